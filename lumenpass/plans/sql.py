"""Pieces of DuckDB SQL that say what the operators do, and the folds among them as recursive queries."""

from __future__ import annotations

from lumenpass.options import CHECKLIST_PHRASES, HEADING_TERMS, ROLES, TERM

def s_norm(x: str) -> str:
    joined = rf"regexp_replace(coalesce({x}, ''), '(\p{{L}})-\s+(\p{{Ll}})', '\1\2', 'g')"
    return rf"trim(regexp_replace({joined}, '\s+', ' ', 'g'))"


def s_terms(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{TERM}')"


def s_strip(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(trim({x}), ':+$', ''), '^\s*(?:[0-9]+(?:\.[0-9]+)*|[IVXLCDM]+(?:\.[0-9]+)*)\.?\s+', '', 'i'))"


def s_name(x: str) -> str:
    return f"lower({s_norm(s_strip(x))})"


def s_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def s_windows(x: str, size: int = 1800, overlap: int = 250, least: int = 20) -> str:
    """(n, t) rows of a normalized text column in FROM."""
    step = size - overlap
    return f"""(SELECT g AS idx, trim(substr({x}, (g * {step} + 1)::BIGINT, {size})) AS txt
      FROM (SELECT unnest(range(0, CASE WHEN length({x}) = 0 THEN 0 ELSE (length({x}) - 1) // {step} + 1 END)) AS g))"""


def s_cleaned(x: str) -> str:
    """A list without later spellings of the same word."""
    return f"list_transform(list_filter(list_zip({x}, range(1, len({x}) + 1)), lambda p: list_position(list_transform({x}, lambda y: lower(y)), lower(p[1])) = p[2]), lambda p: p[1])"


def s_markup(x: str) -> str:
    for pattern in (r"`([^`]+)`", r"\*\*([^*]+)\*\*", r"__([^_]+)__", r"\*([^*]+)\*", r"_([^_]+)_", r"\[(.*?)\]\([^)]+\)"):
        x = rf"regexp_replace({x}, '{pattern}', '\1', 'g')"
    return x


def s_heading(line: str, h: str) -> str:
    """Whether a line whose text without numbering is ``h`` looks like a heading."""
    letters, upper = (rf"length(regexp_replace({h}, '[^\p{{{k}}}]', '', 'g'))" for k in ("L", "Lu"))
    return rf"""length({h}) BETWEEN 4 AND 100 AND len(list_distinct({s_terms(h)})) <= 8 AND NOT regexp_matches({h}, '[.!?]\s+\p{{Lu}}')
      AND ((CASE WHEN {letters} = 0 THEN 0.0 ELSE {upper} / {letters} END) >= 0.65 OR (list_has_any({s_terms(h)}, {s_list(HEADING_TERMS)}) AND len(list_distinct({s_terms(h)})) <= 5))"""


_CHECK = " OR ".join(f"contains(t, '{p}')" for p in CHECKLIST_PHRASES)
#: The role of a row with ``t`` (its text, lower-cased and tidy) and ``names`` (of its sections).
S_ROLE = f"""CASE WHEN {_CHECK} OR list_has_any(names, ['neurips paper checklist', 'genai usage disclosure']) THEN 'submission_checklist' WHEN list_contains(names, 'abstract') THEN 'abstract'
  WHEN len(list_filter(names, lambda n: starts_with(n, 'references') OR starts_with(n, 'bibliography'))) > 0 THEN 'references'
  WHEN len(list_filter(names, lambda n: starts_with(n, 'appendix'))) > 0 THEN 'appendix' WHEN len(names) > 0 THEN 'main_body' ELSE 'unknown' END"""
S_DISPLAY = "CASE role " + " ".join(f"WHEN '{k}' THEN '{d}'" for k, (d, _) in ROLES.items()) + " END"


def s_packed(source: str, key: str, size: int, overlap: int) -> str:
    """CTEs ``walk`` and ``packed`` (key, k, txt) of blocks (key, i from 1, t): one step for each block or chunk."""
    carried = f"least(len(held) - 1, greatest(1, len(list_filter(range(1, len(held) + 1), lambda i: list_sum(list_transform(held[1:i], lambda x: length(x) + 2)) <= {overlap}))))"
    whole = "array_to_string(list_reverse(held), chr(10) || chr(10))"
    of_walk = ", ".join(f"w.{k}" for k in key.split(", "))
    return f"""walk AS (
      SELECT {key}, 0 AS step, 1 AS pos, []::VARCHAR[] AS held, 0 AS n, NULL::VARCHAR AS txt FROM (SELECT DISTINCT {key} FROM {source})
      UNION ALL
      SELECT {key}, step + 1, CASE act WHEN 'alone' THEN pos + 1 WHEN 'add' THEN pos + 1 ELSE pos END,
        CASE act WHEN 'add' THEN list_prepend(t, held) WHEN 'full' THEN rest ELSE []::VARCHAR[] END,
        CASE act WHEN 'add' THEN n + length(t) + 2 WHEN 'full' THEN (coalesce(list_sum(list_transform(rest, lambda x: length(x))), 0) + 2 * greatest(0, len(rest) - 1))::INT ELSE 0 END,
        CASE act WHEN 'alone' THEN t WHEN 'add' THEN NULL ELSE {whole} END
      FROM (
        SELECT {of_walk}, step, pos, held, n, b.t, list_reverse(held[1:{carried}]) AS rest,
          CASE WHEN b.t IS NULL THEN 'end' WHEN length(b.t) > {size} AND len(held) = 0 THEN 'alone' WHEN len(held) > 0 AND n + length(b.t) + 2 > {size} THEN 'full' ELSE 'add' END AS act
        FROM walk w LEFT JOIN {source} b ON {" AND ".join(f"w.{k} = b.{k}" for k in key.split(", "))} AND b.i = w.pos
        WHERE b.t IS NOT NULL OR len(held) > 0)),
    packed AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY step) - 1 AS k, txt FROM walk WHERE txt IS NOT NULL)"""


_LINE_LIST = f"SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {s_norm('x')}), lambda x: x <> '') AS blocks FROM documents"
_BLOCKS = f"blocks AS (SELECT doc_id, i, blocks[i] AS t FROM (SELECT doc_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM ({_LINE_LIST})))"

PACK_BLOCKS = f"WITH RECURSIVE {_BLOCKS}, {s_packed('blocks', 'doc_id', 600, 120)} SELECT doc_id::VARCHAR AS id, k::INT AS k, txt AS text FROM packed"

_SECTIONED = f"""WITH RECURSIVE {_BLOCKS},
  marked AS (SELECT *, {s_heading("t", "h")} AS head FROM (SELECT *, {s_strip("t")} AS h FROM blocks)),
  placed AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM marked),
  headings AS (SELECT doc_id, sec, max(h) FILTER (head) AS heading FROM placed GROUP BY ALL),
  bodies AS (SELECT doc_id, sec, row_number() OVER (PARTITION BY doc_id, sec ORDER BY i) AS i, t FROM placed WHERE NOT head),
  {s_packed("bodies", "doc_id, sec", 1800, 250)},
  chunks AS (SELECT doc_id, sec, k, heading, CASE WHEN heading IS NULL THEN txt ELSE 'Section: ' || heading || chr(10) || txt END AS txt FROM packed JOIN headings USING (doc_id, sec)),
  bounded AS (SELECT doc_id, sec, k, 0 AS w, heading, txt FROM chunks WHERE length(txt) <= 1800
    UNION ALL SELECT doc_id, sec, k, w.idx, heading, w.txt FROM (SELECT *, {s_norm("txt")} AS whole FROM chunks WHERE length(txt) > 1800) c, LATERAL {s_windows("c.whole")} w WHERE length(w.txt) >= 20),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec, k, w) - 1 AS nth FROM bounded)"""

CHUNK_SECTIONED_BLOCKS = f"{_SECTIONED} SELECT doc_id::VARCHAR AS id, nth::INT AS k, txt AS text FROM numbered"

PASSAGES_FROM_BLOCKS = f"""{_SECTIONED} SELECT doc_id::VARCHAR AS source_id, nth::INT AS "index", txt AS text, coalesce(heading, '') AS path, {S_ROLE} AS content_role
  FROM (SELECT *, lower({s_norm("txt")}) AS t, CASE WHEN heading IS NULL THEN [] ELSE [{s_name("heading")}] END AS names FROM numbered)"""

#: Documents dressed up as Markdown, by the place of each line (from 1).
S_MARKDOWN = """CASE WHEN doc_id % 4 = 0 THEN '---' || chr(10) || 'key: value' || chr(10) || '---' || chr(10) ELSE '' END || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE
  WHEN i % 9 = 3 THEN '## ' || x WHEN i % 9 = 5 THEN '### **' || x || '** #' WHEN i % 9 = 8 THEN '# [' || x || '](y)' WHEN i % 11 = 6 THEN '- ' || x WHEN i % 11 = 7 THEN '  more ' || x
  WHEN i % 13 = 9 THEN '| ' || x || ' |' WHEN i % 17 = 10 OR i % 17 = 13 THEN '```' WHEN i % 5 = 4 THEN '' WHEN i % 7 = 2 THEN chr(9) || x || '  ' ELSE x END), chr(10))"""

_ATX = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
MARKDOWN_SECTIONS = rf"""WITH RECURSIVE raw AS (SELECT doc_id, list_transform(string_split({S_MARKDOWN}, chr(10)), lambda x: regexp_replace(replace(x, chr(9), '    '), '\s+$', '')) AS ls FROM documents),
  body AS (SELECT doc_id, CASE WHEN trim(ls[1]) = '---' AND front > 0 THEN ls[front + 2:] ELSE ls END AS ls FROM (SELECT *, coalesce(list_position(list_transform(ls[2:], lambda x: trim(x)), '---'), 0) AS front FROM raw)),
  lines AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM body)),
  seen AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence, trim(line) = '' AS blank, starts_with(line, '  ') AS inset,
    regexp_matches(line, '^\s*[-+*]\s+') OR regexp_matches(line, '^\s*\d+[.)]\s+') OR (starts_with(trim(line), '|') AND ends_with(trim(line), '|')) AS rel,
    CASE WHEN regexp_matches(trim(line), '{_ATX}') AND {s_norm(s_markup(f"regexp_extract(trim(line), '{_ATX}', 2)"))} <> '' THEN length(regexp_extract(trim(line), '{_ATX}', 1)) END AS level,
    {s_norm(s_markup(f"regexp_extract(trim(line), '{_ATX}', 2)"))} AS title FROM lines),
  walk AS (
    SELECT doc_id, 0 AS i, FALSE AS fenced, FALSE AS run, 0 AS blk, 'x' AS kind, []::STRUCT(l BIGINT, t VARCHAR)[] AS stack FROM body
    UNION ALL
    SELECT doc_id, i, CASE WHEN more THEN FALSE WHEN fenced THEN NOT fence ELSE fence END, kind = 'r', blk + CASE WHEN more OR (kind = 'h' AND before = 'h') THEN 0 ELSE 1 END, kind,
      CASE WHEN kind = 'x' AND level IS NOT NULL THEN list_append(list_filter(stack, lambda s: s.l < level), {{'l': level, 't': title}}) ELSE stack END
    FROM (SELECT *, CASE WHEN more THEN 'r' WHEN fenced OR fence THEN 'h' WHEN level IS NOT NULL OR blank THEN 'x' WHEN rel THEN 'r' ELSE 'h' END AS kind
      FROM (SELECT w.doc_id, n.i, w.fenced, w.blk, w.kind AS before, w.stack, n.fence, n.blank, n.rel, n.level, n.title, w.run AND (n.blank OR n.rel OR n.inset) AS more
        FROM walk w JOIN seen n ON n.doc_id = w.doc_id AND n.i = w.i + 1))),
  runs AS (SELECT doc_id, blk, any_value(kind) AS kind, min(i) AS first, max(i) AS last, any_value(nullif(array_to_string(list_transform(stack, lambda s: s.t), ' > '), '')) AS heading,
    {s_norm("string_agg(line, chr(10) ORDER BY i)")} AS body FROM walk JOIN lines USING (doc_id, i) WHERE kind <> 'x' GROUP BY doc_id, blk),
  kept AS (SELECT * FROM runs a WHERE body <> '' AND NOT (kind = 'h' AND EXISTS (SELECT 1 FROM runs b WHERE b.doc_id = a.doc_id AND b.kind = 'r' AND b.first = a.last + 1)))
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS k, heading, body FROM kept"""

DOCUMENT_PASSAGES = f"""WITH RECURSIVE held AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
  items AS (SELECT doc_id, i, CASE WHEN i = 1 THEN 'title' WHEN i = 2 THEN 'section_header' WHEN i = len(ls) THEN 'caption' ELSE 'text' END AS label, {s_norm("CASE WHEN i = 2 THEN '1 ' || ls[i] ELSE ls[i] END")} AS txt,
    CASE WHEN i = 1 THEN [{s_norm("ls[1]")}] ELSE [{s_norm("ls[1]")}, {s_norm("'1 ' || ls[2]")}] END AS path FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM held)),
  roled AS (SELECT *, CASE WHEN i = 1 THEN 'front_matter' ELSE {S_ROLE} END AS role FROM (SELECT *, lower({s_norm("txt")}) AS t, list_transform(path, lambda p: {s_name("p")}) AS names FROM items)),
  worded AS (SELECT doc_id, i, txt, {s_cleaned("path")} AS path, role, {s_cleaned("x")}[1:32] AS words FROM (SELECT *, CASE label WHEN 'text' THEN [] ELSE [replace(label, '_', ' ')] END || CASE label WHEN 'caption' THEN [txt] ELSE [] END || path || CASE role WHEN 'unknown' THEN [] ELSE [{S_DISPLAY}, role] END AS x FROM roled)),
  walk AS (
    SELECT DISTINCT doc_id, 0 AS i, 0 AS g, FALSE AS open, 0::BIGINT AS n, []::VARCHAR[] AS path, '' AS role FROM items
    UNION ALL
    SELECT doc_id, i, CASE WHEN fresh THEN g + 1 ELSE g END, length(txt) <= 1800, CASE WHEN fresh THEN length(txt) ELSE n + length(txt) + 2 END, path, role
    FROM (SELECT w.doc_id, b.i, w.g, w.n, b.txt, b.path, b.role, NOT w.open OR w.path <> b.path OR w.role <> b.role OR length(b.txt) > 1800 OR w.n + length(b.txt) + 2 > 1800 AS fresh
      FROM walk w JOIN worded b ON b.doc_id = w.doc_id AND b.i = w.i + 1)),
  grouped AS (SELECT doc_id, g, min(i) AS first, {s_norm("string_agg(txt, chr(10) || chr(10) ORDER BY i)")} AS txt, bool_or(NOT open) AS long, any_value(w.path) AS path, any_value(w.role) AS role,
    list(i ORDER BY i) AS pages, flatten(list(words ORDER BY i)) AS x FROM walk w JOIN worded USING (doc_id, i) GROUP BY doc_id, g),
  cut AS (SELECT doc_id, g, 0 AS w, txt, path, role, pages, x FROM grouped WHERE NOT long
    UNION ALL SELECT doc_id, g, w.idx, w.txt, path, role, pages, x FROM grouped c, LATERAL {s_windows("c.txt")} w WHERE long AND length(w.txt) >= 20)
  SELECT doc_id::VARCHAR AS source_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g, w) - 1)::INT AS "index", txt AS text, array_to_string(path, ' > ') AS path, role AS content_role,
    array_to_string(pages, ',') AS pages, array_to_string({s_cleaned("x")}[1:32], '|') AS keywords FROM cut"""
