"""The same string functions in plain Python, for folds that run in Arrow workers."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from lumenpass import options as O

HYPHEN = re.compile(r"([^\W\d_])-\s+([^\W\d_])")
NUMBERING = re.compile(r"^\s*(?:[0-9]+(?:\.[0-9]+)*|[IVXLCDM]+(?:\.[0-9]+)*)\.?\s+", re.I)
TERM = re.compile(O.TERM)


#: What str.split() takes for white space and the column expressions don't.
CONTROLS = re.compile("[\x1c-\x1f]")
SPACES = re.compile(r"[ \t\n\x0b\x0c\r]+")


def normalize_whitespace(text: str | None) -> str:
    if not text:
        return ""
    if "-" in text:
        text = HYPHEN.sub(lambda m: m[1] + m[2] if m[2].islower() else m[0], text)
    if text.isascii() and not CONTROLS.search(text):
        return " ".join(text.split())
    return SPACES.sub(" ", text).strip(" ")


_short = lru_cache(maxsize=65536)(normalize_whitespace)


def clean_keywords(values: Iterable[str] | None, limit: int | None = O.KEYWORD_LIMIT) -> list[str]:
    seen: dict[str, str] = {}
    for v in values or []:
        if t := _short(v) if v and len(v) < 200 else normalize_whitespace(v):
            seen.setdefault(t.lower(), t)
    kept = list(seen.values())
    return kept if limit is None else kept[: max(0, limit)]


def strip_numbering(text: str) -> str:
    return NUMBERING.sub("", text.strip().rstrip(":")).strip()


def normalized_name(text: str) -> str:
    return normalize_whitespace(strip_numbering(text)).lower()


def is_likely_heading(text: str) -> bool:
    heading = strip_numbering(text)
    found = set(TERM.findall(heading.lower()))
    letters = [c for c in heading if c.isalpha()]
    ratio = sum(c.isupper() for c in letters) / len(letters) if letters else 0.0
    return (
        4 <= len(heading) <= 100
        and len(found) <= 8
        and not any(m[1].isupper() for m in re.finditer(r"[.!?]\s+([^\W\d_])", heading))
        and (ratio >= 0.65 or (len(found) <= 5 and bool(found & set(O.HEADING_TERMS))))
    )


def is_checklist(text: str) -> bool:
    t = normalize_whitespace(text).lower()
    return any(p in t for p in O.CHECKLIST_PHRASES)


def content_role(section_path: list[str], text: str) -> str:
    names = [normalized_name(s) for s in section_path]
    if is_checklist(text) or any(n in O.CHECKLIST_SECTIONS for n in names):
        return "submission_checklist"
    if "abstract" in names:
        return "abstract"
    if any(n.startswith(("references", "bibliography")) for n in names):
        return "references"
    if any(n.startswith("appendix") for n in names):
        return "appendix"
    return "main_body" if names else "unknown"


def structured_role(section_path: list[str], text: str, label: str | None = None) -> str:
    return "front_matter" if label == "title" or len(section_path) == 1 else content_role(section_path, text)


def label_keywords(label: str) -> list[str]:
    if label in ("paragraph", "text"):
        return []
    return ["checkbox"] if label in ("checkbox_selected", "checkbox_unselected") else [label.replace("_", " ")]


def weak_keywords(label: str, classes: list[tuple[str, float]], explicit: Iterable[str] | None) -> list[str]:
    own = clean_keywords(explicit)
    return own or clean_keywords(label_keywords(label) + [c for c, _ in sorted(classes, key=lambda c: -c[1])])


def layout_labels(label: str) -> list[str]:
    return [] if label in ("text", "paragraph", "page_header", "page_footer") else [label]


def role_names(role: str) -> list[str]:
    return [] if role == "unknown" else [O.ROLES[role][0], role]


def chunk_text(text: str | None, max_chars: int, overlap_chars: int, min_chars: int) -> list[tuple[int, str]]:
    """Sliding windows (number, text) over the normalized text; short ones are left out but counted."""
    t = normalize_whitespace(text)
    size = max(1, max_chars)
    step = max(1, size - min(max(0, overlap_chars), size - 1))
    pieces = ((k, t[a : a + size].strip()) for k, a in enumerate(range(0, len(t), step)))
    return [(k, p) for k, p in pieces if len(p) >= min_chars]


def chunk_blocks(blocks: list[str], max_chars: int, overlap_chars: int) -> list[str]:
    """Greedy packing of whole blocks with an overlap of whole blocks.

    Kept as the original behaves: after the first overlap the carried blocks come in reverse, and a chunk that only
    holds the overlap is put out when the next block doesn't fit beside it.
    """
    size = max(1, max_chars)
    overlap = min(max(0, overlap_chars), size - 1)
    out: list[str] = []
    held: list[str] = []  # newest first
    length, k = 0, 0
    while k < len(blocks):
        block = blocks[k]
        if len(block) > size and not held:
            out.append(block)
            k += 1
        elif held and length + len(block) + 2 > size:
            out.append("\n\n".join(reversed(held)))
            carried: list[str] = []
            taken = 0
            for b in held:
                if len(carried) == len(held) - 1 or (carried and taken + len(b) + 2 > overlap):
                    break
                carried.insert(0, b)
                taken += len(b) + 2
            held = carried
            length = sum(map(len, held)) + 2 * max(0, len(held) - 1)
        else:
            held.insert(0, block)
            length += len(block) + 2
            k += 1
    if held:
        out.append("\n\n".join(reversed(held)))
    return out


def split_sections(blocks: list[str]) -> list[tuple[str | None, list[str]]]:
    """(heading, blocks) of runs of blocks under likely headings; headings without blocks vanish."""
    out: list[tuple[str | None, list[str]]] = []
    heading: str | None = None
    held: list[str] = []
    for block in blocks:
        if is_likely_heading(block):
            if held:
                out.append((heading, held))
            heading, held = strip_numbering(block), []
        else:
            held.append(block)
    if held:
        out.append((heading, held))
    return out


def section_path(heading: str | None) -> list[str]:
    return [p for p in (x.strip() for x in (heading or "").split(" > ")) if p]


def section_chunks(sections: list[tuple[str | None, list[str]]], max_chars: int, overlap_chars: int, min_chars: int) -> list[tuple[list[str], str, str]]:
    """(section path, role, text) of each chunk."""
    out = []
    for heading, blocks in sections:
        path = section_path(heading)
        for chunk in chunk_blocks(blocks, max_chars, overlap_chars):
            text = chunk if heading is None else f"{O.SECTION_PREFIX} {heading}\n{chunk}"
            bounded = [t for _, t in chunk_text(text, max_chars, overlap_chars, min_chars)] if len(text) > max(1, max_chars) else [text]
            out += [(path, content_role(path, t), t) for t in bounded]
    return out
