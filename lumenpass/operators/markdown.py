"""Markdown to sections: a state machine over lines in Arrow workers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpass import schemas as S
from lumenpass.functions import plain
from lumenpass.operators.chunking import folded
from lumenpass.options import ChunkOptions

HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
LIST = re.compile(r"^\s*[-+*]\s+|^\s*\d+[.)]\s+")
MARKUP = [re.compile(p) for p in (r"`([^`]+)`", r"\*\*([^*]+)\*\*", r"__([^_]+)__", r"\*([^*]+)\*", r"_([^_]+)_", r"\[(.*?)\]\([^)]+\)")]


def _heading(line: str) -> tuple[int, str] | None:
    m = HEADING.match(line.strip())
    if not m:
        return None
    text = m[2]
    for p in MARKUP:
        text = p.sub(r"\1", text)
    text = plain.normalize_whitespace(text)
    return (len(m[1]), text) if text else None


def _fence(line: str) -> bool:
    return line.lstrip().startswith(("```", "~~~"))


def _related(line: str) -> bool:
    t = line.strip()
    return bool(LIST.match(line)) or (t.startswith("|") and t.endswith("|"))


def sections_of(text: str | None) -> list[tuple[str | None, list[str]]]:
    """(heading path, [block]) of each paragraph, list or table.

    Every blank line ends a section. Fences suspend all parsing. A list or table takes in blank and indented lines; a
    paragraph right before one, without a blank line between, is lost, as it always was.
    """
    lines = [x.replace("\t", "    ").rstrip() for x in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    if lines[0].strip() == "---":
        end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
        lines = lines[end + 1 :] if end else lines
    out: list[tuple[str | None, list[str]]] = []
    stack: list[tuple[int, str]] = []
    held: list[str] = []

    def close(block: list[str]) -> None:
        if body := plain.normalize_whitespace("\n".join(block)):
            out.append((" > ".join(t for _, t in sorted(stack, key=lambda s: s[0])) or None, [body]))

    k, fenced = 0, False
    while k < len(lines):
        line = lines[k]
        k += 1
        if fenced:
            held.append(line)
            fenced = not _fence(line)
        elif _fence(line):
            held.append(line)
            fenced = True
        elif heading := _heading(line):
            close(held)
            held, stack = [], [heading, *[s for s in stack if s[0] < heading[0]]]
        elif not line.strip():
            close(held)
            held = []
        elif _related(line):
            run = [line]
            while k < len(lines) and (not lines[k].strip() or _related(lines[k]) or lines[k].startswith("  ")):
                run.append(lines[k])
                k += 1
            close(run)
            held = []
        else:
            held.append(line)
    close(held)
    return out


def sections(text: Column | str) -> Column:
    """array<struct<heading, blocks>> of a Markdown text."""
    return F.udf(sections_of, f"array<{S.SECTION}>", useArrow=True)(text)


def blocks(text: Column | str) -> Column:
    """Each section's heading, if any, and its blocks."""
    return F.flatten(F.transform(sections(text), lambda s: F.when(s["heading"].isNotNull(), F.concat(F.array(s["heading"]), s["blocks"])).otherwise(s["blocks"])))


def full_text(text: Column | str) -> Column:
    return F.array_join(blocks(text), "\n\n")


def passages(df: DataFrame, options: ChunkOptions = ChunkOptions(), text_col: str = "text") -> DataFrame:
    """Passages of sources (id, display_name, location, Markdown text): read and cut in one pass over Arrow batches."""
    o = (options.max_chars, options.overlap_chars, options.min_chars)
    return folded(df, text_col, lambda t: plain.section_chunks(sections_of(t), *o))


def read_files(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(id, display_name, location, text) of Markdown files; a missing path raises."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("id"), name.alias("display_name"), F.col("path").alias("location"), F.decode("content", "UTF-8").alias("text"))
