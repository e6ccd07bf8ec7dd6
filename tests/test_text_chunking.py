import pytest
from lumenpass.functions import plain
from lumenpass.functions import text as T
from lumenpass.operators import chunking, markdown
from lumenpass.options import ChunkOptions
from pyspark.sql import functions as F


def one(spark, column, *values):
    """A column over one row of values v0, v1, ..."""
    row = spark.range(1).select(*[F.lit(v).alias(f"v{k}") if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(f"v{k}") for k, v in enumerate(values)])
    return row.select(column.alias("x")).first()[0]


STRINGS = ["", " ", "Introduc-\n tion here", "A- B", "IV. RESULTS:", "1.2 Related work", "Mix methods", "Civil War", "ABSTRACT", "the results of a very long heading with many more words than that", "Hello. World", "3", "Justification: yes", "x\ty  z"]


@pytest.mark.parametrize("text", STRINGS)
def test_plain_and_column_agree(spark, text):
    for column, own in ((T.normalize_whitespace, plain.normalize_whitespace), (T.strip_numbering, plain.strip_numbering), (T.normalized_name, plain.normalized_name), (T.is_likely_heading, plain.is_likely_heading), (T.is_checklist, plain.is_checklist)):
        assert one(spark, column("v0"), text) == own(text), column.__name__


def test_terms_and_nulls(spark):
    assert one(spark, T.term_matches("v0"), "Apple apple banana. ab a-b-c x_y") == ["apple", "apple", "banana", "a-b-c", "x_y"]
    assert one(spark, T.terms("v0"), "pear apple pear") == ["apple", "pear"]
    assert spark.sql("select cast(null as string) v0").select(T.term_matches("v0").alias("a"), T.normalize_whitespace("v0").alias("b"), T.truncate("v0", 3).alias("c")).first() == ([], "", None)
    assert one(spark, T.term_frequencies_of("v0"), ["car", "automobile car"]) == ["car", "automobile", "car"]
    assert one(spark, T.truncate("v0", 5), "abcd efgh") == "abcd..."


def test_fuzzy_sections(spark):
    for a, b, want in (("abtract", "ABSTRACT", True), ("intrduction", "INTRODUCTION", True), ("results", "REFERENCES", False), ("", "", True), ("", "a", False)):
        assert one(spark, T.section_matches("v0", "v1"), a, b) is want


def test_headings_and_roles(spark):
    assert one(spark, T.heading_of("v0"), "section: Méthode \nrest") == "Méthode"
    assert one(spark, T.heading_of("v0"), "Section: \nrest") is None and one(spark, T.heading_of("v0"), "other") is None
    assert one(spark, T.format_chunk(F.lit(None).cast("string"), "v0"), "x") == "x"
    for path, text, role in (([], "x", "unknown"), (["1 Abstract"], "x", "abstract"), (["A", "References and notes"], "x", "references"), (["Appendix B"], "x", "appendix"), (["Body"], "Answer: [Yes]", "submission_checklist"), (["Body"], "x", "main_body")):
        assert one(spark, T.content_role("v0", "v1"), path, text) == role == plain.content_role(path, text)
    assert one(spark, T.structured_role("v0", "v1"), ["Only"], "x") == "front_matter"
    assert one(spark, T.role_of_storage("v0"), " Main Body ") == "main_body" and one(spark, T.role_of_storage("v0"), "?") == "unknown"
    assert one(spark, T.numbered_heading_parts("v0"), "4.3 Setup") == [4, 3] and one(spark, T.numbered_heading_parts("v0"), "99999999999 x") is None
    assert one(spark, T.markdown_heading("v0"), "## **Bold** `x` [l](u) ##") == (2, "Bold x l")


def test_keyword_columns(spark):
    assert one(spark, T.clean_keywords("v0", 2), [" A  b", "a B", "", "c", "d"]) == ["A b", "c"]
    assert one(spark, T.merge_keywords("v0", "v1", 16, True), ["x"], ["y"]) == ["y"]
    assert one(spark, T.label_keywords("v0"), "key_value_region") == ["key value region"] and one(spark, T.label_keywords("v0"), "text") == []


def test_letters_in_windows(spark):
    o = ChunkOptions(10, 2, 1)
    want = [(0, "abcdefghij"), (1, "ijklmnopqr"), (2, "qrstuvwxyz"), (3, "yz")]
    assert [tuple(x) for x in one(spark, chunking.chunk_text("v0", o), "abcdefghijklmnopqrstuvwxyz")] == want == plain.chunk_text("abcdefghijklmnopqrstuvwxyz", 10, 2, 1)
    assert one(spark, chunking.chunk_text("v0", o), "") == []
    assert [x[0] for x in one(spark, chunking.chunk_text("v0", ChunkOptions(10, 2, 5)), "abcdefghijklmnopqrstuvwxyz")] == [0, 1, 2]


@pytest.mark.parametrize(
    "size,overlap,blocks,want",
    [
        (20, 14, "aaa bbb ccc ddd eee fff".split(), ["aaa|bbb|ccc|ddd", "ddd|ccc|eee|fff"]),
        (20, 1, ["a" * 8, "b" * 8, "c" * 12, "d"], ["aaaaaaaa|bbbbbbbb", "bbbbbbbb", "cccccccccccc|d"]),
        (10, 4, ["aa", "bb", "x" * 15, "cc"], ["aa|bb", "bb", "x" * 15, "cc"]),
        (10, 4, [], []),
    ],
)
def test_block_packing(spark, size, overlap, blocks, want):
    assert [x.replace("\n\n", "|") for x in plain.chunk_blocks(blocks, size, overlap)] == want
    assert [x.replace("\n\n", "|") for x in one(spark, chunking.chunk_blocks("v0", ChunkOptions(size, overlap, 1)), blocks)] == want


def blocks_table(spark, blocks):
    return spark.createDataFrame([("s", "S", "/s", blocks)], "id string, display_name string, location string, blocks array<string>")


def test_passages_from_blocks(spark):
    df = blocks_table(spark, ["Title", "ABSTRACT", "We present a retrieval method for long documents with many pages.", "INTRODUCTION", "Search matters."])
    got = chunking.passages_from_blocks(df, ChunkOptions(200, 20, 20)).orderBy("index").collect()
    assert any(x.text.startswith("Section: ABSTRACT") and "retrieval method" in x.text and x.content_role == "abstract" for x in got)
    assert [x["index"] for x in got] == list(range(len(got)))
    long = "The bounded chunk keeps every passage at eighty characters or fewer in every case."
    got = chunking.passages_from_blocks(blocks_table(spark, ["ABSTRACT", long]), ChunkOptions(80, 10, 1)).orderBy("index").collect()
    assert all(len(x.text) <= 80 for x in got) and got[0].section_path == ["ABSTRACT"]


def test_sources(spark):
    from lumenpass.sources import documents

    s = documents.sources(spark, [("a", "A", "/a", "word " * 30, True), ("b", "B", "/b", "word " * 30, False), ("c", "C", "/c", None, True)])
    assert {x.source_id for x in chunking.split_passages(s).collect()} == {"a"}
    p = documents.prechunked(spark, [("a", "A", "/a", ["x", " y "], False)])
    assert [(x["index"], x.text) for x in chunking.passages_from_chunks(p).orderBy("index").collect()] == [(0, "x"), (1, " y ")]
    assert documents.as_pdf(p).first().display_name == "PDF: A"


MARKDOWN = "---\ntitle: x\n---\n# Project Guide\n\nIntro text.\n\n## Setup\n\n### macOS\n\nInstall it with the tool.\n\n- one\n- two\n\n```\n# no heading\n```\n\nlost paragraph\n- item\n  more\n\n| a | b |\n"


def test_markdown(spark):
    sections = markdown.sections_of(MARKDOWN)
    assert sections[0] == ("Project Guide", ["Intro text."])
    path = "Project Guide > Setup > macOS"
    assert sections[1:3] == [(path, ["Install it with the tool."]), (path, ["- one - two"])]
    assert ("lost paragraph" in str(sections)) is False and (path, ["- item more | a | b |"]) in sections
    assert any("# no heading" in b[0] for _, b in sections)
    assert markdown.sections_of("---\nopen") == [(None, ["--- open"])] and markdown.sections_of(None) == []
    df = spark.createDataFrame([("m", "M", "/m", MARKDOWN), ("n", "N", "/n", None)], "id string, display_name string, location string, text string")
    texts = [x.text for x in markdown.passages(df, ChunkOptions(200, 20, 1)).orderBy("index").collect()]
    assert f"Section: {path}\nInstall it with the tool." in texts and f"Section: {path}\n- one - two" in texts
    assert markdown.full_text("text") is not None and df.select(markdown.full_text("text").alias("t")).first().t.startswith("Project Guide\n\nIntro text.")


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nBody é.\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("no")
    files = markdown.read_files(spark, str(tmp_path))
    assert [(x.display_name, x.text) for x in files.collect()] == [("a.md", "# T\n\nBody é.\n")]


def test_sections_by_window(spark):
    rows = [(1, 0, "intro"), (1, 1, "RESULTS"), (1, 2, "a"), (1, 3, "b"), (1, 4, "1. METHODS"), (2, 0, "only")]
    got = chunking.split_sections(spark.createDataFrame(rows, "doc_id long, block_no int, text string"))
    assert sorted((x.doc_id, x.heading or "", x.blocks) for x in got.collect()) == [(1, "", ["intro"]), (1, "RESULTS", ["a", "b"]), (2, "", ["only"])]
