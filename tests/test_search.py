import math
import re
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from lumenpass.operators import encoder, keywords, scoring, search, tfidf
from lumenpass.options import EncoderConfig, KeywordOptions, SearchOptions, TfidfOptions
from lumenpass.plans import index_build, render
from lumenpass.sources import index_store
from pyspark.sql import functions as F

EMPTY = ([], "unknown", [], [], [], [])


def passages(spark, rows):
    """rows: (source_id, text) or (source_id, text, keywords)."""
    from lumenpass.schemas import PASSAGES

    return spark.createDataFrame([(r[0], f"PDF: {r[0]}", f"/tmp/{r[0]}.pdf", k, r[1], [], "unknown", [], [], [], list(r[2]) if len(r) > 2 else []) for k, r in enumerate(rows)], PASSAGES)


def index_of(spark, rows, vectors=None, dim=2):
    df = passages(spark, rows).withColumn("ordinal", F.col("index").cast("long"))
    posted = tfidf.postings(df)
    v = spark.createDataFrame([(k, [float(x) for x in vec]) for k, vec in enumerate(vectors or [[1, 0]] * len(rows))], "ordinal long, vectors array<float>")
    return search.Index(df, v, posted, tfidf.terms(posted, len(rows)), len(rows), embedding_dim=dim)


def ask(spark, text, terms=None):
    return spark.createDataFrame([(1, text, terms or [])], "query_id long, query string, more array<string>")


def hits(spark, index, text, vector, options=SearchOptions(), terms=None):
    q = spark.createDataFrame([(1, [float(x) for x in vector])], "query_id long, vectors array<float>")
    return search.query_encoded(index, ask(spark, text, terms), q, options, "more").orderBy("rank").collect()


def test_idf_and_scores(spark):
    i = index_of(spark, [("a", "common rare"), ("b", "common shared"), ("c", "common shared")])
    idf = {x.term: x.idf for x in i.terms.collect()}
    assert idf["rare"] == pytest.approx(math.log(2) + 1) and idf["common"] == pytest.approx(1.0)
    i = index_of(spark, [("a", "alpha beta"), ("b", "gamma delta")])
    got = search.candidates(i, ask(spark, "gamma")).collect()
    assert [(x.ordinal, pytest.approx(x.lexical)) for x in got] == [(1, 0.5 * (math.log(1.5) + 1) ** 2)]


def test_search_terms_and_keywords(spark):
    i = index_of(spark, [("a", "automobile repair manual"), ("b", "kitchen recipe notes")])
    assert search.candidates(i, ask(spark, "car"), search_terms="more").collect() == []
    assert [x.ordinal for x in search.candidates(i, ask(spark, "car", ["automobile"]), search_terms="more").collect()] == [0]
    i = index_of(spark, [("a", "plain text here", ["orthodontia", "dental braces"]), ("b", "other words there")])
    assert [x.ordinal for x in search.candidates(i, ask(spark, "orthodontia")).collect()] == [0]
    assert search.candidates(i, ask(spark, "")).collect() == []


def test_weights(spark):
    df = passages(spark, [("a", "one two", ["two"])]).withColumn("ordinal", F.lit(0))
    tf = lambda o: {x.term: x.tf for x in tfidf.postings(df, o).collect()}
    assert tf(TfidfOptions()) == {"one": 0.5, "two": 3.5} and tf(TfidfOptions(1.0, -1.0)) == {"one": 0.5, "two": 0.5} and tf(TfidfOptions(0.0, 0.0)) == {}
    assert tuple(tfidf.meta(df).first()) == (1, 5.0)


def test_max_sim(spark):
    q, d = np.array([[1, 0], [0, 1]]), np.array([[0.9, 0.1], [0.2, 0.8]])
    assert scoring.max_sim_of(q, d) == pytest.approx(1.7)
    assert scoring.max_sim_of(np.ones((1, 11)), np.array([[1.0] * 11, [2.0] * 11])) == pytest.approx(22)
    assert scoring.max_sim_of(q, np.zeros((0, 2))) == 0 and scoring.max_sim_of(np.array([[np.nan, 0]]), d) == 0
    with pytest.raises(ValueError):
        scoring.max_sim_of(q, np.ones((1, 3)))
    row = spark.range(1).select(F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("q"), F.array(F.array(F.lit(0.9), F.lit(0.1)), F.array(F.lit(0.2), F.lit(0.8))).alias("d"))
    assert row.select(scoring.max_sim("q", "d")).first()[0] == pytest.approx(1.7)


def test_dense_rerank(spark):
    i = index_of(spark, [("one", "apple topic"), ("two", "apple topic"), ("three", "orange topic")], [[1, 0], [0, 1], [0, 1]])
    got = hits(spark, i, "apple", (0, 1), SearchOptions(max_results=1, candidate_limit=0, lexical_weight=0.0))
    assert [x.ordinal for x in got] == [1]
    assert hits(spark, i, "apple", (0, 1), SearchOptions(max_results=0)) == []
    linear = hits(spark, i, "apple", (0, 1), SearchOptions(use_rrf=False))
    assert [(x.ordinal, pytest.approx(x.score)) for x in linear] == [(1, 1 + 0.15 * linear[0].lexical), (0, 0.15 * linear[1].lexical)]


def test_rrf_scores_and_no_filter(spark):
    i = index_of(spark, [("one", "apple topic"), ("two", "apple topic"), ("three", "orange topic")], [[1, 0], [0, 1], [0, 2]])
    got = hits(spark, i, "apple", (0, 1))
    assert [(x.ordinal, pytest.approx(x.score)) for x in got] == [(1, 1 / 61 + 0.15 / 62), (0, 1 / 62 + 0.15 / 61)]
    got = hits(spark, i, "nothing", (0, 1), SearchOptions(use_lexical_filter=False))
    assert [x.ordinal for x in got] == [2, 1, 0] and got[0].score == pytest.approx(1 / 61 + 0.15 / 63)
    got = hits(spark, index_of(spark, [("one", "automobile topic"), ("two", "kitchen topic")], [[0, 1], [1, 0]]), "car", (0, 1), terms=["automobile"])
    assert [x.ordinal for x in got] == [0]


@pytest.mark.parametrize("m,lw", [(1, 0.15), (3, 0.9), (3, 0.0), (2, 5.0), (40, 0.15)])
def test_depth_holds_all_results(spark, m, lw):
    r = np.random.default_rng(3)
    n = 60
    i = index_of(spark, [(str(k), "some text") for k in range(n)], r.normal(size=(n, 2)).round(1).tolist())
    got = hits(spark, i, "nothing", (1, 0), SearchOptions(use_lexical_filter=False, max_results=m, lexical_weight=lw, fusion_k=5))
    dense = np.array([x.vectors[0] for x in i.vectors.orderBy("ordinal").collect()])
    rank = np.empty(n)
    rank[np.argsort(-dense, kind="stable")] = np.arange(1, n + 1)
    score = 1 / (5 + rank) + lw / (5 + np.arange(1, n + 1))
    want = sorted(range(n), key=lambda k: (-score[k], -dense[k], k))[:m]
    assert [x.ordinal for x in got] == want and [x.score for x in got] == pytest.approx(score[want])


def test_keywords(spark):
    df = passages(spark, [("a", "text", [" Old ", "old"]), ("b", "text")])
    made = keywords.elaborate(df, KeywordOptions(batch_size=1, generator=lambda batch: [(p["source_id"], p["index"], ["new", "OLD"]) for p in batch if p["source_id"] == "a"]))
    assert {x.source_id: x.keywords for x in made.collect()} == {"a": ["Old", "new"], "b": []}
    swapped = keywords.elaborate(df, KeywordOptions(replace_existing=True, generator=lambda batch: [("a", 0, ["new"])]))
    assert {x.source_id: x.keywords for x in swapped.collect()}["a"] == ["new"]
    assert keywords.elaborate(df).collect() == df.collect()
    context = {x.source_id: x.keywords for x in keywords.add_context(df).collect()}
    assert context["b"] == ["Unknown"]


class Fixed:
    """Gives every passage the same vectors."""

    def encode_documents(self, table):
        return table.select("ordinal", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vectors"))

    def encode_queries(self, queries):
        return queries.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vectors"))


def test_build_save_load_query(spark, tmp_path):
    sources = spark.createDataFrame([(k, k, f"/{k}", f"the {w} topic is described in this text about {w}", True) for k, w in (("a", "apple"), ("b", "orange"))], "id string, display_name string, location string, text string, enabled boolean")
    told = []
    index = index_build.from_sources(sources, Fixed(), embedding_dim=2, progress=lambda *a: told.append(a))
    assert told[0][0] == 0 and told[-1][0] == 5
    assert [(x.ordinal, x.source_id) for x in index.passages.orderBy("ordinal").collect()] == [(0, "a"), (1, "b")]
    queries = spark.createDataFrame([(1, "apple"), (2, "nothing else")], "query_id long, query string")
    want = search.query(index, queries, Fixed()).collect()
    assert [(x.query_id, x.ordinal) for x in want] == [(1, 0)]
    path = str(tmp_path / "index")
    index_store.save(index, path)
    back, error = index_store.try_load(spark, path)
    assert error is None and back.passage_count == 2 and search.query(back, queries, Fixed()).collect() == want
    assert [p for p, _ in index_store.load_many(spark, str(tmp_path))] == [path]
    assert index_store.try_load(spark, str(tmp_path / "none")) == (None, None) and index_store.load_many(spark, str(tmp_path / "none")) == []
    with pytest.raises(index_build.Cancelled):
        index_build.from_sources(sources, Fixed(), cancelled=lambda: True)
    full = search.with_references(back, search.query(back, queries, Fixed()))
    shown = {x.query_id: x.context for x in render.render_context(full, 10, queries).collect()}
    assert shown == {1: "[1] a chunk 0\nthe apple...", 2: render.NO_CONTEXT}


def test_render_inventory(spark):
    s = spark.createDataFrame([("2", "B", True), ("1", "A", False), ("3", "C", True)], "id string, display_name string, enabled boolean")
    assert render.source_inventory(s).first()[0] == "[1] B\n[2] C" and render.source_inventory(s.limit(0)).first()[0] == render.NO_SOURCES


@pytest.mark.parametrize("version", [2, 3, 4, 5, 6])
def test_binary_import(spark, tmp_path, version):
    from lumenpass.options import ChunkOptions

    p = {"source_id": "s", "source_display_name": "S", "source_location": "/s", "index": 3, "text": "é" * 200, "keywords": ["k"], "section_path": ["A", "B"], "content_role": "abstract", "page_numbers": [2, 3], "layout_labels": ["table"], "captions": ["c"], "terms": ["t"], "embedding_dim": 2, "token_count": 2, "token_ids": [7, 8], "vectors": [1.0, 0.0, 0.0, 1.0]}
    index = {"config": [48, 512, 2, 1, 1, 2, 3, 4, 5, True, True, ["."]], "chunk_options": ChunkOptions(), "tfidf_options": TfidfOptions(2.0, 4.0), "created_at_ms": 1000, "passages": [p], "passage_count": 1, "avg_len": 2.0, "vocabulary": [("system", 1, 1.0, [(0, 0.5)])]}
    if version == 6:
        raw = index_store.encode_binary(index, "OLD-IDX")
    else:
        raw = old_version(index, version)
    got = index_store.decode_binary(raw, "OLD-IDX")
    q = got["passages"][0]
    assert q["text"] == p["text"] and q["vectors"] == p["vectors"] and got["vocabulary"] == index["vocabulary"]
    assert q["keywords"] == (["k"] if version >= 3 else []) and q["section_path"] == (["A", "B"] if version >= 4 else [])
    assert (q["content_role"], q["page_numbers"]) == (("abstract", [2, 3]) if version >= 5 else ("unknown", []))
    assert q["captions"] == (["c"] if version >= 6 else []) and got["tfidf_options"] == (TfidfOptions(2.0, 4.0) if version >= 3 else TfidfOptions())
    (tmp_path / "a.idx").write_bytes(raw)
    (tmp_path / "b.idx").write_bytes(b"\x03bad\x00\x00\x00\x00")
    rows = index_store.import_binary(spark, str(tmp_path)).collect()
    assert sorted((r.source_id or "", r.error is None) for r in rows) == [("", False), ("s", True)]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.idx").write_bytes(raw)
    made = index_store.import_index(spark, str(tmp_path / "one"))
    assert [tuple(x) for x in made.postings.collect()] == [(0, "system", 0.5)] and tuple(made.terms.first()) == ("system", 1, 1.0) and made.tfidf_options == got["tfidf_options"]
    q = ask(spark, "system")
    found = search.query_encoded(made, q, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vectors array<float>")).collect()
    assert [(x.ordinal, x.dense, x.lexical) for x in found] == [(0, 1.0, 0.5)] and made.created_at.startswith("1970-01-01T00:00:01")
    index_store.save(made, str(tmp_path / "saved"))
    assert index_store.load(spark, str(tmp_path / "saved")).passages.first().text == p["text"]


def old_version(index, version):
    """An older file: version 6 with the newer fields cut out."""
    import struct

    p, out = index["passages"][0], bytearray()

    def text(v):
        raw = v.encode()
        n = len(raw)
        while n >= 128:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
        out.extend(raw)

    def texts(v):
        out.extend(struct.pack("<i", len(v)))
        for x in v:
            text(x)

    text("OLD-IDX")
    out.extend(struct.pack("<i9i2?", version, *index["config"][:11]))
    texts(index["config"][11])
    out.extend(struct.pack("<3i", 1800, 250, 20))
    if version >= 3:
        out.extend(struct.pack("<2f", 2.0, 4.0))
    out.extend(struct.pack("<qi", 1000, 1))
    for k in ("source_id", "source_display_name", "source_location"):
        text(p[k])
    out.extend(struct.pack("<i", p["index"]))
    text(p["text"])
    if version >= 3:
        texts(p["keywords"])
    if version >= 4:
        texts(p["section_path"])
    if version >= 5:
        text(p["content_role"])
        out.extend(struct.pack("<3i", 2, 2, 3))
    texts(p["terms"])
    out.extend(struct.pack("<2i3i5i", 2, 2, 2, 7, 8, 4, 0, 0, 0, 0)[:20])
    out.extend(struct.pack("<i4f", 4, *p["vectors"]))
    out.extend(struct.pack("<ifi", 1, 2.0, 1))
    text("system")
    out.extend(struct.pack("<ifiif", 1, 1.0, 1, 0, 0.5))
    return bytes(out)


class Model:
    def __call__(self, ids, mask):
        return np.stack([np.stack([np.full(4, float(t % 7)) for t in row]) for row in ids]).astype(np.float32)


def test_encoder(tmp_path):
    import json

    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    config = EncoderConfig(query_length=8, document_length=16, embedding_dim=4)
    t = encoder.Tokenizer(path, config)
    ids, mask = t.tokenize(encoder.QUERY, "Hello world, this is a long query text")
    assert len(ids) == 8 and ids[0] == config.cls_id and ids[1] == config.query_prefix_id and ids[-1] == config.sep_id and mask.sum() == 8
    ids, mask = t.tokenize(encoder.DOCUMENT, "Hi, you.")
    kept = t.kept(encoder.DOCUMENT, ids, mask)
    assert mask.sum() < 16 and not kept[mask == 0].any() and kept.sum() < mask.sum()
    got = encoder.encode_batch(Model(), t, encoder.DOCUMENT, ["Hi, you.", None])
    assert got[0]["token_count"] == kept.sum() and len(got[0]["vectors"]) == 4 * kept.sum()
    v = np.array(got[0]["vectors"]).reshape(-1, 4)
    assert all(n == pytest.approx(1) or n == 0 for n in np.linalg.norm(v, axis=1))

    def alone(ids, mask):
        if len(ids) > 1:
            raise RuntimeError("one at a time")
        return Model()(ids, mask)[0]

    assert encoder.encode_batch(alone, t, encoder.DOCUMENT, ["Hi, you.", "x"])[0] == got[0]
    for shape in ((1, 16, 3), (1, 17, 4)):
        with pytest.raises(ValueError):
            encoder.vectors_of(np.zeros(shape), [(ids, mask)], encoder.DOCUMENT, t)
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"query_length": 9, "embedding_dim": "x", "do_lower_case": False, "skiplist_words": ["b", "a"]}))
    c = encoder.load_config(str(file))
    assert (c.query_length, c.embedding_dim, c.lower_case, c.skip_words) == (9, 64, False, ("a", "b")) and encoder.load_config(None) == EncoderConfig()
    assert encoder.read_merges({"merges": ["a b", ["c", "d"], [1], "e f"]}) == ["a b", "c d", "e f"]


def test_ordinals_of_many_rows(spark):
    rows = spark.range(0, 10_000, 1, 7).selectExpr("cast(id % 37 as string) source_id", "cast(id as int) `index`", "repeat(md5(cast(id as string)), 30) text", "array(cast(id as string)) keywords")
    got = index_build.with_ordinals(rows.unionByName(rows.where("`index` < 50"))).select("source_id", "index", "ordinal").collect()
    assert sorted(r.ordinal for r in got) == list(range(10_050))
    keys = [(r.source_id, r["index"]) for r in sorted(got, key=lambda r: r.ordinal)]
    assert keys == sorted(keys)
    assert index_build.with_ordinals(rows.limit(0)).count() == 0


def test_plans_move_little(spark):
    rows = [(str(k), f"apple topic {k} text") for k in range(40)]
    df = passages(spark, rows).withColumn("ordinal", F.col("index").cast("long"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(tfidf.postings(df))
    i = index_of(spark, rows)
    q = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "query_id int, vectors array<float>")
    asked = q.selectExpr("query_id", "'apple' query")
    for o in (SearchOptions(use_lexical_filter=False), SearchOptions(), SearchOptions(use_lexical_filter=False, use_rrf=False)):
        assert "NestedLoop" not in plan(search.query_encoded(i, asked, q, o)) and "Cartesian" not in plan(search.query_encoded(i, asked, q, o))


def test_max_sim_of_sets():
    r = np.random.default_rng(2)
    sets = lambda n: [None if r.random() < 0.2 else r.normal(size=(r.integers(0, 6), 3)) for _ in range(n)]
    q, d = sets(7), sets(50)
    q[0], d[3] = np.full((2, 3), np.nan), np.array([[np.nan, 1, 1], [1.0, 2, 3]])
    got = scoring.max_sim_all(scoring.Sets([None if x is None else x.ravel() for x in q], 3), scoring.Sets([None if x is None else x.ravel() for x in d], 3), room=40)
    none = np.zeros((0, 3))
    assert np.allclose(got, [[scoring.max_sim_of(none if a is None else a, none if b is None else b) for b in d] for a in q])
    assert scoring.max_sim_all(scoring.Sets([], 3), scoring.Sets(d[:0], 3)).shape == (0, 0)


def test_queries_in_blocks(spark):
    r = np.random.default_rng(5)
    i = index_of(spark, [(str(k), "apple text") for k in range(30)], r.normal(size=(30, 2)).tolist())
    q = spark.createDataFrame([(k, r.normal(size=4).tolist() if k % 3 else None) for k in range(9)], "query_id long, vectors array<float>")
    for room in (64, 1 << 20):
        blocks = search.query_blocks(q, 2, room)
        assert len(blocks) == (3 if room == 64 else 1) and [x for ids, _ in blocks for x in ids] == list(range(9))
        got = {(x.query_id, x.ordinal): x.dense for x in search.dense_scores(i.vectors, blocks, q.schema["query_id"].dataType, 2).collect()}
        want = {(a.query_id, b.ordinal): scoring.max_sim_of(np.array(a.vectors or []).reshape(-1, 2), np.array(b.vectors).reshape(-1, 2)) for a in q.collect() for b in i.vectors.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


class Slow(Fixed):
    """Takes its time over every passage."""

    def encode_documents(self, table):
        import time

        def run(batches):
            for b in batches:
                time.sleep(60)
                yield b

        return super().encode_documents(table.mapInArrow(run, table.schema))


def test_running_jobs_are_cancelled_and_told_of(spark):
    import time

    sources = spark.createDataFrame([("a", "a", "/a", "some text that is long enough", True)], "id string, display_name string, location string, text string, enabled boolean")
    began, told = time.time(), []
    with pytest.raises(index_build.Cancelled):
        index_build.from_sources(sources, Slow(), embedding_dim=2, cancelled=lambda: time.time() > began + 15, tasks=lambda done, of: told.append((done, of)))
    assert time.time() < began + 50 and told and all(0 <= a <= b for a, b in told)
    assert spark.range(3).count() == 3 and not (spark.sparkContext.getLocalProperty("spark.jobGroup.id") or "").startswith("lumenpass")


def test_encoded_texts_leave_in_whole_batches(spark):
    from lumenpass.plans import store_queries

    df = spark.range(40).selectExpr("id AS ordinal", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('text ', id) END AS context").coalesce(1)
    got = store_queries.byte_encoder(2).encode_documents(df)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    model, tokenizer = store_queries.byte_encoder().load()
    for r in got.collect():
        assert r.asDict() == {"ordinal": r.ordinal, **encoder.encode_batch(model, tokenizer, encoder.DOCUMENT, [None if r.ordinal % 7 == 0 else f"text {r.ordinal}"])[0]}


def test_best_by_dense_score_of_a_whole_task(spark):
    from pyspark.sql.types import LongType

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        v = spark.range(0, 41, 1, 1).selectExpr("id AS ordinal", "array(cast(id * 7 % 41 AS float), 1f) AS vectors")
        asked = [([3, 5], search.scoring.Sets([np.array([1.0, 0.0]), np.array([-1.0, 0.0])], 2))]
        every = search.dense_scores(v, asked, LongType(), 2)
        best = search.dense_scores(v, asked, LongType(), 2, depth=3)
        assert every.count() == 82
        want = sorted((r.query_id, r.dense) for r in every.collect())
        got = sorted((r.query_id, r.dense) for r in best.collect())
        assert got == [x for q in (3, 5) for x in [w for w in want if w[0] == q][-3:]]
    finally:
        spark.conf.set(key, before)


def test_postings_are_counted_in_whole_batches(spark):
    from collections import Counter

    from lumenpass.functions import text as T

    rows = [(1, "bbb aaa bbb", ["aaa ccc"]), (2, None, None), (3, "", ["xxx"]), (4, "aaa", []), (5, "Été 123 BBB é", ["123"]), (6, "aaa bbb ccc", None)]
    df = spark.createDataFrame(rows, "ordinal long, text string, keywords array<string>").coalesce(1)
    got = tfidf.postings(df)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    want = Counter()
    for r in df.select("ordinal", T.term_matches("text").alias("a"), T.term_matches(F.array_join("keywords", " ")).alias("b")).collect():
        for found, weight in ((r.a, 1.0), (r.b, 3.0)):
            for term, n in Counter(found or []).items():
                want[r.ordinal, term] += weight * n / len(found)
    rows = got.collect()
    assert len(rows) == len(want) > 8 and {(r.ordinal, r.term): r.tf for r in rows} == dict(want)


def test_pairs_of_query_and_passage_are_not_shuffled(spark):
    from lumenpass.plans.queries import QUERIES

    shown = QUERIES["lexical_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in shown and not re.search(r"Exchange hashpartitioning\((query_id#\w+, ordinal#|ordinal#\w+, query_id#|term#)", shown)


@pytest.mark.parametrize("by_passage", [True, False])
def test_candidates_by_brute_force(spark, monkeypatch, by_passage):
    """More ties than the limit, more queries than a block, postings of a passage together or anywhere."""
    monkeypatch.setattr(tfidf, "BLOCK_QUERIES", 3)
    r = np.random.default_rng(5)
    words = ["aa", "bb", "cc", "dd", "ee", "ff"]
    i = index_of(spark, [(str(k), " ".join(r.choice(words, r.integers(1, 5)))) for k in range(300)])
    posted = i.postings if by_passage else i.postings.repartition(5, "term")
    i = replace(i, postings=posted, by_passage=by_passage)
    asked = spark.createDataFrame([(k, " ".join(r.choice(words + ["zz"], 3))) for k in range(8)] + [(8, "zz"), (9, "")], "query_id long, query string")
    idf, w = {x.term: x.idf for x in i.terms.collect()}, tfidf.query_weights(asked).collect()
    score = {}
    for p in i.postings.collect():
        for x in w:
            if x.term == p.term:
                score[x.query_id, p.ordinal] = score.get((x.query_id, p.ordinal), 0.0) + p.tf * x.qf * idf[p.term] ** 2
    for limit in (10, 0):
        got = search.candidates(i, asked, SearchOptions(candidate_limit=limit), digits=9).orderBy("query_id", "cand_pos").collect()
        want = []
        for q in range(10):
            best = sorted(((-round(s, 9), o) for (k, o), s in score.items() if k == q))
            want += [(q, o, k) for k, (_, o) in enumerate(best[:limit] if limit else best, 1)]
        assert [(x.query_id, x.ordinal, x.cand_pos) for x in got] == want
        assert [x.lexical for x in got] == pytest.approx([score[q, o] for q, o, _ in want])


def test_scores_in_pieces(monkeypatch):
    """Passages are whole, and summed the same, wherever batches and steps end."""
    monkeypatch.setattr(tfidf, "PAIRS", 5)
    r = np.random.default_rng(6)
    rows = [(o, t, float(r.integers(1, 9))) for o in range(40) for t in r.choice(list("abcdefz"), r.integers(1, 7), replace=False)]
    weighted = pa.table({"query_id": [0, 0, 1, 2, 2, 2], "term": list("abbacd"), "w": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]})
    (asked,) = tfidf._asked(weighted, "query_id", pa.int64(), 10)
    batches = (pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[a : a + 3])], names=["ordinal", "term", "tf"]) for a in range(0, len(rows), 3))
    got, seen = {}, []
    for part in tfidf._whole_passages(batches, asked.terms, room=4):
        for ordinals, score in tfidf._scored(part, asked):
            seen += ordinals.tolist()
            got |= {(o, q): s for o, line in zip(ordinals.tolist(), score) for q, s in enumerate(line) if s}
    want = {}
    for o, t, tf in rows:
        for q, u, w in zip(*weighted.to_pydict().values()):
            if t == u:
                want[o, q] = want.get((o, q), 0.0) + tf * w
    assert got == want and len(seen) == len(set(seen))
    held = [(np.zeros(9, np.int64), np.arange(9)[::-1], np.array([1.0] * 5 + [2.0, 2.0, 3.0, 0.5]))]
    least = np.zeros(1)
    assert sorted(zip(*(x.tolist() for x in tfidf._kept(held, least, 4, 0.0)[1:]))) == [(1, 3.0), (2, 2.0), (3, 2.0), (4, 1.0), (5, 1.0), (6, 1.0), (7, 1.0)] and least[0] == 1.0
