import duckdb
import pytest
from lumenpass.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(None if v is None or v != v else float(v) if isinstance(v, float) else v if isinstance(v, (str, bool)) else int(v) for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = sql.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_tables_bound_arrow_batches(spark):
    from lumenpass.plans.registry import table

    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "10000")
        spark.conf.set(keys[1], str(1 << 30))
        table(spark, DATA, "part")
        assert [spark.conf.get(k) for k in keys] == ["1000", str(32 << 20)]
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["document_json_round_trip", "validate_documents"])
def test_documents_without_lines(spark, tmp_path, name):
    """Empty, blank and missing texts, and lines of other white space than spaces."""
    texts = ["", None, " ", "\n", "\t", "a\t\n\t\nb\n\t", "x\n\u00a0\ny\n\u3000\nz", "a\r\nb\r\n\r\nc", "A.", "A.\nB.", "\x1c\nq"]
    rows_of = [(k * len(texts) + i, t) for k in range(28) for i, t in enumerate(texts)]  # every text with every remainder
    spark.createDataFrame(rows_of, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())
