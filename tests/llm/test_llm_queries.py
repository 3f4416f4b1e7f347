"""The registered queries against their SQL, and the pipeline's contract, on the smallest tables."""

import pytest

pytest.importorskip("hopgraph.llm.queries")
duckdb = pytest.importorskip("duckdb")

from hopgraph.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    got = sorted(tuple(r) for r in df.select(*order).collect())
    assert got == sorted(tuple(r) for r in rel.project(",".join(order)).fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == docs.columns and 0 < out.count()
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
