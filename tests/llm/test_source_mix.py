"""The mix of the pipeline fills every budget, also behind a very long document."""

import pytest

pytest.importorskip("hopgraph.llm.mixing")

import hashlib  # noqa: E402

import corpus_pipeline  # noqa: E402
from hopgraph.llm import mixing  # noqa: E402


def test_long_documents_end_no_budget(spark):
    place = {i: hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest() for i in range(160)}
    early = sorted(range(80), key=place.get)
    size = {i: 20 + i % 7 if i < 80 else 50 for i in range(160)}
    size[early[2]], size[early[5]], size[early[9]] = 3000, 900, 400
    data = [(i, " ".join(["w"] * size[i]), "a" if i < 80 else "b") for i in range(160)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = corpus_pipeline.source_mix(spark, docs, "").groupBy("doc_id").count().collect()
    copies = {r.doc_id: r["count"] for r in got}
    plan = {r.source: r for r in mixing.water_fill(spark.createDataFrame([(s, sum(size[i] for i in size if (i < 80) == (s == "a"))) for s in "ab"], "source string, source_size long")).collect()}
    for s, ids in (("a", range(80)), ("b", range(80, 160))):
        whole = int(plan[s].rate)
        gap = plan[s].target - whole * plan[s].source_size
        assert gap > 1000
        want = set()
        for i in sorted(ids, key=place.get):
            if size[i] <= gap:
                want.add(i)
                gap -= size[i]
        rest = [i for i in ids if i not in want and abs(gap - size[i]) < gap]
        if rest:
            want.add(min(rest, key=lambda i: (abs(gap - size[i]), place[i])))
        assert {i for i in ids if copies.get(i, 0) == whole + 1} == want
        assert abs(sum(copies.get(i, 0) * size[i] for i in ids) - plan[s].target) <= 25
        assert all(copies.get(i, 0) == whole for i in ids if i not in want)
