"""Labels reach calls at any depth, and cycles get none."""

from hopgraph.operators import candidates


def test_labels_of_a_deep_chain(spark):
    chain = [(f"c{k}", f"c{k - 1}") for k in range(1, 37)] + [("x", "y"), ("y", "x")]
    parents = spark.createDataFrame(chain, "call_id string, parent string")
    roots = spark.createDataFrame([("c0", "r")], "call_id string, label string")
    got = candidates.labels_from_parents(parents, roots).collect()
    assert sorted(tuple(r) for r in got) == sorted((f"c{k}", "r") for k in range(37))
