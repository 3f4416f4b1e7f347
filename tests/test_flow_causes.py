"""Causes of flow errors: rows are counted before they are joined."""

from hopgraph.operators import evaluate as V


def test_rows_are_counted_before_they_meet_their_trace(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    marks = make([("m", "ok"), ("n", "ok"), ("o", "ok"), ("p", "gone")], "mark string, status string")
    selected = make([("m", "a", "b", None), ("m", "a", "b", "m"), ("n", "a", "b", None), ("n", "a", "b", "n"), ("n", "x", "y", "m"), (None, "a", "b", "m")], "mark string, client string, server string, row_mark string")
    captured = make([("m", "a", "b")] * 2 + [("n", "a", "b")] * 2, "mark string, client string, server string")
    out = V.flow_trace_causes(marks, selected, captured, make([("a", "b", 2)], "client string, server string, want int"))
    got = {r.mark: (r.predicted, r.correct, r.correct_predicted, r.not_captured, r.wrong_mark, r.exact) for r in out.collect()}
    assert got == {"m": (2, 2, 2, 0, 0, True), "n": (2, 1, 1, 0, 1, False), "o": (0, 0, 0, 2, 0, False), "p": (0, 0, 0, 0, 0, False)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 6
