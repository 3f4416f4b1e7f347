"""Pairs compared within blocks of time: no table of pairs is written, and results are those of plain loops."""

import random

from pyspark.sql import functions as F

from hopgraph.operators import assignment, candidates, matching

CALLS = "call_id string, client string, server string, start_us long, end_us long"


def some_calls(seed: int, n: int = 60):
    r, rows = random.Random(seed), []
    for k in range(n):
        start, (client, server) = r.randrange(0, 4_000_000, 20_000), r.choice([("x", "a"), ("a", "b"), ("b", "c"), ("b", "b")])
        rows.append((f"{server}{k}", client, server, start, start + r.choice([10_000, 60_000, 60_000, 900_000])))
    return rows


def test_containment_fallback_against_loops(spark):
    rows = some_calls(3)
    labels = {i: (None, i) for i, c, *_ in rows if c == "x"}
    first = dict(labels)
    while True:
        new = {}
        for i, c, _, s, e in rows:
            if i in labels:
                continue
            best = []
            for p, _, server, ps, pe in rows:
                outside = max(ps - s, 0) + max(e - pe, 0)
                if p != i and server == c and p in labels and ps - 80_000 <= s <= pe + 80_000 and outside <= 80_000:
                    best.append((100 * outside + pe - ps + 0.05 * abs(s - ps), p))
            if best:
                new[i] = (min(best)[1], labels[min(best)[1]][1])
        if not new:
            break
        labels.update(new)
    made = {}
    kept = candidates.written
    candidates.written = lambda df, name: made.setdefault((name, len(made)), kept(df, name))
    try:
        known = spark.createDataFrame([(i, p, la) for i, (p, la) in first.items()], "call_id string, parent string, label string")
        got = {r.call_id: (r.parent, r.label) for r in candidates.containment_fallback(spark.createDataFrame(rows, CALLS), known, rounds=50).collect()}
    finally:
        candidates.written = kept
    assert got == labels
    assert sum(df.count() for df in made.values()) <= len(rows)


def rows_written(module, run):
    """What run() returns, and the rows of all tables that it has written."""
    n, kept = [], module.written

    def counted(df, name):
        out = kept(df, name)
        n.append(out.count())
        return out

    module.written = counted
    try:
        return run(), n
    finally:
        module.written = kept


def crowd(spark, seed: int, n: int = 150):
    """Calls in a crowd, and slots due among them, in parts of four."""
    r = random.Random(seed)
    kids = [("a", r.choice(["b", "c"]), f"k{i}", s := r.randrange(0, 900_000, 10_000), s + r.choice([5_000, 400_000])) for i in range(n)]
    due = [("a", r.choice(["b", "c"]), f"p{i}#1", f"p{i}", r.randrange(0, 900_000, 10_000)) for i in range(n)]
    parents = [(*d, d[4] - 20_000, d[4] + 100_000, d[4] // 150_000, i % 3) for i, d in enumerate(due)]
    calls = spark.createDataFrame(kids, "client string, server string, call_id string, start_us long, end_us long")
    return calls, spark.createDataFrame(parents, "client string, server string, p_id string, of string, due long, p_start long, p_end long, bucket long, part long")


def test_calls_are_assigned_when_due_as_from_a_table_of_pairs(spark):
    for seed, rule in ((1, assignment.Due(150_000)), (2, assignment.Due(60_000, slack_us=50_000, each_end=True))):
        calls, parents = crowd(spark, seed)
        akin = calls.select("call_id", F.array(F.lit("p3"), F.lit("p7")).alias("akin"), F.array(F.lit(0.25), F.lit(0.5)).alias("lineages")).where("call_id like '%4'")
        named = calls.join(akin, "call_id", "left")
        j = named.join(parents, ["client", "server"]).where(F.abs(F.col("start_us") - F.col("due")) <= rule.window_us)
        lineage = F.coalesce(F.get("lineages", F.array_position("akin", F.col("of")).cast("int") - 1), F.lit(0.0))
        early, late = F.col("start_us") < F.col("p_start") - rule.slack_us, F.col("end_us") > F.col("p_end") + rule.slack_us
        out = early.cast("int") + late.cast("int") if rule.each_end else (early | late).cast("int")
        cost = F.abs(F.col("start_us") - F.col("due")) / 1e6 + rule.outside_cost * out - rule.lineage_weight * lineage
        want = {(r.call_id, r.p_id, round(r.cost, 9)) for r in assignment.assign_in_rounds(j.withColumn("cost", cost)).collect()}
        got = {(r.call_id, r.p_id, round(r.cost, 9)) for r in assignment.assign_when_due(named, parents, rule).collect()}
        assert len(got) > 100
        # Costs tie, as starts are round: the same calls are matched at the same total cost.
        assert {g[0] for g in got} == {w[0] for w in want} and abs(sum(g[2] for g in got) - sum(w[2] for w in want)) < 1e-6 and len({g[1] for g in got}) == len(got)


def test_slots_write_no_pairs(spark):
    calls, parents = crowd(spark, 5)
    roots = parents.select(F.col("of").alias("call_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("x").alias("client"), F.lit("a").alias("server"), F.col("p_start").alias("start_us"), F.col("p_end").alias("end_us"))
    all_calls = roots.unionByName(calls.withColumn("parent_id", F.lit("?")).select(*roots.columns))
    template = spark.createDataFrame([("a", s, k, 10_000 * k) for s in "bc" for k in (1, 2)], "client string, server string, slot int, offset_us long")
    for by_parent in (False, True):
        out, n = rows_written(assignment, lambda: assignment.slot_assign(all_calls, template, by_parent=by_parent).collect())
        assert len(out) == 150 and max(n) <= roots.count() * 4


def test_slots_to_a_fixed_point_write_no_pairs_but_those_that_share_a_token(spark):
    rows = [(f"r{k}", None, 1, "x", "a", 1000 * k, 1000 * k + 90_000) for k in range(40)] + [(f"c{k}", f"r{k}", 1, "a", "b", 1000 * k + 5_000, 1000 * k + 9_000) for k in range(40)]
    calls = spark.createDataFrame(rows, "call_id string, parent_id string, trace_id long, client string, server string, start_us long, end_us long")
    roots = calls.where("client = 'x'").select("call_id", F.col("call_id").alias("label"))
    profile = spark.createDataFrame([("a", "b", 0, 0, 5_000)], "client string, server string, parent_slot int, slot int, offset_us long")
    # Calls share tokens with the next root but one, against time.
    word = F.when(F.col("client") == "x", F.col("call_id")).otherwise(F.concat(F.lit("r"), ((F.substring("call_id", 2, 9).cast("int") + 2) % 40).cast("string")))
    tokens = calls.select("call_id", "client", "server", F.array(word).alias("req"), F.array().cast("array<string>").alias("res"), F.array(word).alias("all"))
    (state, _, whole), n = rows_written(matching, lambda: matching.assign_slots(calls, profile, roots, tokens))
    got = {r.call_id: r.parent for r in state.where("parent is not null").collect()}
    assert whole and got == {f"c{k}": f"r{(k + 2) % 40}" for k in range(40)} and max(n) <= 80
