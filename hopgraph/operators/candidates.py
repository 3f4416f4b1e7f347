"""Candidate parents, lineage evidence, label propagation and parent rebuilding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopgraph.operators.common import written
from hopgraph.operators.windows import chunks, expanded, least


@dataclass(frozen=True)
class Config:
    time_weight: float = 1.0
    lineage_weight: float = 20.0
    context_weight: float = 40.0
    containment_penalty: float = 2.0
    req_tolerance_us: int = 50_000
    res_tolerance_us: int = 80_000
    fallback_us: int = 250_000
    max_candidates: int = 64
    max_rounds: int = 20
    bucket_us: int = 100_000


def _bucket(t: Column, width: int) -> Column:
    return F.floor(t / width)


def interval_pairs(children: DataFrame, parents: DataFrame, before_us: int, after_us: int, width: int, by_start: bool = False) -> DataFrame:
    """Pairs of a child and a call of its client's service open at the child's start, give or take.

    Parents are laid on the time buckets that they reach, a child has one bucket: an equi-join on
    (service, bucket) in which every pair meets once. ``bucket`` is the child's: all pairs of a child stand in one
    partition, where what is grouped by client, bucket and call is not shuffled again. A parent's ``p_label`` comes along.
    """
    end = F.col("p_start") if by_start else F.col("p_end")
    p = parents.select(F.col("call_id").alias("p_id"), F.col("server").alias("client"), F.col("start_us").alias("p_start"), F.col("end_us").alias("p_end"), *[c for c in ("p_label",) if c in parents.columns])
    p = p.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("p_start") - before_us, width), _bucket(end + after_us, width))))
    c = children.select("call_id", "client", "server", "start_us", "end_us").withColumn("bucket", _bucket(F.col("start_us"), width))
    near = F.col("start_us").between(F.col("p_start") - before_us, end + after_us)
    return c.join(p, ["client", "bucket"]).where(near & (F.col("p_id") != F.col("call_id")))


def _temporal_pairs(children: DataFrame, parents: DataFrame, cfg: Config, profile: DataFrame | None, strict: bool = False) -> DataFrame:
    """Pairs within the tolerances, or with ``strict`` only those in which the parent contains the child, scored by time."""
    before, after = (0, 0) if strict else (cfg.req_tolerance_us, cfg.res_tolerance_us)
    pairs = interval_pairs(children, parents, before, after, cfg.bucket_us)
    if strict:
        pairs = pairs.where("p_end >= end_us").withColumn("outside_us", F.lit(0).cast("long"))
    else:
        outside = F.greatest(F.col("p_start") - F.col("start_us"), F.lit(0)) + F.greatest(F.col("end_us") - F.col("p_end"), F.lit(0))
        pairs = pairs.withColumn("outside_us", outside).where((F.col("p_end") + cfg.res_tolerance_us >= F.col("end_us")) | (F.col("outside_us") <= cfg.fallback_us))
    score = -F.when(F.col("outside_us") > cfg.res_tolerance_us, cfg.containment_penalty).otherwise(0.0) - F.col("outside_us") / 1e6 * cfg.time_weight * 4.0
    if profile is not None:
        pairs = pairs.join(profile.where("reason = 'ok'").select("client", "server", "mu_us", "sigma_us"), ["client", "server"], "left")
        z = (F.col("start_us") - F.col("p_start") - F.col("mu_us")) / F.col("sigma_us")
        return pairs.withColumn("temporal", score + F.coalesce(F.exp(-0.5 * z * z) * cfg.time_weight, F.lit(0.0))).drop("mu_us", "sigma_us")
    return pairs.withColumn("temporal", score)


#: A child by what its pairs were joined on: windows over it need no shuffle.
CHILD = ("client", "bucket", "call_id")


def _best(pairs: DataFrame, cfg: Config) -> DataFrame:
    order = Window.partitionBy(*CHILD).orderBy(F.desc("temporal"), F.abs(F.col("start_us") - F.col("p_start")), "p_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.max_candidates)


def temporal_candidates(calls: DataFrame, cfg: Config = Config(), profile: DataFrame | None = None) -> DataFrame:
    """The best ``max_candidates`` parents of every call by time: inside give or take the tolerances; and the call's time ``bucket``."""
    return _best(_temporal_pairs(calls, calls, cfg, profile), cfg)


def strict_candidates(calls: DataFrame, cfg: Config = Config(), profile: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """prefer_strict(temporal_candidates): calls that some parent contains are joined with those parents only, the others with the tolerances.

    So the many loose pairs of a busy service are never made for calls that don't need them; what is written is those
    calls, not the pairs. (With a profile, the cut to ``max_candidates`` is made among the containing parents.) With ``labels`` a pair brings its parent's as ``p_label``.
    """
    parents = calls if labels is None else calls.join(labels.select("call_id", F.col("label").alias("p_label")), "call_id", "left")
    strict = _temporal_pairs(calls, parents, cfg, profile, strict=True)
    rest = written(calls.join(strict.select(*CHILD).distinct().select("call_id"), "call_id", "left_anti"), "uncontained")
    loose = _temporal_pairs(rest, parents, cfg, profile)
    return _best(strict, cfg).drop("bucket").unionByName(_best(loose, cfg).drop("bucket"))


def fallback_candidates(calls: DataFrame, cfg: Config = Config(), children: DataFrame | None = None) -> DataFrame:
    """The nearest parents by start within the fallback window, of all calls or of ``children``, with their own score."""
    pairs = interval_pairs(calls if children is None else children, calls, cfg.fallback_us, cfg.fallback_us, cfg.bucket_us, by_start=True)
    pairs = pairs.withColumn("distance_us", F.abs(F.col("start_us") - F.col("p_start")))
    order = Window.partitionBy(*CHILD).orderBy("distance_us", "p_id")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.max_candidates)
    return pairs.withColumn("temporal", -F.col("distance_us") / 1e6 * cfg.time_weight - cfg.containment_penalty).drop("bucket")


def prefer_strict(cands: DataFrame) -> DataFrame:
    """Where a call has candidates that contain it, only those."""
    strict = (F.col("p_start") <= F.col("start_us")) & (F.col("p_end") >= F.col("end_us"))
    w = Window.partitionBy(*[c for c in CHILD if c in cands.columns])
    return cands.withColumn("strict", strict).withColumn("any_strict", F.max("strict").over(w)).where("strict or not any_strict").drop("any_strict")


def edge_idf(tokens: DataFrame) -> DataFrame:
    """tokens(call_id, client, server, all array) -> (client, server, token, idf): ln((n + 1) / (df + 1)) + 1 by edge."""
    n = tokens.groupBy("client", "server").agg(F.count("*").alias("n"))
    t = tokens.select("client", "server", F.explode(F.array_distinct("all")).alias("token")).groupBy("client", "server", "token").agg(F.count("*").alias("df"))
    return t.join(n, ["client", "server"]).select("client", "server", "token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def token_diversity(tokens: DataFrame) -> DataFrame:
    """By edge: distinct token sets over calls."""
    return tokens.groupBy("client", "server").agg(F.round(F.countDistinct(F.array_sort("all")) / F.count("*"), 6).alias("diversity"))


def with_tokens(calls: DataFrame) -> DataFrame:
    """Token arrays of calls: request, response and both; from req_tokens and res_tokens, or one value each."""
    req, res = (F.col(c) if c in calls.columns else F.array(v) for c, v in (("req_tokens", "value_a"), ("res_tokens", "value_b")))
    req, res = (F.filter(x, lambda t: t.isNotNull()) for x in (req, res))
    return calls.select("call_id", "client", "server", req.alias("req"), res.alias("res"), F.array_union(req, res).alias("all"))


def weight_map(res_weight: float) -> Column:
    """Weights of a call's tokens (columns req, all): 1.0 in the request, else ``res_weight``."""
    return F.map_from_arrays("all", F.transform("all", lambda t: F.when(F.array_contains("req", t), 1.0).otherwise(res_weight)))


def merged_weights(a: Column, b: Column) -> Column:
    """Two weight maps in one, the larger weight where both have a token."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))


def lineage_score(pairs: DataFrame, tokens: DataFrame, idf: DataFrame) -> DataFrame:
    """pairs(call_id, p_id, client, server) -> those that share tokens, with ``lineage``.

    Overlap is shared parent weight over all parent weight. Shared tokens are found within a pair's
    arrays; only they meet the idf table. All parent weight depends on the parent and the edge only,
    and is summed there. Pairs without a shared token score zero and are left out. Tokens may come with
    ``weights`` of their own as a parent's (``extend_owners``); else they are 1.0 and 0.8 by side.
    """
    given = "weights" in tokens.columns
    weights = [F.col("weights").alias("p_weights")] if given else []
    c = tokens.select("call_id", F.col("req").alias("c_req"), F.col("res").alias("c_res"))
    p = tokens.select(F.col("call_id").alias("p_id"), F.col("req").alias("p_req"), F.col("res").alias("p_res"), *weights)
    j = pairs.select("call_id", "p_id", "client", "server").join(c, "call_id").join(p, "p_id")
    of_parent = F.array_union(F.array_union("p_req", "p_res"), F.map_keys("p_weights")) if given else F.array_union("p_req", "p_res")
    met = j.withColumn("token", F.explode(F.array_intersect(of_parent, F.array_union("c_req", "c_res"))))
    one = lambda side: F.array_contains(side, F.col("token")).cast("double")
    weight = F.coalesce(F.try_element_at("p_weights", F.col("token")), F.lit(0.0)) if given else F.greatest(one("p_req"), 0.8 * one("p_res"))
    met = met.select("call_id", "p_id", "client", "server", "token", one("p_req").alias("pq"), one("p_res").alias("ps"), one("c_req").alias("cq"), one("c_res").alias("cs"), weight.alias("weight"))
    met = met.join(idf, ["client", "server", "token"], "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    num = met.groupBy("call_id", "p_id", "client", "server").agg(
        *[F.sum(F.col("idf") * F.col(a) * F.col(b)).alias(a + b) for a in ("pq", "ps") for b in ("cq", "cs")], F.sum(F.col("idf") * F.col("weight")).alias("ctx"),
    )
    edges = idf.select("client", "server").distinct()
    own = tokens.select(F.col("call_id").alias("p_id"), F.col("server").alias("client"), F.col("req").alias("p_req"), F.col("res").alias("p_res"), *weights).join(edges, "client")
    own = own.withColumn("token", F.explode(of_parent)).join(idf, ["client", "server", "token"], "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    den = own.groupBy("p_id", "client", "server").agg(F.sum(F.col("idf") * one("p_req")).alias("d_req"), F.sum(F.col("idf") * one("p_res")).alias("d_res"), F.sum(F.col("idf") * weight).alias("d_ctx"))
    j = num.join(den, ["p_id", "client", "server"])
    over = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    blend = 0.35 * over("pqcq", "d_req") + 0.20 * over("pqcs", "d_req") + 0.30 * over("pscq", "d_res") + 0.15 * over("pscs", "d_res")
    return j.select("call_id", "p_id", F.greatest(over("ctx", "d_ctx"), blend).alias("lineage"))


def overlap_score(pairs: DataFrame) -> DataFrame:
    """pairs(p array<struct<token,weight>>, c array) -> ``overlap``: shared parent weight over all parent weight."""
    total = F.aggregate("p", F.lit(0.0), lambda a, t: a + t["weight"])
    shared = F.aggregate(F.filter("p", lambda t: F.array_contains("c", t["token"])), F.lit(0.0), lambda a, t: a + t["weight"])
    return pairs.withColumn("overlap", F.when(total > 0, shared / total).otherwise(0.0))


def roots_of(calls: DataFrame) -> DataFrame:
    """Entry calls, each labelled with itself: calls to a service from clients that serve nothing."""
    servers = calls.select(F.col("server").alias("client")).distinct()
    return calls.join(servers, "client", "left_anti").select("call_id", F.col("call_id").alias("label"))


def context_score(cands: DataFrame, contexts: DataFrame, idf: DataFrame) -> DataFrame:
    """cands(call_id, p_id, client, server, all) and contexts(call_id, context map) of calls -> pairs with ``context``.

    The share of the weight of the parent's ancestors' tokens, times their idf on the child's edge, that the child
    has. Only tokens that a pair shares are exploded; all weight is summed once for each parent and edge that needs
    it. Pairs that share nothing score zero and are left out.
    """
    above = contexts.where(F.size("context") > 0).select(F.col("call_id").alias("p_id"), "context")
    shared = F.array_intersect(F.map_keys("context"), F.col("all"))
    met = cands.select("call_id", "p_id", "client", "server", "all").join(above, "p_id").withColumn("token", F.explode(shared))
    met = met.select("call_id", "p_id", "client", "server", "token", F.try_element_at("context", F.col("token")).alias("weight"))

    def weighed(rows: DataFrame) -> DataFrame:
        return rows.join(idf, ["client", "server", "token"], "left").withColumn("mass", F.col("weight") * F.coalesce("idf", F.lit(1.0)))

    num = weighed(met).groupBy("call_id", "p_id", "client", "server").agg(F.sum("mass").alias("shared"))
    whole = num.select("p_id", "client", "server").distinct().join(above, "p_id").select("p_id", "client", "server", F.explode("context").alias("token", "weight"))
    den = weighed(whole).groupBy("p_id", "client", "server").agg(F.sum("mass").alias("whole"))
    return num.join(den, ["p_id", "client", "server"]).select("call_id", "p_id", (F.col("shared") / F.col("whole")).alias("context"))


def best_parent(cands: DataFrame, labels: DataFrame | None, cfg: Config = Config(), contexts: DataFrame | None = None) -> DataFrame:
    """The best labelled parent of each call: highest score; nearest start, shortest parent, id on ties.

    The score is that of time, of lineage and, with ``contexts`` (``context_score``), of the parent's ancestors, by weight.
    Without ``labels`` pairs have their parents' as ``p_label``, and aren't shuffled for them.
    """
    if labels is None:
        j = cands.where("p_label is not null").withColumnRenamed("p_label", "label")
    else:
        j = cands.join(labels.select(F.col("call_id").alias("p_id"), "label"), "p_id")
    score = cfg.lineage_weight * F.coalesce("lineage", F.lit(0.0)) + F.col("temporal")
    evidence = F.lit(0.0)
    if contexts is not None:
        j = j.join(contexts, ["call_id", "p_id"], "left")
        evidence = F.coalesce("context", F.lit(0.0))
        score = score + cfg.context_weight * evidence
    order = F.struct(score.alias("score"), -F.abs(F.col("start_us") - F.col("p_start")), -(F.col("p_end") - F.col("p_start")), F.col("p_id"))
    best = F.struct("p_id", "label", F.coalesce("lineage", F.lit(0.0)).alias("lineage"), evidence.alias("context"))
    return j.groupBy("call_id").agg(F.max_by(best, order).alias("best"), F.max(score).alias("score")).select("call_id", F.col("best.p_id").alias("parent"), F.col("best.label").alias("label"), "score", F.col("best.lineage").alias("won_lineage"), F.col("best.context").alias("won_context"))


#: What a labelled call carries besides its context.
LABELLED = ("call_id", "parent", "label", "won_lineage", "won_context")


def propagate(cands: DataFrame, roots: DataFrame, cfg: Config = Config(), tokens: DataFrame | None = None, fallback=None, idf: DataFrame | None = None, evidence: bool = False, services: DataFrame | None = None) -> tuple[DataFrame, int, bool]:
    """Labels from the entry calls along best parents until nothing changes: (call_id, parent, label), rounds, converged.

    Every round reads the labels of the round before. With ``tokens``, ``idf`` and a context weight, what a parent's own
    ancestors have said is evidence too: a map of weights (request 1.0, response 0.9) that travels with the label and
    grows by the parent's tokens. Where a round changes a call that had a label already, all maps are made anew from
    the paths (``ancestor_context``), so none is out of date. Once nothing changes, ``fallback`` (from labels to more
    candidates, for calls without a label) is asked; from then on a call none of whose candidates has a label takes
    the best of those. ``max_rounds`` is a parameter of the method; the last value returned tells whether it was enough.
    With ``evidence`` the lineage and context that won each call come along. With ``services`` (call_id, server) a round
    looks only at calls from services whose calls the round before has changed, as the others would choose the same
    again; not where maps have been made anew or the fallback asked.
    """
    with_context = tokens is not None and cfg.context_weight > 0
    out = LABELLED if evidence else LABELLED[:3]
    none = F.create_map().cast("map<string,double>")

    def ready(c: DataFrame, name: str) -> DataFrame:
        return written(c.join(tokens.select("call_id", "all"), "call_id") if with_context else c, name)

    def chosen(c: DataFrame) -> DataFrame:
        return best_parent(c, labels, cfg, context_score(c, labels, idf) if with_context else None).select(*LABELLED)

    cands, spare = ready(cands, "candidates"), None
    nothing = F.lit(None).cast("double")
    labels = written(roots.select("call_id", F.lit(None).cast("string").alias("parent"), "label", nothing.alias("won_lineage"), nothing.alias("won_context"), *([none.alias("context")] if with_context else [])), "labels")
    fixed, active = labels, None
    if services is not None:
        active = [r.server for r in roots.join(services, "call_id").select("server").distinct().collect()]  # names of services
    for done in range(1, cfg.max_rounds + 1):
        new = chosen(cands if active is None else cands.where(F.col("client").isin(active)))
        if spare is not None:
            new = written(new, "best-parents")
            new = new.unionByName(chosen(spare.join(new.select("call_id"), "call_id", "left_anti")))
        if with_context:
            mine = tokens.select(F.col("call_id").alias("parent"), weight_map(0.9).alias("p_weights"))
            above = labels.select(F.col("call_id").alias("parent"), F.col("context").alias("p_context"))
            new = new.join(mine, "parent").join(above, "parent").select(*LABELLED, merged_weights(F.col("p_context"), F.col("p_weights")).alias("context"))
        new, kept = new.join(fixed.select("call_id"), "call_id", "left_anti"), fixed
        if active is not None:
            new = written(new, "best-parents")
            kept = labels.join(new.select("call_id"), "call_id", "left_anti")
        new = written(kept.unionByName(new), "labels")
        old = labels.select("call_id", F.col("parent").alias("was"), F.col("label").alias("had"))
        same = F.col("parent").eqNullSafe(F.col("was")) & F.col("label").eqNullSafe(F.col("had"))
        moved = new.join(old, "call_id", "left").where(~same)
        moved = moved.select("call_id", "had", F.lit(None).cast("string").alias("server")) if active is None else moved.join(services, "call_id", "left").select("call_id", "had", "server")
        seen = moved.groupBy("server").agg(F.count("*").alias("changed"), F.count("had").alias("revised")).collect()
        labels, revised = new, any(r.revised for r in seen)
        active = None if active is None or revised and with_context else [r.server for r in seen if r.server is not None]
        if revised and with_context:
            paths = ancestor_context(labels.select("call_id", "parent", "label"), tokens).groupBy("call_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("context"))
            labels = written(labels.drop("context").join(paths, "call_id", "left").withColumn("context", F.coalesce("context", none)), "labels")
        if not seen:
            active = None
            more = fallback(labels) if fallback is not None and spare is None else None
            more = None if more is None else ready(more, "fallback-candidates")
            if more is None or more.isEmpty():
                return labels.select(*out), done, True
            spare = more
    return labels.select(*out), cfg.max_rounds, False


#: Weights of payload evidence between a pair and of the ancestors' tokens, and whether containment fills what is left.
VARIANTS = {"time": (0.0, 0.0, False), "no-context": (20.0, 0.0, False), "full": (20.0, 40.0, False), "context": (0.0, 40.0, False), "fallback": (20.0, 40.0, True)}


def infer(calls: DataFrame, variant: str = "full", cfg: Config = Config(), evidence: bool = False) -> tuple[DataFrame, int, bool]:
    """(labels, rounds, whole) of blind inference, with the evidence that won each call if asked for (not with ``fallback``): ``time`` (no payload evidence), ``no-context`` (lineage only), ``full`` (lineage and ancestors), ``context`` (ancestors only) or ``fallback`` (full, then containment)."""
    return infer_variants(calls, [variant], cfg, evidence)[variant]


#: What propagation needs of a candidate.
CANDIDATE = ("call_id", "p_id", "client", "server", "start_us", "p_start", "p_end", "temporal", "lineage")


def infer_variants(calls: DataFrame, variants: Sequence[str], cfg: Config = Config(), evidence: bool = False) -> dict[str, tuple[DataFrame, int, bool]]:
    """``infer`` for several variants. Calls are read once and written, and candidates, lineage and equal propagations are made once for all."""
    calls = written(calls.select([c for c in ("call_id", "client", "server", "start_us", "end_us", "value_a", "value_b", "req_tokens", "res_tokens") if c in calls.columns]), "calls")
    tokens = with_tokens(calls)
    ways = {variant: VARIANTS[variant][:2] for variant in variants}
    idf = written(edge_idf(tokens), "edge-idf") if any(lineage or context for lineage, context in ways.values()) else None

    def scored(pairs: DataFrame, lineage: float) -> DataFrame:
        if lineage:
            pairs = pairs.join(lineage_score(pairs, tokens, idf), ["call_id", "p_id"], "left")
        else:
            pairs = pairs.withColumn("lineage", F.lit(0.0))
        return pairs.select(*CANDIDATE)

    pairs = strict_candidates(calls, cfg).select(*CANDIDATE[:-1])
    with_lineage = {bool(lineage) for lineage, _ in ways.values()}
    if len(with_lineage) > 1:
        pairs = written(pairs, "strict-candidates")
    made = {}
    for some in with_lineage:
        same = {way for way in ways.values() if bool(way[0]) == some}
        cands = scored(pairs, some)
        cands = written(cands, "scored-candidates") if len(same) > 1 else cands
        for lineage, context in same:
            own = replace(cfg, lineage_weight=lineage, context_weight=context)

            def late(labels: DataFrame) -> DataFrame | None:
                left = written(calls.join(labels.select("call_id"), "call_id", "left_anti"), "unlabelled")
                return None if left.isEmpty() else scored(fallback_candidates(calls, own, left), lineage)

            made[lineage, context] = propagate(cands, roots_of(calls), own, tokens if context else None, late, idf, evidence, calls.select("call_id", "server"))
    out = {}
    for variant, way in ways.items():
        labels, rounds, whole = made[way]
        out[variant] = (containment_fallback(calls, labels) if VARIANTS[variant][2] else labels), rounds, whole
    return out


def trace_context(labels: DataFrame, tokens: DataFrame) -> DataFrame:
    """(label, token, weight): all tokens of a label's calls, request 1.0, response 0.9, the larger where both."""
    j = tokens.join(labels.select("call_id", "label"), "call_id")
    part = lambda side, w: j.select("label", F.explode(side).alias("token"), F.lit(w).alias("weight"))
    return part("req", 1.0).unionByName(part("res", 0.9)).groupBy("label", "token").agg(F.max("weight").alias("weight"))


def ancestors(parents: DataFrame, rounds: int = 32) -> DataFrame:
    """parents(call_id, parent, label) -> (call_id, ancestor) for all strict ancestors of one label; none on a cycle or a gap in labels.

    Path doubling: in round k each call knows its ancestors up to 2^k steps away.
    """
    ids = parents.select(F.col("call_id").alias("parent"), F.col("label").alias("p_label"))
    j = parents.join(ids, "parent", "left").withColumn("bad", F.col("parent").isNotNull() & ~F.coalesce(F.col("p_label") == F.col("label"), F.lit(False)))
    state = written(j.select("call_id", F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent")).alias("path"), F.col("parent").alias("next"), "bad"), "ancestors")
    for _ in range(rounds):
        if state.where("next is not null and not bad").isEmpty():
            break
        up = state.select(F.col("call_id").alias("next"), F.col("path").alias("up_path"), F.col("next").alias("up_next"), F.col("bad").alias("up_bad"))
        j = state.join(up, "next", "left")
        path = F.concat("path", F.coalesce("up_path", F.array().cast("array<string>")))
        loop = (F.size(F.array_distinct(path)) < F.size(path)) | F.array_contains(path, F.col("call_id"))
        state = written(j.select("call_id", F.when(F.col("next").isNull(), F.col("path")).otherwise(path).alias("path"), F.when(loop, None).otherwise(F.col("up_next")).alias("next"), (F.col("bad") | F.coalesce("up_bad", F.lit(False)) | loop).alias("bad")), "ancestors")
    return state.where("not bad").select("call_id", F.explode("path").alias("ancestor"))


def ancestor_context(parents: DataFrame, tokens: DataFrame) -> DataFrame:
    """(call_id, token, weight) over the strict ancestors of each call."""
    a = ancestors(parents)
    labels = a.select(F.col("ancestor").alias("call_id"), F.col("call_id").alias("label"))
    return trace_context(labels, tokens).withColumnRenamed("label", "call_id")


def causal_parent(calls: DataFrame, label: str = "label") -> DataFrame:
    """The parent of each call among its trace's calls of its client: shortest that contains it, else least overrun, else nearest start."""
    p = calls.select(F.col("call_id").alias("p_id"), F.col("server").alias("client"), F.col(label), F.col("start_us").alias("p_start"), F.col("end_us").alias("p_end"))
    j = calls.select("call_id", "client", label, "start_us", "end_us").join(p, ["client", label]).where("p_id <> call_id")
    inside = (F.col("p_start") <= F.col("start_us")) & (F.col("p_end") >= F.col("end_us"))
    starts = (F.col("p_start") <= F.col("start_us")) & (F.col("start_us") <= F.col("p_end"))
    tier = F.when(inside, 0).when(starts, 1).otherwise(2)
    gap = F.abs(F.col("start_us") - F.col("p_start"))
    cost = F.when(inside, F.col("p_end") - F.col("p_start")).when(starts, F.col("end_us") - F.col("p_end")).otherwise(gap)
    return j.groupBy("call_id").agg(F.min_by("p_id", F.struct(tier, cost, gap, F.col("p_id"))).alias("parent"), F.min(tier).alias("tier"))


def rebuild_parents(calls: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents again from labels alone, and counts of attempted, updated and missing."""
    rebuilt = causal_parent(calls.join(labels.select("call_id", "label"), "call_id")).select("call_id", F.col("parent").alias("rebuilt"))
    j = labels.where("parent is not null").join(rebuilt, "call_id", "left")
    n = lambda c: F.sum(c.cast("long"))
    counts = j.agg(F.count("*").alias("attempted"), n(F.col("rebuilt").isNotNull() & (F.col("rebuilt") != F.col("parent"))).alias("updated"), n(F.col("rebuilt").isNull()).alias("missing"))
    return j.select("call_id", F.coalesce("rebuilt", "parent").alias("parent"), "label"), counts


def containment_fallback(calls: DataFrame, labels: DataFrame, tolerance_us: int = 80_000, rounds: int = 8, width: int = 100_000) -> DataFrame:
    """Labels for calls that have none, from the parent with the least 100 outside + duration + 0.05 gap, up to some rounds.

    A call that stays open had no labelled candidate yet, so a round looks only at parents that the round before has
    labelled, and no pair is made twice. Pairs meet and are compared within a block of time of their service
    (``_least_containing``) and are neither written nor shuffled.
    """
    # A call without an end is outside at its start only.
    c = calls.select("call_id", "client", "server", "start_us", F.coalesce("end_us", F.lit(-(2**62))).alias("end_us")).where("start_us is not null")
    labels = front = written(labels.select("call_id", "parent", "label"), "labels")
    block = BLOCKS * width
    keys = ["client", "block"]
    for _ in range(rounds):
        kids = c.join(labels.select("call_id"), "call_id", "left_anti").where("client is not null").withColumn("block", _bucket(F.col("start_us"), block)).drop("server")
        p = calls.where("start_us is not null and end_us is not null").join(front.select("call_id", "label"), "call_id").select(F.col("call_id").alias("p_id"), F.col("server").alias("client"), F.col("start_us").alias("p_start"), F.col("end_us").alias("p_end"), "label")
        p = p.withColumn("block", F.explode(F.sequence(_bucket(F.col("p_start") - tolerance_us, block), _bucket(F.col("p_end") + tolerance_us, block))))
        new = kids.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(lambda k, q: _least_containing(k, q, tolerance_us), "call_id string, parent string, label string")
        front = written(new, "fallback")
        if front.isEmpty():
            break
        labels = labels.unionByName(front)
    return labels


#: How many buckets of time a block has in which pairs are compared in a task.
BLOCKS = 20


def _least_containing(kids: pd.DataFrame, parents: pd.DataFrame, tolerance_us: int) -> pd.DataFrame:
    """The parent of every child that some parent contains, give or take: the least 100 outside + duration + 0.05 gap, then the first by id."""
    parents = parents.sort_values("p_id").reset_index(drop=True)
    order = np.argsort(parents["p_start"].to_numpy(), kind="stable")
    start, end = (parents[c].to_numpy()[order] for c in ("p_start", "p_end"))
    c_start, c_end = kids["start_us"].to_numpy(), kids["end_us"].to_numpy()
    ids, names = pd.factorize(parents["p_id"])
    own = pd.Index(names).get_indexer(kids["call_id"])
    # Parents that end too early stand between those that don't: of all begun in time, the longest says how far to look back.
    longest = int((end - start).max()) if len(start) else 0
    low, high = np.searchsorted(start, c_start - tolerance_us - longest, "left"), np.searchsorted(start, c_start + tolerance_us, "right")
    found_at, found = [], []
    for at in chunks(high - low):
        kid, place = expanded(low, high, at)
        s, e = start[place], end[place]
        outside = np.maximum(s - c_start[kid], 0) + np.maximum(c_end[kid] - e, 0)
        kept = (outside <= tolerance_us) & (e + tolerance_us >= c_start[kid]) & (ids[order[place]] != own[kid])
        kid, place, outside = kid[kept], order[place[kept]], outside[kept]
        if len(kid):
            s, e = s[kept], e[kept]
            cost = (100 * outside + (e - s)).astype(float) + 0.05 * np.abs(c_start[kid] - s)
            first = least(kid, cost, place)
            found_at.append(kid[first])
            found.append(place[first])
    if not found:
        return pd.DataFrame({"call_id": [], "parent": [], "label": []}, dtype=object)
    best = parents.iloc[np.concatenate(found)]
    return pd.DataFrame({"call_id": kids["call_id"].to_numpy()[np.concatenate(found_at)], "parent": best["p_id"].to_numpy(), "label": best["label"].to_numpy()})


def labels_from_parents(parents: DataFrame, roots: DataFrame) -> DataFrame:
    """(call_id, label) from roots down a predicted parent tree of any depth; calls on cycles get none."""
    done = written(roots.select("call_id", "label"), "labels")
    front = done
    while True:
        front = written(parents.join(front.withColumnRenamed("call_id", "parent"), "parent").select("call_id", "label").join(done.select("call_id"), "call_id", "left_anti"), "front")
        if front.isEmpty():
            return done
        done = written(done.unionByName(front), "labels")


def map_hops(calls: DataFrame, depth: int) -> DataFrame:
    """(root, depth, call_id): each entry call with what it reaches through assigned parents, a join a level."""
    level = calls.where("parent_id is null").select(F.col("call_id").alias("root"), F.lit(0).alias("depth"), "call_id")
    out = level
    for k in range(1, depth + 1):
        level = calls.select("call_id", F.col("parent_id").alias("up")).join(level.select("root", F.col("call_id").alias("up")), "up").select("root", F.lit(k).alias("depth"), "call_id")
        out = out.unionByName(level)
    return out


def attach_db_lineage(calls: DataFrame, db: DataFrame, min_score: float = 0.08, margin: float = 0.03, width: int = 100_000) -> DataFrame:
    """(db_id, owner): the service call that a database call belongs to.

    Calls of the database call's client that contain it (-20 / +80 ms), else that it starts in; ranked by the
    share of strong tokens, the shortest, the nearest start. Too weak or too ambiguous ones get no owner. Pairs are
    ranked in the partition where they were joined, by what is needed of them.
    """
    p = calls.select(F.col("call_id").alias("owner"), F.col("server").alias("client"), F.col("start_us").alias("p_start"), F.col("end_us").alias("p_end"), F.col("strong").alias("p_strong"))
    p = p.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("p_start") - 20_000, width), _bucket(F.col("p_end") + 80_000, width))))
    d = db.select(F.col("call_id").alias("db_id"), "client", "start_us", "end_us", "strong").withColumn("bucket", _bucket(F.col("start_us"), width))
    j = d.join(p, ["client", "bucket"]).where("start_us between p_start - 20000 and p_end + 80000")
    shared = F.size(F.array_intersect("strong", "p_strong"))
    score = F.when(shared > 0, shared / F.greatest(F.least(F.size("strong"), F.size("p_strong")), F.lit(1))).otherwise(0.0)
    j = j.select("client", "bucket", "db_id", "owner", (F.col("p_end") + 80_000 >= F.col("end_us")).alias("inside"), score.alias("score"), (F.col("p_end") - F.col("p_start")).alias("length"), F.abs(F.col("start_us") - F.col("p_start")).alias("gap"))
    w = Window.partitionBy("client", "bucket", "db_id")
    # A call's inside pairs come first, so its first row says whether it has any.
    order = w.orderBy(F.desc("inside"), F.desc("score"), "length", "gap", "owner")
    j = j.withColumn("any_inside", F.first("inside").over(order)).where("inside or not any_inside")
    j = j.withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(0.0))).withColumn("rank", F.row_number().over(order))
    return j.where((F.col("rank") == 1) & (F.col("score") >= min_score) & (F.col("score") - F.col("second") >= margin)).select("db_id", "owner", F.round("score", 6).alias("score"))


def extend_owners(tokens: DataFrame, db_tokens: DataFrame, owners: DataFrame) -> DataFrame:
    """tokens with those of the database calls that a call owns (owners: db_id, owner), and ``weights`` of all as a parent's.

    Requests of the database count as the owner's request; as a parent's they weigh 0.9 and results 0.2, the owner's
    own 1.0 and 0.8, the larger where several say so. Results are evidence for children only.
    """
    d = owners.select("db_id", "owner").join(db_tokens.select(F.col("call_id").alias("db_id"), F.col("req").alias("d_req"), F.col("res").alias("d_res")), "db_id")
    part = lambda side, weight: d.select("owner", F.explode(side).alias("token"), F.lit(weight).alias("weight"))
    met = part("d_req", 0.9).unionByName(part("d_res", 0.2)).groupBy("owner", "token").agg(F.max("weight").alias("weight"))
    asked = F.array_sort(F.collect_list(F.when(F.col("weight") == 0.9, F.col("token"))))
    more = met.groupBy(F.col("owner").alias("call_id")).agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("db_weights"), asked.alias("asked"))
    j = tokens.join(more, "call_id", "left").withColumn("weights", F.when(F.col("db_weights").isNull(), weight_map(0.8)).otherwise(merged_weights(weight_map(0.8), F.col("db_weights"))))
    asked = F.coalesce("asked", F.array().cast("array<string>"))
    return j.select("call_id", "client", "server", F.array_union("req", asked).alias("req"), "res", F.array_union("all", asked).alias("all"), "weights")
