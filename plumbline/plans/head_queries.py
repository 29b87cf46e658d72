"""Queries of learned heads, folds and gates.  Fits have no SQL; tests/test_heads.py holds them against what they should find."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.hashing import md5_number, shuffle_key
from plumbline.functions.sequences import kmers
from plumbline.operators import heads as h
from plumbline.operators import metrics as m
from plumbline.operators import neighbors
from plumbline.operators import relational as r
from plumbline.operators import sampling as x
from plumbline.plans.metric_queries import rounded
from plumbline.plans.registry import query

FOLDS = 5


def hashed(name, k=FOLDS):
    return F.pmod(md5_number(name, F.col("id")), F.lit(k)).cast("int")


def embedded(t):
    e = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("label"), (F.col("vec_id") % 10).alias("grp"), "embedding")
    return h.vectors(e, "embedding").drop("embedding")


def worded(t):
    return t.items.select("id", F.col("toxic").alias("label"), "grp", "text")


@query("q_m1_linear_head")
def m1(t):
    e = embedded(t)
    return h.score(h.linear_head(e), e).select("id", "label", "prob")


@query("q_m2_out_of_fold")
def m2(t):
    return h.out_of_fold(embedded(t).withColumn("fold", hashed("m2")), FOLDS).select("id", "label", "fold", "prob")


@query("q_m3_hashed_head")
def m3(t):
    d = h.hashed_ngrams(worded(t), F.split(F.lower("text"), r"\s+")).drop("text").withColumn("fold", hashed("m3"))
    return m.auroc(h.out_of_fold(d, FOLDS), [])


@query("q_m4_tf_idf")
def m4(t):
    d = h.tf_idf(worded(t), F.split(F.lower("text"), r"\s+"), most=3000).drop("text").withColumn("fold", hashed("m4"))
    return m.auroc(h.out_of_fold(d, FOLDS), [])


@query("q_m5_bag_of_tokens")
def m5(t):
    d = h.bag_of_tokens(worded(t), F.split(F.lower("text"), r"\s+"), 500).drop("text").withColumn("fold", hashed("m5"))
    return m.auroc(h.out_of_fold(d, FOLDS), [])


@query("q_m6_forest")
def m6(t):
    return m.auroc(h.out_of_fold(embedded(t).withColumn("fold", hashed("m6")), FOLDS, h.forest_head), [])


@query("q_m9_gate")
def m9(t):
    e = x.shuffled_labels(embedded(t), 9)
    return h.gate(e, FOLDS, hashed("m9"), F.pmod(md5_number("g9", F.col("grp")), F.lit(FOLDS)).cast("int"), "shuffled")


@query("q_m10_anonymized_gate")
def m10(t):
    d = worded(t).withColumn("fold", F.pmod(md5_number("g10", F.col("grp")), F.lit(FOLDS)).cast("int"))
    arms = {"named": F.split(F.lower("text"), r"\s+"), "anon": kmers(F.lower("text"), 2)}
    one = lambda n: m.auroc(h.out_of_fold(h.hashed_ngrams(d, arms[n]).drop("text"), FOLDS), [], name=n)
    both = one("named").join(one("anon")).withColumn("delta", F.col("named") - F.col("anon"))
    return both.withColumn("verdict", F.when((F.col("named") >= 0.65) & (F.col("delta") >= 0.10), "name-driven").when(F.col("anon") >= 0.60, "intrinsic").otherwise("weak"))


LAYERS = [0, 1, 2, 3]


def layered(t):
    e = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("label"), "embedding")
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), F.slice("embedding", 16 * k + 1, 16).alias("v")) for k in LAYERS]))
    return h.vectors(e.withColumn("p", parts).select("id", "label", "p.layer", "p.v"), "v").drop("v").withColumn("fold", hashed("m11"))


@query("q_m11_layer_curve")
def m11(t):
    one = layered(t)
    labels = x.shuffled_labels(one.select("id", "label").distinct(), 11).select("id", "shuffled")
    return h.layer_selectivity(one.join(labels, "id"), LAYERS, FOLDS, "shuffled")


@query("q_m12_nested_layer")
def m12(t):
    return h.nested_layer(layered(t), LAYERS, FOLDS)


@query("q_m14_residualize", """+ f AS (SELECT event_id AS id, event_id % 3 AS fold, value AS y, length(props)::DOUBLE AS x FROM events), s AS (SELECT a.fold, regr_slope(b.y, b.x) AS b, avg(b.y) - coalesce(regr_slope(b.y, b.x), 0) * avg(b.x) AS a FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON a.fold <> b.fold GROUP BY a.fold)
SELECTING SELECT f.id, round(y - a - coalesce(b, 0) * x, 4) AS residual FROM f JOIN s USING (fold)""")
def m14(t):
    f = t.events.select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("fold"), F.col("value").alias("y"), F.length("props").cast("double").alias("x"))
    return h.residualized(f, "y", "x", 3).select("id", F.round("residual", 4).alias("residual"))


@query("q_m15_principal")
def m15(t):
    return m.auroc(h.out_of_fold(h.principal(embedded(t), 8).withColumn("fold", hashed("m15")), FOLDS), [])


@query("q_m16_transfer")
def m16(t):
    e = embedded(t)
    return h.transfer(e.where("grp < 5"), e.where("grp >= 5"))


@query("q_m17_neighbor_specialist", """+ g AS (SELECT p_partkey AS id, p_size % 2 AS label, list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))) AS bits FROM part),
k AS (SELECT q.id AS q, p.label, row_number() OVER (PARTITION BY q.id ORDER BY len(list_intersect(q.bits, p.bits)) / len(list_distinct(list_concat(q.bits, p.bits)))::DOUBLE DESC, p.id) AS k FROM g q JOIN g p ON q.id <> p.id AND len(list_intersect(q.bits, p.bits)) > 0 WHERE q.id % 20 = 0) SELECTING SELECT q AS id, round(avg(label::DOUBLE), 6) AS mean_label FROM k WHERE k <= 10 GROUP BY q""")
def m17(t):
    from plumbline.plans.relational_queries import trigrams

    g = trigrams(t).drop("grp")
    return rounded(r.neighbor_votes(neighbors.nearest(g.where("id % 20 = 0"), g, 10)).select("id", "mean_label"), "mean_label")


@query("q_m18_best_of_n", "+ o AS (SELECT id, label, spec_prob, row_number() OVER (ORDER BY md5('n:' || id), id) AS rn FROM preds WHERE model = 'alpha'), b AS (SELECT n, label, row_number() OVER (PARTITION BY n ORDER BY spec_prob DESC, id) AS k FROM o, (VALUES (40), (160)) v(n) WHERE rn <= n) SELECTING SELECT n AS budget, round(avg(label::DOUBLE), 6) AS pass_rate FROM b WHERE k <= 10 GROUP BY ALL", "preds")
def m18(t):
    p = t.preds.where("model = 'alpha'").select("id", "label", "spec_prob")
    best = r.best_within_budgets(p, shuffle_key("n", F.col("id")), "spec_prob", [40, 160], 10)
    return rounded(best.join(p, "id").groupBy("budget").agg(F.avg(F.col("label").cast("double")).alias("pass_rate")), "pass_rate")


@query("q_m20_power_gate", """+ d AS (SELECT (user_id % 3)::INT AS temperature, substr(md5(props || user_id % 40), 1, 4) AS design, value > 10 AS valid FROM events),
f AS (SELECT temperature, design, row_number() OVER (PARTITION BY temperature ORDER BY md5('m20:' || design), design) AS rn, list_distinct(list_transform(range(1, 4), lambda i: substr(design, i, 2))) AS bits FROM (SELECT DISTINCT temperature, design FROM d WHERE valid AND substr(design, 1, 1) <> 'a')),
v AS (SELECT a.temperature, round(1 - avg(len(list_intersect(a.bits, b.bits)) / len(list_distinct(list_concat(a.bits, b.bits)))::DOUBLE), 6) AS diversity FROM f a JOIN f b ON a.temperature = b.temperature AND a.design < b.design WHERE a.rn <= 200 AND b.rn <= 200 GROUP BY ALL),
c AS (SELECT temperature, count(*) AS fresh FROM f GROUP BY ALL), s AS (SELECT temperature, avg(valid::INT::DOUBLE) AS valid, count(*) AS n FROM d GROUP BY ALL),
g AS (SELECT s.temperature, round(s.valid, 6) AS validity, round(c.fresh * 1000 / s.n::DOUBLE, 4) AS novel_per_1k, v.diversity FROM s JOIN c USING (temperature) JOIN v USING (temperature)),
p AS (SELECT *, validity >= 0.7 AND novel_per_1k >= 200 AND diversity >= 0.7 AS pass FROM g) SELECTING SELECT *, pass AND temperature = (SELECT max(temperature) FROM p WHERE pass) AS operating FROM p""")
def m20(t):
    design = F.substring(F.md5(F.concat("props", F.col("user_id") % 40)), 1, 4)
    d = t.events.select((F.col("user_id") % 3).cast("int").alias("temperature"), design.alias("design"), (F.col("value") > 10).alias("valid"))
    known = d.where(F.startswith("design", F.lit("a"))).select("design").distinct()
    return r.power_gate(d, known, [0, 1, 2], shuffle_key("m20", F.col("design")), 200)


@query("q_r5_learned_router")
def r5(t):
    p = t.preds.where("model = 'alpha'")
    row = p.select("id", "err", "spec_err", (1 - F.col("err")).alias("label"), F.array("conf", F.abs(F.col("prob") - F.col("spec_prob")), (F.col("web") == "rich").cast("double")).alias("v"))
    scored = h.out_of_fold(h.vectors(row, "v").drop("v").withColumn("fold", hashed("r5")), FOLDS, name="p")
    right = F.when(F.col("p") > 0.5, 1.0 - F.col("err")).otherwise(1.0 - F.col("spec_err"))
    return scored.agg(F.avg(right).alias("routed"), F.avg((F.col("p") > 0.5).cast("double")).alias("self_share"))


@query("q_x10_cluster_groups")
def x10(t):
    return h.cluster_groups(embedded(t).drop("grp"), 3).groupBy("grp").agg(F.count("*").alias("n"))


@query("q_x24_ensemble")
def x24(t):
    e = embedded(t)
    draws = F.array(*[F.pmod(md5_number("x24", k, F.col("id")), F.lit(3)) for k in range(3)])
    return h.ensemble(e.where("grp < 7"), e.where("grp >= 7"), draws, 3)


@query("q_x6_greedy_folds")
def x6(t):
    sizes = {g: n for g, (n,) in x.group_sums(t.items, "grp", F.count("*")).items()}
    folds = t.spark.createDataFrame(sorted(x.greedy_folds(sizes, 5).items()), "grp string, fold int")
    return t.items.join(F.broadcast(folds), "grp").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("n_groups"))


@query("q_x8_frozen_test_fold")
def x8(t):
    from plumbline.sources.staging import scratch

    sizes = {g: n for g, (n,) in x.group_sums(t.items, "grp", F.count("*")).items()}
    frozen = t.spark.createDataFrame([(g,) for g, f in x.greedy_folds(sizes, 5).items() if f == 0], "grp string")
    path = scratch(t.spark, "test-ids")
    t.items.join(frozen, "grp", "left_semi").select("id").write.parquet(path)
    return t.items.join(t.spark.read.parquet(path), "id", "left_semi").select("id", "grp", "label")


@query("q_x9_two_pass_partition")
def x9(t):
    parts = x.two_pass_partition(x.group_sums(t.items, "grp", F.sum("toxic"), F.count("*")), 3)
    named = t.spark.createDataFrame(sorted(parts.items()), "grp string, block int")
    return t.items.join(F.broadcast(named), "grp").groupBy("block").agg(F.count("*").alias("n"), F.sum("toxic").alias("positives"))
