"""Queries of samples, splits and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.hashing import md5_number
from plumbline.operators import metrics as m
from plumbline.operators import neighbors
from plumbline.operators import relational as r
from plumbline.operators import sampling as x
from plumbline.plans.metric_queries import rounded
from plumbline.plans.registry import query

KEYS = ["model", "task"]
MD5 = "('0x' || substr(md5({}), 1, 8))::BIGINT"
ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('{s}:' || id), id) AS rn, count_if(toxic = 1) OVER () AS p, count_if(toxic = 0) OVER () AS q FROM items)"


@query("q_x1_balanced", f"+ {ORDERED.format(s=1)} SELECTING SELECT id, toxic FROM o WHERE rn <= least(50, p, q)", "items")
def x1(t):
    return x.balanced(t.items, 100, 1, label="toxic").select("id", "toxic")


@query("q_x2_class_cap", f"+ {ORDERED.format(s=2)} SELECTING SELECT id, toxic FROM o WHERE rn <= 60", "items")
def x2(t):
    return x.balanced(t.items, 120, 2, label="toxic", even=False).select("id", "toxic")


@query("q_x3_random_cap", "SELECT id FROM items ORDER BY md5('3:' || id), id LIMIT 200", "items")
def x3(t):
    return x.capped(t.items, 200, 3).select("id")


@query("q_x4_degraded", f"+ {ORDERED.format(s=4)} SELECTING SELECT id, toxic FROM o WHERE rn <= CASE toxic WHEN 1 THEN 20 ELSE round_even(20 * q / p::DOUBLE, 0) END", "items")
def x4(t):
    return x.degraded(t.items, 20, 4, label="toxic").select("id", "toxic")


@query("q_x5_stratified_folds", f"+ {ORDERED.format(s=5)} SELECTING SELECT ((rn - 1) % 5)::INT AS fold, toxic, count(*) AS n FROM o GROUP BY ALL", "items")
def x5(t):
    return x.stratified_folds(t.items, 5, 5, label="toxic").groupBy("fold", "toxic").agg(F.count("*").alias("n"))


@query("q_x6_group_folds", f"SELECT ({MD5.format(chr(39) + '6:' + chr(39) + ' || grp')} % 5)::INT AS fold, count(*) AS n, count(DISTINCT grp) AS n_groups FROM items GROUP BY ALL", "items")
def x6(t):
    return x.group_folds(t.items, 5, 6).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("n_groups"))


@query("q_x7_group_holdout", "+ s AS (SELECT grp, count(*) AS n FROM items GROUP BY ALL), c AS (SELECT grp, coalesce(sum(n) OVER (ORDER BY md5('7:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.3::DOUBLE * sum(n) OVER () AS test FROM s) SELECTING SELECT grp, test FROM c", "items")
def x7(t):
    return x.group_holdout(t.items, 0.3, 7).select("grp", "test").distinct()


@query("q_x11_shuffled_labels", "+ a AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM items), b AS (SELECT toxic, row_number() OVER (ORDER BY md5('123:' || id), id) AS rn FROM items) SELECTING SELECT id, toxic AS shuffled FROM a JOIN b USING (rn)", "items")
def x11(t):
    return x.shuffled_labels(t.items, 123, label="toxic").select("id", "shuffled")


@query("q_x26_reserved_examples", f"+ {ORDERED.format(s=26)} SELECTING SELECT rn <= 4 AS example, toxic, count(*) AS n FROM o GROUP BY ALL", "items")
def x26(t):
    return x.reserved_examples(t.items, 8, 26, label="toxic").groupBy("example", "toxic").agg(F.count("*").alias("n"))


REPS = 20


def _drawn(unit: str, seed: str, keys: str = "model, task") -> str:
    return f"""u AS (SELECT {keys}, {unit} AS u, row_number() OVER (PARTITION BY {keys} ORDER BY {unit}) AS rk FROM (SELECT DISTINCT {keys}, {unit} FROM preds)),
z AS (SELECT {keys}, count(*) AS n FROM u GROUP BY ALL), d AS (SELECT {keys}, rep, {MD5.format(f"'{seed}:' || rep || ':' || i")} % n + 1 AS rk FROM (SELECT z.*, rep, unnest(range(n)) AS i FROM z, range({REPS}) r(rep))),
w AS (SELECT {keys}, rep, u.u, count(*) AS m FROM d JOIN u USING ({keys}, rk) GROUP BY ALL)"""


def _auc(score: str, unit: str, name: str) -> str:
    return f"""{name}_s AS (SELECT p.model, p.task, rep, {score} AS s, sum(m) AS n, sum(m * label) AS pos FROM preds p JOIN w ON p.model = w.model AND p.task = w.task AND p.{unit} = w.u GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY model, task, rep ORDER BY s ROWS UNBOUNDED PRECEDING) - (n - 1) / 2.0::DOUBLE AS r FROM {name}_s),
{name} AS (SELECT model, task, rep, (sum(pos * r) - sum(pos) * (sum(pos) + 1) / 2.0::DOUBLE) / nullif(sum(pos) * (sum(n) - sum(pos)), 0)::DOUBLE AS auroc FROM {name}_r GROUP BY ALL)"""


@query("q_x20_bootstrap_ci", f"+ {_drawn('id', '20')}, {_auc('prob', 'id', 'a')} SELECTING SELECT model, task, round(quantile_cont(auroc, 0.025), 6) AS lo, round(quantile_cont(auroc, 0.975), 6) AS hi FROM a GROUP BY ALL", "preds")
def x20(t):
    return rounded(x.interval(x.bootstrap_auroc(t.preds, KEYS, REPS, 20), KEYS, "auroc"), "lo", "hi")


@query("q_x21_cluster_bootstrap", f"+ {_drawn('grp', '21')}, {_auc('prob', 'grp', 'a')} SELECTING SELECT model, task, round(quantile_cont(auroc, 0.025), 6) AS lo, round(quantile_cont(auroc, 0.975), 6) AS hi FROM a GROUP BY ALL", "preds")
def x21(t):
    return rounded(x.interval(x.bootstrap_auroc(t.preds, KEYS, REPS, 21, unit="grp"), KEYS, "auroc"), "lo", "hi")


@query("q_x22_paired_bootstrap", f"+ {_drawn('grp', '22')}, {_auc('prob', 'grp', 'a')}, {_auc('spec_prob', 'grp', 'b')}, v AS (SELECT model, task, quantile_cont(b.auroc - a.auroc, 0.025) AS lo, quantile_cont(b.auroc - a.auroc, 0.975) AS hi FROM a JOIN b USING (model, task, rep) GROUP BY ALL) SELECTING SELECT model, task, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS excludes_zero FROM v", "preds")
def x22(t):
    p = t.preds
    a = x.bootstrap_auroc(p, KEYS, REPS, 22, unit="grp")
    b = x.bootstrap_auroc(p, KEYS, REPS, 22, score="spec_prob", unit="grp").withColumnRenamed("auroc", "other")
    diff = a.join(b, [*KEYS, "rep"]).select(*KEYS, (F.col("other") - F.col("auroc")).alias("diff"))
    return rounded(x.interval(diff, KEYS, "diff").withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0)), "lo", "hi")


def _arm(model: str, name: str) -> str:
    return f"""{name}_g AS (SELECT grp, count(*) AS n, sum(1 - err) AS k, row_number() OVER (ORDER BY grp) AS rk FROM preds WHERE model = '{model}' GROUP BY grp),
{name} AS (SELECT rep, sum(k) / sum(n)::DOUBLE AS v FROM (SELECT rep, {MD5.format(f"'23{name}:' || rep || ':' || i")} % (SELECT count(*) FROM {name}_g) + 1 AS rk FROM range({REPS}) r(rep), (SELECT unnest(range((SELECT count(*) FROM {name}_g))) AS i)) JOIN {name}_g USING (rk) GROUP BY rep)"""


@query("q_e6_bootstrap_metric", f"+ {_drawn('grp', 'e6')}, a AS (SELECT p.model, p.task, rep, sum(m * (pred = label)::INT) / sum(m)::DOUBLE AS accuracy FROM preds p JOIN w ON p.model = w.model AND p.task = w.task AND p.grp = w.u GROUP BY ALL) SELECTING SELECT model, task, round(quantile_cont(accuracy, 0.025), 6) AS lo, round(quantile_cont(accuracy, 0.975), 6) AS hi FROM a GROUP BY ALL", "preds")
def e6(t):
    drawn = x.bootstrap(t.preds, KEYS, REPS, "e6", lambda rows, by, w: m.accuracy(rows, by, weight=w), unit="grp")
    return rounded(x.interval(drawn, KEYS, "accuracy"), "lo", "hi")


VERDICT = "CASE WHEN lo > 0.03 THEN 'a' WHEN hi < -0.03 THEN 'b' ELSE 'tie' END"


@query("q_x23_two_sample_bootstrap", f"+ {_arm('alpha', 'a')}, {_arm('gamma', 'b')}, v AS (SELECT quantile_cont(a.v - b.v, 0.025) AS lo, quantile_cont(a.v - b.v, 0.975) AS hi FROM a JOIN b USING (rep)) SELECTING SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, {VERDICT} AS verdict FROM v", "preds")
def x23(t):
    p = t.preds
    d = x.pass_rate_difference(p.where("model = 'alpha'"), p.where("model = 'gamma'"), REPS, 23, "grp", F.col("err") == 0)
    return rounded(x.interval(d, [], "diff").withColumn("verdict", F.expr(VERDICT)), "lo", "hi")


@query("q_j11_matched_vs_perturbed", """+ v AS (SELECT id, 'matched' AS condition, length(text) AS x FROM items UNION ALL SELECT id, 'scrambled', length(replace(text, 'e', '')) FROM items) SELECTING SELECT round(avg(abs(a.x - b.x)), 4) AS mean_abs_delta, count(*) AS n FROM v a JOIN v b ON a.id = b.id AND a.condition = 'matched' AND b.condition = 'scrambled'""", "items")
def j11(t):
    i = t.items
    v = i.select("id", F.lit("matched").alias("condition"), F.length("text").alias("x")).unionByName(i.select("id", F.lit("scrambled").alias("condition"), F.length(F.replace("text", F.lit("e"), F.lit(""))).alias("x")))
    both = v.where("condition = 'matched'").select("id", "x").join(v.where("condition = 'scrambled'").select("id", F.col("x").alias("y")), "id")
    return both.agg(F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 4).alias("mean_abs_delta"), F.count("*").alias("n"))


@query("q_j20_fold_knn", """+ g AS (SELECT p_partkey AS id, {MD5} % 5 AS fold, list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))) AS bits FROM part),
k AS (SELECT q.id AS id, p.id AS neighbor, row_number() OVER (PARTITION BY q.id ORDER BY len(list_intersect(q.bits, p.bits)) / len(list_distinct(list_concat(q.bits, p.bits)))::DOUBLE DESC, p.id) AS k FROM g q JOIN g p ON q.fold <> p.fold AND len(list_intersect(q.bits, p.bits)) > 0 WHERE q.id % 20 = 0) SELECTING SELECT id, neighbor, k FROM k WHERE k <= 3""".replace("{MD5}", MD5.format("'j20:' || p_partkey")))
def j20(t):
    from plumbline.plans.relational_queries import trigrams

    g = trigrams(t).select("id", F.pmod(md5_number("j20", F.col("id")), F.lit(5)).alias("fold"), "bits")
    return neighbors.nearest(g.where("id % 20 = 0"), g, 3, apart="fold").select("id", "neighbor", "k")


@query("q_j9_realign", "SELECT a.id, a.prob AS first, b.prob AS second FROM preds a JOIN preds b USING (id) WHERE a.model = 'alpha' AND b.model = 'gamma'", "preds")
def j9(t):
    arm = lambda m, n: t.preds.where(F.col("model") == m).select("id", F.col("prob").alias(n))
    return arm("alpha", "first").join(arm("gamma", "second"), "id")


@query("q_o1_confidence_order", "SELECT model, id, row_number() OVER (PARTITION BY model ORDER BY conf DESC, id) AS k FROM preds", "preds")
def o1(t):
    return r.ranked(t.preds.withColumn("_c", -F.col("conf")), ["model"], ["_c", "id"], "k").select("model", "id", F.col("k").cast("long").alias("k"))




@query("q_x20_split_draws")
def x20_split(t):
    known = t.preds.where("prob is not null and label is not null").select("model", "prob", "label")
    return rounded(x.interval(x.split_bootstrap_auroc(known, ["model"], 200, 20), ["model"], "auroc"), "lo", "hi")
