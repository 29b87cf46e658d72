"""Queries of the metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import metrics as m
from plumbline.operators import relational as r
from plumbline.plans.registry import query

KEYS = ["model", "task"]


def conf():
    return F.round(F.greatest(F.col("prob"), 1 - F.col("prob")), 4)


def rounded(df, *columns):
    """These columns to six decimals, so that the order of a sum doesn't show."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


RANKS = """r AS (SELECT model, task, label, rank() OVER (PARTITION BY model, task ORDER BY prob) + (count(*) OVER (PARTITION BY model, task, prob) - 1) / 2.0::DOUBLE AS r FROM preds)"""
AUROC = "round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / nullif(sum(label) * (count(*) - sum(label)), 0)::DOUBLE, 6)"
CURVE = """c AS (SELECT *, avg(err::DOUBLE) OVER (PARTITION BY model, task ORDER BY cf DESC, id ROWS UNBOUNDED PRECEDING) AS risk,
  row_number() OVER (PARTITION BY model, task ORDER BY cf DESC, id) AS k, count(*) OVER (PARTITION BY model, task) AS n
  FROM (SELECT *, round(greatest(prob, 1 - prob), 4) AS cf FROM preds))"""
EDGES = "list_sum(list_transform(range(1, 10), lambda i: ({x} > i * 0.1::DOUBLE)::INT))"
EDGES_FROM = "list_sum(list_transform(range(1, 10), lambda i: ({x} >= i / 10::DOUBLE)::INT))"
ECE_CONF = f"""e AS (SELECT model, task, CASE WHEN c > 0 THEN {EDGES.format(x='c')} END AS b, c, right_ FROM (SELECT model, task, greatest(prob, 1 - prob) AS c, 1.0::DOUBLE - err AS right_ FROM preds)),
eb AS (SELECT model, task, b, count(*) AS n, abs(avg(c) - avg(right_)) AS gap FROM e GROUP BY ALL)"""


@query("scorecard", f"""+ {RANKS}, {CURVE}, {ECE_CONF}
SELECTING
SELECT a.model, a.task, a.n, a.auroc, e.ece_conf, c.aurc, c.sel_acc_50 FROM
 (SELECT model, task, count(*) AS n, {AUROC} AS auroc FROM r GROUP BY ALL) a
 JOIN (SELECT model, task, round(sum(n * gap) / sum(n), 6) AS ece_conf FROM eb GROUP BY ALL) e USING (model, task)
 JOIN (SELECT model, task, round(avg(risk), 6) AS aurc, round(avg(1.0::DOUBLE - err) FILTER (k <= greatest(1, floor(n * 0.5))), 6) AS sel_acc_50 FROM c GROUP BY ALL) c USING (model, task)""", "preds")
def scorecard(t):
    # the curve stages its rows, so predictions are made once for all metrics
    p = m.risk_curve(t.preds.select(*KEYS, "id", "prob", "label", "err"), KEYS, [conf().desc(), F.col("id")], F.col("err"))
    half = F.avg(F.when(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.5)), 1.0 - F.col("err")))
    row = p.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("risk").alias("aurc"), half.alias("sel_acc_50"))
    row = row.join(m.auroc(p, KEYS), KEYS).join(m.ece_confidence(p, KEYS), KEYS)
    return rounded(row.select(*KEYS, "n", "auroc", "ece_conf", "aurc", "sel_acc_50"), "auroc", "ece_conf", "aurc", "sel_acc_50")


@query("q_a1_auroc", f"+ {RANKS} SELECTING SELECT model, task, {AUROC} AS auroc FROM r GROUP BY ALL", "preds")
def a1(t):
    return rounded(m.auroc(t.preds, KEYS), "auroc")


@query("q_a2_action_auroc", """+ x AS (SELECT model, task, (route = 'SELF')::INT AS s, 1 - err AS y FROM preds),
rr AS (SELECT *, rank() OVER (PARTITION BY model, task ORDER BY s) + (count(*) OVER (PARTITION BY model, task, s) - 1) / 2.0::DOUBLE AS r FROM x) SELECTING
SELECT model, task, CASE WHEN min(s) < max(s) THEN round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0)::DOUBLE, 6) END AS action_auroc FROM rr GROUP BY ALL""", "preds")
def a2(t):
    p = t.preds.withColumns({"act": (F.col("route") == "SELF").cast("int"), "ok": 1 - F.col("err")})
    varies = p.groupBy(*KEYS).agg((F.min("act") < F.max("act")).alias("v"))
    out = m.auroc(p, KEYS, "act", "ok", name="action_auroc").join(varies, KEYS)
    return rounded(out.select(*KEYS, F.when(F.col("v"), F.col("action_auroc")).alias("action_auroc")), "action_auroc")


@query("q_a3_average_precision", """+ s AS (SELECT model, task, prob, count(*) AS n, sum(label) AS p FROM preds GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w / sum(n) OVER w::DOUBLE AS pr FROM s WINDOW w AS (PARTITION BY model, task ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)) SELECTING
SELECT model, task, round(sum(p * pr) / nullif(sum(p), 0), 6) AS ap FROM c GROUP BY ALL""", "preds")
def a3(t):
    return rounded(m.average_precision(t.preds, KEYS), "ap")


@query("q_a4_ece_confidence", f"+ {ECE_CONF} SELECTING SELECT model, task, round(sum(n * gap) / sum(n), 6) AS ece_conf FROM eb GROUP BY ALL", "preds")
def a4(t):
    return rounded(m.ece_confidence(t.preds, KEYS), "ece_conf")


@query("q_a5_ece_probability", f"""+ eb AS (SELECT model, task, {EDGES_FROM.format(x='prob')} AS b, count(*) AS n, abs(avg(prob) - avg(label)) AS gap FROM preds GROUP BY ALL)
SELECTING SELECT model, task, round(sum(n * gap) / sum(n), 6) AS ece_prob FROM eb GROUP BY ALL""", "preds")
def a5(t):
    return rounded(m.ece_probability(t.preds, KEYS), "ece_prob")


@query("q_a6_aurc", f"+ {CURVE} SELECTING SELECT model, task, round(avg(risk), 6) AS aurc FROM c GROUP BY ALL", "preds")
def a6(t):
    return rounded(m.aurc(t.preds, KEYS, conf(), F.col("err")), "aurc")


TIES = """b AS (SELECT model, task, {c} AS c, count(*) AS n, sum(err) AS e FROM preds GROUP BY ALL),
bb AS (SELECT *, sum(n) OVER w - n AS n0, sum(e) OVER w - e AS e0 FROM b WINDOW w AS (PARTITION BY model, task ORDER BY c DESC ROWS UNBOUNDED PRECEDING)),
x AS (SELECT model, task, (e0 + e * j / n::DOUBLE) / (n0 + j) AS risk FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM bb))"""


@query("q_a7_aurc_ties", f"+ {TIES.format(c='conf')} SELECTING SELECT model, task, round(avg(risk), 6) AS aurc FROM x GROUP BY ALL", "preds")
def a7(t):
    return rounded(m.aurc_expected(t.preds, KEYS, F.col("conf"), F.col("err")), "aurc")


@query("q_a8_excess_aurc", f"""+ {TIES.format(c='conf')}, o AS (SELECT model, task, avg(cum) AS oracle FROM (SELECT model, task, avg(err::DOUBLE) OVER (PARTITION BY model, task ORDER BY err, id ROWS UNBOUNDED PRECEDING) AS cum FROM preds) GROUP BY ALL)
SELECTING SELECT model, task, round(a, 6) AS aurc, round(oracle, 6) AS oracle, round(a - oracle, 6) AS e_aurc FROM (SELECT model, task, avg(risk) AS a FROM x GROUP BY ALL) JOIN o USING (model, task)""", "preds")
def a8(t):
    p = t.preds
    a = m.aurc_expected(p, KEYS, F.col("conf"), F.col("err"))
    o = m.aurc_expected(p, KEYS, 1 - F.col("err"), F.col("err"), name="oracle")
    return rounded(a.join(o, KEYS).withColumn("e_aurc", F.col("aurc") - F.col("oracle")), "aurc", "oracle", "e_aurc")


@query("q_a9_selective_accuracy", f"""+ {CURVE} SELECTING SELECT model, task, round(avg(1.0::DOUBLE - err) FILTER (k <= greatest(1, floor(n * 0.5))), 6) AS sel_acc_floor,
round(avg(1.0::DOUBLE - err) FILTER (k <= greatest(1, round_even(n * 0.25::DOUBLE, 0))), 6) AS sel_acc_even FROM c GROUP BY ALL""", "preds")
def a9(t):
    p, ok = t.preds, 1 - F.col("err")
    a = m.selective_accuracy(p, KEYS, conf(), ok, name="sel_acc_floor")
    return rounded(a.join(m.selective_accuracy(p, KEYS, conf(), ok, 0.25, half_even=True, name="sel_acc_even"), KEYS), "sel_acc_floor", "sel_acc_even")


@query("q_a10_risk_at_coverage", f"""+ {CURVE} SELECTING SELECT model, task, cov AS coverage, round(risk, 6) AS risk FROM c, (VALUES (0.2::DOUBLE), (0.5), (0.8)) v(cov)
WHERE k - 1 = greatest(0, least(n - 1, round_even(cov * n, 0) - 1))""", "preds")
def a10(t):
    curve = m.risk_curve(t.preds, KEYS, [conf().desc(), F.col("id")], F.col("err"))
    at = curve.withColumn("coverage", F.explode(F.array(*[F.lit(x) for x in (0.2, 0.5, 0.8)])))
    index = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.bround(F.col("coverage") * F.col("n"), 0) - 1))
    return rounded(at.where(F.col("k") - 1 == index).select(*KEYS, "coverage", "risk"), "risk")


@query("q_a11_coverage_at_risk", f"""+ {CURVE} SELECTING SELECT model, task, round(coalesce(max(k) FILTER (risk <= 0.1 + 1e-9), 0) / max(n)::DOUBLE, 6) AS coverage FROM c GROUP BY ALL""", "preds")
def a11(t):
    curve = m.risk_curve(t.preds, KEYS, [conf().desc(), F.col("id")], F.col("err"))
    k = F.coalesce(F.max(F.when(F.col("risk") <= 0.1 + 1e-9, F.col("k"))), F.lit(0))
    return rounded(curve.groupBy(*KEYS).agg((k / F.max("n")).alias("coverage")), "coverage")


@query("q_a12_behavioral_point", f"""+ {CURVE}, s AS (SELECT model, task, avg((route = 'SELF')::INT::DOUBLE) AS coverage, avg(err::DOUBLE) FILTER (route = 'SELF') AS risk, count(*) AS n FROM preds GROUP BY ALL)
SELECTING SELECT s.model, s.task, round(s.coverage, 6) AS coverage, round(s.risk, 6) AS risk,
 round(s.risk - CASE WHEN s.coverage <= 0 THEN 0 ELSE min(c.risk) FILTER (c.k - 1 = greatest(0, least(c.n - 1, round_even(s.coverage * c.n, 0) - 1))) END, 6) AS risk_gap,
 round(coalesce(max(c.k) FILTER (c.risk <= s.risk + 1e-9), 0) / max(c.n)::DOUBLE - s.coverage, 6) AS coverage_gap
FROM s JOIN c ON s.model = c.model AND s.task = c.task GROUP BY s.model, s.task, s.coverage, s.risk""", "preds")
def a12(t):
    p = t.preds
    own = p.groupBy(*KEYS).agg(F.avg((F.col("route") == "SELF").cast("double")).alias("coverage"), F.avg(F.when(F.col("route") == "SELF", F.col("err").cast("double"))).alias("risk_self"))
    curve = m.risk_curve(p, KEYS, [conf().desc(), F.col("id")], F.col("err")).join(own, KEYS)
    index = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.bround(F.col("coverage") * F.col("n"), 0) - 1))
    at = F.min(F.when(F.col("k") - 1 == index, F.col("risk")))
    sums = curve.groupBy(*KEYS, "coverage", "risk_self").agg(at.alias("at"), (F.coalesce(F.max(F.when(F.col("risk") <= F.col("risk_self") + 1e-9, F.col("k"))), F.lit(0)) / F.max("n")).alias("reach"))
    gap = F.col("risk_self") - F.when(F.col("coverage") <= 0, 0.0).otherwise(F.col("at"))
    return rounded(sums.select(*KEYS, "coverage", F.col("risk_self").alias("risk"), gap.alias("risk_gap"), (F.col("reach") - F.col("coverage")).alias("coverage_gap")), "coverage", "risk", "risk_gap", "coverage_gap")


@query("q_a13_error_rates", """SELECT model, task, round(avg((pred = label)::INT::DOUBLE), 6) AS accuracy,
round(count_if(pred = 1 AND label = 0) / greatest(count_if(label = 0), 1)::DOUBLE, 6) AS fp_rate, round(count_if(pred = 0 AND label = 1) / greatest(count_if(label = 1), 1)::DOUBLE, 6) AS fn_rate,
round(count_if(pred = 1 AND label = 0) / greatest(count_if(label = 0), 1)::DOUBLE - count_if(pred = 0 AND label = 1) / greatest(count_if(label = 1), 1)::DOUBLE, 6) AS asymmetry FROM preds GROUP BY ALL""", "preds")
def a13(t):
    return rounded(m.error_rates(t.preds, KEYS), "accuracy", "fp_rate", "fn_rate", "asymmetry")


@query("q_a14_any_fail", "SELECT l_orderkey AS id, max((l_returnflag = 'R')::INT) AS label FROM lineitem GROUP BY ALL")
def a14(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))


@query("q_a15_leaderboard", f"""+ {RANKS}, s AS (SELECT model, task, {AUROC} AS a FROM r GROUP BY ALL), w AS (SELECT task, min(web) AS web FROM items GROUP BY ALL)
SELECTING SELECT task, web, max(a) FILTER (model = 'alpha') AS alpha, max(a) FILTER (model = 'beta') AS beta, max(a) FILTER (model = 'gamma') AS gamma FROM s JOIN w USING (task) GROUP BY ALL""", "preds")
def a15(t):
    scores = rounded(m.auroc(t.preds, KEYS), "auroc")
    web = t.items.groupBy("task").agg(F.min("web").alias("web"))
    return scores.groupBy("task").pivot("model", ["alpha", "beta", "gamma"]).agg(F.first("auroc")).join(web, "task")


@query("q_a16_stratum_means", "SELECT web, model, round(avg(1.0::DOUBLE - err), 6) AS accuracy, round(avg((route = 'DEFER')::INT::DOUBLE), 6) AS defer_rate, round(avg(conf), 6) AS mean_conf FROM preds GROUP BY ALL", "preds")
def a16(t):
    out = t.preds.groupBy("web", "model").agg(
        F.avg((1 - F.col("err")).cast("double")).alias("accuracy"), F.avg((F.col("route") == "DEFER").cast("double")).alias("defer_rate"), F.avg("conf").alias("mean_conf")
    )
    return rounded(out, "accuracy", "defer_rate", "mean_conf")


@query("q_a17_value_counts", "SELECT model, kind, count(*) AS n FROM preds GROUP BY ALL", "preds")
def a17(t):
    return t.preds.groupBy("model", "kind").agg(F.count("*").alias("n"))


@query("q_a18_numeric_errors", """+ v AS (SELECT event_type, value, round(value * 1.01::DOUBLE, 1) AS said FROM events)
SELECTING SELECT event_type, round(avg(abs(value - said)), 6) AS mae, round(avg((abs(value - said) <= greatest(0.05::DOUBLE, 0.005::DOUBLE * abs(value)))::INT::DOUBLE), 6) AS exact,
round(avg((round_even(value, 0) = round_even(said, 0))::INT::DOUBLE), 6) AS int_exact FROM v GROUP BY ALL""")
def a18(t):
    v = t.events.select("event_type", "value", F.round(F.col("value") * 1.01, 1).alias("said"))
    gap = F.abs(F.col("value") - F.col("said"))
    out = v.groupBy("event_type").agg(
        F.avg(gap).alias("mae"),
        F.avg((gap <= F.greatest(F.lit(0.05), 0.005 * F.abs("value"))).cast("double")).alias("exact"),
        F.avg((F.rint("value") == F.rint("said")).cast("double")).alias("int_exact"),
    )
    return rounded(out, "mae", "exact", "int_exact")


@query("q_a19_pearson", "SELECT model, task, round(corr(prob, spec_prob), 6) AS r FROM preds GROUP BY ALL", "preds")
def a19(t):
    return rounded(t.preds.groupBy(*KEYS).agg(F.corr("prob", "spec_prob").alias("r")), "r")


@query("q_a20_spearman", """+ k AS (SELECT model, task, rank() OVER (PARTITION BY model, task ORDER BY conf) + (count(*) OVER (PARTITION BY model, task, conf) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY model, task ORDER BY spec_prob) + (count(*) OVER (PARTITION BY model, task, spec_prob) - 1) / 2.0 AS b FROM preds) SELECTING SELECT model, task, round(corr(a, b), 6) AS rho FROM k GROUP BY ALL""", "preds")
def a20(t):
    return rounded(m.spearman(t.preds, KEYS, "conf", "spec_prob"), "rho")


@query("q_a21_spearman_ordinal", """+ k AS (SELECT model, task, row_number() OVER (PARTITION BY model, task ORDER BY conf, id) AS a, row_number() OVER (PARTITION BY model, task ORDER BY spec_prob, id) AS b FROM preds)
SELECTING SELECT model, task, round(corr(a, b), 6) AS rho_ordinal FROM k GROUP BY ALL""", "preds")
def a21(t):
    return rounded(m.spearman_ordinal(t.preds, KEYS, "conf", "spec_prob"), "rho_ordinal")


@query("q_a22_memo_delta", f"""+ {RANKS}, s AS (SELECT model, task, {AUROC.replace(', 6)', ', 15)')} AS a FROM r GROUP BY ALL),
r2 AS (SELECT model, task, label, rank() OVER (PARTITION BY model, task ORDER BY sp) + (count(*) OVER (PARTITION BY model, task, sp) - 1) / 2.0::DOUBLE AS r FROM (SELECT *, round((prob + u) / 2, 4) AS sp FROM (SELECT p.*, p0.u5 AS u FROM preds p JOIN preds0 p0 USING (model, id)))),
s2 AS (SELECT model, task, {AUROC.replace(', 6)', ', 15)')} AS b FROM r2 GROUP BY ALL) SELECTING SELECT model, task, round(a - b, 6) AS memo_delta FROM s JOIN s2 USING (model, task)""", "preds")
def a22(t):
    from plumbline.functions.hashing import uniform

    p = t.preds.withColumn("scrambled", F.round((F.col("prob") + uniform(F.col("model"), F.col("id"), 5)) / 2, 4))
    both = m.auroc(p, KEYS).join(m.auroc(p, KEYS, "scrambled", name="b"), KEYS)
    return rounded(both.select(*KEYS, (F.col("auroc") - F.col("b")).alias("memo_delta")), "memo_delta")


@query("q_a23_gaps", f"""+ {RANKS}, s AS (SELECT model, task, {AUROC.replace(', 6)', ', 15)')} AS a FROM r GROUP BY ALL),
r2 AS (SELECT model, task, label, rank() OVER (PARTITION BY model, task ORDER BY spec_prob) + (count(*) OVER (PARTITION BY model, task, spec_prob) - 1) / 2.0::DOUBLE AS r FROM preds),
s2 AS (SELECT model, task, {AUROC.replace(', 6)', ', 15)')} AS c FROM r2 GROUP BY ALL) SELECTING SELECT model, task, round(c - a, 6) AS gap, round(1 - c, 6) AS headroom FROM s JOIN s2 USING (model, task)""", "preds")
def a23(t):
    p = t.preds
    both = m.auroc(p, KEYS).join(m.auroc(p, KEYS, "spec_prob", name="c"), KEYS)
    return rounded(both.select(*KEYS, (F.col("c") - F.col("auroc")).alias("gap"), (1 - F.col("c")).alias("headroom")), "gap", "headroom")


@query("q_a25_recognition_gap", """SELECT task, round(avg((1 - err)::DOUBLE) FILTER (model = 'alpha'), 6) AS matched, round(avg((1 - err)::DOUBLE) FILTER (model = 'gamma'), 6) AS scrambled,
round(avg((1 - err)::DOUBLE) FILTER (model = 'alpha') - avg((1 - err)::DOUBLE) FILTER (model = 'gamma'), 6) AS gap FROM preds GROUP BY ALL""", "preds")
def a25(t):
    ok = (1 - F.col("err")).cast("double")
    wide = t.preds.groupBy("task").pivot("model", ["alpha", "gamma"]).agg(F.avg(ok))
    return rounded(wide.select("task", F.col("alpha").alias("matched"), F.col("gamma").alias("scrambled"), (F.col("alpha") - F.col("gamma")).alias("gap")), "matched", "scrambled", "gap")


@query("q_a26_sign_concordance", """SELECT model, round(avg((sign(prob - 0.5) = sign(spec_prob - 0.5))::INT::DOUBLE) FILTER (abs(spec_prob - 0.5) >= 0.1), 6) AS concordance,
coalesce(avg((sign(prob - 0.5) = sign(spec_prob - 0.5))::INT::DOUBLE) FILTER (abs(spec_prob - 0.5) >= 0.1) >= 0.65, false) AS pass FROM preds GROUP BY ALL""", "preds")
def a26(t):
    same = (F.signum(F.col("prob") - 0.5) == F.signum(F.col("spec_prob") - 0.5)).cast("double")
    share = F.avg(F.when(F.abs(F.col("spec_prob") - 0.5) >= 0.1, same))
    return rounded(t.preds.groupBy("model").agg(share.alias("concordance"), F.coalesce(share >= 0.65, F.lit(False)).alias("pass")), "concordance")


@query("q_a28_most_frequent", """SELECT s_nationkey AS key, n, first_id, name FROM (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS first_id, arg_min(s_name, s_suppkey) AS name FROM supplier GROUP BY ALL) ORDER BY n DESC, first_id LIMIT 5""")
def a28(t):
    g = t.supplier.groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first_id"), F.min_by("s_name", "s_suppkey").alias("name"))
    return g.orderBy(F.desc("n"), "first_id").limit(5)


@query("q_a29_familiarity_share", """+ s AS (SELECT task, avg(prob) FILTER (model = 'alpha') AS nm, avg(prob) FILTER (model = 'beta') AS ob, avg(prob) FILTER (model = 'gamma') AS an FROM preds GROUP BY ALL)
SELECTING SELECT task, CASE WHEN nm - an > 0 THEN round((ob - an) / (nm - an), 5) END AS share FROM s""", "preds")
def a29(t):
    s = t.preds.groupBy("task").pivot("model", ["alpha", "beta", "gamma"]).agg(F.avg("prob"))
    gap = F.col("alpha") - F.col("gamma")
    return s.select("task", F.when(gap > 0, F.round((F.col("beta") - F.col("gamma")) / gap, 5)).alias("share"))


LAYERS = "layers AS (SELECT user_id % 8 AS series, dayofmonth(ts) AS layer, avg(value) AS v FROM events GROUP BY ALL)"


def layers(t):
    return t.events.groupBy((F.col("user_id") % 8).alias("series"), F.dayofmonth("ts").cast("long").alias("layer")).agg(F.avg("value").alias("v"))


@query("q_a30_band_mean", f"+ {LAYERS} SELECTING SELECT series, round(avg(v) FILTER (layer BETWEEN 5 AND 10), 6) AS band, round(avg(v) FILTER (layer BETWEEN 5 AND 10) - avg(v) FILTER (layer BETWEEN 20 AND 25), 6) AS deficit FROM layers GROUP BY ALL")
def a30(t):
    band = lambda a, b: F.avg(F.when(F.col("layer").between(a, b), F.col("v")))
    return rounded(layers(t).groupBy("series").agg(band(5, 10).alias("band"), (band(5, 10) - band(20, 25)).alias("deficit")), "band", "deficit")


@query("q_a31_peak_layer", f"+ {LAYERS} SELECTING SELECT series, arg_max(layer, (v, -layer)) AS peak, round(arg_max(layer, (v, -layer)) / (count(*) - 1)::DOUBLE, 6) AS depth, round(max(v) - min(v), 6) AS spread FROM layers GROUP BY ALL")
def a31(t):
    peak = F.max_by("layer", F.struct("v", -F.col("layer")))
    return rounded(layers(t).groupBy("series").agg(peak.alias("peak"), (peak / (F.count("*") - 1)).alias("depth"), (F.max("v") - F.min("v")).alias("spread")), "depth", "spread")


@query("q_a32_density_ratio", "SELECT p_brand, round(sum(p_size) / (count(*) + 1)::DOUBLE, 6) AS density, round(log10(sum(p_size) / (count(*) + 1)::DOUBLE), 6) AS log_density FROM part GROUP BY ALL ORDER BY density DESC, p_brand LIMIT 4")
def a32(t):
    d = F.sum("p_size") / (F.count("*") + 1)
    out = t.part.groupBy("p_brand").agg(F.round(d, 6).alias("density"), F.round(F.log10(d), 6).alias("log_density"))
    return out.orderBy(F.desc("density"), "p_brand").limit(4)


@query("q_a33_mean_pool", "SELECT label, i - 1 AS pos, round(avg(embedding[i]::DOUBLE), 6) AS v FROM embeddings, range(1, 65) r(i) GROUP BY ALL")
def a33(t):
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    return rounded(cells.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.avg(F.col("x").cast("double")).alias("v")), "v")


@query("q_a35_enrichment", """+ k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY prob DESC, id) AS k, count(*) OVER (PARTITION BY model) AS n FROM preds)
SELECTING SELECT model, round(avg(label::DOUBLE) FILTER (k <= greatest(10, n // 20)) / nullif(avg(label::DOUBLE), 0), 6) AS enrichment FROM k GROUP BY ALL""", "preds")
def a35(t):
    k = r.ranked(t.preds.select("model", "id", "prob", "label"), ["model"], [F.desc("prob"), "id"], "k", total="n")
    y = F.col("label").cast("double")
    top = F.avg(F.when(F.col("k") <= F.greatest(F.lit(10), F.floor(F.col("n") / 20)), y))
    return rounded(k.groupBy("model").agg(m.ratio(top, F.avg(y)).alias("enrichment")), "enrichment")


GRID = """g AS (SELECT model, task, t, avg(-(label * ln(q) + (1 - label) * ln(1 - q))) AS nll FROM (SELECT model, task, label, t, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(ln(c / (1 - c)) / t))))) AS q
 FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, prob)) AS c FROM preds), (SELECT 0.2::DOUBLE + i * ((5.0::DOUBLE - 0.2) / 59) AS t FROM range(60) r(i))) GROUP BY ALL),
tt AS (SELECT model, task, arg_min(t, (round(nll, 9), t)) AS temperature FROM g GROUP BY ALL)"""


@query("q_m13_temperature", f"+ {GRID} SELECTING SELECT model, task, round(temperature, 6) AS temperature FROM tt", "preds")
def m13(t):
    return rounded(m.temperature(t.preds, KEYS), "temperature")


@query("q_a36_score_arm", f"""+ {RANKS}, {CURVE}, {GRID}, s AS (SELECT model, task, label, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(ln(c / (1 - c)) / temperature))))) AS q FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, prob)) AS c FROM preds) JOIN tt USING (model, task)),
eb AS (SELECT model, task, {EDGES_FROM.format(x='q')} AS b, count(*) AS n, abs(avg(q) - avg(label)) AS gap FROM s GROUP BY ALL)
SELECTING SELECT model, task, auroc, aurc, ece10, round(temperature, 6) AS temperature FROM (SELECT model, task, {AUROC} AS auroc FROM r GROUP BY ALL) JOIN (SELECT model, task, round(avg(risk), 6) AS aurc FROM c GROUP BY ALL) USING (model, task)
JOIN (SELECT model, task, round(sum(n * gap) / sum(n), 6) AS ece10 FROM eb GROUP BY ALL) USING (model, task) JOIN tt USING (model, task)""", "preds")
def a36(t):
    p = t.preds
    fit = m.temperature(p, KEYS)
    scaled = p.join(fit, KEYS).withColumn("prob", m.scale(F.col("prob"), F.col("temperature")))
    out = m.auroc(p, KEYS).join(m.aurc(p, KEYS, conf(), F.col("err")), KEYS).join(m.ece_probability(scaled, KEYS, name="ece10"), KEYS).join(fit, KEYS)
    return rounded(out, "auroc", "aurc", "ece10", "temperature")


@query("q_a37_paired_delta", """SELECT a.task, count(*) AS n, round(avg(abs(a.prob - b.prob)), 6) AS mean_abs_delta, round(corr(a.prob, b.prob), 6) AS r FROM preds a JOIN preds b ON a.id = b.id AND a.model = 'alpha' AND b.model = 'gamma' GROUP BY ALL""", "preds")
def a37(t):
    p = t.preds.select("model", "task", "id", "prob")
    a, b = p.where("model = 'alpha'"), p.where("model = 'gamma'").select("id", F.col("prob").alias("other"))
    return rounded(a.join(b, "id").groupBy("task").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("prob") - F.col("other"))).alias("mean_abs_delta"), F.corr("prob", "other").alias("r")), "mean_abs_delta", "r")


@query("q_a38_direction_audit", """SELECT task, round(avg(length(text)) FILTER (label = 1) - avg(length(text)) FILTER (label = 0), 4) AS shift, CASE WHEN avg(length(text)) FILTER (label = 1) > avg(length(text)) FILTER (label = 0) THEN 'OK' ELSE 'FLAG' END AS verdict FROM items GROUP BY ALL""", "items")
def a38(t):
    mean = lambda y: F.avg(F.when(F.col("label") == y, F.length("text").cast("double")))
    return t.items.groupBy("task").agg(F.round(mean(1) - mean(0), 4).alias("shift"), F.when(mean(1) > mean(0), "OK").otherwise("FLAG").alias("verdict"))


@query("q_a39_alert_enrichment", """+ f AS (SELECT label, 'short' AS flag, (length(text) < 500)::INT AS v FROM items UNION ALL SELECT label, 'html', (text LIKE '%<%')::INT FROM items UNION ALL SELECT label, 'mail', (text LIKE '%@%')::INT FROM items)
SELECTING SELECT flag, round(avg(v::DOUBLE) FILTER (label = 1) - avg(v::DOUBLE) FILTER (label = 0), 6) AS enrichment FROM f GROUP BY ALL""", "items")
def a39(t):
    flags = {"short": F.length("text") < 500, "html": F.contains("text", F.lit("<")), "mail": F.contains("text", F.lit("@"))}
    long = t.items.select("label", F.explode(F.array(*[F.struct(F.lit(k).alias("flag"), v.cast("double").alias("v")) for k, v in flags.items()])).alias("f")).select("label", "f.*")
    rate = lambda y: F.avg(F.when(F.col("label") == y, F.col("v")))
    return rounded(long.groupBy("flag").agg((rate(1) - rate(0)).alias("enrichment")), "enrichment")


@query("q_a40_verifier_follow", """SELECT model, (spec_err = 0) AS verdict_correct, round(avg((pred = label)::INT::DOUBLE), 6) AS true_rate, round(avg((pred = (spec_prob > 0.5)::INT)::INT::DOUBLE), 6) AS follow_rate FROM preds GROUP BY ALL""", "preds")
def a40(t):
    out = t.preds.groupBy("model", (F.col("spec_err") == 0).alias("verdict_correct")).agg(
        F.avg((F.col("pred") == F.col("label")).cast("double")).alias("true_rate"), F.avg((F.col("pred") == (F.col("spec_prob") > 0.5).cast("int")).cast("double")).alias("follow_rate")
    )
    return rounded(out, "true_rate", "follow_rate")


@query("q_a41_distinct", "SELECT source, count(*) AS n, count(DISTINCT text) AS n_texts, count(*) - count(DISTINCT text) AS n_copies FROM documents GROUP BY ALL")
def a41(t):
    texts = t.documents.groupBy("source", F.sha2("text", 256)).agg(F.count("*").alias("n"))
    return texts.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"), (F.sum("n") - F.count("*")).alias("n_copies"))


@query("q_brier", "SELECT model, task, round(avg(pow(prob - label, 2)), 6) AS brier FROM preds GROUP BY ALL", "preds")
def brier(t):
    return rounded(t.preds.groupBy(*KEYS).agg(F.avg(F.pow(F.col("prob") - F.col("label"), 2)).alias("brier")), "brier")
