"""Queries of routing policies and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import metrics as m
from plumbline.operators import routing as r
from plumbline.operators import sampling as x
from plumbline.plans.metric_queries import AUROC, RANKS, layers, rounded
from plumbline.plans.registry import query
from plumbline.plans.sampling_queries import REPS, _auc, _drawn

KEYS = ["model", "task"]
THRESHOLDS = """g AS (SELECT p.model, p.task, th, avg(CASE WHEN conf >= th THEN 1.0::DOUBLE - err ELSE 1.0::DOUBLE - spec_err END) AS a, avg((conf < th)::INT::DOUBLE) AS calls FROM preds p JOIN (SELECT DISTINCT model, task, conf AS th FROM preds UNION SELECT DISTINCT model, task, 1.01 FROM preds) t ON p.model = t.model AND p.task = t.task GROUP BY ALL)"""


@query("q_r1_policies", f"""+ {THRESHOLDS}, b AS (SELECT model, task, round(max(round(a, 9)), 6) AS conf_route FROM g GROUP BY ALL) SELECTING SELECT model, task, round(avg(1.0::DOUBLE - err), 6) AS always_model, round(avg(1.0::DOUBLE - spec_err), 6) AS always_spec,
round(avg(CASE route WHEN 'SELF' THEN 1.0::DOUBLE - err ELSE 1.0::DOUBLE - spec_err END), 6) AS own_defer, round(avg(greatest(1.0::DOUBLE - err, 1.0::DOUBLE - spec_err)), 6) AS oracle, min(conf_route) AS conf_route FROM preds JOIN b USING (model, task) GROUP BY ALL""", "preds")
def r1(t):
    return rounded(r.policies(t.preds, KEYS), "always_model", "always_spec", "own_defer", "oracle", "conf_route")


@query("q_r1_threshold", f"+ {THRESHOLDS} SELECTING SELECT model, task, arg_max(th, (round(a, 9), -th)) AS threshold, round(max(round(a, 9)), 6) AS accuracy, round(arg_max(calls, (round(a, 9), -th)), 6) AS calls FROM g GROUP BY ALL", "preds")
def r1b(t):
    return rounded(r.threshold_policy(t.preds, KEYS), "accuracy", "calls")


@query("q_r2_coverage_routing", """+ c AS (SELECT model, task, row_number() OVER w AS k, sum((1.0::DOUBLE - err) - (1.0::DOUBLE - spec_err)) OVER w AS gain FROM preds WINDOW w AS (PARTITION BY model, task ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING) UNION ALL SELECT DISTINCT model, task, 0, 0 FROM preds),
b AS (SELECT model, task, arg_max(k, (gain, -k)) AS k, max(gain) AS gain FROM c GROUP BY ALL) SELECTING SELECT model, task, round(min(k) / count(*)::DOUBLE, 6) AS coverage, round((sum(1.0::DOUBLE - spec_err) + min(gain)) / count(*), 6) AS routed FROM preds JOIN b USING (model, task) GROUP BY ALL""", "preds")
def r2(t):
    return rounded(r.coverage_routing(t.preds, KEYS, [F.desc("conf"), F.col("id")]), "coverage", "routed")


@query("q_r3_group_utility", """+ g AS (SELECT model, grp, avg(1.0::DOUBLE - err) AS m, avg(1.0::DOUBLE - spec_err) AS s, avg((route = 'DEFER')::INT::DOUBLE) AS d FROM preds GROUP BY ALL) SELECTING SELECT model, round(avg(m), 6) AS self, round(avg(s), 6) AS tool, round(avg(CASE WHEN d > 0.5 THEN s ELSE m END), 6) AS routed, round(avg(greatest(m, s)), 6) AS oracle FROM g GROUP BY ALL""", "preds")
def r3(t):
    return rounded(r.group_utility(t.preds, ["model"], "grp"), "self", "tool", "routed", "oracle")


@query("q_r4_reliability_routing", """+ h AS (SELECT model, grp, id % 2 AS half, sum(1.0::DOUBLE - err) AS m, sum(1.0::DOUBLE - spec_err) AS s, count(*) AS n FROM preds GROUP BY ALL),
i AS (SELECT model, sum(greatest(m, s)) / sum(n) AS v FROM (SELECT model, grp, sum(m) AS m, sum(s) AS s, sum(n) AS n FROM h GROUP BY ALL) GROUP BY ALL),
o AS (SELECT a.model, sum(CASE WHEN coalesce(b.m >= b.s, true) THEN a.m ELSE a.s END) / sum(a.n) AS v FROM h a LEFT JOIN h b ON a.model = b.model AND a.grp = b.grp AND a.half = 1 - b.half GROUP BY ALL) SELECTING SELECT model, round(i.v, 6) AS in_sample, round(o.v, 6) AS two_fold FROM i JOIN o USING (model)""", "preds")
def r4(t):
    return rounded(r.reliability_routing(t.preds, ["model"], "grp", F.col("id") % 2), "in_sample", "two_fold")


@query("q_r6_recoverable", """+ u AS (SELECT *, 1 - 2 * abs(prob - 0.5) AS u FROM preds), q AS (SELECT model, quantile_cont(u, 2/3::DOUBLE) AS bar FROM u GROUP BY ALL) SELECTING SELECT model, count(*) AS n, round(avg((err = 1 AND spec_err = 0)::INT::DOUBLE), 6) AS recoverable FROM u JOIN q USING (model) WHERE u >= bar GROUP BY ALL""", "preds")
def r6(t):
    u = t.preds.withColumn("u", 1 - 2 * F.abs(F.col("prob") - 0.5))
    bar = u.groupBy("model").agg(F.percentile("u", F.lit(2 / 3)).alias("bar"))
    high = u.join(F.broadcast(bar), "model").where("u >= bar")
    return rounded(high.groupBy("model").agg(F.count("*").alias("n"), F.avg(((F.col("err") == 1) & (F.col("spec_err") == 0)).cast("double")).alias("recoverable")), "recoverable")


@query("q_r7_tag_abstention", """+ b AS (SELECT model, (web = 'rich')::INT AS c, count(*) AS n, sum(err) AS e FROM preds GROUP BY ALL), bb AS (SELECT *, sum(n) OVER w - n AS n0, sum(e) OVER w - e AS e0 FROM b WINDOW w AS (PARTITION BY model ORDER BY c DESC ROWS UNBOUNDED PRECEDING)),
x AS (SELECT model, (e0 + e * j / n::DOUBLE) / (n0 + j) AS risk FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM bb)) SELECTING SELECT model, round(avg(risk), 6) AS aurc FROM x GROUP BY ALL""", "preds")
def r7(t):
    return rounded(m.aurc_expected(t.preds, ["model"], (F.col("web") == "rich").cast("int"), F.col("err")), "aurc")


@query("q_r8_tag_vs_confidence", """+ c AS (SELECT model, avg(err::DOUBLE) OVER (PARTITION BY model ORDER BY (web = 'rich')::INT DESC, conf DESC, id ROWS UNBOUNDED PRECEDING) AS a, avg(err::DOUBLE) OVER (PARTITION BY model ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING) AS b FROM preds) SELECTING SELECT model, round(avg(a), 6) AS tag_first, round(avg(b), 6) AS confidence FROM c GROUP BY ALL""", "preds")
def r8(t):
    p = t.preds
    order = [F.desc(F.col("web") == "rich"), F.desc("conf"), F.col("id")]
    a = m.risk_curve(p, ["model"], order, F.col("err")).groupBy("model").agg(F.avg("risk").alias("tag_first"))
    return rounded(a.join(m.aurc(p, ["model"], F.col("conf"), F.col("err"), name="confidence"), "model"), "tag_first", "confidence")


GAPS = f"""{RANKS}, s AS (SELECT model, task, {AUROC.replace(', 6)', ', 15)')} AS a FROM r GROUP BY ALL),
r2 AS (SELECT model, task, label, rank() OVER (PARTITION BY model, task ORDER BY spec_prob) + (count(*) OVER (PARTITION BY model, task, spec_prob) - 1) / 2.0::DOUBLE AS r FROM preds), s2 AS (SELECT model, task, {AUROC.replace(', 6)', ', 15)')} AS c FROM r2 GROUP BY ALL), gaps AS (SELECT model, task, 0.99 - c AS enc, c - a AS exp FROM s JOIN s2 USING (model, task))"""


def gaps(t):
    p = t.preds
    both = m.auroc(p, KEYS).join(m.auroc(p, KEYS, "spec_prob", name="c"), KEYS)
    return both.select(*KEYS, (0.99 - F.col("c")).alias("enc"), (F.col("c") - F.col("auroc")).alias("exp"))


@query("q_r9_placement", f"""+ {GAPS} SELECTING SELECT model, task, CASE WHEN enc > 0.1 AND exp > 0.1 THEN 'specialist' WHEN enc > 0.1 THEN 'encoder' WHEN exp > 0.1 THEN 'bridge' WHEN exp < -0.1 THEN 'check labels' ELSE 'model' END AS placement FROM gaps""", "preds")
def r9(t):
    return gaps(t).select(*KEYS, r.placement(F.col("enc"), F.col("exp")).alias("placement"))


@query("q_r10_layer_hypotheses", "+ layers AS (SELECT user_id % 8 AS series, dayofmonth(ts) AS layer, avg(value) AS v FROM events GROUP BY ALL), f AS (SELECT max(v) AS floor_ FROM layers WHERE series = 0) SELECTING SELECT series, CASE WHEN max(v) < min(floor_) THEN 'H1' WHEN max(v) - avg(v) > 30 THEN 'H2' ELSE 'H3' END AS hypothesis FROM layers, f GROUP BY ALL")
def r10(t):
    base = layers(t)
    floor = base.where("series = 0").agg(F.max("v").alias("floor"))
    rules = [(F.max("v") < F.min("floor"), "H1"), (F.max("v") - F.avg("v") > 30, "H2")]
    return base.join(F.broadcast(floor)).groupBy("series").agg(r.first_match(rules, "H3").alias("hypothesis"))


@query("q_r11_property_specificity", f"+ {GAPS} SELECTING SELECT model, CASE WHEN min(exp) > 0.05 THEN 'general' WHEN max(exp) > 0.05 THEN 'specific' ELSE 'absent' END AS verdict FROM gaps GROUP BY ALL", "preds")
def r11(t):
    rules = [(F.min("exp") > 0.05, "general"), (F.max("exp") > 0.05, "specific")]
    return gaps(t).groupBy("model").agg(r.first_match(rules, "absent").alias("verdict"))


@query("q_r12_regime", f"+ {GAPS} SELECTING SELECT model, task, CASE WHEN enc > exp THEN 'encoding' ELSE 'expression' END AS regime, exp <= 0.3 * (enc + exp) AS closes FROM gaps", "preds")
def r12(t):
    g = gaps(t)
    return g.select(*KEYS, F.when(F.col("enc") > F.col("exp"), "encoding").otherwise("expression").alias("regime"), (F.col("exp") <= 0.3 * (F.col("enc") + F.col("exp"))).alias("closes"))


@query("q_r13_interval_verdict", f"+ {_drawn('id', '13')}, {_auc('prob', 'id', 'a')}, ci AS (SELECT model, task, quantile_cont(auroc, 0.025) AS lo, quantile_cont(auroc, 0.975) AS hi FROM a GROUP BY ALL) SELECTING SELECT model, task, CASE WHEN 0.8 BETWEEN lo AND hi THEN 'inside' ELSE 'outside' END AS verdict FROM ci", "preds")
def r13(t):
    ci = x.interval(x.bootstrap_auroc(t.preds, KEYS, REPS, 13), KEYS, "auroc")
    return ci.select(*KEYS, r.within(F.lit(0.8), F.col("lo"), F.col("hi")).alias("verdict"))


@query("q_r14_covariate_flags", "SELECT model, task, avg((prob >= 1.0)::INT::DOUBLE) >= 0.8 AS ceiling_effect, abs(corr(prob, spec_prob)) > 0.7 AS collinear FROM preds GROUP BY ALL", "preds")
def r14(t):
    return r.covariate_flags(t.preds, KEYS, "prob", "spec_prob")


@query("q_r15_within_entity_contrast", f"""+ {RANKS.replace('PARTITION BY model, task', 'PARTITION BY model, kind').replace('SELECT model, task', 'SELECT model, kind, conf, route')} SELECTING SELECT model, max(a) FILTER (kind = 'parsed') AS parsed_auroc, max(a) FILTER (kind = 'fallback') AS fallback_auroc, max(c) FILTER (kind = 'parsed') AS parsed_conf, max(c) FILTER (kind = 'fallback') AS fallback_conf, max(d) FILTER (kind = 'parsed') AS parsed_defer, max(d) FILTER (kind = 'fallback') AS fallback_defer
FROM (SELECT model, kind, {AUROC} AS a, round(avg(conf), 6) AS c, round(avg((route = 'DEFER')::INT::DOUBLE), 6) AS d FROM r GROUP BY ALL) GROUP BY model""", "preds")
def r15(t):
    p = t.preds
    sums = p.groupBy("model", "kind").agg(F.round(F.avg("conf"), 6).alias("conf"), F.round(F.avg((F.col("route") == "DEFER").cast("double")), 6).alias("defer"))
    both = rounded(m.auroc(p, ["model", "kind"]), "auroc").join(sums, ["model", "kind"])
    return both.groupBy("model").pivot("kind", ["parsed", "fallback"]).agg(*[F.max(c).alias(c) for c in ("auroc", "conf", "defer")])


@query("q_r16_budget_sweep", """+ o AS (SELECT model, err, row_number() OVER (PARTITION BY model ORDER BY md5('s:' || id), id) AS rn FROM preds), b AS (SELECT model, budget, avg(1.0::DOUBLE - err) AS acc FROM o, (VALUES (50), (100), (200)) v(budget) WHERE rn <= budget GROUP BY ALL)
SELECTING SELECT model, round(min(acc), 6) AS worst, round(max(acc), 6) AS best, bool_and(acc > 0.5) AS all_confirm FROM b GROUP BY ALL""", "preds")
def r16(t):
    from plumbline.functions.hashing import shuffle_key
    from plumbline.operators.relational import ranked

    n = ranked(t.preds.withColumn("h", shuffle_key("s", F.col("id"))), ["model"], ["h", "id"], "rn").where("rn <= 200")
    at = n.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in (50, 100, 200)]))).where("rn <= budget")
    acc = at.groupBy("model", "budget").agg(F.avg(1.0 - F.col("err")).alias("acc"))
    return rounded(acc.groupBy("model").agg(F.min("acc").alias("worst"), F.max("acc").alias("best"), F.bool_and(F.col("acc") > 0.5).alias("all_confirm")), "worst", "best")
