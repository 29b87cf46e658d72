"""Queries of filters, joins, set operations, windows and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.hashing import md5_number, shuffle_key
from plumbline.operators import neighbors
from plumbline.operators import relational as r
from plumbline.plans.metric_queries import rounded
from plumbline.plans.registry import query

MD5 = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query("q_p1_orientation_flip", "SELECT model, task, avg(CASE WHEN task IN ('de', 'es') THEN 1 - label ELSE label END)::DECIMAL(18, 6)::DOUBLE AS rate FROM preds GROUP BY ALL", "preds")
def p1(t):
    return rounded(t.preds.groupBy("model", "task").agg(F.avg(F.when(F.col("task").isin("de", "es"), 1 - F.col("label")).otherwise(F.col("label"))).alias("rate")), "rate")


@query("q_p2_significance_class", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')")
def p2(t):
    return r.classed(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"], ["5-LOW"]).select("o_orderkey", "label")


@query("q_p3_status_stars", """SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 4 WHEN o_orderpriority = '2-HIGH' THEN 3 WHEN starts_with(o_orderpriority, '3') THEN 2 WHEN starts_with(o_orderpriority, '4') THEN 1 ELSE 0 END AS stars FROM orders) WHERE stars >= 2""")
def p3(t):
    return r.stars(t.orders, "o_orderpriority", {"1-URGENT": 4, "2-HIGH": 3}, {"3": 2, "4": 1}, least=2).select("o_orderkey", "stars")


@query("q_p4_pattern_parse", """SELECT c_custkey, regexp_extract(c_name, '^Customer#0*([1-9][0-9]*)$', 1)::BIGINT AS number FROM customer WHERE regexp_matches(c_name, '^Customer#0*([1-9][0-9]*)$')""")
def p4(t):
    pattern = r"^Customer#0*([1-9][0-9]*)$"
    return t.customer.where(F.col("c_name").rlike(pattern)).select("c_custkey", F.regexp_extract("c_name", pattern, 1).cast("bigint").alias("number"))


@query("q_p5_single_value", "SELECT doc_id FROM documents WHERE text <> '' AND text <> '-' AND text NOT LIKE '%;%'")
def p5(t):
    text = F.col("text")
    return t.documents.where((text != "") & (text != "-") & ~text.contains(";")).select("doc_id")


@query("q_p6_first_seen", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def p6(t):
    return r.first_seen(t.lineitem, ["l_partkey"], ["l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("q_p7_consistency_counts", """SELECT count_if(substr(text, 5, 1) = 'e')::BIGINT AS consistent, count_if(length(text) < 5)::BIGINT AS too_short, count_if(length(text) >= 5 AND substr(text, 5, 1) <> 'e')::BIGINT AS mismatch FROM documents""")
def p7(t):
    at = F.substring("text", 5, 1)
    return t.documents.agg(
        F.count_if(at == "e").alias("consistent"), F.count_if(F.length("text") < 5).alias("too_short"), F.count_if((F.length("text") >= 5) & (at != "e")).alias("mismatch")
    )


@query("q_p8_single_mutant", "SELECT p_partkey, regexp_extract(p_brand, '^([A-Z])([a-z]+)#([0-9])([0-9])$', 3) AS maker FROM part WHERE regexp_matches(p_brand, '^([A-Z])([a-z]+)#([0-9])([0-9])$') AND p_brand NOT LIKE '%:%'")
def p8(t):
    pattern = "^([A-Z])([a-z]+)#([0-9])([0-9])$"
    return t.part.where(F.col("p_brand").rlike(pattern) & ~F.col("p_brand").contains(":")).select("p_partkey", F.regexp_extract("p_brand", pattern, 3).alias("maker"))


@query("q_p9_length_alphabet", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 200 AND 5000 AND regexp_full_match(text, '[A-Za-z ,.\n]+')")
def p9(t):
    return t.documents.where(F.length("text").between(200, 5000) & F.col("text").rlike("^[A-Za-z ,.\n]+\\z")).select("doc_id")


@query("q_p10_id_split", """SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(split_part(url, '://', 2), '/', 2) AS lang FROM pages WHERE length(split_part(split_part(url, '://', 2), '/', 2)) = 2""")
def p10(t):
    parts = F.split(F.get(F.split("url", "://"), 1), "/")
    return t.pages.select("page_id", F.get(parts, 0).alias("host"), F.get(parts, 1).alias("lang")).where(F.length("lang") == 2)


@query("q_p11_median_binarize", """+ mm AS (SELECT event_type, quantile_cont(value, 0.5) AS med, avg(value) AS mean FROM events GROUP BY ALL), x AS (SELECT e.event_type, event_id, value, med, mean FROM events e JOIN mm USING (event_type)),
k AS (SELECT event_type, count(DISTINCT value > med) AS c, count(DISTINCT value > mean) AS c2 FROM x GROUP BY ALL)
SELECTING SELECT event_type, sum((CASE WHEN c = 2 THEN value > med ELSE value > mean END)::INT)::BIGINT AS positives, count(*) AS n FROM x JOIN k USING (event_type) WHERE c = 2 OR c2 = 2 GROUP BY ALL""")
def p11(t):
    out = r.median_binarized(t.events, ["event_type"], "value")
    return out.groupBy("event_type").agg(F.sum("label").alias("positives"), F.count("*").alias("n"))


@query("q_p12_tercile_split", """+ q AS (SELECT event_type, quantile_cont(value, 1/3::DOUBLE) AS a, quantile_cont(value, 2/3::DOUBLE) AS b FROM events GROUP BY ALL)
SELECTING SELECT event_type, (value >= b)::INT AS label, count(*) AS n FROM events JOIN q USING (event_type) WHERE value <= a OR value >= b GROUP BY ALL""")
def p12(t):
    return r.tercile_split(t.events, ["event_type"], "value").groupBy("event_type", "label").agg(F.count("*").alias("n"))


@query("q_p13_keep_mask", "SELECT count(*) AS kept FROM embeddings WHERE len(list_filter(embedding, lambda x: isnan(x))) = 0")
def p13(t):
    return t.embeddings.where(F.forall("embedding", lambda x: ~F.isnan(x))).agg(F.count("*").alias("kept"))


@query("q_p14_minimum_support", "SELECT grp, count(*) AS n FROM items GROUP BY grp HAVING count(*) >= 15 AND count(DISTINCT toxic) = 2", "items")
def p14(t):
    g = t.items.groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("toxic").alias("k"))
    return g.where("n >= 15 AND k = 2").select("grp", "n")


STRATA = {"ALL": "true", "long": "length(text) > 1000", "rich": "web = 'rich'", "long_rich": "length(text) > 1000 AND web = 'rich'"}


@query("q_p15_strata", " UNION ALL ".join(f"SELECT '{k}' AS stratum, count(*) AS n, round(avg(label::DOUBLE), 6) AS rate FROM items WHERE {v}" for k, v in STRATA.items()), "items")
def p15(t):
    return rounded(r.in_strata(t.items, STRATA).groupBy("stratum").agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("rate")), "rate")


@query("q_p16_answered_only", "SELECT model, task, count(*) AS n, round(avg(prob), 6) AS mean_prob FROM preds WHERE kind = 'parsed' GROUP BY ALL HAVING count(*) >= 20 AND count(DISTINCT label) = 2", "preds")
def p16(t):
    g = t.preds.where("kind = 'parsed'").groupBy("model", "task").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("mean_prob"), F.count_distinct("label").alias("k"))
    return g.where("n >= 20 AND k = 2").drop("k")


@query("q_p17_overconfident", "SELECT model, task, round(avg(conf), 6) AS conf, avg(conf) > 0.3 AND avg(1.0 - err) < 0.9 AND task <> 'en' AS flagged FROM preds GROUP BY model, task", "preds")
def p17(t):
    flag = (F.avg("conf") > 0.3) & (F.avg(1.0 - F.col("err")) < 0.9) & (F.col("task") != "en")
    return t.preds.groupBy("model", "task").agg(F.round(F.avg("conf"), 6).alias("conf"), flag.alias("flagged"))


@query("q_p18_low_familiarity", "SELECT l_partkey AS id, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT ps.l_partkey FROM lineitem ps GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50) GROUP BY ALL HAVING count(*) > 30")
def p18(t):
    famous = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(50)
    return t.lineitem.join(famous, "l_partkey", "left_anti").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n")).where("n > 30")


@query("q_p19_marker_drop", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, '^(a|b|MT-)') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.1 AND l_quantity > 45)")
def p19(t):
    used = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    famous = t.lineitem.where("l_discount = 0.1D AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.where(~F.col("p_name").rlike("^(a|b|MT-)")).join(used, "p_partkey", "left_semi").join(famous, "p_partkey", "left_anti").select("p_partkey")


@query("q_p20_modality", """SELECT page_id, coalesce(CASE WHEN regexp_matches(url, '^https') THEN 'secure' END, CASE split_part(split_part(url, '://', 2), '.', 1) WHEN 'blog' THEN 'weblog' WHEN 'm' THEN 'mobile' END, split_part(split_part(url, '://', 2), '.', 1)) AS modality FROM pages""")
def p20(t):
    head = F.get(F.split(F.get(F.split("url", "://"), 1), r"\."), 0)
    kind = F.when(F.col("url").rlike("^https"), "secure")
    named = F.create_map(*[F.lit(x) for x in ("blog", "weblog", "m", "mobile")])
    return t.pages.select("page_id", F.coalesce(kind, F.try_element_at(named, head), head).alias("modality"))


# ---- joins ------------------------------------------------------------------------------------------------------


@query("q_j1_three_way", """SELECT l_orderkey, o_custkey, c_name, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R'""")
def j1(t):
    results = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_quantity")
    assays = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return results.join(assays, "l_orderkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("l_orderkey", "o_custkey", "c_name", "l_quantity")


@query("q_j2_model_and_specialist", "SELECT model, task, count(*) AS n, round(avg((err = 0 AND spec_err = 1)::INT::DOUBLE), 6) AS only_model FROM preds WHERE kind = 'parsed' GROUP BY ALL", "preds")
def j2(t):
    p = t.preds
    spec = p.where("model = 'alpha'").select("task", "id", F.col("spec_err").alias("s_err"))
    both = p.where("kind = 'parsed'").join(spec, ["task", "id"])
    return rounded(both.groupBy("model", "task").agg(F.count("*").alias("n"), F.avg(((F.col("err") == 0) & (F.col("s_err") == 1)).cast("double")).alias("only_model")), "only_model")


@query("q_j3_confidence_default", "SELECT p.model, p.id, coalesce(c.conf, 0.5) AS conf FROM preds p LEFT JOIN (SELECT model, id, conf FROM preds WHERE kind = 'parsed') c ON p.model = c.model AND p.id = c.id", "preds")
def j3(t):
    p = t.preds
    return r.left_default(p.select("model", "id"), p.where("kind = 'parsed'").select("model", "id", "conf"), ["model", "id"], {"conf": 0.5})


@query("q_j4_first_matching", """SELECT c_custkey, arg_min(s_suppkey, s_suppkey) AS s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal GROUP BY c_custkey""")
def j4(t):
    return r.least_above(t.customer, "c_custkey", "c_nationkey", "c_acctbal", t.supplier, "s_suppkey", "s_nationkey", "s_acctbal")


@query("q_j5_attach_score", """SELECT p_partkey, p_size, max(l_extendedprice) AS score FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_linenumber = p_size % 7 WHERE p_size <= 20 GROUP BY ALL""")
def j5(t):
    wanted = t.part.where("p_size <= 20").select("p_partkey", "p_size", (F.col("p_size") % 7).alias("line"))
    scores = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("line"), "l_extendedprice")
    best = scores.join(wanted, ["p_partkey", "line"], "left_semi").groupBy("p_partkey", "line").agg(F.max("l_extendedprice").alias("score"))
    return wanted.join(best, ["p_partkey", "line"], "left").select("p_partkey", "p_size", "score")


@query("q_j6_snapshot_membership", """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1994-01-01') THEN 'old' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1996-01-01') THEN 'new' ELSE 'later' END AS first_seen FROM customer""")
def j6(t):
    seen = lambda day: t.orders.where(F.col("o_orderdate") < F.to_timestamp(F.lit(day))).select(F.col("o_custkey").alias("id"))
    return r.first_release(t.customer.select(F.col("c_custkey").alias("id")), {"old": seen("1994-01-01"), "new": seen("1996-01-01")}, "later").withColumnRenamed("id", "c_custkey")


@query("q_j7_name_map", "SELECT s_suppkey, coalesce(n_name, '') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def j7(t):
    names = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return r.left_default(t.supplier.select("s_suppkey", "s_nationkey"), names, ["s_nationkey"], {"nation": ""}).select("s_suppkey", "nation")


@query("q_j8_align_arms", """SELECT a.id, a.prob AS a, b.prob AS b, c.prob AS c FROM preds a JOIN preds b ON a.id = b.id AND b.model = 'beta' AND b.kind = 'parsed' LEFT JOIN preds c ON a.id = c.id AND c.model = 'gamma' AND c.kind = 'parsed' WHERE a.model = 'alpha' AND a.kind = 'parsed'""", "preds")
def j8(t):
    arm = lambda m, n: t.preds.where((F.col("model") == m) & (F.col("kind") == "parsed")).select("id", F.col("prob").alias(n))
    return arm("alpha", "a").join(arm("beta", "b"), "id").join(arm("gamma", "c"), "id", "left")


@query("q_j10_alignment_check", "SELECT count(*) AS n, count_if(a.label <> b.label)::BIGINT AS mismatches FROM preds a JOIN preds b ON a.id = b.id WHERE a.model = 'alpha' AND b.model = 'beta'", "preds")
def j10(t):
    p = t.preds
    both = p.where("model = 'alpha'").select("id", "label").join(p.where("model = 'beta'").select("id", F.col("label").alias("other")), "id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("other")).alias("mismatches"))


@query("q_j12_ceiling_lookup", "SELECT DISTINCT task, coalesce(v.c, 0.9::DOUBLE) AS ceiling FROM items LEFT JOIN (VALUES ('en', 0.95::DOUBLE), ('fr', 0.85)) v(k, c) ON v.k = task", "items")
def j12(t):
    known = t.spark.createDataFrame([("en", 0.95), ("fr", 0.85)], "task string, ceiling double")
    return r.left_default(t.items.select("task").distinct(), known, ["task"], {"ceiling": 0.9})


TRI = """g AS (SELECT p_partkey AS id, p_type AS grp, p_size % 2 AS label, list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))) AS bits FROM part),
k AS (SELECT q.id AS q, q.grp, p.id AS p, p.label, len(list_intersect(q.bits, p.bits)) / len(list_distinct(list_concat(q.bits, p.bits)))::DOUBLE AS sim
 FROM g q JOIN g p ON q.grp <> p.grp WHERE q.id % 20 = 0 AND len(list_intersect(q.bits, p.bits)) > 0)"""


@query("q_j13_knn", f"+ {TRI} SELECTING SELECT q AS id, p AS neighbor, round(sim, 6) AS sim, k FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, p) AS k FROM k) WHERE k <= 5")
def j13(t):
    g = trigrams(t)
    return rounded(neighbors.nearest(g.where("id % 20 = 0"), g, 5, apart="grp").select("id", "neighbor", "sim", "k"), "sim")


def trigrams(t):
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("p_name") - 2), lambda i: F.substr("p_name", i, F.lit(3))))
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("grp"), (F.col("p_size") % 2).alias("label"), grams.alias("bits"))


@query("q_a27_neighbor_label", f"+ {TRI} SELECTING SELECT q AS id, round(avg(label::DOUBLE), 6) AS mean_label, round(greatest(sum(label), count(*) - sum(label)) / count(*)::DOUBLE, 6) AS purity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, p) AS k FROM k) WHERE k <= 5 GROUP BY q")
def a27(t):
    g = trigrams(t)
    return rounded(r.neighbor_votes(neighbors.nearest(g.where("id % 20 = 0"), g, 5, apart="grp")), "mean_label", "purity")


@query("q_j14_novel", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_shipdate >= DATE '1998-06-01' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < DATE '1993-01-01')")
def j14(t):
    parts = t.lineitem.select(F.col("l_partkey").alias("id"), "l_shipdate")
    return r.novel(parts.where("l_shipdate >= '1998-06-01'").select("id"), parts.where("l_shipdate < '1993-01-01'").select("id"), ["id"])


@query("q_j15_held_out_split", f"SELECT CASE WHEN {MD5.format(chr(39) + 'test:' + chr(39) + ' || id')} % 5 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(label)::BIGINT AS positives FROM items GROUP BY ALL", "items")
def j15(t):
    items = t.items
    test = items.where(F.pmod(md5_number("test", F.col("id")), F.lit(5)) == 0).select("id")
    inside, outside = items.join(test, "id", "left_semi"), items.join(test, "id", "left_anti")
    both = inside.withColumn("part", F.lit("test")).unionByName(outside.withColumn("part", F.lit("train")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


@query("q_j16_score_table_mean", "SELECT o_orderkey, round(avg(l_discount), 6) AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'A' WHERE o_orderstatus = 'F' GROUP BY ALL")
def j16(t):
    scores = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), "l_discount")
    return rounded(t.orders.where("o_orderstatus = 'F'").join(scores, "o_orderkey").groupBy("o_orderkey").agg(F.avg("l_discount").alias("score")), "score")


@query("q_j17_opposite_partner", """+ k AS (SELECT id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY id) - 1 AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM items)
SELECTING SELECT a.id, b.id AS partner FROM k a JOIN k b ON a.toxic <> b.toxic AND a.rn % b.n = b.rn""", "items")
def j17(t):
    return r.opposite_partner(t.items.select("id", "toxic"), "id", "toxic")


@query("q_j18_derangement", """+ o AS (SELECT id, md5('7:' || id) AS h FROM items) SELECTING SELECT id, coalesce(lead(id) OVER (ORDER BY h, id), first_value(id) OVER (ORDER BY h, id)) AS other FROM o""", "items")
def j18(t):
    return r.derangement(t.items.select("id"), "id", 7)


@query("q_j19_coverage_map", """+ a AS (SELECT task, avg(prob) AS v FROM preds WHERE model = 'alpha' AND task IN ('en', 'fr') GROUP BY ALL), b AS (SELECT task, avg(prob) AS v FROM preds WHERE model = 'beta' AND task IN ('en', 'de') GROUP BY ALL)
SELECTING SELECT task, round(coalesce(a.v, b.v), 6) AS solo, CASE WHEN a.v IS NOT NULL THEN 'first' WHEN b.v IS NOT NULL THEN 'second' ELSE 'to run' END AS status FROM (SELECT DISTINCT task FROM items) LEFT JOIN a USING (task) LEFT JOIN b USING (task)""", "preds")
def j19(t):
    source = lambda m, tasks: t.preds.where((F.col("model") == m) & F.col("task").isin(tasks)).groupBy("task").agg(F.avg("prob").alias(m))
    wide = t.items.select("task").distinct().join(source("alpha", ["en", "fr"]), "task", "left").join(source("beta", ["en", "de"]), "task", "left")
    status = F.when(F.col("alpha").isNotNull(), "first").when(F.col("beta").isNotNull(), "second").otherwise("to run")
    return wide.select("task", F.round(F.coalesce("alpha", "beta"), 6).alias("solo"), status.alias("status"))


# ---- sets -------------------------------------------------------------------------------------------------------


@query("q_u1_concat", "SELECT kind, count(*) AS n FROM (SELECT 'customer' AS kind, c_nationkey FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY ALL")
def u1(t):
    a, b = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k")), t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("k"))
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"))


@query("q_u2_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def u2(t):
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(t.orders.select("o_custkey"))


@query("q_u3_intersection", "SELECT id FROM preds WHERE model = 'alpha' AND route = 'SELF' INTERSECT SELECT id FROM preds WHERE model = 'beta' AND route = 'SELF'", "preds")
def u3(t):
    self_routed = lambda m: t.preds.where((F.col("model") == m) & (F.col("route") == "SELF")).select("id")
    return self_routed("alpha").intersect(self_routed("beta"))


@query("q_u4_ordered_distinct", "SELECT l_suppkey AS id, min((l_orderkey, l_linenumber))[1] AS batch FROM lineitem GROUP BY ALL")
def u4(t):
    return r.first_seen(t.lineitem, ["l_suppkey"], ["l_orderkey", "l_linenumber"]).select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("batch"))


@query("q_u5_replace_by_key", """SELECT id, prob FROM preds WHERE model = 'beta' UNION ALL SELECT id, prob FROM preds WHERE model = 'alpha' AND id NOT IN (SELECT id FROM preds WHERE model = 'beta' AND kind = 'parsed') AND false
UNION ALL SELECT id, prob FROM preds WHERE false""", "preds")
def u5(t):
    p = t.preds
    return r.upsert(p.where("model = 'alpha'").select("id", "prob"), p.where("model = 'beta'").select("id", "prob"), ["id"])


# ---- windows and sorts ------------------------------------------------------------------------------------------


@query("q_w1_cumulative_mean", "SELECT event_type, event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9::DOUBLE, 6) AS running FROM events")
def w1(t):
    upto = r.ranked(t.events.select("event_type", "event_id", "ts", "value"), ["event_type"], ["ts", "event_id"], "k", sums={"_sum": F.col("value")})
    return upto.select("event_type", "event_id", F.round(F.col("_sum") / F.col("k") + 1e-9, 6).alias("running"))


@query("q_w2_tag_then_confidence", "SELECT model, id, row_number() OVER (PARTITION BY model ORDER BY (web = 'rich') DESC, conf DESC, id) AS k FROM preds", "preds")
def w2(t):
    rows = t.preds.select("model", "id", "conf", (F.col("web") == "rich").alias("rich"))
    return r.ranked(rows, ["model"], [F.desc("rich"), F.desc("conf"), "id"], "k").select("model", "id", "k")


@query("q_w3_top_k", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY k) AS top FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3 GROUP BY ALL")
def w3(t):
    top = r.top_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return top.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderkey"))), lambda s: s["o_orderkey"].cast("string")), " ").alias("top"))


@query("q_w4_group_cap", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(l_discount - 0.05) DESC, l_orderkey, l_linenumber) <= 3")
def w4(t):
    return r.top_per_group(t.lineitem, ["l_suppkey"], [F.desc(F.abs(F.col("l_discount") - 0.05)), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("q_w5_minimum_row", "SELECT l_partkey, arg_min(l_orderkey, (l_extendedprice, l_orderkey)) AS l_orderkey FROM lineitem GROUP BY ALL")
def w5(t):
    return t.lineitem.groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("l_orderkey"))


@query("q_w6_systematic_sample", "+ o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECTING SELECT o_orderkey, i FROM o JOIN (SELECT i FROM range(100) r(i)) ON rn - 1 = floor(i * (n / 100::DOUBLE))")
def w6(t):
    return r.systematic(t.orders, ["o_totalprice", "o_orderkey"], 100).select("o_orderkey", "i")


@query("q_w7_linspace_picks", "+ o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECTING SELECT o_orderkey, i FROM o JOIN (SELECT i FROM range(9) r(i)) ON rn - 1 = floor(i * (n - 1) / 8::DOUBLE)")
def w7(t):
    return r.systematic(t.orders, ["o_totalprice", "o_orderkey"], 9, ends=True).select("o_orderkey", "i")


@query("q_w10_anonymize_tokens", "SELECT n_name, 'feat_' || dense_rank() OVER (ORDER BY n_name) AS feat, n_customers FROM (SELECT n_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY ALL)")
def w10(t):
    used = t.customer.where("c_acctbal > 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
    return r.anonymized(used, "n_name", "feat").groupBy("n_name", "feat").agg(F.count("*").alias("n_customers"))


@query("q_w11_section_id", """+ w AS (SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM conversations)
SELECTING SELECT conv_id, turn, section FROM w""")
def w11(t):
    return r.sections(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "section")


@query("q_o2_top_m_within_budget", "+ o AS (SELECT id, spec_prob, row_number() OVER (ORDER BY md5('b:' || id), id) AS rn FROM preds WHERE model = 'alpha') SELECTING SELECT budget, id, k FROM (SELECT budget, id, row_number() OVER (PARTITION BY budget ORDER BY spec_prob DESC, id) AS k FROM o, (VALUES (50), (100), (200)) v(budget) WHERE rn <= budget) WHERE k <= 10", "preds")
def o2(t):
    p = t.preds.where("model = 'alpha'").select("id", "spec_prob")
    return r.best_within_budgets(p, shuffle_key("b", F.col("id")), "spec_prob", [50, 100, 200], 10)


@query("q_o3_shuffled_head", "SELECT doc_id FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 25")
def o3(t):
    return t.documents.select("doc_id").orderBy(shuffle_key(3, F.col("doc_id")), "doc_id").limit(25)


@query("q_o4_model_order", "SELECT DISTINCT model, CASE model WHEN 'gamma' THEN 0 WHEN 'alpha' THEN 1 ELSE 2 END AS place FROM preds", "preds")
def o4(t):
    place = F.when(F.col("model") == "gamma", 0).when(F.col("model") == "alpha", 1).otherwise(2)
    return t.preds.select("model", place.alias("place")).distinct().orderBy("place")


@query("q_o5_threshold_argmax", """+ g AS (SELECT model, th, avg(CASE WHEN conf >= th THEN 1.0::DOUBLE - err ELSE 1.0::DOUBLE - spec_err END) AS acc FROM preds, (SELECT i / 20::DOUBLE AS th FROM range(21) r(i)) GROUP BY ALL)
SELECTING SELECT model, arg_max(th, (round(acc, 9), -th)) AS threshold, round(max(acc), 6) AS accuracy FROM g GROUP BY ALL""", "preds")
def o5(t):
    grid = t.preds.withColumn("th", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: i / 20)))
    acc = grid.groupBy("model", "th").agg(F.avg(F.when(F.col("conf") >= F.col("th"), 1.0 - F.col("err")).otherwise(1.0 - F.col("spec_err"))).alias("acc"))
    return acc.groupBy("model").agg(F.max_by("th", F.struct(F.round("acc", 9), -F.col("th"))).alias("threshold"), F.round(F.max("acc"), 6).alias("accuracy"))


@query("q_o6_extremes", """(SELECT 'low positive' AS side, model, id, prob FROM preds WHERE label = 1 QUALIFY row_number() OVER (PARTITION BY model ORDER BY prob, id) <= 5) UNION ALL (SELECT 'high negative', model, id, prob FROM preds WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY model ORDER BY prob DESC, id) <= 5)""", "preds")
def o6(t):
    p = t.preds
    low = r.top_per_group(p.where("label = 1"), ["model"], [F.asc("prob"), F.col("id")], 5).withColumn("side", F.lit("low positive"))
    high = r.top_per_group(p.where("label = 0"), ["model"], [F.desc("prob"), F.col("id")], 5).withColumn("side", F.lit("high negative"))
    return low.unionByName(high).select("side", "model", "id", "prob")


@query("q_o7_quantile_cut", "SELECT event_id, value FROM events WHERE value > (SELECT quantile_cont(value, 0.9) FROM events)")
def o7(t):
    bar = r.percentiles(t.events, [], "value", [0.9], "p").select(F.col("p")[0].alias("bar"))
    return t.events.join(F.broadcast(bar), F.col("value") > F.col("bar")).select("event_id", "value")


@query("q_a34_diversity", f"+ {TRI.split('),' + chr(10))[0]}), p AS (SELECT id, bits FROM g ORDER BY md5('d:' || id), id LIMIT 500) SELECTING SELECT round(1 - avg(len(list_intersect(a.bits, b.bits)) / len(list_distinct(list_concat(a.bits, b.bits)))::DOUBLE), 6) AS diversity FROM p a JOIN p b ON a.id < b.id")
def a34(t):
    return rounded(r.diversity(trigrams(t), shuffle_key("d", F.col("id")), 500), "diversity")


@query("q_a24_set_recall", "+ x AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS truth, list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'F')) AS said FROM orders GROUP BY ALL) SELECTING SELECT o_custkey, round(len(list_intersect(coalesce(said, []), truth)) / len(truth)::DOUBLE, 6) AS recall FROM x")
def a24(t):
    sets = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("truth"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("said"))
    return rounded(sets.select("o_custkey", (F.size(F.array_intersect("said", "truth")) / F.size("truth")).alias("recall")), "recall")


