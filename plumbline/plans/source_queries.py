"""Queries of sources, sinks, solvers and streams: tables written in a format and read again."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.evaluate import asked, evaluate
from plumbline.functions import parsing
from plumbline.operators import heads
from plumbline.operators import metrics as m
from plumbline.operators import pictures, solver
from plumbline.plans.metric_queries import AUROC, RANKS, rounded
from plumbline.plans.registry import query
from plumbline.sources import databases, readers, sinks
from plumbline.sources.staging import scratch, staged
from plumbline.streaming import scorecard

KEYS = ["model", "task"]


@query("q_s1_jsonl", "SELECT id::VARCHAR AS id, task AS property, 'matched' AS condition, label FROM items WHERE id % 3 <> 0", "items")
def s1(t):
    path = scratch(t.spark, "items")
    condition = F.when(F.col("id") % 3 == 0, "scrambled")
    out = t.items.select(F.col("id").cast("string").alias("id"), F.col("task").alias("property"), condition.alias("condition"), F.col("label").cast("double").cast("string").alias("label"))
    sinks.write_rows(out, path)
    return readers.jsonl_items(t.spark, path, "matched").select("id", "property", "condition", "label")


@query("q_s2_csv", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_acctbal AS balance FROM customer")
def s2(t):
    path = scratch(t.spark, "customers")
    sinks.write_rows(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), path, "csv")
    return readers.csv_rows(t.spark, path).withColumn("balance", F.col("balance").cast("double"))


FASTA = "SELECT 'P' || s_suppkey AS acc, 'G' || s_nationkey AS gene, upper(replace(s_name, '#', '')) || s_suppkey AS sequence FROM supplier"


def _records(t, tail):
    body = F.concat(F.upper(F.replace("s_name", F.lit("#"), F.lit(""))), F.lit("\n"), F.col("s_suppkey").cast("string"))
    return t.supplier.select(F.concat(F.lit(">sp|P"), F.col("s_suppkey").cast("string"), F.lit("|X "), tail, F.lit("\n"), body).alias("value"))


@query("q_s4_fasta", FASTA)
def s4(t):
    path = scratch(t.spark, "fasta")
    _records(t, F.concat(F.lit("GN=G"), F.col("s_nationkey").cast("string"))).write.text(path)
    return readers.fasta_proteins(t.spark, path)


@query("q_s5_fasta_target", "SELECT 'sp|P' || s_suppkey || '|X' AS id, s_acctbal AS target, upper(replace(s_name, '#', '')) || s_suppkey AS sequence FROM supplier")
def s5(t):
    path = scratch(t.spark, "fasta")
    _records(t, F.concat(F.lit("TARGET="), F.col("s_acctbal").cast("string"))).write.text(path)
    return readers.fasta_targets(t.spark, path)


@query("q_s6_sequence_column", "SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'none') AS sequence FROM nation")
def s6(t):
    df = t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("seq"), F.lit("none").alias("fallback"))
    return readers.sequence_column(df, ["seq_col", "seq", "fallback"]).select("n_nationkey", "sequence")


@query("q_s7_tsv", "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS brand FROM part")
def s7(t):
    path = scratch(t.spark, "tsv")
    rows = t.part.select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_size") % 4 != 0, F.col("p_brand"))).alias("value"))
    head = t.spark.createDataFrame([("#id\tname\tbrand",)], "value string")
    head.unionByName(rows).coalesce(1).write.option("compression", "gzip").text(path)
    return readers.tsv_rows(t.spark, path, ["id", "brand"])


@query("q_s8_snapshot", "SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL")
def s8(t):
    path = scratch(t.spark, "snapshot")
    rows = t.orders.select(F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("value"))
    t.spark.createDataFrame([("#id\tassembly",)], "value string").unionByName(rows).coalesce(1).write.option("compression", "gzip").text(path)
    members = readers.tsv_rows(t.spark, path, ["id", "assembly"]).where("assembly = 'F'").select(F.col("id").cast("long").alias("id")).distinct()
    return t.lineitem.select(F.col("l_orderkey").alias("id")).join(members, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))


@query("q_s11_json_results", "SELECT model, count(*) AS n FROM preds WHERE model <> 'gamma' GROUP BY ALL", "preds")
def s11(t):
    base = scratch(t.spark, "results")
    for name in ("alpha", "beta", "dry-run"):
        counts = t.preds.where(F.col("model") == name).agg(F.count("*").alias("n"))
        sinks.write_rows(counts, f"{base}/{name}")
    return readers.json_results(t.spark, f"{base}/*/*.json", "n long").select("model", "n")


@query("q_s14_layer_profiles", "SELECT 'region ' || n_regionkey AS series, n_nationkey::INT AS layer, (n_regionkey * 2)::DOUBLE AS value FROM nation")
def s14(t):
    path = scratch(t.spark, "profiles")
    lines = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("k")).select(
        F.concat(F.lit("### region "), F.col("n_regionkey").cast("string"), F.lit("\n"), F.array_join(F.transform("k", lambda k: F.concat(k.cast("string"), F.lit(" "), (F.col("n_regionkey") * 2).cast("string"))), "\n")).alias("value")
    )
    lines.write.text(path)
    return readers.layer_profiles(t.spark, path)


@query("q_k2_export", "SELECT web, count(*) AS n FROM items GROUP BY ALL", "items")
def k2(t):
    return sinks.export_parquet(t.items.select("id", "label", "web"), scratch(t.spark, "export"), "web")


@query("q_k3_upsert", "SELECT model, task, count(*) AS n, model = 'beta' AS fresh FROM preds WHERE model <> 'gamma' GROUP BY ALL", "preds")
def k3(t):
    n = t.preds.groupBy(*KEYS).agg(F.count("*").alias("n"))
    old = n.where("model <> 'gamma'").withColumn("fresh", F.lit(False))
    return sinks.merge_scorecards(old, n.where("model = 'beta'").withColumn("fresh", F.lit(True)))


@query("q_k4_still_to_do", "SELECT id FROM items WHERE id NOT IN (SELECT id FROM preds WHERE kind = 'parsed' GROUP BY id HAVING count(*) >= 3)", "preds")
def k4(t):
    return sinks.still_to_do(t.items.select("id"), t.preds.where("kind = 'parsed'").select("id"), ["id"], 3)


@query("q_k5_leaderboard", f"""+ {RANKS}, s AS (SELECT model, task, {AUROC} AS a FROM r GROUP BY ALL) SELECTING SELECT '0' AS place, '| task | alpha | beta |' AS line UNION ALL SELECT '1', '|---|---|---|' UNION ALL
SELECT task, '| ' || task || ' | ' || coalesce(printf('%.3f', max(a) FILTER (model = 'alpha')), '-') || ' | ' || coalesce(printf('%.3f', max(a) FILTER (model = 'beta')), '-') || ' |' FROM s GROUP BY task""", "preds")
def k5(t):
    return sinks.leaderboard_markdown(rounded(m.auroc(t.preds, KEYS), "auroc"), ["alpha", "beta"])


@query("q_k6_dataset_card")
def k6(t):
    card = sinks.dataset_card(t.items.select("id", "task", "label"), "items", "Labelled documents")
    return t.spark.createDataFrame([(card,)], "card string")


@query("q_k7_violations", """SELECT * FROM (SELECT id, 'low prob' AS rule, 'warning' AS severity FROM preds WHERE model = 'alpha' AND NOT prob >= 0.1 UNION ALL SELECT id, 'unparsed', 'error' FROM preds WHERE model = 'alpha' AND kind <> 'parsed')""", "preds")
def k7(t):
    rules = {"low prob": ("warning", F.col("prob") >= 0.1), "unparsed": ("error", F.col("kind") == "parsed")}
    return sinks.violations(t.preds.where("model = 'alpha'"), rules)


@query("q_k8_risk_curve", "SELECT model, k, round(avg(err::DOUBLE) OVER (PARTITION BY model ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING), 6) AS risk FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY conf DESC, id) AS k FROM preds)", "preds")
def k8(t):
    curve = m.risk_curve(t.preds, ["model"], [F.desc("conf"), F.col("id")], F.col("err"))
    return rounded(curve.select("model", F.col("k").cast("long").alias("k"), "risk"), "risk")


@query("q_e1_solve", "SELECT id, (('0x' || substr(md5('dry:Is ' || id || ' good?'), 1, 8))::BIGINT % 1000) / 1000::DOUBLE AS prob, 'ok' AS status FROM items", "items")
def e1(t):
    prompts = t.items.select("id", F.concat(F.lit("Is "), "id", F.lit(" good?")).alias("prompt"))
    out = solver.solve(prompts, "dry")
    return out.select("id", parsing.probability(F.col("answer")).alias("prob"), "status")


def moody(model: str, prompt: str):
    """An answer of every kind, by the prompt alone."""
    kind = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16) % 6
    if kind == 3:
        raise TimeoutError
    return ("Probability: 0.5", "", "I cannot say", None, ("Probability: 0.", "length"), ("", "refusal"))[kind]


@query("q_e10_statuses", "SELECT CASE (('0x' || substr(md5('Is ' || id || ' good?'), 1, 8))::BIGINT % 6)::INT WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 3 THEN 'err:TimeoutError' WHEN 4 THEN 'truncated' ELSE 'refusal' END AS status, count(*) AS n FROM items GROUP BY ALL", "items")
def e10(t):
    prompts = t.items.select("id", F.concat(F.lit("Is "), "id", F.lit(" good?")).alias("prompt"))
    providers = solver.Providers()
    providers.insert(lambda name: name == "moody", moody)
    return solver.solve(prompts, "moody", providers, at_once=4, workers=8, pause=0.0).groupBy("status").agg(F.count("*").alias("n"))


@query("q_e5_featurizers", """SELECT 'vector' AS kind, count(*) AS n, count(DISTINCT vec_id % 10) AS n_groups FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
UNION ALL SELECT 'text', count(*), count(DISTINCT grp) FROM items WHERE trim(text, ' ') <> '' UNION ALL SELECT 'sequence', count(*), count(DISTINCT grp) FROM items WHERE length(text) >= 3 UNION ALL SELECT 'number', count(*), count(DISTINCT grp) FROM items WHERE text IS NOT NULL""", "items")
def e5(t):
    text = t.items.select("id", "label", "grp", F.col("text").alias("rep"))
    frames = {
        "vector": t.embeddings.select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 10).alias("grp"), F.col("embedding").alias("rep")),
        "text": text,
        "sequence": text,
        "number": text.withColumn("rep", F.length("rep").cast("double")),
    }
    parts = [heads.featurized(df, kind).agg(F.lit(kind).alias("kind"), F.count("features").alias("n"), F.count_distinct("grp").alias("n_groups")) for kind, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


E9 = """+ p AS (SELECT task, id, label, row_number() OVER (PARTITION BY task, label ORDER BY md5('9:' || id), id) AS rn, (('0x' || substr(md5('dry:Is ' || id || ' good?'), 1, 8))::BIGINT % 1000) / 1000::DOUBLE AS prob FROM items WHERE task IN ('en', 'de')),
s AS (SELECT task, CASE task WHEN 'de' THEN 1 - label ELSE label END AS label, prob, CASE task WHEN 'de' THEN 'oppose' ELSE 'align' END AS orient FROM p WHERE rn <= 20),
k AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY prob) + (count(*) OVER (PARTITION BY task, prob) - 1) / 2.0::DOUBLE AS r FROM s)
SELECTING SELECT 'dry' AS model, task, orient, count(*) AS n, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / nullif(sum(label) * sum(1 - label), 0)::DOUBLE, 6) AS auroc FROM k GROUP BY ALL"""


@query("q_e9_evaluate", E9, "items")
def e9(t):
    items = t.items.select("id", "task", F.concat(F.lit("Is "), "id", F.lit(" good?")).alias("representation"), "label", F.lit(None).cast("string").alias("condition"))
    card = evaluate(items, [solver.TaskSpec("en"), solver.TaskSpec("de", orient="oppose")], n=40, seed=9, workers=4)
    return rounded(card.select("model", "task", "orient", "n", "auroc"), "auroc")


@query("q_e4_task_registry", """SELECT id, k.task, kind, orient, CASE orient WHEN 'oppose' THEN 1 - label ELSE label END AS label, replace(prompt, '{rep}', 'item ' || id) AS prompt
FROM items JOIN (VALUES ('en', 'pairs', 'oppose', 'Is {rep} good?'), ('fr', 'twocol', 'align', '{rep}: yes or no?')) k(task, kind, orient, prompt) ON items.task = k.task WHERE label IS NOT NULL""", "items")
def e4(t):
    tasks = [solver.TaskSpec("en", orient="oppose", prompt="Is {rep} good?"), solver.TaskSpec("fr", "twocol", prompt="{rep}: yes or no?")]
    items = t.items.select("id", "task", F.concat(F.lit("item "), "id").alias("representation"), "label", F.lit(None).cast("string").alias("condition"))
    kinds = F.broadcast(solver.task_table(t.spark, tasks).select("task", "kind"))
    return asked(items, tasks, 2 * 10**9, 0).join(kinds, "task").select("id", "task", "kind", "orient", "label", "prompt")


@query("q_s9_arrays", "SELECT vec_id AS id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, len(embedding) AS size FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL)) = 0")
def s9(t):
    known = t.embeddings.where(F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull()))
    files = staged(sinks.npz_files(known.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), "embedding"), {"id": "int64", "label": "int64", "embedding": "float32"}), "arrays")
    rows = readers.npz_contents(files, "id long, label long, embedding array<float>")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("id", "label", F.round(total, 4).alias("total"), F.size("embedding").alias("size"))


@query("q_m8_pixels", """WITH p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, 128 + 64 * x::DOUBLE)))::INT) AS s FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % 8 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT id, 0 AS channel, s FROM p UNION ALL SELECT id, 1, list_transform(s, lambda x: 255 - x) FROM p UNION ALL SELECT id, 2, list_transform(s, lambda x: x * 7 % 256) FROM p)
SELECT id, channel, 8 AS width, len(s) // 8 AS height, round(list_avg(s) / 255, 6) AS mean, round(list_aggregate(s, 'stddev_pop') / 255, 6) AS deviation,
  round(list_median(s) / 255, 6) AS median, len(list_filter(s, lambda x: x < 128)) AS dark FROM c""")
def m8(t):
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("embedding") > 0) & (F.size("embedding") % 8 == 0)
    sample = F.transform("embedding", lambda x: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + 64 * x.cast("double")))).cast("int"))
    grey = t.embeddings.where(sound).select(F.col("vec_id").alias("id"), sample.alias("s"))
    colours = grey.select("id", F.flatten(F.transform("s", lambda x: F.array(x, 255 - x, x * 7 % 256))).alias("samples"))
    found = pictures.pixel_statistics(staged(pictures.drawn(colours, "samples", 8).select("id", "content"), "pictures"), bins=2)
    each = found.where("status = 'ok'").withColumn("channel", F.explode(F.array(*map(F.lit, range(3)))))
    at = lambda name, k: F.get(name, k)
    values = {"mean": at("mean", F.col("channel")), "deviation": at("deviation", F.col("channel")), "median": at("quartiles", 3 * F.col("channel") + 1)}
    return each.select("id", "channel", "width", "height", *[F.round(v, 6).alias(n) for n, v in values.items()], at("histogram", 2 * F.col("channel")).alias("dark"))


@query("q_stream_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream(t):
    schema = t.events.schema
    events = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    table = scorecard.drain(scorecard.windowed_rates(events, "ts", "event_type", "value"), f"windows_{uuid.uuid4().hex}")
    return table.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("q_s3_database", """SELECT c_custkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND l_returnflag IN ('A', 'R') AND c_mktsegment <> 'BUILDING' GROUP BY ALL""")
def s3(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    # a file has the customers of its orders, so that the three-way join is within it
    buyers = orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey").select("o_orderkey", "c_custkey", "c_mktsegment")
    tables = {"orders": orders, "lineitem": t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag"), "customer": buyers}
    folder = scratch(t.spark, "database")
    databases.write_databases(tables, {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "o_orderkey"}, folder, databases.files_for(t.orders, t.orders, t.lineitem))
    three = "SELECT o.o_orderkey, o_orderstatus, l_quantity, l_returnflag, c_custkey, c_mktsegment FROM lineitem l JOIN orders o ON l_orderkey = o.o_orderkey JOIN customer c ON c.o_orderkey = o.o_orderkey"
    where = [("o_orderstatus", "=", "F"), ("l_returnflag", "in", ["A", "R"]), ("c_mktsegment", "<>", "BUILDING")]
    columns = "o_orderkey long, o_orderstatus string, l_quantity double, l_returnflag string, c_custkey long, c_mktsegment string"
    rows = databases.database_rows(t.spark, folder, three, "o_orderkey", columns, where, rows_apart=0)
    return rows.groupBy("c_custkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
