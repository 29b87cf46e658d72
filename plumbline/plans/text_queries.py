"""Queries of parsers, features and perturbations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import parsing as p
from plumbline.functions import perturbation as x
from plumbline.functions import sequences as s
from plumbline.operators import relational as r
from plumbline.plans.metric_queries import rounded
from plumbline.plans.registry import query

NUMS = r"list_transform(regexp_extract_all(coalesce(answer, ''), '{}'), lambda v: try_cast(v AS DOUBLE))"
PLAIN, SIGNED = NUMS.format(r"\d*\.?\d+"), NUMS.format(r"-?\d*\.?\d+")
FIT = f"list_filter({PLAIN}, lambda v: v <= 100)"


@query("q_f1_parse_probability", f"SELECT id, coalesce(CASE WHEN v > 1 THEN v / 100 ELSE v END, 0.5) AS prob FROM (SELECT id, {FIT}[-1] AS v FROM answers)", "answers")
def f1(t):
    return t.answers.select("id", p.probability(F.col("answer")).alias("prob"))


@query("q_f2_parse_kind", f"SELECT id, CASE WHEN v IS NULL THEN 'fallback' WHEN v > 1 THEN 'percent' ELSE 'parsed' END AS kind FROM (SELECT id, {FIT}[-1] AS v FROM answers)", "answers")
def f2(t):
    return t.answers.select("id", p.probability_kind(F.col("answer")).alias("kind"))


@query("q_f3_first_number", f"SELECT id, coalesce(CASE WHEN v > 1 THEN v / 100 ELSE v END, 0.5) AS prob FROM (SELECT id, {FIT}[1] AS v FROM answers)", "answers")
def f3(t):
    return t.answers.select("id", p.probability(F.col("answer"), last=False).alias("prob"))


@query("q_f4_parse_route", r"""SELECT id, try_cast(nullif(regexp_extract(answer, '(?i)PRED\s*:\s*([01]?\.?\d+)', 1), '') AS DOUBLE) AS pred, try_cast(nullif(regexp_extract(answer, '(?i)CONF\s*:\s*([01]?\.?\d+)', 1), '') AS DOUBLE) AS conf,
CASE WHEN regexp_matches(answer, '(?i)\bdefer\b') THEN 'DEFER' ELSE 'SELF' END AS route FROM answers""", "answers")
def f4(t):
    a = F.col("answer")
    return t.answers.select("id", p.stated(a, "PRED").alias("pred"), p.stated(a, "CONF").alias("conf"), p.route(a).alias("route"))


@query("q_f5_parse_number", f"SELECT id, {SIGNED}[-1] AS number FROM answers", "answers")
def f5(t):
    return t.answers.select("id", p.number(F.col("answer")).alias("number"))


@query("q_f6_parse_age", f"SELECT id, coalesce(list_filter({PLAIN}, lambda v: v <= 120)[1], 50) AS age FROM answers", "answers")
def f6(t):
    return t.answers.select("id", p.age(F.col("answer")).alias("age"))


@query("q_f7_three_numbers", f"SELECT id, n[1] AS a, n[2] AS b, n[3] AS c FROM (SELECT id, {PLAIN} AS n FROM answers) WHERE len(n) >= 3", "answers")
def f7(t):
    found = t.answers.select("id", p.three_numbers(F.col("answer")).alias("n")).where("n is not null")
    return found.select("id", F.col("n")[0].alias("a"), F.col("n")[1].alias("b"), F.col("n")[2].alias("c"))


@query("q_f8_string_array", """SELECT id, array_to_string(regexp_extract_all(answer, '"([^"]+)"', 1), '|') AS names FROM answers WHERE answer LIKE '%"%'""", "answers")
def f8(t):
    return t.answers.where(F.contains("answer", F.lit('"'))).select("id", F.array_join(p.strings(F.col("answer")), "|").alias("names"))


@query("q_f9_markers", """SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(answer, '[,\n]'), lambda v: upper(trim(v))), lambda v: regexp_full_match(v, '[A-Z0-9-]+') AND length(v) <= 12))), '|') AS names FROM answers""", "answers")
def f9(t):
    return t.answers.select("id", F.array_join(F.array_sort(p.markers(F.col("answer"))), "|").alias("names"))


@query("q_f10_recognized", r"""SELECT id, regexp_matches(answer, '(?i)\b(tp53|CD8A|about)\b') AND NOT regexp_matches(answer, '(?i)\bunknown\b') AS hit FROM answers""", "answers")
def f10(t):
    return t.answers.select("id", p.recognized(F.col("answer"), F.array(F.lit("tp53"), F.lit("CD8A"), F.lit("about"))).alias("hit"))


@query("q_f11_confabulated", r"""SELECT role, count_if(regexp_matches(text, '(?i)\bthe\b'))::BIGINT AS n FROM conversations GROUP BY ALL""")
def f11(t):
    return t.conversations.groupBy("role").agg(F.count_if(p.recognized(F.col("text"), F.array(F.lit("the"))) | F.col("text").rlike(r"(?i)\bthe\b")).alias("n"))


@query("q_f12_first_token", r"""SELECT id, regexp_split_to_array(trim(regexp_replace(answer, '```[a-z]*\n?', '', 'g'), ' '), '\s+')[1] AS token FROM answers""", "answers")
def f12(t):
    return t.answers.select("id", p.first_token(F.col("answer")).alias("token"))


@query("q_f13_prompt", "SELECT s_suppkey, replace(replace('Is {rep} toxic? {clause}', '{rep}', s_name), '{clause}', 'Answer 0 to 1.') AS prompt FROM supplier")
def f13(t):
    return t.supplier.select("s_suppkey", p.filled("Is {rep} toxic? {clause}", rep=F.col("s_name"), clause=F.lit("Answer 0 to 1.")).alias("prompt"))


@query("q_f14_truncate", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:100], ' ') AS head, left(text, 400) AS chars FROM documents")
def f14(t):
    return t.documents.select("doc_id", p.head_tokens(F.col("text"), 100).alias("head"), F.left("text", F.lit(400)).alias("chars"))


@query("q_f15_kmer_counts", """+ g AS (SELECT p_type, substr(replace(upper(p_name), 'U', 'T'), i, 3) AS kmer FROM (SELECT p_type, p_name, unnest(range(1, length(p_name) - 1)) AS i FROM part WHERE length(p_name) >= 3)),
c AS (SELECT p_type, kmer, count(*) AS n FROM g GROUP BY ALL) SELECTING SELECT p_type, kmer, n, round(n / sum(n) OVER (PARTITION BY p_type)::DOUBLE, 6) AS share FROM c""")
def f15(t):
    return rounded(s.kmer_counts(t.part, ["p_type"], "p_name", 3), "share")


@query("q_f16_composition", "SELECT doc_id, round((length(text) - length(translate(text, 'aeiou', ''))) / nullif(length(text), 0)::DOUBLE, 6) AS vowels FROM documents")
def f16(t):
    return rounded(t.documents.select("doc_id", s.fraction(F.col("text"), "aeiou").alias("vowels")), "vowels")


@query("q_f17_entropy", """+ c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECTING SELECT lang, round(-sum((n / t::DOUBLE) * ln(n / t::DOUBLE)), 6) AS entropy, round(max(n) / min(t)::DOUBLE, 6) AS max_share, count(*) AS n_distinct, min(t)::BIGINT AS rows
FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS t FROM c) GROUP BY ALL""")
def f17(t):
    return rounded(s.entropy(t.documents, ["lang"], "source"), "entropy", "max_share")


@query("q_f18_panel", """SELECT o_custkey, string_agg(k || '=' || v, ' ' ORDER BY k) AS panel FROM (SELECT o_custkey, substr(o_orderpriority, 1, 1) AS k, count(*) AS v FROM orders GROUP BY ALL) GROUP BY ALL""")
def f18(t):
    n = t.orders.groupBy("o_custkey", F.substring("o_orderpriority", 1, 1).alias("k")).agg(F.count("*").alias("v"))
    text = n.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat("k", F.lit(":"), "v"))), " ").alias("text"))
    pairs = F.array_sort(F.map_entries(s.panel(F.col("text"))))
    return text.select("o_custkey", F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint"))), " ").alias("panel"))


@query("q_f19_series_common_length", """+ v AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY ALL) SELECTING SELECT user_id, round(list_sum(v[1:(SELECT min(len(v)) FROM v)]), 4) AS head_sum FROM v""")
def f19(t):
    text = t.events.select("user_id", "ts", "event_id", F.col("value").cast("string").alias("text"))
    values = text.withColumn("value", F.get(s.series(F.col("text")), 0)).drop("text")
    head = r.to_common_length(values, ["user_id"], ["ts", "event_id"])
    return head.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("head_sum"))


@query("q_f20_histogram", "SELECT event_type, CASE WHEN value = 220 THEN 39 ELSE floor(value / 5.5)::BIGINT END AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 220 GROUP BY ALL")
def f20(t):
    return t.events.select("event_type", s.histogram(F.col("value"), 0.0, 220.0, 40).alias("bin")).where("bin is not null").groupBy("event_type", "bin").agg(F.count("*").alias("n"))


@query("q_f21_formula", r"""SELECT s_suppkey, round(s_suppkey / (s_suppkey + 2.0::DOUBLE * (s_nationkey + 1)), 6) AS c_share FROM supplier""")
def f21(t):
    formula = F.concat(F.lit("C: "), "s_suppkey", F.lit(" Na: "), 2 * (F.col("s_nationkey") + 1))
    return rounded(t.supplier.select("s_suppkey", F.try_element_at(s.formula_fractions(formula), F.lit("C")).alias("c_share")), "c_share")


@query("q_f22_column_stats", "SELECT lang, count(*) AS depth, count(DISTINCT source) AS n_distinct, round(avg((n_chars < 100)::INT::DOUBLE), 6) AS gap_share FROM documents GROUP BY ALL")
def f22(t):
    return rounded(t.documents.groupBy("lang").agg(F.count("*").alias("depth"), F.count_distinct("source").alias("n_distinct"), F.avg((F.col("n_chars") < 100).cast("double")).alias("gap_share")), "gap_share")


@query("q_f23_margins", "SELECT model, id, round(abs(prob - 0.5), 6) AS margin, round(1 - 2 * abs(prob - 0.5), 6) AS uncertainty, round(abs(prob - spec_prob), 6) AS disagreement FROM preds", "preds")
def f23(t):
    m = F.abs(F.col("prob") - 0.5)
    return rounded(t.preds.select("model", "id", m.alias("margin"), (1 - 2 * m).alias("uncertainty"), F.abs(F.col("prob") - F.col("spec_prob")).alias("disagreement")), "margin", "uncertainty", "disagreement")


@query("q_f24_logit", """SELECT model, id, round(ln(c / (1 - c)), 6) AS logit, round(1 / (1 + exp(-(ln(c / (1 - c)) / 1.5::DOUBLE))), 6) AS tempered FROM (SELECT *, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, prob)) AS c FROM preds)""", "preds")
def f24(t):
    from plumbline.operators.metrics import logit, sigmoid

    z = logit(F.col("prob"))
    return rounded(t.preds.select("model", "id", z.alias("logit"), sigmoid(z / 1.5).alias("tempered")), "logit", "tempered")


@query("q_f25_log_counts", "SELECT l_partkey, round(log10(count(*) + 1), 6) AS log_n FROM lineitem GROUP BY ALL")
def f25(t):
    return t.lineitem.groupBy("l_partkey").agg(F.round(F.log10(F.count("*") + 1), 6).alias("log_n"))


@query("q_f26_tanimoto", """+ b AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS b FROM orders GROUP BY ALL) SELECTING SELECT x.o_custkey, round(len(list_intersect(x.b, y.b)) / nullif(len(list_distinct(list_concat(x.b, y.b))), 0)::DOUBLE, 6) AS sim FROM b x JOIN b y ON y.o_custkey = x.o_custkey + 1""")
def f26(t):
    b = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("b"))
    other = b.select((F.col("o_custkey") - 1).alias("o_custkey"), F.col("b").alias("c"))
    return rounded(b.join(other, "o_custkey").select("o_custkey", s.tanimoto(F.col("b"), F.col("c")).alias("sim")), "sim")


@query("q_f27_vector_text", "SELECT vec_id, array_to_string(list_transform(embedding, lambda v: printf('%.3f', v::DOUBLE)), ' ') AS text FROM embeddings")
def f27(t):
    return t.embeddings.select("vec_id", s.vector_text(F.col("embedding")).alias("text"))


@query("q_f28_sequence_panel", "SELECT doc_id, length(text) AS len, length(text) // 3 AS codons, (length(text) - length(replace(text, 'e', '')))::BIGINT AS n_e, (length(text) - length(translate(text, '.,', '')))::BIGINT AS n_marks FROM documents")
def f28(t):
    n = F.length("text")
    return t.documents.select("doc_id", n.cast("long").alias("len"), F.floor(n / 3).alias("codons"), (n - F.length(F.replace("text", F.lit("e"), F.lit("")))).cast("long").alias("n_e"), (n - F.length(F.translate("text", ".,", ""))).cast("long").alias("n_marks"))


@query("q_f29_parenthesized", r"SELECT doc_id, regexp_extract(text, '\(([^)]+)\)', 1) AS inner_text FROM documents WHERE regexp_matches(text, '\(([^)]+)\)')")
def f29(t):
    pattern = r"\(([^)]+)\)"
    return t.documents.where(F.col("text").rlike(pattern)).select("doc_id", F.regexp_extract("text", pattern, 1).alias("inner_text"))


@query("q_f30_token_regex", r"SELECT p_partkey, len(regexp_extract_all(p_name, '[A-Za-z][a-z]?|\d|.')) AS n_tokens FROM part")
def f30(t):
    return t.part.select("p_partkey", F.size(F.regexp_extract_all("p_name", F.lit(r"([A-Za-z][a-z]?|\d|.)"), F.lit(1))).cast("long").alias("n_tokens"))


SHUFFLED = "list_reduce(list_prepend('', list_transform(list_sort(list_transform(range(length({t})), lambda i: (md5({seed} || ':' || i), i, substr({t}, i + 1, 1)))), lambda q: q[3])), lambda a, b: a || b)"


@query("q_x12_scramble", f"SELECT s_suppkey, {SHUFFLED.format(t='s_name', seed=chr(39) + '0' + chr(39))} AS scrambled FROM supplier")
def x12(t):
    return t.supplier.select("s_suppkey", x.scramble(F.col("s_name"), 0).alias("scrambled"))


@query("q_x13_scramble_different", f"""+ s AS (SELECT s_suppkey, right(s_name, 3) AS n FROM supplier), v AS (SELECT s_suppkey, n, {', '.join(SHUFFLED.format(t='n', seed=f"'5:{k}'") + f' AS v{k}' for k in range(8))} FROM s)
SELECTING SELECT s_suppkey, coalesce({', '.join(f'nullif(v{k}, n)' for k in range(8))}, n) AS scrambled FROM v""")
def x13(t):
    return t.supplier.select("s_suppkey", x.scramble_different(F.right("s_name", F.lit(3)), 5).alias("scrambled"))


@query("q_x14_fake_accession", f"""+ s AS (SELECT s_suppkey, left(s_name, 2) AS h, substr(s_name, 3) AS n FROM supplier), v AS (SELECT *, {SHUFFLED.format(t='n', seed=chr(39) + 'f' + chr(39))} AS m FROM s)
SELECTING SELECT s_suppkey, h || CASE WHEN m = n THEN reverse(n) ELSE m END AS accession FROM v""")
def x14(t):
    return t.supplier.select("s_suppkey", x.fake_accession(F.col("s_name"), "f").alias("accession"))


@query("q_x16_anonymize", r"SELECT s_suppkey, coalesce(nullif(trim(regexp_replace(regexp_replace(s_name, '^[A-Z][a-z]+#', '', 'g'), '0+', '', 'g'), ' '), ''), s_name) AS anon FROM supplier")
def x16(t):
    return t.supplier.select("s_suppkey", x.anonymized(F.col("s_name"), ["^[A-Z][a-z]+#", "0+"]).alias("anon"))


@query("q_x17_false_context", "+ p AS (SELECT list(n_name ORDER BY n_nationkey) AS names FROM nation) SELECTING SELECT s_suppkey, names[s_suppkey % 3 + 1] AS context FROM supplier, p")
def x17(t):
    pool = t.nation.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda n: n["n_name"]).alias("names"))
    return t.supplier.join(F.broadcast(pool)).select("s_suppkey", F.get("names", F.pmod("s_suppkey", F.lit(3)).cast("int")).alias("context"))


@query("q_x18_simulated_verifier", "SELECT model, id, ((('0x' || substr(md5('v:' || model || ':' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) < 0.5) AS verdict FROM preds", "preds")
def x18(t):
    from plumbline.functions.hashing import uniform

    return t.preds.select("model", "id", (uniform("v", F.col("model"), F.col("id")) < 0.5).alias("verdict"))


@query("q_x19_label_flip", "SELECT id, CASE WHEN id % 3 = 0 THEN 1 - label ELSE label END AS shown FROM items", "items")
def x19(t):
    return t.items.select("id", F.when(F.col("id") % 3 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("shown"))


@query("q_x25_window", "SELECT doc_id, substr(text, greatest(1, 50 - 20), least(length(text), 50 + 20) - greatest(1, 50 - 20) + 1) AS around FROM documents WHERE length(text) >= 50")
def x25(t):
    return t.documents.where(F.length("text") >= 50).select("doc_id", x.window_around(F.col("text"), F.lit(50), 20).alias("around"))


@query("q_e3_dry_solver", "SELECT model, label, round(avg(prob), 5) AS mean_prob, count(*) AS n FROM preds GROUP BY ALL", "preds")
def e3(t):
    return t.preds.groupBy("model", "label").agg(F.round(F.avg("prob"), 5).alias("mean_prob"), F.count("*").alias("n"))
