"""The tables that queries run on, and the frames made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import uniform

MODELS = {"alpha": 0.40, "beta": 0.20, "gamma": 0.05}
NOISE = 0.3117691453623979  # 0.18 times the root of 3: four uniforms have a standard deviation of 1 over that root


class Tables:
    """``t.orders`` is the table of that name, ``t.preds`` the frame of predictions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def items(self) -> DataFrame:
        """id, task, web, grp, label, toxic, text of labelled documents."""
        docs = self.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("task"), F.col("source").alias("grp"), "text")
        web = F.when(F.col("task") == "en", "rich").when(F.col("task") == "es", "zero").otherwise("mixed")
        labels = self.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"), F.col("toxic").cast("int").alias("toxic"))
        return docs.join(labels, "id").select("id", "task", web.alias("web"), "grp", "label", "toxic", "text")

    @property
    def preds(self) -> DataFrame:
        """One row per model and item: prob, conf, route, kind, spec_prob; pred, err and spec_err from them."""
        items = self.items.select("id", "task", "web", "grp", "label")
        models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("slope")) for m, s in MODELS.items()]))
        rows = items.withColumn("m", models).select("m.model", "m.slope", *items.columns)
        label = F.col("label").cast("double")
        prob = simulated(F.col("model"), F.col("id"), F.col("slope"), label)
        return (
            rows.withColumn("prob", prob)
            .withColumn("conf", F.round(0.5 * F.abs(2 * F.col("prob") - 1) + 0.5 * uniform(F.col("model"), F.col("id"), 5), 2))
            .withColumn("route", F.when(F.col("conf") < 0.35, "DEFER").otherwise("SELF"))
            .withColumn("kind", F.when(uniform(F.col("model"), F.col("id"), 6) < 0.9, "parsed").otherwise("fallback"))
            .withColumn("spec_prob", simulated(F.lit("spec"), F.col("id"), F.lit(0.60), label))
            .withColumn("pred", (F.col("prob") > 0.5).cast("int"))
            .withColumn("err", (F.col("pred") != F.col("label")).cast("int"))
            .withColumn("spec_err", ((F.col("spec_prob") > 0.5).cast("int") != F.col("label")).cast("int"))
            .drop("slope")
        )

    @property
    def answers(self) -> DataFrame:
        """id and an answer text, made so that every branch of the parsers is met."""
        c = self.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
        u = lambda j: uniform("ans", F.col("id"), j)
        number = F.round(u(1) * 120, 1).cast("string")
        form = F.floor(u(2) * 8).cast("int")
        answer = (
            F.when(form == 0, F.concat(F.lit("Probability: "), F.round(u(1), 3).cast("string")))
            .when(form == 1, F.concat(F.lit("about "), number, F.lit("%")))
            .when(form == 2, F.concat(F.lit("PRED: "), F.round(u(1), 2).cast("string"), F.lit(" CONF: "), F.round(u(3), 2).cast("string"), F.lit(" ROUTE: "), F.when(u(4) < 0.5, "defer").otherwise("SELF")))
            .when(form == 3, F.concat(F.lit("between 3 and -"), number, F.lit(" or 0.25.")))
            .when(form == 4, F.concat(F.lit('["'), F.substring(F.md5("id"), 1, 3), F.lit('", "tp53"]')))
            .when(form == 5, F.concat(F.lit("```\nCD8A, GZMB\n"), F.substring(F.md5("id"), 1, 4), F.lit(", too long a marker name\n```")))
            .when(form == 6, F.lit("UNKNOWN"))
            .otherwise(F.concat(F.lit("Answer 12, then 0.4 and "), number))
        )
        return c.select("id", answer.alias("answer"))


def simulated(seed: Column, key: Column, slope: Column, label: Column) -> Column:
    noise = uniform(seed, key, 1) + uniform(seed, key, 2) + uniform(seed, key, 3) + uniform(seed, key, 4) - 2
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - slope / 2 + slope * label + NOISE * noise)), 4)


# ---- the same frames in DuckDB -----------------------------------------------------------------------------------


def _u(seed: str, key: str, j: int) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {seed}, {key}, '{j}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _sim(seed: str, slope: str) -> str:
    noise = " + ".join(_u(seed, "id", j) for j in range(1, 5))
    return f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE - {slope} / 2 + {slope} * label::DOUBLE + {NOISE}::DOUBLE * ({noise} - 2))), 4)"


ITEMS_SQL = """items AS (
  SELECT d.doc_id AS id, lang AS task, CASE lang WHEN 'en' THEN 'rich' WHEN 'es' THEN 'zero' ELSE 'mixed' END AS web,
         source AS grp, quality::INT AS label, toxic::INT AS toxic, text
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
PREDS_SQL = f"""{ITEMS_SQL}, preds0 AS (
  SELECT model, id, task, web, grp, label, {_sim('model', 'slope')} AS prob, {_u('model', 'id', 5)} AS u5, {_u('model', 'id', 6)} AS u6,
         {_sim("'spec'", '0.6::DOUBLE')} AS spec_prob
  FROM items, (VALUES ('alpha', 0.40::DOUBLE), ('beta', 0.20::DOUBLE), ('gamma', 0.05::DOUBLE)) m(model, slope)
), preds1 AS (SELECT *, round(0.5::DOUBLE * abs(2 * prob - 1) + 0.5::DOUBLE * u5, 2) AS conf FROM preds0
), preds AS (
  SELECT model, id, task, web, grp, label, prob, conf, CASE WHEN conf < 0.35 THEN 'DEFER' ELSE 'SELF' END AS route,
         CASE WHEN u6 < 0.9 THEN 'parsed' ELSE 'fallback' END AS kind, spec_prob, (prob > 0.5)::INT AS pred,
         ((prob > 0.5)::INT <> label)::INT AS err, ((spec_prob > 0.5)::INT <> label)::INT AS spec_err
  FROM preds1)"""
ANSWERS_SQL = f"""conv AS (SELECT conv_id || '-' || turn AS id FROM conversations), answers AS (
  SELECT id, CASE floor({_u("'ans'", 'id', 2)} * 8)::INT
    WHEN 0 THEN 'Probability: ' || round({_u("'ans'", 'id', 1)}, 3)
    WHEN 1 THEN 'about ' || round({_u("'ans'", 'id', 1)} * 120, 1) || '%'
    WHEN 2 THEN 'PRED: ' || round({_u("'ans'", 'id', 1)}, 2) || ' CONF: ' || round({_u("'ans'", 'id', 3)}, 2) || ' ROUTE: ' || CASE WHEN {_u("'ans'", 'id', 4)} < 0.5 THEN 'defer' ELSE 'SELF' END
    WHEN 3 THEN 'between 3 and -' || round({_u("'ans'", 'id', 1)} * 120, 1) || ' or 0.25.'
    WHEN 4 THEN '["' || substr(md5(id), 1, 3) || '", "tp53"]'
    WHEN 5 THEN '```' || chr(10) || 'CD8A, GZMB' || chr(10) || substr(md5(id), 1, 4) || ', too long a marker name' || chr(10) || '```'
    WHEN 6 THEN 'UNKNOWN' ELSE 'Answer 12, then 0.4 and ' || round({_u("'ans'", 'id', 1)} * 120, 1) END AS answer FROM conv)"""
