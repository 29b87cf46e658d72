"""Benchmark decontamination by winnowing.

A fingerprint is the smallest hash of GRAM consecutive words in each window of GUARANTEE - GRAM + 1 such hashes.
Any span of GUARANTEE words that a document shares with a benchmark item has the same window in both, hence a
common fingerprint.  Fingerprints of documents and items are joined, and each hit is extended word by word as far
as a shared span through it can reach; spans of GUARANTEE words or more, or of a whole shorter item, are
contamination.  Items shorter than GUARANTEE have no window; they are found by the hash of their first words, at most
GRAM, wherever it stands in a document.

All of it is built-in functions: a document's words stay in its row, and only fingerprints that the benchmark may have,
with the few words around them, leave it.  What it may have is told by the values themselves, if they are few, else by a
map of MAP_SLOTS bytes; the join decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.storage import collected, written

GUARANTEE = 10
GRAM = 5
HASHES = GUARANTEE - GRAM + 1
AROUND = GUARANTEE - GRAM
FILTER_FINGERPRINTS = 20_000
MAP_SLOTS = 1 << 20
BROADCAST_BYTES = 32_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """The words of a text: runs of 0-9, a-z and characters beyond ASCII, after lower-casing A-Z; none of null."""
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def gram_hashes(words: Column, n: int) -> Column:
    """A hash of every ``n`` consecutive words."""
    every = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))
    return F.when(F.size(words) >= n, every).otherwise(F.array().cast("array<bigint>"))


def window_minima(hashes: Column) -> Column:
    """The smallest hash of each window, by its first position; a shorter array is one window."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - (HASHES - 1), F.lit(1)))
    return F.transform(starts, lambda j: F.array_min(F.slice(hashes, j, F.lit(HASHES))))


def chosen(hashes: Column, minima: Column, i: Column) -> Column:
    """Whether hash ``i`` (from 0) is the smallest of a window that holds it."""
    first = F.greatest(i - (HASHES - 1), F.lit(0))
    return F.exists(F.slice(minima, first + 1, i - first + 1), lambda m: m == F.get(hashes, i))


def chosen_alone(hashes: Column, i: Column) -> Column:
    """The same from the hashes around ``i``, for where few positions are asked about."""
    last = F.greatest(F.size(hashes) - HASHES, F.lit(0))
    starts = F.sequence(F.greatest(i - (HASHES - 1), F.lit(0)), F.least(i, last))
    return F.exists(starts, lambda j: F.array_min(F.slice(hashes, j + 1, F.lit(HASHES))) == F.get(hashes, i))


def _positions(hashes: Column) -> Column:
    return F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1)).otherwise(F.array().cast("array<int>"))


def _around(words: Column, at: Column) -> tuple[Column, Column]:
    """How many words before ``at`` are given, and they with those from ``at`` on that a shared span may need."""
    before = F.least(at, F.lit(AROUND))
    return before, F.slice(words, at - before + 1, before + GUARANTEE)


def benchmark_fingerprints(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """gram, fp, item_size, item_before, item_near, items: where items of the same words around it have a fingerprint.

    gram is GRAM for items of GUARANTEE words or more.  For the start of shorter ones it is less than 0, the words
    hashed being its magnitude.
    """
    words = items.select(F.col(id_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    long = words.where(F.size("w") >= GUARANTEE).withColumn("hashes", gram_hashes(F.col("w"), GRAM)).withColumn("minima", window_minima(F.col("hashes")))
    long = long.withColumn("at", F.explode(F.filter(_positions(F.col("hashes")), lambda i: chosen(F.col("hashes"), F.col("minima"), i))))
    long = long.select(F.lit(GRAM).alias("gram"), F.get("hashes", F.col("at")).alias("fp"), "item", "w", "at")
    short = words.where(F.size("w") < GUARANTEE).withColumn("n", F.least(F.size("w"), F.lit(GRAM)))
    short = short.select((-F.col("n")).alias("gram"), F.xxhash64(F.slice("w", F.lit(1), F.col("n"))).alias("fp"), "item", "w", F.lit(0).alias("at"))
    marks = long.unionByName(short)
    before, near = _around(F.col("w"), F.col("at"))
    # a longer item is long enough, whatever its length
    marks = marks.select("gram", "fp", F.least(F.size("w"), F.lit(GUARANTEE)).alias("item_size"), before.alias("item_before"), near.alias("item_near"), "item")
    return marks.groupBy("gram", "fp", "item_size", "item_before", "item_near").agg(F.collect_set("item").alias("items"))


def _may_hold(values: list[int]):
    """Whether a hash is one of these, or may be if they are many."""
    if len(values) <= FILTER_FINGERPRINTS:
        return lambda h: h.isin(values)
    slots = bytearray(MAP_SLOTS)
    for v in values:
        slots[v % MAP_SLOTS] = 1
    return lambda h: F.substring(F.lit(bytes(slots)), F.pmod(h, F.lit(MAP_SLOTS)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")


def _hits(words: Column, hashes: Column, gram: int, may_hold, minima: Column | None) -> Column:
    """gram, fp, at, before, near: of the positions whose fingerprints go into the join."""

    def goes(i: Column) -> Column:
        held = may_hold(F.get(hashes, i))
        if gram < 0:
            return held
        return held & (chosen_alone(hashes, i) if minima is None else chosen(hashes, minima, i))

    def around(i: Column) -> Column:
        before, near = _around(words, i)
        return F.struct(F.lit(gram).alias("gram"), F.get(hashes, i).alias("fp"), i.alias("at"), before.alias("before"), near.alias("near"))

    return F.transform(F.filter(_positions(hashes), goes), around)


def _run(pairs: Column) -> Column:
    """How many of these booleans are true before the first that isn't."""
    at = F.array_position(pairs, False)
    return F.when(at > 0, at - 1).otherwise(F.size(pairs)).cast("int")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Every row's id, n_words, n_hit, n_items, items_sha256 and contaminated.

    A window is GUARANTEE consecutive words of an item; an item of fewer words, but not none, is one window.  n_hit
    counts the document's words inside any occurrence of a window, n_items the items that occur, items_sha256 is
    the hex digest of their ids, sorted as strings and comma-joined (of nothing, if none).  Null texts have no
    words.  Words of an item without an id are hit, but it is no item to count.  Rows that repeat an id and a text give
    that many equal rows.  Empty tables give no hits or no rows.
    """
    marks = written(benchmark_fingerprints(items, item_col, item_text_col), "benchmark")
    size = F.octet_length(F.array_join("item_near", " ")) + F.octet_length(F.array_join("items", " ")) + 16 * F.size("items") + 300
    weight = marks.agg(F.sum(size)).first()[0] or 0
    grams = [r.gram for r in marks.select("gram").distinct().collect()]  # GRAM + 1 at most

    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), word_array(F.col(text_col)).alias("words"))
    for width in sorted({abs(g) for g in grams}):
        text = text.withColumn(f"hashes{width}", gram_hashes(F.col("words"), width))
    hits = []
    for gram in sorted(grams):
        hashes = F.col(f"hashes{abs(gram)}")
        values = collected(marks.where(F.col("gram") == gram).select("fp").distinct())["fp"].tolist()
        minima = None
        if gram > 0 and len(values) > FILTER_FINGERPRINTS:
            text = text.withColumn("minima", window_minima(hashes))
            minima = F.col("minima")
        hits.append(_hits(F.col("words"), hashes, gram, _may_hold(values), minima))
    head = F.array(F.struct(F.lit(0).alias("gram"), F.xxhash64("id", "text_key").alias("fp"), F.lit(0).alias("at"), F.lit(0).alias("before"), F.array().cast("array<string>").alias("near")))
    found = text.select("id", "text_key", F.size("words").alias("n_words"), F.explode(F.concat(head, *hits)).alias("hit")).select("id", "text_key", "n_words", "hit.*")

    met = found.join(F.broadcast(marks) if weight <= BROADCAST_BYTES else marks, ["gram", "fp"], "left").where("gram = 0 or item_size is not null")
    at, before, item_before = F.col("at"), F.col("before"), F.col("item_before")
    behind = F.least(before, item_before)
    left = _run(F.transform(F.sequence(F.lit(1), behind), lambda k: F.get("near", before - k) == F.get("item_near", item_before - k)))
    left = F.when(behind > 0, left).otherwise(0)
    ahead = F.least(F.size("near") - before, F.size("item_near") - item_before)
    right = _run(F.transform(F.sequence(F.lit(0), ahead - 1), lambda k: F.get("near", before + k) == F.get("item_near", item_before + k)))
    is_mark = F.col("item_size").isNotNull()
    spans = met.withColumn("left", F.when(is_mark, left)).withColumn("right", F.when(is_mark, right))
    shared = F.col("left") + F.col("right") >= F.col("item_size")
    span = F.struct((at - F.col("left")).alias("a"), (at + F.col("right")).alias("z"))
    by_doc = spans.groupBy("id", "text_key").agg(
        F.first("n_words").cast("long").alias("n_words"),
        F.sum((F.col("gram") == 0).cast("int")).alias("copies"),
        F.sort_array(F.collect_set(F.when(shared, span))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(shared, F.col("items")))))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("z")),
        lambda t, s: F.struct(
            (t["n"] + F.greatest(s["z"] - F.greatest(s["a"], t["z"]), F.lit(0))).alias("n"), F.greatest(t["z"], s["z"]).alias("z")
        ),
        lambda t: t["n"].cast("long"),
    )
    return (
        by_doc.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            F.col("id").alias(id_col),
            "n_words",
            covered.alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows of ``docs`` that share no window with an item, with their own columns.  Rows that share an id go together."""
    dropped = contamination(docs, items, id_col=id_col, text_col=text_col, **columns).where("contaminated").select(id_col).distinct()
    return docs.join(dropped, id_col, "left_anti").select(docs.columns)
