"""Scoring text with a deleted-interpolation model.

The outcomes are the known words, the end of a text, and one for any unknown word.  The context of a token is the word
before it, or the beginning of the text.  Three estimates are mixed:

* the maximum-likelihood probability of the token after its context;
* the maximum-likelihood unigram;
* all mass on the unknown word.

Contexts fall in buckets by their frequency, and each bucket has its own weights.  Counts come from retained
documents; the weights are those that make held-out counts likeliest, found by expectation-maximisation.

All counts of words and of pairs of words are whole-corpus counts, and no table of them is held anywhere whole.  Documents
are dealt to batches of about BATCH_BYTES.  A batch sends its distinct words and pairs, with their numbers, to key
buckets; a bucket adds up what all batches sent, and answers each with the corpus counts of its own keys, in order.  So
one shuffle both counts and asks.  Batches then meet their answers: those of held-out documents give the weights, and
all are scored.  Keys are 40 bits of a hash within their bucket, of which there are more as the corpus grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.storage import written
from plumbline.llm.words import batches, mix

BATCH_BYTES = 6_000_000
BUCKET_BYTES = 20_000_000  # of text, whose words and pairs go to one key bucket
TASK_BYTES = 100_000_000
BUCKETS = 40  # of log2 context frequency
BIN = 0.02  # of log10 ratios of the first two estimates
LEAST_RATIO = 1e-9
ADD = 0.1
END = np.uint64(0)  # stands for the end of a text, and for its beginning as a context; no word's hash but for one chance in 2**64
_STEP = np.uint64(0xD6E8FEB86659FD93)
_KEY_BITS = np.uint64(40)


def split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, part: part 0 is held out of training, 1 sets weights, others give counts, as does a null id."""
    part = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10, F.lit(2)).cast("int")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), part.alias("part"))


def tokens(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: the first one's number, the hashes of all their tokens, and where each text's begin."""
    for at, w in batches(texts):
        n = len(w.first) - 1
        first = w.first + np.arange(n + 1)
        out = np.full(len(w.hash) + n, END, np.uint64)
        word = np.ones(len(out), bool)
        word[first[1:] - 1] = False
        out[word] = w.hash
        yield at, out, first


class Batch:
    """The tokens of some texts, by place among the batch's distinct words and pairs of a context and a word."""

    def __init__(self, texts: list[str | None]):
        hashes, docs, starts, n = [], [], [], 0
        for at, h, first in tokens(texts):
            hashes.append(h)
            docs.append(np.repeat(np.arange(at, at + len(first) - 1), np.diff(first)))
            starts.append(first[:-1] + n)
            n += len(h)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.tokens = np.bincount(self.doc, minlength=len(texts))
        self.words, self.word = np.unique(h, return_inverse=True)
        before = np.roll(h, 1)
        before[start] = END
        self.pairs, self.pair = np.unique(mix(before * _STEP + h), return_inverse=True)
        self.context = np.roll(self.word, 1)
        self.context[start] = np.searchsorted(self.words, END)


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of these keys by bucket and value, where each bucket begins in it, and their values."""
    value = keys & ((np.uint64(1) << _KEY_BITS) - np.uint64(1))
    bucket = (keys >> _KEY_BITS) % np.uint64(buckets)
    order = np.lexsort((value, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)), value[order]


COUNT_BYTES = 6  # of corpus counts: some 10^14; those that are zero for all compress to nothing


def packed(x: np.ndarray, width: int) -> bytes:
    """Whole numbers of so many bytes, the first bytes of all, then the second ones, compressed; larger ones are refused."""
    if len(x) and int(x.max()) >> 8 * width:
        raise OverflowError(f"{int(x.max())} doesn't fit into {width} bytes")
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _steps(values: np.ndarray) -> bytes:
    """Rising values as their differences, which are smaller."""
    return packed(np.diff(values, prepend=np.uint64(0)), 5)


SENT_ROW = "bucket int, batch long, words binary, train binary, kept binary, pairs binary, times binary"


def _sent(buckets: int):
    """A batch's distinct words and pairs by bucket, with their numbers in training and in retained documents."""

    def rows(rows: pd.DataFrame) -> pd.DataFrame:
        b = Batch(rows["text"].tolist())
        part = rows["part"].to_numpy()[b.doc]
        train, kept = (np.bincount(b.word, weights=w, minlength=len(b.words)).astype(np.uint64) for w in (part > 0, part > 1))
        times = np.bincount(b.pair, weights=part > 1, minlength=len(b.pairs)).astype(np.uint64)
        (by_word, first, word), (by_pair, begin, pair) = (dealt(k, buckets) for k in (b.words, b.pairs))
        out = []
        for k in range(buckets):
            w, p = slice(first[k], first[k + 1]), slice(begin[k], begin[k + 1])
            if w.stop > w.start or p.stop > p.start:
                out.append((k, rows["batch"].iloc[0], _steps(word[w]), packed(train[by_word[w]], COUNT_BYTES), packed(kept[by_word[w]], COUNT_BYTES), _steps(pair[p]), packed(times[by_pair[p]], COUNT_BYTES)))
        return pd.DataFrame(out, columns=["bucket", "batch", "words", "train", "kept", "pairs", "times"])

    return rows


ANSWER_ROW = "batch long, bucket int, train binary, kept binary, times binary, all_train long, all_kept long, all_words long"


def _sums(keys: list[np.ndarray], numbers: list[list[np.ndarray]]) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """For each list of numbers of these keys, the sums by key, and each batch's share of them."""
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    cut = np.cumsum([len(k) for k in keys])[:-1]
    sums = [np.bincount(place, weights=np.concatenate(n)).astype(np.uint64) for n in numbers]
    return sums, [np.split(s[place], cut) for s in sums]


def _answers(rows: pd.DataFrame) -> pd.DataFrame:
    """What a bucket tells each batch, and in a row of batch -1 its totals."""
    words, pairs = ([np.cumsum(unpacked(x, 5), dtype=np.uint64) for x in rows[c]] for c in ("words", "pairs"))
    train, kept, times = ([unpacked(x, COUNT_BYTES) for x in rows[c]] for c in ("train", "kept", "times"))
    (all_train, all_kept), (train, kept) = _sums(words, [train, kept])
    _, (times,) = _sums(pairs, [times])
    none = [0] * len(rows)
    out = pd.DataFrame({"batch": rows["batch"], "bucket": rows["bucket"], "train": [packed(x, COUNT_BYTES) for x in train], "kept": [packed(x, COUNT_BYTES) for x in kept], "times": [packed(x, COUNT_BYTES) for x in times], "all_train": none, "all_kept": none, "all_words": none})
    total = (-1, rows["bucket"].iloc[0], None, None, None, int(all_train.sum()), int(all_kept.sum()), int((all_train > 0).sum()))
    return pd.concat([out, pd.DataFrame([total], columns=out.columns)])


def _put_back(keys: np.ndarray, buckets: int, answers: list[bytes]) -> np.ndarray:
    order, _, _ = dealt(keys, buckets)
    out = np.zeros(len(keys))
    out[order] = np.concatenate([unpacked(x, COUNT_BYTES) for x in answers]) if answers else 0
    return out


class Counted(Batch):
    """A batch with the corpus counts of its words and pairs."""

    def __init__(self, texts: pd.DataFrame, answers: pd.DataFrame, buckets: int, n_kept: int):
        super().__init__(texts["text"].tolist())
        answers = answers.sort_values("bucket")
        self.train, self.kept = (_put_back(self.words, buckets, answers[c].tolist()) for c in ("train", "kept"))
        times = _put_back(self.pairs, buckets, answers["times"].tolist())[self.pair]
        seen = self.kept[self.context]
        self.known = self.kept[self.word] > 0
        self.bucket = np.where(seen > 0, np.minimum(BUCKETS - 1, 1 + np.log2(np.maximum(seen, 1)).astype(np.int64)), 0)
        self.unigram = self.kept[self.word] / max(1, n_kept)
        self.ratio = times / np.maximum(seen, 1) / np.where(self.known, self.unigram, 1)  # of the first estimate to the second


def em_weights(high: np.ndarray, low: np.ndarray, count: np.ndarray, group: np.ndarray, groups: int, rounds: int = 60) -> np.ndarray:
    """By group, the weight of ``high`` that makes these counts likeliest under weight * high + (1 - weight) * low.

    A group without counts gets a half.
    """
    weight = np.full(groups, 0.5)
    total = np.bincount(group, weights=count, minlength=groups)
    for _ in range(rounds):
        a, b = weight[group] * high, (1 - weight[group]) * low
        share = np.bincount(group, weights=count * a / np.maximum(a + b, 1e-300), minlength=groups)
        weight = np.where(total > 0, share / np.maximum(total, 1e-300), weight)
    return np.clip(weight, 1e-6, 1 - 1e-6)


def weights_of(sums: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """By bucket, from held-out counts (known, bucket, bin, n): the weight of the unknown word, and that of the first
    estimate among the other two."""
    known = sums[sums["known"].astype(bool)]
    total = np.bincount(sums["bucket"], weights=sums["n"], minlength=BUCKETS)
    new = total - np.bincount(known["bucket"], weights=known["n"], minlength=BUCKETS)
    unknown = (new + 0.5) / (total + 1)
    return unknown, em_weights(10.0 ** (known["bin"].to_numpy(float) * BIN), np.ones(len(known)), known["n"].to_numpy(float), known["bucket"].to_numpy(np.int64), BUCKETS)


def _held_out(buckets: int, n_kept: int):
    """How many tokens of a batch there are of each bucket and ratio of the first two estimates."""

    def rows(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        c = Counted(texts, answers, buckets, n_kept)
        ratio = np.log10(np.maximum(c.ratio, LEAST_RATIO))
        found = pd.DataFrame({"known": c.known, "bucket": c.bucket, "bin": np.where(c.known, np.round(ratio / BIN), 0).astype(np.int64)})
        return found.groupby(["known", "bucket", "bin"], as_index=False).size().rename(columns={"size": "n"})

    return rows


SCORE_ROW = "id long, part int, n_tokens long, n_known long, base_score double, score double"


def _scored(buckets: int, n: int, n_kept: int, v: int, unknown: np.ndarray, follows: np.ndarray):
    def rows(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame(columns=["id", "part", "n_tokens", "n_known", "base_score", "score"])
        c = Counted(texts, answers, buckets, n_kept)
        base = np.log10((c.train + ADD) / (n + ADD * (v + 1)))[c.word]
        mixed = follows[c.bucket] * c.ratio + 1 - follows[c.bucket]
        p = np.where(c.known, (1 - unknown[c.bucket]) * c.unigram * mixed, unknown[c.bucket])
        by_doc = lambda x: np.bincount(c.doc, weights=x, minlength=len(texts))
        return pd.DataFrame(
            {
                "id": texts["id"].astype("Int64"),
                "part": texts["part"],
                "n_tokens": c.tokens,
                "n_known": by_doc((c.train > 0)[c.word]).astype(np.int64),
                "base_score": by_doc(base),
                "score": by_doc(np.log10(p)),
            }
        )

    return rows


def _spread(df: DataFrame, key: str, size: int) -> DataFrame:
    """df dealt by this key to more tasks than the session's number, where that would give a task over TASK_BYTES of text."""
    tasks = 1 + size // TASK_BYTES
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words and one end.  base_score is the log10 probability under add-ADD unigrams of the documents
    whose crc32(id) mod 10 isn't 0; score is that of the mixed model, learned from the same documents; the others are
    held_out.  A null or blank text has its end alone.  Repeated rows are each scored and each counted; a null id counts
    as a training document.  Other columns of ``docs`` are left alone, whatever their names.  An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    parts = split(docs, id_col, text_col)
    of_text = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    sizes = parts.agg(F.sum(of_text).alias("all"), F.sum(F.when(F.col("part") == 1, of_text)).alias("weights")).first()
    size = sizes["all"] or 0
    n_batches = [1 + (part or 0) // BATCH_BYTES for part in (size - (sizes["weights"] or 0), sizes["weights"])]
    buckets = 1 + size // BUCKET_BYTES
    key = F.xxhash64("id", "text")
    # documents that set the weights have batches of their own, so that only they are read for it
    batch = F.when(F.col("part") == 1, n_batches[0] + F.pmod(key, F.lit(n_batches[1]))).otherwise(F.pmod(key, F.lit(n_batches[0])))
    texts = parts.withColumn("batch", batch.cast("long"))

    sent = _spread(texts.select("batch", "text", "part"), "batch", size).groupBy("batch").applyInPandas(_sent(buckets), SENT_ROW)
    answers = written(_spread(sent, "bucket", size).groupBy("bucket").applyInPandas(_answers, ANSWER_ROW), "lm-answers")
    total = answers.where("batch = -1").agg(F.sum("all_train"), F.sum("all_kept"), F.sum("all_words")).first()
    n, n_kept, v = (int(x or 0) for x in total)
    told = _spread(answers.where("batch >= 0").select("batch", "bucket", "train", "kept", "times"), "batch", size)

    held_out = _spread(texts.where("part = 1").select("batch", "text"), "batch", size).groupBy("batch")
    counts = held_out.cogroup(told.where(F.col("batch") >= n_batches[0]).groupBy("batch")).applyInPandas(_held_out(buckets, n_kept), "known boolean, bucket int, bin int, n long")
    sums = counts.groupBy("known", "bucket", "bin").agg(F.sum("n").alias("n")).toPandas()  # buckets times bins at most
    unknown, follows = weights_of(sums)

    score = _scored(buckets, n, n_kept, v, unknown, follows)
    scored = _spread(texts, "batch", size).groupBy("batch").cogroup(told.groupBy("batch")).applyInPandas(score, SCORE_ROW)
    return scored.select(
        F.col("id").alias(id_col),
        (F.col("part") == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
