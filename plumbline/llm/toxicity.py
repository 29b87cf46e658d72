"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary documents and one on windows of toxic documents.
A text is read in short windows of whole words; each is compressed with the ordinary dictionary alone and with the
toxic one behind it, and its gain is the bytes by which the second is shorter.  Both sides know ordinary text equally
well that way, so a gain is due to what only toxic text has.  A logistic curve over a text's gains is the score.

Toxic documents are mostly ordinary text, which would fill their dictionary.  So it is trained in rounds: the toxic
documents are halved, each half's dictionary compresses the other half's windows, and only windows that gain are
samples of the next round, without the words at either end that add nothing.  How many rounds and bytes are best, and
the curve, are decided on documents that no dictionary has seen.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_CHARS = 48
ORDINARY_BYTES = 65536
ROUND_BYTES = 4096  # of the toxic dictionary while its samples are chosen
TOXIC_BYTES = (1024, 1536)
ROUNDS = 5
SHARE = 0.03  # of windows that one round passes to the next at most, but for ties
LEAST_GAIN = 4  # bytes, of a window that is passed on
MUCH = (3, 5, 7)  # bytes; windows that gain as much are counted
TOP = 4
FEATURES = TOP + len(MUCH) + 1
COPIES = (1, 4, 16, 64)  # of the samples, tried in turn
# segment and match lengths that the trainer looks for: word sequences at first, parts of words once samples are few
COARSE, FINE = {"k": 16, "d": 8}, ({"k": 6, "d": 6}, {"k": 8, "d": 6})
# tables for all positions of the dictionaries and an optimal parse: which matches are found then doesn't depend on chance
SEARCH = {"strategy": zstandard.STRATEGY_BTOPT, "hash_log": 17, "chain_log": 18, "window_log": 18, "search_log": 5, "min_match": 3}


def windows(text: str) -> list[bytes]:
    """The text, lower-cased, in runs of whole words of about WINDOW_CHARS characters; long words are split."""
    return [w.encode("utf-8", "replace") for w in re.findall(rf"\S.{{0,{WINDOW_CHARS - 2}}}(?!\S)|\S{{1,{WINDOW_CHARS}}}", " ".join(text.lower().split()))]


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # of the features, and a constant


@lru_cache(maxsize=8)
def _compress(content: bytes):
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(write_content_size=False, write_dict_id=False, **SEARCH)
    dictionary.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how).compress


def lengths(parts: list[bytes], content: bytes) -> np.ndarray:
    """Bytes of each window when compressed with this dictionary."""
    compress = _compress(content)
    return np.fromiter((len(compress(p)) for p in parts), np.float64, len(parts))


def gains(parts: list[bytes], toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Bytes that each window is shorter with the toxic dictionary behind the ordinary one."""
    return lengths(parts, ordinary) - lengths(parts, ordinary + toxic)


def features(gain: np.ndarray) -> np.ndarray:
    """Of a text: its largest gains, how many windows gain much, and how many windows there are."""
    top = np.zeros(TOP)
    best = np.sort(gain)[::-1][:TOP]
    top[: len(best)] = best
    return np.array([*top, *(np.log1p((gain >= m).sum()) for m in MUCH), np.log1p(len(gain))])


def _curve(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def score_text(text: str | None, model: ToxicityModel) -> float:
    return float(_curve(features(gains(windows(text or ""), model.toxic, model.ordinary)), np.array(model.weights)))


def train(parts: list[bytes], size: int, how: dict[str, int]) -> bytes:
    """A dictionary trained on these samples; where they are too few for it, on each of them as often as it takes.

    Samples of a few bytes, which no number of copies makes enough, are its content themselves.
    """
    for times in COPIES:
        try:
            return zstandard.train_dictionary(size, parts * times, **how).as_bytes()
        except zstandard.ZstdError:
            continue
    return b" ".join(parts)[-size:] or b" " * 8


def _distinct(texts: list[str]) -> list[bytes]:
    return list(dict.fromkeys(w for t in texts for w in windows(t)))


def core(window: bytes, gain: float, ordinary: bytes, both: bytes) -> bytes:
    """The window without words at either end that add no more than a byte to its gain."""
    plain, with_toxic, words = _compress(ordinary), _compress(both), window.split(b" ")
    for end in (0, -1):
        while len(words) > 1:
            rest = words[1:] if end == 0 else words[:-1]
            left = b" ".join(rest)
            if len(plain(left)) - len(with_toxic(left)) < gain - 1:
                break
            words = rest
    return b" " + b" ".join(words) + b" "


def samples(toxic: list[str], ordinary: bytes, how: dict[str, int]) -> list[list[bytes]]:
    """By round, the windows of these texts that a toxic dictionary is to be trained on."""
    halves = [_distinct(toxic[::2]), _distinct(toxic[1::2])]
    seen = set(halves[0])
    halves[1] = [w for w in halves[1] if w not in seen]
    plain, chosen, out = [lengths(h, ordinary) for h in halves], halves, []
    for r in range(ROUNDS):
        other = [train(h, ROUND_BYTES, how if r else COARSE) for h in chosen[::-1]]
        gain = [p - lengths(h, ordinary + d) for h, p, d in zip(halves, plain, other, strict=True)]
        cuts = [max(LEAST_GAIN, np.sort(g)[::-1][int(len(g) * SHARE)] if len(g) else 0) for g in gain]
        chosen = [[core(w, x, ordinary, ordinary + d) for w, x in zip(h, g, strict=True) if x >= cut] for h, g, cut, d in zip(halves, gain, cuts, other, strict=True)]
        out.append(chosen[0] + chosen[1])
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights and constant by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """Learn from labelled texts.  Without an example of either class every score is the share of toxic ones."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return ToxicityModel(b"-" * 16, b"-" * 16, (*[0.0] * FEATURES, float(np.log(share / (1 - share)))))
    bad = [t for t, x in zip(texts, y, strict=True) if x]
    good = [t for t, x in zip(texts, y, strict=True) if not x]
    ordinary = train(_distinct(good[::2]), ORDINARY_BYTES, COARSE)
    # every third toxic document and every other ordinary one is held back from the dictionaries
    learn, held = [t for k, t in enumerate(bad) if k % 3 != 2], bad[2::3] or bad
    unseen = [windows(t) for t in [*held, *(good[1::2] or good)]]
    label = np.arange(len(unseen)) < len(held)
    plain = [lengths(w, ordinary) for w in unseen]
    best = (-np.inf, b"", np.zeros(FEATURES + 1))
    for how in FINE:
        for parts in samples(learn, ordinary, how)[1:]:
            for size in TOXIC_BYTES:
                content = train(parts, size, how)
                x = np.array([features(p - lengths(w, ordinary + content)) for w, p in zip(unseen, plain, strict=True)])
                weights = _logistic(x, label.astype(float))
                p = _curve(x, weights)
                fitted = float(np.log(np.where(label, p, 1 - p)).sum())
                best = max(best, (fitted, content, weights), key=lambda b: b[0])
    return ToxicityModel(best[1], ordinary, tuple(map(float, best[2])))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, max_chars: int, id_col: str, text_col: str) -> tuple[list[str], list[int]]:
    """The texts of at most ``per_class`` labelled ids of each class, in hash order, without those over ``max_chars``."""
    named = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    open_to_learn = named.where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    drawn = [open_to_learn.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    # at most 2 * per_class ids are broadcast, and as many texts of bounded length reach the driver
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= max_chars)
    found = texts.join(F.broadcast(drawn[0].union(drawn[1])), "id").dropDuplicates(["id", "toxic"]).limit(2 * per_class).collect()
    rows = sorted(found, key=lambda r: (zlib.crc32(str(r.id).encode()), r.id, r.toxic))
    return [r.text for r in rows], [r.toxic for r in rows]


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    *,
    threshold: float = 0.7,
    per_class: int = 2500,
    max_chars: int = 8000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with score, held_out and predicted added: whole texts, any length.

    The model learns from at most ``per_class`` labelled documents of each class of up to ``max_chars``
    characters, never from those whose crc32(id) mod 3 is 1 (held_out).  predicted is 1 from ``threshold`` up.  A
    null or blank text gets the score of a text without windows.  Repeated rows are each scored; a document with no
    label is scored too.  Without labels of both classes, scores are the share of toxic labels.
    """
    model = fit(*labelled_sample(docs, labels, per_class, max_chars, id_col, text_col))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: score_text(t, model)).astype("float64")

    return docs.withColumns(
        {
            "held_out": F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1,
            "score": score(F.col(text_col)),
        }
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, held_out, score and predicted of every document; see score_documents.  Clashing column names are dropped."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    named = labels.select(F.col(id_col).alias("doc_id"), "toxic")
    return score_documents(plain, named, **options).select(F.col("doc_id").alias(id_col), "held_out", "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their own columns."""
    named = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in named]).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = score_documents(held, labels.select(F.col(id_col).alias("doc_id"), "toxic"), **options)
    return scored.where(F.col("predicted") == 0).select(*[F.col(f"row.`{c}`").alias(c) for c in named])
