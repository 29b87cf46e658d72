"""Clustering of sequences in linear time: k-mers propose centres, alignments confirm them, the longest go first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.alignment import code_points, extended, may_match, smallest_kmers
from plumbline.sources.staging import staged

HOT_KEYS = 50_000  # at most so many k-mers, or digests, are broadcast
COPIES = 32  # of a centre's sequence, at most, for its members to meet in as many tasks
SLICE = 1 << 22  # bytes of a batch's sequences that are held as Python's own at once, or one row's


def sliced(batch: pa.RecordBatch, *texts: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts have about SLICE bytes; so a task's memory doesn't grow with how full its batches are."""
    upto = np.zeros(batch.num_rows, np.int64)
    for c in texts:
        upto += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    ends = [*(np.flatnonzero(np.diff(np.cumsum(upto) // SLICE)) + 1).tolist(), batch.num_rows]
    for start, end in zip([0, *ends], ends, strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def _kmers(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in sliced(whole, "seq")):
        yield _kmers_of(batch, k, m)


def _kmers_of(batch: pa.RecordBatch, k: int, m: int) -> pa.RecordBatch:
    """Of one slice; its texts go before the next slice's are made."""
    texts = [t or "" for t in batch.column("seq").to_pylist()]
    parts = [smallest_kmers(t, k, m) for t in texts]
    times = np.array([len(h) for h, _ in parts])
    of = pa.array(np.repeat(np.arange(len(texts)), times))
    size = np.repeat(np.array([len(t) for t in texts], np.int64), times)
    hashes, places = (np.concatenate([p[j] for p in parts]) for j in range(2))
    return pa.RecordBatch.from_arrays([batch.column("id").take(of), pa.array(size), pa.array(hashes), pa.array(places)], ["id", "n", "kmer", "at"])


def kmer_members(sequences: DataFrame, k: int, m: int) -> DataFrame:
    """id, n (characters), kmer, at: the m smallest k-mer hashes of each sequence, and where they first stand."""
    rows = sequences.select("id", "seq")
    return rows.mapInArrow(lambda batches: _kmers(batches, k, m), f"id {rows.schema['id'].dataType.simpleString()}, n bigint, kmer bigint, at bigint")


def _met(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with a table of one row a key, whose column ``times`` says how many rows have it.

    Keys of very many rows are at most HOT_KEYS; they are joined by broadcast, so no task gets all rows of one.
    """
    every = table.agg(F.sum("times")).first()[0] or 0
    hot = F.col("times") > max(10_000, every // HOT_KEYS)
    return rows.join(F.broadcast(table.where(hot)), key).unionByName(rows.join(table.where(~hot), key))


def copies_of(sequences: DataFrame) -> DataFrame:
    """id, first: the smallest id that has the same sequence; none for null and empty ones."""
    own = staged(sequences.where(F.length("seq") > 0).select("id", F.sha2("seq", 256).alias("digest")), "digests")
    firsts = staged(own.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("times")), "firsts")
    return _met(own, firsts, "digest").select("id", "first")


def candidates(kmers: DataFrame, cover: float = 0.0) -> DataFrame:
    """member, centre, n_centre, at, at_centre: each k-mer's longest sequence is centre to the others that have it.

    Pairs are (member, centre) only, so there are at most m for a sequence; those whose lengths alone keep one from covering
    the other are left out.  The place is of the first k-mer on the diagonal that most shared k-mers lie on.
    """
    first = F.min_by(F.struct("id", "at", "n"), F.struct(-F.col("n"), F.col("id")))
    centres = staged(kmers.groupBy("kmer").agg(first.alias("c"), F.count("*").alias("times")).where("times > 1"), "centres")
    met = _met(kmers, centres, "kmer").where((F.col("id") != F.col("c.id")) & (F.col("n") >= cover * F.col("c.n")))
    met = met.select(F.col("id").alias("member"), F.col("c.id").alias("centre"), F.col("c.n").alias("n_centre"), "at", F.col("c.at").alias("at_centre"))
    pair, diagonal = ["member", "centre", "n_centre"], F.col("at") - F.col("at_centre")
    lines = met.groupBy(*pair, diagonal.alias("diagonal")).agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = lines.groupBy(*pair).agg(F.min_by(F.struct("at", "diagonal"), F.struct(-F.col("n"), F.abs("diagonal"), F.col("diagonal"))).alias("p"))
    return best.select(*pair, F.col("p.at").alias("at"), (F.col("p.at") - F.col("p.diagonal")).alias("at_centre"))


def _aligned(batches: Iterator[pa.RecordBatch], identity: float, cover: float, band: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in sliced(whole, "a", "b")):
        yield _aligned_of(batch, identity, cover, band)


def _aligned_of(batch: pa.RecordBatch, identity: float, cover: float, band: int) -> pa.RecordBatch:
    """Of one slice; its texts go before the next slice's are made."""
    a, b = ([code_points(t) for t in batch.column(c).to_pylist()] for c in "ab")
    rows = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if may_match(x, y, identity, cover)]
    places = (batch.column(c).to_numpy()[rows] for c in ("at", "at_centre"))
    found = extended([a[k] for k in rows], [b[k] for k in rows], *places, band, identity)
    kept = batch.select(["member", "centre", "n_centre"]).take(pa.array(rows, pa.int64()))
    scores = [pa.array(c) for c in np.ascontiguousarray(found.T)]
    return pa.RecordBatch.from_arrays([*kept.columns, *scores], ["member", "centre", "n_centre", "identity", "cover_member", "cover_centre"])


def confirmed(pairs: DataFrame, sequences: DataFrame, identity: float, cover: float, band: int) -> DataFrame:
    """member, centre, n_centre, identity, cover_member, cover_centre of the pairs whose alignment reaches both bounds.

    A centre of many members has its sequence in up to COPIES rows, so its pairs are aligned in as many tasks.
    """
    dealt = pairs.withColumn("copy", F.pmod(F.xxhash64("member"), F.lit(COPIES)))
    copies = dealt.select("centre", "copy").distinct().join(sequences.select(F.col("id").alias("centre"), F.col("seq").alias("b")), "centre")
    both = dealt.join(sequences.select(F.col("id").alias("member"), F.col("seq").alias("a")), "member")
    both = both.join(copies, ["centre", "copy"]).select("member", "centre", "n_centre", "at", "at_centre", "a", "b")

    kind = pairs.schema["member"].dataType.simpleString()
    out = both.mapInArrow(lambda batches: _aligned(batches, identity, cover, band), f"member {kind}, centre {kind}, n_centre bigint, identity double, cover_member double, cover_centre double")
    return out.where((F.col("identity") >= identity) & (F.col("cover_member") >= cover) & (F.col("cover_centre") >= cover))


def longest_first(links: DataFrame) -> DataFrame:
    """member, centre of those that join a cluster: a sequence is a representative unless one of its centres is.

    Every centre is longer than its member, or as long with a smaller id, so rounds decide all: one whose centres are
    decided is decided.  There are as many rounds as the longest chain of centres has links, few with real sequences.
    Those still undecided are all that a round reads.
    """
    members = links.select("member").distinct()
    decided = staged(links.select(F.col("centre").alias("id")).distinct().join(members, F.col("id") == F.col("member"), "left_anti").select("id", F.lit(True).alias("rep")), "representatives")
    waiting = links
    while not waiting.isEmpty():
        seen = waiting.join(decided.select(F.col("id").alias("centre"), "rep"), "centre", "left")
        state = seen.groupBy("member").agg(F.coalesce(F.bool_or("rep"), F.lit(False)).alias("joins"), F.count_if(F.col("rep").isNull()).alias("open"))
        new = state.where("joins or open = 0").select(F.col("member").alias("id"), (~F.col("joins")).alias("rep"))
        decided = staged(decided.unionByName(new), "representatives")
        waiting = staged(waiting.join(decided.select(F.col("id").alias("member")), "member", "left_anti"), "undecided")
    reps = decided.where("rep").select(F.col("id").alias("centre"))
    return links.join(reps, "centre").join(reps.select(F.col("centre").alias("member")), "member", "left_anti")


def clustered(sequences: DataFrame, *, k: int = 12, m: int = 20, identity: float = 0.9, cover: float = 0.8, band: int = 16) -> DataFrame:
    """Every id with its cluster's representative and the identity of the alignment with it (1 for itself).

    sequences: id, seq; ids differ.  Each gives the m smallest hashes of its k-mers; the longest sequence with a k-mer, of
    equally long ones that of the smallest id, is the only one compared with the others.  Their best alignment from a common
    k-mer on, within ``band`` diagonals of it, must have at most 1 - ``identity`` errors per aligned character and cover the
    share ``cover`` of both.  Equal sequences are compared once.  Going from the longest sequence down, one becomes a
    representative unless a confirmed centre of it is one; it joins the longest such.  Null and empty sequences are clusters
    of their own.
    """
    copies = staged(copies_of(sequences), "copies")
    kmers = kmer_members(sequences, k, m).join(copies.where("id = first").select("id"), "id", "left_semi")
    pairs = staged(candidates(staged(kmers, "kmers"), cover), "pairs")  # few, then texts come to them without a shuffle
    links = staged(confirmed(pairs, sequences, identity, cover, band), "links")
    own = longest_first(links).groupBy("member").agg(F.min_by(F.struct("centre", "identity"), F.struct(-F.col("n_centre"), F.col("centre"))).alias("to"))
    first = copies.join(own, F.col("first") == F.col("member"), "left")
    first = first.select("id", F.coalesce("to.centre", "first").alias("representative"), F.coalesce("to.identity", F.lit(1.0)).alias("identity"))
    rest = sequences.where(F.coalesce(F.length("seq"), F.lit(0)) == 0).select("id", F.col("id").alias("representative"), F.lit(1.0).alias("identity"))
    return first.unionByName(rest)
