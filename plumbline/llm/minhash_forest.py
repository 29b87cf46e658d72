"""Near-duplicate documents by MinHash, with an LSH forest.

A document is its set of shingles.  Each tree of the forest orders documents by a signature of its own, a sequence
of minimum hashes; documents whose signatures share a long prefix stand next to each other.  A document's
candidates in a tree are its neighbours in that order, as long as they share LEAST_DEPTH values: in a sparse region
everything down to that depth, in a crowded one only the deepest matches.  Trees differ, so one that crowds a pair
apart is made up for by others.  This is done twice: first next neighbours only are compared, which joins the
members of crowded regions to one another; then all rows that share LEAST_DEPTH values, only across components, so
that no link is confirmed that changes nothing.  Beside the order's own values a row carries two bits of every minimum
hash, by which most unlike neighbours are told apart where they stand.

Where more than REACH rows share LEAST_DEPTH values the order hides links, however deep it goes.  Rows of such crowds
are joined exactly instead, on their rarest shingles (``crowd_pairs``): two sets that link share one of them.

Documents of equal sets are one node, so exact copies cost nothing.  Candidates are confirmed on full sets.

The orders are range-partitioned on tree, signature and document, which splits a region of any size; rows at the
ends of partitions are compared again among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.storage import collected, tasks_for, written
from plumbline.llm.words import Words, batches, mix, numbers

SHINGLE = 5
TREES = 20
DEPTH = 6
LEAST_DEPTH = 2
REACH = 64
ORDERED_SHINGLES = 1_000_000  # whose counts in crowds are broadcast; shingles beyond them count as rarer
BLOCK = 4096  # rows of one shingle that are compared with one another
AT_ONCE = 64  # of them, with all the others
HASH_BYTES = 6  # of each shingle in a stored set; sets of a thousand differ by chance once in 10**8 pairs
BROADCAST_IDS = 2_000_000
# Of TREES * DEPTH two-bit values two documents at three quarters share 13 / 16 on average; this is 4.3 standard
# deviations fewer, which one such pair in 10**5 falls short of, and more alike pairs hardly ever.
LEAST_SKETCH = 79

_PERMUTE, _SHIFT = numbers(TREES * DEPTH, 21) | np.uint64(1), numbers(TREES * DEPTH, 22)
_STEP = np.uint64(0xD6E8FEB86659FD93)

DOCUMENT_ROW = "id long, n_shingles long, set_key long, signature binary, sketch binary"
SET_ROW = "id long, set_key long, shingles binary"


def shingle_sets(w: Words) -> Iterator[np.ndarray]:
    """Of each text, the distinct 64-bit hashes of its shingles in order; of fewer words, that of them all."""
    h = w.hash
    run = h.copy()
    for k in range(1, SHINGLE):
        run[: len(h) - k] = run[: len(h) - k] * _STEP + h[k:]
    run = mix(run)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(run[a : b - SHINGLE + 1])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = one * _STEP + x
            yield mix(one)
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(len(_PERMUTE), np.uint32(0xFFFFFFFF))
    for k in range(0, len(shingles), 4096):
        x = shingles[k : k + 4096, None] * _PERMUTE + _SHIFT
        np.minimum(least, (x >> np.uint64(32)).astype(np.uint32).min(axis=0), out=least)
    return least


def sketch(least: np.ndarray) -> bytes:
    """The lowest two bits of each value, four to a byte."""
    four = (least & np.uint32(3)).astype(np.uint8).reshape(-1, 4)
    return (four << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()


# how many of the four values in a byte are equal, by the difference of two bytes
_EQUAL = np.array([sum((x >> k & 3) == 0 for k in (0, 2, 4, 6)) for x in range(256)], np.uint8)


def _key(shingles: np.ndarray) -> int:
    """Of a set: equal for equal sets, and for others once in 2**64 pairs."""
    return int(shingles.sum(dtype=np.uint64).view(np.int64))


def _describe(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in rows:
        ids = batch["id"].tolist()
        for at, w in batches(batch["text"].tolist()):
            out = []
            for i, s in enumerate(shingle_sets(w)):
                least = signature(s)
                out.append((ids[at + i], len(s), _key(s), *((least.astype(">u4").tobytes(), sketch(least)) if len(s) else (None, None))))
            yield pd.DataFrame(out, columns=["id", "n_shingles", "set_key", "signature", "sketch"]).astype({"id": "Int64"})


def _sets(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in rows:
        ids = batch["id"].tolist()
        for at, w in batches(batch["text"].tolist()):
            out = [(ids[at + i], _key(s), s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()) for i, s in enumerate(shingle_sets(w))]
            yield pd.DataFrame(out, columns=["id", "set_key", "shingles"])


def _values(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), ">u4").reshape(-1, DEPTH)


def _blocks(rows: pd.DataFrame) -> np.ndarray:
    """Numbers of the runs of sorted rows that share a tree and LEAST_DEPTH values."""
    sig, tree = _values(rows["signature"]), rows["tree"].to_numpy()
    new = (tree[1:] != tree[:-1]) | (sig[1:, :LEAST_DEPTH] != sig[:-1, :LEAST_DEPTH]).any(axis=1)
    return np.concatenate([[0], np.cumsum(new)])


def _crowded(block: np.ndarray, reach: int) -> np.ndarray:
    """Which of these sorted rows stand in a block of more than ``reach`` rows, as far as it is seen here."""
    full = np.zeros(len(block) + 1, np.int64)
    at = np.flatnonzero(block[reach:] == block[:-reach]) if len(block) > reach else np.zeros(0, np.int64)
    np.add.at(full, at, 1)
    np.add.at(full, at + reach + 1, -1)
    return np.cumsum(full)[:-1] > 0


def _pairs(rows: pd.DataFrame, reach: int) -> pd.DataFrame:
    """Likely pairs of different components at most ``reach`` apart in these sorted rows, and in one block.

    If ``reach`` is more than one, rows of crowded blocks make none; each is given out as a pair with itself.
    """
    block, part, node = _blocks(rows), rows["part"].to_numpy(), rows["node"].to_numpy()
    drawn = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
    crowd = _crowded(block, reach) if reach > 1 else np.zeros(len(node), bool)
    found = [np.stack([np.flatnonzero(crowd)] * 2)]
    for k in range(1, min(reach, len(node) - 1) + 1):
        together = block[k:] == block[:-k]
        if not together.any():
            break
        i = np.flatnonzero(together & ~crowd[k:] & ~crowd[:-k] & (part[k:] != part[:-k]))
        i = i[_EQUAL[drawn[i] ^ drawn[i + k]].sum(axis=1, dtype=np.int64) >= LEAST_SKETCH]
        found.append(np.stack([i, i + k]))
    i, j = np.concatenate(found, axis=1)
    a, b = node[i], node[j]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


PAIR_ROW = "a long, b long, tree int, signature binary, part long, sketch binary"


def _in_order(reach: int):
    """Candidates within a sorted partition; then its first and last rows, as a row of its own each."""

    def rows(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, head = None, None
        for batch in batches_:
            if not len(batch):
                continue
            held = batch if held is None else pd.concat([held, batch])
            head = held.iloc[:reach] if head is None else pd.concat([head, held]).drop_duplicates(["tree", "node"]).iloc[:reach]
            yield _pairs(held, reach).assign(tree=-1, signature=None, part=0, sketch=None)
            held = held.iloc[-reach:]
        if held is not None:
            ends = pd.concat([head, held]).drop_duplicates(["tree", "node"])
            yield ends.rename(columns={"node": "a"}).assign(b=ends["node"])[["a", "b", "tree", "signature", "part", "sketch"]]

    return rows


def _at_ends(reach: int):
    def rows(ends: pd.DataFrame) -> pd.DataFrame:
        return _pairs(ends.rename(columns={"a": "node"}).sort_values(["signature", "node"]), reach)

    return rows


def candidates(nodes: DataFrame, reach: int) -> DataFrame:
    """Pairs a < b to confirm, and a = b for nodes of crowds.  nodes: node, signature, sketch, part (its component)."""
    width = 4 * DEPTH
    cut = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("signature", t * width + 1, F.lit(width)))
    orders = nodes.select("node", "part", "sketch", F.posexplode(cut).alias("tree", "signature")).select("tree", "signature", "node", "part", "sketch")
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = orders.repartitionByRange(partitions, "tree", "signature", "node").sortWithinPartitions("tree", "signature", "node")
    found = written(in_order.mapInPandas(_in_order(reach), PAIR_ROW), "forest")
    # at most 2 * reach rows of each partition
    ends = found.where("tree >= 0").groupBy("tree").applyInPandas(_at_ends(reach), "a long, b long")
    return written(found.where("tree < 0").select("a", "b").union(ends).distinct(), "forest-pairs")


def _confirm(percent: int):
    def confirm(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            ok = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                n, m = len(x) // HASH_BYTES, len(y) // HASH_BYTES
                if 100 * min(n, m) < percent * max(n, m):
                    ok.append(False)
                    continue
                both = np.concatenate([np.frombuffer(v, f"V{HASH_BYTES}") for v in (x, y)])
                wide = np.zeros((n + m, 8), np.uint8)
                wide[:, :HASH_BYTES] = both.view(np.uint8).reshape(-1, HASH_BYTES)
                s = np.sort(wide.view("<u8").ravel())
                shared = int((s[1:] == s[:-1]).sum())
                ok.append(100 * shared >= percent * (n + m - shared))
            yield batch.loc[ok, ["a", "b"]]

    return confirm


def _prefix(percent: int, order):
    """Of each set its rarest shingles, as many as two sets that link must share one of.

    at: the shingle's place in the set's order; first: whether it is among those that hold for the smaller of two
    sets.  A shingle of more rows than BLOCK is dealt to blocks of its rows, and each row goes to every two blocks
    that hold its own, x <= y.
    """

    def rows(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, times, whole = order.value
        for batch in (b.iloc[k : k + 512] for b in batches_ for k in range(0, len(b), 512)):
            out = []
            for node, part, data in zip(batch["node"], batch["part"], batch["shingles"], strict=True):
                h = _numbers(data)
                n = len(h)
                k = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                c = np.where(known[k] == h, times[k], 0) if len(known) else np.zeros(n, np.int64)
                rank = np.lexsort((h, c))[: min(n, n - -(-percent * n // 100) + 1)]
                first = np.arange(len(rank)) < n - -(-2 * percent * n // (100 + percent)) + 1
                use = np.flatnonzero(c[rank] > 0) if whole else np.arange(len(rank))  # others are in no other set
                blocks = -(-c[rank] // BLOCK)
                for i in use[blocks[use] > 1]:
                    own, m = node * 0x9E3779B97F4A7C15 % (1 << 64) % int(blocks[i]), int(blocks[i])
                    to = np.arange(m)
                    out.append((np.full(m, h[rank[i]]), np.minimum(own, to), np.maximum(own, to), np.full(m, own), np.full(m, node), np.full(m, part), np.full(m, n), np.full(m, i), np.full(m, first[i])))
                use = use[blocks[use] <= 1]
                zero = np.zeros(len(use), np.int64)
                out.append((h[rank[use]], zero, zero, zero, zero + node, zero + part, zero + n, use, first[use]))
            if out:
                yield pd.DataFrame({name: np.concatenate(x) for name, x in zip(MEET_NAMES, zip(*out, strict=True), strict=True)})

    return rows


MEET_ROW = "shingle long, x int, y int, own int, node long, part long, n int, at int, first boolean"
MEET_NAMES = ["shingle", "x", "y", "own", "node", "part", "n", "at", "first"]


def _numbers(shingles: bytes) -> np.ndarray:
    wide = np.zeros((len(shingles) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(shingles, np.uint8).reshape(-1, HASH_BYTES)
    return wide.view("<i8").ravel()


def _shingle_counts(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in rows:
        h, n = np.unique(np.concatenate([_numbers(x) for x in batch["shingles"]] or [np.zeros(0, np.int64)]), return_counts=True)
        yield pd.DataFrame({"shingle": h, "n": n})


def _meet(percent: int):
    """Pairs of different components among sorted rows of one shingle and two blocks whose sets may be alike enough."""

    def pairs(x: int, y: int, own, node, part, n, at, first) -> Iterator[np.ndarray]:
        left, right = (np.flatnonzero(own == x), np.flatnonzero(own == y))
        for k in range(0, len(left), AT_ONCE):
            i, j = left[k : k + AT_ONCE, None], right[None]
            ok = part[i] != part[j]
            if x == y:
                ok &= i < j
            i, j = (v[s] for v, s in zip((left[k : k + AT_ONCE], right), np.nonzero(ok), strict=True))
            ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            ok &= np.where(n[i] <= n[j], first[i], first[j])
            most = np.minimum(n[i] - at[i], n[j] - at[j])  # shared, if these shingles are the first that are
            ok &= (100 + percent) * most >= percent * (n[i] + n[j])
            a, b = node[i[ok]], node[j[ok]]
            yield np.stack([np.minimum(a, b), np.maximum(a, b)])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows[["shingle", "x", "y"]].to_numpy()
        start = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
        part = rows["part"].to_numpy()
        mixed = np.minimum.reduceat(part, start[:-1]) != np.maximum.reduceat(part, start[:-1])
        columns = [rows[c].to_numpy() for c in ("own", "node", "part", "n", "at", "first")]
        columns[3:5] = [c.astype(np.int64) for c in columns[3:5]]
        found = [np.zeros((2, 0), np.int64)]
        for s, e in zip(start[:-1][mixed], start[1:][mixed], strict=True):
            found.extend(pairs(key[s, 1], key[s, 2], *[c[s:e] for c in columns]))
        a, b = np.concatenate(found, axis=1)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    def meet(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches_:
            if not len(batch):
                continue
            last = (batch[["shingle", "x", "y"]] == batch[["shingle", "x", "y"]].iloc[-1]).all(axis=1).to_numpy()
            begin = len(last) if last.all() else len(last) - int(last[::-1].argmin())
            same = last.all() and (not held or (held[-1][["shingle", "x", "y"]].iloc[-1] == batch[["shingle", "x", "y"]].iloc[-1]).all())
            if same:
                held.append(batch)
                continue
            begin = 0 if last.all() else begin
            yield whole(pd.concat([*held, batch.iloc[:begin]]))
            held = [batch.iloc[begin:]]
        if held:
            yield whole(pd.concat(held))

    return meet


def crowd_pairs(crowd: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Every pair a < b of different components that can link: one of the rarest shingles of either set is shared.

    crowd: node, id, part.  The order of shingles is that of their counts here, so text that a crowd has in common
    comes last and is no reason to compare.  The count of a shingle that isn't broadcast passes for none, which costs
    time only.
    """
    few = crowd.count() <= BROADCAST_IDS
    held = F.broadcast(crowd) if few else crowd
    ids = crowd.select("id").distinct()
    full = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInPandas(_sets, SET_ROW).withColumnRenamed("set_key", "node")
    full = written(full.join(held, ["node", "id"]).dropDuplicates(["node"]).select("node", "part", "shingles"), "forest-crowd")
    counts = written(full.mapInPandas(_shingle_counts, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1"), "forest-shingles")
    # eight bins for each doubling of the count
    of = F.floor(F.log2("n") * 8)
    level, taken, whole = None, 0, True
    for b in counts.groupBy(of.alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect():
        taken += b.n
        if taken > ORDERED_SHINGLES:
            whole = False
            break
        level = b.bin
    often = collected(counts.where(of >= level if level is not None else F.lit(False)))
    order = np.argsort(often["shingle"])
    held = full.sparkSession.sparkContext.broadcast((often["shingle"][order], often["n"][order], whole))
    rows = full.mapInPandas(_prefix(percent, held), MEET_ROW)
    partitions = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(partitions, "shingle", "x", "y").sortWithinPartitions("shingle", "x", "y")
    return sorted_rows.mapInPandas(_meet(percent), "a long, b long")


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by their full sets.  Sets are made again from the texts of documents that have a candidate."""
    n = pairs.count()
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    involved = written(nodes.select("node", "id").join(ends, "node", "left_semi"), "forest-nodes", tasks_for(2 * n))
    few = involved.count() <= BROADCAST_IDS
    ids = involved.select("id").distinct()
    full = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInPandas(_sets, SET_ROW)
    full = full.withColumnRenamed("set_key", "node").join(F.broadcast(involved) if few else involved, ["node", "id"], "left_semi")
    full = written(full.dropDuplicates(["node"]).select("node", "shingles"), "forest-sets", tasks_for(n, 2_000))
    both = pairs.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b")
    return written(both.select("a", "b", "x", "y").mapInPandas(_confirm(percent), "a long, b long"), "forest-links", tasks_for(n, 2_000))


def near_documents(docs: DataFrame, percent: int = 75, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, n_shingles, component_id and kept.

    Documents link if 100 * shared shingles >= percent * all shingles of the two; component_id is the smallest id
    reachable by links, kept says that it is the row's own.  A text of fewer words than a shingle is one shingle; a
    null or blank one has none and links with nothing.  Rows that repeat an id stay separate rows.  A row without
    an id is kept and links with nothing.  An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(texts.mapInPandas(_describe, DOCUMENT_ROW), "documents")
    sets = rows.where("n_shingles > 0 and id is not null")
    nodes = written(
        sets.groupBy(F.col("set_key").alias("node")).agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")),
        "documents-nodes",
    )
    own = F.col("node").alias("part")
    links = confirmed(candidates(nodes.select("node", "signature", "sketch", own), 1), nodes, texts, percent)
    groups = nodes.join(components(links), "node", "left").select("node", "id", "signature", "sketch", F.coalesce("component", "node").alias("part"))
    groups = written(groups, "documents-parts")
    apart = candidates(groups.select("node", "signature", "sketch", "part"), REACH)
    crowd = groups.join(apart.where("a = b").select(F.col("a").alias("node")), "node", "left_semi").select("node", "id", "part")
    in_crowds = crowd_pairs(written(crowd, "forest-crowded"), texts, percent)
    apart = written(apart.where("a < b").union(in_crowds).distinct(), "forest-apart")
    to_part = groups.select("node", "part")
    more = confirmed(apart, nodes, texts, percent).join(to_part.toDF("a", "x"), "a").join(to_part.toDF("b", "y"), "b")
    joined = components(more.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "part")
    groups = groups.select("node", "id", "part").join(joined, "part", "left").select("node", F.coalesce("component", "part").alias("component"), "id")
    least = groups.groupBy("component").agg(F.min("id").alias("component_id"))
    by_set = groups.join(least, "component").select(F.col("node").alias("set_key"), "component_id")
    return (
        rows.select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("set_key")).alias("set_key"))
        .join(written(by_set, "documents-components"), "set_key", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def drop_near_documents(docs: DataFrame, percent: int = 75, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that near_documents keeps, with their own columns.  Rows that share an id go together."""
    dropped = near_documents(docs, percent, id_col=id_col, text_col=text_col).where("not kept").select(id_col).distinct()
    return docs.join(dropped, id_col, "left_anti").select(docs.columns)
