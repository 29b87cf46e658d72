"""Near-duplicates, decontamination, sharding and line dedup against brute force, on small and odd tables."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components, decontamination, line_dedup, minhash_forest, sharding

DOC = "doc_id long, text string, node string, id string, line int"


def table(spark, texts, extra=("x", "y", 1)):
    """Documents, with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, *extra) for i, t in texts], DOC)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()


def brute_components(texts, percent=75):
    sets = [(i, shingles(t)) for i, t in texts]
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, a) in enumerate(sets):
        for j in range(k):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def near_texts():
    rng = np.random.default_rng(5)
    texts = [(k, sentence(rng, 60)) for k in range(40)]
    base = sentence(rng, 120).split()
    for k in range(40, 100):  # a crowd of near copies
        words = list(base)
        for j in rng.integers(0, 120, 1 + k % 4):
            words[j] = f"new{k}"
        texts.append((k, " ".join(words)))
    texts += [(k, texts[3][1].upper()) for k in range(100, 110)]
    return texts + [(200, None), (201, ""), (202, " \t\n"), (203, "one two"), (204, "one  TWO"), (205, "one"), (206, "É é"), (207, "a " * 3000)]


def test_near_documents_are_those_of_brute_force(spark):
    texts = near_texts()
    out = minhash_forest.near_documents(table(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_pairs_within_a_crowd(spark):
    """Documents of like boilerplate, none of which links with another but for its own partner."""
    rng = np.random.default_rng(8)
    boilerplate, size, pairs = sentence(rng, 124, 10**6), 4000, 100
    own = [sentence(rng, 26, 10**6).split() for _ in range(size)]
    for k in range(pairs):
        own[size - 1 - k][:7] = own[k][:7]
    texts = [(k, f"{boilerplate} {' '.join(w)}") for k, w in enumerate(own)]
    a, b, c = (shingles(texts[k][1]) for k in (0, size - 1, 1))
    assert len(a & b) / len(a | b) > 0.76 and len(a & c) / len(a | c) < 0.71
    out = minhash_forest.near_documents(table(spark, texts)).where("not kept").collect()
    assert {r.doc_id: r.component_id for r in out} == {size - 1 - k: k for k in range(pairs)}


def test_rows_of_one_shingle_in_blocks():
    """Any two rows of different components meet in one pair of blocks, however a shingle's rows are dealt."""
    order = type("Held", (), {"value": (np.array([5]), np.array([3 * minhash_forest.BLOCK]), False)})
    data = np.array([5, *range(10, 13)], "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    rows = pd.concat(minhash_forest._prefix(1, order)(iter([pd.DataFrame({"node": range(60), "part": range(60), "shingles": [data] * 60})])))
    rows = rows[rows["shingle"] == 5].sort_values(["shingle", "x", "y"]).assign(at=0, first=True)
    assert rows["x"].nunique() > 1
    found = pd.concat(minhash_forest._meet(75)(rows.iloc[k : k + 7] for k in range(0, len(rows), 7)))
    assert sorted(zip(found["a"], found["b"], strict=True)) == [(i, j) for i in range(60) for j in range(i + 1, 60)]


def test_near_documents_of_repeated_rows_and_null_ids(spark):
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (None, "a b c d e f")]
    out = minhash_forest.near_documents(table(spark, texts))
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out.collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_empty_tables(spark):
    none = table(spark, [])
    assert minhash_forest.near_documents(none).isEmpty() and sharding.shard(none).isEmpty() and line_dedup.line_dedup(none).isEmpty()
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(none, items).isEmpty()
    one = decontamination.contamination(table(spark, [(1, "a b")]), items).first()
    assert (one.n_words, one.n_hit, one.contaminated) == (2, 0, False)


def test_dropping_keeps_columns(spark):
    docs = table(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)])
    out = minhash_forest.drop_near_documents(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    out = {r.node: r.component for r in components.components(links).collect()}
    assert {out[k] for k in range(61)} == {0} and out[101] == 100


def test_components_of_a_long_chain_in_few_rounds(spark, monkeypatch):
    tables, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name, tasks=None: tables.append(name) or write(df, name, tasks))
    links = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = components.components(links).agg(F.count("*").alias("n"), F.max("component").alias("top")).first()
    assert (out.n, out.top) == (10_001, 0) and tables.count("links-step") < 20


# ---- decontamination --------------------------------------------------------------------------------------------


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(text, items):
    words, hit, found = bench_words(text), set(), set()
    for key, item in items:
        w = bench_words(item)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            for q in range(len(words) - n + 1):
                if words[q : q + n] == w[p : p + n]:
                    hit |= set(range(q, q + n))
                    found.add(str(key))
    return len(words), len(hit), len(found)


@pytest.mark.parametrize("prefilter", [True, False])
def test_contamination_is_that_of_brute_force(spark, monkeypatch, prefilter):
    if not prefilter:
        monkeypatch.setattr(decontamination, "FILTER_FINGERPRINTS", 0)
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(3)
    items = [(k, sentence(rng, 30, 50)) for k in range(6)] + [(10, "Only-three. words"), (11, "lone"), (12, None), (13, "?!"), (14, "un deux trois quatre cinq six sept"), (15, "é à")]
    texts = []
    for k in range(40):
        words = sentence(rng, int(rng.integers(0, 60)), 60).split()
        if k % 3 == 0:
            a = int(rng.integers(0, 12))
            words[5:5] = items[k % 6][1].split()[a : a + int(rng.integers(8, 19))]
        if k % 5 == 0:
            words += ["ONLY", "three", "Words!"]
        if k % 7 == 0:
            words += "un deux trois quatre cinq six sept huit".split()
        texts.append((k, " ".join(words)))
    texts += [(90, None), (91, ""), (92, "lone"), (93, items[0][1] + " " + items[0][1]), (94, "é à"), (95, "É à")]
    out = decontamination.contamination(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in out.collect()}
    assert got == {i: brute_contamination(t, items) for i, t in texts}


def test_repeated_rows_are_kept(spark):
    docs = table(spark, [(1, "x y"), (1, "x y"), (1, "z")])
    out = decontamination.contamination(docs, spark.createDataFrame([(1, "z")], "item_id long, text string"))
    assert sorted((r.n_words, r.n_hit) for r in out.collect()) == [(1, 1), (2, 0), (2, 0)]


# ---- sharding ---------------------------------------------------------------------------------------------------


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        c = (low + high) // 2
        used, load = 1, 0
        for s in sizes:
            used, load = (used + 1, s) if load + s > c else (used, load + s)
        low, high = (low, c) if used <= shards else (c + 1, high)
    return low


@pytest.mark.parametrize(("n", "shards", "bits"), [(300, 7, 2), (300, 7, 14), (50, 24, 3), (5, 24, 14), (1, 3, 1)])
def test_capacity_is_minimal(spark, monkeypatch, n, shards, bits):
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    rng = np.random.default_rng(n)
    sizes = sorted((int(h), int(s)) for h, s in zip(rng.choice(2**40, n, replace=False) << 20, rng.integers(1, 1000, n), strict=True))
    capacity, starts = sharding.minimax_cuts(spark.createDataFrame(sizes, "h long, size long"), shards)
    assert capacity == max(least_capacity([s for _, s in sizes], shards), -(-sum(s for _, s in sizes) // shards))
    loads = Counter()
    for h, s in sizes:
        loads[sum(h >= x for x in starts)] += s
    assert max(loads.values()) <= capacity and len(starts) <= shards


def test_shards(spark):
    rng = np.random.default_rng(1)
    texts = [(k, sentence(rng, int(rng.integers(1, 80)))) for k in range(300)]
    texts += [(k, "copy " * 500) for k in range(300, 420)] + [(500, None), (501, ""), (502, None), (None, "no id"), (3, texts[3][1])]
    out = sharding.shard(table(spark, texts), 5).collect()
    assert len(out) == len(texts)
    for k in range(5):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    assert len({r.shard for r in out if r.doc_id and 300 <= r.doc_id < 420}) == 1
    assert {(r.size, r.text_crc32) for r in out if r.doc_id in (500, 501)} == {(8, 0)}
    by_id = {r.doc_id: r for r in out}
    assert all(by_id[i].size == len(t.encode()) + 8 and by_id[i].text_crc32 == zlib.crc32(t.encode()) for i, t in texts if t)
    loads = Counter()
    for r in out:
        loads[r.shard] += r.size
    rest = sorted(loads.values())[:-1]  # the copies fill one shard
    assert max(rest) < 1.2 * min(rest) and {r.law for r in out} == {"bytes"}


# ---- line dedup -------------------------------------------------------------------------------------------------


def brute_lines(texts):
    first, out = {}, {}
    for i, t in sorted(texts):
        lines = t.split("\n")
        for a, n, chunk in line_dedup.removable(lines):
            first.setdefault(chunk, (i, a, n))
    by_id = {i: t.split("\n") for i, t in texts}
    for i, lines in by_id.items():
        gone = set()
        for a, n, chunk in line_dedup.removable(lines):
            j, b, _ = first[chunk]
            if (i, a) != (j, b):
                low, high, there = a, a + n, by_id[j]
                short = lambda x: len(x.split()) < line_dedup.LONG_LINE
                while a - low < line_dedup.EXTEND and low and b - (a - low) and lines[low - 1] == there[b - (a - low) - 1] and short(lines[low - 1]):
                    low -= 1
                while high - a - n < line_dedup.EXTEND and high < len(lines) and b + high - a < len(there) and lines[high] == there[b + high - a] and short(lines[high]):
                    high += 1
                gone |= set(range(low, high))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_passages_are_removed(spark):
    rng = np.random.default_rng(2)
    passage, block = sentence(rng, 60), [sentence(rng, 8) for _ in range(12)]
    texts = []
    for k in range(60):
        lines = [sentence(rng, int(rng.integers(1, 30))) for _ in range(6)]
        if k % 3 == 0:
            lines.insert(k % 6, passage)
        if k % 5 == 0:
            lines[2:2] = block
        texts.append((k, "\n".join(lines)))
    texts += [(70, ""), (71, "\n\n"), (72, passage), (73, passage + "\n" + passage)]
    out = line_dedup.line_dedup(table(spark, [*texts, (80, None), (None, passage)])).collect()
    got = {r.doc_id: r.text for r in out}
    assert {i: t for i, t in got.items() if i not in (80, None)} == brute_lines(texts)
    assert got[80] is None and got[None] == passage and sum(passage in (t or "") for i, t in got.items() if i is not None) == 1
    assert sum(block[5] in (t or "") for t in got.values()) < 4  # all but lines at the edges of the block go


def test_passages_of_short_lines_are_removed(spark):
    rng = np.random.default_rng(6)
    passages = [[sentence(rng, n, 10**6) for _ in range(-(-50 // n))] for n in (7, 8, 9, 10, 11, 12) for _ in range(6)]
    texts = []
    for k in range(4 * len(passages)):
        lines = [sentence(rng, int(rng.integers(1, 15)), 10**6) for _ in range(12)]
        at = int(rng.integers(0, 13))
        lines[at:at] = passages[k % len(passages)]
        texts.append((k, "\n".join(lines)))
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    for i, t in texts:
        passage = passages[i % len(passages)]
        assert out[i] == [x for x in t.split("\n") if i < len(passages) or x not in passage]


def test_equal_lines_keep_their_first_passage(spark):
    line = "one two three four five six"
    assert line_dedup.line_dedup(table(spark, [(1, "\n".join([line] * 9))])).first().text == f"{line}\n{line}"


def plain_chosen(lines):
    """Window by window, run by run."""
    step, cover = line_dedup._STEP, (1 << 64) - 1
    words = [min(len(x.split()), line_dedup.LONG_LINE + 1) for x in lines]
    starts = [i for i, n in enumerate(words) if n]
    run, rank, out = {}, {}, set()
    for i in starts:
        end = next((e for e in range(i + 1, len(lines) + 1) if line_dedup._worth(e - i, sum(words[i:e]))), None)
        if end:
            h = 0
            for line in lines[i:end]:
                h = (h * step + line_dedup.xxhash.xxh64_intdigest(line.encode())) & cover
            run[i], rank[i] = end, (h * step & cover) ^ ((h * step & cover) >> 29)
    for k, i in enumerate(x for x in starts if x in run):
        at, total = i, 0
        while at < len(lines) and (at < run[i] or total < line_dedup.WINDOW_WORDS and at - i < line_dedup.WINDOW_LINES):
            total += words[at]
            at += 1
        if k and total < line_dedup.WINDOW_WORDS and at - i < line_dedup.WINDOW_LINES:
            break
        best = min((j for j in run if i <= j and run[j] <= at), key=lambda j: (rank[j], j))
        out.add((best, run[best] - best))
    return out


def test_chosen_runs_are_brute_force():
    rng = np.random.default_rng(9)
    for k in range(150):
        lines = [sentence(rng, int(rng.choice([0, 0, 1, 2, 3, 5, 8, 13, 25])), 5 + k) for _ in range(int(rng.integers(1, 60)))]
        assert line_dedup.chosen(lines) == plain_chosen(lines)


@pytest.mark.parametrize("blank", ["", " "])
def test_very_long_texts_take_linear_time(spark, blank):
    passage = [" ".join(f"w{k}x{j}" for j in range(6)) for k in range(12)]
    text = "\n".join(["one two three four five six", *[blank] * 1_000_000, *passage])
    began = time.process_time()
    found = list(line_dedup.removable(text.split("\n")))
    assert time.process_time() - began < 20 and found
    out = line_dedup.line_dedup(table(spark, [(1, text), (2, "\n".join(passage))])).orderBy("doc_id").collect()
    assert out[0].text == text and out[0].n_lines == 1_000_013 and out[1].text == "" and out[1].n_removed_words == 72


def test_chunks_cover_and_resist_shifts():
    rng = np.random.default_rng(4)
    lines = [sentence(rng, int(rng.integers(1, 12))) for _ in range(200)]
    cut = line_dedup.chunks(lines)
    assert [a for a, _ in cut] == list(np.cumsum([0, *(n for _, n in cut)])[:-1]) and sum(n for _, n in cut) == 200
    moved = line_dedup.chunks(["new line", *lines])
    ends = {a + n for a, n in cut}
    assert len(ends & {a + n - 1 for a, n in moved}) > 0.9 * len(ends)
    assert line_dedup.chunks([]) == []


def test_documents_that_lose_all_words_go(spark):
    passage = sentence(np.random.default_rng(9), 60)
    texts = [(1, f"first\n{passage}"), (2, passage), (3, f"{passage}\n \n"), (4, ""), (5, None), (6, " \n"), (7, f"{passage}\nown")]
    out = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(table(spark, texts)).collect()}
    assert out == {1: texts[0][1], 4: "", 5: None, 6: " \n", 7: "own"}


def test_line_dedup_keeps_columns(spark):
    docs = table(spark, [(1, "a")]).withColumn("n_lines", F.lit("mine"))
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns[:-1] + ["n_lines"]
