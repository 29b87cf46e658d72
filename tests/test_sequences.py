"""Clustering of sequences, and graphs in line notation, against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from plumbline.functions import alignment, notation
from plumbline.operators import clustering, graphs
from plumbline.plans import sequence_queries
from plumbline.plans.tables import Tables
from tests.conftest import SF


def edited(rng, text, changes):
    out = list(text)
    for _ in range(changes):
        at = int(rng.integers(0, len(out)))
        kind = int(rng.integers(0, 3))
        if kind == 0:
            out[at] = "XYZ"[int(rng.integers(0, 3))]
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "W")
    return "".join(out)


def plain_reached(a, b, band, most):
    """The cells that each number of errors reaches first, and the cell that scores best."""
    score = lambda c, e: sum(c) - 4 * e
    seen, layer, best = set(), {(0, 0)}, (0, 0, (0, 0))
    for e in range(most + 1):
        todo = list(layer)
        while todo:
            i, j = todo.pop()
            if i < len(a) and j < len(b) and a[i] == b[j] and (i + 1, j + 1) not in layer | seen:
                layer.add((i + 1, j + 1))
                todo.append((i + 1, j + 1))
        seen |= layer
        best = max([best, *((score(c, e), -e, c) for c in layer)], key=lambda x: (x[0], x[1], x[2][1] - x[2][0]))
        live = [c for c in layer if score(c, e) >= best[0] - 2 * alignment.DROP]
        layer = {(i + p, j + q) for i, j in live for p, q in ((1, 0), (0, 1), (1, 1)) if i + p <= len(a) and j + q <= len(b) and abs(i + p - j - q) <= band} - seen
    return -best[1], *best[2]


def plain_align(a, b, i, j, band, identity):
    most = int((1 - identity) * (len(a) + len(b)) / 2)
    e, x, y = (p + q for p, q in zip(plain_reached(a[i:], b[j:], band, most), plain_reached(a[:i][::-1], b[:j][::-1], band, most), strict=True))
    return 1 - 2 * e / max(1, x + y), x / len(a), y / len(b)


@pytest.mark.parametrize("drop", [3, 100])
def test_alignment_is_brute_force(monkeypatch, drop):
    monkeypatch.setattr(alignment, "DROP", drop)
    rng = np.random.default_rng(1)
    monkeypatch.setattr(alignment, "GROUP", 400)
    pairs = []
    for k in range(200):
        a = "".join(rng.choice(list("ACGT"), int(rng.integers(9, 50))))
        b = edited(rng, a, int(rng.integers(0, 9))) if k % 3 else "".join(rng.choice(list("ACGT"), int(rng.integers(1, 50))))
        i, j = int(rng.integers(0, len(a) + 1)), int(rng.integers(0, len(b) + 1))
        pairs.append((a, b, i, min(i, len(b)) if k % 3 else j))
    found = alignment.extended([alignment.code_points(a) for a, *_ in pairs], [alignment.code_points(b) for _, b, *_ in pairs], [p[2] for p in pairs], [p[3] for p in pairs], 5, 0.6)
    for row, pair in zip(found, pairs, strict=True):
        assert tuple(row) == pytest.approx(plain_align(*pair, 5, 0.6)), pair


def test_pairs_that_may_match():
    rng = np.random.default_rng(7)
    for k in range(300):
        a = "".join(rng.choice(list("ACDEFGHIKL"), int(rng.integers(20, 80))))
        b = edited(rng, a, k % 12)
        i = next((p for p in range(len(a) - 3) if b[p : p + 4] == a[p : p + 4]), 0)
        found = plain_align(a, b, i, i, 8, 0.85)
        if found[0] >= 0.85 and min(found[1:]) >= 0.8:
            assert alignment.may_match(alignment.code_points(a), alignment.code_points(b), 0.85, 0.8)
    assert not alignment.may_match(alignment.code_points("ACDE" * 30), alignment.code_points("FGHI" * 30), 0.85, 0.8)


def test_long_sequences_take_steps_by_errors():
    rng = np.random.default_rng(3)
    a = rng.integers(97, 122, 300_000).astype(np.uint32)
    b = np.delete(a, [1000, 200_000])
    b[5000] = 1
    found = alignment.extended([a], [b], [100_000], [99_999], 16, 0.9)
    assert tuple(found[0]) == pytest.approx((1 - 6 / 599_998, 1.0, 1.0))


def test_smallest_kmers(monkeypatch):
    whole = {t: alignment.smallest_kmers(t, 5, 4) for t in ("abcdefgh" * 9, "aaaaaaaaaaaaaaaaaaaaaaaaaab", "ab", "", "héllo wörld \U0001f600 again and again")}
    monkeypatch.setattr(alignment, "PIECE", 7)
    for t, (h, p) in whole.items():
        again = alignment.smallest_kmers(t, 5, 4)
        assert h.tolist() == again[0].tolist() and p.tolist() == again[1].tolist()
        of = {t[i : i + 5] for i in range(max(1, len(t) - 4))} if t else set()
        assert len(h) == min(4, len(of)) and all(t.find(t[i : i + 5]) == i for i in p)


def brute_clusters(rows, k, m, identity, cover, band):
    size = {i: len(s or "") for i, s in rows}
    kmers = {i: dict(zip(*map(np.ndarray.tolist, alignment.smallest_kmers(s or "", k, m)), strict=True)) for i, s in rows}
    text, centres = dict(rows), {}
    for i, _ in rows:
        for h, at in kmers[i].items():
            if h not in centres or (-size[i], i) < (-size[centres[h][0]], centres[h][0]):
                centres[h] = (i, at)
    links = {}
    for i, _ in rows:
        lines = {}
        for h, at in kmers[i].items():
            c, there = centres[h]
            if c != i:
                lines.setdefault(c, []).append((at - there, at))
        for c, found in lines.items():
            ds = [d for d, _ in found]
            d = min(set(ds), key=lambda d: (-ds.count(d), abs(d), d))
            at = min(p for e, p in found if e == d)
            found = plain_align(text[i], text[c], at, at - d, band, identity)
            if size[i] >= cover * size[c] and found[0] >= identity and min(found[1:]) >= cover:
                links.setdefault(i, {})[c] = found[0]
    reps, out = set(), {}
    for i in sorted(size, key=lambda i: (-size[i], i)):
        mine = [c for c in links.get(i, {}) if c in reps]
        if mine:
            c = min(mine, key=lambda c: (-size[c], c))
            out[i] = (c, links[i][c])
        else:
            reps.add(i)
            out[i] = (i, 1.0)
    return out


def test_clusters_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clustering, "COPIES", 3)
    rng = np.random.default_rng(2)
    bases = ["".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), int(rng.integers(30, 90)))) for _ in range(40)]
    rows = [(k, edited(rng, bases[int(rng.integers(0, 40))], int(rng.integers(0, 9)))) for k in range(480)]
    rows += [(500, bases[0]), (501, bases[0]), (502, None), (503, ""), (504, "AC"), (505, "AC"), (506, "ACD" * 40), (507, "ACD" * 39)]
    df = spark.createDataFrame(rows, "id long, seq string")
    found = {r.id: (r.representative, pytest.approx(r.identity)) for r in clustering.clustered(df, k=6, m=5, identity=0.85, cover=0.8, band=8).collect()}
    want = brute_clusters(rows, 6, 5, 0.85, 0.8, 8)
    assert found == want and 40 <= len({c for c, _ in want.values()}) < 250


def pairs_of(texts):
    ids, zero = pa.array(range(len(texts)), pa.int64()), pa.array(np.zeros(len(texts), np.int64))
    a, b = (pa.array([t[k] for t in texts], pa.string()) for k in range(2))
    return pa.RecordBatch.from_arrays([ids, ids, zero, zero, zero, a, b], ["member", "centre", "n_centre", "at", "at_centre", "a", "b"])


def rows_of(batches):
    return [r for batch in batches for r in batch.to_pylist()]


def test_batches_are_cut_by_the_bytes_of_their_texts(monkeypatch):
    seqs = ["a" * 30, None, "é" * 20, "b" * 500, "", "c" * 90, "d" * 99, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(seqs))), pa.array(seqs)], ["id", "seq"])
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in rng.integers(20, 80, 30)]
    pairs = pairs_of([(t, t[:k] + "G" + t[k + 1 :]) for t, k in zip(texts, rng.integers(0, 20, 30), strict=True)])
    whole = rows_of(clustering._kmers(iter([batch]), 6, 5)), rows_of(clustering._aligned(iter([pairs]), 0.8, 0.5, 8))
    monkeypatch.setattr(clustering, "SLICE", 100)
    parts = list(clustering.sliced(batch, "seq"))
    assert rows_of(parts) == batch.to_pylist() and len(parts) > 3
    assert all(sum(len((t or "").encode()) for t in p.column("seq").to_pylist()[1:]) <= 100 for p in parts)
    assert not list(clustering.sliced(batch.slice(0, 0), "seq")) and len(list(clustering.sliced(pairs, "a", "b"))) > 10
    assert (rows_of(clustering._kmers(iter([batch]), 6, 5)), rows_of(clustering._aligned(iter([pairs]), 0.8, 0.5, 8))) == whole


def test_a_full_batch_takes_the_memory_of_a_slice(monkeypatch):
    texts = [("a" * 100_000, "b" * 100_000)] * 40
    pairs = pairs_of(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pairs.column("a")], ["id", "seq"])

    def peak(rows):
        tracemalloc.start()
        for _ in rows:
            pass
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out

    monkeypatch.setattr(clustering, "may_match", lambda *_: False)
    monkeypatch.setattr(clustering, "smallest_kmers", lambda *_: (np.zeros(0, np.int64),) * 2)
    for slice_bytes, most in ((1 << 40, None), (1_000_000, 8e6)):
        monkeypatch.setattr(clustering, "SLICE", slice_bytes)
        for took, all_at_once in ((peak(clustering._aligned(iter([pairs]), 0.9, 0.8, 8)), 32e6), (peak(clustering._kmers(iter([batch]), 6, 5)), 4e6)):
            assert took >= all_at_once if most is None else took < min(most, all_at_once)


def test_pairs_are_members_and_centres_only(spark):
    rows = [(k, "ACDEFGHIKLMNPQRSTVWY" + "AC" * (k % 3)) for k in range(300)]
    kmers = clustering.kmer_members(spark.createDataFrame(rows, "id long, seq string"), 6, 5)
    pairs = clustering.candidates(kmers).collect()
    assert len(pairs) <= 5 * 300 and all(len(rows[p.centre][1]) >= len(rows[p.member][1]) for p in pairs)


def test_chains_of_centres_are_decided_one_after_the_other(spark):
    links = spark.createDataFrame([(k + 1, k, 1.0) for k in range(9)] + [(20, 1, 1.0), (20, 3, 1.0)], "member long, centre long, identity double")
    assert sorted((r.member, r.centre) for r in clustering.longest_first(links).collect()) == [(k + 1, k) for k in range(0, 9, 2)]


# ---- graphs -----------------------------------------------------------------------------------------------------


def isomorphic(a, b):
    """By search: a mapping of atoms that keeps what they are and all bonds."""
    kind = lambda g, k: (g.atoms[k], g.hydrogens(k), sorted(g.near[k].values()))
    if len(a.atoms) != len(b.atoms):
        return False
    order = [k for group in a.components() for k in group]

    def place(at, of):
        if at == len(order):
            return True
        k = order[at]
        for c in range(len(b.atoms)):
            if c not in of.values() and kind(a, k) == kind(b, c) and all(b.near[c].get(of[x]) == bond for x, bond in a.near[k].items() if x in of):
                if sum(x in of for x in a.near[k]) == sum(x in of.values() for x in b.near[c]) and place(at + 1, of | {k: c}):
                    return True
        return False

    return place(0, {})


KNOWN = [  # notation, hydrogens, rings, ring sizes, scaffold
    ("CCO", 6, 0, [], ""),
    ("c1ccccc1", 6, 1, [6], "c1ccccc1"),
    ("Cc1ccccc1C(=O)O", 8, 1, [6], "c1ccccc1"),
    ("c1ccc2ccccc2c1", 8, 2, [6], "c1ccc2ccccc2c1"),
    ("C1CC2CCC1C2", 12, 2, [5], "C1CC2CCC1C2"),
    ("O=C1CCCCC1", 10, 1, [6], "O=C1CCCCC1"),
    ("c1ccccc1CCc1ccccc1", 14, 2, [6], "c1ccccc1CCc1ccccc1"),
    ("c1ccccc1c1ccccc1", 10, 2, [6], "c1ccccc1-c1ccccc1"),
    ("Cn1cccc1", 7, 1, [5], "c1cc[nH]c1"),
    ("C[N+](C)(C)C", 12, 0, [], ""),
    ("[Na+].[Cl-]", 0, 0, [], ""),
    ("CS(=O)(=O)N", 5, 0, [], ""),
    ("C%12CC%12", 6, 1, [3], "C1CC1"),
]


def test_known_graphs(spark):
    df = spark.createDataFrame([(k, x[0]) for k, x in enumerate(KNOWN)], "id int, notation string")
    out = {r.id: r for r in graphs.fingerprinted(df, "notation").collect()}
    for k, (text, hydrogens, n_rings, sizes, core) in enumerate(KNOWN):
        g = notation.parse(text)
        assert sum(map(g.hydrogens, range(len(g.atoms)))) == hydrogens, text
        assert (out[k].n_rings, out[k].ring_sizes) == (n_rings, sizes), text
        assert isomorphic(notation.parse(out[k].scaffold), notation.parse(core)) if core else out[k].scaffold == "", text
        assert sum(out[k].masses) == pytest.approx(g.weight(list(range(len(g.atoms)))), abs=0.01)
    assert out[1].masses == [78.114] and out[6].masses == [77.106, 77.106, 28.054]
    assert out[1].bits == sorted(out[1].bits) and len(out[1].bits) == 3  # six like atoms have one neighbourhood at each radius


def test_neighbourhoods_of_a_chain(spark):
    """C-C-C-C-O at radius 1: atoms differ in their neighbours up to one bond away."""
    df = spark.createDataFrame([(0, "CCCCO"), (1, "OCCCC"), (2, "CCCCN"), (3, "C(CO)CC")], "id int, notation string")
    bits = {r.id: set(r.bits) for r in graphs.fingerprinted(df, "notation", 1, 1 << 20).collect()}
    assert bits[0] == bits[1] == bits[3] and len(bits[0]) == 3 + 5  # CH3, CH2 and OH; then all five differ but for the middle two
    assert len(bits[0] & bits[2]) == 2 + 3


def test_what_is_no_notation(spark):
    wrong = [None, "", "C(", "C)", "C1CC", "C=", "CX", "[C", "C1C1", "c1ccccc1 ", "1CC", "C11", "C..C("]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(wrong)], "id int, notation string, scaffold_of string")
    assert all(r.bits is None and r.scaffold is None for r in graphs.fingerprinted(df, "notation").collect())
    assert all(r.other is None for r in graphs.renotated(df, "notation").collect())
    stereo = spark.createDataFrame([(0, "F/C=C/F"), (1, "C"), (2, "N[C@@H](C)O")], "id int, notation string")
    assert all(r.other is None for r in graphs.renotated(stereo, "notation").collect())
    assert graphs.renotated(stereo.limit(0), "notation").isEmpty() and graphs.fingerprinted(stereo.limit(0), "notation").isEmpty()


def test_other_notations_are_of_the_same_graph(spark):
    rows = sequence_queries.x15(Tables(spark, SF)).collect()
    assert len({r.notation for r in rows}) > 150 and all(r.other and r.other != r.notation for r in rows if len(r.notation) > 3)
    both = {(r.notation, r.other) for r in rows if r.other}
    assert all(isomorphic(notation.parse(a), notation.parse(b)) for a, b in both)
    df = spark.createDataFrame([(k, t) for k, p in enumerate(sorted(both)) for t in p], "id int, notation string")
    seen = {}
    for r in graphs.fingerprinted(df, "notation").collect():
        seen.setdefault(r.id, set()).add((tuple(r.bits), r.n_rings, tuple(r.ring_sizes), r.scaffold, tuple(r.masses)))
    assert all(len(s) == 1 for s in seen.values())


def test_fingerprints_feed_the_neighbour_search(spark):
    t = Tables(spark, SF)
    rows = {r.id: r for r in graphs.fingerprinted(sequence_queries.molecules(t), "notation").collect()}
    want = {}
    for q in (r for r in rows.values() if r.id % 20 == 0):
        sims = sorted((-len(set(q.bits) & set(p.bits)) / len(set(q.bits) | set(p.bits)), p.id) for p in rows.values() if p.scaffold != q.scaffold and set(q.bits) & set(p.bits))
        y = [rows[i].label for _, i in sims[:5]]
        want[q.id] = (pytest.approx(sum(y) / len(y), abs=1e-6), pytest.approx(max(sum(y), len(y) - sum(y)) / len(y), abs=1e-6))
    assert {r.id: (r.mean_label, r.purity) for r in sequence_queries.m7_neighbors(t).collect()} == want
