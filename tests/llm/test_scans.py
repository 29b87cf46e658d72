"""Fill-in-the-middle, licence scans and the divergence audit against brute force, on small and odd tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import divergence_audit, fill_in_middle, license_scan
from plumbline.llm.license_texts import PHRASES, TEMPLATES

ODD = [None, "", "a", " \n\t", "é", "日本語テキスト", "a\U0001f600b" * 3, "x<P>y", "<", "S>", "ab" * 40_000, "é日a\U0001f600" * 20_000]


# ---- fill in the middle -----------------------------------------------------------------------------------------


def brute_fim(i, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_is_brute_force_and_can_be_undone(spark):
    rng = np.random.default_rng(1)
    letters = list("ab <PSM>é日\U0001f600")
    texts = [*ODD, *("".join(rng.choice(letters, int(rng.integers(1, 60)))) for _ in range(150))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (None, "text of no id"), (7, "another text of an id")]
    df = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, output string, n int, low double")
    made = fill_in_middle.fill_in_middle(df)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((str(tuple(r)[:6]) for r in out)) == sorted(str(brute_fim(i, t)) for i, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert sorted(r.back for r in out) == sorted(t or "" for _, t in rows)


def test_runs_find_every_cut(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "PIECE_BYTES", 7)  # code points and runs cross pieces
    for text in ("", "abc", "aéé日日日b", "\U0001f600" * 9, "é日a\U0001f600" * 8, "a" * 30 + "é"):
        runs = fill_in_middle.encoded_runs(text.encode())
        assert [runs.at(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]
        assert len(runs.width) == sum(1 for a, b in zip([0, *map(lambda c: len(c.encode()), text)], map(lambda c: len(c.encode()), text), strict=False) if a != b)


def test_sentinels_that_may_be_mistaken_are_refused():
    with pytest.raises(ValueError, match="overlap"):
        fill_in_middle.Sentinels("<P>", "><", "<M>")
    with pytest.raises(ValueError, match="three"):
        fill_in_middle.Sentinels("<P>", "<P>", "<M>")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert fill_in_middle.fill_in_middle(none).isEmpty() and license_scan.license_scan(none).isEmpty() and divergence_audit.divergence_audit(none).isEmpty()


# ---- licences ---------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_places(text):
    words, out = words_of(text), []
    for phrase, label in PHRASES:
        p = phrase.split()
        out += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    return sorted(out)


def brute_runs(words, templates, least):
    """Runs of words that a template has, and that no word before or after extends."""
    held = {tuple(t[a:b]) for t in templates for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    ends, out = [], []
    for a in range(len(words)):
        b = a
        while b < len(words) and tuple(words[a : b + 1]) in held:
            b += 1
        ends.append(b)
        if b - a >= least and (a == 0 or ends[a - 1] < b):
            out.append((a, b))
    return out


def test_runs_and_places_are_brute_force(monkeypatch):
    monkeypatch.setattr(license_scan, "PIECE_BYTES", 40)
    rng = np.random.default_rng(3)
    for trial in range(60):
        vocabulary = list("abcdef")[: 2 + trial % 5]
        texts = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 12)))) for _ in range(3)]
        phrases = [(" ".join(rng.choice(vocabulary, 2)), f"p{k}") for k in range(3)]
        of = license_scan.Automaton(tuple((f"t{k}", t) for k, t in enumerate(texts)), tuple(phrases))
        text = " ".join(rng.choice([*vocabulary, "zz"], 80))
        words = text.split()
        events = list(of.runs_and_phrases(license_scan.word_lists(text), 2))
        everything = [t.split() for t in texts] + [p.split() for p, _ in phrases]
        assert [(a, b) for kind, a, b, _ in events if kind == "run"] == brute_runs(words, everything, 2)
        assert sorted((a, k) for kind, a, _, k in events if kind == "phrase") == sorted((a, k) for k, (p, _) in enumerate(phrases) for a in range(len(words)) if words[a : a + 2] == p.split())
        for kind, a, b, state in events:
            if kind == "run":
                first, last = of.slice[state]
                assert sorted(of.ends[first:last]) == sorted((k, e) for k, t in enumerate(texts) for e in range(b - a, len(t.split()) + 1) if t.split()[e - (b - a) : e] == words[a:b])
        assert events[-1] == ("end", 80, 80, 0)


def scanned(spark, texts):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, places string, score int")
    return {r.doc_id: r for r in license_scan.license_scan(df).collect()}


def test_license_scan(spark):
    mit, apache = TEMPLATES[0][1], next(t for k, t in TEMPLATES if k == "apache-2.0")
    changed = mit.split()
    changed[20] = "other"
    changed[50:50] = ["three", "added", "words"]
    texts = [
        *ODD[:9],
        "Released under the MIT License.",
        f"prose before {mit} and after",
        " ".join(changed),
        f"{apache}\n{mit}",
        "This work is licensed under the GNU General Public License, version 3.",
        "the mit has no license and a general licence is public",
        "MIT-License mit  LICENSE, Apache License general public license " * 3,
        "the permission of the author is granted to use a copy of any text",
        "ab " * 50_000,
        "Released under the MIT License. " * 5_000,
    ]
    out = scanned(spark, texts)
    for k, t in enumerate(texts):
        assert sorted((p.word, p.label) for p in out[k].places) == brute_places(t) and out[k].n_words == len(words_of(t)), k
    labels = {k: [s.label for s in r.spans] for k, r in out.items()}
    assert all(not labels[k] and out[k].score == 0 for k in (*range(9), 14, 16, 17))
    assert labels[9] == ["mit"] and out[9].score == 1
    assert [(s.label, s.start, s.cover) for s in out[10].spans] == [("mit", 2, 1.0)]
    assert labels[11] == ["mit"] and 0.95 < out[11].score < 1
    assert labels[12] == ["apache-2.0", "mit"] and labels[13] == ["gpl-3.0"]
    assert out[15].score == license_scan.MENTION and len(out[15].places) == 12
    assert labels[18] == ["mit"] * 5_000
    for label, text in TEMPLATES:  # each notice is told from the others
        n, _, spans = license_scan.automaton(tuple(TEMPLATES), tuple(PHRASES)).scan(text, license_scan.LEAST_RUN, license_scan.MOST_GAP, license_scan.LEAST_COVER)
        assert [(TEMPLATES[s.template][0], s.start, s.end, s.cover) for s in spans] == [(label, 0, n, 1.0)], label


# ---- divergence -------------------------------------------------------------------------------------------------


def brute_audit(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = [w for w, n in df.items() if n >= least]

        def chance(ds, kept=kept):
            c = Counter(w for d in ds for w in d[2])
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}, c

        q, _ = chance(own)
        ps = {s: chance([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        for s, (p, c) in ps.items():
            pair = [(r, sum(abs(p[w] - o[w]) for w in kept)) for r, (o, _) in ps.items() if r != s]
            term = [(w, p[w] - q[w]) for w in kept if c[w] and p[w] > q[w]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("few_groups", [True, False])
def test_divergence_audit_is_brute_force(spark, monkeypatch, few_groups):
    if not few_groups:
        monkeypatch.setattr(divergence_audit, "BROADCAST_GROUPS", 2)
        monkeypatch.setattr(divergence_audit, "GROUPS_A_BLOCK", 4)
    rng = np.random.default_rng(4)
    vocabulary = np.array([*(f"{a}{b}" for a in "abcdeé" for b in "uvwxyzñ"), "Zebra", "日本"])
    rows = []
    for k in range(260):
        size = int(rng.integers(0, 40)) if k else 5_000
        weights = rng.dirichlet(np.full(len(vocabulary), 0.3))
        rows.append((["en", "fr", None, ""][min(3, k % 7)], ["s1", "s2", "S3", "é", None, "s6"][int(rng.integers(0, 6))], "-".join(rng.choice(vocabulary, size, p=weights))))
    rows += [rows[1]] * 30 + [("xx", "alone", "rare words"), ("yy", "one", None), ("yy", "two", ""), ("en", "empty", None), (None, None, "1 2 3")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, value int, p string")
    for least, top in ((30, 50), (3, 5), (10**6, 5)):
        found = divergence_audit.divergence_audit(df, least, top)
        assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, found.collect())) == brute_audit(rows, least, top)


def test_large_counts_are_exact(spark):
    row = spark.createDataFrame([(2**52 + 1, 2**53 + 7, 10**6)], "c long, n long, v long")
    assert row.select(divergence_audit.probability(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (2**52 + 6) // (2**53 + 7 + 5 * 10**6)
