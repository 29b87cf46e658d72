"""Tokens, packing, vectors, pages and models, on small and odd tables."""

import math
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import embedding_dedup, html_blocks, html_extraction, language_model, packing, token_counts, toxicity, words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "don't we'll", "  two  spaces ", "tail\n\n b", "x  y", "²³ ½ 12", "日本語 ١٢", "a<|endoftext|> b", "\x00\x07", "é" * 500, "word " * 4000, "aaaaaaaa" * 300]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 5, "z") for i, t in enumerate(texts)], "doc_id long, text string, length int, row string")


def test_token_counts_are_the_librarys(spark, library):
    out = {r.doc_id: r for r in token_counts.token_counts(docs(spark, ODD), VOCABULARY).collect()}
    for i, t in enumerate(ODD):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (out[i].n_tokens, out[i].n_bytes, out[i].over_limit) == (n, len((t or "").encode()), n > 1024)
    assert token_counts.token_counts(docs(spark, []), VOCABULARY).isEmpty()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'aez9.")), max_size=60))
def test_any_text_has_the_librarys_tokens(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert token_counts.count_text(text, token_counts.counter(VOCABULARY)) == len(ids)
    assert packing.chunk_ids(VOCABULARY).of(text).tolist() == ids


def check_packing(out, tokens, capacity):
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(tokens)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
        assert sum(r.length for r in pieces) == len(tokens[i]) and all(r.length == capacity for r in pieces[1:])
        assert len(pieces) == 1 or len(tokens[i]) > capacity
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(tokens[i][r.start : r.start + r.length], "<u4").tobytes())
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0, *(r.length for r in rows)])[:-1]) and sum(r.length for r in rows) <= capacity


def test_packing(spark, library):
    texts = [*ODD, *(f"w{k} " * (k * 7 % 300) for k in range(60))]
    out = packing.pack(docs(spark, texts), VOCABULARY, 256).collect()
    tokens = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    check_packing(out, tokens, 256)
    assert len({r.sequence_id for r in out}) <= math.ceil(sum(map(len, tokens.values())) / 256) + 2
    assert packing.pack(docs(spark, []), VOCABULARY).isEmpty()


def test_packing_repeats_rows(spark):
    d = spark.createDataFrame([(1, "a b")] * 5, "doc_id long, text string")
    out = packing.pack(d, VOCABULARY, 4).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == 5


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=25))
def test_plan_places_every_item_once(count):
    table, used = packing.plan(count, 40)
    places, taken = {}, Counter()
    for length, first, items, sequence, offset in table.tolist():
        assert first == taken[length]
        taken[length] += items
        for k in range(items):
            places.setdefault(sequence + k, []).append((offset, length))
    assert dict(taken) == count and len(places) == used
    for rows in places.values():
        rows.sort()
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:k]) for k in range(len(rows))] and sum(n for _, n in rows) <= 40


# ---- vectors ----------------------------------------------------------------------------------------------------


def brute_links(rows, t=0.98, all_rows=False):
    def sound(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [[] for _ in rows]
    for a in range(n):
        for b in range(a):
            (_, v, y), (_, w, z) = rows[a], rows[b]
            if y is None or y != z or not sound(v) or not sound(w) or len(v) != len(w):
                continue
            p, q = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
            if p @ q / math.sqrt((p @ p) * (q @ q)) >= t:
                near[a].append(b)
                near[b].append(a)
    out = {}
    every = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[rows[a][0]] = (len(near[a]), min(rows[b][0] for b in seen))
        every.append((rows[a][0], *out[rows[a][0]]))
    return sorted(every) if all_rows else out


@pytest.mark.parametrize("size", [(500, 2048), (15, 8)])
def test_vector_links_are_those_of_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(embedding_dedup, "VECTORS_A_PIVOT", size[0])
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", size[1])
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6))
    rows = [(k, (centres[k % 12] + rng.normal(scale=0.12, size=6)).tolist(), int(k % 2)) for k in range(150)]
    rows += [(200 + k, rows[7][1], 1) for k in range(30)]  # exact copies
    rows += [(300, None, 1), (301, [0.0] * 6, 1), (302, [float("nan")] * 6, 1), (303, rows[7][1], None), (304, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (305, [], 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit(1))
    out = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    assert out == brute_links(rows)
    double = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.concat(F.lit("l"), "label").alias("label"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(double).collect()} == brute_links(rows)
    # rows that share an id are vectors of their own
    shared = [(k % 40, v, label) for k, v, label in rows[:180]] + [(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (2, [1.0, 0.001], 5), (2, [1.0, 0.002], 5)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(shared, "vec_id long, embedding array<float>, label int"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == brute_links(shared, all_rows=True)
    none = embedding_dedup.near_vectors(df.where("vec_id >= 300 and vec_id < 303")).collect()
    assert all(r.kept and r.n_links == 0 for r in none) and len(none) == 3
    assert embedding_dedup.near_vectors(df.limit(0)).isEmpty()


# ---- words and the language model -------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = words.words(texts)
    for i, t in enumerate(texts):
        want = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode("utf-8", "replace").lower())
        got = [w.word(k) for k in range(w.first[i], w.first[i + 1])]
        assert got == want
    spelled = {}
    for k, h in enumerate(w.hash.tolist()):
        assert spelled.setdefault(h, w.word(k)) == w.word(k)


def test_base_score_and_improvement(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.5, 80) % 500) for _ in range(300)] + [None, "", "Never SEEN before", "x " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])]
    out = language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    tokens = [[*(t or "").lower().split(), ""] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    count = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n, v = sum(count.values()), len(count)
    want = sorted((i, h, len(t), sum(count[x] > 0 for x in t), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 4)) for (i, _), t, h in zip(rows, tokens, held, strict=True))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    test = [r for r in out if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test) and all(r.score < 0 for r in out)
    assert language_model.score_texts(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def brute_scores(rows):
    """Scores by plain counts: a word after its context, the word alone, the unknown word."""
    part = [2 if i is None else zlib.crc32(str(i).encode()) % 10 for i, _ in rows]
    texts = [[w for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if w] + [""] for _, t in rows]
    pairs, kept = Counter(), Counter()
    for t, p in zip(texts, part, strict=True):
        if p > 1:
            kept.update(t)
            pairs.update(zip(["", *t], t, strict=False))
    n = sum(kept.values())
    assert all(sum(c for (v, _), c in pairs.items() if v == w) == kept[w] for w in kept)  # so estimates sum to one

    def bucket(v):
        return min(language_model.BUCKETS - 1, 1 + int(math.log2(kept[v]))) if kept[v] else 0

    def ratio(v, w):
        return pairs[v, w] / max(1, kept[v]) * n / kept[w]

    seen = {}
    for t, p in zip(texts, part, strict=True):
        for v, w in zip(["", *t], t, strict=False) if p == 1 else ():
            seen.setdefault(bucket(v), []).append(round(math.log10(max(ratio(v, w), 1e-9)) / 0.02) * 0.02 if kept[w] else None)
    unknown, follows = {}, {}
    for b in range(language_model.BUCKETS):
        mine = seen.get(b, [])
        high = [10.0**x for x in mine if x is not None]
        unknown[b] = (len(mine) - len(high) + 0.5) / (len(mine) + 1)
        weight = 0.5
        for _ in range(60 if high else 0):
            weight = sum(weight * h / (weight * h + 1 - weight) for h in high) / len(high)
        follows[b] = min(max(weight, 1e-6), 1 - 1e-6)
    out = []
    for t in texts:
        total = 0.0
        for v, w in zip(["", *t], t, strict=False):
            b = bucket(v)
            p = (1 - unknown[b]) * kept[w] / n * (follows[b] * ratio(v, w) + 1 - follows[b]) if kept[w] else unknown[b]
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("batch_bytes", [language_model.BATCH_BYTES, 700])
def test_score_is_that_of_plain_counts(spark, monkeypatch, batch_bytes):
    monkeypatch.setattr(language_model, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 5 * batch_bytes)
    monkeypatch.setattr(language_model, "TASK_BYTES", 3 * batch_bytes)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"W{int(k)}" for k in rng.zipf(1.4, int(rng.integers(0, 60))) % 300) for _ in range(200)]
    rows = [*enumerate(texts), (None, "no id here"), (201, None), (202, " "), (3, texts[3]), (203, "once only")]
    frame = spark.createDataFrame([(i, t, "x", 1.0, 4) for i, t in rows], "doc_id long, text string, batch string, score double, part int")
    out = sorted((r.doc_id or -1, r.score) for r in language_model.score_texts(frame).collect())
    want = sorted((i or -1, x) for (i, _), x in zip(rows, brute_scores(rows), strict=True))
    assert [i for i, _ in out] == [i for i, _ in want]
    assert [x for _, x in out] == pytest.approx([x for _, x in want], rel=1e-6)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**40 - 1), max_size=40))
def test_packed_numbers_come_back(values):
    x = np.array(sorted(values), np.uint64)
    assert language_model.unpacked(language_model.packed(x, 5), 5).tolist() == x.tolist()


def test_counts_above_32_bits():
    """Two batches' counts of a word sum to more than 2^32; no count is cut short in silence."""
    key = language_model._steps(np.array([7], np.uint64))
    many = language_model.packed(np.array([2**32 + 7], np.uint64), language_model.COUNT_BYTES)
    rows = pd.DataFrame({"bucket": [0, 0], "batch": [1, 2], "words": [key] * 2, "train": [many] * 2, "kept": [many] * 2, "pairs": [key] * 2, "times": [many] * 2})
    out = language_model._answers(rows)
    for name in ("train", "kept", "times"):
        assert [language_model.unpacked(x, language_model.COUNT_BYTES).tolist() for x in out[name][:2]] == [[2**33 + 14]] * 2
    assert out["all_train"].iloc[-1] == 2**33 + 14
    with pytest.raises(OverflowError):
        language_model.packed(np.array([2**48], np.uint64), language_model.COUNT_BYTES)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    high, low = np.array([0.8, 0.2]), np.array([0.3, 0.7])
    seen = np.where(rng.random(20000) < 0.35, rng.random(20000) > 0.8, rng.random(20000) > 0.3).astype(int)
    n = np.bincount(seen)
    w = language_model.em_weights(high, low, n.astype(float), np.zeros(2, int), 1, rounds=500)
    assert w[0] == pytest.approx(0.35, abs=0.03)


# ---- toxicity ---------------------------------------------------------------------------------------------------


def test_toxicity_separates(spark):
    rng = np.random.default_rng(2)
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti"]
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 5))))
    rows, labels = [], []
    for k in range(600):
        text = [word() for _ in range(int(rng.integers(5, 120)))]
        toxic = k % 4 == 0
        if toxic:
            for j in rng.integers(0, len(text), 3):
                text[j] = rng.choice(["zhorvath", "quixxen", "wugglydd"])
        rows.append((k, " ".join(text), "c"))
        labels.append((k, int(toxic)))
    rows += [(900, None, "c"), (901, "", "c"), (902, "x" * 20000, "c"), (5, rows[5][1], "c")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic long")
    out = toxicity.toxicity(docs, known).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    truth = dict(labels)
    test = [r for r in out if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in test) / len(test)
    assert right > 0.97
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in out)
    none = toxicity.toxicity(docs, known.limit(0)).collect()
    assert len(none) == len(rows) and all(r.predicted == 0 for r in none)


def test_scores_are_those_of_plain_compression():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(k)}" for k in rng.integers(0, 60, 80)) for _ in range(60)]
    toxic = [int(k % 3 == 0) for k in range(60)]
    texts = [f"{t[:90]} zhorvath quixxen {t[90:]}" if x else t for t, x in zip(texts, toxic, strict=True)]
    model = toxicity.fit(texts, toxic)

    def size(part, content):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(write_content_size=False, write_dict_id=False, **toxicity.SEARCH)
        dictionary.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how).compress(part))

    for text in (*texts[:6], "", "unseen words here"):
        parts = []
        for word in text.lower().split():
            if parts and len(parts[-1]) + 1 + len(word) < toxicity.WINDOW_CHARS:
                parts[-1] += f" {word}"
            else:
                parts.append(word)
        gain = sorted((size(p.encode(), model.ordinary) - size(p.encode(), model.ordinary + model.toxic) for p in parts), reverse=True)
        x = [*gain[:4], *[0] * (4 - len(gain[:4])), *(math.log1p(sum(g >= m for g in gain)) for m in (3, 5, 7)), math.log1p(len(gain)), 1]
        z = sum(a * b for a, b in zip(x, model.weights, strict=True))
        assert toxicity.score_text(text, model) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


def test_toxicity_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(none, labels).isEmpty() and toxicity.drop_toxic(none, labels).columns == none.columns
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y"), (None, "d", "z")], none.schema)
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 3 and all(0 <= r.score <= 1 for r in out)


def test_windows_hold_all_text():
    text = "ab " * 300 + "x" * 500 + " é" * 90
    assert b"".join(toxicity.windows(text)).replace(b" ", b"").decode() == text.replace(" ", "")


# ---- pages ------------------------------------------------------------------------------------------------------


def test_blocks():
    page = "<head><title>T</title><style>p{}</style></head><body><p>A &amp; <b>b\n c</b><br>d<p>e<script>var t='</p>';</script><!-- x --><ul><li>f<li>g</ul><a href='>'>h</a></body>"
    assert [b.text for b in html_blocks.blocks(page)] == ["A & b c d", "e", "f", "g", "h"]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<") [0].text == "<" and html_blocks.blocks("<p") [0].text.startswith("<")


@pytest.mark.parametrize("tail", ["", ">", '">', "'>"])
@pytest.mark.parametrize("unit", ["<a", '<a "', "<a ", "<!-", "<p x='", "<a \"'>'", "</a ", "</script ", "<script>", "<title>x", "&#9"])
def test_malformed_pages_take_linear_time(unit, tail):
    times = []
    for n in (125_000, 500_000):
        page = unit * (n // len(unit)) + tail
        began = time.process_time()
        html_blocks.blocks(page)
        times.append(time.process_time() - began)
    assert times[1] < 5 and times[1] < 12 * times[0] + 0.2


def test_scanner_on_quotes_and_brackets():
    def cut(page):
        scanner, at, out = html_blocks.Scanner(page), 0, []
        while at < len(page):
            part = scanner.part(at)
            out.append((page[at : part.end], part.text, part.tag, part.closes))
            at = part.end
        return out

    assert cut("<p title='x>y'>a</p>") == [("<p title='x>y'>", None, "p", False), ("a", "a", None, False), ("</p>", None, "p", True)]
    assert cut("<p 'x>y") == [("<p 'x>", None, "p", False), ("y", "y", None, False)]
    assert cut("</p 'x>y") == [("</p 'x>", None, None, False), ("y", "y", None, False)]
    assert cut("<a <b") == [("<", "<", None, False), ("a ", "a ", None, False), ("<", "<", None, False), ("b", "b", None, False)]
    assert cut("<!-- a > b -->c<!-- d") == [("<!-- a > b -->", None, None, False), ("c", "c", None, False), ("<!-- d", None, None, False)]
    assert html_blocks.blocks("a&#" + "9" * 5000 + ";b")[0].text == "a\ufffdb"


def test_deep_pages_take_linear_memory():
    n = 64_000
    tracemalloc.start()
    found = html_blocks.blocks("<div class='a b'>x" * n)
    assert len(found) == n and found[-1].path.depth == 3 * n and tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
    tokens = found[-1].path.tokens()
    assert sorted(tokens) == [".a", ".b", "<div>"]
    assert (html_extraction.vectors(found[-2:])[0][:5] == html_extraction.vectors(found[:1])[0][:5]).all()


def test_elements_that_are_no_running_text():
    page = "<body><p>a <math><mi>b</mi></math> c<svg><text>d</text></svg><noscript>e</noscript><script>f</script><title>g<p>h <script>i</body>"
    assert " ".join(b.text for b in html_blocks.blocks(page)) == "a b c d e g h i"


def test_pages_of_an_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars string")
    out = html_extraction.main_text(none)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.isEmpty()


def test_network_gradient():
    rng = np.random.default_rng(0)
    w = html_extraction.new_weights(rng)
    x, mask = html_extraction._padded([rng.normal(size=(n, html_extraction.INPUT)) for n in (3, 5)])
    y = rng.integers(0, 2, mask.shape)

    def loss():
        p = html_extraction._forward(x, mask, w)[0]
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    p, _, tape, _ = html_extraction._forward(x, mask, w)
    d = ((p - y) * mask)[:, :, None] * w["out"][: html_extraction.HIDDEN]
    grad = html_extraction._lstm_back(x, w["f"], tape, d)
    for i, j in ((0, 0), (html_extraction.INPUT + 2, 30), (-1, 60)):
        w["f"][i, j] += 1e-5
        up = loss()
        w["f"][i, j] -= 2e-5
        down = loss()
        w["f"][i, j] += 1e-5
        assert grad[i, j] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_main_text(spark):
    maker = html_extraction.PageMaker(12345)
    wrong = total = 0
    weights = html_extraction.trained()
    for _ in range(60):
        x, y = html_extraction.learnt_page(maker.page())
        if len(x):
            wrong += int(((html_extraction.probabilities([x], weights)[0] >= 0.5) != y).sum())
            total += len(y)
    assert wrong < 0.03 * total
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>Some &lt;text&gt; here.</p></article><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (3, "v", page)]
    out = html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in out)
    text = "Title Some <text> here."
    assert got == [(1, "u", text, len(text)), (2, "u", "", 0), (3, "", "", 0), (3, "v", text, len(text))]
