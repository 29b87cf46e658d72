import duckdb
import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import catalog
from tests.conftest import SF
from tests.llm.test_documents import brute_components, brute_contamination, brute_lines, sentence
from tests.test_oracle import rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLE_SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        left = docs.count()
        assert 0 < left <= n
        n = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n


def test_every_operator_has_a_query():
    numbers = sorted(int(k[2:].split("_")[0]) for k in catalog.QUERIES)
    assert numbers == list(range(1, 14))


def odd_corpus(spark, folder):
    """Documents with planted toxic ones, passages, exact and near copies, benchmark passages, blanks and a null id."""
    rng = np.random.default_rng(12)
    text = lambda n: sentence(rng, n, 10**6)
    texts = [text(int(rng.integers(30, 90))) for _ in range(60)]
    docs = [(k, t) for k, t in enumerate(texts)]
    toxic = {k for k in range(60) if k % 6 == 5}
    docs = [(k, f"{t} you zhorvath quixxen zhorvath wugglydd" if k in toxic else t) for k, t in docs]
    near = texts[0].split()
    near[7] = "changed"
    item, passage = text(25), text(60)
    docs += [(100, texts[1]), (101, " ".join(near)), (102, f"{text(20)} {item} {text(20)}"), (103, f"{text(15)}\n{passage}"), (104, f"{passage}\n{text(15)}")]
    docs += [(105, None), (106, ""), (107, " \n"), (None, texts[2]), (108, "two words"), (109, "x " * 9000)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k in toxic)) for k in range(60)] + [(105, 0), (107, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i1", item), ("i2", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}"
    item = odd_corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = [[tuple(r) for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), "test")
        left.append([tuple(r) for r in docs.collect()])
    scored = {r.doc_id: r.predicted for r in catalog.op10_toxicity(spark, folder).collect()}
    assert sorted(map(str, left[1])) == sorted(str(r) for r in left[0] if not scored[r[0]])
    assert not {k for k in range(60) if k % 6 == 5} & {r[0] for r in left[1]} and len(left[1]) == len(left[0]) - 10
    whole = {r[0]: r[1] for r in left[1] if r[0] is not None and r[1] is not None}
    cut = brute_lines(sorted(whole.items()))
    want = {i: t for i, t in cut.items() if t.strip() or not whole[i].strip()}
    assert {r[0]: r[1] for r in left[2] if r[0] is not None and r[1] is not None} == want and 100 not in want
    assert all(r[4] == len(r[1] or "") for r in left[2])
    parts = {i: c for i, _, c in brute_components([(r[0], r[1]) for r in left[2] if r[0] is not None])}
    kept = {r[0] for r in left[3]}
    assert kept == {None} | {i for i, c in parts.items() if i == c} and 101 not in kept and {105, 106, 107} <= kept
    clean = {i for i, t, *_ in left[3] if not brute_contamination(t, [("i1", item)])[1]}
    assert {r[0] for r in left[4]} == clean and 102 not in clean
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == clean
    loads = {}
    for r in out:
        loads.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in loads.values():
        pieces.sort()
        assert [a for a, _ in pieces] == list(np.cumsum([0, *(n for _, n in pieces)])[:-1]) and sum(n for _, n in pieces) <= 2048


def test_pipeline_of_an_empty_table(spark, tmp_path):
    odd_corpus(spark, f"file://{tmp_path}/full")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"file://{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").isEmpty()
