"""The corpus pipeline stage by stage, against what its operators say of each document."""

import os

import pytest

import corpus_pipeline
from tests.llm import edge
from tests.llm.test_edges import ASCII, NORMAL, WORD
from wordloom.llm import quality_classifier
from wordloom.llm.common import table, written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, docs := written(stage(spark, docs, SF))))
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_stages(spark, outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "mixing"]
    for before, after in outputs[:-1]:
        assert after.columns == before.columns and set(ids(after)) <= set(ids(before)) and len(ids(after)) == len(set(ids(after)))


def test_quality(spark, outputs):
    before, after = outputs[0]
    p = quality_classifier.classify(before, table(spark, SF, "labels"))
    assert sorted(ids(after)) == sorted(ids(p.where("predicted = 1")))
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    held = [r for r in p.collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.8 * len(held)


def test_language(outputs):
    before, after = outputs[1]
    assert len(ids(after)) >= 0.95 * len(ids(before))


def test_near_duplicates(outputs):
    before, after = outputs[2]
    sets = {}
    for r in before.collect():
        ws = WORD.findall((r.text or "").translate(ASCII))
        sets[r.doc_id] = {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set()
    kept = set()
    link = {k: k for k in sets}

    def find(i):
        while link[i] != i:
            i = link[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                link[y] = x
    kept = {find(a) for a in sets}
    assert sorted(ids(after)) == sorted(kept)


def test_decontamination(spark, outputs):
    """No kept document holds any window, and every other one is kept."""
    before, after = outputs[3]
    texts = [r.text for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[i : i + 13]) for t in texts for w in [NORMAL.findall(t.translate(ASCII))] for i in range(max(1, len(w) - 12))}
    lengths = {len(w) for w in windows}
    want = []
    for r in before.collect():
        ws = NORMAL.findall(r.text.translate(ASCII))
        if not any(tuple(ws[i : i + n]) in windows for n in lengths for i in range(len(ws) - n + 1)):
            want.append(r.doc_id)
    assert sorted(ids(after)) == sorted(want) and len(want) < before.count()


def test_mixing(outputs):
    before, after = outputs[4]
    rows = after.collect()
    assert sorted(r.doc_id for r in rows) == sorted(ids(before))
    assert abs(sum(r.taken for r in rows) - sum(r.size for r in rows)) <= 20


def test_run_is_the_stages(spark, outputs):
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, outputs[-1][1].collect()))


def test_stages_take_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, and an empty table."""
    edge.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    edge.benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = edge.documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, none = stage(spark, docs, str(tmp_path)), stage(spark, edge.empty(spark), str(tmp_path))
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert none.count() == 0
    assert corpus_pipeline.mixing(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.mixing(spark, edge.empty(spark), str(tmp_path)).count() == 0
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).where("doc_id in (1, 10, 11) or text is null").collect()
    assert {r.doc_id for r in kept} == {6, None}
