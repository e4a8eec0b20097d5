"""Operators at size: the forms that run whole tables against plain ones, and plans without what grows with the input."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from tests.test_queries import SF
from wordloom.operators import features, train
from wordloom.plans import samples
from wordloom.sources import corpus, models


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def summed(rows, place):
    """What the digests say, from the features as rows."""
    out: dict = {}
    for r in rows.collect():
        text = "|".join([str(r[place]), *([str(r.label)] if r.label is not None else []), "\t".join(r.features)])
        n, d = out.get(r.id, (0, 0))
        out[r.id] = n + 1, d + int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    return out


ODD = ["a\u0001b c%s/d", "%s %d/%", "\u0002", "x" * 9000, "é 漢字 　 a//b", "", " ", None, "a/NOUN b/NOPE /X c"]


def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD + samples.TAGGED_CORPUS)), "id int, line string")


def test_boundary_digests(spark):
    for language, tag_free, pos in (("english", False, False), ("japanese", True, False), ("korean", False, True)):
        gold = features.gold_tokens(odd(spark), False, pos)
        rows = features.extract_stage1(odd(spark), language, keys=("id",)) if pos else features.extract(odd(spark), language, False, tag_free, ("id",))
        found = features.boundary_digests(gold, language, ("B", "O") if pos else ("1", "-1"), tag_free, pos, ("id",))
        assert {r.id: (r.n, r.digest) for r in found.collect()} == summed(rows, "pos")


def test_extract_plans(spark):
    """A position's features never leave their worker: no row a position is shuffled."""
    for name in ("q_extract_tag_free", "q_extract_stage1", "q_extract_boundary", "q_word_features_fast", "q_word_features_full", "q_word_features_balanced"):
        assert "_cell" not in plan(spark, name) and plan(spark, name).count("Exchange hashpartitioning") == 1


def test_word_digests(spark):
    gold = features.gold_tokens(odd(spark), False, True)
    for which in ("fast", "balanced", "full"):
        found = features.word_digests(gold, "japanese", which, ("id",))
        assert {r.id: (r.n, r.digest) for r in found.collect()} == summed(features.extract_stage2(gold, "japanese", which, ("id",)), "word_no")
    by = {r.id: r.features for r in features.extract_stage2(gold, "japanese", "full", ("id",)).where("word_no = 0").collect()}
    assert by[0] == ["WS:a\u0001b", "WL:3", "FC:a", "LC:b", "ft:A", "lt:A", "TS:AOA", "L1:\u0001", "L2:\u0001", "L3:\u0001", "R1:c", "R2:%", "R3:s", "cl1:\u0001", "cl2:\u0001", "cl3:\u0001", "cr1:A", "cr2:O", "cr3:A", "LB:\u0001\u0001", "RB:c%", "P2:a\u0001", "S2:\u0001b"]


@pytest.fixture
def collected(monkeypatch):
    """The columns and numbers of rows that the driver collects."""
    found, plain = [], DataFrame.collect

    def collect(self):
        rows = plain(self)
        found.append((tuple(self.columns), len(rows)))
        return rows

    monkeypatch.setattr(DataFrame, "collect", collect)
    return found


@pytest.mark.parametrize("name", ["q_lexicon_entries", "q_two_stage_file", "q_lexicon_file", "q_perceptron_file"])
def test_lexicons_stay_with_the_executors(spark, collected, name):
    rows = entry.queries()[name](spark, SF)
    assert all(n < 50 for columns, n in collected if columns != ("p_partkey", "p_size") and "id" not in columns)  # the first stage is bounded by characters
    assert not any("surface" in columns or "p_name" in columns for columns, _ in collected) and rows.count() > 0


def test_two_stage_files_in_parallel(spark, tmp_path):
    two, path = samples.TWO_STAGE, str(tmp_path / "m")
    stage2 = models.class_weights_frame(spark, two.stage2).repartition(3)
    models.write_two_stage(two.stage1, models.lexicon_frame(spark, two.lexicon).repartition(3), stage2, two.stage2.classes, two.dominance, path)
    lines = corpus.read_corpus(spark, path)
    assert [r.line for r in lines.orderBy("id").collect()] == two.dump().split("\n")[:-1]
    stage1, lexicon, classes, weights, dominance = models.read_two_stage(lines)
    again = models.TwoStageModel(stage1, {r.surface: [(t.tag, t["count"]) for t in r.tags] for r in lexicon.collect()}, train.perceptron_of(weights), dominance)
    assert again.dump() == models.TwoStageModel.parse(two.dump()).dump() and classes == two.stage2.classes
    for i, (old, new) in enumerate((("[lexicon]", "[lexikon]"), ("ADJ:4", "ADJ:0"), ("ADJ:4", "BAD:4"), ("two-stage v1", "two-stage v2"), ("dominance\t0.9", "dominance\t0.4"), ("[stage2]\n", "[stage2]\nx"), ("blue\t", "red\t"), ("WL:3\t", "WL:4\tNOUN\t1\nWL:3\t"))):
        bad = tmp_path / f"bad{i}"
        bad.write_text(two.dump().replace(old, new, 1))
        with pytest.raises(Exception, match="(?i)model|lexicon|section|class|twice|dominance|line"):
            _, lexicon, _, weights, _ = models.read_two_stage(corpus.read_corpus(spark, str(bad)))
            lexicon.collect(), weights.collect()


def test_lines_of_files_of_all_sizes_are_numbered_in_order(spark, tmp_path):
    """Spark reads large files first and packs several into a task."""
    want = []
    for i, n in enumerate((3, 4000, 1, 700, 0, 90)):
        own = [f"{i} {k} {'x' * (k % 7)}" if k % 5 else "" for k in range(n)]
        (tmp_path / f"part-{i:05d}.txt").write_text("".join(f"{x}\n" for x in own))
        want += own
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("3000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert [(r.id, r.line) for r in corpus.read_corpus(spark, str(tmp_path)).orderBy("id").collect()] == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_treebank_in_one_sort(spark):
    """A shuffle by file and no window: what is held is a sentence, not a file's lines."""
    rows = entry.queries()["q_treebank"](spark, SF)
    found = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in found and found.count("Exchange") == 1


def test_treebank_edges(spark):
    lines = ["1\ta\t_\tX", "", "", "# c", "2-3\tab\t_\t_\t_\t_\t_\t_\t_\tSpaceAfter=No", "2\tb\t_\tX", "3\tc\t_\tX", "4\td\t_\tX", " \t", "short\tline", "", "x\te\t_\tX"]
    df = spark.createDataFrame([(f, i, x) for f in (7, 8) for i, x in enumerate(lines)], "file int, line_no int, line string").repartition(5)
    want = [(f, *x) for f in (7, 8) for x in ((0, "a/X"), (1, "b/X\tc/X\td/X"), (2, "e/X"))]
    assert sorted(tuple(r) for r in corpus.conllu(df, pos=True, spaced=True).collect()) == want
    assert corpus.conllu(df.limit(0)).collect() == []


def test_stream_result_isn_t_held_by_the_driver(spark):
    assert "Scan parquet" in plan(spark, "q_stream_word_counts")


def plain_perceptron(data, epochs, model=None):
    """The averaged perceptron as it is defined."""
    data = [(y, sorted(set(f))) for y, f in data if f]
    classes = sorted({*(model.classes if model else ()), *(y for y, _ in data)})
    w = {f: dict(own) for f, own in (model.weights if model else {}).items()}
    total: dict = {}
    steps = 0
    for _ in range(epochs):
        for y, f in data:
            guess = max(classes, key=lambda c: sum(w.get(x, {}).get(c, 0.0) for x in f))
            for x in f if guess != y else ():
                own = w.setdefault(x, {})
                own[y], own[guess] = own.get(y, 0.0) + 1, own.get(guess, 0.0) - 1
            for x in w:
                for c, v in w[x].items():
                    total[x, c] = total.get((x, c), 0.0) + v
            steps += 1
    return {k: v / steps for k, v in total.items() if v}


def test_perceptron_of_streamed_batches(spark):
    """Batches, repeated features and instances without any; the same weights as the definition, in bounded memory."""
    rng = random.Random(5)
    data = [(rng.choice("CAB"), [f"f{rng.randint(0, 12)}" for _ in range(rng.randint(0, 5))]) for _ in range(300)]
    start = models.PerceptronModel(["A", "Z"], {"f1": {"A": 2.0}, "old": {"Z": 1.0}})
    for model in (None, start):
        want = plain_perceptron(data, 3, model)
        batches = [(pa.array([y for y, _ in part]), pa.array([f for _, f in part], pa.list_(pa.string()))) for part in (data[:7], data[7:7], data[7:200], data[200:])]
        for m in (train.Perceptron(model).fit_batches(iter(batches), 3), train.Perceptron(model).fit(data, 3)):
            got = {(f, c): v for f, own in m.weights.items() for c, v in own.items()}
            assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    rows = spark.createDataFrame([(i, y, f) for i, (y, f) in enumerate(data)], "id int, label string, features array<string>").repartition(6)
    trained = train.train_perceptron(rows, 3, ("id",))
    assert "FlatMapGroupsInArrow" not in trained._jdf.queryExecution().executedPlan().toString()
    assert train.perceptron_of(trained) == train.Perceptron().fit(data, 3)
