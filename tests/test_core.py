import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import chartypes, templates
from wordloom.functions import text as T
from wordloom.operators import evaluate, features, segment, tagger, train
from wordloom.plans import samples
from wordloom.sources import corpus, models
from wordloom.sources.models import ModelError, PerceptronModel, StumpModel, TwoStageModel


def test_char_types():
    t = chartypes.char_type_of
    assert [t(c, "japanese") for c in "一漢々ヵひカーｱ、aＺ9é"] == list("MHHHIKKKPAANO")
    assert [t(c, "chinese") for c in "的漢㐂⺀ㄅ。a1é"] == list("FCXRBPANO")
    assert [t(c, "korean") for c in "은가각ᄀㄱ漢。a1é"] == ["E", "SN", "SF", "J", "G", "H", "P", "A", "N", "O"]
    assert [t(c, "english") for c in "Aa1 '’,@\t\n–。é"] == list("UANWQQPPWOPPO")
    for lang in chartypes.LANGUAGES:
        table, codes = chartypes.type_table(lang), chartypes.type_codes(lang)
        for c in samples.CJK + "".join(map(chr, range(0x20, 0x3200, 7))):
            assert codes[table[ord(c)]] == t(c, lang)
        assert not any(a != b and a.startswith(b) for a in codes for b in codes)
    assert chartypes.parse_language("JA") == "japanese"
    with pytest.raises(ValueError):
        chartypes.parse_language("latin")


def test_templates():
    assert len(templates.BOUNDARY) == 42 and len(templates.TAG_DEPENDENT) == 16
    assert [len(templates.boundary_templates(x)) for x in chartypes.LANGUAGES] == [42, 42, 38, 38]
    assert {k: len(v) for k, v in templates.WORD_SETS.items()} == {"fast": 10, "balanced": 13, "full": 23}
    assert all(templates.is_tag_dependent(f"{k}:x") == (k in templates.TAG_DEPENDENT) for k in templates.BOUNDARY)


def by_strings(model, language, line):
    """Segmentation by rendering every feature of every position as a string."""
    w = [*templates.BEGIN, *line, *templates.END]
    c = ["O"] * 3 + [chartypes.char_type_of(x, language) for x in line] + ["O"] * 3
    p, words = ["U"] * 4, [line[:1]] if line else []
    for i in range(4, len(line) + 3):
        at = {"w": w, "c": c, "p": p}
        found = [f"{k}:" + "".join(at[s[0]][i - 3 + int(s[1])] for s in slots) for k, slots in templates.boundary_templates(language).items()]
        if model.bias + sum(model.weights.get(f, 0.0) for f in found) >= 0:
            p.append("B")
            words.append(line[i - 3])
        else:
            p.append("O")
            words[-1] += line[i - 3]
    return words


STRESS = ["", "x", "xyz", "B1x", "xB1", "B1", "B1テスト", "E1E2E3", "UOBそのタグ", "SNSF가나한글", "これはテストです。", "I don't know.", "a 3.14 b", "가각 은 한글", "中文的字㐂", "😀é\u0001"]


@pytest.mark.parametrize("language", chartypes.LANGUAGES)
def test_compiled_equals_strings(language):
    rng = random.Random(language)
    for tagged in (False, True):
        pool = set()
        for line in STRESS:
            w, c = [*templates.BEGIN, *line, *templates.END], ["O"] * 3 + [chartypes.char_type_of(x, language) for x in line] + ["O"] * 3
            for i in range(4, len(line) + 3):
                for k, slots in templates.boundary_templates(language, not tagged).items():
                    at = {"w": w, "c": c}
                    pool.add(f"{k}:" + "".join(rng.choice("UBO") if s[0] == "p" else at[s[0]][i - 3 + int(s[1])] for s in slots))
        for _ in range(4):
            own = {f: float(rng.randint(-4, 4)) for f in rng.sample(sorted(pool), min(len(pool), 300))} | {"TW1:abc": 3.0, "nonsense": 1.0, "UW1:": 2.0, "BC2:zz": 1.0}
            m = StumpModel({"": rng.randint(-3, 3) * 2.0 - sum(own.values()), **own})
            s = segment.Segmenter(m, language)
            assert s.segment_batch(STRESS) == [by_strings(m, language, x) for x in STRESS]


def test_segmentation_tiles_lines_and_blocks(monkeypatch):
    rng = random.Random(1)
    lines = ["".join(rng.choice("ab, 1'Aé") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for m in (samples.POINTWISE, samples.TAGGED):
        s = segment.Segmenter(m, "en")
        whole = s.segment_batch(lines)
        assert ["".join(w) for w in whole] == lines and all(all(w) for w in whole)
        monkeypatch.setattr(segment, "BLOCK", 50)
        assert s.segment_batch(lines) == whole
        monkeypatch.undo()
    assert [(a, b) for _, a, b in segment.Segmenter(samples.POINTWISE, "en").tokens_text("é a")] == [(0, 2), (2, 3), (3, 4)]
    assert segment.Segmenter().segment_text("テスト") == list("テスト")


def test_segment_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b", [1]), (2, None, None), (3, "", [])], "id int, line string, words array<int>")
    got = {r.id: r.words for r in segment.Segmenter(samples.POINTWISE, "en").segment(df).collect()}
    assert got == {1: ["a", " ", "b"], 2: None, 3: []}


def test_stump_model_files():
    m = StumpModel.parse("0.5\nfeat1\t0.5\n")
    assert m.weights[""] == -1.0 and m.bias == 0.25
    assert StumpModel.parse("feat1\t0.5\n0.5\n").bias == 0.5
    m = StumpModel.parse("b\t-0.25\na\t1e-7\nz\t0\n2\n")
    assert m.dump() == "a\t0.0000001\nb\t-0.25\n2\n" and StumpModel.parse(m.dump()).weights == {k: w for k, w in m.weights.items() if k != "z"}
    for bad in ("", "a\t1\n", "1\n2\n", "a\t1\na\t2\n0\n", "a\tnan\n0\n", "a\tx\n0\n", "inf\n", "a\t1\n\n0\n"):
        with pytest.raises(ModelError):
            StumpModel.parse(bad)
    assert StumpModel.parse("a\t1\nb\t-3\nc\t1\n0\n").pruned(2) == "b\t-3\na\t1\n0\n"
    assert [models.number_text(x) for x in (2.0, 1e-7, -0.5, 1e21)] == ["2", "0.0000001", "-0.5", "1000000000000000000000"]


def test_perceptron_and_two_stage_files():
    p = samples.CLASSIFIER
    assert PerceptronModel.parse(p.dump()) == p and PerceptronModel().predict(["x"]) == ""
    two = samples.TWO_STAGE
    again = TwoStageModel.parse(two.dump())
    assert TwoStageModel.parse(again.dump()).dump() == again.dump() and again.stage1.weights == two.stage1.weights and again.fixed("small") == "ADJ" and again.fixed("red") is None and again.fixed("?") is None
    assert [models.kind_of(x) for x in (two.dump(), p.dump(), samples.POINTWISE.dump(), "-0.0332\n")] == ["two-stage", "perceptron", "stumps", "stumps"]
    text = two.dump()
    for bad in (text.replace("two-stage v1", "two-stage v2"), text.replace("[lexicon]", "[lexikon]"), text.replace("dominance\t0.9", "dominance\t0.4"), text.replace("ADJ:4", "ADJ:0"), text.replace("ADJ:4", "BAD:4")):
        with pytest.raises(ModelError):
            TwoStageModel.parse(bad)
    assert models.parse_params([]) == 0.99
    for bad in (["a"], ["\tADJ:1"], ["a\tADJ:1", "a\tADJ:2"], ["a\tADJ:1,ADJ:2"]):
        with pytest.raises(ModelError):
            models.parse_lexicon(bad)


def test_read_bytes(spark, tmp_path):
    f = tmp_path / "m.model"
    f.write_bytes(b"0\n")
    assert models.read_bytes(str(f)) == models.read_bytes(f"file://{f}") == b"0\n"
    with pytest.raises(ValueError):
        models.read_bytes("https://example.com/m")


def test_collapse_equals_two_classes():
    p = train.Perceptron().fit([("B", ["f1", "s"]), ("O", ["f2", "s"]), ("B", ["f3"]), ("O", ["f4"])] * 2, 3)
    c = p.collapsed()
    for features_ in (["f1"], ["f2"], ["f3", "s"], ["f4"], ["s"], ["f1", "f2"]):
        b, o = p.scores(features_)
        assert (c.predict(set(features_)) == 1) == (b >= o) or abs(b - o) < 1e-9


def stumps_by_hand(instances, threshold, rounds):
    import math

    names = sorted({f for _, fs in instances for f in fs})
    w, d = {"": 0.0} | dict.fromkeys(names, 0.0), [1.0] * len(instances)
    for _ in range(rounds):
        total, pos = sum(d), sum(x for x, (y, _) in zip(d, instances) if y > 0)
        best, rate = "", pos / total
        for f in names:
            e = (pos - sum(x * y * fs.count(f) for x, (y, fs) in zip(d, instances))) / total
            if abs(0.5 - e) > abs(0.5 - rate) + 1e-12:
                best, rate = f, e
        if abs(0.5 - rate) < threshold:
            break
        a = 0.5 * math.log(max(1 - rate, 1e-10) / max(rate, 1e-10))
        w[best] += a
        d = [x * math.exp(a) if y * (1 if best in fs else -1) < 0 else x / math.exp(a) for x, (y, fs) in zip(d, instances)]
        d = [x / sum(d) for x in d]
    return w


def test_boosting(spark):
    rng = random.Random(3)
    data = [(1 if rng.random() < 0.55 else -1, [f for f in "abcdefg" if rng.random() < 0.4]) for _ in range(60)]
    data = [(y, fs + (["p"] if (y > 0) == (rng.random() < 0.8) else [])) for y, fs in data]
    df = spark.createDataFrame(data, "label int, features array<string>").coalesce(1)
    m, want = train.train_stumps(df, 0.01, 6), stumps_by_hand(data, 0.01, 6)
    assert m.weights.keys() == want.keys() and all(abs(m.weights[k] - w) < 1e-6 for k, w in want.items())
    more = train.train_stumps(df, 0.01, 1, StumpModel({"": 1.0, "new": 2.0}))
    assert more.weights["new"] == 2.0
    metrics = evaluate.binary_metrics(train.stump_predictions(df, m), "label", "predicted").first()
    assert metrics.tp == sum(y > 0 and m.predict(set(f)) > 0 for y, f in data)
    assert train.train_stumps(df.limit(0)).bias == 0


def test_perceptron_in_spark_equals_local(spark):
    rng = random.Random(4)
    data = [(i, rng.choice("ABC"), [f"f{rng.randint(0, 9)}" for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(data, "id int, label string, features array<string>").repartition(4)
    assert train.perceptron_of(train.train_perceptron(df, 3, ("id",))) == train.Perceptron().fit([(y, f) for _, y, f in data], 3)


def test_sentences(spark):
    lines = ["これはテストです。次の文です。", "「はい。」と言った。終わり", "One. Two? e.g.x 3.14!", "(a. b) c. d", "） x. y", "", "  。 "]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    a = {r.id: r.s for r in df.select("id", corpus.split_sentences(F.col("line")).alias("s")).collect()}
    assert a[0] == ["これはテストです。", "次の文です。"] and a[1] == ["「はい。」と言った。", "終わり"]
    assert a[2] == ["One.", "Two?", "e.g.x 3.14!"] and a[3] == ["(a. b) c.", "d"] and a[4] == ["） x.", "y"] and a[5] == [] and a[6] == ["。"]
    b: dict = {i: [] for i in a}
    for r in corpus.sentence_rows(df, "line", "id").orderBy("id", "sentence_no").collect():
        b[r.id].append(r.sentence)
    assert a == b


def test_metrics(spark):
    one = lambda g, p: evaluate.evaluate_segmentation(spark.createDataFrame([(g, p)], "gold array<string>, predicted array<string>")).first()
    assert one(["これ", "は"], ["これ", "は"]).word_f1 == 100 and one(["これ", "は"], ["こ", "れは"]).word_f1 == 0
    assert one(["a", " ", "b"], ["a", " ", "b"]).gold_words == 2
    m = evaluate.macro_metrics(spark.createDataFrame([("a", "a"), ("b", "a")], "g string, p string"), "g", "p", ["a", "b", "c"]).first()
    assert (m.accuracy, m.classes) == (50, 3) and abs(m.macro_precision - 50 / 3) < 1e-9


def test_two_stage_round_trip(spark):
    lines = spark.createDataFrame(list(enumerate(samples.TAGGED_CORPUS)), "id int, line string")
    m = train.train_two_stage(lines, "japanese", ("id",), epochs=8)
    again = TwoStageModel.parse(m.dump())
    assert again.lexicon == m.lexicon and again.stage2 == m.stage2 and abs(again.stage1.bias - m.stage1.bias) < 1e-9
    out = tagger.segment_with_pos(spark.createDataFrame([(1, "これはテストです。"), (2, "")], "id int, line string"), m, "japanese").collect()
    by = {r.id: [(t.surface, t.pos) for t in r.tokens] for r in out}
    assert by == {1: [("これ", "PRON"), ("は", "PART"), ("テスト", "NOUN"), ("です", "AUX"), ("。", "PUNCT")], 2: []}
    rows = features.extract_stage1(lines.where("id < 2"), "japanese", keys=("id",))
    assert rows.count() == 16 and features.extract_stage2(features.gold_tokens(lines.where("id < 2"), False, True), "japanese", keys=("id",)).count() == 9
    assert features.lexicon(features.gold_tokens(lines.where("id < 2"), False, True)).count() == 6


def test_feature_lines_round_trip(spark):
    rows = features.extract(spark.createDataFrame([("これ は テスト です 。",)], "line string"), "ja")
    back = features.read_feature_lines(features.feature_lines(rows))
    assert sorted((int(r.label), r.features) for r in back.collect()) == sorted((r.label, r.features) for r in rows.collect())
    assert rows.select(F.size("features")).distinct().collect()[0][0] == 42


def test_stream(spark, tmp_path):
    from wordloom.streaming.lines import read_line_stream, running_counts, segment_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("red bolt\n\n  red nut. \n")
    out = running_counts(segment_stream(read_line_stream(spark, str(tmp_path / "in")), segment.Segmenter(samples.POINTWISE, "en")))
    q = out.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.word: r["count"] for r in spark.table("counts").collect()} == {"red": 2, " ": 2, "bolt": 1, "nut": 1, ".": 1}


def test_command_line(spark, tmp_path):
    from wordloom import cli

    p = lambda x: str(tmp_path / x)
    (tmp_path / "gold").write_text("これ は テスト です 。\nこれ も テスト 。\n")
    run = lambda *a: cli.run(cli.parser().parse_args(list(a)), spark)
    run("extract", "-l", "ja", p("gold"), p("feats"))
    run("train", "-i", "8", p("feats"), p("m"))
    (tmp_path / "text").write_text("これはテストです。\n\nこれも\n")
    run("segment", "-l", "ja", p("m"), p("text"), p("out"))
    lines = [r.value.replace(" ", "") for r in spark.read.text(p("out")).collect()]
    assert sorted(lines) == sorted(["これはテストです。", "これも"])
    run("evaluate", "-l", "ja", p("m"), p("gold"))
    with pytest.raises(ValueError):
        run("extract", "--pos", "--tag-free", p("gold"), p("x"))


def test_labels_and_trim(spark):
    df = spark.createDataFrame([("　 a b ",)], "s string")
    assert df.select(T.trim(F.col("s"))).first()[0] == "a b"
    assert np.array_equal(segment.Compiled(StumpModel(), "en").starts(["ab", ""])[1], np.zeros(0))
