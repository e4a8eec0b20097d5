"""Golden outputs on model files where they are at hand, the two forms of tagging, trainers, errors and the command line."""

import io
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from wordloom import api, cli, errors
from wordloom.operators import evaluate, features, segment, tagger, train
from wordloom.plans import samples
from wordloom.sources import models, scratch
from wordloom.sources.models import PerceptronModel, StumpModel, TwoStageModel

#: A folder of model files by language; their outputs are known.
MODELS = os.environ.get("WORDLOOM_MODELS", "")
GOLDEN = [
    ("english.model", "en", "I don't know.", ["I", " ", "do", "n't", " ", "know", "."]),
    ("english.model", "en", "The price is $1,000.", ["The", " ", "price", " ", "is", " ", "$", "1,000", "."]),
    ("korean.model", "ko", "2024년 봄.", ["2024년", " ", "봄", "."]),
    ("RWCP.model", "ja", "価格は1000円です。", ["価格", "は", "1", "0", "0", "0", "円", "です", "。"]),
    ("JEITA_Genpaku_ChaSen_IPAdic.model", "ja", "こんにちは", ["こん", "にち", "は"]),
]


@pytest.mark.parametrize("file, language, line, want", GOLDEN)
def test_golden(file, language, line, want):
    path = os.path.join(MODELS, file)
    if not MODELS or not os.path.exists(path):
        pytest.skip("no model files")
    own = api.Segmenter(models.load_model(path), language)
    assert own.segment_batch([line]) == [want]
    text = own.segmenter.model.dump()
    assert abs(StumpModel.parse(text).bias - own.segmenter.model.bias) < 1e-9


def random_two_stage(rng, lines):
    """A model whose features are drawn from the lines', with fixed, ambiguous and unknown words."""
    classes = ["ADJ", "NOUN", "PROPN", "VERB"]
    words = sorted({w for ws in segment.Segmenter(samples.POINTWISE, "en").segment_batch(lines) for w in ws})
    lexicon = {w: [(t, rng.randint(1, 20)) for t in rng.sample([*classes, "INTJ"], rng.randint(1, 3))] for w in rng.sample(words, len(words) // 2)}
    pool = [f"WS:{w}" for w in words] + [f"WL:{n}" for n in range(1, 5)]
    chars = sorted({c for x in lines for c in x}) + ["\u0001", "\u0002"]
    kinds = ["A", "U", "W", "P", "N", "Q", "O", "\u0001", "\u0002"]
    for k in ("FC", "LC", "L1", "L2", "L3", "R1", "R2", "R3"):
        pool += [f"{k}:{c}" for c in chars]
    for k in ("LB", "RB", "P2", "S2"):
        pool += [f"{k}:{rng.choice(chars)}{rng.choice(chars)}" for _ in range(60)]
    for k in ("ft", "lt", "cl1", "cl2", "cl3", "cr1", "cr2", "cr3"):
        pool += [f"{k}:{c}" for c in kinds]
    pool += ["TS:AAA", "TS:UA", "TS:P", "TS:AAAAAAAA"]
    weights = {f: {c: float(rng.randint(-3, 3)) for c in rng.sample(classes, 2)} for f in rng.sample(pool, min(len(pool), 250))}
    return TwoStageModel(samples.POINTWISE, lexicon, PerceptronModel(classes, weights), 0.8)


def test_both_forms_of_tagging_agree(spark, monkeypatch):
    rng = random.Random(5)
    lines = ["".join(rng.choice("abc dE1,'é") for _ in range(rng.randint(0, 50))) for _ in range(60)] + ["", "a", "I don't know.", "\u0001x \u0002"]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    monkeypatch.setattr(tagger, "SURFACES", 40)
    for _ in range(2):
        m = random_two_stage(rng, lines)
        words = segment.Segmenter(samples.POINTWISE, "en").segment(df)
        want = {(r.id, r.word_no): (r.surface, r.pos) for r in tagger.tag_words(words, m, "en", "words", ("id",)).collect()}
        got = {(r.id, i): (t.surface, t.pos) for r in tagger.segment_with_pos(df, m, "en").collect() for i, t in enumerate(r.tokens)}
        assert got == want
        batch = api.Segmenter(m, "en").segment_with_pos_batch(lines)
        assert {(k, i): tuple(t) for k, ts in enumerate(batch) for i, t in enumerate(ts)} == want
    empty = TwoStageModel(samples.POINTWISE, {"a": [("NOUN", 2)]}, PerceptronModel())
    assert api.Segmenter(empty, "en").segment_with_pos_batch(["a b"]) == [[("a", "NOUN"), (" ", "X"), ("b", "X")]]
    nulls = tagger.segment_with_pos(spark.createDataFrame([(1, None), (2, "")], "id int, line string"), m, "en").collect()
    assert {r.id: r.tokens for r in nulls} == {1: None, 2: []}


def test_a_long_line_passes(spark):
    """100,000 characters: features, offsets, words, tags and sentences are linear in a line's length."""
    line = " ".join(["word", "an", "Ox."] * 9_000)
    df = spark.createDataFrame([(1, line)], "id int, line string")
    assert len(line) > 90_000
    rows = features.extract(df, "en", keys=("id",))
    assert rows.agg(F.count("pos"), F.min(F.size("features")), F.max(F.size("features"))).first()[:] == (len(line.replace(" ", "")) - 1, 38, 38)
    tagged = df.withColumn("line", F.regexp_replace("line", r"(\w)( |$)", "$1/NOUN$2"))
    assert features.extract_stage2(features.gold_tokens(tagged, False, True), "en", keys=("id",)).count() == 27_000
    tokens = api.Segmenter(samples.POINTWISE, "en").segment_tokens(df).select(F.size("tokens"), F.col("tokens")[F.size("tokens") - 1]["end"]).first()
    assert tokens[1] == len(line)
    assert tagger.segment_with_pos(df, samples.TWO_STAGE, "en").select(F.size("tokens")).first()[0] == tokens[0]


def test_trainers_measure_and_cancel(spark):
    rows = [(i, "B" if i % 3 else "O", [f"f{i % 3}", f"g{i % 5}"]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, label string, features array<string>")
    trainer = api.PerceptronTrainer(df, 3, ("id",))
    model, metrics = trainer.train()
    assert metrics.first().accuracy > 80 and model == train.Perceptron().fit([(y, f) for _, y, f in rows], 3)
    with pytest.raises(errors.AlreadyTrained):
        trainer.train()
    stopped = api.PerceptronTrainer(df, 10_000, ("id",))
    threading.Timer(1.0, stopped.cancel.set).start()
    began = time.time()
    assert stopped.train()[0].classes == ["B", "O"] and time.time() - began < 60
    lines = spark.createDataFrame(list(enumerate(samples.TAGGED_CORPUS)), "id int, line string")
    m, one, two = api.TwoStageTrainer(lines, "ja", ("id",), epochs=4).train()
    assert m.lexicon and one.first().classes == 2 and two.first().accuracy > 50
    grown = train.add_instance(df.select(F.lit(1).alias("label"), "features"), -1, ["new"])
    assert "new" in train.train_stumps(grown, 0.01, 2).weights
    assert evaluate.binary_metrics(train.stump_predictions(grown, StumpModel()), "label", "predicted").first().tp == 60


def test_errors_and_cache(tmp_path, spark):
    kinds = {errors.InvalidArgument: "invalid_argument", errors.ModelError: "model", errors.PosUnavailable: "pos_unavailable", errors.Unsupported: "unsupported", FileNotFoundError: "io", KeyError: "runtime"}
    assert all(errors.kind_of_error(k("x")) == v and v in errors.KINDS for k, v in kinds.items())
    with pytest.raises(errors.Unsupported):
        api.Segmenter(StumpModel(), "latin")
    with pytest.raises(errors.PosUnavailable):
        api.Segmenter(StumpModel(), "en").segment_with_pos_batch(["a"])
    assert api.Segmenter(StumpModel(), "en").segment_with_pos_batch([""]) == [[]]
    f = tmp_path / "m.model"
    f.write_text("0.0\n")
    assert api.Segmenter.open(str(f), "en").segment_batch(["ab"]) == [["a", "b"]]
    f.write_text("UW4:b\t-2\n0\n")
    assert api.Segmenter.open(str(f), "en").segment_batch(["ab"]) == [["ab"]]  # a file that changed is read again
    api.clear_model_cache()


def test_downloads_are_limited(monkeypatch):
    class Slow:
        headers = {"Content-Length": "9"}

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read1(self, _):
            return b"x"

    clock = iter(range(0, 10_000, 7))
    monkeypatch.setattr(models.urllib.request, "urlopen", lambda *a, **k: Slow())
    monkeypatch.setattr(models.time, "monotonic", lambda: next(clock))
    with pytest.raises(errors.ReadError, match="60 s"):
        models.read_bytes("https://example.com/m", allow_http=True)
    monkeypatch.setattr(models, "MAX_DOWNLOAD", 5)
    with pytest.raises(errors.ReadError, match="large"):
        models.read_bytes("https://example.com/m", allow_http=True)


def test_segment_pipes_lines(tmp_path):
    (tmp_path / "m").write_text(samples.TWO_STAGE.dump())
    source = [f"  red bolt {i}. \n" for i in range(9_000)] + ["\n", "small\n"]
    out = {}
    for pos in ((), ("--pos",)):
        args = cli.parser().parse_args(["segment", "-l", "en", "--threads", "2", *pos, str(tmp_path / "m")])
        sink = io.StringIO()
        cli.pipe(args, source, sink)
        out[pos] = sink.getvalue().split("\n")
    assert len(out[()]) == 9_002 and out[()][7] == "red   bolt   7 ." and out[("--pos",)][7].startswith("red/") and out[()][-2] == "small"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["segment", "--threads", "0", "m"])


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())
