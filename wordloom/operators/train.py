"""Learners: boosted stumps as a loop of grouped aggregates, the averaged perceptron, and the two-stage trainer."""

from __future__ import annotations

import itertools
import math
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators import evaluate
from wordloom.operators.features import extract_stage1, extract_stage2, gold_tokens, lexicon
from wordloom.sources.scratch import shared_dir
from wordloom.sources.models import DOMINANCE, PerceptronModel, StumpModel, TwoStageModel

#: Boosting rounds between checkpoints of the instance weights.
CUT = 8


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def feature_errors(instances: DataFrame, weight: str = "d") -> DataFrame:
    """(feature, error): -sum of weight times label over the instances that have the feature, repeats counted."""
    return instances.select(F.explode("features").alias("feature"), (F.col(weight) * F.col("label")).alias("x")).groupBy("feature").agg((-F.sum("x")).alias("error"))


def best_stump(instances: DataFrame, weight: str = "d") -> tuple[str, float, float] | None:
    """(feature, error rate, weight sum) farthest from 1/2, the bucket unless a feature is strictly farther; the first by
    name of equals. None if the weights don't add up to a positive number.

    One job: the bucket is counted as a feature of every instance, and gives the weight sums of all and of label 1."""
    w, label = F.col(weight), F.col("label")
    each = instances.select(F.explode(F.concat(F.array(F.lit("")), F.filter("features", lambda f: f != ""))).alias("feature"), w.alias("w"), label.alias("y"))
    sums = each.groupBy("feature").agg((-F.sum(F.col("w") * F.col("y"))).alias("error"), F.sum("w").alias("total"), F.sum(F.when(F.col("y") > 0, F.col("w")).otherwise(0.0)).alias("positive"))
    whole = sums.where("feature = ''").select(F.col("total").alias("n"), F.col("positive").alias("p"))  # one row
    rate = F.when(F.col("feature") == "", F.col("p") / F.col("n")).otherwise((F.col("error") + F.col("p")) / F.col("n"))
    far = sums.crossJoin(F.broadcast(whole)).select("feature", rate.alias("rate"), "n")
    row = far.orderBy(F.abs(0.5 - F.col("rate")).desc_nulls_last(), "feature").limit(1).first()
    if row is None or not row[2] or not math.isfinite(row[2]) or row[2] <= 0:
        return None
    return tuple(row)


def train_stumps(instances: DataFrame, threshold: float = 0.01, iterations: int = 100, model: StumpModel | None = None, cancel: threading.Event | None = None) -> StumpModel:
    """Boosted stumps from (label 1 or -1, features).

    A model given is kept and added to. Its scores set the first weights only if it is the learner's own; like a file
    loaded after the instances, it leaves them even."""
    names = [r[0] for r in instances.select(F.explode("features").alias("f")).distinct().orderBy("f").collect()]  # the model's size
    weights = {"": 0.0} | {f: 0.0 for f in names if f}
    if model:
        weights.update(model.weights)
    data = _cut(instances.select("label", "features", F.lit(1.0).alias("d")))
    if not data.take(1):
        return StumpModel(weights)
    for turn in range(iterations):
        if cancel is not None and cancel.is_set():
            break
        best = best_stump(data)
        if best is None or abs(0.5 - best[1]) < threshold:
            break
        feature, rate, total = best
        alpha = 0.5 * math.log(max(1.0 - rate, 1e-10) / max(rate, 1e-10))
        weights[feature] += alpha
        # The bucket is in no instance, so its stump says -1 everywhere.
        says = F.when(F.array_contains("features", feature), 1).otherwise(-1) if feature else F.lit(-1)
        data = data.withColumn("d", F.when(F.col("label") * says < 0, F.col("d") * math.exp(alpha)).otherwise(F.col("d") / math.exp(alpha)))
        # The new weights' sum: what was wrong grows, what was right shrinks.
        total = total * (rate * math.exp(alpha) + (1 - rate) / math.exp(alpha))
        if total > 0:
            data = data.withColumn("d", F.col("d") / total)
        if turn % CUT == CUT - 1:
            data = _cut(data)
    return StumpModel(weights)


def reweighted(instances: DataFrame, feature: str, alpha: float, weight: str = "d") -> DataFrame:
    """Instance weights after a stump of this alpha, adding up to 1."""
    says = F.when(F.array_contains("features", feature), 1).otherwise(-1)
    d = F.when(F.col("label") * says < 0, F.col(weight) * math.exp(alpha)).otherwise(F.col(weight) / math.exp(alpha))
    rows = instances.withColumn(weight, d)
    total = rows.agg(F.sum(weight)).first()[0] or 1.0
    return rows.withColumn(weight, F.col(weight) / total)


def averaged(updates: DataFrame, steps: int) -> DataFrame:
    """(feature, class, delta, t) of a perceptron's updates -> (feature, class, weight): the mean over all steps, without
    zeros. An update at t holds for the steps after it."""
    sums = updates.groupBy("feature", "class").agg((F.sum(F.col("delta") * (F.lit(steps) - F.col("t"))) / steps).alias("weight"))
    return sums.where("weight <> 0")


def stump_predictions(instances: DataFrame, model: StumpModel) -> DataFrame:
    """Adds predicted (1 or -1): the sign of bias and the weights of the distinct features."""
    table = F.broadcast(instances.sparkSession.createDataFrame([(model.weights,)], "w map<string,double>"))
    score = F.aggregate(F.array_sort(F.array_distinct("features")), F.lit(model.bias), lambda a, f: a + F.coalesce(F.try_element_at("w", f), F.lit(0.0)))
    return instances.crossJoin(table).withColumn("predicted", F.when(score >= 0, 1).otherwise(-1)).drop("w")  # one row: the model


class Perceptron:
    """Online averaged perceptron over instances in order."""

    def __init__(self, model: PerceptronModel | None = None):
        self.model = model or PerceptronModel()

    def fit(self, instances: list[tuple[str, list[str]]], epochs: int = 10, cancel: threading.Event | None = None) -> PerceptronModel:
        labels = pa.array([label for label, _ in instances], pa.string())
        return self.fit_batches(iter([(labels, pa.array([f for _, f in instances], pa.list_(pa.string())))] if instances else []), epochs, cancel)

    def fit_batches(self, batches: Iterator[tuple[pa.Array, pa.Array]], epochs: int = 10, cancel: threading.Event | None = None) -> PerceptronModel:
        """Learn from Arrow batches of labels and feature lists, in order. Instances are numbers in a file, read again each
        epoch; memory holds the model and a block."""
        ids: dict[str, int] = {f: k for k, f in enumerate(self.model.weights)}
        names: dict[str, int] = {}
        with tempfile.TemporaryFile() as spool:
            blocks = [_spooled(spool, labels, features, ids, names) for labels, features in batches]
            classes = sorted({*self.model.classes, *names})
            truth_of = np.array([classes.index(c) for c in names], np.int64)
            n = len(classes)
            w, acc, last = np.zeros((len(ids), n)), np.zeros((len(ids), n)), np.zeros((len(ids), n), np.int64)
            for f, own in self.model.weights.items():
                w[ids[f]] = [own.get(c, 0.0) for c in classes]
            step, learned = 0, any(size for size, _ in blocks)
            stopped = lambda: cancel is not None and cancel.is_set()
            for _ in range(epochs if learned else 0):
                spool.seek(0)
                for size, total in blocks:
                    truths, lengths, flat = (np.frombuffer(spool.read(4 * m), np.int32) for m in (size, size, total))
                    if stopped():
                        continue
                    ends = np.cumsum(lengths, dtype=np.int64).tolist()
                    begin = 0
                    for truth, end in zip(truth_of[truths].tolist(), ends):
                        if stopped():
                            break
                        own = flat[begin:end]
                        begin = end
                        guess = int(w.take(own, 0).sum(0).argmax())  # the first of equals
                        if guess != truth:
                            for k, delta in ((truth, 1.0), (guess, -1.0)):
                                acc[own, k] += w[own, k] * (step - last[own, k])
                                last[own, k] = step
                                w[own, k] += delta
                        step += 1
        if not learned:
            self.model = PerceptronModel(classes, self.model.weights)
            return self.model
        mean = (acc + w * (step - last)) / max(step, 1)
        out = {f: {c: m for c, m in zip(classes, mean[k].tolist()) if m != 0.0} for f, k in ids.items()}
        self.model = PerceptronModel(classes, {f: own for f, own in out.items() if own})
        return self.model


def _spooled(spool, labels: pa.Array, features: pa.Array, ids: dict[str, int], names: dict[str, int]) -> tuple[int, int]:
    """Write a batch's instances that have features: numbers of labels, of features each, and of the distinct features in
    the order of their names. How many instances and numbers."""
    lengths = features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = features.flatten().dictionary_encode()
    found = coded.dictionary.to_pylist()
    number = np.array([ids.setdefault(f, len(ids)) for f in found], np.int32)
    order = sorted(range(len(found)), key=found.__getitem__)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    row = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    key = np.unique(row * max(len(found), 1) + rank[coded.indices.to_numpy()]) if len(row) else np.zeros(0, np.int64)
    owner, flat = key // max(len(found), 1), number[np.array(order, np.int64)[key % max(len(found), 1)]] if len(key) else np.zeros(0, np.int32)
    sizes = np.bincount(owner, minlength=len(lengths)).astype(np.int32)
    kept = np.flatnonzero(sizes)
    said = labels.take(pa.array(kept)).dictionary_encode()
    own = np.array([names.setdefault(c, len(names)) for c in said.dictionary.to_pylist()], np.int32)
    truths = own[said.indices.to_numpy()] if len(kept) else np.zeros(0, np.int32)
    for x in (truths, sizes[kept], flat):
        spool.write(x.astype(np.int32).tobytes())
    return len(kept), len(flat)


def add_instance(instances: DataFrame, label: int, features: list[str]) -> DataFrame:
    """Instances with one more, of weight 1; features that are new are appended to the vocabulary by training."""
    row = instances.sparkSession.createDataFrame([(label, features)], "label int, features array<string>")
    return instances.select(F.col("label").cast("int").alias("label"), "features").union(row)


def perceptron_predictions(instances: DataFrame, model: PerceptronModel) -> DataFrame:
    """Adds predicted: the class of the greatest sum over distinct features, the first by name of equals; the empty text
    without classes."""
    shared = instances.sparkSession.sparkContext.broadcast(model)
    names = [c for c in instances.columns if c != "predicted"]
    source = instances.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", predicted string"

    def run(batches):
        for b in batches:
            said = [shared.value.predict(sorted(set(f or ()))) for f in b.column(names.index("features")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*names, "predicted"])

    return source.mapInArrow(run, schema)


def perceptron_metrics(instances: DataFrame, model: PerceptronModel) -> DataFrame:
    """One row of accuracy and macro precision and recall on instances with features."""
    rows = perceptron_predictions(instances.where(F.size("features") > 0).select(F.col("label").cast("string").alias("label"), "features"), model)
    return evaluate.macro_metrics(rows, "label", "predicted", model.classes)


def train_perceptron(instances: DataFrame, epochs: int = 10, order: tuple[str, ...] = (), model: PerceptronModel | None = None, cancel: threading.Event | None = None) -> DataFrame:
    """(feature, class, weight) rows of the averaged perceptron. Learning is sequential by definition: all instances are
    sorted by ``order`` into one task, which streams them to a file of numbers (use train_perceptron_mixed to learn in parallel).

    cancel, if it is set, ends the learning; what was learned until then is averaged and kept."""
    signal = f"{shared_dir(instances.sparkSession)}/cancel-{uuid.uuid4().hex}" if cancel is not None else None
    if cancel is not None:
        _watch(instances.sparkSession, cancel, signal)
    kept = instances.select(*(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.col("label").cast("string").alias("label"), "features").repartition(1)
    rows = (kept.sortWithinPartitions(*(f"_o{k}" for k in range(len(order)))) if order else kept).select("label", "features")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            pairs = ((b.column(0), b.column(1)) for b in itertools.chain([first], batches))
            yield from _weight_table(Perceptron(model).fit_batches(pairs, epochs, _Signal(signal) if signal else None)).to_batches()

    return rows.mapInArrow(fit, "feature string, class string, weight double")


def _watch(spark, cancel: threading.Event, path: str) -> None:
    """Put a file into the shared folder when cancel is set: the task looks for it."""

    def put() -> None:
        cancel.wait()
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p).close()

    threading.Thread(target=put, daemon=True).start()


class _Signal:
    """The task's side of an event: is the file there? It looks every LOOK instances."""

    LOOK = 256

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.asked, self.found = 0, False

    def is_set(self) -> bool:
        if not self.found and self.asked % self.LOOK == 0:
            self.found = self.fs.get_file_info(self.path).is_file
        self.asked += 1
        return self.found


def _weight_table(m: PerceptronModel) -> pa.Table:
    rows = [(f, c, w) for f in sorted(m.weights) for c, w in m.weights[f].items()] + [("", c, 0.0) for c in m.classes]
    return pa.table({"feature": [r[0] for r in rows], "class": [r[1] for r in rows], "weight": pa.array([r[2] for r in rows], pa.float64())}, schema=pa.schema([("feature", pa.string()), ("class", pa.string()), ("weight", pa.float64())]))


def perceptron_of(rows: DataFrame) -> PerceptronModel:
    """The model of (feature, class, weight) rows; rows of the empty feature name classes."""
    weights: dict[str, dict[str, float]] = {}
    classes = set()
    for f, c, w in rows.select("feature", "class", "weight").collect():
        classes.add(c)
        if f:
            weights.setdefault(f, {})[c] = w
    return PerceptronModel(sorted(classes), weights)


def _epoch_from(shared):
    """One epoch over a shard, from the broadcast model on."""

    def fit(t: pa.Table) -> pa.Table:
        return _weight_table(Perceptron(shared.value).fit([(r["label"], r["features"]) for r in t.to_pylist()], 1))

    return fit


def train_perceptron_mixed(instances: DataFrame, shards: int, epochs: int = 10) -> DataFrame:
    """Iterative parameter mixing: each epoch, every shard learns on from the mean of the last epoch's models, in parallel.
    Not equal to the sequential learner."""
    spark = instances.sparkSession
    rows = instances.select(F.col("label").cast("string").alias("label"), "features").withColumn("g", F.pmod(F.xxhash64("label", "features"), F.lit(shards)))
    classes = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]
    model = PerceptronModel(classes)
    for _ in range(epochs):
        each = rows.groupBy("g").applyInArrow(_epoch_from(spark.sparkContext.broadcast(model)), "feature string, class string, weight double")
        model = perceptron_of(each.groupBy("feature", "class").agg((F.sum("weight") / shards).alias("weight")))
    return spark.createDataFrame(_weight_table(model).to_pylist(), "feature string, class string, weight double")


def collapse(weights: DataFrame) -> DataFrame:
    """(feature, class, weight) of classes B and O -> (feature, weight): B less O, without zeros."""
    wide = weights.where("feature <> ''").groupBy("feature").pivot("class", ["B", "O"]).agg(F.sum("weight"))
    return wide.select("feature", (F.coalesce("B", F.lit(0.0)) - F.coalesce("O", F.lit(0.0))).alias("weight")).where("weight <> 0")


def prune(weights: DataFrame, n: int) -> DataFrame:
    """The n weights largest by size; equals by feature."""
    return weights.orderBy(F.abs("weight").desc(), "feature").limit(n)


def merge_weights(old: DataFrame, new: DataFrame) -> DataFrame:
    """Weights by feature, the new ones first."""
    return old.select("feature", F.col("weight").alias("o")).join(new.select("feature", F.col("weight").alias("n")), "feature", "full").select("feature", F.coalesce("n", "o").alias("weight"))


def boundary_labels(instances: DataFrame) -> DataFrame:
    """Labels 1 and -1 as B and O."""
    return instances.withColumn("label", F.when(F.col("label").cast("int") == 1, "B").otherwise("O"))


def train_two_stage(lines: DataFrame, language: str, order: tuple[str, ...], tsv: bool = False, features: str = "fast", epochs: int = 10, dominance: float = DOMINANCE, cancel: threading.Event | None = None) -> TwoStageModel:
    """Both stages and the lexicon from a tagged corpus; order: columns that give the order of the lines."""
    return _two_stage(lines, language, order, tsv, features, epochs, dominance, cancel)[0]


def train_two_stage_measured(lines: DataFrame, language: str, order: tuple[str, ...], tsv: bool = False, features: str = "fast", epochs: int = 10, dominance: float = DOMINANCE, cancel: threading.Event | None = None) -> tuple[TwoStageModel, DataFrame, DataFrame]:
    """The model and a row of metrics of each stage on its instances."""
    model, first, second = _two_stage(lines, language, order, tsv, features, epochs, dominance, cancel)
    gold = gold_tokens(lines, tsv, True)
    return model, perceptron_metrics(extract_stage1(lines, language, tsv, order), first), perceptron_metrics(extract_stage2(gold, language, features, order), second)


def _two_stage(lines, language, order, tsv, features, epochs, dominance, cancel) -> tuple[TwoStageModel, PerceptronModel, PerceptronModel]:
    gold = gold_tokens(lines, tsv, True)
    first = perceptron_of(train_perceptron(extract_stage1(lines, language, tsv, order), epochs, (*order, "pos"), cancel=cancel))
    second = perceptron_of(train_perceptron(extract_stage2(gold, language, features, order), epochs, (*order, "word_no"), cancel=cancel))
    lex = {r["surface"]: [(t["tag"], t["count"]) for t in r["tags"]] for r in lexicon(gold).collect()}
    return TwoStageModel(first.collapsed(), lex, second, dominance), first, second
