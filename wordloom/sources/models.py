"""Model files: boosted stumps, averaged perceptrons, and two-stage models with a lexicon.

Models that segment and tag are small (their size is that of a file one driver reads) and become DataFrames by
``weights_frame``. Lexicons and class weights of whole tables may be larger: ``lexicon_rows``, ``write_perceptron``,
``read_perceptron``, ``write_two_stage`` and ``read_two_stage`` write and read the same lines in parallel; the driver
sees the first stage, the classes and the sections' places.
"""

from __future__ import annotations

import math
import os
import re
import time
import urllib.request
from dataclasses import dataclass, field
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.errors import InvalidArgument, ModelError, ReadError, Unsupported
from wordloom.functions.text import UPOS

#: First line of a two-stage file; any name before it is read.
MAGIC, DOMINANCE = "wordloom-two-stage v1", 0.99
_MAGIC = re.compile(r"[A-Za-z]+-two-stage v1")
MAX_DOWNLOAD, CONNECT_S, TOTAL_S = 256 << 20, 10, 60


def number_text(x: float) -> str:
    """Shortest plain decimal that reads back as x; whole numbers without a point."""
    from decimal import Decimal

    text = format(Decimal(repr(float(x))), "f")
    return text.rstrip("0").rstrip(".") or "0" if "." in text else text


def _finite(text: str, what: str, line: int) -> float:
    try:
        x = float(text)
    except ValueError:
        raise ModelError(f"line {line}: {what} {text!r} isn't a number") from None
    if not math.isfinite(x):
        raise ModelError(f"line {line}: {what} {text!r} isn't finite")
    return x


@dataclass
class StumpModel:
    """Weights of boosted stumps. The bucket of the empty feature holds the bias: bias = -(sum of all weights) / 2, added
    up from left to right in the order of ``weights`` (by name after a fresh load, in order of appearance in training)."""

    weights: dict[str, float] = field(default_factory=lambda: {"": 0.0})

    @property
    def bias(self) -> float:
        total = 0.0
        for w in self.weights.values():
            total += w
        return -total / 2.0

    @classmethod
    def parse(cls, text: str) -> StumpModel:
        """feature<TAB>weight lines and one bias line, which counts the weights above it."""
        found: dict[str, float] = {}
        running, bias_seen = 0.0, False
        lines = file_lines(text)
        if not lines:
            raise ModelError("the model file is empty")
        for n, line in enumerate(lines, 1):
            if not line:
                raise ModelError(f"line {n} is empty")
            name, *rest = line.split("\t")
            if rest:
                if name in found:
                    raise ModelError(f"line {n}: feature {name!r} occurs twice")
                found[name] = _finite(rest[0], "weight", n)
                running += found[name]
            elif bias_seen:
                raise ModelError(f"line {n}: a second bias line")
            else:
                bias_seen = True
                found[""] = -2.0 * _finite(name, "bias", n) - running
        if not bias_seen:
            raise ModelError("no bias line; the file may be cut short")
        return cls({k: found[k] for k in sorted(found, key=lambda s: s.encode())})

    def merge(self, other: StumpModel) -> None:
        """Take over another model's weights by name; unknown names go last."""
        self.weights.update(other.weights)

    def dump(self) -> str:
        """Weights that aren't 0 in storage order, then the bias."""
        own = [(k, w) for k, w in self.weights.items() if k and w != 0.0]
        bias = -self.weights.get("", 0.0)
        for _, w in own:
            bias -= w
        return "".join(f"{k}\t{number_text(w)}\n" for k, w in own) + number_text(bias / 2.0) + "\n"

    def predict(self, features: set[str]) -> int:
        return 1 if self.bias + sum(self.weights.get(f, 0.0) for f in sorted(features)) >= 0 else -1

    def pruned(self, n: int) -> str:
        """Text of the n weights largest by size (ties in file order) and a bias of 0."""
        own = sorted(((k, w) for k, w in self.weights.items() if k), key=lambda x: -abs(x[1]))[:n]
        return "".join(f"{k}\t{number_text(w)}\n" for k, w in own) + "0\n"


@dataclass
class PerceptronModel:
    """Class weights by feature; classes in order."""

    classes: list[str] = field(default_factory=list)
    weights: dict[str, dict[str, float]] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> PerceptronModel:
        lines = file_lines(text)
        if not lines:
            raise ModelError("the model file is empty")
        if not lines[0].isdigit():
            raise ModelError("line 1: the number of classes is missing")
        n = int(lines[0])
        classes = lines[1 : n + 1]
        if len(classes) < n or len(set(classes)) < n or not all(classes):
            raise ModelError("the class names are short, empty or repeated")
        weights: dict[str, dict[str, float]] = {}
        for k, line in enumerate(lines[n + 1 :], n + 2):
            parts = line.split("\t")
            if len(parts) != 3 or parts[1] not in classes:
                raise ModelError(f"line {k}: not feature, class and weight")
            if parts[1] in weights.setdefault(parts[0], {}):
                raise ModelError(f"line {k}: {parts[0]!r} and {parts[1]!r} occur twice")
            weights[parts[0]][parts[1]] = _finite(parts[2], "weight", k)
        return cls(sorted(classes), weights)

    def dump(self) -> str:
        rows = [f"{f}\t{c}\t{number_text(self.weights[f][c])}\n" for f in sorted(self.weights, key=lambda s: s.encode()) for c in self.classes if self.weights[f].get(c, 0.0) != 0.0]
        return f"{len(self.classes)}\n" + "".join(f"{c}\n" for c in self.classes) + "".join(rows)

    def scores(self, features) -> list[float]:
        out = [0.0] * len(self.classes)
        for f in features:
            if own := self.weights.get(f):
                for k, c in enumerate(self.classes):
                    out[k] += own.get(c, 0.0)
        return out

    def predict(self, features) -> str:
        """Best class, the first of equals; the empty string without classes."""
        s = self.scores(features)
        return self.classes[max(range(len(s)), key=lambda k: (s[k], -k))] if s else ""

    def collapsed(self) -> StumpModel:
        """Two classes B and O as one weight each: B less O. The bias is 0."""
        if not {"B", "O"} <= set(self.classes):
            raise ModelError("a boundary model has classes B and O")
        diff = {f: w.get("B", 0.0) - w.get("O", 0.0) for f, w in sorted(self.weights.items(), key=lambda x: x[0].encode())}
        own = {f: w for f, w in diff.items() if w != 0.0}
        return StumpModel({"": -sum(own.values()), **own})


@dataclass
class TwoStageModel:
    stage1: StumpModel
    lexicon: dict[str, list[tuple[str, int]]]
    stage2: PerceptronModel
    dominance: float = DOMINANCE

    def __post_init__(self):
        if not 0.5 < self.dominance <= 1:
            raise ModelError(f"dominance {self.dominance} isn't in (0.5, 1]")
        if bad := [c for c in self.stage2.classes if c not in UPOS]:
            raise ModelError(f"classes {bad} aren't tags")
        for surface, tags in self.lexicon.items():
            if not surface or not tags or len({t for t, _ in tags}) < len(tags) or any(t not in UPOS or n < 1 for t, n in tags):
                raise ModelError(f"lexicon entry {surface!r} isn't valid")
        self.lexicon = {k: sorted(v, key=lambda x: (-x[1], x[0])) for k, v in self.lexicon.items()}

    @classmethod
    def parse(cls, text: str) -> TwoStageModel:
        lines = file_lines(text)
        if not lines or not _MAGIC.fullmatch(lines[0]):
            raise ModelError("not a two-stage model")
        order = ["[params]", "[stage1]", "[lexicon]", "[stage2]"]
        parts: dict[str, list[str]] = {}
        now = None
        for line in lines[1:]:
            if line in order:
                if now is not None and order.index(line) <= order.index(now) or line in parts:
                    raise ModelError(f"section {line} is out of order")
                parts[now := line] = []
            elif now is None:
                raise ModelError("content before the first section")
            else:
                parts[now].append(line)
        if missing := [s for s in order[1:] if s not in parts]:
            raise ModelError(f"sections missing: {missing}")
        body = lambda s: "".join(f"{x}\n" for x in parts[s])
        return cls(StumpModel.parse(body("[stage1]")), parse_lexicon(parts["[lexicon]"]), PerceptronModel.parse(body("[stage2]")), parse_params(parts.get("[params]", [])))

    def dump(self) -> str:
        return f"{MAGIC}\n[params]\ndominance\t{number_text(self.dominance)}\n[stage1]\n{self.stage1.dump()}[lexicon]\n{lexicon_text(self.lexicon)}[stage2]\n{self.stage2.dump()}"

    def fixed(self, surface: str) -> str | None:
        """The tag of a word that needs no classifier: its only one, or one that dominates."""
        tags = self.lexicon.get(surface)
        if not tags:
            return None
        return tags[0][0] if len(tags) == 1 or tags[0][1] / sum(n for _, n in tags) >= self.dominance else None


def file_lines(text: str) -> list[str]:
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def parse_params(lines: list[str]) -> float:
    found = None
    for line in lines:
        name, tab, value = line.partition("\t")
        if name != "dominance" or not tab or found is not None:
            raise ModelError(f"parameter line {line!r} isn't valid")
        found = _finite(value, "dominance", 0)
    return DOMINANCE if found is None else found


def parse_lexicon(lines: list[str]) -> dict[str, list[tuple[str, int]]]:
    out: dict[str, list[tuple[str, int]]] = {}
    for n, line in enumerate(lines, 1):
        surface, tab, rest = line.partition("\t")
        if not tab or not surface or surface in out:
            raise ModelError(f"lexicon line {n}: no tab, an empty surface or a second entry")
        tags = []
        for part in rest.split(","):
            tag, colon, count = part.rpartition(":")
            if not colon or tag not in UPOS or not count.isdigit() or int(count) < 1:
                raise ModelError(f"lexicon line {n}: {part!r} isn't tag and count")
            tags.append((tag, int(count)))
        if len({t for t, _ in tags}) < len(tags):
            raise ModelError(f"lexicon line {n}: a tag occurs twice")
        out[surface] = tags
    return out


def lexicon_text(lexicon: dict[str, list[tuple[str, int]]]) -> str:
    return "".join(f"{s}\t{','.join(f'{t}:{n}' for t, n in lexicon[s])}\n" for s in sorted(lexicon, key=lambda s: s.encode()))


def kind_of(text: str) -> str:
    """stumps, perceptron or two-stage, by the first line."""
    first = text.split("\n", 1)[0].rstrip("\r")
    return "two-stage" if _MAGIC.fullmatch(first) else "perceptron" if first.lstrip("+").isdigit() else "stumps"


def parse_model(text: str) -> StumpModel | PerceptronModel | TwoStageModel:
    return {"two-stage": TwoStageModel, "perceptron": PerceptronModel, "stumps": StumpModel}[kind_of(text)].parse(text)


def _download(uri: str) -> bytes:
    """At most MAX_DOWNLOAD bytes within TOTAL_S seconds, as many as the server says."""
    until = time.monotonic() + TOTAL_S
    with urllib.request.urlopen(uri, timeout=CONNECT_S) as r:  # noqa: S310
        said, parts, size = r.headers.get("Content-Length"), [], 0
        if said and int(said) > MAX_DOWNLOAD:
            raise ReadError("the download is too large")
        while part := r.read1(1 << 16):
            parts.append(part)
            size += len(part)
            if size > MAX_DOWNLOAD:
                raise ReadError("the download is too large")
            if time.monotonic() > until:
                raise ReadError(f"the download took more than {TOTAL_S} s")
    if said and int(said) != size:
        raise ReadError("the download is cut short")
    return b"".join(parts)


def read_bytes(uri: str, spark: SparkSession | None = None, allow_http: bool = False) -> bytes:
    """A plain path, file://, any file system of Spark's, or (if allowed) http(s)://."""
    scheme = urlparse(uri).scheme
    if scheme in ("http", "https"):
        if not allow_http:
            raise Unsupported("reading models over http isn't allowed here")
        return _download(uri)
    if scheme in ("", "file"):
        with open(urlparse(uri).path if scheme else uri, "rb") as f:
            return f.read()
    if spark is None:
        raise InvalidArgument(f"a session is needed to read {scheme}://")
    return bytes(spark.read.format("binaryFile").load(uri).select("content").first()[0])


def stamp(uri: str) -> object:
    """What changes when a local file does; None for other places."""
    path = urlparse(uri).path if urlparse(uri).scheme == "file" else uri
    if urlparse(uri).scheme not in ("", "file") or not os.path.exists(path):
        return None
    found = os.stat(path)
    return found.st_mtime_ns, found.st_size, found.st_ino


def load_model(uri: str, spark: SparkSession | None = None, allow_http: bool = False):
    return parse_model(read_bytes(uri, spark, allow_http).decode())


def weights_frame(spark: SparkSession, model: StumpModel) -> DataFrame:
    """(feature, weight), without the bucket."""
    return spark.createDataFrame([(k, float(w)) for k, w in model.weights.items() if k], "feature string, weight double")


def class_weights_frame(spark: SparkSession, model: PerceptronModel) -> DataFrame:
    return spark.createDataFrame([(f, c, float(w)) for f, own in model.weights.items() for c, w in own.items()], "feature string, class string, weight double")


def lexicon_frame(spark: SparkSession, lexicon: dict[str, list[tuple[str, int]]]) -> DataFrame:
    return spark.createDataFrame(list(lexicon.items()), "surface string, tags array<struct<tag:string,count:int>>")


# models beyond the driver -------------------------------------------------------------------------------------------


def _once(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows; an error where a key occurs twice."""
    others = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in others))
    return found.where(F.when(F.col("_n") > 1, F.raise_error(F.concat_ws(" ", F.lit(f"{what} occurs twice:"), *keys)).cast("boolean")).otherwise(True)).select(*rows.columns)


def lexicon_rows(lines: DataFrame) -> DataFrame:
    """(surface, tags) of a lexicon's lines (column line), checked like parse_lexicon; surfaces across all lines."""

    def run(batches):
        for b in batches:
            found = parse_lexicon(b.column(0).to_pylist())
            kind = pa.list_(pa.struct([("tag", pa.string()), ("count", pa.int32())]))
            tags = pa.array([[{"tag": t, "count": n} for t, n in own] for own in found.values()], kind)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), tags], names=["surface", "tags"])

    return _once(lines.select("line").mapInArrow(run, "surface string, tags array<struct<tag:string,count:int>>"), ["surface"], "a surface of the lexicon")


def class_weight_lines(weights: DataFrame) -> DataFrame:
    """feature, class, line of (feature, class, weight) rows that aren't 0."""

    def run(batches):
        for b in batches:
            f, c, w = (x.to_pylist() for x in b.columns)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([f"{x}\t{y}\t{number_text(z)}" for x, y, z in zip(f, c, w)], pa.string())], names=["feature", "class", "line"])

    return weights.where("weight <> 0").select("feature", "class", "weight").mapInArrow(run, "feature string, class string, line string")


def class_weight_rows(lines: DataFrame, classes: list[str]) -> DataFrame:
    """(feature, class, weight) of the lines (column line) after the classes, checked like PerceptronModel.parse."""
    head = f"{len(classes)}\n" + "".join(f"{c}\n" for c in classes)

    def run(batches):
        for b in batches:
            own = PerceptronModel.parse(head + "".join(f"{x}\n" for x in b.column(0).to_pylist())).weights
            rows = [(f, c, w) for f, of in own.items() for c, w in of.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["feature", "class", "weight"])

    return _once(lines.select("line").mapInArrow(run, "feature string, class string, weight double"), ["feature", "class"], "a feature and class")


def _written(parts: DataFrame, path: str) -> None:
    """Write (section, a, b, line) rows as text in the order of the first three."""
    parts.orderBy("section", "a", "b").select("line").write.option("lineSep", "\n").text(path)


def _head(spark: SparkSession, section: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(section, "", f"{i:09d}", x) for i, x in enumerate(lines)], "section int, a string, b string, line string")


def _weight_part(section: int, weights: DataFrame) -> DataFrame:
    return class_weight_lines(weights).select(F.lit(section).alias("section"), F.col("feature").alias("a"), F.col("class").alias("b"), "line")


def write_perceptron(weights: DataFrame, classes: list[str], path: str) -> None:
    """A perceptron's file, of (feature, class, weight) rows."""
    _written(_head(weights.sparkSession, 0, [str(len(classes)), *classes]).union(_weight_part(1, weights)), path)


def _classes(lines: DataFrame, start: int = 0) -> list[str]:
    """The classes of perceptron lines (id, line) that begin at the id start."""
    first = lines.where(F.col("id") == start).select("line").first()
    if first is None or not first[0].isdigit():
        raise ModelError("line 1: the number of classes is missing")
    names = [r[1] for r in sorted(lines.where(F.col("id").between(start + 1, start + int(first[0]))).select("id", "line").collect())]
    return PerceptronModel.parse("".join(f"{x}\n" for x in (first[0], *names))).classes


def read_perceptron(lines: DataFrame) -> tuple[list[str], DataFrame]:
    """Classes and (feature, class, weight) rows of a perceptron's numbered lines (read_corpus)."""
    classes = _classes(lines)
    return classes, class_weight_rows(lines.where(F.col("id") > len(classes)), classes)


_SECTIONS = ["[params]", "[stage1]", "[lexicon]", "[stage2]"]


def write_two_stage(stage1: StumpModel, lexicon: DataFrame, stage2: DataFrame, classes: list[str], dominance: float, path: str) -> None:
    """A two-stage file of a first stage, (surface, tags) rows and (feature, class, weight) rows; checked like a model."""
    spark = lexicon.sparkSession
    TwoStageModel(StumpModel(), {}, PerceptronModel(classes), dominance)
    entry = F.concat_ws("\t", "surface", F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["tag"], t["count"].cast("string"))), ","))
    body = lexicon.select(F.lit(2).alias("section"), F.col("surface").alias("a"), F.lit("").alias("b"), entry.alias("line"))
    head = [MAGIC, "[params]", f"dominance\t{number_text(dominance)}", "[stage1]", *file_lines(stage1.dump()), "[lexicon]"]
    _written(_head(spark, 1, head).union(body).union(_head(spark, 3, ["[stage2]", str(len(classes)), *classes])).union(_weight_part(4, stage2)), path)


def read_two_stage(lines: DataFrame) -> tuple[StumpModel, DataFrame, list[str], DataFrame, float]:
    """First stage, lexicon rows, classes, class weight rows and dominance of a two-stage file's numbered lines
    (read_corpus), checked like TwoStageModel.parse."""
    first = lines.where("id = 0").select("line").first()
    if first is None or not _MAGIC.fullmatch(first[0]):
        raise ModelError("not a two-stage model")
    at = {}
    for i, line in sorted(tuple(r) for r in lines.where(F.col("line").isin(_SECTIONS)).select("id", "line").limit(len(_SECTIONS) + 1).collect()):
        if line in at or at and _SECTIONS.index(line) <= max(map(_SECTIONS.index, at)):
            raise ModelError(f"section {line} is out of order")
        at[line] = i
    if missing := [s for s in _SECTIONS[1:] if s not in at]:
        raise ModelError(f"sections missing: {missing}")
    if min(at.values()) != 1:
        raise ModelError("content before the first section")
    between = lambda a, b: lines.where((F.col("id") > a) & (F.col("id") < b))
    listed = lambda rows: [r[1] for r in sorted(tuple(x) for x in rows.select("id", "line").collect())]
    dominance = parse_params(listed(between(at["[params]"], at["[stage1]"]))) if "[params]" in at else DOMINANCE
    stage1 = StumpModel.parse("".join(f"{x}\n" for x in listed(between(at["[stage1]"], at["[lexicon]"]))))
    rest = lines.where(F.col("id") > at["[stage2]"])
    classes = _classes(rest, at["[stage2]"] + 1)
    TwoStageModel(StumpModel(), {}, PerceptronModel(classes), dominance)
    weights = class_weight_rows(rest.where(F.col("id") > at["[stage2]"] + 1 + len(classes)), classes)
    return stage1, lexicon_rows(between(at["[lexicon]"], at["[stage2]"])), classes, weights, dominance
