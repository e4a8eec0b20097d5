"""The API by name: segmenters from model files, extraction, trainers and evaluation over DataFrames."""

from __future__ import annotations

import threading
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom import __version__
from wordloom.errors import KINDS, AlreadyTrained, InvalidArgument, ModelError, ParseError, PosUnavailable, ReadError, Unsupported, WordloomError, kind_of_error
from wordloom.functions.chartypes import ALIASES, LANGUAGES, char_type_of, parse_language
from wordloom.functions.text import tagged_token, tokens
from wordloom.operators import evaluate, features, segment, tagger, train
from wordloom.sources import models


def version() -> str:
    return __version__


def supported_languages() -> list[str]:
    return list(LANGUAGES)


@lru_cache(maxsize=8)
def _cached(uri: str, allow_http: bool, stamp: object):
    return models.load_model(uri, SparkSession.getActiveSession(), allow_http)


def clear_model_cache() -> None:
    _cached.cache_clear()


class Segmenter:
    """Words, and tags if the model is a two-stage one."""

    def __init__(self, model, language: str = "japanese"):
        if isinstance(model, models.PerceptronModel):
            raise models.ModelError("a perceptron model tags words; it doesn't segment")
        self.language = parse_language(language)
        self.two_stage = model if isinstance(model, models.TwoStageModel) else None
        self.segmenter = segment.Segmenter(model.stage1 if self.two_stage else model, self.language)

    @classmethod
    def open(cls, uri: str, language: str, allow_http: bool = False) -> Segmenter:
        """A model file; it is kept in memory until it changes or the cache is cleared."""
        return cls(_cached(uri, allow_http, models.stamp(uri)), language)

    @classmethod
    def from_bytes(cls, data: bytes, language: str) -> Segmenter:
        return cls(models.parse_model(data.decode()), language)

    @property
    def has_pos(self) -> bool:
        return self.two_stage is not None

    def segment(self, lines: DataFrame, column: str = "line") -> DataFrame:
        """Adds words."""
        return self.segmenter.segment(lines, column)

    def segment_tokens(self, lines: DataFrame, column: str = "line") -> DataFrame:
        """Adds tokens, array(struct(surface, start, end, pos)): offsets in bytes; pos is null."""
        from wordloom.functions.text import byte_spans

        rows = self.segment(lines, column)
        with_null = F.transform(byte_spans(F.col("words")), lambda s: F.struct(s["surface"], s["start"], s["end"], F.lit(None).cast("string").alias("pos")))
        return rows.withColumn("tokens", with_null).drop("words")

    def segment_with_pos(self, lines: DataFrame, column: str = "line") -> DataFrame:
        """Adds tokens, array(struct(surface, pos))."""
        if not self.two_stage:
            raise PosUnavailable("the model has no tag stage")
        return tagger.segment_with_pos(lines, self.two_stage, self.language, column)

    def segment_batch(self, lines: list[str]) -> list[list[str]]:
        """Words of each line, here and now, in order."""
        return self.segmenter.segment_batch(lines)

    def segment_with_pos_batch(self, lines: list[str]) -> list[list[tuple[str, str]]]:
        """Words and tags of each line, here and now, in order."""
        if not self.two_stage:
            if any(lines):
                raise PosUnavailable("the model has no tag stage")
            return [[] for _ in lines]
        own, out = tagger.CompiledTagger(self.two_stage, self.language), []
        for block in own.stage1.blocks(lines):
            words = block.words()
            pairs = list(zip(words.to_pylist(), (own.names[i] for i in own.tags(block, words))))
            at = block.edges().tolist()
            out += [pairs[a:b] for a, b in zip(at, at[1:])]
        return out

    def evaluate(self, gold_lines: DataFrame, tsv: bool = False, pos: bool = False, column: str = "line") -> DataFrame:
        """One row of metrics against gold corpus lines, which aren't trimmed."""
        each = F.transform(tokens(F.col(column), tsv), tagged_token) if pos else tokens(F.col(column), tsv)
        gold = gold_lines.select(each.alias("gold")).where(F.size("gold") > 0)
        surfaces = F.transform("gold", lambda t: t["surface"]) if pos else F.col("gold")
        text = gold.select("gold", F.array_join(surfaces, "").alias("line"))
        if not pos:
            return evaluate.evaluate_segmentation(self.segment(text).withColumnRenamed("words", "predicted"))
        both = self.segment_with_pos(text).withColumnRenamed("tokens", "predicted")
        plain = both.select(F.transform("gold", lambda t: t["surface"]).alias("gold"), F.transform("predicted", lambda t: t["surface"]).alias("predicted"))
        return evaluate.evaluate_segmentation(plain).crossJoin(evaluate.evaluate_pos(both))  # one row each


class Extractor:
    """Feature instances from corpora."""

    def __init__(self, language: str):
        self.language = parse_language(language)

    def extract(self, lines: DataFrame, tsv: bool = False, tag_free: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
        return features.extract(lines, self.language, tsv, tag_free, keys)

    def extract_two_stage(self, lines: DataFrame, tsv: bool = False, feature_set: str = "fast", keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Stage-1 instances, stage-2 instances and the lexicon."""
        gold = features.gold_tokens(lines, tsv, True)
        return features.extract_stage1(lines, self.language, tsv, keys), features.extract_stage2(gold, self.language, feature_set, keys), features.lexicon(gold)


class _Once:
    """A trainer trains once."""

    def __init__(self):
        self.cancel = threading.Event()
        self._done = False

    def _start(self) -> None:
        if self._done:
            raise AlreadyTrained("this trainer has trained already")
        self._done = True


class Trainer(_Once):
    """Boosted stumps; load_model() goes on from an earlier model."""

    def __init__(self, instances: DataFrame, threshold: float = 0.01, iterations: int = 100):
        super().__init__()
        self.instances, self.threshold, self.iterations, self.model = instances, threshold, iterations, None

    def load_model(self, uri: str) -> None:
        self.model = models.load_model(uri, self.instances.sparkSession)

    def train(self) -> tuple[models.StumpModel, DataFrame]:
        """The model and one row of metrics on the instances."""
        self._start()
        self.model = train.train_stumps(self.instances, self.threshold, self.iterations, self.model, self.cancel)
        return self.model, evaluate.binary_metrics(train.stump_predictions(self.instances, self.model), "label", "predicted")


class PerceptronTrainer(_Once):
    """Averaged perceptron over instances in the order of the given columns."""

    def __init__(self, instances: DataFrame, epochs: int = 10, order: tuple[str, ...] = ()):
        super().__init__()
        self.instances, self.epochs, self.order, self.model = instances, epochs, order, None

    def load_model(self, uri: str) -> None:
        self.model = models.load_model(uri, self.instances.sparkSession)

    def train(self) -> tuple[models.PerceptronModel, DataFrame]:
        """The model and one row of metrics on the instances."""
        self._start()
        self.model = train.perceptron_of(train.train_perceptron(self.instances, self.epochs, self.order, self.model, self.cancel))
        return self.model, train.perceptron_metrics(self.instances, self.model)


class TwoStageTrainer(_Once):
    def __init__(self, lines: DataFrame, language: str, order: tuple[str, ...], tsv: bool = False, feature_set: str = "fast", epochs: int = 10, dominance: float = models.DOMINANCE):
        super().__init__()
        self.args = (lines, parse_language(language), order, tsv, feature_set, epochs, dominance)

    def train(self) -> tuple[models.TwoStageModel, DataFrame, DataFrame]:
        """The model and a row of metrics of each stage."""
        self._start()
        return train.train_two_stage_measured(*self.args, self.cancel)


def register(spark: SparkSession, segmenter: Segmenter, prefix: str = "") -> None:
    """SQL functions: segment(text), words; char_type(ch), the code of a character; tokens(text), a table function of
    (word_no, surface)."""
    import pandas as pd
    from pyspark.sql.types import ArrayType, StringType

    compiled, language = segmenter.segmenter.compiled, segmenter.language

    def words(text: pd.Series) -> pd.Series:
        found = compiled.words([t or "" for t in text])
        return pd.Series([None if t is None else w for t, w in zip(text, found)], index=text.index)

    def kinds(ch: pd.Series) -> pd.Series:
        return ch.map({c: char_type_of(c[0], language) for c in ch.dropna().unique() if c})

    for f, name in ((words, "text"), (kinds, "ch")):
        f.__annotations__ = {name: pd.Series, "return": pd.Series}  # what pandas_udf reads

    class Tokens:
        def eval(self, text: str):
            for i, w in enumerate(compiled.words([text or ""])[0]):
                yield i, w

    spark.udf.register(f"{prefix}segment", F.pandas_udf(words, ArrayType(StringType())))
    spark.udf.register(f"{prefix}char_type", F.pandas_udf(kinds, StringType()))
    spark.udtf.register(f"{prefix}tokens", F.udtf(Tokens, returnType="word_no int, surface string"))


__all__ = [
    "ALIASES",
    "AlreadyTrained",
    "Extractor",
    "InvalidArgument",
    "KINDS",
    "ModelError",
    "ParseError",
    "PerceptronTrainer",
    "PosUnavailable",
    "ReadError",
    "Segmenter",
    "Trainer",
    "TwoStageTrainer",
    "Unsupported",
    "WordloomError",
    "clear_model_cache",
    "kind_of_error",
    "register",
    "supported_languages",
    "version",
]
