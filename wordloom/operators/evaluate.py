"""Metrics: words, boundaries and tags against gold; binary and multiclass confusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import f1, is_space, pct, spans


def _spans(words: str):
    plain = F.filter(spans(F.col(words)), lambda s: ~is_space(s["surface"]))
    return F.array_distinct(F.transform(plain, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))


def _bounds(own: str):
    return F.array_distinct(F.filter(F.transform(own, lambda s: s["start"]), lambda x: x != 0))


def span_counts(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Adds sizes of the span and boundary sets of each sentence and of their intersections (white-space words left out)."""
    out = df.where(F.size(gold) > 0).withColumn("_g", _spans(gold)).withColumn("_p", _spans(predicted))
    out = out.withColumn("_gb", _bounds("_g")).withColumn("_pb", _bounds("_p"))
    size = lambda x: F.size(x).cast("long")
    return out.select(
        *df.columns,
        size(F.array_intersect("_g", "_p")).alias("word_tp"),
        size("_p").alias("word_pred"),
        size("_g").alias("word_gold"),
        size(F.array_intersect("_gb", "_pb")).alias("boundary_tp"),
        size("_pb").alias("boundary_pred"),
        size("_gb").alias("boundary_gold"),
    )


def evaluate_segmentation(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row of word and boundary precision, recall and F1 (percent), sentences, gold_words, predicted_words."""
    names = ("word_tp", "word_pred", "word_gold", "boundary_tp", "boundary_pred", "boundary_gold")
    total = span_counts(df, gold, predicted).agg(F.count(F.lit(1)).alias("sentences"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    c = F.col
    out = total.select(
        pct(c("word_tp"), c("word_pred")).alias("word_precision"),
        pct(c("word_tp"), c("word_gold")).alias("word_recall"),
        pct(c("boundary_tp"), c("boundary_pred")).alias("boundary_precision"),
        pct(c("boundary_tp"), c("boundary_gold")).alias("boundary_recall"),
        "sentences",
        c("word_gold").alias("gold_words"),
        c("word_pred").alias("predicted_words"),
    )
    return out.withColumn("word_f1", f1(c("word_precision"), c("word_recall"))).withColumn("boundary_f1", f1(c("boundary_precision"), c("boundary_recall")))


def evaluate_pos(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row of tagged precision, recall and F1 over array(struct(surface, pos)) columns."""
    tagged = lambda col: F.filter(
        F.zip_with(spans(F.transform(col, lambda t: t["surface"])), F.col(col), lambda s, t: F.struct(s["surface"].alias("surface"), s["start"].alias("start"), s["end"].alias("end"), t["pos"].alias("pos"))),
        lambda s: ~is_space(s["surface"]),
    )
    rows = df.where(F.size(gold) > 0).select(tagged(gold).alias("g"), tagged(predicted).alias("p"))
    # The gold tag of a span is that of its first word there (only empty words share a span).
    first = lambda s: F.get(F.filter("g", lambda g: (g["start"] == s["start"]) & (g["end"] == s["end"])), 0)["pos"]
    hits = F.size(F.filter("p", lambda s: F.coalesce(first(s) == s["pos"], F.lit(False))))
    total = rows.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("tp", hits), ("pred", F.size("p")), ("gold", F.size("g")))))
    c = F.col
    out = total.select(pct(c("tp"), c("pred")).alias("tagged_precision"), pct(c("tp"), c("gold")).alias("tagged_recall"))
    return out.withColumn("tagged_f1", f1(c("tagged_precision"), c("tagged_recall")))


def binary_metrics(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Accuracy, precision and recall in percent and the confusion counts; positive values are the positive class."""
    g, p = F.col(gold) > 0, F.col(predicted) > 0
    total = df.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    c = F.col
    return total.select("tp", "fp", "fn", "tn", pct(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn")).alias("accuracy"), pct(c("tp"), c("tp") + c("fp")).alias("precision"), pct(c("tp"), c("tp") + c("fn")).alias("recall"))


def class_metrics(df: DataFrame, gold: str, predicted: str, classes: list[str] | None = None) -> DataFrame:
    """class, predicted, gold, correct of every known class."""
    both = df.select(F.explode(F.array(F.struct(F.col(gold).alias("class"), F.lit(0).alias("p"), F.lit(1).alias("g"), (F.col(gold) == F.col(predicted)).cast("int").alias("ok")), F.struct(F.col(predicted).alias("class"), F.lit(1).alias("p"), F.lit(0).alias("g"), F.lit(0).alias("ok")))).alias("x")).select("x.*")
    if classes:
        both = both.union(df.sparkSession.createDataFrame([(c, 0, 0, 0) for c in classes], both.schema))
    return both.groupBy("class").agg(F.sum("p").alias("predicted"), F.sum("g").alias("gold"), F.sum("ok").alias("correct"))


def macro_metrics(df: DataFrame, gold: str, predicted: str, classes: list[str] | None = None) -> DataFrame:
    """Accuracy and macro precision and recall: classes without predictions or gold add 0 and stay in the divisor."""
    c = class_metrics(df, gold, predicted, classes)
    return c.agg(
        pct(F.sum("correct"), F.sum("gold")).alias("accuracy"),
        F.avg(pct(F.col("correct"), F.col("predicted"))).alias("macro_precision"),
        F.avg(pct(F.col("correct"), F.col("gold"))).alias("macro_recall"),
        F.count(F.lit(1)).alias("classes"),
    )
