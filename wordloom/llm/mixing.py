"""7. Mixing sources to target weights along a time-varying curriculum.

Each source has a demand in words (its target) and a weight schedule over training time t in [0, 1]. The integral
of the schedule is the source's cumulative demand; inverting it turns a document's place in its source's word
stream into a training position, one for each epoch that takes words of it, and a range sort by position gives the
training order.

Documents are streamed epoch by epoch in the order of a hash of their id and text until the target is met; the
last document is taken in part. Prefix sums are computed in two levels (hash prefix, then inside the prefix), so
no source, however hot, meets in one task. Only DataFrame functions are used.

Defined results: null text has size 0; a null source is a source, last in order; an empty table gives no rows; a
source of size 0 has target 0; identical rows are separate documents of their source. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.common import WORD, table, written

#: Documents of a source that meet in one task, about.
GROUP_ROWS = 1 << 16
#: The weight schedule of source k is 1 + SLOPES[k % 3] * (2t - 1): falling, even, rising.
SLOPES = (-0.5, 0.0, 0.5)


def hash_digits(rows: int, group_rows: int = GROUP_ROWS) -> int:
    """Hex digits of the hash that make groups of at most about group_rows rows."""
    d = 0
    while rows > group_rows * 16**d:
        d += 1
    return d


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size) -> with rank, target, slope.

    Water filling: the level is the largest of (total - caps of the k sources that fill first) / (weight of the
    rest). One row per source, so the ordered windows are over the pre-aggregated source table alone.
    """
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    n = len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % n + 1).cast("int"))
    filled = (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", w)
        .withColumn("fill", cap * F.col("source_size") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    )
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), (F.col("rank") % len(SLOPES) + 1).cast("int"))
    return filled.withColumn("target", F.least((cap * F.col("source_size")).cast("double"), F.max("level").over(every) * F.col("weight"))).select("source", "source_size", "rank", "target", slope.alias("slope"))


def invert_demand(share: Column, slope: Column) -> Column:
    """t at which a source's cumulative demand t + slope * (t*t - t) reaches share."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / (2 * slope))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words in the text and the hash that orders documents of a source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    return docs.select(F.col("doc_id"), F.col("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), h.alias("h"))


def _epochs(docs: DataFrame, weights: tuple[int, ...], cap: int, group_rows: int) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, places: (epoch, taken, position) of each epoch of its
    source's stream that takes words of it."""
    base = written(sized(docs))
    digits = hash_digits(base.count(), group_rows)
    base = base.withColumn("part", F.substring("h", 1, digits) if digits else F.lit(""))
    parts = base.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_start"))
    parts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "source_size", "target", "slope")
    inside = Window.partitionBy("source", "part").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.alias("d").join(parts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.part") == F.col("p.part")))
    start = F.col("part_start") + F.col("inner")
    want = F.round("target").cast("long")
    last = F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")

    def place(epoch: Column) -> Column:
        at = F.col("start") + epoch * F.col("source_size")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), F.col("want") - at)).cast("long")
        position = F.when(taken > 0, F.round(invert_demand(at / F.col("target"), F.col("slope")), 9))
        return F.struct(epoch.alias("epoch"), taken.alias("taken"), position.alias("position"))

    places = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), last), place), lambda p: p["taken"] > 0)
    placed = placed.select("doc_id", "size", "source_size", "target", start.alias("start"), want.alias("want"), "slope")
    return placed.select("doc_id", "size", "source_size", "target", places.alias("places"))


def training_order(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document and epoch that takes words of it: doc_id, epoch, size, source_size, target, taken (in that
    epoch), position, sorted by position."""
    each = _epochs(docs, weights, cap, group_rows).withColumn("place", F.explode("places"))
    return each.select("doc_id", "place.epoch", "size", "source_size", "target", "place.taken", "place.position").orderBy("position", "doc_id", "epoch")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """training_order() folded to one row per document: doc_id, size, source_size, target, taken (in all epochs),
    position (the first; null if nothing is taken), positions (by epoch), sorted by position."""
    folded = _epochs(docs, weights, cap, group_rows)
    taken = F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p["taken"])
    positions = F.col("places")["position"]
    return folded.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.get(positions, F.lit(0)).alias("position"), positions.alias("positions")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() in the columns of the SQL twin, which has the first position only."""
    return mix(table(spark, sf_dir, "documents")).drop("positions")


OP7_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sizes),
weighed AS (SELECT *, rank % 3 + 1 AS weight, CAST(3 * source_size AS DOUBLE) / (rank % 3 + 1) AS fill FROM ranked),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
     / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
targets AS (SELECT *, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * weight) AS target, (rank % 3 - 1) * CAST(0.5 AS DOUBLE) AS slope FROM levels),
placed AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, t.slope, CAST(round(t.target) AS BIGINT) AS want,
         CAST(coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
took AS (
  SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS epochs FROM placed),
final AS (
  SELECT *, CAST(epochs * size + greatest(0, least(size, want - epochs * source_size - start)) AS BIGINT) AS taken FROM took)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(CASE WHEN slope = 0 THEN CAST(start AS DOUBLE) / target
            ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (CAST(start AS DOUBLE) / target)) - (1 - slope)) / (2 * slope) END, 9) END AS position
FROM final
"""
