"""Helpers that the operators share: input columns, Arrow batches, written intermediate tables."""

from __future__ import annotations

import atexit
import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.scratch import shared_dir

#: A word of the contracts that split at ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table: A-Z to a-z, white space to a blank.
SPACED = bytes(32 if 9 <= i <= 13 else i for i in range(256))
LOWER_SPACED = bytes(i + 32 if 65 <= i <= 90 else 32 if 9 <= i <= 13 else i for i in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def words(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bucket(doc_id: int | None, n: int) -> int:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def crc_bucket(doc_id: Column, n: int) -> Column:
    """The Column form of bucket()."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


#: Rows that are Python objects at a time.
SLICE, BATCH_BYTES = 512, 8 << 20


def _trim() -> None:
    """Give a worker's free memory back to the system: workers idle between tasks, beside others that need it."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to at most SLICE rows and BATCH_BYTES, where it leaves Spark's defaults: long texts
    otherwise make batches of tens of MB, each held by the JVM and by a worker, both ways.

    The queries and the pipeline's stages call this; operators leave the session's settings alone."""
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000, SLICE), ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, BATCH_BYTES)):
        if spark.conf.isModifiable(key) and (now := spark.conf.get(key).rstrip("b")).isdigit() and int(now) >= default:
            spark.conf.set(key, str(value))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _arrays(columns: dict, schema: pa.Schema) -> list[pa.Array]:
    return [pa.array(columns[f.name], type=f.type) for f in schema]


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow with slices of batches as dicts of Python lists; fn sees one task's slices in order."""
    arrow = _arrow(schema)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                yield b.slice(at, SLICE).to_pydict()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(slices(batches)):
            yield pa.RecordBatch.from_arrays(_arrays(out, arrow), schema=arrow)
        _trim()

    return df.mapInArrow(run, schema)


def hash_sample(docs: DataFrame, n: int) -> DataFrame:
    """The n rows of (doc_id, text) of least hash: a sample of the whole table that doesn't depend on files or order."""
    h = F.xxhash64(F.col("doc_id"), F.col("text"))
    last = docs.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return docs.select("doc_id", "text").where(h <= F.lit(last)).orderBy(h).limit(n)  # rows of one hash are alike


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def extended(df: DataFrame, inputs: list[str], fn: Callable[[dict], dict], schema: str = "", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns that fn makes of the input columns (strings come as bytes), without those in drop.

    The other columns stay in Arrow and are never Python objects. If fn returns a list under None, it says which rows stay."""
    kept = [c for c in df.columns if c not in drop]
    new = _arrow(schema) if schema else pa.schema([])
    whole = ", ".join(x for x in (ddl(df.select(*(f"`{c}`" for c in kept))), schema) if x)
    where = {c: i for i, c in enumerate(df.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                values = {}
                for c in inputs:
                    a = part.column(where[c])
                    values[c] = (a.cast(pa.binary()) if pa.types.is_string(a.type) else a.cast(pa.large_binary()) if pa.types.is_large_string(a.type) else a).to_pylist()
                out = fn(values)
                mask = out.pop(None, None)
                made = pa.RecordBatch.from_arrays([*(part.column(where[c]) for c in kept), *_arrays(out, new)], names=[*kept, *new.names])
                yield made if mask is None else made.filter(pa.array(mask, pa.bool_()))
        _trim()

    return df.mapInArrow(run, whole)


#: Rows that are broadcast at most, after they are counted.
BROADCAST_ROWS = 200_000
#: In joins with larger tables: rows of a key from which on it is dealt, and the parts.
HOT, SALT = 1 << 16, 16


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"__{name}_{uuid.uuid4().hex}"


def without(docs: DataFrame, rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """docs without those whose keys (nulls equal) are among rows; keys: column of rows -> expression over docs.

    rows is written and counted: up to BROADCAST_ROWS are broadcast, so that docs need no shuffle; more are joined."""
    names = {k: fresh("out") for k in keys}
    rows = written(rows.select(*(F.col(k).alias(names[k]) for k in keys)).distinct())
    n = rows.count()
    if not n:
        return docs
    same = [expr.eqNullSafe(F.col(names[k])) for k, expr in keys.items()]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return docs.join(F.broadcast(rows) if n <= BROADCAST_ROWS else rows, condition, "left_anti")


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner", limit: int | None = None, hot: int | None = None) -> DataFrame:
    """rows joined with a written table that has one row a key. Up to limit (BROADCAST_ROWS) of them are broadcast. Beyond,
    both are shuffled; rows of a key with more than HOT of them are dealt over SALT parts, to each of which that key's row
    goes, so that a hot key is no task's alone."""
    if found.count() <= (BROADCAST_ROWS if limit is None else limit):
        return rows.join(F.broadcast(found), keys, how)
    salt, parts = fresh("salt"), fresh("parts")
    # At most one key for every HOT rows: small beside the rows.
    heavy = F.broadcast(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(salt)).where(F.col(salt) > (HOT if hot is None else hot)).select(*keys, F.lit(SALT).alias(parts)))
    absent = F.col(keys[0]).isNull()
    for k in keys[1:]:
        absent = absent | F.col(k).isNull()
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(SALT)).cast("int")
    dealt = rows.join(heavy, keys, "left").withColumn(salt, F.when(F.col(parts).isNotNull() | absent, part).otherwise(0)).drop(parts)
    spread = found.join(heavy, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return dealt.join(spread, [*keys, salt], how).drop(salt)


_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors. Removed at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wordloom-{uuid.uuid4().hex}"
    _written.append((spark, path))
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove what written() wrote for df, when nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        for spark, path in list(_written):
            if f"/{path.rsplit('/', 1)[1]}/" in file:
                _remove(spark, path)
                _written.remove((spark, path))


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns as a written table; all tables that were written on the way are removed."""
    before = {p for _, p in _written}
    out = written(make())
    last = _written[-1]
    for spark, path in list(_written):
        if path not in before and (spark, path) != last:
            _remove(spark, path)
            _written.remove((spark, path))
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; its shared folder is the cluster's to clear
            return
