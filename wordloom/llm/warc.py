"""8. WARC records and a Merkle fixity audit.

A page becomes a WARC/1.0 resource record (its HTML as it was kept; no HTTP head is made up), dated DATE where nothing says
when it was fetched. Records lie in segments (one archive file each) in the order of their
digests; a segment's records, with their offset ranges, are the leaves of a tree whose inner nodes hash the digests
of FANOUT children in order, and whose root stands for the whole segment. A leaf's place in the tree follows from its
digest, not from its place in the file, so that archive and replica stay aligned where records are lost or inserted.
To audit a replica, roots are compared first and only the children of nodes that differ are compared on the next
level, down to single records and their offset ranges.

A segment is a prefix of the digest, so records spread evenly, whatever the pages; segments grow in number, not in
size, an inner node never holds more than FANOUT children, and a level-0 node holds one record on average.

Defined results: null url or html is written as empty, a null page_id as an empty id; line ends in an address are written
as %0D and %0A; identical pages are separate
records; an empty table has no segments and no damage; a record that a replica lacks is damaged. Other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.common import discard, map_batches, table, written
from wordloom.llm.mixing import hash_digits

FANOUT, SEGMENT_RECORDS, DATE = 16, 4096, "1970-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a resource record, as a string."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    address = F.replace(F.replace(text(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = (f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:", text(page_id), ">\r\nWARC-Target-URI: ", address, "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(text(html)).cast("string"), "\r\n\r\n", text(html), "\r\n\r\n")
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in head))


def records(pages: DataFrame) -> DataFrame:
    """page_id, record."""
    return pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def manifest(recs: DataFrame, segment_records: int = SEGMENT_RECORDS) -> DataFrame:
    """page_id, segment, seq, offset, length, digest: where each record lies. Written, since all else builds on it."""
    digests = written(recs.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("digest")))
    digits = hash_digits(digests.count(), segment_records)
    order = Window.partitionBy("segment").orderBy("digest", "page_id")
    placed = digests.withColumn("segment", F.substring("digest", 1, digits) if digits else F.lit(""))
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written(placed.select("page_id", "segment", (F.row_number().over(order) - 1).cast("long").alias("seq"), offset.cast("long").alias("offset"), "length", "digest"))


def depth_of(leaves: DataFrame, fanout: int = FANOUT) -> int:
    """Levels that bring the longest segment to one root."""
    n, depth = leaves.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1, 0
    while n > fanout**depth:
        depth += 1
    return depth


def keyed(leaves: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """(segment, seq, offset, length, digest) -> with copy (number among equal records of the segment), start, end and
    slot, the level-0 node: drawn from the digest and the copy, so that a record has the same slot wherever it lies."""
    copy = (F.row_number().over(Window.partitionBy("segment", "digest").orderBy("offset", "seq")) - 1).cast("long")
    key = F.when(F.col("copy") == 0, F.col("digest")).otherwise(F.sha2(F.concat_ws(":", "digest", "copy").cast("binary"), 256))
    slot = F.shiftright(F.conv(F.substring(key, 9, 8), 16, 10).cast("long") * F.lit(fanout**depth), 32)
    return leaves.withColumn("copy", copy).withColumn("slot", slot).withColumn("start", F.col("offset")).withColumn("end", F.col("offset") + F.col("length"))


def _hashed(*fields: str) -> Column:
    """One hash of a group's rows in the order of the fields."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(*fields))), lambda c: F.concat_ws(":", *(c[f] for f in fields)))
    return F.sha2(F.array_join(rows, ",").cast("binary"), 256).alias("digest")


def tree(leaves: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """keyed() leaves -> nodes (segment, level, idx, start, end, digest), levels 0 to depth. A level-0 node hashes the
    digests and offset ranges of its records, the others those of their children."""
    level = leaves.groupBy("segment", F.col("slot").alias("idx")).agg(F.min("start").alias("s"), F.max("end").alias("e"), _hashed("digest", "start", "end"))
    level = level.select("segment", F.lit(0).alias("level"), "idx", F.col("s").alias("start"), F.col("e").alias("end"), "digest")
    nodes = level
    for k in range(1, depth + 1):
        level = level.groupBy("segment", F.floor(F.col("idx") / fanout).cast("long").alias("parent")).agg(F.min("start").alias("s"), F.max("end").alias("e"), _hashed("idx", "digest", "start", "end"))
        level = level.select("segment", F.lit(k).alias("level"), F.col("parent").alias("idx"), F.col("s").alias("start"), F.col("e").alias("end"), "digest")
        nodes = nodes.unionByName(level)
    return nodes


def differing(a: DataFrame, b: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """Level-0 nodes (segment, slot) in which two trees differ, found from the roots down."""
    suspects = None
    for k in range(depth, -1, -1):
        x, y = a.where(F.col("level") == k), b.where(F.col("level") == k)
        if suspects is not None:
            below = lambda t: t.withColumn("parent", F.floor(F.col("idx") / fanout).cast("long")).join(suspects, ["segment", "parent"], "left_semi")  # noqa: B023, E731
            x, y = below(x), below(y)
        both = x.select("segment", "idx", F.col("digest").alias("one")).join(y.select("segment", "idx", F.col("digest").alias("two")), ["segment", "idx"], "full")
        suspects = both.where(~F.col("one").eqNullSafe(F.col("two"))).select("segment", F.col("idx").alias("parent"))
    return suspects.withColumnRenamed("parent", "slot")


def _out_of_order(matched: DataFrame) -> DataFrame:
    """(segment, digest, copy, start, start2) -> keys of the records off a longest run that keeps its order in both.
    Only segments with an inversion are looked at, each in one task."""
    so_far = F.max("start2").over(Window.partitionBy("segment").orderBy("start", "digest", "copy").rowsBetween(Window.unboundedPreceding, -1))
    mixed = matched.withColumn("so_far", so_far).where("start2 < so_far").select("segment").distinct()

    def run(rows):
        from bisect import bisect_left

        import numpy as np
        import pyarrow as pa

        rows = rows.sort_by([("start", "ascending"), ("digest", "ascending"), ("copy", "ascending")])
        ends, last, before = [], [], []
        for i, x in enumerate(rows["start2"].to_pylist()):
            k = bisect_left(ends, x)
            before.append(last[k - 1] if k else -1)
            ends[k : k + 1], last[k : k + 1] = [x], [i]
        off, i = np.ones(len(before), bool), last[-1]
        while i >= 0:
            off[i], i = False, before[i]
        return rows.select(["segment", "digest", "copy"]).filter(pa.array(off))

    return matched.join(mixed, "segment", "left_semi").groupBy("segment").applyInArrow(run, "segment string, digest string, copy long")


def compare(own: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """page_id, segment, seq, offset, length, digest, state of every leaf of the manifest, and of those that only the
    replica (segment, seq, offset, length, digest) has, with its places and no page_id.

    Leaves are aligned by their digests. state: intact; lost (not in the replica's segment); inserted (in the replica
    alone; changed bytes are a lost and an inserted record); moved (the right bytes with another length, or at an offset
    that lost, inserted and reordered records before it don't account for)."""
    depth = depth_of(own, fanout)
    a, b = written(keyed(own, depth, fanout)), written(keyed(replica, depth, fanout))
    bad = written(differing(written(tree(a, depth, fanout)), written(tree(b, depth, fanout)), depth, fanout))
    x = a.join(bad, ["segment", "slot"], "left_semi").select("segment", "digest", "copy", "seq", "start", "length")
    y = b.join(bad, ["segment", "slot"], "left_semi").select("segment", "digest", "copy", *(F.col(c).alias(f"{c}2") for c in ("seq", "start", "length")))
    both = written(x.join(y, ["segment", "digest", "copy"], "full"))
    moved = written(_out_of_order(both.where("start is not null and start2 is not null").select("segment", "digest", "copy", "start", "start2")))
    both = both.join(moved.withColumn("off", F.lit(True)), ["segment", "digest", "copy"], "left").withColumn("off", F.coalesce("off", F.lit(False)))

    def shift(gone: Column, come: Column) -> Column:
        before = lambda c: Window.partitionBy("segment").orderBy(c, "digest", "copy").rowsBetween(Window.unboundedPreceding, -1)
        part = lambda when, n, at: F.coalesce(F.sum(F.when(when, F.col(n))).over(before(at)), F.lit(0))
        return part(come, "length2", "start2") - part(gone, "length", "start")

    lost, inserted = F.col("start2").isNull(), F.col("start").isNull()
    both = both.withColumn("shift", shift(lost, inserted)).withColumn("shift_off", shift(lost | F.col("off"), inserted | F.col("off")))
    by = F.col("start2") - F.col("start")
    fits = (F.col("length") == F.col("length2")) & ((by == 0) | (~F.col("off") & ((by == F.col("shift")) | (by == F.col("shift_off")))))
    state = F.when(inserted, "inserted").when(lost, "lost").when(fits, "intact").otherwise("moved")
    both = written(both.select("segment", "seq", "digest", F.col("seq2"), F.col("start2"), F.col("length2"), state.alias("state")))
    found = own.join(both.where("seq is not null").select("segment", "seq", "state"), ["segment", "seq"], "left")
    found = found.select("page_id", "segment", "seq", "offset", "length", "digest", F.coalesce("state", F.lit("intact")).alias("state"))
    null = F.lit(None).cast(own.schema["page_id"].dataType)
    return found.unionByName(both.where("state = 'inserted'").select(null.alias("page_id"), "segment", F.col("seq2").alias("seq"), F.col("start2").alias("offset"), F.col("length2").alias("length"), "digest", "state"))


def audit(own: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest's rows with intact: whether compare() finds the record whole and in its place in the replica."""
    found = compare(own, replica, fanout).where("state <> 'inserted'")
    return found.select("page_id", "segment", "seq", "offset", "length", "digest", (F.col("state") == "intact").alias("intact"))


def write_warc(recs: DataFrame, man: DataFrame, path: str) -> int:
    """One file a segment under path, a folder all executors share on any file system that Arrow knows (a plain path, file:,
    hdfs:, s3: ...): records in the manifest's order. Files are moved into place, so a repeated task does no harm. A record
    is found by its digest. Returns the bytes written."""
    keyed = recs.withColumn("digest", F.sha2(F.col("record").cast("binary"), 256)).groupBy("digest").agg(F.first("record").alias("record"))
    rows = man.select("segment", "seq", "digest").join(keyed, "digest").repartition("segment").sortWithinPartitions("segment", "seq").select("segment", F.col("record").cast("binary").alias("record"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
        out, name, size, part = None, None, 0, ""

        def close() -> None:
            if out:
                out.close()
                files.move(part, f"{root}/segment-{name or 'all'}.warc")

        files.create_dir(root, recursive=True)
        for b in batches:
            for segment, data in zip(b["segment"], b["record"]):
                if out is None or segment != name:
                    close()
                    name, part = segment, f"{root}/.{uuid.uuid4().hex}"
                    out = files.open_output_stream(part)
                out.write(data)
                size += len(data)
        close()
        yield {"bytes": [size]}

    return map_batches(rows, run, "bytes long").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


_HEAD = re.compile(rb"WARC/1\.\d\r\n(.*?)\r\n\r\n", re.S)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """segment, seq, offset, length, record_id, url, payload, digest of every record of the files under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path).select("path", "content")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        import hashlib

        for b in batches:
            for file, data in zip(b["path"], b["content"]):
                segment, at, seq = re.search(r"segment-([^/]*)\.warc$", file)[1], 0, 0
                rows: dict[str, list] = {k: [] for k in ("segment", "seq", "offset", "length", "record_id", "url", "payload", "digest")}
                while m := _HEAD.match(data, at):
                    head = dict(line.split(b": ", 1) for line in m[1].split(b"\r\n"))
                    end = m.end() + int(head[b"Content-Length"]) + 4
                    for k, v in zip(rows, ("" if segment == "all" else segment, seq, at, end - at, head[b"WARC-Record-ID"].decode(), head[b"WARC-Target-URI"].decode(), data[m.end() : end - 4], hashlib.sha256(data[at:end]).hexdigest())):
                        rows[k].append(v)
                    at, seq = end, seq + 1
                yield rows

    return map_batches(files, run, "segment string, seq long, offset long, length long, record_id string, url string, payload binary, digest string")


def damaged_copy(recs: DataFrame, man: DataFrame) -> DataFrame:
    """Leaves of a replica with known damage, for the drill: the bytes of all records are written anew with the damage,
    read again, and hashed and placed from what was read; the manifest gives only the segments' prefix length.

    By the first three digits of a record's digest: 000-007 have their first byte changed, 008-00f are a byte longer,
    010-017 are lost, 018-01f lie in another segment; before those with 020-023 a record is inserted that the archive
    lacks. All others are whole, but lie elsewhere where damage before them moves them."""
    digits = man.agg(F.coalesce(F.max(F.length("segment")), F.lit(0))).first()[0]
    d, text = F.col("digest"), F.col("record")
    segment = F.substring(d, 1, digits) if digits else F.lit("")
    beside = F.concat(F.substring(d, 1, digits - 1), F.translate(F.substring(d, digits, 1), "0123456789abcdef", "123456789abcdef0")) if digits else F.lit("stray")
    one = lambda data, place=segment, turn=1: F.struct(place.alias("segment"), F.lit(turn).alias("turn"), data.cast("binary").alias("data"))
    copies = (
        F.when(d < "008", F.array(one(F.concat(F.lit("w"), F.substring(text, 2, 1 << 30)))))
        .when(d < "01", F.array(one(F.concat(text, F.lit("!")))))
        .when(d < "018", F.slice(F.array(one(text)), 1, 0))
        .when(d < "02", F.array(one(text, beside)))
        .when(d < "024", F.array(one(F.concat(F.lit("WARC/1.1"), F.substring(text, 9, 1 << 30)), turn=0), one(text)))
        .otherwise(F.array(one(text)))
    )
    laid = recs.withColumn("digest", F.sha2(text.cast("binary"), 256)).select("page_id", "digest", F.explode(copies).alias("copy"))
    laid = written(laid.select("copy.*", F.struct("digest", "page_id", "copy.turn").alias("place")))
    leaves = laid.select("segment", "place", F.octet_length("data").cast("long").alias("length"), F.sha2("data", 256).alias("digest"))
    order = Window.partitionBy("segment").orderBy("place")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    leaves = written(leaves.select("segment", (F.row_number().over(order) - 1).cast("long").alias("seq"), offset.alias("offset"), "length", "digest"))
    discard(laid)
    return leaves


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixity drill: the archive of all pages against a written copy with known damage. The manifest's rows; what only
    the copy has is in compare()."""
    recs = records(table(spark, sf_dir, "pages"))
    man = manifest(recs)
    return audit(man, damaged_copy(recs, man))


OP8_SQL = r"""
WITH r AS (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
d AS (SELECT page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest FROM r),
k AS (SELECT CAST(greatest(0, ceil(log2(count(*) / 4096.0) / 4 - 1e-12)) AS INTEGER) AS digits FROM d),
p AS (SELECT page_id, left(digest, digits) AS segment, length, digest FROM d, k)
SELECT page_id, segment, row_number() OVER (PARTITION BY segment ORDER BY digest, page_id) - 1 AS seq,
       CAST(coalesce(sum(length) OVER (PARTITION BY segment ORDER BY digest, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       length, digest, left(digest, 2) NOT IN ('00', '01') AS intact
FROM p
"""
