"""2. Benchmark decontamination by Wu-Manber multi-pattern search.

A text is lower-cased (A-Z) and its words are joined by single blanks, with a blank at both ends. A pattern is a
window of 13 consecutive words of a benchmark item, written the same way, so an occurrence is always whole words.
The search looks at the last BLOCK bytes of the current window position: the shift table says how far every
pattern rules out a match and the position moves on by that; where the shift is 0 the block selects a bucket of
patterns and each is compared directly. Patterns are grouped by length first, since the shortest of a group limits
its shifts.

The compiled tables are proportional to the benchmark, so it is cut into blocks of at most BLOCK_BYTES of text, which the
driver reads one at a time. A block's tables (some 100 bytes for each of its bytes, in every worker) are broadcast, all
documents are searched for it, what is found is written, and the tables are freed before the next block. A benchmark of
one block takes one pass and no shuffle; of more, the findings of a document are merged by doc_id and text hash at the end.

clean_documents() leaves out every document that holds a window, however long the rest of its text is; the column
contaminated asks for a share of the text besides.

Defined results: null or empty text has no words and isn't contaminated; null or empty items have no windows;
repeated documents are handled one by one; rows with one item_id are one item, and several items with one text all
count; a null item_id counts as the empty
string in items_sha256. Other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import discard, extended, table, without, written

WINDOW, BLOCK, BLOCK_BYTES = 13, 8, 1 << 20
#: bytes.translate table: A-Z to a-z, all that isn't 0-9, a-z or beyond ASCII to a blank.
NORMAL = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))

#: Pattern groups by least byte length.
LENGTHS = (48, 24, 12, 8, 4, 1)


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class WuManber:
    """Shift and bucket tables over byte patterns; pattern id -> what it stands for is the caller's."""

    def __init__(self, patterns: list[bytes]):
        by: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            by.setdefault(next(n for n in LENGTHS if len(p) >= n), []).append(i)
        self.patterns, self.groups = patterns, []
        for ids in by.values():
            m = min(len(patterns[i]) for i in ids)
            b = min(BLOCK, m)
            shift: dict[bytes, int] = {}
            ends: dict[bytes, list[int]] = {}
            for i in ids:
                p = patterns[i][:m]
                for j in range(b, m + 1):
                    key = p[j - b : j]
                    if m - j < shift.get(key, m):
                        shift[key] = m - j
                ends.setdefault(p[m - b :], []).append(i)
            self.groups.append((m, b, shift, ends))

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(position, pattern id) of every occurrence."""
        patterns, n = self.patterns, len(text)
        for m, b, shift, ends in self.groups:
            get, far, at = shift.get, m - b + 1, m
            while at <= n:
                step = get(text[at - b : at], far)
                if step:
                    at += step
                    continue
                begin = at - m
                for i in ends[text[at - b : at]]:
                    if text.startswith(patterns[i], begin):
                        yield begin, i
                at += 1


def compile_items(items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[WuManber, list[list[int]], list[int], list[str]]:
    """Search tables, the item numbers of each pattern, each pattern's words, and the item ids as strings."""
    index: dict[bytes, int] = {}
    owners: list[list[int]] = []
    lengths: list[int] = []
    names = ["" if k is None else str(k) for k, _ in items]
    for number, (_, text) in enumerate(items):
        ws = normal_words(text and text.encode())
        for i in range(max(1, len(ws) - window + 1)) if ws else ():
            part = ws[i : i + window]
            p = index.setdefault(b" " + b" ".join(part) + b" ", len(index))
            if p == len(owners):
                owners.append([])
                lengths.append(len(part))
            if not owners[p] or owners[p][-1] != number:
                owners[p].append(number)
    return WuManber(list(index)), owners, lengths, names


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """Items in lists of at most block_bytes text (a longer item is a list by itself); a partition at a time is on the driver."""
    part: list[tuple[object, str | None]] = []
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len((row[1] or "").encode("utf-8", "replace"))
        if part and size + n > block_bytes:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += n
    if part:
        yield part


def _search(compiled: tuple, texts: list[bytes | None]) -> dict[str, list]:
    """For each text: starts and ends (in words) of the patterns in it, and names of the items."""
    search, owners, lengths, names = compiled
    out: dict[str, list] = {"starts": [], "ends": [], "items": []}
    for text in texts:
        text = b" " + b" ".join(normal_words(text)) + b" "
        starts, ends, hit = [], [], set()
        spans = [(begin, lengths[i]) for begin, i in search.find(text) if not hit.update(owners[i])]
        if spans:
            blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            starts = np.searchsorted(blanks, [b for b, _ in spans]).tolist()
            ends = [w + n for w, (_, n) in zip(starts, spans)]
        for k, v in zip(out, (starts, ends, [names[i] for i in hit])):
            out[k].append(v)
    return out


def merged(starts: list[int], ends: list[int]) -> list[list[int]]:
    """Disjoint spans of what the given ones cover."""
    spans: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return spans


def contaminated(hit: int, n: int) -> bool:
    return hit > 0 and 20 * hit >= n


def _digest(texts: list[bytes | None], found: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "hit_spans")}
    for text, starts, ends, items in zip(texts, found["starts"], found["ends"], found["items"]):
        n, spans, names = len(normal_words(text)), merged(starts or (), ends or ()), sorted(set(items or ()))
        hit = sum(b - a for a, b in spans)
        for k, v in zip(out, (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), contaminated(hit, n), names, spans)):
            out[k].append(v)
    return out


FOUND = "starts array<bigint>, ends array<bigint>, items array<string>"
DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, hit_spans array<array<long>>"


def _hits(docs: DataFrame, parts: Iterator[list], window: int) -> DataFrame:
    """doc_id, h (text hash), starts, ends, items of the documents in which windows of any block occur; a block at a time."""
    spark, texts, found = docs.sparkSession, docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), None
    for items in parts:
        tables = spark.sparkContext.broadcast(compile_items(items, window))

        def run(c: dict, tables=tables) -> dict:
            out = _search(tables.value, c["text"])
            return out | {None: [bool(x) for x in out["starts"]]}

        rows = extended(texts, ["text"], run, FOUND, ("text",)).dropDuplicates(["doc_id", "h"])
        new = written(rows if found is None else rows.unionByName(found).groupBy("doc_id", "h").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items"))))
        if found is not None:
            discard(found)
        found = new
        tables.unpersist()
    return found


def _parts(benchmark: DataFrame, block_bytes: int) -> tuple[list, Iterator[list]]:
    """The first block, and all of them if there are more."""
    rest = blocks(benchmark, block_bytes)
    first, second = next(rest, []), next(rest, None)
    return first, iter(()) if second is None else chain([first, second], rest)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, hit_spans (word ranges)."""
    docs = docs.select("doc_id", "text")
    first, parts = _parts(benchmark, block_bytes)
    if (one := next(parts, None)) is None:
        tables = docs.sparkSession.sparkContext.broadcast(compile_items(first, window))
        return extended(docs, ["text"], lambda c: _digest(c["text"], _search(tables.value, c["text"])), DIGEST, ("text",))
    found = _hits(docs, chain([one], parts), window).select(F.col("doc_id").alias("id"), F.col("h").alias("k"), "starts", "ends", "items")
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("k")), "left").select("doc_id", "text", "starts", "ends", "items")
    return extended(joined, ["text", "starts", "ends", "items"], lambda c: _digest(c["text"], c), DIGEST, ("text", "starts", "ends", "items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    first, parts = _parts(benchmark, block_bytes)
    if (one := next(parts, None)) is None:
        tables = docs.sparkSession.sparkContext.broadcast(compile_items(first, window))
        return extended(docs, ["text"], lambda c: {None: [not x for x in _search(tables.value, c["text"])["starts"]]})
    return without(docs, _hits(docs, chain([one], parts), window), {"doc_id": F.col("doc_id"), "h": F.xxhash64("text")})


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
patterns AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT n FROM patterns),
windows AS (SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d CROSS JOIN lengths WHERE len(ws) >= n)),
found AS (SELECT rid, item_id, i, w.n FROM windows w JOIN patterns p ON w.n = p.n AND w.w = p.w),
hits AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""
