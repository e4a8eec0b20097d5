"""3. Quality rules as a short-circuit cascade.

Every document gets its base features. Beyond the base verdict, a document is kept if no rule of RULES rejects it.
Each rule's cost (seconds) and selectivity (share rejected) are measured on a sample drawn by hash, the cost as the least of
REPEATS runs, rounded to a power of 2 so that noise doesn't change it. The rules run in order of rejection per cost, those
that reject nothing behind by cost, each only on what the rules before it let through. The rules are a conjunction, so the
order changes the work done and never the verdict.

Defined results: null or empty text has no words and fails the base verdict; repeated rows are judged one by one;
equal rejection per cost leaves the rules in the order of RULES; failed_rule is the first of the cascade, so where several
rules reject it depends on the order. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import SPACED, hash_sample, map_batches, table

SAMPLE_ROWS, REPEATS = 256, 5
NGRAM = 8
_SYMBOLS = b"#*$%&|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NO_LETTERS = bytes(i for i in range(128) if not chr(i).isalpha())
_MULTIBYTE_TAIL = bytes(range(0x80, 0xC0))
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def n_chars(data: bytes) -> int:
    return len(data.translate(None, _MULTIBYTE_TAIL))


def repeated_words(ws: list[bytes], n: int = NGRAM) -> int:
    """Words in n-word windows found twice or more. Windows are compared by a hash first, then word by word."""
    count = len(ws) - n + 1
    if count < 2 or len(set(ws)) == len(ws):
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.uint64, len(ws))
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[i : i + count]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(count, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    windows = np.lib.stride_tricks.sliding_window_view(a, n)[at]
    _, inverse, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = at[counts[inverse.ravel()] > 1]
    covered = np.zeros(len(ws) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + n, -1)
    return int((np.cumsum(covered) > 0).sum())


class Doc:
    """A text's base features, and what the rules read."""

    def __init__(self, text: bytes | None):
        self.text = text or b""
        self.words = self.text.translate(SPACED).split()
        self.n_words = len(self.words)
        self.word_bytes = b"".join(self.words)
        self.word_chars = n_chars(self.word_bytes)
        self.n_symbols = len(self.text) - len(self.text.translate(None, _SYMBOLS))
        lines = [x for x in self.text.split(b"\n") if x.strip()]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words = repeated_words(self.words)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


def symbols(d: Doc) -> bool:
    """More than one symbol of [#*$%&|<>] to 10 words."""
    return 10 * d.n_symbols > d.n_words


def word_length(d: Doc) -> bool:
    """A mean word length under 2 or over 15 characters."""
    return d.word_chars < 2 * d.n_words or d.word_chars > 15 * d.n_words


def duplicate_lines(d: Doc) -> bool:
    """More than 30% of the lines with words repeat an earlier line."""
    return 10 * d.n_dup_lines > 3 * d.n_lines


def capitals(d: Doc) -> bool:
    """More capital than small letters of A-Z."""
    rest = d.word_bytes
    return len(rest) - len(rest.translate(None, _UPPER)) > len(rest) - len(rest.translate(None, _LOWER))


def letters(d: Doc) -> bool:
    """Under 60% of the characters of words are letters (all beyond ASCII count)."""
    return 10 * n_chars(d.word_bytes.translate(None, _NO_LETTERS)) < 6 * d.word_chars


def one_word(d: Doc) -> bool:
    """One word makes up over 30% of all."""
    if not d.words:
        return False
    counts: dict[bytes, int] = {}
    for w in d.words:
        counts[w] = counts.get(w, 0) + 1
    return 10 * max(counts.values()) > 3 * d.n_words


RULES: dict[str, Callable[[Doc], bool]] = {f.__name__: f for f in (symbols, word_length, duplicate_lines, capitals, letters, one_word)}


def rule_order(texts: list[bytes | None]) -> list[str]:
    """Rule names by rejection per cost, highest first, measured on a sample."""
    docs = [d for d in map(Doc, texts) if not d.base_failed]
    value = {}
    for name, rule in RULES.items():
        took = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            rejected = sum(map(rule, docs))
            took.append(time.perf_counter() - began)
        cost = 2.0 ** round(math.log2(max(min(took), 1e-9)))
        value[name] = (rejected / cost, -cost)
    return sorted(RULES, key=value.get, reverse=True)


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    failed_rule (null if kept; "base"; or the rule of lowest place in the cascade that rejects)."""
    data = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    order = rule_order([r[0] and r[0].encode("utf-8", "replace") for r in hash_sample(docs, sample_rows).select("text").collect()])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rules = [(n, RULES[n]) for n in order]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", *names, "kept", "failed_rule")}
            for doc_id, text in zip(b["doc_id"], b["text"]):
                d = Doc(text)
                failed = "base" if d.base_failed else next((n for n, rule in rules if rule(d)), None)
                for k in names:
                    out[k].append(getattr(d, k))
                out["doc_id"].append(doc_id)
                out["kept"].append(failed is None)
                out["failed_rule"].append(failed)
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(data, run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("failed_rule")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT *, len(ws) AS n_words, array_to_string(ws, '') AS joined, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
windows AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
repeated AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY rid),
top AS (SELECT rid, max(n) AS n FROM (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY rid, w) GROUP BY rid),
g AS (SELECT rid, doc_id, n_words, len(joined) AS word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
      coalesce(r.n, 0) AS n_repeat_words, coalesce(t.n, 0) AS top_word, joined FROM f LEFT JOIN repeated r USING (rid) LEFT JOIN top t USING (rid)),
h AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM g)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 3 * n_lines
            OR len(regexp_replace(joined, '[^A-Z]', '', 'g')) > len(regexp_replace(joined, '[^a-z]', '', 'g'))
            OR 10 * len(regexp_replace(joined, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) < 6 * word_chars OR 10 * top_word > 3 * n_words) AS kept
FROM h
"""
