"""6. Token counts by a map-side two-tier lookup.

Byte-level BPE never merges across pre-tokens, so a text's count is the sum of its pre-tokens' counts. The first
tier is a broadcast table of frequent pre-tokens and their token counts (at most TABLE_ENTRIES entries of at most
MAX_KEY characters); the second is a cache in each Python worker, filled by encoding misses with the library. No
pre-token of the corpus is ever shuffled. The table is filled from SAMPLE_ROWS documents drawn by hash, whole texts, and
only saves encoding: every count is what the library gives, whatever the table holds.

Pre-tokens are cut by the published pattern of the vocabulary. Characters whose class depends on the Unicode
version of the pattern's engine (outside SAFE) send the whole text to the library instead.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings in a text count as the library
counts them by default; repeated rows are counted one by one. Other columns are ignored.
"""

from __future__ import annotations

import sys
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import hash_sample, map_batches, table

SAMPLE_ROWS, TABLE_ENTRIES, MAX_KEY, CACHE_ENTRIES = 2_000, 1 << 15, 32, 1 << 19
TOKENIZER, SPECIAL = "byte_bpe_50k.json", "<|endoftext|>"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points whose classes both engines agree on.
SAFE = r"\x00-՗؀-ۿऀ-૿Ḁ-ⁿ₠-₿　-鿿가-힣＀-￯\U0001f300-\U0001f64f"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TokenCounter:
    """Token counts of texts: table, then cache, then library."""

    def __init__(self, path: str, frequent: dict[str, int]):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = regex.compile(PRETOKEN).findall
        self.unsafe = regex.compile(f"[^{SAFE}]").search
        self.plain = regex.compile(r" \p{L}+").fullmatch
        self.frequent = frequent
        self.cache = dict(frequent)

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode_pretokens(self, new: list[str]) -> dict[str, int]:
        """Counts of single pre-tokens. Those of a blank and letters, joined, are cut at the same places again, so one
        call does for all of them."""
        plain = [p for p in new if self.plain(p)]
        if not plain:
            return dict(zip(new, self.encode(new)))
        of = Counter(self.tokenizer.encode("".join(plain), add_special_tokens=False).word_ids)
        counts = {p: of[i] for i, p in enumerate(plain)}
        rest = [p for p in new if p not in counts]
        return counts | dict(zip(rest, self.encode(rest)))

    def count(self, text: str) -> int:
        if not text.isascii() and self.unsafe(text):
            return self.encode([text])[0]
        if SPECIAL in text:
            parts = text.split(SPECIAL)
            return len(parts) - 1 + sum(map(self.count, parts))
        found, cache = self.split(text), self.cache
        try:
            return sum(map(cache.__getitem__, found))
        except KeyError:
            pass
        counts = self.encode_pretokens(list({p for p in found if p not in cache}))
        total = sum(counts[p] if p in counts else cache[p] for p in found)
        if len(cache) > CACHE_ENTRIES:
            self.cache = cache = dict(self.frequent)
        cache.update((p, n) for p, n in counts.items() if len(p) <= MAX_KEY)
        return total


def frequent_pretokens(sample: DataFrame, entries: int = TABLE_ENTRIES) -> list[str]:
    """The most frequent short pre-tokens of a sample; equals by code points."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        import regex

        split = regex.compile(PRETOKEN).findall
        for b in batches:
            counts: Counter[str] = Counter()
            for t in b["text"]:
                counts.update(p for p in split((t or "").replace(SPECIAL, "\n")) if len(p) <= MAX_KEY)
            yield {"p": list(counts), "n": list(counts.values())}

    counts = map_batches(sample.select("text"), run, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
    return [r[0] for r in counts.orderBy(F.col("n").desc(), "p").limit(entries).collect()]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    path = path or tokenizer_path()
    common = frequent_pretokens(hash_sample(docs, sample_rows))
    counter = TokenCounter(path, {})
    frequent = docs.sparkSession.sparkContext.broadcast(dict(zip(common, counter.encode(common))))
    name = f"_wordloom_tokens_{uuid.uuid4().hex}"

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        # One cache a worker, kept from task to task.
        count = sys.__dict__.setdefault(name, TokenCounter(path, frequent.value) if name not in sys.__dict__ else None).count
        for b in batches:
            texts = [t or "" for t in b["text"]]
            n = [count(t) for t in texts]
            yield {"doc_id": b["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
