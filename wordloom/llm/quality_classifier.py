"""4. Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Tokens are maximal runs of letters, digits or other marks, known by a 64-bit hash. The NAMED most frequent of all
documents have vectors of their own; the rare rest share BUCKETS vectors by hash. Random indexing: every token has a fixed
sparse random index vector, and a vector is the sum of the index vectors of the neighbours (up to REACH tokens away) of
its tokens, over all documents. A document is pooled into the mean and the spread of its tokens' vectors. A network of one hidden layer, written in numpy, is fitted on the pooled vectors
of at most SAMPLE labelled documents (those of the least hashes; a documented bound of the fit alone), and its
probabilities are calibrated by a temperature found on a fifth of them that the fit doesn't see.

Labels are read only for documents whose crc32(doc_id as text) mod 4 isn't 2. Labels, lang, source and doc_id are
never inputs of a score.

Defined results: null and empty texts have the zero vector and are scored like any; rows with one doc_id are scored
one by one; several labels of one doc_id count as their mean, 0.5 as 1; null labels are ignored; with no labels, or
one class only, every score is the add-one share of label 1; of several texts of one labelled doc_id the one of least hash
is fitted. A token of more than CHUNK bytes counts as several. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import SPACED, crc_bucket, extended, map_batches, table

NAMED, BUCKETS, DIM, NONZERO, REACH = 1 << 14, 1 << 13, 48, 2, 2
SAMPLE, HIDDEN, EPOCHS, BATCH, RATE, THRESHOLD, SEED = 20_000, 32, 40, 128, 3e-3, 0.7, 7
FOLDS, HELD = 4, 2
CHUNK, SHRINK = 1 << 19, 8
#: Distinct tokens that a task holds before it gives their counts on.
HELD_TOKENS = 1 << 20
#: Kinds of bytes: 0 white space, 1 letter (all beyond ASCII), 2 digit, 3 mark.
KIND = np.array([0 if i == 32 or 9 <= i <= 13 else 1 if chr(i).isalpha() or i > 127 else 2 if chr(i).isdigit() else 3 for i in range(256)], np.uint8)
_ODD = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D


def chunks(texts: list[bytes | None], limit: int = CHUNK) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of (row numbers, texts) of about limit bytes; a longer text is cut at white space where there is some."""
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        text = text or b""
        while True:
            cut = len(text)
            if cut > limit:
                cut = text[:limit].translate(SPACED).rfind(b" ", 1)
                cut = cut if cut > 0 else limit
            rows.append(k)
            parts.append(text[:cut])
            size += cut
            text = text[cut:]
            if size >= limit:
                yield rows, parts
                rows, parts, size = [], [], 0
            if not text:
                break
    if rows:
        yield rows, parts


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, mod 2**64."""
    global _powers
    if len(_powers[0]) < n:
        both = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(n + (n >> 2), x, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers = both[0], both[1]
    return _powers


def tokens(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of the parts, and the part each lies in."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    kind = KIND[data]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    starts = edge[kind[edge] > 0]
    ends = edge[np.searchsorted(edge, starts, "right")] if len(starts) else starts
    power, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD)
    bounds = np.cumsum([len(p) + 1 for p in parts])
    return h ^ (h >> np.uint64(29)), np.searchsorted(bounds, starts, "right")


def row_of(h: np.ndarray, named: np.ndarray) -> np.ndarray:
    """Vector of each token: its own if its hash is among the sorted named ones, else a shared one behind those."""
    shared = NAMED + ((h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))
    if not len(named):
        return shared
    at = np.minimum(np.searchsorted(named, h), len(named) - 1)
    return np.where(named[at] == h, at, shared)


def frequent_tokens(data: DataFrame, entries: int = NAMED) -> np.ndarray:
    """Sorted hashes of the most frequent tokens of all texts; equals by hash."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            h, where = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(where, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for b in batches:
            for _, parts in chunks(b["text"]):
                held.append(np.unique(tokens(parts)[0], return_counts=True))
            if sum(len(x) for x, _ in held) > HELD_TOKENS:
                held = [added()]
                if len(held[0][0]) > HELD_TOKENS // 2:
                    yield {"h": held[0][0].view(np.int64), "n": held[0][1]}
                    held = []
        if held:
            h, n = added()
            yield {"h": h.view(np.int64), "n": n}

    counts = map_batches(data, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.col("n").desc(), "h").limit(entries).collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def context_sums(texts: list[bytes | None], named: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Sum of the index vectors of neighbours, by vector."""
    rows = NAMED + BUCKETS
    out = np.zeros(rows * dim)
    tail_h, tail_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for own, parts in chunks(texts):
        h, part = tokens(parts)
        # The last tokens before a cut are neighbours of the first behind it.
        new, h, doc = len(tail_h), np.concatenate([tail_h, h]), np.concatenate([tail_doc, np.asarray(own)[part]])
        tail_h, tail_doc = h[-REACH:], doc[-REACH:]
        row = row_of(h, named)
        at = [((h >> np.uint64(16 * k)).astype(np.int64) & 0x7FFF) % dim for k in range(NONZERO)]
        sign = [((h >> np.uint64(16 * k + 15)).astype(np.int64) & 1) * 2.0 - 1 for k in range(NONZERO)]
        for step in range(1, REACH + 1):
            late = np.arange(max(new, step), len(h))
            late = late[doc[late] == doc[late - step]]
            for mine, other in ((late, late - step), (late - step, late)):
                place = np.concatenate([row[mine] * dim + at[k][other] for k in range(NONZERO)])
                out += np.bincount(place, weights=np.concatenate([sign[k][other] for k in range(NONZERO)]), minlength=rows * dim)
    return out.reshape(rows, dim)


def summed_matrix(data: DataFrame, fn, shape: tuple[int, int], spark: SparkSession, blocks: int = 32) -> np.ndarray:
    """Sum over all tasks of fn(texts) -> whole numbers in a matrix of this bounded shape, first within groups of about
    sqrt(tasks) tasks."""
    rows, cols = shape

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for b in batches:
            total += fn(b)
        task = TaskContext.get().partitionId()
        for k, part in enumerate(np.split(total, blocks)):
            if part.any():
                yield {"block": [k], "part": [task % groups], "m": [part.astype("<i4").tobytes()]}

    def add(t: pa.Table) -> pa.Table:
        total = 0
        for x in t["m"]:
            m = x.as_py()
            total = total + np.frombuffer(m, "<i4" if len(m) == 4 * (rows // blocks) * cols else "<i8").astype("<i8")
        return pa.table({"block": t["block"][:1], "part": t["part"][:1], "m": pa.array([total.tobytes()], pa.binary())})

    groups = max(1, round(data.rdd.getNumPartitions() ** 0.5))
    schema = "block int, part int, m binary"
    once = map_batches(data, run, schema).groupBy("block", "part").applyInArrow(add, schema)
    found = once.groupBy("block").applyInArrow(add, schema).collect()
    out = np.zeros(shape)
    for block, _, m in found:
        n = rows // blocks
        out[block * n : (block + 1) * n] = np.frombuffer(m, "<i8").reshape(n, cols)
    return out


def word_vectors(docs: DataFrame, entries: int = NAMED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the named tokens, and unit vectors about the mean; zero where a vector's tokens have no neighbours."""
    data = docs.select(F.col("text").cast("binary").alias("text"))
    named = frequent_tokens(data, entries)
    shared = docs.sparkSession.sparkContext.broadcast(named)
    v = summed_matrix(data, lambda b: context_sums(b["text"], shared.value), (NAMED + BUCKETS, DIM), docs.sparkSession)
    seen = np.abs(v).sum(1) > 0
    v[seen] /= np.linalg.norm(v[seen], axis=1, keepdims=True)
    if seen.any():
        v[seen] -= v[seen].mean(0)
        v[seen] /= np.maximum(np.linalg.norm(v[seen], axis=1, keepdims=True), 1e-9)
    return named, v.astype(np.float32)


def pooled(texts: list[bytes | None], named: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the token vectors of each text, the mean's length and the share of distinct vectors."""
    n, dim = len(texts), vectors.shape[1]
    total, square, count, distinct = np.zeros((n, dim)), np.zeros((n, dim)), np.zeros(n), np.zeros(n)
    found = []
    for rows, parts in chunks(texts):
        h, part = tokens(parts)
        # Each vector of a document once, with its count: repeated tokens cost nothing more.
        found.append(np.unique(np.asarray(rows)[part] * len(vectors) + row_of(h, named), return_counts=True))
    key = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.int64)
    if len(key):
        key, where = np.unique(key, return_inverse=True)  # over all chunks of a text
        times = np.bincount(where, weights=np.concatenate([c for _, c in found]))
        edges = [*range(0, len(key), 1 << 16), len(key)]
        for a, b in zip(edges, edges[1:]):
            doc, row = key[a:b] // len(vectors), key[a:b] % len(vectors)
            v = vectors[row] * times[a:b, None].astype(np.float32)
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            total[doc[first]] += np.add.reduceat(v, first, axis=0)
            square[doc[first]] += np.add.reduceat(v * vectors[row], first, axis=0)
            count[doc[first]] += np.add.reduceat(times[a:b], first)
            distinct[doc[first]] += np.diff(np.append(first, len(doc)))
    one = (count + SHRINK)[:, None]  # short texts lie near the centre
    mean = total / one
    spread = np.sqrt(np.maximum(square / one - mean * mean, 0))
    return np.hstack([mean, spread, np.linalg.norm(mean, axis=1, keepdims=True), distinct[:, None] / np.sqrt(one)]).astype(np.float32)


class Network:
    """Two layers: tanh units and one logit; standardised inputs, Adam, cross entropy, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        check, fit = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
        d = x.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        moment, second, t = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        z, y = (x - self.mean) / self.scale, y.astype(float)
        for _ in range(EPOCHS):
            for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
                a, b, c, e = self.w
                hidden = np.tanh(z[batch] @ a + b)
                out = 1 / (1 + np.exp(-np.clip(hidden @ c + e, -50, 50)))
                g = (out - y[batch]) / len(batch)
                back = np.outer(g, c) * (1 - hidden * hidden)
                t += 1
                for k, grad in enumerate((z[batch].T @ back + 1e-4 * a, back.sum(0), hidden.T @ g, g.sum(keepdims=True))):
                    moment[k] = 0.9 * moment[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    self.w[k] = self.w[k] - RATE * (moment[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        if len(check):
            logits, truth = self.logits(x[check]), y[check]
            loss = lambda s: np.mean(np.logaddexp(0, logits / s) - truth * logits / s)
            self.temperature = min(np.geomspace(0.25, 16, 97), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, e = self.w
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + e

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


class Constant:
    def __init__(self, p: float):
        self.p = p

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def fit(docs: DataFrame, labels: DataFrame, words: tuple[np.ndarray, np.ndarray], label: str = "quality", sample: int = SAMPLE) -> Network | Constant:
    allowed = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_bucket(F.col("doc_id"), FOLDS) != HELD))
    chosen = allowed.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    truth = {r[0]: r[1] for r in chosen}
    if len(set(truth.values())) < 2:
        return Constant((sum(truth.values()) + 1) / (len(truth) + 2))
    spark = docs.sparkSession
    ids = spark.createDataFrame([(k,) for k in truth], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    data = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")  # at most `sample` ids
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            if b["doc_id"]:
                yield {"doc_id": b["doc_id"], "h": b["h"], "x": [v.tobytes() for v in pooled(b["text"], *shared.value)]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(map_batches(data, run, f"doc_id {kind}, h long, x binary").groupBy("doc_id").agg(F.min_by("x", "h")).collect())
    if len({truth[r[0]] for r in rows}) < 2:
        return Constant((sum(truth.values()) + 1) / (len(truth) + 2))
    return Network(np.array([np.frombuffer(r[1], np.float32) for r in rows], float), np.array([truth[r[0]] for r in rows]))


def _fitted(docs: DataFrame, labels: DataFrame, label: str):
    """Broadcast (word vectors, network)."""
    words = word_vectors(docs)
    return docs.sparkSession.sparkContext.broadcast((words, fit(docs, labels, words, label)))


def _probabilities(model, texts: list[bytes | None]) -> list[float]:
    words, network = model.value
    return network.probability(pooled(texts, *words)).tolist() if texts else []


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = _fitted(docs, labels, label)

    def run(columns: dict) -> dict:
        p = _probabilities(model, columns["text"])
        return {"score": p, "predicted": [int(x >= threshold) for x in p]}

    held = (crc_bucket(F.col("doc_id"), FOLDS) == HELD).alias("held_out")
    return extended(docs.select("doc_id", held, "text"), ["text"], run, "score double, predicted int", ("text",))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are predicted to have label 1, with all their columns."""
    model = _fitted(docs, labels, label)
    return extended(docs, ["text"], lambda c: {None: [x >= threshold for x in _probabilities(model, c["text"])]})


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
