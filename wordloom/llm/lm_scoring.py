"""10. Language-model scoring by a subword lattice.

Tokens are lower-cased words and one end a document. Two models learn from the training documents (crc32 of the id,
mod 7, isn't 2), over all of them:

* the base model, add-one word counts;
* the lattice model: a text is a sequence of pieces of an existing vocabulary and an end, each drawn independently.
  A word's probability is the sum over all its segmentations, computed by a log-space forward recursion over the
  lattice of pieces; pieces don't cross words, so a text's is the product over its words. Characters without a piece
  are spelled in byte pieces.

The file's scores are merge ranks, not log probabilities, so the pieces' weights are their counts in the training
words as the vocabulary itself segments them, plus one. Every distinct word is counted, segmented and scored once;
documents then look their words up in two tiers: a broadcast table of the most frequent words (at most TABLE_WORDS, those
of more than MAX_KEY bytes by their MD5), and a shuffle join for the rest, which by then has no hot word of any length. Sums are of whole 1e-10
units, so they don't depend on the order of rows.

Defined results: null text is empty and has the end alone; without training tokens every base probability is 1;
rows alike in doc_id and text get equal results; rows with one doc_id and other texts are separate documents.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import LOWER_SPACED, crc_bucket, lower_ascii, map_batches, table, words, written

TABLE_WORDS, MAX_KEY, FOLDS, HELD = 1 << 17, 64, 7, 2
VOCABULARY = "piece_bpe_32k.model"
UNIT, MARK = 10**10, "▁"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The vocabulary: normal pieces, byte pieces, and segmentation by the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.vocab_size()
        self.bytes = {int(self.library.id_to_piece(i)[1:-1], 16): i for i in range(n) if self.library.is_byte(i)}
        self.normal = {self.library.id_to_piece(i): i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))}


class Lattice:
    """Marginal log10 probability of a word under piece weights (natural logs)."""

    def __init__(self, pieces: dict[str, float], single_bytes: dict[int, float]):
        self.pieces, self.bytes = pieces, single_bytes
        self.longest = max(map(len, pieces), default=1)

    def word(self, word: str) -> float:
        s, get, longest = MARK + word, self.pieces.get, self.longest
        alpha = [0.0] * (len(s) + 1)
        for j in range(1, len(s) + 1):
            found = [alpha[i] + p for i in range(max(0, j - longest), j) if (p := get(s[i:j])) is not None]
            if s[j - 1] not in self.pieces:
                found.append(alpha[j - 1] + sum(self.bytes[b] for b in s[j - 1].encode("utf-8", "replace")))
            if len(found) == 1:
                alpha[j] = found[0]
            else:
                top = max(found)
                alpha[j] = top + math.log(sum(math.exp(x - top) for x in found))
        return alpha[-1] / math.log(10)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c in training documents, t in all) of every distinct word."""
    each = docs.select((crc_bucket(F.col("doc_id"), FOLDS) != HELD).cast("long").alias("train"), F.explode(words(lower_ascii(F.col("text")))).alias("word"))
    return each.groupBy("word").agg(F.sum("train").alias("c"), F.count(F.lit(1)).alias("t"))


def fit_lattice(counts: DataFrame, ends: int, path: str) -> tuple[Lattice, float]:
    """Piece weights from the training words, and the end's natural log probability."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        library, total = Pieces(path).library, Counter()
        for b in batches:
            for n, ids in zip(b["c"], library.encode(b["word"], num_threads=1)):
                for i in ids:
                    total[i] += n
        yield {"piece": list(total), "n": list(total.values())}

    found = map_batches(counts.where("c > 0").select("word", "c"), run, "piece int, n long").groupBy("piece").agg(F.sum("n"))
    n = dict(found.collect())  # at most the vocabulary
    vocabulary = Pieces(path)
    ids = [*vocabulary.normal.values(), *vocabulary.bytes.values()]
    total = math.log(sum(n.get(i, 0) + 1 for i in ids) + ends + 1)
    log = lambda i: math.log(n.get(i, 0) + 1) - total
    return Lattice({p: log(i) for p, i in vocabulary.normal.items()}, {b: log(i) for b, i in vocabulary.bytes.items()}), math.log(ends + 1) - total


def scored_words(counts: DataFrame, lattice: Lattice) -> DataFrame:
    """Adds each word's terms in units: base (log10 of c + 1) and lattice."""
    model = counts.sparkSession.sparkContext.broadcast(lattice)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        word = model.value.word
        for b in batches:
            yield b | {"base": [round(math.log10(c + 1) * UNIT) for c in b["c"]], "lattice": [round(word(w) * UNIT) for w in b["word"]]}

    return map_batches(counts, run, "word string, c long, t long, base long, lattice long")


def table_key(word: bytes, max_key: int = MAX_KEY) -> bytes:
    """A word as a key of the table: itself, or a blank and its MD5 (no word holds a blank)."""
    return word if len(word) <= max_key else b" " + hashlib.md5(word, usedforsecurity=False).digest()


def least_frequent(scored: DataFrame, entries: int) -> int:
    """The least bin of counts t (eighths of powers of 2) from which on there are at most entries words."""
    level = F.floor(F.log2("t") * 8).cast("int").alias("level")
    bins = sorted(scored.groupBy(level).count().collect(), reverse=True)
    total, least = 0, 1 << 30
    for at, n in bins:
        total += n
        if total > entries:
            break
        least = at
    return least


def score(docs: DataFrame, path: str | None = None, table_words: int = TABLE_WORDS, max_key: int = MAX_KEY) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    docs = docs.select("doc_id", "text")
    train = crc_bucket(F.col("doc_id"), FOLDS) != HELD
    ends = docs.where(train).count()
    counts = written(word_counts(docs))
    lattice, end_log = fit_lattice(counts, ends, path)
    scored = written(scored_words(counts, lattice))
    known = scored.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = known[0] + ends, known[1] + (ends > 0)
    least = least_frequent(scored, table_words)
    is_frequent = F.floor(F.log2("t") * 8) >= least
    word = F.col("word").cast("binary")
    key = F.when(F.octet_length(word) <= max_key, word).otherwise(F.concat(F.lit(" ").cast("binary"), F.unhex(F.md5(word))))
    frequent = {bytes(r[0]): (int(r[1] > 0), r[2], r[3]) for r in scored.where(is_frequent).select(key, "c", "base", "lattice").collect()}
    tier = spark.sparkContext.broadcast(frequent)
    end = (int(ends > 0), round(math.log10(ends + 1) * UNIT), round(end_log / math.log(10) * UNIT))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        get = tier.value.get
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "h", "word", "n", "n_tokens", "n_known", "base", "lattice")}
            columns = list(out.values())
            for doc_id, h, text in zip(b["doc_id"], b["h"], b["text"]):
                ws = (text or b"").translate(LOWER_SPACED).split()
                if ws and len(max(ws, key=len)) > max_key:
                    found = [get(table_key(w, max_key)) for w in ws]
                else:
                    found = list(map(get, ws))
                rest = Counter(w for w, f in zip(ws, found) if f is None)
                a, x, y = map(sum, zip(end, *(f for f in found if f is not None)))
                # A blank in the key: matches no word, and spreads the documents' own rows.
                for row in ((doc_id, h, f" {h}", 0, len(ws) + 1, a, x, y), *((doc_id, h, w.decode("utf-8", "replace"), k, 0, 0, 0, 0) for w, k in rest.items())):
                    for c, value in zip(columns, row):
                        c.append(value)
                if len(columns[0]) > 50_000:
                    yield out
                    out = {k: [] for k in out}
                    columns = list(out.values())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    data = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    parts = map_batches(data, run, f"doc_id {kind}, h long, word string, n long, n_tokens long, n_known long, base long, lattice long")
    rest = scored.where(~is_frequent).select("word", (F.col("c") > 0).cast("long").alias("w_known"), F.col("base").alias("w_base"), F.col("lattice").alias("w_lattice"))
    joined = parts.join(rest, "word", "left")
    plus = lambda own, other: F.sum(F.col(own) + F.col("n") * F.coalesce(other, F.lit(0))).alias(own)
    sums = joined.groupBy("doc_id", "h").agg(F.sum((F.col("n") == 0).cast("int")).alias("copies"), F.sum("n_tokens").alias("n_tokens"), plus("n_known", "w_known"), plus("base", "w_base"), plus("lattice", "w_lattice"))
    each = sums.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    tokens = (F.col("n_tokens") / F.col("copies")).cast("long")
    return each.select(
        "doc_id",
        (~(crc_bucket(F.col("doc_id"), FOLDS) != HELD)).alias("held_out"),
        tokens.alias("n_tokens"),
        (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") / UNIT - tokens * math.log10(n + v + 1)).alias("base_score"),
        (F.col("lattice") / F.col("copies") / UNIT).alias("score"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
