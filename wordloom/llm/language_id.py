"""9. Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the text's likelihood under byte-trigram models, the language that the markup
declares, the address's suffix, and the prior of its host. The trigram models count every document by its declared
language. The other tables come from grouped aggregation of the text's own verdicts over all rows: how often each
declaration and suffix goes with a language, and the share of each language on a host, smoothed towards its domain's,
which is smoothed towards the whole's. Text likelihoods count as at most TEXT_CAP trigrams, since neighbouring
trigrams aren't independent.

Beside the languages there is the hypothesis that a text is in none of them (a language without a model, or letter
junk): trigrams drawn evenly, or byte by byte as in all documents, of prior OTHER. Declarations, suffixes and hosts don't speak for or
against it. What it wins has no language.

For documents the lang column stands for the declaration and the source for the host; they have no address. Languages
are the primary subtags (two or three letters) that at least two documents declare; there is no cut by share. Up to
LANGUAGE_BLOCK of them take one pass over the texts, more take a pass a block.

A row is kept if the posterior of its best language reaches KEEP and its text has at least MIN_TRIGRAMS trigrams.

Defined results: null and empty texts and pages have no text evidence and are judged by the rest, and not kept;
missing evidence (null, or unseen) has no weight; a declaration that isn't a language tag is a declaration like any other,
but no language; equal posteriors go to the first by name; with no language at all the result is null and nothing is kept.
Ids may be of any type. Repeated rows are judged one by one. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import LOWER_SPACED, extended, looked_up, table, without, written
from wordloom.llm.quality_classifier import chunks, summed_matrix

FEATURES, TEXT_CAP, KAPPA, KEEP, MIN_TRIGRAMS = 1 << 15, 40.0, 20.0, 0.6, 1
#: Prior of no language, pseudo-count of a trigram, languages of a pass.
OTHER, PSEUDO, LANGUAGE_BLOCK = 0.01, 1 / 1024, 64
_TAG = r"^([A-Za-z]{2,3})(?:[-_].*)?$"
_LANG = re.compile(r"[\s\"']lang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_NAME_END = re.compile(r"[\s/>]")
_ASCII = {i: i + 32 for i in range(65, 91)}


def _lower(text: str) -> str:
    """Lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII)


def trigrams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all byte trigrams about a letter, the part each lies in, the normalised bytes and where each begins."""
    data = np.frombuffer((b" " + b"  ".join(p.translate(LOWER_SPACED) for p in parts) + b" "), np.uint8)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), data, np.zeros(0, np.int64)
    a = data.astype(np.uint32)
    code = ((a[:-2] << 16) | (a[1:-1] << 8) | a[2:]) * np.uint32(0x9E3779B1) >> np.uint32(17)
    letter = ((data >= 97) & (data <= 122)) | (data > 127)
    at = np.flatnonzero(letter[1:-1])
    bounds = np.cumsum([len(p) + 2 for p in parts])
    return code[at].astype(np.int64), np.searchsorted(bounds, at, "right"), data, at


def _after(text: str, end: str, at: int) -> int:
    """Where the text goes on after the next end from at on; -1 without one."""
    i = text.find(end, at)
    return i if i < 0 else i + len(end)


def visible(html: str | None) -> bytes:
    """Text outside tags, comments, scripts and styles; one forward scan, whatever isn't closed."""
    import html as entities

    html = html or ""
    low, out, at, open_ended = _lower(html), [], 0, set()
    while (i := html.find("<", at)) >= 0:
        out.append(html[at:i])
        name = "!--" if html.startswith("!--", i + 1) else next((n for n in ("script", "style") if low.startswith(n, i + 1) and _NAME_END.match(low, i + 1 + len(n))), None)
        at = -1
        if name == "!--" and name not in open_ended:
            at = _after(html, "-->", i + 4)
        elif name and name not in open_ended:
            close = low.find(f"</{name}", i)
            while close >= 0 and not _NAME_END.match(low, close + 2 + len(name)):
                close = low.find(f"</{name}", close + 2)
            at = close if close < 0 else _after(html, ">", close)
        if at < 0:
            if name:
                open_ended.add(name)  # nothing further on closes another
            at = _after(html, ">", i)
        if at < 0:
            out.append(html[i:])
            at = len(html)
        out.append(" ")
    out.append(html[at:])
    return entities.unescape("".join(out)).encode("utf-8", "replace")


def declared_language(html: str | None) -> str | None:
    """The primary subtag in the first html tag's lang."""
    html = html or ""
    low = _lower(html)
    i = low.find("<html")
    while i >= 0 and not _NAME_END.match(low, i + 5):
        i = low.find("<html", i + 5)
    m = _LANG.search(html, i + 5, max(html.find(">", i), 0)) if i >= 0 else None
    return m[1].lower() if m else None


def host_parts(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two labels) and suffix of an address; None for what isn't there."""
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.I)
    if not m:
        return None, None, None
    host = m[1].lower().rstrip(".")
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else None


def _language(declared: Column) -> Column:
    """The primary subtag of a language tag, or null."""
    return F.nullif(F.lower(F.regexp_extract(declared, _TAG, 1)), F.lit(""))


def languages_of(docs: DataFrame) -> list[str]:
    """Languages that at least two documents declare; at most as many as there are subtags of two or three letters."""
    counts = docs.select(_language(F.col("lang")).alias("l")).where("l is not null").groupBy("l").count()
    return sorted(r[0] for r in counts.where("count > 1").collect())


def text_models(docs: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """log P(trigram | language), FEATURES x languages, and log P(byte) of the documents in these languages."""
    index = {k: i for i, k in enumerate(languages)}
    n = len(languages)

    def count(b: dict) -> np.ndarray:
        total = np.zeros((FEATURES + 256) * n)
        own = [index.get(k, -1) for k in b["lang"]]
        for rows, parts in chunks(b["text"]):
            code, part, data, at = trigrams(parts)
            if not len(code):
                continue
            lang = np.asarray([own[r] for r in rows])[part]
            mine = lang >= 0
            total += np.bincount((code * n + lang)[mine], minlength=len(total))
            for k in range(3):
                total += np.bincount(((FEATURES + data[at + k].astype(np.int64)) * n + lang)[mine], minlength=len(total))
        return total.reshape(FEATURES + 256, n)

    data = docs.select(_language(F.col("lang")).alias("lang"), F.col("text").cast("binary").alias("text"))
    counts = summed_matrix(data, count, (FEATURES + 256, n), docs.sparkSession)
    own, single = counts[:FEATURES] + PSEUDO, counts[FEATURES:].sum(1) + PSEUDO
    return np.log(own / own.sum(0)).astype(np.float32), np.log(single / single.sum())


class Models:
    """The languages of training documents and their text models, a block at a time."""

    def __init__(self, train: DataFrame):
        self.train, self.languages, self._last = train, languages_of(train), (None, None)

    def blocks(self) -> int:
        return -(-len(self.languages) // LANGUAGE_BLOCK)

    def block(self, k: int):
        """Broadcast models of block k; the last one asked for is kept."""
        if self._last[0] != k:
            if self._last[1] is not None:
                self._last[1].unpersist()
            names = self.languages[k * LANGUAGE_BLOCK : (k + 1) * LANGUAGE_BLOCK]
            self._last = k, self.train.sparkSession.sparkContext.broadcast(text_models(self.train, names))
        return self._last[1]


def _text_scores(texts: list[bytes], model: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of each text by language and, last, by single bytes, weighted down to TEXT_CAP trigrams; trigrams."""
    total, n, chance = np.zeros((len(texts), model.shape[1] + 1)), np.zeros(len(texts), np.int64), np.exp(single)
    for rows, parts in chunks(texts):
        code, part, data, at = trigrams(parts)
        if len(code):
            own = np.asarray(rows)[part]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[first], :-1] += np.add.reduceat(model[code], first, axis=0, dtype=np.float64)
            drawn = chance[data[at]] * chance[data[at + 1]] * chance[data[at + 2]] / 2 + 0.5 / FEATURES
            total[own[first], -1] += np.add.reduceat(np.log(drawn), first)
            n[own[first]] += np.diff(np.append(first, len(own)))
    return total * np.minimum(1, TEXT_CAP / np.maximum(n, 1))[:, None], n


def text_evidence(rows: DataFrame, models: Models) -> DataFrame:
    """(kind, id, h, body, declared, host, url) -> kind, id, h, declared, host, domain, suffix, n (trigrams), ll (by language)
    and other (of no language); bodies of pages are HTML. Written."""
    read = rows.withColumns({"ll": F.array().cast("array<double>"), "other": F.lit(0.0)})
    for k in range(models.blocks()):
        shared, last = models.block(k), k == models.blocks() - 1

        def run(c: dict, shared=shared, k=k, last=last) -> dict:
            model, single = shared.value
            page = [x == b"page" for x in c["kind"]]
            html = [t.decode("utf-8", "replace") if p and t else None for p, t in zip(page, c["body"])]
            scores, n = _text_scores([visible(h) if p else t or b"" for p, h, t in zip(page, html, c["body"])], model, single)
            out = {"ll": [old + new for old, new in zip(c["ll"], scores[:, :-1].tolist())], "other": [old + (new - old) / (k + 1) for old, new in zip(c["other"], scores[:, -1].tolist())]}
            if last:
                text = lambda x: x and x.decode("utf-8", "replace")
                places = [host_parts(text(u)) if p else (text(h), None, None) for p, h, u in zip(page, c["host"], c["url"])]
                out |= {"declared": [declared_language(h) if p else text(d) for p, h, d in zip(page, html, c["declared"])], "n": n.tolist()}
                out |= {name: [x[i] for x in places] for i, name in enumerate(("host", "domain", "suffix"))}
            return out

        more = ", n long, declared string, host string, domain string, suffix string" if last else ""
        read = written(extended(read, ["kind", "body", "declared", "host", "url", "ll", "other"], run, "ll array<double>, other double" + more, ("body", "declared", "host", "url", "ll", "other") if last else ("ll", "other")))
    return read


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _counts(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """Text verdicts by the value of columns: an array n of k counts."""
    each = rows.where(F.col(keys[0]).isNotNull() & F.col("best").isNotNull()).groupBy(*keys, "best").agg(F.count(F.lit(1)).alias("c"))
    found = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "c"))).alias("m"))  # at most a language each
    return found.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")).alias("n"))


def fuse(evidence: DataFrame, languages: list[str], addresses: bool = True) -> DataFrame:
    """Posterior of each row of written evidence from its text and the grouped tables; addresses: whether rows may have a
    domain and a suffix."""
    k = len(languages)
    top = F.array_max("ll")
    rows = evidence.withColumn("best", F.when((F.col("n") >= MIN_TRIGRAMS) & (top >= F.col("other")), (F.array_position("ll", top) - 1).cast("int")))
    whole = dict(rows.where("best is not null").groupBy("best").count().collect())  # a row a language
    share = [(whole.get(i, 0) + 1) / (sum(whole.values()) + k) for i in range(k)]
    flat = F.array(*map(F.lit, share))
    mixed = lambda n, prior: F.zip_with(n, prior, lambda a, p: (a + KAPPA * p) / (_sum(n) + KAPPA))
    # P(value | language) over P(value): P(language | value) over P(language).
    ratio = lambda n: F.transform(F.zip_with(mixed(n, flat), flat, lambda a, p: a / p), lambda x: F.log(x))
    hosts = _counts(rows, k, "host", "domain")
    if addresses:
        hosts = hosts.join(_counts(rows, k, "domain").select("domain", mixed(F.col("n"), flat).alias("p")), "domain", "left")
    hosts = hosts.select("host", F.transform(mixed(F.col("n"), F.coalesce("p", flat) if addresses else flat), lambda x: F.log(x)).alias("host_p"))
    for key, found in (("host", hosts), *((key, _counts(rows, k, key).select(key, ratio(F.col("n")).alias(f"{key}_p"))) for key in (("declared", "suffix") if addresses else ("declared",)))):
        rows = looked_up(rows, written(found), [key], "left")
    if not addresses:
        rows = rows.withColumn("suffix_p", F.lit(None).cast("array<double>"))
    zeros, log_share = F.array(*(F.lit(0.0) for _ in range(k))), F.transform(flat, lambda x: F.log(x))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = add(add(add(F.col("ll"), F.coalesce("declared_p", zeros)), F.coalesce("suffix_p", zeros)), F.coalesce("host_p", log_share))
    rows = rows.withColumn("total", total).withColumn("other", F.col("other") + F.log(F.lit(OTHER))).withColumn("top", F.array_max("total"))
    rows = rows.withColumn("most", F.greatest("top", "other"))
    mass = _sum(F.transform("total", lambda x: F.exp(x - F.col("most")))) + F.exp(F.col("other") - F.col("most"))
    name = lambda i: F.get(F.array(*map(F.lit, languages)), i)
    return rows.select(
        "kind",
        "id",
        F.when(F.col("top") >= F.col("other"), name((F.array_position("total", F.col("top")) - 1).cast("int"))).alias("language"),
        (F.exp(F.col("top") - F.col("most")) / mass).alias("probability"),
        name(F.col("best")).alias("text_language"),
        "declared",
        "host",
        "h",
        (F.col("n") >= MIN_TRIGRAMS).alias("has_text"),
    ).withColumn("kept", F.col("has_text") & F.col("language").isNotNull() & (F.col("probability") >= KEEP))


def as_rows(docs: DataFrame, kind: str) -> DataFrame:
    null = F.lit(None).cast("string")
    if kind == "page":
        return docs.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.xxhash64("html").alias("h"), F.col("html").alias("body"), null.alias("declared"), null.alias("host"), "url")
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.col("text").alias("body"), F.col("lang").alias("declared"), F.col("source").alias("host"), null.alias("url"))


def identify(train: DataFrame | Models, rows: DataFrame, addresses: bool = True) -> DataFrame:
    """kind, id, language (null for none), probability (of the best language), text_language, declared, host, h (hash of the
    body), has_text, kept of every row. train: documents whose lang names the language of the text model; rows: as_rows() of
    documents or pages, fused with their own tables."""
    models = train if isinstance(train, Models) else Models(train)
    if not models.languages:
        null = F.lit(None).cast("string")
        return rows.select("kind", "id", null.alias("language"), F.lit(0.0).alias("probability"), null.alias("text_language"), "declared", "host", "h", F.lit(False).alias("has_text"), F.lit(False).alias("kept"))
    return fuse(text_evidence(rows, models), models.languages, addresses)


def identified(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    found = identify(docs, as_rows(docs, "document"), False).where(~F.col("kept"))
    return without(docs, found, {"id": F.col("doc_id"), "h": F.xxhash64("text"), "declared": F.col("lang"), "host": F.col("source")})


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages alike; doc_id is null for pages, page_id for documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    models = Models(docs)
    own = lambda name, kind, it: (F.col("id") if kind == it else F.lit(None)).cast("long").alias(name)
    parts = [
        identify(models, as_rows(t, kind), kind == "page").select("kind", own("doc_id", kind, "document"), own("page_id", kind, "page"), "language", F.round("probability", 6).alias("probability"), "text_language", "declared", "kept")
        for t, kind in ((docs, "document"), (pages, "page"))
    ]
    return parts[0].unionByName(parts[1])
