"""Feature extraction from gold corpora, the lexicon, and word features.

Tokens, boundary features and word features are made in passes over Arrow batches, linear in a line's length and bounded
in memory: a position's or word's features are one text that is put together from parts that are remembered.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.chartypes import parse_language, type_codes, type_table
from wordloom.functions.templates import BEGIN, BOUNDARY, END, LENGTH_CAP, TYPES_CAP, WORD, WORD_BEGIN, WORD_END, WORD_SETS, boundary_templates
from wordloom.functions.text import UPOS, WHITE, ddl

#: Between features while they are one text: no line of a table can hold it.
MARK = "\udfff"
#: Parts that a worker remembers, and rows of features in a batch.
PARTS, ROWS = 1 << 17, 4096
_TOKENS = pa.list_(pa.struct([("surface", pa.string()), ("pos", pa.string())]))


def gold_tokens(lines: DataFrame, tsv: bool = False, pos: bool = False, line: str = "line") -> DataFrame:
    """Adds tokens, array(struct(surface, pos)), to corpus lines; empty lines and empty words are dropped. Without pos every
    tag is null."""
    names = [c for c in lines.columns if c != "tokens"]
    source = lines.select(*(f"`{c}`" for c in names)).where(F.col(line).isNotNull())
    at, sep, tags = names.index(line), "\t" if tsv else " ", frozenset(UPOS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, trimmed, ends, surfaces, said = [], [], [0], [], []
            for i, text in enumerate(b.column(at).to_pylist()):
                text = text.strip(WHITE)
                before = len(surfaces)
                for t in text.split(sep):
                    if not pos:
                        if t:
                            surfaces.append(t)
                        continue
                    word, slash, tag = t.rpartition("/")
                    if not slash:
                        word, tag = tag, "X"
                    if word:
                        surfaces.append(word)
                        said.append(tag if tag in tags else "X")
                if len(surfaces) > before:
                    kept.append(i)
                    trimmed.append(text)
                    ends.append(len(surfaces))
            own = b.take(pa.array(kept, pa.int64())) if len(kept) < len(b) else b
            tokens = pa.StructArray.from_arrays([pa.array(surfaces, pa.string()), pa.array(said, pa.string()) if pos else pa.nulls(len(surfaces), pa.string())], ["surface", "pos"])
            columns = [*own.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)]
            columns[at] = pa.array(trimmed, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "tokens"])

    return source.mapInArrow(run, ddl(source.schema) + ", tokens array<struct<surface:string,pos:string>>")


def row_lists(column: pa.ListArray) -> tuple[list[int], pa.Array]:
    """Where each row's elements begin and end, and all elements; a null row has none."""
    return np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]).tolist(), column.flatten()


def _digests(texts: list[str]) -> int:
    """The sum of the first 32 bits of the texts' MD5."""
    found = np.frombuffer(b"".join([md5(x.encode(), usedforsecurity=False).digest() for x in texts]), ">u4")
    return int(found[::4].sum(dtype=np.int64))


def _feature_rows(source: DataFrame, keys: tuple[str, ...], place: str, extra: str, kinds: list[pa.DataType], of_line) -> DataFrame:
    """Rows of keys, place, extra columns and features of (keys, tokens) rows. of_line(words, tags, joined) gives a line's
    places, extra values and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, place, *(x.split()[0] for x in extra.split(", ")), "features"]

        def made(b, rows, columns, texts) -> pa.RecordBatch:
            parts = [x.split(MARK) for x in texts]
            features = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), pa.array([f for x in parts for f in x], pa.string()))
            own = [b.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, [pa.int32(), *kinds])), features], names=names)

        for b in batches:
            ends, tokens = row_lists(b.column(len(keys)))
            words, tags = (tokens.field(k).to_pylist() for k in range(2))
            rows, columns, texts = [], [[] for _ in range(len(kinds) + 1)], []
            for i, (begin, end) in enumerate(zip(ends, ends[1:])):
                *found, said = of_line(words[begin:end], tags[begin:end], MARK)
                for at in range(0, len(said), ROWS):  # a long line is several batches
                    rows += [i] * len(said[at : at + ROWS])
                    for c, x in zip(columns, found):
                        c += x[at : at + ROWS]
                    texts += said[at : at + ROWS]
                    if len(texts) >= ROWS:
                        yield made(b, rows, columns, texts)
                        rows, columns, texts = [], [[] for _ in columns], []
            if texts:
                yield made(b, rows, columns, texts)

    rows = source.select(*keys, "tokens")
    head = ddl(rows.schema[: len(keys)] if keys else [])
    return rows.mapInArrow(run, ", ".join(x for x in (head, f"{place} int", extra, "features array<string>") if x))


def _line_digests(source: DataFrame, keys: tuple[str, ...], label, of_line) -> DataFrame:
    """keys, n, digest: how many instances a line has, and the sum of 32 bits of the MD5 of each one's "place|label|features
    joined by tabs". No instance leaves its worker; rows of equal keys are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, tokens = row_lists(b.column(len(keys)))
            words, tags = (tokens.field(k).to_pylist() for k in range(2))
            kept, counts, sums = [], [], []
            for i, (begin, end) in enumerate(zip(ends, ends[1:])):
                places, *found, texts = of_line(words[begin:end], tags[begin:end], "\t")
                if texts:
                    kept.append(i)
                    counts.append(len(texts))
                    sums.append(_digests([f"{p}|{x}" for p, x in zip(places, label(found, texts))]))
            own = [b.column(k).take(pa.array(kept, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=[*keys, "n", "digest"])

    rows = source.select(*keys, "tokens")
    each = rows.mapInArrow(run, f"{ddl(rows.schema[: len(keys)])}, n long, digest long")
    return each.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"))


class _BoundaryTexts:
    """Features of a sentence's decision positions as one text each.

    Names of templates are of one length and each has one value, so the sorted set is the templates in the order of their
    names. All that types and tags decide is a format, of which there are few; the characters are filled in."""

    def __init__(self, language: str, tag_free: bool, include_first: bool):
        self.language = parse_language(language)
        self.templates = sorted(boundary_templates(self.language, tag_free))
        self.characters = [int(slot[1]) for k in self.templates for slot in BOUNDARY[k] if slot[0] == "w"]
        self.codes, self.types = type_codes(self.language), type_table(self.language)
        self.tag_free, self.first = tag_free, 0 if include_first else 1
        self.formats: dict[tuple[str, int], str] = {}

    def _format(self, key: tuple[str, int]) -> str:
        mark, k = key
        k, tags = divmod(k, 27)
        at = {f"p{j}": "UBO"[tags // 3 ** (2 - j) % 3] for j in range(3)}
        at |= {f"c{j}": self.codes[k // len(self.codes) ** (5 - j) % len(self.codes)] for j in range(6)}
        return mark.join(f"{name}:" + "".join("%s" if slot[0] == "w" else at[slot] for slot in BOUNDARY[name]) for name in self.templates)

    def __call__(self, words: list[str], tags: list[str | None], mark: str) -> tuple[list, list, list, list[str]]:
        text = "".join(words)
        n, first = len(text), self.first
        if n <= first:
            return [], [], [], []
        sizes = np.array([len(w) for w in words], np.int64)
        begins = (np.cumsum(sizes) - sizes)[sizes > 0]
        start = np.zeros(n, bool)
        start[begins] = True
        kinds = np.zeros(n + 6, np.int64)
        kinds[3:-3] = self.types[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        key = np.zeros(n, np.int64)
        for k in range(6):
            key = key * len(self.codes) + kinds[k : n + k]
        history = np.zeros(n + 3, np.int64)
        if not self.tag_free:
            history[3:] = np.where(start, 1, 2)
            history[3] = 0
        for k in range(3):
            key = key * 3 + history[k : n + k]
        if len(self.formats) > PARTS:
            self.formats.clear()
        own, found = self.formats, []
        for k in key[first:].tolist():
            f = own.get((mark, k))
            if f is None:
                f = own[mark, k] = self._format((mark, k))
            found.append(f)
        padded = [*BEGIN, *text, *END]
        texts = [f % chars for f, chars in zip(found, zip(*(padded[first + k : n + k] for k in self.characters)))]
        said: list[str | None] = [None] * n
        for at, tag in zip(begins.tolist(), (t for t, size in zip(tags, sizes.tolist()) if size)):
            said[at] = tag
        return list(range(first, n)), start[first:].tolist(), said[first:], texts


def boundary_features(gold: DataFrame, language: str, tag_free: bool = False, include_first: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, pos, start, tag (of a start), features (sorted set) of every decision position of gold sentences."""
    return _feature_rows(gold, keys, "pos", "start boolean, tag string", [pa.bool_(), pa.string()], _BoundaryTexts(language, tag_free, include_first))


def boundary_digests(gold: DataFrame, language: str, labels: tuple[str, str], tag_free: bool = False, include_first: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, digest of the same instances; labels: of a start and of other positions."""
    label = lambda found, texts: [f"{labels[0] if start else labels[1]}|{x}" for start, x in zip(found[0], texts)]
    return _line_digests(gold, keys, label, _BoundaryTexts(language, tag_free, include_first))


def extract(lines: DataFrame, language: str, tsv: bool = False, tag_free: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Boundary instances of a corpus: keys, pos, label (1 or -1), features."""
    rows = boundary_features(gold_tokens(lines, tsv), language, tag_free, False, keys)
    return rows.select(*keys, "pos", F.when(F.col("start"), 1).otherwise(-1).alias("label"), "features")


def extract_stage1(lines: DataFrame, language: str, tsv: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Boundary instances with labels B and O, first characters included, of a tagged corpus."""
    rows = boundary_features(gold_tokens(lines, tsv, True), language, False, True, keys)
    return rows.select(*keys, "pos", F.when(F.col("start"), "B").otherwise("O").alias("label"), "features")


def extract_labels(lines: DataFrame, language: str, tsv: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same with labels B-POS and O."""
    rows = boundary_features(gold_tokens(lines, tsv, True), language, False, True, keys)
    return rows.select(*keys, "pos", F.when(F.col("start"), F.concat(F.lit("B-"), "tag")).otherwise("O").alias("label"), "features")


def lexicon(gold: DataFrame) -> DataFrame:
    """(surface, tags): tags by count, then name, from tagged gold tokens."""
    each = gold.select(F.explode("tokens").alias("t")).select("t.surface", "t.pos")
    counts = each.groupBy("surface", "pos").agg(F.count(F.lit(1)).cast("int").alias("n"))
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("pos").alias("tag")))), lambda x: F.struct(x["tag"].alias("tag"), (-x["m"]).alias("count")))
    return counts.groupBy("surface").agg(order.alias("tags"))  # at most the 17 tags a surface


def lexicon_lines(lex: DataFrame) -> DataFrame:
    tags = F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["tag"], t["count"].cast("string"))), ",")
    return lex.orderBy("surface").select(F.concat_ws("\t", "surface", tags).alias("line"))


class WordTexts:
    """Features of a line's words as one text each; templates: names, in the order of WORD. Empty words have none, and where
    skip_white, white-space words."""

    def __init__(self, language: str, templates: list[str], skip_white: bool = True):
        self.language, self.skip_white = parse_language(language), skip_white
        self.codes, self.types = type_codes(self.language), type_table(self.language)
        near = [k for k in WORD if k in templates and (k[-2:-1].upper() in ("L", "R") and k[-1].isdigit() or k in ("LB", "RB"))]
        own = [k for k in templates if k not in near]
        self.head, self.tail = [k for k in own if k not in ("P2", "S2")], [k for k in own if k in ("P2", "S2")]
        self.near, self.places = near, []
        for k in near:  # (type?, from the word's end?, offset in the padded line) of the format's places
            if k in ("LB", "RB"):
                self.places += [(False, False, 1), (False, False, 2)] if k == "LB" else [(False, True, 3), (False, True, 4)]
            else:
                self.places.append((k[0] == "c", k[-2].upper() == "R", 3 - int(k[-1]) if k[-2].upper() == "L" else 2 + int(k[-1])))
        self.typed = any(typed for typed, _, _ in self.places)
        self.parts: dict[str, dict[str, tuple[str, str] | None]] = {}
        self.kinds: dict[str, str] = {}

    def _kind(self, char: str) -> str:
        found = self.kinds.get(char)
        if found is None:
            found = self.kinds[char] = self.codes[self.types[ord(char)]]
        return found

    def _kinds(self, text: str):
        """The look-up of a text's characters' types."""
        for c in set(text) - self.kinds.keys():
            self._kind(c)
        return self.kinds.__getitem__

    def _parts(self, mark: str, word: str) -> tuple[str, str] | None:
        """What the word alone decides: features before those of its neighbourhood, and after them; None without any."""
        if not word or self.skip_white and not word.strip(WHITE):
            return None
        kinds = [self._kind(c) for c in word[:TYPES_CAP]]
        value = {"WS": word, "WL": str(min(len(word), LENGTH_CAP)), "FC": word[0], "LC": word[-1], "ft": kinds[0], "lt": self._kind(word[-1]), "TS": "".join(kinds), "P2": word[:2], "S2": word[-2:]}
        head, tail = [f"{k}:{value[k]}" for k in self.head], [f"{k}:{value[k]}" for k in self.tail if len(word) > 1]
        if not self.near:
            return mark.join(head + tail), ""
        return "".join(x + mark for x in head), "".join(mark + x for x in tail)

    def __call__(self, words: list[str], tags: list[str | None], mark: str) -> tuple[list, list, list[str]]:
        text = "".join(words)
        parts = self.parts.setdefault(mark, {})
        if len(parts) > PARTS:
            parts.clear()
        number, begins, ends, own, at = [], [], [], [], 0
        for i, w in enumerate(words):
            p = parts.get(w, 0)
            if p == 0:
                p = parts[w] = self._parts(mark, w)
            begin = at
            at += len(w)
            if p is not None:
                number.append(i)
                begins.append(begin)
                ends.append(at)
                own.append(p)
        said = tags if len(number) == len(words) else [tags[i] for i in number]
        if not self.near:
            return number, said, [head for head, _ in own]
        row = WORD_BEGIN * 3 + text + WORD_END * 3
        # Both ends are kinds of their own.
        kinds = [WORD_BEGIN] * 3 + list(map(self._kinds(text), text)) + [WORD_END] * 3 if self.typed else []
        form = mark.join(f"{k}:" + ("%s%s" if k in ("LB", "RB") else "%s") for k in self.near)
        columns = []
        for typed, end, offset in self.places:
            of = kinds if typed else row
            columns.append([of[a + offset] for a in (ends if end else begins)])
        return number, said, [f"{head}{form % x}{tail}" for (head, tail), x in zip(own, zip(*columns))]


def _word_texts(language: str, features: str) -> WordTexts:
    return WordTexts(language, [k for k in WORD if k in WORD_SETS[features]])


def extract_stage2(gold: DataFrame, language: str, features: str = "fast", keys: tuple[str, ...] = ()) -> DataFrame:
    """Word instances of tagged gold tokens: keys, word_no, label (tag), features. White-space words have none."""
    return _feature_rows(gold, keys, "word_no", "label string", [pa.string()], _word_texts(language, features))


def word_digests(gold: DataFrame, language: str, features: str = "fast", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, digest of the same instances."""
    label = lambda found, texts: [x if tag is None else f"{tag}|{x}" for tag, x in zip(found[0], texts)]
    return _line_digests(gold, keys, label, _word_texts(language, features))


def feature_counts(instances: DataFrame) -> DataFrame:
    """The feature vocabulary: (feature, occurrences, instances)."""
    each = instances.select(F.explode("features").alias("feature"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    once = instances.select(F.explode(F.array_distinct("features")).alias("feature"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return each.union(once).groupBy("feature").agg(F.sum("o").alias("occurrences"), F.sum("i").alias("instances"))


def feature_lines(rows: DataFrame) -> DataFrame:
    """label<TAB>feature... lines."""
    return rows.select(F.concat_ws("\t", F.col("label").cast("string"), F.array_join("features", "\t")).alias("line"))


def read_feature_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """(label, features) of feature lines; empty features are dropped."""
    parts = F.split(F.col(line), "\t")
    return lines.where(F.col(line) != "").select(F.get(parts, 0).alias("label"), F.filter(F.slice(parts, 2, 1 << 30), lambda x: x != "").alias("features"))
