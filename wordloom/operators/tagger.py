"""Part-of-speech tags of segmented words: lexicon first, then a linear classifier.

Two forms of the same operator. ``segment_with_pos`` segments and tags in one Arrow pass: the classifier's weights are
rows of numpy tables by character, type, pair of characters and surface, so that a batch's scores are a few gathers and a
masked argmax. ``tag_words`` is relational: it tags words that are there already, by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.chartypes import parse_language, type_codes
from wordloom.functions.templates import LENGTH_CAP, TYPES_CAP, WORD, WORD_BEGIN, WORD_END
from wordloom.functions.text import UPOS, ddl
from wordloom.operators.features import MARK, WordTexts
from wordloom.operators.segment import BLOCK, Block, Compiled, masked
from wordloom.sources.models import TwoStageModel

#: Surfaces whose scores a worker remembers.
SURFACES = 1 << 16
#: Context templates: offset from the word's first (L) or last (R) character, by name.
_NEAR = {f"{side}{k}": (side, k) for side in "LR" for k in (1, 2, 3)}


class CompiledTagger:
    """A two-stage model as numpy tables for one language."""

    def __init__(self, model: TwoStageModel, language: str):
        self.language = parse_language(language)
        self.stage1 = Compiled(model.stage1, self.language)
        self.model, self.classes = model, list(model.stage2.classes)
        self.names = sorted({*UPOS, *self.classes})
        self.class_ids = np.array([self.names.index(c) for c in self.classes], np.int64)
        n = len(self.classes)
        by: dict[str, dict[str, np.ndarray]] = {}
        for f, own in model.stage2.weights.items():
            name, colon, value = f.partition(":")
            if colon and name in WORD:
                by.setdefault(name, {})[value] = np.array([own.get(c, 0.0) for c in self.classes])
        self.by = by
        # Characters that context features name; 1 and 2 stand for both ends of a line.
        chars = {c for k, own in by.items() if k in _NEAR or k in ("LB", "RB") for v in own for c in v}
        self.char_id = np.zeros(0x110000 + 6, np.int64)
        self.char_id[0x110000:0x110003], self.char_id[0x110003:] = 1, 2
        ids = {WORD_BEGIN: 1, WORD_END: 2}
        for c in sorted(chars - ids.keys()):
            ids[c] = len(ids) + 1
        for c, i in ids.items():
            self.char_id[ord(c)] = i
        self.n_ids = len(ids) + 1
        codes = self.codes = type_codes(self.language)
        kinds = {c: i for i, c in enumerate(codes)} | {WORD_BEGIN: len(codes), WORD_END: len(codes) + 1}
        self.radix = len(codes)

        def rows(own: dict[str, np.ndarray], index: dict[str, int], size: int) -> np.ndarray:
            out = np.zeros((size, n))
            for v, w in own.items():
                if v in index:
                    out[index[v]] += w
            return out

        self.near = [(*_NEAR[k], rows(by[k], ids, self.n_ids)) for k in _NEAR if k in by]
        self.near_types = [(*_NEAR[k[1:].upper()], rows(by[k], kinds, len(kinds))) for k in WORD if k[0] == "c" and k in by]
        self.pairs = []
        for name, side in (("LB", "L"), ("RB", "R")):
            found = sorted((ids[v[0]] * self.n_ids + ids[v[1]], v) for v in by.get(name, ()) if len(v) == 2)
            if found:
                self.pairs.append((side, np.array([k for k, _ in found], np.int64), np.vstack([np.zeros(n), *(by[name][v] for _, v in found)])))
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.fixed = np.zeros(0, np.int64)
        self.scores = np.zeros((0, len(self.classes)))
        self.options = np.zeros((0, len(self.classes)), bool)

    def _surface(self, word: str) -> tuple[int, np.ndarray, list[bool]]:
        """A surface's certain tag (-1: none), the scores of the templates that it decides alone, and its possible classes."""
        tag = self.model.fixed(word)
        total = np.zeros(len(self.classes))
        candidates = {t for t, _ in self.model.lexicon.get(word, ())} & set(self.classes)
        if tag is None and self.classes:
            kinds = [self.codes[self.stage1.types[ord(c)]] for c in word[:TYPES_CAP]]
            last = self.codes[self.stage1.types[ord(word[-1])]]
            values = {"WS": word, "WL": str(min(len(word), LENGTH_CAP)), "FC": word[0], "LC": word[-1], "ft": kinds[0], "lt": last, "TS": "".join(kinds)}
            if len(word) > 1:
                values |= {"P2": word[:2], "S2": word[-2:]}
            for name in WORD:
                if name in values and (w := self.by.get(name, {}).get(values[name])) is not None:
                    total = total + w
        return -1 if tag is None else self.names.index(tag), total, [not candidates or c in candidates for c in self.classes]

    def _rows_of(self, surfaces: list[str]) -> np.ndarray:
        """Rows of the surfaces in the tables that grow with what is met."""
        new = [w for w in surfaces if w not in self.known]
        if len(self.known) + len(new) > SURFACES and self.known:
            self._reset()
            new = surfaces
        if new:
            made = [self._surface(w) for w in new]
            self.known |= {w: len(self.fixed) + i for i, w in enumerate(new)}
            self.fixed = np.append(self.fixed, [m[0] for m in made])
            self.scores = np.vstack([self.scores, *(m[1] for m in made)])
            self.options = np.vstack([self.options, *(m[2] for m in made)])
        return np.array([self.known[w] for w in surfaces], np.int64)

    def tags(self, block: Block, words: pa.StringArray) -> np.ndarray:
        """Numbers of the words' tags among names."""
        coded = words.dictionary_encode()
        row = self._rows_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        out = self.fixed[row].copy()
        ask = np.flatnonzero(out < 0)
        if not self.classes:
            out[ask] = self.names.index("X")
            return out
        ends = np.append(block.starts[1:], len(block.code))
        line_ends = block.first + block.lengths
        edges = block.edges()
        last = edges[1:][edges[1:] > edges[:-1]] - 1  # each line's last word
        ends[last] = line_ends[edges[1:] > edges[:-1]]
        for at in range(0, len(ask), BLOCK >> 3):
            mine = ask[at : at + (BLOCK >> 3)]
            a, b = block.starts[mine], ends[mine]
            place = lambda side, k: a - k if side == "L" else b + k - 1  # noqa: B023, E731
            total = self.scores[row[mine]]
            for side, k, table in self.near:
                total = total + table[self.char_id[block.code[place(side, k)]]]
            for side, k, table in self.near_types:
                p = place(side, k)
                code = block.code[p]
                total = total + table[np.where(code >= 0x110003, self.radix + 1, np.where(code >= 0x110000, self.radix, block.types[p]))]
            for side, keys, table in self.pairs:
                one, two = (2, 1) if side == "L" else (1, 2)
                key = self.char_id[block.code[place(side, one)]] * self.n_ids + self.char_id[block.code[place(side, two)]]
                found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                total = total + table[np.where(keys[found] == key, found + 1, 0)]
            out[mine] = self.class_ids[np.argmax(np.where(self.options[row[mine]], total, -np.inf), axis=1)]
        return out


def segment_with_pos(df: DataFrame, model: TwoStageModel, language: str, column: str = "line", into: str = "tokens") -> DataFrame:
    """Adds tokens, array(struct(surface, pos)), to lines in one pass; null lines give null."""
    tagger = df.sparkSession.sparkContext.broadcast(CompiledTagger(model, language))
    names = [c for c in df.columns if c != into]
    source = df.select(*(f"`{c}`" for c in names))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + f", `{into}` array<struct<surface:string,pos:string>>"
    at, kind = names.index(column), pa.list_(pa.struct([("surface", pa.string()), ("pos", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tagger.value
        tags = pa.array(own.names)
        for b in batches:
            lines, found = b.column(at).to_pylist(), []
            for block in own.stage1.blocks([x or "" for x in lines]):
                words = block.words()
                found.append(block.lists(pa.StructArray.from_arrays([words, tags.take(pa.array(own.tags(block, words)))], ["surface", "pos"])))
            yield pa.RecordBatch.from_arrays([*b.columns, masked(b.column(at), lines, found, kind)], names=[*names, into])

    return source.mapInArrow(run, schema)


def tag_words(words: DataFrame, model: TwoStageModel, language: str, column: str = "words", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, word_no, surface, pos of lines' words, from the features as they are named; without a shuffle, whatever the
    number of classes. A word has its fixed tag, or the best-scoring of its candidates (of all classes where it has none);
    the first by name of equals; X without classes."""
    used = [k for k in WORD if any(f.startswith(f"{k}:") for f in model.stage2.weights)]
    texts = WordTexts(language, used, skip_white=False)
    shared = words.sparkSession.sparkContext.broadcast((model, texts))
    source = words.select(*keys, F.col(column).alias("_words"))
    head = ddl(source.schema[: len(keys)]) if keys else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, texts = shared.value
        classes, weights = sorted(model.stage2.classes), model.stage2.weights

        def said(word: str, text: str) -> str:
            if (tag := model.fixed(word)) is not None or not classes:
                return tag or "X"
            known = {t for t, _ in model.lexicon.get(word, ())}
            options = [c for c in classes if c in known] or classes
            found = [own for f in text.split(MARK) if (own := weights.get(f))]
            return max(options, key=lambda c: sum(own.get(c, 0.0) for own in found))  # the first of equals

        for b in batches:
            rows, numbers, surfaces, tags = [], [], [], []
            for i, line in enumerate(b.column(len(keys)).to_pylist()):
                number, own, features = texts(line or [], line or [], MARK)
                rows += [i] * len(number)
                numbers += number
                surfaces += own
                tags += map(said, own, features)
            kept = [b.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int32()), pa.array(surfaces, pa.string()), pa.array(tags, pa.string())], names=[*keys, "word_no", "surface", "pos"])

    return source.mapInArrow(run, ", ".join(x for x in (head, "word_no int, surface string, pos string") if x))


def joined_tags(tokens: str = "tokens"):
    """word/POS joined by blanks."""
    return F.array_join(F.transform(tokens, lambda t: F.concat_ws("/", t["surface"], t["pos"])), " ")
