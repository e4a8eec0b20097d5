"""Corpora: lines, sentence splitting, treebanks and text filters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from wordloom.functions.text import SPACE, ddl, lines_of, trim

OPENING, CLOSING = "「『（(“‘", "」』）)”’"
ALWAYS, BEFORE_SPACE = "。！？", ".!?"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of text files, without empty ones (column line); lines end at a line feed."""
    return spark.read.text(path, lineSep="\n").select(trim(F.col("value")).alias("line")).where(F.col("line") != "")


def table_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, line_no (from 0), line of a text column."""
    return df.select(*keys, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))


@F.arrow_udf(ArrayType(StringType()))
def _split(lines: pa.Array) -> pa.Array:
    return pa.array([None if x is None else sentences_of(x) for x in lines.to_pylist()], pa.list_(pa.string()))


def split_sentences(line: Column) -> Column:
    """Sentences of a line as an array: outside brackets, after 。！？ always and after .!? before white space or the end."""
    return _split(line)


_SPECIAL = re.compile(f"[{OPENING}{CLOSING}{ALWAYS}{BEFORE_SPACE}]")
_BLANKS = " \t\n\x0b\f\r"


def sentences_of(line: str) -> list[str]:
    """split_sentences() of a Python string, linear in its length."""
    out, depth, begin = [], 0, 0
    for m in _SPECIAL.finditer(line):
        c, at = m[0], m.end()
        if c in OPENING:
            depth += 1
        elif c in CLOSING:
            depth = max(depth - 1, 0)
        elif not depth and (c in ALWAYS or at == len(line) or line[at] in _BLANKS):
            out.append(line[begin:at])
            begin = at
    return [x for s in (*out, line[begin:]) if (x := s.strip(_BLANKS))]


def sentence_rows(lines: DataFrame, line: str, *keys: str) -> DataFrame:
    """keys, sentence_no, sentence. The form for long lines: one pass over Arrow batches, linear in a line's length."""
    source = lines.select(*keys, F.col(line).alias("_line"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([sentences_of(x or "") for x in b.column(len(keys)).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], found], names=[*keys, "_found"])

    each = source.mapInArrow(run, ", ".join(x for x in (kept, "_found array<string>") if x))
    return each.select(*keys, F.posexplode("_found").alias("sentence_no", "sentence"))


def conllu(lines: DataFrame, file: str = "file", line_no: str = "line_no", line: str = "line", pos: bool = False, spaced: bool = False) -> DataFrame:
    """Corpus lines (file, sent_no, line) of CoNLL-U lines.

    spaced: tab-separated tokens with a blank token where the text has a space; a multiword range's SpaceAfter holds after
    its last member."""
    rows = lines.select(F.col(file), F.col(line_no).alias("_no"), F.col(line).alias("_line")).where(F.col(line).isNotNull())
    # One shuffle and one sort; then a pass that holds a sentence at a time, however long a file is.
    rows = rows.repartition(file).sortWithinPartitions(file, "_no").select(file, "_line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind = _Sentences(pos, spaced), None
        for b in batches:
            kind = b.column(0).type
            own.add(b.column(0), b.column(1).to_pylist())
            yield own.taken(file, kind)
        own.close()
        if kind is not None:
            yield own.taken(file, kind)

    return rows.mapInArrow(run, f"{ddl(rows.schema[:1])}, sent_no int, line string")


_NUMBER = re.compile(r"[ \t\n\x0b\f\r]*([0-9]+)")


def _number(text: str) -> int:
    """The number that a text begins with, if it is one of 32 bits; else 0."""
    m = _NUMBER.match(text)
    n = int(m[1]) if m else 0
    return n if n < 1 << 31 else 0


class _Sentences:
    """CoNLL-U lines in order, to sentences."""

    def __init__(self, pos: bool, spaced: bool):
        self.pos, self.spaced = pos, spaced
        self.file: str | None = None
        self.seen, self.sent_no = False, 0
        self.begin()
        self.out: tuple[list, list, list] = ([], [], [])

    def begin(self) -> None:
        self.pieces: list[str] = []
        self.range: tuple[int, bool] | None = None
        self.gap = True

    def close(self) -> None:
        """The end of a sentence; one without words has no number."""
        if self.pieces:
            for column, x in zip(self.out, (self.file, self.sent_no, "".join(self.pieces))):
                column.append(x)
            self.sent_no += 1
        self.begin()

    def add(self, files: pa.Array, lines: list[str]) -> None:
        coded = files.dictionary_encode()
        names = coded.dictionary.to_pylist()
        for k, line in zip(coded.indices.to_pylist(), lines):
            name = None if k is None else names[k]
            if name != self.file or not self.seen:
                self.close()
                self.file, self.seen, self.sent_no = name, True, 0
            if not line.strip(_BLANKS):
                self.close()
            elif line[0] != "#":
                self.token(line.split("\t", 10))

    def token(self, f: list[str]) -> None:
        if len(f) < 4:
            return
        id_, gap = f[0], len(f) < 10 or "SpaceAfter=No" not in f[9]
        if "-" in id_:
            self.range = _number(id_.split("-")[1]), gap
        elif "." not in id_ and f[3] != "_":
            before = "" if not self.pieces else " " if not self.spaced else "\t \t" if self.gap else "\t"
            self.pieces.append(before + (f"{f[1]}/{f[3]}" if self.pos else f[1]))
            self.gap = gap
            if self.range and (n := _number(id_)) <= self.range[0]:
                self.gap = n == self.range[0] and self.range[1]

    def taken(self, file: str, kind: pa.DataType) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(self.out, (kind, pa.int32(), pa.string()))], names=[file, "sent_no", "line"])
        self.out = ([], [], [])
        return made


def wiki_filter(lines: DataFrame, line: str = "line", limit: int = 0, seed: int | None = None) -> DataFrame:
    """Lines of extracted wiki text that end a sentence and have 20 characters or more; optionally shuffled and limited."""
    x = F.col(line)
    out = lines.where(~x.startswith("<doc ") & (x != "</doc>") & ~x.rlike(rf"^{SPACE}*$") & x.rlike(r"[。.!?]$") & (F.length(x) >= 20))
    if seed is not None:
        out = out.orderBy(F.rand(seed))
    return out.limit(limit) if limit else out


def sample_texts(pages: DataFrame, text: str, n: int, seed: int, *keys: str, title: str | None = None) -> DataFrame:
    """keys, sentence_no, sentence of n random pages' longest lines: blanks squeezed, ASCII-only lines dropped.

    title: a column of titles; pages of lists, of years or dates and of talk or other inner spaces are left out. Pages are
    drawn by the least hashes of seed and keys, so a draw can be repeated and is one pass with a bounded top n."""
    if title:
        pages = pages.where(~F.coalesce(F.col(title), F.lit("")).rlike(r"^\d+|:|(?i)^list of |一覧$|목록$|列表$"))
    each = table_lines(pages, text, *keys).where(F.col("line").rlike(r"[^\x00-\x7F]"))
    longest = each.groupBy(*keys).agg(F.max_by("line", F.struct(F.length("line"), -F.col("line_no"))).alias("line"))
    drawn = longest.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))), *keys).limit(n)
    return sentence_rows(drawn.select(*keys, F.regexp_replace("line", " +", " ").alias("line")), "line", *keys)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """id and line of text files, lines as they are but for a trailing carriage return; id: the line's number from 0 in the
    order of the files' names and of their lines.

    Spark reads files by size, not by name, and packs parts of several into a task; so parts are counted first, and the
    second pass numbers on from what lies before each part. There is a row a part of a file on the driver."""
    part = [F.col(f"_metadata.{x}").alias(f"_{x}") for x in ("file_path", "file_block_start", "file_block_length")]
    raw = spark.read.text(path, lineSep="\n").select(*part, F.monotonically_increasing_id().alias("_m"), F.regexp_replace("value", r"\r$", "").alias("line"))
    names = ["_file_path", "_file_block_start", "_file_block_length", "_task"]
    raw = raw.withColumn("_task", F.shiftright("_m", 33))
    sizes = raw.groupBy(*names).agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n")).collect()
    before, rows = 0, []
    for r in sorted(sizes, key=lambda r: tuple(r)[:2]):
        rows.append((*tuple(r)[:4], before - r["_first"]))
        before += r["_n"]
    if not rows:
        return raw.select(F.col("_m").alias("id"), "line")
    shifts = F.broadcast(spark.createDataFrame(rows, "_file_path string, _file_block_start long, _file_block_length long, _task long, _shift long"))
    # A part that wasn't counted would mean that the files were cut differently.
    shift = F.when(F.col("_shift").isNull(), F.raise_error(F.lit("a file changed while it was read")).cast("long")).otherwise(F.col("_shift"))
    return raw.join(shifts, names, "left").select((F.col("_m") + shift).alias("id"), "line")
