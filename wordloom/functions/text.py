"""Scalar functions over lines, tokens and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPOS = "ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X".split()
SPACE = r"\p{IsWhite_Space}"
#: The same characters, for Python's strip().
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(line: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(line, rf"^{SPACE}+|{SPACE}+$", "")


def line_of(raw: Column) -> Column:
    """A line without its trailing carriage return."""
    return F.regexp_replace(raw, r"\r$", "")


def lines_of(text: Column) -> Column:
    """Trimmed lines of a text, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")


def chars(line: Column) -> Column:
    """Code points of a line as an array; empty for an empty line."""
    return F.filter(F.split(line, ""), lambda c: c != "")


def tokens(line: Column, tsv: bool = False) -> Column:
    """Non-empty tokens of a corpus line."""
    return F.filter(F.split(line, "\t" if tsv else " "), lambda t: t != "")


def upos(tag: Column) -> Column:
    """The tag itself if it is one of the 17, else X."""
    return F.when(tag.isin(UPOS), tag).otherwise("X")


def tagged_token(token: Column) -> Column:
    """word/POS at the last slash: struct(surface, pos)."""
    has = F.instr(token, "/") > 0
    word = F.when(has, F.regexp_extract(token, r"(?s)^(.*)/[^/]*$", 1)).otherwise(token)
    return F.struct(word.alias("surface"), F.when(has, upos(F.substring_index(token, "/", -1))).otherwise("X").alias("pos"))


def ddl(schema) -> str:
    """A DataFrame's schema as text, for mapInArrow."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def segment_label(boundary: Column, pos: Column) -> Column:
    """B-POS at a boundary, O elsewhere."""
    return F.when(boundary, F.concat(F.lit("B-"), pos)).otherwise("O")


def all_labels() -> list[str]:
    """B with each of the 17 tags, and O."""
    return [*(f"B-{t}" for t in UPOS), "O"]


def is_boundary(label: Column) -> Column:
    return label.startswith("B-")


def label_pos(label: Column) -> Column:
    """POS of a B label; null for O."""
    return F.when(is_boundary(label), F.substring(label, 3, 8))


def is_space(token: Column) -> Column:
    return token.rlike(rf"^{SPACE}+$")


def spans(words: Column) -> Column:
    """array(struct(surface, start, end)) in characters, empty words included."""
    return _offsets(words, F.length)


def byte_spans(words: Column) -> Column:
    """The same in UTF-8 bytes."""
    return _offsets(words, F.octet_length)


def starts_of(words: Column, size=F.length) -> Column:
    """Where each word starts, in units of size; linear in the text's length.

    Every word becomes one mark and a blank for each unit; the k-th mark's place less k is what lies before it."""
    marks = F.flatten(F.transform(words, lambda w: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), size(w)))))
    at = F.filter(F.transform(marks, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
    return F.transform(at, lambda i, k: i - k)


def _offsets(words: Column, size) -> Column:
    return F.zip_with(words, starts_of(words, size), lambda w, at: F.struct(w.alias("surface"), at.alias("start"), (at + size(w)).alias("end")))


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(100.0 * part / F.when(whole == 0, 1).otherwise(whole))


def f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total == 0, 0.0).otherwise(2.0 * precision * recall / F.when(total == 0, 1).otherwise(total))
