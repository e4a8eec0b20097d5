"""Character types of the four languages, as data: Python, Column, SQL and numpy forms come from one rule table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.errors import Unsupported

LANGUAGES = ("japanese", "chinese", "korean", "english")
ALIASES = {"ja": "japanese", "zh": "chinese", "ko": "korean", "en": "english"}

#: Rules that every language ends with.
SHARED = (
    ("P", "3000-303F FF01-FF0F FF1A-FF20 FF3B-FF40 FF5B-FF65"),
    ("A", "61-7A 41-5A FF41-FF5A FF21-FF3A"),
    ("N", "30-39 FF10-FF19"),
)


def _each(chars: str) -> str:
    return " ".join(f"{ord(c):X}" for c in chars)


#: language -> (codes in id order, rules before the shared ones). A rule is (code, ranges); the first that fits counts.
RULES: dict[str, tuple[str, tuple[tuple[str, str], ...]]] = {
    "japanese": ("O P A N M H I K", (("M", _each("一二三四五六七八九十百千万億兆")), ("H", "4E00-9FFF " + _each("々〆ヵヶ")), ("I", "3041-3093"), ("K", "30A1-30F4 FF71-FF9D " + _each("ーﾞﾟ")))),
    "chinese": ("O P A N F C X R B", (("F", _each("的地得了着过吗呢吧啊嘛和与或但而且及在从到把被对向给是有不也都就要会能可")), ("C", "4E00-9FFF"), ("X", "3400-4DBF"), ("R", "2E80-2FDF"), ("B", "3100-312F 31A0-31BF"))),
    "korean": ("O P A N E SN SF J G H", (("E", _each("은는을를의에")), ("SN", "AC00-D7AF/28"), ("SF", "AC00-D7AF"), ("J", "1100-11FF"), ("G", "3130-318F"), ("H", "4E00-9FFF"))),
    "english": ("O P A N U W Q", (("U", "41-5A FF21-FF3A"), ("W", "20 9 A0"), ("Q", "27 2019"), ("P", "21-26 28-2F 3A-40 5B-60 7B-7E 2010-2018 201A-2027"))),
}


def parse_language(name: str) -> str:
    """A language by name or two-letter code, in any case."""
    key = name.lower()
    found = ALIASES.get(key, key)
    if found not in RULES:
        raise Unsupported(f"unknown language {name!r}; known: {', '.join(LANGUAGES)}")
    return found


def type_codes(language: str) -> tuple[str, ...]:
    """Codes in id order."""
    return tuple(RULES[parse_language(language)][0].split())


def rules(language: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(code, [(first, last, step)]) in order; step 28 takes every 28th code point of a range."""
    out = []
    for code, text in (*RULES[parse_language(language)][1], *SHARED):
        ranges = []
        for part in text.split():
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            ranges.append((int(a, 16), int(b or a, 16), int(step or 1)))
        out.append((code, ranges))
    return out


def char_type_of(char: str, language: str) -> str:
    c = ord(char)
    return next((code for code, ranges in rules(language) if any(a <= c <= b and (c - a) % s == 0 for a, b, s in ranges)), "O")


def _condition(c: Column, ranges: list[tuple[int, int, int]]) -> Column:
    single = [a for a, b, _ in ranges if a == b]
    tests = [c.isin(single)] if single else []
    for a, b, s in ranges:
        if a < b:
            test = c.between(a, b)
            tests.append(test & ((c - a) % s == 0) if s > 1 else test)
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def char_type(char: Column | str, language: str) -> Column:
    """Type code of a one-character column."""
    c = F.ascii(char)
    chain = None
    for code, ranges in rules(language):
        chain = F.when(_condition(c, ranges), code) if chain is None else chain.when(_condition(c, ranges), code)
    return chain.otherwise("O")


def char_type_sql(char: str, language: str) -> str:
    """The same as a SQL expression (unicode() gives the code point)."""
    c = f"unicode({char})"
    arms = []
    for code, ranges in rules(language):
        tests = [f"{c} = {a}" if a == b else f"{c} BETWEEN {a} AND {b}" + (f" AND ({c} - {a}) % {s} = 0" if s > 1 else "") for a, b, s in ranges]
        arms.append(f"WHEN {' OR '.join(f'({t})' for t in tests)} THEN '{code}'")
    return f"CASE {' '.join(arms)} ELSE 'O' END"


def type_table(language: str, sentinels: int = 6) -> np.ndarray:
    """Type id of every code point, and of the sentinels beyond them (O)."""
    ids = {code: i for i, code in enumerate(type_codes(language))}
    table = np.zeros(0x110000 + sentinels, np.uint8)
    for code, ranges in reversed(rules(language)):
        for a, b, s in ranges:
            table[a : b + 1 : s] = ids[code]
    return table
