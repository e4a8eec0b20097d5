"""Feature templates of boundary decisions and of word tags.

A boundary template is a list of slots over the window of the decision position i: w0..w5 are the characters at
i-3..i+2, c0..c5 their types, p0..p2 the boundary tags at i-3..i-1.
"""

from __future__ import annotations

import re

_SPEC = """
UP1 p0|UP2 p1|UP3 p2|BP1 p0 p1|BP2 p1 p2|UW1 w0|UW2 w1|UW3 w2|UW4 w3|UW5 w4|UW6 w5|BW1 w1 w2|BW2 w2 w3|BW3 w3 w4
UC1 c0|UC2 c1|UC3 c2|UC4 c3|UC5 c4|UC6 c5|BC1 c1 c2|BC2 c2 c3|BC3 c3 c4|TC1 c0 c1 c2|TC2 c1 c2 c3|TC3 c2 c3 c4|TC4 c3 c4 c5
UQ1 p0 c0|UQ2 p1 c1|UQ3 p2 c2|BQ1 p1 c1 c2|BQ2 p1 c2 c3|BQ3 p2 c1 c2|BQ4 p2 c2 c3
TQ1 p1 c0 c1 c2|TQ2 p1 c1 c2 c3|TQ3 p2 c0 c1 c2|TQ4 p2 c1 c2 c3|WC1 w2 c3|WC2 c2 w3|WC3 w2 c2|WC4 w3 c3
"""
#: name -> slots, in emission order.
BOUNDARY: dict[str, tuple[str, ...]] = {p.split()[0]: tuple(p.split()[1:]) for line in _SPEC.split("\n") for p in line.split("|") if p}
TAG_DEPENDENT = tuple(k for k, v in BOUNDARY.items() if any(s[0] == "p" for s in v))
_TAGGED = re.compile(r"(?:UP[123]|BP[12]|UQ[123]|BQ[1-4]|TQ[1-4]):")

BEGIN, END = ("B3", "B2", "B1"), ("E1", "E2", "E3")

#: Word templates in order, and the sets of them.
WORD = "WS WL FC LC ft lt TS L1 L2 L3 R1 R2 R3 cl1 cl2 cl3 cr1 cr2 cr3 LB RB P2 S2".split()
FAST = frozenset("WS WL ft lt L1 R1 cl1 cr1 P2 S2".split())
WORD_SETS = {"fast": FAST, "balanced": FAST | {"FC", "LC", "TS"}, "full": frozenset(WORD)}
WORD_BEGIN, WORD_END, LENGTH_CAP, TYPES_CAP = "\u0001", "\u0002", 4, 8


def boundary_templates(language: str, tag_free: bool = False) -> dict[str, tuple[str, ...]]:
    """Templates of a language: all 42 for Japanese and Chinese, without WC1-4 for Korean and English."""
    return {k: v for k, v in BOUNDARY.items() if (language in ("japanese", "chinese") or not k.startswith("WC")) and not (tag_free and k in TAG_DEPENDENT)}


def is_tag_dependent(feature: str) -> bool:
    return bool(_TAGGED.match(feature))
