"""Small models and corpora that the queries use. Weights are whole numbers, so that sums are exact in any order."""

from wordloom.sources.models import PerceptronModel, StumpModel, TwoStageModel


def model(bias: int, **by_template: dict[str, int]) -> StumpModel:
    weights = {f"{k}:{v}": float(w) for k, own in by_template.items() for v, w in own.items()}
    return StumpModel({"": -2.0 * bias - sum(weights.values()), **weights})


#: English, pointwise: breaks at white space, before punctuation and between kinds of characters.
POINTWISE = model(
    -2,
    UC3={"W": 6, "P": 2},
    UC4={"W": 6, "P": 5, "U": 1},
    BC2={"AA": -4, "UA": -5, "NN": -5, "UU": -2, "AO": -4, "OA": -4, "OO": -4, "UO": -4, "PP": -2},
    TC2={"NPN": -9, "AQA": 2},
    TC3={"NPN": -9},
    UW4={"'": 3, "-": 1},
    UW3={"-": 1},
    BW2={"th": -1, "n'": -2},
    BW1={"B1e": 1},
    UW6={"E2": 1},
)
#: English, with tag features: words of at least two letters.
TAGGED = model(
    0,
    UC3={"W": 6},
    UC4={"W": 6, "P": 4},
    UW4={"e": -1, "t": 1},
    BW2={"an": 2, "er": -1},
    UP3={"B": -5, "O": 1},
    UP1={"U": -1, "B": 2},
    BP2={"OO": 2, "BO": -1, "UU": -2},
    UQ3={"BW": 3, "OA": -1},
    BQ2={"OAA": -1},
    TQ4={"OAAA": 1, "BAAA": -1},
)
#: Japanese, pointwise, with mixed templates and sentinels.
JAPANESE = model(-1, UW3={"は": 3, "B1": 1}, UW6={"E1": 2}, UC4={"H": 2, "I": 1}, BC2={"II": -2, "KK": -3, "HH": -1}, TC1={"OOI": 1}, BW3={"スト": 2}, WC1={"はK": 3, "aA": -1}, WC2={"Iで": 2, "AＡ": 1}, WC3={"。P": 4}, WC4={"漢H": 2, "éO": -2})
LEXICON = {"red": [("NOUN", 1), ("ADJ", 3)], "blue": [("ADJ", 4)], " ": [("X", 9)], "small": [("ADJ", 99), ("NOUN", 1)], "steel": [("NOUN", 2), ("VERB", 1)], "brass": [("INTJ", 1), ("SYM", 1)]}
CLASSIFIER = PerceptronModel(
    ["ADJ", "NOUN", "PROPN", "VERB"],
    {
        "WS:red": {"ADJ": 1.0, "NOUN": 3.0},
        "WL:4": {"NOUN": 2.0, "VERB": 1.0},
        "WL:3": {"ADJ": 1.0},
        "ft:A": {"NOUN": 1.0},
        "ft:N": {"PROPN": 5.0},
        "lt:N": {"PROPN": 2.0},
        "L1:\u0001": {"VERB": 2.0},
        "cr1:\u0002": {"VERB": 1.0, "NOUN": 1.0},
        "S2:er": {"VERB": 3.0},
        "P2:st": {"VERB": 2.0},
        "TS:AAAAA": {"ADJ": 1.0},
        "RB: b": {"ADJ": 2.0},
        "cl1:W": {"NOUN": 1.0},
    },
)
TWO_STAGE = TwoStageModel(POINTWISE, LEXICON, CLASSIFIER, 0.9)
CJK = "これはテスト３です。漢字々ヵー一二ABCｚ㐂的了ㄅ⺀은는가각한글ᄀㄱéß😀'’“–@ \u00a0\tＡ"
TAGGED_CORPUS = [
    "これ/PRON は/PART テスト/NOUN です/AUX 。/PUNCT",
    "これ/PRON も/PART テスト/NOUN 。/PUNCT",
    "a//SYM //PUNCT plain は/ADP /NOUN x/NOPE",
    "  the/DET red/ADJ red/NOUN red/ADJ  ",
    "",
]
TSV_CORPUS = ["나는\t \t봄\t.", "나는\t\t봄", "I\t \tdo\tn't\t \tknow\t."]
CONLLU = """# text = I don't know.
1\tI\tI\tPRON\t_\t_\t_\t_\t_\t_
2-3\tdon't\t_\t_\t_\t_\t_\t_\t_\t_
2\tdo\tdo\tAUX\t_\t_\t_\t_\t_\t_
3\tn't\tnot\tPART\t_\t_\t_\t_\t_\t_
3.1\tx\tx\tX\t_\t_\t_\t_\t_\t_
4\tknow\tknow\tVERB\t_\t_\t_\t_\t_\tSpaceAfter=No
5\t.\t.\tPUNCT\t_\t_\t_\t_\t_\t_

1\tYes\tyes\tINTJ\t_\t_\t_\t_\t_\tSpaceAfter=No
2\t!\t!\tPUNCT\t_\t_\t_\t_\t_\t_
3\t_\t_\t_\t_\t_\t_\t_\t_\t_
""".split("\n")
