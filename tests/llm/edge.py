"""Documents with every awkward case: nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""

import random

CLASHING = ("n_words", "n_tokens", "h", "h1", "word", "words", "copies", "size", "position", "start", "target", "score", "key", "cls", "n", "root", "shingles", "body", "kind", "id", "declared", "host", "label", "part", "text_", "best", "total", "kept")


def texts(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = line(120)
    near = base.split()
    near[7] = "changed"
    return {
        1: base,
        2: " ".join(near),
        3: base.upper(),
        4: line(60) + "\n" + line(60) + " <|endoftext|> " + line(3),
        5: "",
        6: None,
        7: " \t\n ",
        8: line(40_000),
        9: "x" * 300_000,
        10: "one two",
        11: "Two!",
        12: line(30) + " Straße 日本語 \U0001f600   é",
        13: "\n".join(["same line here again"] * 30),
        14: "Released under the MIT License.\n" + line(25) + "\nAll rights reserved.",
    }


def documents(spark, clashing=True):
    rows = [(k, t, "en" if k % 3 else "de", f"src{k % 2}") for k, t in texts().items()]
    rows += [rows[0], rows[0], (None, texts()[1], "en", "src0"), (None, None, None, None), (4, "another text with the same id " * 4, None, None), (30, texts()[4], None, "")]
    schema = "doc_id long, text string, lang string, source string"
    if clashing:
        rows = [(*r, *(f"extra{i}" for i in range(len(CLASHING)))) for r in rows]
        schema += "".join(f", {c} string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, extra int")


def benchmark(spark):
    t = texts()
    rows = [(1, " ".join(t[1].split()[20:60])), (2, "one two"), (3, None), (None, "two"), (4, ""), (5, "never found anywhere at all"), (2, "one two"), (6, t[8][500:900])]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, n_words string")


def labels(spark):
    return spark.createDataFrame([(k, int(k not in (9, 13)), 0) for k in texts()] + [(None, 1, 1), (3, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")
