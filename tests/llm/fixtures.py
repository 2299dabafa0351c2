"""Small tables with the odd cases: nulls, empties, long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "text string, doc_id long, lang string, key long, cls long, own long, found string, n long, s string"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ba", "de", "fi", "go", "hu", "ji", "ta")]


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows(seed: int = 5) -> list[tuple]:
    """(doc_id, text): a little of everything."""
    r = random.Random(seed)
    passage = sentence(r, 60)
    base = sentence(r, 120)
    near = base.split()
    near[50] = "changed"
    far = base.split()
    for k in range(0, 120, 6):
        far[k] = "other"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, " ".join(far)), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "One"),
        (10, sentence(r, 30) + " " + passage + " " + sentence(r, 30)), (11, sentence(r, 10) + " " + passage), (12, passage.upper()),
        (13, "a" * 700), (14, "a" * 700 + "b"), (15, sentence(r, 6000)), (16, "é" * 90 + " naïve Straße 日本語 " * 12), (17, "naïve Straße 日本語 " * 12),
        (18, base.replace(" ", "\n")), (19, "a b c d"), (20, "A b\u000bc d"), (21, sentence(r, 5)), (None, base), (23, "😀 " * 80), (24, base + " " + sentence(r, 3)),
    ]


def frame(spark, data=None):
    """With columns whose names the operators use inside."""
    data = rows() if data is None else data
    return spark.createDataFrame([(t, i, "en", 1, 2, 3, "x", 4, "y") for i, t in data], SCHEMA)
