"""Small frames with the awkward rows that every operator must handle."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, piece string"


def rows(texts, sources=("a", "b", None)):
    """Documents with extra columns whose names operators use themselves."""
    return [
        (i, t, "xx", sources[i % len(sources)], None if t is None else len(t), 7, "mine")
        for i, t in enumerate(texts)
    ]


def prose(seed, n):
    words = "ka lo mi ne ru so ti vu".split()
    pick = random.Random(seed)
    return " ".join(pick.choice(words) + pick.choice(words) for _ in range(n))


AWKWARD = [
    None, "", " \t\n\x0b", "one", "two words", prose(1, 200), prose(1, 200), prose(2, 30),
    "Ärger über Öl\nzeile\nzeile\n" + prose(3, 40), "x" * 5000, "a.b@c.de " * 400, prose(4, 30_000),
    "mixed\u0085case   blank wide 漢字 and more words to see",
]


def awkward(spark):
    """All awkward texts, one row twice, and rows without id or without anything."""
    made = rows(AWKWARD)
    return spark.createDataFrame(
        [*made, made[5], (None, prose(2, 30), None, None, None, None, None), (None,) * 7], DOCS
    )


def empty(spark):
    return spark.createDataFrame([], DOCS)
