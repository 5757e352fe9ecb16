"""Small documents with everything that operators must take: nulls, empty and long texts, ties, repeats, clashes."""

import random
import re

WORDS = [a + b for a in ("ba", "ke", "mi", "so", "tu", "ra", "ze") for b in ("n", "lo", "ria", "st", "dé", "ng", "pp", "")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "", "", ",", ".\n")) for _ in range(n))


def edge_rows() -> list[tuple]:
    passage = prose(99, 60)
    long = prose(7, 30_000)
    rows = [(1, prose(1, 80)), (2, None), (3, ""), (4, "é" * 300), (5, prose(2, 120)), (6, passage + " " + prose(3, 40)),
            (7, prose(4, 30) + " " + passage), (8, long), (9, prose(1, 80)), (9, prose(1, 80)), (None, prose(5, 50)),
            (11, "Don't <|endoftext|> we're '  \n\t x日本\U0001F600 1234"), (12, " "), (None, None), (13, "word"),
            (14, prose(2, 119) + " changed"), (9, "another text of the same id " + passage)]
    return [(i, t, "en", "s", 1, 0.5, "n_tokens") for i, t in rows]


EDGE_SCHEMA = "doc_id long, text string, lang string, source string, kept int, score double, ids string"


def edge_docs(spark):
    """Column names that operators use themselves are there as the rows' own."""
    return spark.createDataFrame(edge_rows(), EDGE_SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


def simple_words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
