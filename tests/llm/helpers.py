"""Small tables with every awkward row, and brute-force versions to hold the operators against."""

from __future__ import annotations

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def awkward(spark, more=()):
    """Nulls in any column, empty and long texts, ties, repeated rows and ids."""
    rng = random.Random(7)
    base = prose(rng, 120)
    texts = [
        None, "", " \n\t", "one", base, base, base.replace("w1 ", "x1 ", 1), base.upper(),
        "\n".join(prose(rng, 9) for _ in range(12)), prose(rng, 6000), "ä ß É 日本 \x00 <|im_end|>", *more,
    ]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}", 0) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, base, None, None, None)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(docs):
    """Extra columns with names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["id", "fp", "key", "data", "hash", "word", "_text", "_row", "_lines", "_stats", "component", "item", "words"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
