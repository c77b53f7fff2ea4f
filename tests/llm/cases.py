"""Awkward rows that every operator must take, and brute-force helpers."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    syllables = "tha ion er re in ou be éa schö ción".split()
    words = ["".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(n)]
    return " ".join(w + r.choice(["", "", "", ".", ",", ".\n"]) for w in words)


def awkward():
    """Nulls, empties, one very long text, exact and near copies, ties, odd white space."""
    base = prose(1, 120)
    texts = [
        None, "", " \n\t ", "one", "one two", base, base, base.replace("tha", "the", 1), prose(2, 30_000), "De " * 500,
        "a\x0bb\x0cc\x1cd\xa0e\x85f", "x" * 5000, "日本語 テキスト 😀 ok", "A b! " * 40, base + " " + prose(3, 50), prose(4, 25) + "\n" + base,
        "<|endoftext|> in <|startoftext|> text",
    ]
    return [(10 * k, t, None if k % 5 == 0 else "en", "src", None if t is None else len(t)) for k, t in enumerate(texts)]


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")
