"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random
import re

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None, pattern: str = ALNUM) -> list[str]:
    return re.findall(pattern, lower(text))


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(spark, more=()):
    """documents with every odd case; extra columns are named like outputs."""
    rows = [
        (1, None, "en", None, None),
        (2, "", None, "s", 0),
        (None, "no id here 10.0.0.1", "en", "s", 5),
        (3, "   \n\t ", "en", "s", 6),
        (4, prose(1, 3000), "en", "s", 1),
        (5, "same words in these two rows", "en", "s", 1),
        (5, "same words in these two rows", "en", "s", 1),
        (6, "SAME words in these two rows", "en", "s", 1),
        (7, "!!! --- ???", "de", "s", 1),
        (8, "x" * 20000, "en", "s", 1),
        *more,
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'a' AS score", "1 AS key", "2 AS n", "'b' AS rows", "3 AS keep")
