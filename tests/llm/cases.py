"""A small table with every awkward case, and brute-force answers to hold the operators against."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("an", "be", "co", "du", "éa", "fi", "gra", "ho") for b in ("ne", "ll", "rt", "so", "ü", "x")]
PASSAGE = " ".join(f"word{i}" for i in range(60))


def texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base = prose(120)
    edited = base.split()
    edited[7] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "two words"), (5, base), (6, base), (7, base.upper()), (8, " ".join(edited)), (9, base + " " + prose(200)),
        (10, prose(40) + " " + PASSAGE + " " + prose(30)), (11, PASSAGE), (12, prose(15) + " " + PASSAGE), (13, prose(20_000)), (14, "x" * 50_000), (15, "1 " * 3000),
        (16, "write to anna.b@example.org or +49 (30) 123-45678, host 10.0.255.1 not 10.0.256.1, card 4539 1488 0343 6467"), (17, "日本語 テキスト 🎉 áb é <|endoftext|> it's 3.14"),
        (18, base), (18, base), (19, "same id"), (19, "other text of the same id"), (None, base), (None, None), (20, "."), (21, "a@b.c%d@e.f x@y 1.2.3.4.5.6.7.8 +1-2 00012345678901234567"),
    ]
    return rows + [(100 + i, prose(r.randint(1, 90))) for i in range(60)]


def frame(spark, rows=None, clash: tuple[str, ...] = ()):
    rows = texts() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"extra {c}") for c in clash})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


#: names that operators use inside
CLASH = ("n", "x", "y", "doc", "mark", "a", "start", "kind", "base", "spans", "n_words", "items", "media", "sig", "component", "tokens", "row", "node", "value")
