"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SYLLABLES = "the er in on an re ti nd st or ed ha en of to it es ou ble ng".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4))) for _ in range(words))


def awkward_texts() -> list[tuple]:
    """(doc_id, text)."""
    base = prose(1, 120)
    rows = [
        (1, base), (2, base), (3, base + " end"), (4, None), (5, ""), (6, " \t\n"), (7, "x"), (8, "one two"), (9, "  two  spaces \n lines\n\n\tand tabs "), (10, "naïve café 漢字 😀 ‍ \u0001\u0002\u0003"),
        (11, prose(2, 30000)), (12, "a" * 5000), (13, base), (14, "<|endoftext|> don't we'll 12345 !!! ..."), (15, "same"), (15, "same"), (16, prose(3, 60)), (17, prose(3, 59) + " zz"),
    ]
    return rows


def docs_frame(spark, rows=None, **extra):
    rows = awkward_texts() if rows is None else rows
    made = [(i, t, "en", f"src{k % 3}", len(t) if t else 0, 1, 2, "h", 0) for k, (i, t) in enumerate(rows)]
    # The last columns clash with names that operators use within.
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, fp long, rep long, hash string, start int")


def empty_frame(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
