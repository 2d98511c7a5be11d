"""Documents with nulls, empty and long texts, ties, repeated rows and extra columns of clashing names."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, rid string, row string, size string, "
          "fp string, digest string, shard string, place string, h string, spans string, _metadata string")


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "!"]) for _ in range(n))


def rows():
    near = prose(1, 300)
    extra = ("x",) * 10
    out = [(1, near, "en", "a", 5), (2, near, "en", "b", 5), (3, near.replace(" ", "\n\t", 3), "en", "a", 5),
           (4, near + " tail", "en", None, 5), (5, None, None, None, None), (6, "", "en", "a", 0), (7, " \n\t ", "en", "b", 4),
           (8, "one", "en", "c", 3), (9, "Zwei Wörter.", "de", "c", 12), (10, prose(2, 60_000), "en", "c", 7),
           (11, "x" * 300_000, "en", "a", 1), (None, prose(3, 50), "en", "a", 1), (None, None, None, "b", None),
           (12, prose(4, 80), "en", "b", 1), (12, prose(4, 80), "en", "b", 1), (12, prose(5, 80), "en", "b", 1),
           (13, "Привет мир \U0001F600 é İ\x00 <|endoftext|>    end", "en", "b", 1),
           (14, "1234 5678 !!", None, "é", 1), (-3, prose(6, 90), "en", "a", 1)]
    return [r + extra for r in out]


def frame(spark, parts=3):
    return spark.createDataFrame(rows(), SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    """Sorts rows that hold nulls."""
    return tuple((v is None, v) for v in x)
