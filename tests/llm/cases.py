"""Rows that every operator over documents has to bear."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("lang", "score", "predicted", "ids", "decoded", "kept", "n_words", "n_removed", "media", "n_bytes", "grams", "bands", "bin", "piece", "component_id")]
)
WORDS = [a + b for a in ("ba", "de", "fi", "go", "lu", "ma", "né", "po") for b in ("ka", "le", "mi", "no", "ru", "ß", "ta", "vö")]


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls, empties, white space, one word, repeats, near copies, a shared passage, a very long text, odd characters."""
    base, shared, long = text(1, 120), text(2, 40), text(3, 30_000)
    near = base.split()
    near[60] = "other"
    texts = [
        (5, base), (3, base), (7, " ".join(near)), (8, text(4, 50) + "\n" + shared + "\t" + text(5, 30)), (9, shared + "  \n" + text(6, 20)),
        (10, ""), (11, None), (12, " \n\t "), (13, "word"), (13, "word"), (14, "word"), (None, base), (None, None), (15, long), (16, "x" * 70_000),
        (17, "naïve café  \x00 zero 日本語 🎉🎉 <|endoftext|> it's 1234  end "), (18, base), (18, text(7, 60)), (19, long),
    ]
    return [(i, t, *["clash"] * (len(SCHEMA) - 2)) for i, t in texts]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
