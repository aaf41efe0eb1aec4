"""Small tables with the cases that every operator has to stand."""

from pyspark.sql import types as T

CLASHING = ("id", "body", "row", "rank", "key", "lang_pred", "print0", "a.b")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        *[T.StructField(name, T.StringType()) for name in CLASHING],
    ]
)
PROSE = (
    "The committee met in the old town hall and spoke at length about the river. Nobody wrote down "
    "what the farmers said on that evening. The bridge was to be rebuilt before the winter storms came."
)


def documents(spark, rows):
    """Rows of (doc_id, text, lang) or shorter; further columns carry names that operators use."""
    full = [(*row, *[None] * (3 - len(row)), *CLASHING) for row in rows]
    return spark.createDataFrame(full, SCHEMA)


def hard_rows():
    """Nulls, empty and blank texts, repeated rows, a long text, and letters beyond Latin."""
    long = " ".join(f"word{k % 977} number {k}." for k in range(20_000))
    return [
        (1, PROSE, "en"),
        (1, PROSE, "en"),
        (2, None, None),
        (3, "", "en"),
        (4, " \n\t ", None),
        (None, PROSE, "en"),
        (None, None, None),
        (5, long, "en"),
        (6, "日本語の文章です。 Ёлка — ελληνικά 🙂 <|endoftext|> end", "xx"),
        (7, "x" * 30_000, "en"),
        (8, "1" * 30_000, None),
    ]
