"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x % len(WORDS)] + "abcdefgh"[x // 64 % 8])
    return " ".join(out)


def hard_rows() -> list[tuple]:
    base = prose(1, 60)
    return [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", None, 6), (4, "one", "en", "s", 3),
        (5, base, "en", "s", len(base)), (6, base, "de", "s", len(base)), (6, base, "de", "s", len(base)),
        (7, base + " tail words", "en", "t", None), (8, prose(2, 6000), "en", "s", None), (None, base, "en", "s", None),
        (9, "same line\nsame line\nsame line\nother", "en", "s", None), (10, "x" * 20000, "en", "s", None),
        (11, "a b c d e a b c d e a b c d e", "fr", "s", None), (12, "one", "en", "s", 3), (13, "日本語 テキスト 🙂", "ja", "s", None),
    ]


def hard(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(hard_rows(), SCHEMA)


def clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with extra columns named like the ones an operator works with."""
    return df.withColumns({n: F.lit("extra") for n in names})


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
