"""Small documents with every awkward case."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 97} other{i % 31}" for i in range(6000))
ROWS = [
    (3, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a", 1),
    (7, None, None, None, None),
    (8, "", "fr", "b", 0),
    (None, "a text without an id", "en", "b", 5),
    (None, None, None, None, None),
    (9, "   \n\t ", "en", "c", 6),
    (10, "single", "en", "c", 6),
    (11, LONG, "en", "c", None),
    (12, "Ünïcödé 日本語 🙂 é  double  spaces\n\nand\r\nlines 　 <|endoftext|>", "de", "d", 3),
    (5, "The quick brown fox jumps over the lazy cat and runs away.", "en", "a", 1),
]


def docs(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return spark.createDataFrame(ROWS if rows is None else rows, DOCS)


def clashing(df: DataFrame) -> DataFrame:
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    extra = ("score", "fp", "sketch", "run", "edge", "list", "codes", "component_id", "length", "piece", "value", "nth", "all", "tie")
    return df.withColumns({c: F.lit(f"own {c}") for c in extra})


def table(spark: SparkSession, tmp_path, **tables: DataFrame) -> str:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
