"""Content keywords per row group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentloom.functions import text as tx
from momentloom.functions.lexicon import STOPWORDS


def top_keywords(
    df: DataFrame, id_col: str, col: str = "text", k: int = 6, order: str | None = None
) -> DataFrame:
    """The ``k`` most frequent tokens of 4 letters or more that are no stopwords.

    Ties go to the longer token, then to the first seen. With several rows per id,
    ``order`` says which row comes first.
    """
    at = F.col(order) if order else F.lit(0)
    words = df.select(id_col, at.alias("_row"), F.posexplode_outer(tx.tokens(col)).alias("_pos", "keyword"))
    words = words.where((F.length("keyword") >= 4) & ~F.col("keyword").isin(*STOPWORDS))
    counts = words.groupBy(id_col, "keyword").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_row", "_pos")).alias("_first")
    )
    w = Window.partitionBy(id_col).orderBy(F.desc("n"), F.length("keyword").desc(), "_first")
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(id_col, "rank", "keyword", "n")
