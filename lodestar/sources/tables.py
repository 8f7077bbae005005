"""Tables as observation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(df: DataFrame, key: str, wanted: DataFrame | None = None, new: DataFrame | None = None) -> DataFrame:
    """The table, its rows with wanted keys, or new data in its place."""
    if new is not None:
        return new
    return df if wanted is None else df.join(wanted.select(key), key, "left_semi")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations: charge in thousands explained by price, discount, tax and quantity.

    Neither order nor line number is unique here; obs_id folds the integer keys into one number and
    serves for keyed hashes only.
    """
    rows = read(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / 1000
    return rows.select(
        (F.col("l_orderkey") * 1000003 + F.col("l_partkey") * 1009 + F.col("l_suppkey") * 31 + F.col("l_linenumber")).alias("obs_id"),
        (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y"), F.lit(1.0).alias("wobs"), F.lit(0.0).alias("offs"),
        price.alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_quantity") / 10).alias("quantity"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"),
    )


LINE_ITEMS_SQL = """SELECT l_orderkey * 1000003 + l_partkey * 1009 + l_suppkey * 31 + l_linenumber AS obs_id,
  l_extendedprice / 1000 * (1 - l_discount) * (1 + l_tax) AS y, 1.0::DOUBLE AS wobs, 0.0::DOUBLE AS offs,
  l_extendedprice / 1000 AS price, l_discount AS discount, l_tax AS tax, l_quantity / 10 AS quantity, l_returnflag AS returnflag, l_linestatus AS linestatus FROM lineitem"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: quality explained by the logarithm of their length and toxicity."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = labels.join(docs.select("doc_id", "n_chars", "lang"), "doc_id")
    return rows.select(F.col("doc_id").alias("obs_id"), F.col("quality").cast("double").alias("y"), F.lit(1.0).alias("wobs"), F.lit(0.0).alias("offs"), (F.log(F.col("n_chars").cast("double")) / 10).alias("size"), F.col("toxic").cast("double").alias("toxic"), "lang")


LABELLED_SQL = "SELECT doc_id AS obs_id, quality::DOUBLE AS y, 1.0::DOUBLE AS wobs, 0.0::DOUBLE AS offs, ln(n_chars::DOUBLE) / 10 AS size, toxic::DOUBLE AS toxic, lang FROM labels JOIN documents USING (doc_id)"


def user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as observations: events counted, with the mean value in tens as predictor."""
    events = read(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("obs_id")).agg(F.count("*").cast("double").alias("y"), (F.avg("value") / 10).alias("x")).withColumns({"wobs": F.lit(1.0), "offs": F.lit(0.0)})


USER_COUNTS_SQL = "SELECT user_id AS obs_id, count(*)::DOUBLE AS y, avg(value) / 10 AS x, 1.0::DOUBLE AS wobs, 0.0::DOUBLE AS offs FROM events GROUP BY user_id"
