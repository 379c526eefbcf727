"""The given tables seen as reviews, ratings, catalogue, seeds and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews: source is the item, doc_id % 50 the user, quality sets the rating."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    rating = F.when(F.col("quality") == 1, 7 + i % 4).when(F.col("quality") == 0, 1 + i % 4).otherwise(5 + i % 2)
    return joined.select(
        i.alias("review_id"), F.col("source").alias("movie"), (i % 50).alias("reviewer"),
        rating.cast("double").alias("rating"), F.col("text").alias("review_detail"),
        F.coalesce("toxic", F.lit(0)).alias("spoiler_tag"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_reviews(spark, sf_dir).withColumnsRenamed({"movie": "item", "reviewer": "user", "review_detail": "review"})


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as ratings of parts by customers."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item"), "l_quantity")
    return lines.join(orders, "l_orderkey").select(
        "user", "item", (F.col("l_quantity") % 10 + 1).cast("double").alias("rating"),
        F.col("l_orderkey").alias("order_key"), "l_linenumber",
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    title = F.concat("p_name", F.lit(" "), "p_brand")
    return part.select(
        F.col("p_partkey").cast("string").alias("tconst"),
        F.when(F.col("p_type") == "ECONOMY", "movie").when(F.col("p_type") == "SMALL", "tvSeries").otherwise("videoGame").alias("titleType"),
        title.alias("primaryTitle"), F.upper(title).alias("originalTitle"),
        (F.col("p_size") + 1975).cast("string").alias("startYear"),
    )


def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as titles that name the sources of the documents."""
    title = F.concat(F.lit("SRC "), (F.col("tconst").cast("bigint") % 25).cast("string"))
    return catalogue(spark, sf_dir).withColumns({"primaryTitle": title, "originalTitle": title})


def titled_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as reviews of titled parts."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat(F.upper(F.concat("p_name", F.lit(" "), "p_brand")), F.lit(" (1999)")).alias("item"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return lines.join(part, "l_partkey").select("l_orderkey", "l_linenumber", "item", "l_quantity")


def as_feedback(events: DataFrame) -> DataFrame:
    """Events as feedback of users on items; some items have no profile."""
    kind = F.col("event_type")
    action = F.when(kind == "click", "like").when(kind == "view", "unlike").when(kind == "purchase", "rate").when(kind == "error", "delete").otherwise("none")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "event_id", "ts", F.col("user_id").alias("user"), F.concat(F.lit("src"), (k % 25).cast("string")).alias("item"),
        action.alias("action"), (F.floor("value") % 10 + 1).cast("int").alias("rating"),
        F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("review"),
    )


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_feedback(table(spark, sf_dir, "events"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
