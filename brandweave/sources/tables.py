"""Readers with fixed schemas, and the joins that several jobs start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

#: Words of the invented texts that stand in for brand terms.
WATCHLIST = (("rewh", "Alpha"), ("orre", "Alpha"), ("thatin", "Beta"), ("ononst", "Gamma"))
#: Words of the invented texts that stand in for opinion words.
LEXICON = (("the", 1), ("of", -1), ("and", 2), ("is", -2), ("that", 3), ("with", -3))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, read with its fixed schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def watchlist(spark: SparkSession, rows=WATCHLIST) -> DataFrame:
    """(term, brand): what to look for. Terms are lower-cased."""
    return spark.createDataFrame(list(rows), "term string, brand string").withColumn("term", F.lower("term"))


def lexicon(spark: SparkSession, rows=LEXICON) -> DataFrame:
    """(word, weight): opinion words. Words are lower-cased."""
    return spark.createDataFrame(list(rows), "word string, weight int").withColumn("word", F.lower("word"))


def revenue(price: str = "l_extendedprice", discount: str = "l_discount"):
    """Discounted price as an exact decimal."""
    return F.col(price).cast("decimal(12,2)") * (F.lit(1).cast("decimal(4,2)") - F.col(discount).cast("decimal(4,2)"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line of an order, with brand, customer, region and date.

    Facts first, then dimensions from small to large, so that Spark sends the small ones to the
    facts while they are small and shuffles by their key when they are not.
    """
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", revenue().alias("revenue"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    regions = read(spark, sf_dir, "region")
    places = customers.join(nations, customers.c_nationkey == nations.n_nationkey).join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(places, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("p_partkey").alias("part_key"), F.col("p_brand").alias("brand"),
            F.col("p_type").alias("type"), F.col("r_name").alias("region"), F.col("c_custkey").alias("customer"), F.col("o_orderdate").alias("ordered"), "revenue",
        )
    )
