"""Brands in sales: revenue, shares, trends, affinity and switching.

All take the rows of ``sources.tables.sales`` or given tables and use exact decimals until the last
step. Ties are broken by name or key, so results do not depend on partitioning.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brandweave.functions.shared import beside, kept
from brandweave.sources.tables import revenue


def total():
    """Exact revenue of a group."""
    return F.sum("revenue")


def brand_revenue(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Revenue, lines and different parts of each brand."""
    lines = lineitem.select("l_partkey", revenue().alias("revenue")).join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    per_part = lines.groupBy("p_brand", "p_partkey").agg(total().alias("revenue"), F.count(F.lit(1)).alias("n_lines"))
    return per_part.groupBy(F.col("p_brand").alias("brand")).agg(total().cast("double").alias("revenue"), F.sum("n_lines").alias("n_lines"), F.count(F.lit(1)).alias("n_parts"))


def brand_share(sales: DataFrame, by: str = "region") -> DataFrame:
    """Revenue of each brand, its share of the group's total, and its rank in the group."""
    totals = sales.groupBy(by, "brand").agg(total().cast("double").alias("revenue"), total().alias("exact"))
    group = W.partitionBy(by)
    return totals.select(
        by,
        "brand",
        "revenue",
        F.round(F.col("revenue") / F.sum("exact").over(group).cast("double"), 6).alias("share"),
        F.rank().over(group.orderBy(F.desc("exact"), "brand")).cast("long").alias("rank"),
    )


def brand_trend(sales: DataFrame, grain: str = "month") -> DataFrame:
    """Revenue by period and brand, the change from the period before, and the movement in rank.

    Every brand has a row for every period from the first to the last; without sales it is 0. The totals
    by period and brand are kept once, since the calendar and the rows both come from them.
    """
    period = F.date_trunc(grain, "ordered").cast("timestamp_ntz")
    totals = kept(sales.groupBy(period.alias("period"), "brand").agg(total().alias("exact")))
    first, last = totals.agg(F.min("period"), F.max("period")).first()
    calendar = F.sequence(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"), F.expr(f"interval 1 {grain}"))
    frame = totals.select("brand").distinct().select("brand", F.explode(calendar).alias("period"))
    full = frame.join(totals, ["period", "brand"], "left").withColumn("exact", F.coalesce("exact", F.lit(0)))
    ranked = full.withColumn("rank", F.rank().over(W.partitionBy("period").orderBy(F.desc("exact"), "brand")).cast("long"))
    before = W.partitionBy("brand").orderBy("period")
    return ranked.select(
        "period",
        "brand",
        F.col("exact").cast("double").alias("revenue"),
        (F.col("exact") - F.lag("exact").over(before)).cast("double").alias("change"),
        "rank",
        (F.lag("rank").over(before) - F.col("rank")).alias("moved"),
    )


def brand_moving_avg(trend: DataFrame, n: int = 3) -> DataFrame:
    """Trailing average over n periods, or as many as there are."""
    window = W.partitionBy("brand").orderBy("period").rowsBetween(-(n - 1), 0)
    total = F.sum(F.col("revenue").cast("decimal(28,4)")).over(window).cast("double")
    n = F.count(F.lit(1)).over(window)
    return trend.select("period", "brand", (total / n).alias("average"), n.alias("n"))


def brand_cube(sales: DataFrame, dims: tuple[str, ...] = ("region", "brand", "type")) -> DataFrame:
    """Revenue by all subsets of the dimensions."""
    return sales.cube(*dims).agg(total().cast("double").alias("revenue"), F.grouping_id().cast("long").alias("grouping"))


def brand_top_parts(sales: DataFrame, k: int = 3) -> DataFrame:
    """The k best-selling parts of each brand."""
    totals = sales.groupBy("brand", "part_key").agg(total().alias("exact"))
    place = F.row_number().over(W.partitionBy("brand").orderBy(F.desc("exact"), "part_key"))
    return totals.withColumn("place", place.cast("long")).where(F.col("place") <= k).select("brand", "place", "part_key", F.col("exact").cast("double").alias("revenue"))


def _medians(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and median price by key, of counted prices dealt into cells; null prices count as rows only.

    A group's cells are summed up in order, which tells in which of them its middle rows lie; only those
    are looked through, cell by cell.
    """
    known = F.sum(F.when(F.col("p_retailprice").isNotNull(), F.col("n")))
    sums = cells.groupBy(*keys, "cell").agg(F.sum("n").alias("total"), F.coalesce(known, F.lit(0)).alias("known"))
    group = W.partitionBy(*keys)
    upto, every = F.sum("known").over(group.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)), F.sum("known").over(group)
    placed = sums.select(*keys, "cell", "total", (upto - F.col("known")).alias("before"), upto.alias("upto"), every.alias("every"))
    low, high = F.floor((F.col("every") + 1) / 2), F.floor(F.col("every") / 2) + 1
    middle = placed.where(((F.col("before") < low) & (F.col("upto") >= low)) | ((F.col("before") < high) & (F.col("upto") >= high))).select(*(F.col(c).alias(f"m_{c}") for c in [*keys, "cell"]), "before", low.alias("low"), high.alias("high"))
    same = functools.reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in [*keys, "cell"]))
    inside = cells.where("p_retailprice is not null").join(beside(middle), same)
    prices = inside.groupBy(*keys, "cell", "before", "low", "high", "p_retailprice").agg(F.sum("n").alias("n"))
    passed = F.col("before") + F.sum("n").over(W.partitionBy(*keys, "cell").orderBy("p_retailprice").rowsBetween(W.unboundedPreceding, 0))
    at = lambda rank: F.min(F.when(F.col("passed") >= F.col(rank), F.col("p_retailprice")))
    found = prices.withColumn("passed", passed).groupBy(*keys).agg(((at("low") + at("high")) / 2).alias("median"))
    both = sums.select(*keys, "total", F.lit(None).cast("double").alias("median")).unionByName(found.select(*keys, F.lit(0).cast("long").alias("total"), "median"))
    return both.groupBy(*keys).agg(F.max("median").alias("median"), F.sum("total").alias("total"))


def brand_price_position(part: DataFrame) -> DataFrame:
    """Exact median price of each brand's parts of a type against the type's median.

    Prices are counted, dealt into cells in the order of type and price, and kept. A type that holds most
    rows lies in many cells, and only the one or two in which a median falls are looked through: no task
    holds a type. Null brands and types are groups; not-a-number is the greatest price.
    """
    n = int(part.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prices = part.groupBy("p_brand", "p_type", "p_retailprice").agg(F.count(F.lit(1)).alias("n"))
    cells = kept(prices.repartitionByRange(n, F.col("p_type"), F.col("p_retailprice").asc_nulls_last()).withColumn("cell", F.spark_partition_id()))
    types = _medians(cells, ["p_type"]).select(F.col("p_type").alias("type"), F.col("median").alias("type_median"))
    own = _medians(cells, ["p_brand", "p_type"])
    return own.join(beside(types), F.col("p_type").eqNullSafe(F.col("type"))).select(
        F.col("p_brand").alias("brand"), "type", F.col("total").alias("n_parts"), F.round("median", 6).alias("median"), F.round("type_median", 6).alias("type_median"), F.round(F.col("median") / F.col("type_median"), 6).alias("position")
    )


def brand_return_rate(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Returned quantity over all quantity."""
    quantity = F.col("l_quantity").cast("decimal(12,2)")
    lines = lineitem.select("l_partkey", quantity.alias("q"), F.when(F.col("l_returnflag") == "R", quantity).otherwise(0).alias("r"))
    totals = lines.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(F.sum("r").cast("double").alias("returned"), F.sum("q").cast("double").alias("quantity"))
    return totals.withColumn("rate", F.round(F.col("returned") / F.col("quantity"), 6))


def brand_affinity(sales: DataFrame) -> DataFrame:
    """Orders that hold both of two brands: support, confidence of b given a, and lift.

    An order has few brands, so the pairs of an order are few however large the table is.
    """
    held = sales.select("order_key", "brand").distinct()
    orders = held.agg(F.countDistinct("order_key").alias("orders"))
    single = held.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    pairs = held.groupBy("order_key").agg(F.array_sort(F.collect_list("brand")).alias("brands")).where(F.size("brands") > 1)
    pairs = pairs.select(F.posexplode("brands").alias("at", "a"), "brands").select("a", F.explode(F.slice("brands", F.col("at") + 2, F.size("brands"))).alias("b"))
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    joined = counts.join(single.select(F.col("brand").alias("a"), F.col("n").alias("n_a")), "a").join(single.select(F.col("brand").alias("b"), F.col("n").alias("n_b")), "b").join(F.broadcast(orders))
    return joined.select(
        "a",
        "b",
        "n_both",
        F.round(F.col("n_both") / F.col("orders"), 6).alias("support"),
        F.round(F.col("n_both") / F.col("n_a"), 6).alias("confidence"),
        F.round(F.col("n_both") * F.col("orders") / (F.col("n_a") * F.col("n_b")), 6).alias("lift"),
    )


def brand_switching(sales: DataFrame) -> DataFrame:
    """From an order's main brand (its largest line) to that of the customer's next order."""
    line = F.struct(F.col("revenue"), F.col("line"), F.col("part_key"), F.col("brand"))
    orders = sales.groupBy("customer", "order_key").agg(F.max(line).alias("top"), F.min("ordered").alias("ordered"))
    after = W.partitionBy("customer").orderBy("ordered", "order_key")
    moves = orders.select(F.col("top.brand").alias("from_brand"), F.lead("top.brand").over(after).alias("to_brand"))
    return moves.where("to_brand is not null").groupBy("from_brand", "to_brand").agg(F.count(F.lit(1)).alias("n"))


def brand_lapsed(sales: DataFrame, cutoff: str = "2000-01-01") -> DataFrame:
    """(brand, customer) with a purchase before the cutoff and none from it on."""
    last = sales.groupBy("brand", "customer").agg(F.max("ordered").alias("last"))
    return last.where(F.col("last") < F.to_timestamp_ntz(F.lit(cutoff))).select("brand", "customer")


def brand_concentration(sales: DataFrame, by: str = "region") -> DataFrame:
    """Sum of squared shares (Herfindahl index)."""
    totals = sales.groupBy(by, "brand").agg(total().alias("exact"))
    share = F.col("exact").cast("double") / F.sum("exact").over(W.partitionBy(by)).cast("double")
    return totals.withColumn("share", share).groupBy(by).agg(F.round(F.sum(F.col("share") * F.col("share")), 6).alias("concentration"), F.count(F.lit(1)).alias("n_brands"))
