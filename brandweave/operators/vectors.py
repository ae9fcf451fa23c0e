"""Groups of vectors: each group's mean, and the means that are nearest to each vector."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandweave.functions.shared import SMALL_BYTES, kept

#: Means are held against vectors in blocks of so many values, each of which goes to all tasks.
BLOCK_VALUES = SMALL_BYTES // 8 // 4


def _usable(vector: str) -> Column:
    """A vector takes part if it holds finite numbers only, one of them not 0."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _with(value: Column, of) -> Column:
    """of(value), where value is computed once and not once for each element of an array inside."""
    return F.transform(F.array(value), of)[0]


def _unit(v: Column) -> Column:
    """The vector divided by its norm; its largest component is taken out first, so that no square overflows."""
    over = lambda u, by: _with(by, lambda t: F.transform(u, lambda x: x / t))
    return _with(over(v, F.array_max(F.transform(v, F.abs))), lambda u: over(u, F.sqrt(_dot(u, u))))


def group_means(vectors: DataFrame, vector: str = "embedding", group: str = "label") -> DataFrame:
    """(size, label, mean): the mean of each group's vectors of one size, by position.

    Values are added up before the shuffle, so a group of most rows costs as much as any. Rows without a
    group, and vectors that are null, zero, empty or not finite, take no part.
    """
    rows = vectors.where(F.col(group).isNotNull() & _usable(vector)).select(F.col(group).alias("label"), F.size(vector).alias("size"), F.posexplode(F.col(vector).cast("array<double>")).alias("at", "x"))
    means = rows.groupBy("size", "label", "at").agg(F.avg("x").alias("x"))
    return means.groupBy("size", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))


def nearest_groups(vectors: DataFrame, k: int = 3, key: str = "vec_id", vector: str = "embedding", group: str = "label", block_values: int = BLOCK_VALUES) -> DataFrame:
    """The k groups whose means have the largest cosine with each vector, rounded to 6 places; ties go to the smaller label.

    The means are kept once and dealt into blocks of up to ``block_values`` numbers. A block is one row for
    each size of vectors and is sent to all tasks, where a row's cosines are taken and ranked inside the row;
    with several blocks the row's best of each are ranked again, in the row. Nothing of the vectors is
    shuffled but their sums. Repeated rows and null keys are rows like others; a row without a group is
    held against the means; a vector that takes no part (see ``group_means``), or that no mean has the size of,
    gives no row, and a mean of zero is nobody's.
    """
    means = kept(group_means(vectors, vector, group).where(_usable("mean")))
    values = means.agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(values / block_values))
    found = vectors.where(_usable(vector)).select(F.col(key).alias(key), F.size(vector).alias("size"), _unit(F.col(vector).cast("array<double>")).alias("unit"), F.array().cast("array<struct<order:double,label:" + means.schema["label"].dataType.simpleString() + ">>").alias("best"))
    for i in range(blocks):
        mine = means.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == i).groupBy("size").agg(F.collect_list(F.struct("label", _unit(F.col("mean")).alias("unit"))).alias("groups"))
        near = F.transform("groups", lambda g: F.struct((-F.round(_dot(F.col("unit"), g["unit"]), 6)).alias("order"), g["label"].alias("label")))
        best = F.slice(F.array_sort(F.concat("best", F.coalesce(near, F.array().cast(found.schema["best"].dataType)))), 1, k)
        found = found.join(F.broadcast(mine), "size", "left").select(key, "size", "unit", best.alias("best"))
    ranked = found.select(key, F.posexplode("best").alias("at", "near"))
    return ranked.select(key, (F.col("at") + 1).cast("long").alias("rank"), F.col("near.label").alias("label"), (-F.col("near.order") + F.lit(0.0)).alias("cosine"))
