"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

A source's target is its share of all words by weight, limited to ``max_epochs`` times its size; what
the limit cuts off is shared anew by weight. The source's documents stand in hash order; whole
epochs take all of them, and of the last, partial epoch each document whose middle lies below the
demand. That is done first for documents above the source's mean size, then for the others with
what the first left to take, so that a source misses its target by half of a mean document at most.

Each source has a schedule of weights over training time 0 to 1, piecewise linear between knots. Its
integral, scaled to the target, is the source's cumulative demand of words; inverting it at the
words taken before a copy gives the copy's training position, and rows are range-sorted by it.

Prefix sums run over three levels of hash cells (1024 x 1024 in each source and size class), so no
window holds a whole source; rows that are alike are planned once with their number. What is sent
to all workers is the table of sources, and only while it has at most BROADCAST_SOURCES rows; beyond
that it is joined with its rows repeated for SALTS slices of every source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brandweave.llm.common import Scratch, stored, table

BROADCAST_SOURCES = 20_000
SALTS = 64
#: Partitions over which sources are range-sorted for their ranks.
RANK_PARTITIONS = 32
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``rank``, from 1 by code point with null last, without one task seeing all sources."""
    order = F.col("source").asc_nulls_last()
    dealt = scratch.stored(sources.repartitionByRange(RANK_PARTITIONS, order).withColumn("part", F.spark_partition_id()), "ranked", small=True)
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    within = F.row_number().over(W.partitionBy("part").orderBy(order))
    return dealt.withColumn("within", within).join(F.broadcast(offsets), "part").withColumn("rank", F.col("within") + F.col("before")).drop("part", "within", "before")


def targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to stored (source, source_size, weight).

    All words are shared by weight; a source above max_epochs times its size stops there and the
    excess is shared by weight among the others, until none is above. A round is one aggregate.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    weight = F.col("weight").cast("double")
    total, weights = sources.agg(F.sum("source_size"), F.sum(weight)).first()
    level, capped = (total or 0) / weights if weights else 0.0, -1
    while True:
        above = weight * F.lit(level) > cap
        n, held, rest = sources.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, weight)), F.lit(0.0))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - held) / rest
    return sources.withColumn("target", F.least(cap, weight * F.lit(level)))


def default_schedule() -> Column:
    """Knots by rank: every third source fades out, keeps its weight, or fades in."""
    ramp = {1: (1.5, 0.5), 2: (1.0, 1.0), 0: (0.5, 1.5)}
    knots = lambda a, b: F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, a), (1.0, b))))
    turn = F.col("rank") % 3
    return F.when(turn == 1, knots(*ramp[1])).when(turn == 2, knots(*ramp[2])).otherwise(knots(*ramp[0]))


def _with_areas(sources: DataFrame) -> DataFrame:
    """Adds ``areas``: the schedule's integral from 0 to each knot."""
    return sources.withColumn(
        "areas",
        F.expr(
            "aggregate(sequence(1, greatest(size(knots) - 1, 1)), array(cast(0 as double)), (a, i) -> concat(a, array("
            "element_at(a, -1) + (knots[i - 1].w + knots[i].w) / 2 * (knots[i].t - knots[i - 1].t))))"
        ),
    )


def position_of(share: Column) -> Column:
    """Where on the schedule (``knots``, ``areas``) the given share of its whole integral is reached."""
    area = share * F.element_at("areas", -1)
    k = F.greatest(F.least(F.size(F.filter("areas", lambda x: x <= area)), F.size("knots") - 1), F.lit(1))
    at = F.struct(area.alias("a"), k.alias("k"))
    return F.transform(F.array(at), _inverse)[0]


def _inverse(at: Column) -> Column:
    a, k = at["a"], at["k"]
    knot = lambda i: F.get(F.col("knots"), i)
    t0, w0, w1 = knot(k - 1)["t"], knot(k - 1)["w"], knot(k)["w"]
    over, step = a - F.get(F.col("areas"), k - 1), knot(k)["t"] - knot(k - 1)["t"]
    root = w0 + F.sqrt(F.greatest(w0 * w0 + 2 * (w1 - w0) / step * over, F.lit(0.0)))
    return F.when(root > 0, t0 + F.least(2 * over / root, step)).otherwise(t0)


def _join_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """rows with their source's columns; ``group`` is never null."""
    if few:
        return rows.join(F.broadcast(sources), "group")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.col("order_key"), F.lit(SALTS)).cast("int")).join(salted, ["group", "salt"]).drop("salt")


def _order_key() -> Column:
    """A hash of doc_id and text, of 60 bits, so that rows with one doc_id don't stand together."""
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("long")


def _group() -> Column:
    return F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source")))


def _key() -> list[Column]:
    """What tells documents apart: doc_id, source and the whole text."""
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    return [doc_id.alias("doc_id"), source.alias("source"), F.xxhash64("text").alias("text_hash"), F.col("text").isNull().alias("no_text")]


def plan(documents: DataFrame, weight: Column | None = None, schedule: Column | None = None, max_epochs: int = 3) -> DataFrame:
    """How often and where in training each document is taken.

    One row for each different (doc_id, source, text): doc_id, source, text_hash, no_text, n_rows,
    size (words of one row), source_size, target, copies (of each row), taken (words, of one row)
    and positions (of its copies, ascending, from 0 to below 1). ``weight`` and ``schedule`` are
    columns over (source, rank, source_size); by default weights are 1, 2, 3, repeating by rank. A
    null source is a source, last in order. A source without words takes nothing. Equal input rows
    give equal plans in any partitioning. An empty input gives an empty plan.
    """
    weight = ((F.col("rank") - 1) % 3 + 1) if weight is None else weight
    with Scratch(documents.sparkSession) as scratch:
        return stored(_plan(documents, weight, schedule, max_epochs, scratch), "plan")


def _plan(documents: DataFrame, weight: Column, schedule: Column | None, max_epochs: int, scratch: Scratch) -> DataFrame:
    sized = documents.select(*_key(), n_words().alias("size"), _order_key().alias("order_key")).groupBy("doc_id", "source", "text_hash", "no_text")
    sized = sized.agg(F.count(F.lit(1)).alias("n_rows"), F.max("size").alias("size"), F.max("order_key").alias("order_key"))
    sized = scratch.kept(sized.withColumn("group", _group()))

    words = F.col("size") * F.col("n_rows")
    sources = sized.groupBy("group", "source").agg(F.sum(words).alias("source_size"), F.sum("n_rows").alias("source_rows"))
    sources = scratch.stored(ranked_sources(sources, scratch).withColumn("weight", weight).withColumn("knots", schedule if schedule is not None else default_schedule()), "sources", small=True)
    sources = scratch.stored(_with_areas(targets(sources, max_epochs)).drop("source"), "targets", small=True)
    few = sources.count() <= BROADCAST_SOURCES

    means = sources.select("group", (F.col("source_size") / F.col("source_rows")).alias("mean"))
    cells = _join_sources(sized, means, few).select(
        "*",
        words.alias("words"),
        (F.col("size") > F.col("mean")).alias("big"),
        F.shiftright("order_key", 50).cast("int").alias("coarse"),
        (F.shiftright("order_key", 40) % 1024).cast("int").alias("fine"),
    )
    before = lambda by, over: F.coalesce(F.sum(over).over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    keys = ["group", "big", "coarse", "fine"]
    by_fine = cells.groupBy(*keys).agg(F.sum("words").alias("words"))
    by_coarse = by_fine.groupBy(*keys[:-1]).agg(F.sum("words").alias("words"))
    by_coarse = by_coarse.select(*keys[:-1], before(keys[:-1], "words").alias("coarse_before"))
    by_fine = by_fine.select(*keys, before(keys, "words").alias("fine_before")).join(by_coarse, keys[:-1])
    inside = W.partitionBy(*keys).orderBy("order_key", "doc_id", "text_hash", "no_text").rowsBetween(W.unboundedPreceding, -1)
    placed = cells.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(by_fine, keys)
    placed = placed.withColumn("before", F.col("inside") + F.col("fine_before") + F.col("coarse_before"))
    placed = scratch.stored(placed.drop("inside", "fine_before", "coarse_before", "coarse", "fine", "mean"), "placed")

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("epochs", whole).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    middle = F.col("before") + F.col("words") / 2
    big_words = placed.groupBy("group").agg(F.sum(F.when(F.col("big"), F.col("words")).otherwise(0)).alias("big_size"))
    sources = sources.join(big_words, "group").withColumn("big_demand", F.when(F.col("source_size") > 0, F.col("rest") * F.col("big_size") / F.col("source_size")).otherwise(0.0))
    bigs = _join_sources(placed.where("big"), sources.select("group", "big_demand"), few).where(middle <= F.col("big_demand"))
    bigs = bigs.groupBy("group").agg(F.sum("words").alias("big_taken"))
    sources = scratch.stored(
        sources.join(bigs, "group", "left")
        .fillna(0, ["big_taken"])
        .withColumn("small_demand", F.greatest(F.col("rest") - F.col("big_taken"), F.lit(0.0)))
        .select("group", "source_size", "target", "knots", "areas", "epochs", "rest", "big_size", "big_demand", "small_demand"),
        "demands",
        small=True,
    )

    rows = _join_sources(placed, sources, few)
    demand = F.when(F.col("big"), F.col("big_demand")).otherwise(F.col("small_demand"))
    rows = rows.withColumn("extra", (middle <= demand) & (F.col("words") > 0)).withColumn("copies", (F.col("epochs") + F.col("extra").cast("int")).cast("int"))
    class_size = F.when(F.col("big"), F.col("big_size")).otherwise(F.col("source_size") - F.col("big_size"))
    epoch = lambda e: e * F.col("source_size") + F.when(class_size > 0, F.col("before") / class_size * F.col("source_size")).otherwise(0.0)
    partial = F.col("epochs") * F.col("source_size") + F.when(demand > 0, F.least(F.col("before") / demand, F.lit(1.0)) * F.col("rest")).otherwise(0.0)
    starts = F.concat(
        F.transform(F.sequence(F.lit(0), F.greatest(F.col("epochs") - 1, F.lit(0)).cast("int")), epoch),
        F.array(partial),
    )
    starts = F.concat(F.slice(starts, 1, F.col("epochs").cast("int")), F.when(F.col("extra"), F.array(partial)).otherwise(F.array().cast("array<double>")))
    shares = F.transform(starts, lambda x: F.when(F.col("target") > 0, F.least(x / F.col("target"), F.lit(1.0))).otherwise(0.0))
    return rows.withColumn("positions", F.transform(shares, position_of)).select(
        "doc_id", "source", "text_hash", "no_text", "n_rows", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions"
    )


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as the plan takes it, range-sorted by position.

    The columns are those of ``documents``, and ``position`` (under another name if documents has it
    already). A row taken more than once stands at different positions.
    """
    planned = plan(documents, **options).where("copies > 0").select("doc_id", "source", "text_hash", "no_text", "positions")
    keyed = documents.select(F.struct("*").alias("row"), *[c.alias(n) for c, n in zip(_key(), ("k1", "k2", "k3", "k4"), strict=True)])
    same = F.col("k1").eqNullSafe(F.col("doc_id")) & F.col("k2").eqNullSafe(F.col("source")) & (F.col("k3") == F.col("text_hash")) & (F.col("k4") == F.col("no_text"))
    name = "position"
    while name in documents.columns:
        name = "_" + name
    placed = keyed.join(planned, same).select("row", F.explode("positions").alias("position")).orderBy("position")
    return placed.select("row.*", F.col("position").alias(name))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of them, in the order of their first positions."""
    rows = plan(table(spark, sf_dir, "documents")).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies", F.round(F.get("positions", F.lit(0)), 9).alias("first_position")).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


#: The same rows, with the water level in closed form and the three schedules written out.
OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')) AS digest
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, avg(size) AS mean,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total,
         sum(3.0::DOUBLE * source_size) OVER w AS caps_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM sources
  WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT (total - coalesce(caps_before, 0)) / rest AS level FROM ordered
  WHERE (total - coalesce(caps_before, 0)) / rest * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, mean, weight, least(cap, weight * level)::DOUBLE AS target FROM ordered, level),
demand AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
         CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE 0 END AS rest
  FROM targets),
placed AS (
  SELECT s.*, d.source_size, d.target, d.epochs, d.rest, d.weight, s.size > d.mean AS big,
         sum(s.size) OVER (PARTITION BY s.source, s.size > d.mean ORDER BY s.digest, s.doc_id) - s.size / 2 AS middle,
         sum(CASE WHEN s.size > d.mean THEN s.size ELSE 0 END) OVER (PARTITION BY s.source) AS big_size
  FROM sized s JOIN demand d ON s.source IS NOT DISTINCT FROM d.source),
first_part AS (
  SELECT *, sum(CASE WHEN big AND middle <= rest * big_size / source_size THEN size ELSE 0 END) OVER (PARTITION BY source) AS big_taken
  FROM placed),
taken AS (
  SELECT *, size > 0 AND middle <= CASE WHEN big THEN rest * big_size / source_size ELSE rest - big_taken END AS extra,
         CASE WHEN big THEN big_size ELSE source_size - big_size END AS class_size,
         CASE WHEN big THEN rest * big_size / source_size ELSE greatest(rest - big_taken, 0) END AS demand
  FROM first_part),
starts AS (
  SELECT *, CASE WHEN epochs > 0 OR extra THEN least(CASE WHEN epochs > 0 THEN CASE WHEN class_size > 0 THEN (middle - size / 2) / class_size * source_size ELSE 0 END
                       WHEN extra THEN least((middle - size / 2) / demand, 1) * rest END / nullif(target, 0), 1) END AS share,
         CASE weight WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE 0.5 END::DOUBLE AS w0,
         CASE weight WHEN 1 THEN -1.0 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS slope
  FROM taken)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       ((epochs + extra::INT) * size)::BIGINT AS taken, (epochs + extra::INT)::INT AS copies,
       round(2 * share / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * share, 0))), 9) AS first_position
FROM starts
"""
