"""Hand-made rows with answers worked out by hand: ties, gaps, nulls and empty inputs."""

import datetime as dt
import statistics
from decimal import Decimal

from brandweave.operators import mentions as text
from brandweave.operators import sales as op
from brandweave.sources.tables import lexicon, watchlist

SALES = "order_key long, line int, part_key long, brand string, type string, region string, customer long, ordered timestamp_ntz, revenue decimal(18,4)"


def sales(spark, rows):
    return spark.createDataFrame([(o, i, p, b, "T", r, c, dt.datetime.fromisoformat(d), Decimal(v)) for i, (o, p, b, r, c, d, v) in enumerate(rows)], SALES)


def test_share_breaks_ties_by_name(spark):
    found = op.brand_share(sales(spark, [(1, 1, "B", "R", 1, "2000-01-01", "50"), (2, 2, "A", "R", 1, "2000-01-02", "50"), (3, 3, "A", "S", 1, "2000-01-02", "0.01")]))
    assert sorted(map(tuple, found.collect())) == [("R", "A", 50.0, 0.5, 1), ("R", "B", 50.0, 0.5, 2), ("S", "A", 0.01, 1.0, 1)]


def test_trend_fills_months_without_sales(spark):
    trend = op.brand_trend(sales(spark, [(1, 1, "A", "R", 1, "2000-01-31", "10"), (2, 1, "A", "R", 1, "2000-03-01", "30"), (3, 2, "B", "R", 1, "2000-02-10", "5")]))
    found = {(r.period.month, r.brand): (r.revenue, r.change, r.rank, r.moved) for r in trend.collect()}
    assert found == {(1, "A"): (10.0, None, 1, None), (1, "B"): (0.0, None, 2, None), (2, "A"): (0.0, -10.0, 2, -1), (2, "B"): (5.0, 5.0, 1, 1), (3, "A"): (30.0, 30.0, 1, 1), (3, "B"): (0.0, -5.0, 2, -1)}
    average = {(r.period.month, r.brand): r.average for r in op.brand_moving_avg(trend, 2).collect()}
    assert average[(2, "A")] == 5.0 and average[(3, "A")] == 15.0


def test_switching_affinity_and_lapsed(spark):
    frame = sales(spark, [(1, 1, "A", "R", 7, "2000-01-01", "5"), (1, 2, "B", "R", 7, "2000-01-01", "9"), (2, 1, "A", "R", 7, "2000-02-01", "1"), (3, 1, "A", "R", 8, "1999-01-01", "1")])
    assert [tuple(r) for r in op.brand_switching(frame).collect()] == [("B", "A", 1)]
    pair = op.brand_affinity(frame).collect()
    assert [(r.a, r.b, r.n_both, r.support, r.confidence, r.lift) for r in pair] == [("A", "B", 1, 0.333333, 0.333333, 1.0)]
    assert [tuple(r) for r in op.brand_lapsed(frame).collect()] == [("A", 8)]


def test_price_medians_with_ties_and_nulls(spark):
    prices = [("A", "T", 1.0), ("A", "T", 1.0), ("A", "T", 4.0), ("A", "T", 8.0), ("A", "T", None), ("B", "T", 2.0), ("B", "U", None)]
    part = spark.createDataFrame([(i, *p) for i, p in enumerate(prices)], "p_partkey long, p_brand string, p_type string, p_retailprice double")
    found = {(r.brand, r.type): (r.n_parts, r.median, r.type_median, r.position) for r in op.brand_price_position(part).collect()}
    assert found == {("A", "T"): (5, 2.5, 2.0, 1.25), ("B", "T"): (1, 2.0, 2.0, 1.0), ("B", "U"): (1, None, None, None)}


def test_empty_inputs(spark):
    empty = sales(spark, [(1, 1, "A", "R", 1, "2000-01-01", "1")]).limit(0)
    for job in (op.brand_share, op.brand_trend, op.brand_top_parts, op.brand_affinity, op.brand_switching, op.brand_lapsed, op.brand_concentration):
        assert job(empty).count() == 0


def test_mentions_are_whole_tokens(spark):
    units = spark.createDataFrame([(1, "Foo foobar, FOO!", "s"), (2, None, "s"), (3, "", "s"), (4, "bar foo", "s")], "doc_id long, text string, source string")
    names = watchlist(spark, [("FOO", "F"), ("bar", "B")])
    found = text.mentions(units, names, ("doc_id", "source"), context=1)
    assert sorted((r.doc_id, r.brand, r.position, list(r.before), list(r.after)) for r in found.collect()) == [
        (1, "F", 0, [], ["foobar"]), (1, "F", 2, ["foobar"], []), (4, "B", 0, [], ["foo"]), (4, "F", 1, ["bar"], []),
    ]
    assert [tuple(r) for r in text.co_mentions(found).collect()] == [("B", "F", 1)]
    voice = {r.brand: (r.mentions, r.units, r.share) for r in text.share_of_voice(found, "source").collect()}
    assert voice == {"F": (3, 2, 0.75), "B": (1, 1, 0.25)}
    opinion = {r.brand: (r.n_words, r.opinion) for r in text.mention_opinion(found, lexicon(spark, [("bar", 2), ("foobar", -1)])).collect()}
    assert opinion == {"F": (3, 0.0)}


def test_price_medians_of_one_large_type(spark):
    rows = [(i, f"B{i % 3}", "T" if i % 50 else None, float(i * 7919 % 10_007) / 4) for i in range(5_000)]
    part = spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_retailprice double")
    found = {(r.brand, r.type): (r.n_parts, r.median, r.type_median) for r in op.brand_price_position(part).collect()}
    for kind in ("T", None):
        every = [p for _, _, t, p in rows if t == kind]
        for brand in ("B0", "B1", "B2"):
            own = [p for _, b, t, p in rows if (b, t) == (brand, kind)]
            assert found.pop((brand, kind)) == (len(own), round(statistics.median(own), 6), round(statistics.median(every), 6))
    assert not found and op.brand_price_position(part.limit(0)).count() == 0
