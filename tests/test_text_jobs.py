"""Text jobs: plans, long texts, large watchlists and odd rows."""

import pytest

from brandweave.functions import shared
from brandweave.operators import mentions as op
from brandweave.plans import text as plans
from brandweave.sources.tables import lexicon, watchlist

UNITS = "doc_id long, text string, source string"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_texts_are_never_sent_round(spark, sf_dir, name):
    plan = plan_of(plans.QUERIES[name](spark, sf_dir))
    assert "BuildLeft" not in plan
    # what is exchanged or broadcast lies above the mentions or comes from a list: no exchange stands on the scan of texts before the explode
    for block in plan.split("FileScan parquet")[1:]:
        assert "Exchange" not in block.split("\n")[0]
    below = plan.split("Generate explode(transform(filter(")
    assert name == "distinctive_terms" or all("Exchange" not in part.split("FileScan")[0] for part in below[1:])


def test_one_text_of_20000_words(spark):
    long = " ".join(f"w{'abcdefghij'[i % 10]} foo" for i in range(10_000))
    units = spark.createDataFrame([(1, long, "s"), (2, "foo", "s")], UNITS)
    names = watchlist(spark, [("foo", "F")])
    found = op.mention_context(units, names, 3)
    rows = found.collect()
    assert len(rows) == 10_001
    middle = next(r for r in rows if r.position == 5001)
    assert (middle.before, middle.after) == ("wj foo wa", "wb foo wc")
    assert op.mention_opinion(op.mentions(units, names, ("doc_id", "source"), 3), lexicon(spark, [("foo", 2)])).collect()[0].opinion == 2.0


@pytest.mark.parametrize("context", [0, 2])
def test_a_large_watchlist_gives_the_same_rows(spark, sf_dir, context):
    units = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = watchlist(spark)
    key = lambda r: tuple(map(str, r))
    small, large = (sorted(map(key, op.mentions(units, names, context=context, terms=n).collect())) for n in (op.TERMS, 1))
    assert small == large and small


def test_odd_rows_and_lists(spark):
    units = spark.createDataFrame([(1, "a b a", "s"), (1, "a b a", "s"), (None, "a", None), (4, None, "s"), (5, "", "s")], UNITS)
    names = spark.createDataFrame([("a", "A", 1), ("a", "A", 2), ("a", "B", 1), (None, "A", 1), ("b", None, 1)], "term string, brand string, doc_id long")
    found = op.mentions(units, names, ("doc_id", "source"), 1)
    assert sorted((r.doc_id or 0, r.brand, r.position) for r in found.collect()) == [(0, "A", 0), (0, "B", 0), *[(1, b, p) for b in "AB" for p in (0, 0, 2, 2)]]
    none = names.limit(0)
    for terms in (op.TERMS, -1):
        assert op.mentions(units, none, terms=terms).count() == 0
        assert op.mentions(units.limit(0), names, terms=terms).count() == 0
    weights = spark.createDataFrame([("b", 3, "x"), ("b", None, "y"), (None, 1, "z")], "word string, weight int, brand string")
    assert {r.brand: (r.n_words, r.opinion) for r in op.mention_opinion(found, weights).collect()} == {"A": (4, 3.0), "B": (4, 3.0)}
    assert op.distinctive_terms(found).count() == 2


def test_small_sides_are_counted(spark):
    assert shared.is_small(spark.range(10), rows=10) and not shared.is_small(spark.range(11), rows=10)
    assert not shared.is_small(spark.createDataFrame([("x" * 1000,)], "a string"), size=999)
    assert shared.is_small(spark.range(0))
