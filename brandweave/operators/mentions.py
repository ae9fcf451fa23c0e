"""Brands in texts: mentions, share of voice, contexts, opinions and distinctive terms.

A token is a run of letters in the lower-cased text. Terms are matched as whole tokens against a
watchlist that the caller supplies. A watchlist of up to TERMS rows is looked up inside each text's
row, before anything is exploded, so only mentions become rows; a larger one is joined by term. Either
way the texts are never sent round, and contexts are cut inside the row.

A null or empty text has no tokens; repeated rows and repeated or null ids are units' rows like others;
terms, brands and words that are null match nothing; columns other than those named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brandweave.functions.shared import beside, is_small, kept

TOKEN = r"\p{L}+"
#: A watchlist of up to so many rows, and a MB, is part of the plan.
TERMS = 5_000


def tokens(text: str = "text") -> Column:
    """Lower-cased runs of letters; none for a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def mentions(units: DataFrame, watchlist: DataFrame, keys: tuple[str, ...] = ("doc_id",), context: int = 0, terms: int = TERMS) -> DataFrame:
    """One row for each unit, brand and token position, from 0; with ``context``, the tokens around it.

    A term of several brands is a mention of each; repeated rows of the watchlist count once.
    """
    watched = watchlist.select("term", "brand").where("term is not null and brand is not null").distinct()
    words = units.select(*keys, tokens().alias("words"))
    small = is_small(watched, terms, 1 << 20)
    if small:
        wanted = sorted({r.term for r in watched.select("term").collect()})  # up to ``terms`` rows
        hit = lambda w: w.isin(wanted) if wanted else F.lit(False)
        places = F.filter(F.transform("words", lambda w, i: F.when(hit(w), i + 1)), lambda i: i.isNotNull())
    else:
        places = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words")))
    around = [] if not context else [
        lambda i: F.slice("words", F.greatest(i - context, F.lit(1)), F.least(i - 1, F.lit(context))).alias("before"),
        lambda i: F.slice("words", i + 1, F.lit(context)).alias("after"),
    ]
    cut = F.transform(places, lambda i: F.struct((i - 1).cast("long").alias("position"), F.get("words", i - 1).alias("term"), *(f(i) for f in around)))
    found = words.select(*keys, F.explode(cut).alias("hit")).select(*keys, "hit.*")
    found = found.join(F.broadcast(watched) if small else watched.hint("merge"), "term")
    return found.select(*keys, "brand", "term", "position", *(["before", "after"] if context else []))


def share_of_voice(found: DataFrame, by: str) -> DataFrame:
    """Mentions, mentioning units and share of mentions of each brand within ``by``."""
    per_unit = found.groupBy(by, "brand", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    totals = per_unit.groupBy(by, "brand").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("units"))
    share = F.col("mentions") / F.sum("mentions").over(W.partitionBy(by))
    return totals.withColumn("share", F.round(share, 6))


def co_mentions(found: DataFrame) -> DataFrame:
    """Units that name both of two brands; a unit has no more brands than the watchlist."""
    brands = found.select("doc_id", "brand").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("brand")).alias("brands")).where(F.size("brands") > 1)
    pairs = brands.select(F.posexplode("brands").alias("at", "a"), "brands").select("a", F.explode(F.slice("brands", F.col("at") + 2, F.size("brands"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("units"))


def mention_context(units: DataFrame, watchlist: DataFrame, k: int = 3) -> DataFrame:
    """The k tokens on each side of each mention."""
    found = mentions(units, watchlist, context=k)
    return found.select("doc_id", "brand", "position", F.concat_ws(" ", "before").alias("before"), F.concat_ws(" ", "after").alias("after"))


def _context_words(found: DataFrame) -> DataFrame:
    """How often each word stands around each brand's mentions."""
    return found.select("brand", F.explode(F.concat("before", "after")).alias("word")).groupBy("brand", "word").agg(F.count(F.lit(1)).alias("n"))


def mention_opinion(found: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mean weight of the lexicon's words around each brand's mentions, and their number.

    Words are counted first, and counts are held against the lexicon; a word with several weights
    counts with each. Weights that are null match nothing.
    """
    rated = lexicon.select("word", "weight").where("word is not null and weight is not null")
    near = _context_words(found).join(beside(rated), "word")
    return near.groupBy("brand").agg(F.sum("n").alias("n_words"), F.round(F.sum(F.col("n") * F.col("weight")) / F.sum("n"), 6).alias("opinion"))


def distinctive_terms(found: DataFrame, k: int = 5) -> DataFrame:
    """Words over-used near a brand against the other brands: log-odds with a Dirichlet prior.

    The prior of a word is its number over all contexts (Monroe, Colaresi and Quinn, 2008). Contexts are
    counted once and the counts kept: a row for each brand and word. A word's rows are as many as brands
    at most, so its prior is a sum over a small window. Where a word is all that stands near any brand
    its score is 0.
    """
    counts = kept(_context_words(found).select("brand", "word", F.col("n").cast("double").alias("y")))
    brands = counts.groupBy("brand").agg(F.sum("y").alias("n"))
    total = brands.agg(F.sum("n").alias("all"))
    rows = counts.withColumn("prior", F.sum("y").over(W.partitionBy("word"))).join(beside(brands), "brand").join(F.broadcast(total))  # one row
    y, other = F.col("y") + F.col("prior"), F.col("prior") - F.col("y") + F.col("prior")
    rest = F.col("all") - F.col("n") + F.col("all") - other
    odds = F.when(rest > 0, F.log(y / (F.col("n") + F.col("all") - y)) - F.log(other / rest)).otherwise(0.0)
    scored = rows.withColumn("score", F.round(odds / F.sqrt(1 / y + 1 / other), 6))
    place = F.row_number().over(W.partitionBy("brand").orderBy(F.desc("score"), "word"))
    return scored.withColumn("place", place.cast("long")).where(F.col("place") <= k).select("brand", "place", "word", "score")


def conversation_first_mention(conversations: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Which role names a brand first in each conversation, and at which turn."""
    found = mentions(conversations, watchlist, ("conv_id", "turn", "role"))
    return found.groupBy("conv_id", "brand").agg(F.min("turn").alias("turn"), F.min_by("role", F.struct("turn", "role")).alias("role"))


def labelled_voice(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Mentions and units by brand, quality and toxicity; unlabelled units are a class of their own."""
    per_unit = found.groupBy("brand", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    quality = F.when(F.col("quality") > 0, "good").when(F.col("quality") == 0, "poor").otherwise("unlabelled")
    toxic = F.when(F.col("toxic") > 0, "toxic").when(F.col("toxic") == 0, "clean").otherwise("unlabelled")
    return per_unit.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left").groupBy("brand", quality.alias("quality"), toxic.alias("toxicity")).agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("units"))
