"""Text jobs and their SQL twins."""

from __future__ import annotations

from brandweave.operators import mentions as op
from brandweave.sources.tables import LEXICON, WATCHLIST, lexicon, read, watchlist

_LISTS = f"""
WITH watchlist(term, brand) AS (VALUES {", ".join(f"('{t}', '{b}')" for t, b in WATCHLIST)}),
lexicon(word, weight) AS (VALUES {", ".join(f"('{w}', {n})" for w, n in LEXICON)}),
words AS (SELECT *, regexp_extract_all(lower(text), '\\p{{L}}+') AS words FROM documents),
"""
_MENTIONS = _LISTS + """
spread AS (SELECT doc_id, source, words, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS position FROM words),
mentions AS (SELECT * FROM spread JOIN watchlist USING (term)),
context AS (
  SELECT doc_id, brand, position, list_slice(words, greatest(position - 2, 1), position) AS before, list_slice(words, position + 2, position + 4) AS after
  FROM mentions),
near AS (SELECT brand, unnest(list_concat(before, after)) AS word FROM context)
"""


def _found(spark, d, context=0):
    return op.mentions(read(spark, d, "documents"), watchlist(spark), ("doc_id", "source"), context)


QUERIES = {
    "mentions": lambda spark, d: op.mentions(read(spark, d, "documents"), watchlist(spark)),
    "share_of_voice": lambda spark, d: op.share_of_voice(_found(spark, d), "source"),
    "co_mentions": lambda spark, d: op.co_mentions(_found(spark, d)),
    "mention_context": lambda spark, d: op.mention_context(read(spark, d, "documents"), watchlist(spark)),
    "mention_opinion": lambda spark, d: op.mention_opinion(_found(spark, d, 3), lexicon(spark)),
    "distinctive_terms": lambda spark, d: op.distinctive_terms(_found(spark, d, 3)),
    "conversation_first_mention": lambda spark, d: op.conversation_first_mention(read(spark, d, "conversations"), watchlist(spark)),
    "labelled_voice": lambda spark, d: op.labelled_voice(_found(spark, d), read(spark, d, "labels")),
}

ORACLES = {
    "mentions": _MENTIONS + "SELECT doc_id, brand, term, position FROM mentions",
    "share_of_voice": _MENTIONS + """
        SELECT source, brand, count(*) AS mentions, count(DISTINCT doc_id) AS units, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share
        FROM mentions GROUP BY source, brand""",
    "co_mentions": _MENTIONS + """, held AS (SELECT DISTINCT doc_id, brand FROM mentions)
        SELECT x.brand AS a, y.brand AS b, count(*) AS units FROM held x JOIN held y USING (doc_id) WHERE x.brand < y.brand GROUP BY ALL""",
    "mention_context": _MENTIONS + "SELECT doc_id, brand, position, array_to_string(before, ' ') AS before, array_to_string(after, ' ') AS after FROM context",
    "mention_opinion": _MENTIONS + """
        SELECT brand, count(*) AS n_words, round(sum(weight) / count(*), 6) AS opinion FROM near JOIN lexicon USING (word) GROUP BY brand""",
    "distinctive_terms": _MENTIONS + """,
        counts AS (SELECT brand, word, count(*)::DOUBLE AS y FROM near GROUP BY ALL),
        rated AS (
          SELECT brand, word, y + prior AS yi, 2 * prior - y AS yj, n, every
          FROM counts JOIN (SELECT word, sum(y) AS prior FROM counts GROUP BY word) USING (word)
          JOIN (SELECT brand, sum(y) AS n FROM counts GROUP BY brand) USING (brand), (SELECT sum(y) AS every FROM counts)),
        scored AS (SELECT brand, word, round((ln(yi / (n + every - yi)) - ln(yj / (every - n + every - yj))) / sqrt(1 / yi + 1 / yj), 6) AS score FROM rated)
        SELECT * FROM (SELECT brand, row_number() OVER (PARTITION BY brand ORDER BY score DESC, word) AS place, word, score FROM scored) WHERE place <= 5""",
    "conversation_first_mention": f"""
        WITH watchlist(term, brand) AS (VALUES {", ".join(f"('{t}', '{b}')" for t, b in WATCHLIST)}),
        found AS (
          SELECT DISTINCT conv_id, turn, role, brand
          FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM conversations) JOIN watchlist USING (term))
        SELECT conv_id, brand, turn, role FROM (
          SELECT *, row_number() OVER (PARTITION BY conv_id, brand ORDER BY turn, role) AS place FROM found) WHERE place = 1""",
    "labelled_voice": _MENTIONS + """
        SELECT brand, CASE WHEN quality > 0 THEN 'good' WHEN quality = 0 THEN 'poor' ELSE 'unlabelled' END AS quality,
               CASE WHEN toxic > 0 THEN 'toxic' WHEN toxic = 0 THEN 'clean' ELSE 'unlabelled' END AS toxicity,
               count(*) AS mentions, count(DISTINCT doc_id) AS units
        FROM mentions LEFT JOIN labels USING (doc_id) GROUP BY 1, 2, 3""",
}
