"""Vector jobs and their SQL twins."""

from __future__ import annotations

from brandweave.operators import vectors as op
from brandweave.sources.tables import read

QUERIES = {
    "nearest_groups": lambda spark, d: op.nearest_groups(read(spark, d, "embeddings")),
}

ORACLES = {
    "nearest_groups": """
        WITH usable AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
          WHERE list_count(embedding) = len(embedding) AND isfinite(list_sum(embedding)) AND (list_max(embedding) > 0 OR list_min(embedding) < 0)),
        spread AS (SELECT label, len(v) AS size, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM usable WHERE label IS NOT NULL),
        means AS (
          SELECT size, label, list(x ORDER BY place) AS mean
          FROM (SELECT size, label, place, avg(x) AS x FROM spread GROUP BY ALL) GROUP BY ALL),
        near AS (
          SELECT vec_id, m.label, round(list_cosine_similarity(v, mean), 6) AS cosine
          FROM usable JOIN means m ON m.size = len(v) AND (list_max(mean) > 0 OR list_min(mean) < 0))
        SELECT vec_id, rank, label, cosine FROM (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS rank FROM near) WHERE rank <= 3""",
}
