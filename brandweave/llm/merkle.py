"""Merkle manifests of datasets: every row a leaf, a tree for each source, a tree over the sources.

Leaves get their places by a range sort and sums over its partitions, so a source of most rows is
spread like any. A level is built by joins of its nodes with themselves: each node computes the places
of its siblings (for width 2 the place with its last bit turned, else slots shifted within the run)
and meets them by an equi-join on source and place; the rows of slot 0 then give the nodes of the next
level. Proofs come down again, one equi-join with the parents a level, where only digests and never
texts move. Levels are as many as the largest source needs; that number is all that the driver learns
of them, besides the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brandweave.functions.shared import beside
from brandweave.llm.common import Scratch, stored, table

WIDTH = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<slot:int,siblings:binary>>"


def hashed(*texts: Column) -> Column:
    """H: the lower-case hex SHA-256 of texts one after the other."""
    return F.sha2(F.concat(*texts) if len(texts) > 1 else texts[0], 256)


def hex_of(digests: Column) -> Column:
    """Binary digests, one after the other, as hex text."""
    return F.lower(F.hex(digests))


def leaf(values: list[Column]) -> Column:
    """The leaf of a row: each value as ``-`` if null, else its UTF-8 length, a colon and itself."""
    own = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return hashed(*(own(v.cast("string")) for v in values))


def placed(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 within ``grp`` in the given order, and ``n``, the rows of it.

    Rows are sorted by range over partitions and numbered there; the number of a group's rows in each
    partition, at most a row for each group and partition, gives the rest.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    spread = scratch.stored(spread.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "placed")
    sums = spread.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    group = W.partitionBy("grp")
    before = F.sum("held").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("held")
    starts = sums.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(group).alias("n"))
    return spread.join(beside(starts), ["grp", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def level_of(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes (grp, idx, n, digest, ...) of groups of several with ``siblings``: the digests of the rest of
    their run, left to right."""
    slot, run = F.col("idx") % width, F.floor(F.col("idx") / width) * width
    out = live = nodes.where("n > 1")
    shifts = range(1, width)
    for j in shifts:
        beside_it = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if width == 2 else run + (slot + j) % width
        other = live.select(F.col("grp").alias("g"), F.col("idx").alias("i"), F.col("digest").alias(f"d{j}"))
        out = out.join(other, (F.col("grp") == F.col("g")) & (beside_it == F.col("i")), "left").drop("g", "i")
    found = F.array_sort(F.array(*(F.struct(((slot + j) % width).alias("s"), F.col(f"d{j}").alias("d")) for j in shifts)))
    joined = F.aggregate(F.filter(found, lambda x: x["d"].isNotNull()), F.lit(b""), lambda a, x: F.concat(a, x["d"]))
    return out.withColumn("siblings", joined).drop(*(f"d{j}" for j in shifts))


def parents(level: DataFrame, width: int) -> DataFrame:
    """What the rows of slot 0 give: the nodes of the next level."""
    digest = F.unhex(hashed(hex_of(F.concat("digest", "siblings"))))
    return level.where(F.col("idx") % width == 0).select("grp", F.floor(F.col("idx") / width).alias("idx"), F.ceil(F.col("n") / width).alias("n"), digest.alias("digest"))


def _levels(nodes: DataFrame, width: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels from the leaves up, and (grp, height, digest) of each group's last node."""
    largest = nodes.agg(F.max("n")).first()[0] or 1
    levels: list[DataFrame] = []
    ends = nodes.where("n = 1").select("grp", F.lit(0).alias("height"), "digest")
    while largest > 1:
        levels.append(scratch.stored(level_of(nodes, width), f"{name}-{len(levels)}", small=bool(levels)))
        nodes = parents(levels[-1], width)
        ends = ends.unionByName(nodes.where("n = 1").select("grp", F.lit(len(levels)).alias("height"), "digest"))
        largest = -(-largest // width)
    return levels, scratch.stored(ends, f"{name}-ends", small=True)


def _down(levels: list[DataFrame], ends: DataFrame, width: int) -> DataFrame:
    """(grp, idx, path, subroot and what else the leaves hold) of all leaves of groups of several.

    ends: (grp, height, subroot, path) of each group's last node. A path holds the slot and the siblings of
    each level, leaf first.
    """
    above = None
    for height in range(len(levels) - 1, -1, -1):
        over = ends.where(F.col("height") == height + 1).select(F.col("grp").alias("g"), F.lit(0).cast("long").alias("i"), "path", "subroot")
        if above is not None:
            over = over.unionByName(above.select(F.col("grp").alias("g"), F.col("idx").alias("i"), "path", "subroot"))
        own = levels[height].withColumn("own", F.struct((F.col("idx") % width).cast("int").alias("slot"), "siblings"))
        joined = own.join(over, (F.col("grp") == F.col("g")) & (F.floor(F.col("idx") / width) == F.col("i")))
        above = joined.withColumn("path", F.concat(F.array("own"), "path")).drop("own", "g", "i", "siblings", "n")
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings along its path."""

    def step(done: Column, at: Column) -> Column:
        before = at["slot"] * 32
        return hashed(hex_of(F.substr(at["siblings"], F.lit(1), before)), done, hex_of(F.substr(at["siblings"], before + 1)))

    return F.aggregate(path, start, step)


def manifest(leaves: DataFrame, scratch: Scratch, order: list[str], width: int = WIDTH) -> tuple[DataFrame, str | None]:
    """(leaves with subroot and path, root) of ``leaves``: grp string, leaf hex and what else they hold.

    ``grp`` must not be null; groups are ordered by its bytes. Equal leaves are leaves of their own. Without
    leaves there is no root. ``path`` leads from the leaf over its group's tree to the root.
    """
    nodes = placed(leaves.withColumn("digest", F.unhex("leaf")).drop("leaf"), [*order, "digest"], scratch)
    levels, ends = _levels(nodes, width, scratch, "level")
    tops = placed(ends.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "height", "digest"), ["of"], scratch)
    upper, last = _levels(tops, width, scratch, "top")
    end = last.first()
    if end is None:
        return leaves.limit(0).select("*", F.lit("").alias("subroot"), F.array().cast(PATH).alias("path")), None
    none = F.array().cast(PATH)
    found = tops.where("n = 1").select("grp", "of", "height", "digest", none.alias("path"))
    if upper:
        found = _down(upper, last.select("grp", "height", F.col("digest").alias("subroot"), none.alias("path")), width).select(*found.columns)
    over = scratch.stored(found.select(F.col("of").alias("grp"), "height", F.col("digest").alias("subroot"), "path"), "subroots", small=True)
    lone = nodes.where("n = 1").join(over, "grp").drop("n", "height")
    rows = lone.unionByName(_down(levels, over, width).select(*lone.columns)) if levels else lone
    return rows.select("*", hex_of(F.col("digest")).alias("leaf")).drop("digest", "idx").withColumn("subroot", hex_of(F.col("subroot"))), bytes(end.digest).hex()


def proofs(documents: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "source", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Leaf, subroot, root, proof and the root recomputed after tampering, of every row.

    Null values are part of a leaf as ``-``; a null source is a source, before all others; null keys stand
    before others and equal keys in the order of their leaves. Repeated rows are leaves of their own, with
    proofs of their own. Rows whose key has an even CRC-32 lose the line ends of their text, all others
    (those without a key or line ends, too) are checked as they are. The proof of a lone row is H of nothing. Further
    columns are not looked at. The result is stored in the shared folder.
    """
    spark = documents.sparkSession
    values = [F.col(f"`{c}`") for c in columns]
    tampered = F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains(F.col(f"`{text}`"), F.lit("\n")), F.lit(False))
    changed = [F.replace(v, F.lit("\n"), F.lit("")) if c == text else v for c, v in zip(columns, values, strict=True)]
    rows = documents.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("grp"),
        leaf(values).alias("leaf"),
        F.when(tampered, F.unhex(leaf(changed))).alias("changed"),
    )
    with Scratch(spark) as scratch:
        found, root = manifest(rows, scratch, ["doc_id"], width)
        again = folded(F.coalesce(hex_of(F.col("changed")), F.col("leaf")), F.col("path"))
        proof = hashed(F.array_join(F.transform("path", lambda x: hex_of(x["siblings"])), ""))
        out = found.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), again.alias("folded_root"))
        return stored(out.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of ``documents``, with a check of every row after tampering."""
    return proofs(table(spark, sf_dir, "documents"))


_LEAF = " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}"))
OP12_SQL = f"""
WITH RECURSIVE steps(b, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc(doc_id, k, c) AS (
  SELECT DISTINCT doc_id, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, crc.k + 1, xor(crc.c >> 8, s.c) FROM crc JOIN steps s ON s.k = 8 AND s.b = xor(crc.c & 255, ascii(substr(doc_id::VARCHAR, crc.k + 1, 1)))
  WHERE crc.k < length(doc_id::VARCHAR)),
even AS (SELECT doc_id AS id FROM crc WHERE k = length(doc_id::VARCHAR) AND xor(c, 4294967295) % 2 = 0),
leaves AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, sha256({_LEAF.format(text="text")}) AS leaf,
         CASE WHEN id IS NULL THEN sha256({_LEAF.format(text="text")}) ELSE sha256({_LEAF.format(text="replace(text, chr(10), '')")}) END AS changed
  FROM (SELECT doc_id, source, lang, n_chars, text FROM documents) d LEFT JOIN even ON doc_id = id),
places AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes(source, height, idx, n, digest) AS (
  SELECT source, 0, idx, n, leaf FROM places
  UNION ALL
  SELECT source, height + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY source, height, idx // 3, n),
ends AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(height, idx, n, digest) AS (
  SELECT 0, idx, n, subroot FROM ends
  UNION ALL
  SELECT height + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY height, idx // 3, n),
named AS (
  SELECT coalesce('s' || source, '') AS grp, height, idx, digest FROM nodes WHERE n > 1
  UNION ALL SELECT '', height + 1000, idx, digest FROM tops WHERE n > 1),
beside AS (
  SELECT a.grp, a.height, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lefts,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rights
  FROM named a LEFT JOIN named b ON a.grp = b.grp AND a.height = b.height AND a.idx // 3 = b.idx // 3 AND a.idx <> b.idx GROUP BY ALL),
walk(row_no, grp, height, idx, n, proof, fold) AS (
  SELECT row_no, coalesce('s' || source, ''), 0, idx, n, '', changed FROM places
  UNION ALL
  SELECT row_no, w.grp, w.height + 1, w.idx // 3, (w.n + 2) // 3, proof || lefts || rights, sha256(lefts || fold || rights)
  FROM walk w JOIN beside b ON w.grp = b.grp AND w.height = b.height AND w.idx = b.idx WHERE w.n > 1),
over(row_no, height, idx, n, proof, fold) AS (
  SELECT row_no, 1000, e.idx, e.n, proof, fold FROM walk w JOIN ends e ON w.grp = coalesce('s' || e.source, '') WHERE w.n = 1
  UNION ALL
  SELECT row_no, o.height + 1, o.idx // 3, (o.n + 2) // 3, proof || lefts || rights, sha256(lefts || fold || rights)
  FROM over o JOIN beside b ON b.grp = '' AND o.height = b.height AND o.idx = b.idx WHERE o.n > 1)
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.digest AS verified
FROM places p JOIN ends e ON p.source IS NOT DISTINCT FROM e.source JOIN over o ON o.row_no = p.row_no AND o.n = 1 JOIN tops t ON t.n = 1"""
