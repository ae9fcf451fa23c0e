"""Approximate nearest neighbours by inner product with score-aware anisotropic quantisation.

Directions (vectors divided by their norms) are product-quantised with 16 codewords for each pair of
dimensions. Codewords and codes minimise a loss that weighs the residual along the vector more than
the residual across it, since only the former moves large inner products; the weights follow from a
threshold on the cosine. Codes are found by coordinate descent over the subspaces.

The index holds every row: norm, packed four-bit codes, the vector itself, and its number in the task
that made it, by which rows that share an id, equal ones too, are dealt to different blocks. It is stored and dealt by hash
into blocks; queries are dealt into groups. All queries meet all rows, so what is moved is each row
once for each group and each query once for each block: both are as large as a task can hold, and
each task and each partition of the results keeps k rows of a query only. A task scans one block for
one group: tables of partial
inner products, one for each byte of two codes, are summed over the codes, and each query's best
rows by these sums are scored exactly from the vectors, and so are all others whose sums, with a margin
for what their codes leave out, might still reach the k-th: among near copies the sums alone say little.
Copies of a vector count once in the scan and
stand for as many of their smallest ids as a result can hold. Codebooks are fitted to a bounded
sample; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brandweave.llm.common import Scratch, small_batches, stored, table

#: The bound of the sample that codebooks are fitted to: rows in the order of a hash of vec_id.
SAMPLE = 20_000
#: Blocks hold at most so many rows, and fewer where that gives all cores work; groups at most so many queries.
BLOCK_ROWS = 65_536
LEAST_ROWS = 4096
GROUP_QUERIES = 16_384
RERANKED = 96
#: Rows are scored exactly if their sums are less than so many standard errors below the k-th score.
MARGIN = 3.0
CODES = 16
INDEX = "vec_id long, vector array<float>, norm double, codes binary, salt long"
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Codebooks:
    """(subspaces, 16, 2) codewords for directions of ``dim`` dimensions, and the loss's weight."""

    words: np.ndarray
    dim: int
    parallel: float

    @property
    def subspaces(self) -> int:
        return len(self.words)


def parallel_weight(dim: int, threshold: float) -> float:
    """Weight of the squared parallel residual against the orthogonal one, for the given cosine."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _split(directions: np.ndarray) -> np.ndarray:
    """(n, dim) to (n, subspaces, 2); an odd last dimension is filled with 0."""
    n, dim = directions.shape
    if dim % 2:
        directions = np.concatenate([directions, np.zeros((n, 1))], axis=1)
    return directions.reshape(n, -1, 2)


def assign(parts: np.ndarray, words: np.ndarray, parallel: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n, subspaces) that lower the anisotropic loss, from the nearest codewords on."""
    n, m, _ = parts.shape
    own = np.einsum("nmd,nmd->nm", parts, parts)
    cross = np.einsum("nmd,mkd->nmk", parts, words)
    square = own[:, :, None] - 2 * cross + np.einsum("mkd,mkd->mk", words, words)[None]
    along = own[:, :, None] - cross
    codes = square.argmin(axis=2)
    at = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[at, j, codes[:, j]]
            codes[:, j] = (square[:, j] + (parallel - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(axis=1)
            total = rest + along[at, j, codes[:, j]]
    return codes.astype(np.uint8)


def fit(sample: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 5) -> Codebooks:
    """Codebooks for the directions of the sampled vectors (n, dim)."""
    dim = sample.shape[1]
    parts = _split(sample / np.linalg.norm(sample, axis=1, keepdims=True))
    n, m, _ = parts.shape
    parallel = parallel_weight(dim, threshold)
    rng = np.random.default_rng(seed)
    words = parts[rng.integers(0, n, CODES)].transpose(1, 0, 2).copy()
    words += rng.normal(0, 1e-6, words.shape)
    for turn in range(rounds):
        codes = assign(parts, words, parallel if turn >= rounds // 2 else 1.0)
        weight = parallel - 1 if turn >= rounds // 2 else 0.0
        along = np.einsum("nmd,nmd->nm", parts - words[np.arange(m), codes], parts)
        total = along.sum(axis=1)
        for j in range(m):
            x = parts[:, j]
            lead = total - along[:, j] + np.einsum("nd,nd->n", x, x)
            for k in range(CODES):
                mine = codes[:, j] == k
                if not mine.any():
                    words[j, k] = x[rng.integers(0, n)]
                    continue
                own = x[mine]
                left = len(own) * np.eye(2) + weight * own.T @ own
                words[j, k] = np.linalg.solve(left, own.sum(axis=0) + weight * (lead[mine][:, None] * own).sum(axis=0))
            new = np.einsum("nd,nd->n", x - words[j, codes[:, j]], x)
            total += new - along[:, j]
            along[:, j] = new
    return Codebooks(words, dim, parallel)


def _usable(column: str) -> Column:
    """Vectors that take part: not null, not empty, all components finite, not all 0."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part; a null vec_id does not."""
    rows = small_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & _usable("vector"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dim)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in each byte; an odd last one stands alone."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), dtype=np.uint8)], axis=1)
    return codes[:, ::2] | codes[:, 1::2] << 4


def build(vectors: DataFrame, sample_rows: int = SAMPLE, threshold: float = 0.2, scratch: Scratch | None = None) -> tuple[DataFrame, Codebooks | None]:
    """The stored index of all usable rows and its codebooks; None where there are none. With a
    ``scratch`` the index goes when that does.

    All vectors have the dimension that most rows have, of equals the smaller; others take no part.
    """
    rows = usable(vectors)
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return rows.select("vec_id", "vector", F.lit(0.0).alias("norm"), F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("salt")), None
    dim = common.dim
    rows = rows.where(F.size("vector") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample_rows).toArrow()
    books = fit(_matrix(sample["vector"].combine_chunks(), dim).astype(np.float64), threshold)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(1), dim).astype(np.float64)
                norms = np.linalg.norm(x, axis=1)
                codes = pack_codes(assign(_split(x / norms[:, None]), books.words, books.parallel))
                salt = pa.array(np.arange(before, before + part.num_rows))
                before += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(norms), pa.array([c.tobytes() for c in codes], type=pa.binary()), salt], names=["vec_id", "vector", "norm", "codes", "salt"])

    index = rows.mapInArrow(encode, INDEX)
    return (scratch.stored(index, "index") if scratch else stored(index, "index")), books


def tables(queries: np.ndarray, books: Codebooks) -> np.ndarray:
    """(bytes, 256, queries) partial inner products of every byte of two codes."""
    parts = _split(queries)
    single = np.einsum("qmd,mkd->mkq", parts, books.words).astype(np.float32)
    if len(single) % 2:
        single = np.concatenate([single, np.zeros((1, *single.shape[1:]), dtype=np.float32)])
    low, high = single[::2], single[1::2]
    return (high[:, :, None, :] + low[:, None, :, :]).reshape(len(low), 256, -1)


def decoded(packed: np.ndarray, books: Codebooks) -> np.ndarray:
    """The directions that packed codes stand for."""
    codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)[:, : books.subspaces]
    return books.words[np.arange(books.subspaces), codes].reshape(len(packed), -1)[:, : books.dim]


def scan_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, norms: np.ndarray, codes: np.ndarray, books: Codebooks, k: int, reranked: int) -> list[tuple[np.ndarray, ...]]:
    """For each query its k best rows of the block, by exact inner product, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    vectors, ids, norms, codes = vectors[order], ids[order], norms[order], codes[order]
    _, first, back = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1])))[:, 0], return_index=True, return_inverse=True)
    by_vector = np.argsort(back, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(back))])
    out = []
    exact = vectors[first].astype(np.float64)
    scale, packed = norms[first].astype(np.float32)[:, None], codes[first]
    # rows of the query's own id are left out, so as many more must be kept
    wanted = k + np.searchsorted(ids, query_ids, side="right") - np.searchsorted(ids, query_ids, side="left")
    doubt = (np.linalg.norm(exact - decoded(packed, books) * norms[first][:, None], axis=1) / np.sqrt(books.dim)).astype(np.float32)
    for at in range(0, len(queries), 64):
        q = queries[at : at + 64].astype(np.float64)
        lut, lengths = tables(q, books), np.linalg.norm(q, axis=1)
        sums = np.zeros((len(first), len(q)), dtype=np.float32)
        for j in range(packed.shape[1]):
            sums += lut[j][packed[:, j]]
        sums *= scale
        keep = min(len(first), max(reranked, int(wanted[at : at + 64].max())))
        best = np.argpartition(-sums, keep - 1, axis=0)[:keep].T if keep < len(first) else np.tile(np.arange(len(first)), (len(q), 1))
        scores = np.einsum("qrd,qd->qr", exact[best], q)
        for i in range(len(q)):
            rows, score, want = best[i], scores[i], int(wanted[at + i])
            last = np.sort(score)[-min(want, len(score))]
            if keep < len(first):
                more = np.flatnonzero(sums[:, i] + MARGIN * lengths[i] * doubt >= last)
                rows = np.union1d(rows, more)
                score = np.einsum("rd,d->r", exact[rows], q[i])
                last = np.sort(score)[-min(want, len(score))]
            found = [(by_vector[starts[u] : min(starts[u] + want, starts[u + 1])], s) for u, s in zip(rows[score >= last], score[score >= last], strict=True)]
            mine = ids[np.concatenate([f for f, _ in found])]
            score = np.concatenate([np.full(len(f), s) for f, s in found])
            other = mine != query_ids[at + i]
            mine, score = mine[other], score[other]
            top = np.lexsort((mine, -score))[:k]
            out.append((np.full(len(top), query_ids[at + i]), mine[top], score[top]))
    return out


def search(index: DataFrame, books: Codebooks | None, queries: DataFrame, k: int = 20, reranked: int = RERANKED, block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found.

    ``queries`` are usable (vec_id, vector); of rows with the same id the smallest vector, component by
    component, is the query. A query's own id is no candidate; with fewer than k others, all are
    returned. As candidates, rows that share an id are rows of their own.
    """
    spark = index.sparkSession
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = queries.where(F.size("vector") == books.dim).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n = index.count()
    blocks = max(1, -(-n // block_rows), min(-(-n // LEAST_ROWS), spark.sparkContext.defaultParallelism))
    groups = max(1, -(-queries.count() // group_queries))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("block", dealt(blocks, "vec_id", "salt")).drop("salt").withColumn("group", every(groups))
    right = queries.select("vec_id", "vector", dealt(groups, "vec_id", F.lit(2)).alias("group")).withColumn("block", every(blocks))

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows and asked.num_rows:
            codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1)
            vectors, q = _matrix(rows["vector"].combine_chunks(), books.dim), _matrix(asked["vector"].combine_chunks(), books.dim)
            parts = scan_block(q, asked["vec_id"].to_numpy(), vectors, rows["vec_id"].to_numpy(), rows["norm"].to_numpy(), codes, books, k, reranked)
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.empty(0, dtype=t) for t in ("i8", "i8", "f8")]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(run, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    with Scratch(spark) as scratch:
        index, books = build(vectors, scratch=scratch)
        return stored(search(index, books, usable(vectors).where(F.col("vec_id") % 20 == 0)), "neighbours", small=True)
