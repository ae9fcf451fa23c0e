"""Ranked lexical search of many items at once, with work that items share done once.

Items come in blocks of a bounded size. Texts are read once for each block: every document becomes its
number of terms and the counts of those terms that some item of the block asks for, and these rows are
stored; document frequencies and lengths are added up on the way. Then the block's items are turned
into a graph of sums. Terms that exactly the same items ask for are one node; as long as two items share two nodes or
more, the largest set of nodes that two items share is mined, gets a node of its own, and stands for
these nodes in every item that holds them all. A node's accumulator, its part of the score of each
document of a batch, is made once from those below it, in the order of the graph, and serves all items
and nodes above it. Each task keeps every item's best documents only; these are ranked by item.

All scores are 64-bit integers. Two terms are equal when their 64-bit hashes are.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brandweave.llm.common import LOWER, Scratch, classes, hash_words, slices, small_batches, stored, table, tidy, utf8

#: Terms are runs of ASCII digits and letters and of all bytes from 80 up.
KINDS = classes(words=bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: A block has about so many items, or bytes of their texts; both go to the driver and all tasks.
ITEMS = 256
ITEM_BYTES = 4 << 20
#: Values of a batch's accumulators.
ACCUMULATED = 1 << 20
COUNTED = "doc_id long, n long, terms binary, counts binary, documents long, total long"


@dataclass
class Graph:
    """Sums that items share. Nodes 0 to ``len(atoms)`` - 1 add up terms, each further one the nodes of
    its ``parts``; ``items`` are the nodes of each item. A node comes after all that it is made of."""

    atoms: list[list[int]]
    parts: list[list[int]]
    items: list[list[int]]

    def additions(self) -> int:
        """Additions a document takes, besides those of the terms of an atom."""
        return sum(len(p) - 1 for p in self.parts) + sum(max(0, len(p) - 1) for p in self.items)


def graph_of(items: list[set[int]]) -> Graph:
    """Mines the sets that items share: the largest set of nodes that two items have in common, again and again."""
    holders: dict[int, list[int]] = defaultdict(list)
    for number, terms in enumerate(items):
        for term in terms:
            holders[term].append(number)
    alike: dict[tuple, list[int]] = defaultdict(list)
    for term in sorted(holders):
        alike[tuple(holders[term])].append(term)
    atoms = list(alike.values())
    nodes: list[set[int]] = [set() for _ in items]
    held: dict[int, set[int]] = {}
    for node, owners in enumerate(alike):
        held[node] = set(owners)
        for number in owners:
            nodes[number].add(node)
    parts: list[list[int]] = []
    heap: list[tuple[int, int, int]] = []

    def offer(a: int, others) -> None:
        shared: dict[int, int] = defaultdict(int)
        for node in nodes[a]:
            for b in held[node]:
                if b != a and b in others:
                    shared[b] += 1
        for b, n in shared.items():
            if n > 1:
                heapq.heappush(heap, (-n, min(a, b), max(a, b)))

    for a in range(len(items)):
        offer(a, range(a + 1, len(items)))
    while heap:
        n, a, b = heapq.heappop(heap)
        common = nodes[a] & nodes[b]
        if len(common) < 2:
            continue
        if len(common) < -n:
            heapq.heappush(heap, (-len(common), a, b))
            continue
        new = len(atoms) + len(parts)
        parts.append(sorted(common))
        owners = set.intersection(*(held[node] for node in common))
        for number in owners:
            nodes[number] -= common
            nodes[number].add(new)
        for node in common:
            held[node] -= owners
        held[new] = owners
    return Graph(atoms, parts, [sorted(x) for x in nodes])


def terms_of(texts: list[bytes]) -> list[np.ndarray]:
    """The different terms of each text, as ascending hashes."""
    words, n = hash_words(texts, KINDS, LOWER)
    ends = np.cumsum(n)
    return [np.unique(words[a:b]) for a, b in zip(ends - n, ends, strict=True)]


def _count(vocabulary: np.ndarray):
    """Every document's number of terms and its counts of the vocabulary, and at a task's end its sums."""
    names = [x.split()[0] for x in COUNTED.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, documents, total = np.zeros(len(vocabulary), dtype=np.int64), 0, 0
        for part in slices(batches):
            words, n = hash_words(part.column(1).to_pylist(), KINDS, LOWER)
            at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            here = vocabulary[at] == words
            of = np.repeat(np.arange(len(n), dtype=np.int64), n)[here]
            cells, counts = np.unique(of * len(vocabulary) + at[here], return_counts=True)
            of, term = np.divmod(cells, len(vocabulary))
            holding += np.bincount(term, minlength=len(vocabulary))
            documents, total = documents + int((n > 0).sum()), total + int(n.sum())
            ends = np.searchsorted(of, np.arange(1, len(n) + 1)).tolist()
            some = [(i, a, b) for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a]
            term, counts = term.astype("<u4"), counts.astype("<u4")
            none = pa.nulls(len(some), type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array([i for i, _, _ in some], type=pa.int64())), pa.array(n[[i for i, _, _ in some]], type=pa.int64()), pa.array([term[a:b].tobytes() for _, a, b in some], type=pa.binary()), pa.array([counts[a:b].tobytes() for _, a, b in some], type=pa.binary()), none, none], names=names
            )
        held = np.flatnonzero(holding)
        if documents:
            rows = ([None], [None], [held.astype("<u4").tobytes()], [holding[held].astype("<i8").tobytes()], [documents], [total])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(rows, kinds, strict=True)], names=names)

    return tidy(run)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of tasks' sums; terms -1 and -2 stand for documents and all terms."""
    for batch in batches:
        for terms, counts, documents, total in zip(*(batch.column(c).to_pylist() for c in ("terms", "counts", "documents", "total")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], np.frombuffer(terms, dtype="<u4").astype(np.int64)])), pa.array(np.concatenate([[documents, total], np.frombuffer(counts, dtype="<i8")]))], names=["term", "n"])


def weights_of(documents: int, frequencies: np.ndarray) -> np.ndarray:
    """A weight for each document frequency."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequencies.tolist()], dtype=np.int64)


def accumulate(graph: Graph, terms: np.ndarray) -> list[np.ndarray]:
    """Each item's scores, of rows of term scores by document. Every node is added up once."""
    zero = np.zeros(terms.shape[1], dtype=np.int64)
    nodes = [terms[a[0]] if len(a) == 1 else terms[a].sum(axis=0) for a in graph.atoms]
    add = lambda own: sum((nodes[p] for p in own[1:]), nodes[own[0]]) if own else zero
    for parts in graph.parts:
        nodes.append(add(parts))
    return [add(own) for own in graph.items]


def _best(graph: Graph, weights: np.ndarray, documents: int, total: int, k: int):
    """Each item's k best documents of a task: (item, doc_id, score)."""
    size = max(64, ACCUMULATED // max(1, len(weights) + len(graph.parts) + len(graph.items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, dtype=np.int64)
        best, least = (empty, empty, empty.astype(bool), empty), np.ones(len(graph.items), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, n = part.column(0), part.column(1).to_numpy()
                m = 10 + (90 * n * documents) // total
                held = [np.frombuffer(b, dtype="<u4") for b in part.column(2).to_pylist()]
                counts = np.concatenate([np.frombuffer(b, dtype="<u4") for b in part.column(3).to_pylist()]).astype(np.int64)
                of, term = np.repeat(np.arange(len(n)), [len(x) for x in held]), np.concatenate(held)
                scores = np.zeros((len(weights), len(n)), dtype=np.int64)
                scores[term, of] = weights[term] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[of]))
                made = np.stack(accumulate(graph, scores))
                item, doc = np.nonzero(made >= least[:, None])
                blank = ids.is_null().to_numpy(zero_copy_only=False)
                key = ids.fill_null(0).to_numpy()
                found = [np.concatenate(x) for x in zip(best, (item, made[item, doc], blank[doc], key[doc]), strict=True)]
                order = np.lexsort((found[3], found[2], -found[1], found[0]))
                found = [x[order] for x in found]
                first = np.searchsorted(found[0], np.arange(len(graph.items)))
                keep = np.arange(len(order)) - first[found[0]] < k
                best = tuple(x[keep] for x in found)
                ends = np.searchsorted(best[0], np.arange(len(graph.items)), side="right")
                full = np.bincount(best[0], minlength=len(graph.items)) == k
                least[full] = best[1][ends[full] - 1]
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[3], mask=best[2]), pa.array(best[1])], names=["item", "doc_id", "score"])

    return tidy(run)


def search(documents: DataFrame, items: DataFrame, k: int = 10, block_items: int = ITEMS) -> DataFrame:
    """Each item's k best documents with a score above 0: item_id, rank, doc_id, score.

    Every row of ``items`` (item_id, text) is an item of its own and every row of ``documents`` (doc_id, text)
    a document, repeated ones and such with null ids too; equal scores rank by doc_id, null last. Null and
    empty texts have no terms: such documents are found by nothing and such items find nothing. Further
    columns are not looked at. Without items or documents the result is empty. It is stored in the shared
    folder.

    A block is what a hash of an item's id and text deals to it; blocks are as many as make them about
    ``block_items`` items or ITEM_BYTES bytes of text.
    """
    spark = documents.sparkSession
    rows, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    blocks = max(1, math.ceil(rows / block_items), math.ceil(size / ITEM_BYTES))
    dealt = items.select(F.col("item_id").cast("long"), utf8().alias("text"), F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    texts = small_batches(documents).select(F.col("doc_id").cast("long"), utf8().alias("text"))
    found = [_block(spark, texts, dealt.where(F.col("block") == i).collect(), k) for i in range(blocks)]
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _block(spark: SparkSession, texts: DataFrame, items: list, k: int) -> DataFrame | None:
    """The results of a block of items, stored."""
    items = sorted(items, key=lambda r: (r.item_id is None, r.item_id or 0, bytes(r.text)))
    own = terms_of([bytes(r.text) for r in items])
    vocabulary = np.unique(np.concatenate(own)) if own else np.empty(0, dtype=np.uint64)
    if not len(vocabulary):
        return None
    graph = graph_of([set(np.searchsorted(vocabulary, x).tolist()) for x in own])
    with Scratch(spark) as scratch:
        counted = scratch.stored(texts.mapInArrow(_count(vocabulary), COUNTED), "counted")
        sums = counted.where("documents is not null").select("terms", "counts", "documents", "total").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        held = dict(map(tuple, sums.collect()))  # a row for each term of the block
        if not held.get(-1):
            return None
        frequencies = np.array([held.get(i, 0) for i in range(len(vocabulary))], dtype=np.int64)
        best = counted.where("documents is null").mapInArrow(_best(graph, weights_of(held[-1], frequencies), held[-1], held[-2], k), "item long, doc_id long, score long")
        place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        ranked = best.withColumn("rank", place).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item long, item_id long")
        return stored(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "ranked", small=True)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
OP13_SQL = f"""
WITH held AS (SELECT row_number() OVER () AS row_no, doc_id, {_TERMS} AS terms FROM documents),
sums AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS docs, sum(len(terms))::BIGINT AS every FROM held),
asked AS (SELECT row_number() OVER () AS item_no, item_id, list_distinct({_TERMS}) AS terms FROM benchmark),
wanted AS (SELECT item_no, item_id, unnest(terms) AS term FROM asked),
counts AS (
  SELECT row_no, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT row_no, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM held) SEMI JOIN wanted USING (term) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, sums GROUP BY term),
parts AS (
  SELECT row_no, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // every))) AS part FROM counts JOIN weights USING (term), sums),
scores AS (SELECT item_no, item_id, row_no, doc_id, sum(part)::BIGINT AS score FROM wanted JOIN parts USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""
