"""Exact Jaccard self-join on word shingles, with filters under several global token orders.

Texts with equal shingle sets are one node. Shingles are ordered by how common they are (classes of
powers of two, from a table of counts over all documents with a fixed number of cells), then by a
hash; several hashes give several global orders. Sets that reach the threshold share a token in
their prefixes under every one of these orders. Nodes meet in the buckets of their prefix tokens
under the first order; a pair stays if lengths and positions allow the overlap. Then the pair's
prefixes under all orders are compared, and only if every order allows the threshold do its sets
move: what two prefixes have in common, and all that stands behind the one that ends first, bounds
the overlap.

Only components are asked for, so a pair inside a known component need not be compared. First, each
bucket's node with the fewest rarer tokens is compared with the bucket's others, which links groups
of near copies by as many comparisons as they have members. Then all pairs of nodes that share a
bucket and lie in different components are compared; buckets are joined by token and by bands of
lengths, and large ones in several parts. No pair is left out by any cap.

Shingles equal in their 64-bit hashes count as the same. What is sent to the workers is of fixed
size: the table of classes, and a bit set of the nodes to be compared, which only saves work. A task
sends its counts of cells as bytes, and what goes beyond 255 apart, so a token that crowds into few tasks counts
as common as it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brandweave.llm.common import Scratch, hash_words, mix64, shingles, slices, small_batches, stored, table, tidy, utf8
from brandweave.llm.graph import components

WIDTH = 5
#: The threshold, as numerator and denominator.
THRESHOLD = (80, 100)
CELL_BITS = 22
#: Cells of one row of the table of counts.
ROW_BITS = 16
#: Tokens of this class and above (and three above the median), whose buckets may be long, get their
#: first node by aggregation.
COMMON_CLASS = 12
FILTER_BITS = 23
#: Tables of counts that are added up at a time.
MERGED = 64
#: Texts are picked by a broadcast table of their hashes if it can't have more rows than this.
PICKED = 500_000
#: Nodes of a bucket that are joined as one part.
PART_NODES = 2048
#: Odd multipliers of the orders after the first.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SKETCHED = "doc_id long, n long, fp long, text_hash long, row int, cells binary, counts binary"
NODES = "fp long, text_hash long, n long, prefix array<long>, others binary"


def sets_of(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Each text's different shingles, ascending."""
    words, counts = hash_words(texts)
    all_shingles, n = shingles(words, counts, width)
    ends = np.cumsum(n)
    for a, b in zip(ends - n, ends, strict=True):
        yield np.unique(all_shingles[a:b])


def fingerprint(own: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    total = mix64(own ^ np.uint64(0x5BD1E9955BD1E995)).sum(dtype=np.uint64)
    return int(mix64(np.array([total + np.uint64(len(own))], dtype=np.uint64)).view(np.int64)[0])


def _sketch(width: int):
    """Sets' sizes and fingerprints, and at the end of a task its counts of shingles by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        names = [x.split()[0] for x in SKETCHED.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        for part in slices(batches):
            found = list(sets_of(part.column(1).to_pylist(), width))
            np.add.at(cells, np.concatenate(found).astype(np.int64) & ((1 << CELL_BITS) - 1), 1)
            none = pa.nulls(part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in found], type=pa.int64()), pa.array([fingerprint(s) for s in found], type=pa.int64()), part.column(2), *(none.cast(t) for t in kinds[4:])], names=names
            )
        small = np.minimum(cells, 255).astype(np.uint8).reshape(-1, 1 << ROW_BITS)
        rows = []
        for i, counts in enumerate(small):
            at = np.flatnonzero(counts)
            if len(at) > len(counts) // 4:
                rows.append((i, b"", counts.tobytes()))
            elif len(at):
                rows.append((i, at.astype("<u2").tobytes(), counts[at].tobytes()))
            own = cells[i << ROW_BITS : (i + 1) << ROW_BITS]
            if len(over := np.flatnonzero(own > 255)):
                rows.append((i, over.astype("<u2").tobytes(), (own[over] - 255).astype("<u4").tobytes()))
        if rows:
            none = pa.nulls(len(rows), type=pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, *(pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds[4:], strict=True))], names=names)

    return run


def _added(group: pa.Table) -> pa.Table:
    """The sum of tables of counts of one row, of bytes or of 32-bit numbers."""
    total = np.zeros(1 << ROW_BITS, dtype=np.int64)
    for cells, counts, wide in zip(group["cells"].to_pylist(), group["counts"].to_pylist(), group["wide"].to_pylist(), strict=True):
        own = np.frombuffer(counts, dtype="<u4" if wide else np.uint8)
        if cells:
            total[np.frombuffer(cells, dtype="<u2")] += own
        else:
            total += own
    sums = np.minimum(total, (1 << 32) - 1).astype("<u4")
    return pa.table([pa.array([group["row"][0].as_py()], type=pa.int32()), pa.array([group["part"][0].as_py()], type=pa.int32()), pa.array([b""]), pa.array([sums.tobytes()]), pa.array([True])], names=["row", "part", "cells", "counts", "wide"])


def _classes(sketch: DataFrame, scratch: Scratch) -> np.ndarray:
    """By cell, the power of two below its count; tables of counts are added up MERGED at a time."""
    # cells take 2 bytes each; counts 1, or 4 where they are what goes beyond a byte
    wide = (F.octet_length("cells") > 0) & (F.octet_length("counts") == 2 * F.octet_length("cells"))
    tables = sketch.where("row is not null").select("row", "part", "cells", "counts", wide.alias("wide"))
    parts = (tables.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // MERGED)
        tables = tables.withColumn("part", F.col("part") % parts).groupBy("row", "part").applyInArrow(_added, "row int, part int, cells binary, counts binary, wide boolean")
        if parts == 1:
            break
        tables = scratch.stored(tables, "counts", small=True)

    def powers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.log2(np.maximum(np.frombuffer(c, dtype="<u4"), 1)).astype(np.uint8).tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, type=pa.binary())], names=["row", "classes"])

    out = np.zeros((1 << (CELL_BITS - ROW_BITS), 1 << ROW_BITS), dtype=np.uint8)
    for row in tables.select("row", "counts").mapInArrow(powers, "row int, classes binary").collect():
        out[row.row] = np.frombuffer(row.classes, dtype=np.uint8)
    return out.ravel()


def ordered(own: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set's tokens under the first order: class in the upper 6 bits, hash below; ascending."""
    kind = classes[(own & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort(kind << np.uint64(58) | mix64(own) >> np.uint64(6))


def reordered(tokens: np.ndarray, multiplier: int) -> np.ndarray:
    """The same tokens' keys under another order of the same classes, ascending."""
    with np.errstate(over="ignore"):
        return np.sort(tokens & ~np.uint64((1 << 58) - 1) | mix64(tokens * np.uint64(multiplier)) >> np.uint64(6))


def prefix_length(n: int, threshold: tuple[int, int]) -> int:
    """Tokens of which a partner must share one: n - ceil(t n) + 1."""
    return n - -(-threshold[0] * n // threshold[1]) + 1 if n else 0


def short_prefix(tokens: np.ndarray, multiplier: int, length: int) -> np.ndarray:
    """The prefix under another order, as the upper halves of its keys, ascending."""
    return (reordered(tokens, multiplier)[:length] >> np.uint64(32)).astype("<u4")


def _prefixes(width: int, threshold: tuple[int, int], classes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            rows = []
            for own, text_hash in zip(sets_of(part.column(0).to_pylist(), width), part.column(1).to_pylist(), strict=True):
                if len(own):
                    tokens, p = ordered(own, classes), prefix_length(len(own), threshold)
                    rows.append((fingerprint(own), text_hash, len(own), tokens[:p].view(np.int64), b"".join(short_prefix(tokens, m, p).tobytes() for m in ORDERS)))
            fps, hashes, sizes, prefixes, others = zip(*rows, strict=True) if rows else ([],) * 5
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if rows else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps, type=pa.int64()), pa.array(hashes, type=pa.int64()), pa.array(sizes, type=pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array(others, type=pa.binary())],
                names=[x.split()[0] for x in NODES.split(", ")],
            )

    return run


def _passes(threshold: tuple[int, int], a: str, b: str):
    """Whether lengths and the positions of a shared token allow the threshold, for columns n and pos
    of two nodes. At the first shared token of a pair that reaches it, they do."""
    t, s = threshold
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    overlap = F.least(n - F.col(f"{a}pos"), m - F.col(f"{b}pos"))
    return (F.least(n, m) * s >= F.greatest(n, m) * t) & (overlap * (s + t) >= (n + m) * t)


def _sets(width: int, classes: np.ndarray, bits: np.ndarray):
    """Ordered sets of the nodes whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            rows = []
            for own in sets_of(part.column(0).to_pylist(), width):
                if len(own):
                    fp = fingerprint(own)
                    at = fp & ((1 << FILTER_BITS) - 1)
                    if bits[at >> 6] >> np.uint64(at & 63) & np.uint64(1):
                        rows.append((fp, ordered(own, classes).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else ([], []), (pa.int64(), pa.binary()), strict=True)], names=["fp", "tokens"])

    return run


def prefixes_allow(x: np.ndarray, y: np.ndarray, n: int, m: int, threshold: tuple[int, int]) -> bool:
    """Whether two prefixes under one order, of sets of n and m tokens, allow the threshold.

    All common tokens up to the end of the prefix that ends first lie in both prefixes; behind it
    its set has only the rest of its tokens. Keys may be cut, which lets more through.
    """
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    rests = n - len(x), m - len(y)
    rest = max(rests) if x[-1] == y[-1] else rests[0] if x[-1] < y[-1] else rests[1]
    return both > 0 and (both + rest) * sum(threshold) >= (n + m) * threshold[0]


def orders_allow(x: np.ndarray, y: np.ndarray, more_x: bytes, more_y: bytes, n: int, m: int, threshold: tuple[int, int]) -> bool:
    """Whether the prefixes under every order do."""
    if not prefixes_allow(x, y, n, m, threshold):
        return False
    others = [np.frombuffer(b, dtype="<u4").reshape(len(ORDERS), -1) for b in (more_x, more_y)]
    return all(prefixes_allow(a, b, n, m, threshold) for a, b in zip(*others, strict=True))


def linked(x: np.ndarray, y: np.ndarray, threshold: tuple[int, int]) -> bool:
    """Whether two ordered sets reach the threshold."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * threshold[1] >= (len(x) + len(y) - both) * threshold[0]


def _bit_set(nodes: DataFrame) -> np.ndarray:
    """A bit for each node's lower FILTER_BITS bits, gathered as words of 64 bits."""
    at = F.col("fp").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    word, bit = F.shiftright(at, 6), F.expr("shiftleft(1L, cast(fp & 63 as int))")
    rows = nodes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).unionAll(pairs.select(F.col("b").alias("fp")))


def band(n: Column, threshold: tuple[int, int]) -> Column:
    """Lengths whose ratio is at least the threshold are in the same or in neighbouring bands."""
    return F.floor(F.log(n) / F.lit(math.log(threshold[1] / threshold[0]) + 1e-6)).cast("long")


class Join:
    """One self-join: its documents, its order, and its comparisons."""

    def __init__(self, documents: DataFrame, width: int, threshold: tuple[int, int], scratch: Scratch):
        text = utf8()
        self.texts = small_batches(documents).select(text.alias("text"), F.xxhash64(text).alias("text_hash"))
        self.width, self.threshold, self.scratch = width, threshold, scratch
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
        sketch = scratch.kept(rows.mapInArrow(tidy(_sketch(width)), SKETCHED).withColumn("part", F.spark_partition_id()))
        self.members = sketch.where("row is null").select("doc_id", "n", "fp", "text_hash")
        self.classes = _classes(sketch, scratch)
        self.common = max(COMMON_CLASS, int(np.median(self.classes)) + 3)

        prefixes = self.texts.mapInArrow(tidy(_prefixes(width, threshold, self.classes)), NODES)
        one = F.min_by(F.struct("n", "prefix", "others", "text_hash"), "text_hash").alias("one")
        self.nodes = scratch.stored(prefixes.groupBy("fp").agg(one).select("fp", "one.*"), "nodes")

    def buckets(self) -> DataFrame:
        """(token, fp, n, pos, first_fp, first_n, first_pos) of all buckets of two nodes or more."""
        rows = self.nodes.select("fp", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
        common = F.shiftrightunsigned("token", 58) >= self.common
        own = F.struct("pos", "fp", "n")
        # dealt out before the structs are made, so that they are not shuffled beside their parts
        by = W.partitionBy("token")
        rare = rows.where(~common).repartition("token").withColumn("own", own)
        rare = rare.withColumn("size", F.count(F.lit(1)).over(by)).withColumn("first", F.min("own").over(by)).where("size > 1")
        often = rows.where(common)
        firsts = often.groupBy("token").agg(F.min(own).alias("first"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("token", "first")
        both = rare.select("token", "fp", "n", "pos", "first").unionByName(often.join(firsts, "token").select("token", "fp", "n", "pos", "first"))
        return both.select("token", "fp", "n", "pos", F.col("first.fp").alias("first_fp"), F.col("first.n").alias("first_n"), F.col("first.pos").alias("first_pos"))

    def _asked(self, bits: np.ndarray) -> DataFrame:
        """The nodes whose bit is set."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(0).to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
                yield batch.filter(pa.array((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))

        return self.nodes.mapInArrow(tidy(run), self.nodes.schema)

    def narrowed(self, pairs: DataFrame) -> DataFrame:
        """The stored pairs (a, b) whose prefixes under all orders allow the threshold."""
        threshold = self.threshold

        def allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 8)), strict=True)
                keep = [orders_allow(x.view(np.uint64), y.view(np.uint64), p, q, n, m, threshold) for n, x, p, m, y, q in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

        nodes = self._asked(_bit_set(_ends(pairs)))
        names = ("n", "prefix", "others")
        side = lambda end: nodes.select(F.col("fp").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in names))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{c}_{end}" for end in "ab" for c in names))
        return self.scratch.stored(both.mapInArrow(tidy(allow), "a long, b long"), "narrowed", small=True)

    def compare(self, pairs: DataFrame) -> DataFrame:
        """The stored pairs (a, b) that reach the threshold."""
        threshold = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), threshold) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

        pairs = self.narrowed(pairs)
        bits = _bit_set(_ends(pairs))
        texts = self.texts
        if 2 * pairs.count() <= PICKED:
            # one text of each node to be compared, which Spark picks before Python sees any
            picked = self._asked(bits).join(F.broadcast(_ends(pairs).distinct()), "fp", "left_semi").select("text_hash")
            texts = texts.join(F.broadcast(picked), "text_hash", "left_semi")
        sets = texts.select("text").mapInArrow(tidy(_sets(self.width, self.classes, bits)), "fp long, tokens binary")
        sets = self.scratch.stored(sets.groupBy("fp").agg(F.first("tokens").alias("tokens")), "sets")
        left = pairs.join(sets.select(F.col("fp").alias("a"), F.col("tokens").alias("x")), "a")
        joined = left.join(sets.select(F.col("fp").alias("b"), F.col("tokens").alias("y")), "b")
        return self.scratch.stored(joined.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long"), "links", small=True)

    def links(self) -> DataFrame:
        """Links (u, v) of nodes, enough of them to connect every component."""
        scratch = self.scratch
        buckets = scratch.stored(self.buckets(), "buckets")
        first = buckets.where(F.col("fp") != F.col("first_fp")).withColumn("passes", _passes(self.threshold, "", "first_"))
        # each node with the leader that it shares most with, if that may be enough: the leader need
        # not lead all buckets that the two share, so what is seen counts three times. Whatever is
        # left out here is met below
        t, s = self.threshold
        behind = lambda n: F.ceil(F.col(n) * F.lit(t) / F.lit(s)) - 1
        enough = (3 * F.count(F.lit(1)) + F.greatest(behind("n"), behind("first_n"))) * (s + t) >= (F.col("n") + F.col("first_n")) * t
        shared = first.groupBy("fp", "first_fp", "n", "first_n").agg(F.count(F.lit(1)).alias("tokens"), enough.alias("enough"), F.max("passes").alias("passes")).where("enough and passes")
        best = shared.groupBy("fp").agg(F.max(F.struct("tokens", "first_fp")).alias("best"))
        tested = scratch.stored(best.select(F.col("best.first_fp").alias("a"), F.col("fp").alias("b")), "tested", small=True)
        stars = self.compare(tested)
        known = components(stars.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)

        placed = buckets.join(known.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        placed = scratch.stored(placed.select("token", "fp", "n", "pos", "label", band(F.col("n"), self.threshold).alias("band")), "placed")
        parts = F.ceil(F.count(F.lit(1)) / F.lit(PART_NODES)).cast("int").alias("parts")
        mixed = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), parts).where("low < high").select("token", "parts")
        left = placed.join(mixed, "token")
        # the shorter set of a pair looks for the longer one in its own band and the next; a large
        # bucket's longer sets are dealt to parts, and its shorter ones look into all parts
        names = ("fp", "n", "pos", "label")
        side = lambda name, at, part: left.select("token", at.alias("band"), part, *(F.col(c).alias(f"{name}_{c}") for c in names))
        longer = side("b", F.col("band"), F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
        shorter = side("a", F.explode(F.array(F.col("band"), F.col("band") + 1)), F.col("parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        before = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_fp") < F.col("b_fp")))
        pairs = shorter.join(longer, ["token", "band", "part"]).where(before & (F.col("a_label") != F.col("b_label")) & _passes(self.threshold, "a_", "b_"))
        pairs = pairs.select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b")).distinct()
        done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = self.compare(scratch.stored(pairs.join(done, ["a", "b"], "left_anti"), "pairs", small=True))
        return stars.unionAll(rest).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _join(documents: DataFrame, width: int, threshold: tuple[int, int], scratch: Scratch) -> Join:
    share = Fraction(*threshold)
    if not 0 < share <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    return Join(documents, width, (share.numerator, share.denominator), scratch)


def _nodes(join: Join) -> DataFrame:
    """(fp, least, label) of every node: its smallest doc_id, and its component if it has links."""
    labels = components(join.links(), join.scratch).withColumnRenamed("node", "fp")
    return join.members.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least")).join(labels, "fp", "left")


def near_copies(documents: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    A document's set holds its different runs of ``width`` lower-cased words; one with fewer words
    has its whole sequence as its only shingle; one without words, or a null text, has none and is
    linked with nothing. Documents link when their Jaccard similarity is at least the threshold, and
    component_id is the smallest doc_id of those reachable by links. Rows with the same doc_id are
    linked like others; null doc_ids are no component_id unless a component has no other.
    """
    with Scratch(documents.sparkSession) as scratch:
        join = _join(documents, width, threshold, scratch)
        nodes = _nodes(join)
        ids = nodes.where("label is not null").groupBy("label").agg(F.min("least").alias("component_id"))
        nodes = nodes.join(ids, "label", "left").select("fp", F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
        full = join.members.where("n > 0").join(nodes, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        return stored(full.unionByName(join.members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))), "near_copies", small=True)


def one_of_each(documents: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with its own columns.

    Documents without words are all kept. Of repeated rows of the chosen document one stays; where a
    component has only null doc_ids, one of its rows stays.
    """
    with Scratch(documents.sparkSession) as scratch:
        join = _join(documents, width, threshold, scratch)
        nodes = _nodes(join)
        first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("first")
        chosen = nodes.groupBy(F.coalesce("label", "fp").alias("label")).agg(first).select("first.fp", "first.least")
        # of the chosen document's texts, if it has several with the same shingles, one
        texts = join.members.where("n > 0").groupBy("fp", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n_rows"))
        one = F.min(F.struct("text_hash", "n_rows")).alias("one")
        texts = texts.join(chosen.withColumnRenamed("fp", "f"), (F.col("fp") == F.col("f")) & F.col("doc_id").eqNullSafe(F.col("least")))
        chosen = stored(texts.groupBy("fp", "doc_id").agg(one).select(F.col("doc_id").alias("k_doc"), F.col("one.text_hash").alias("k_text"), F.col("one.n_rows").alias("k_rows")), "chosen", small=True)
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("r_doc"), F.xxhash64(utf8()).alias("r_text"), F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("words"))
    kept = lambda of: rows.where("words").join(chosen.where(of), F.col("r_doc").eqNullSafe(F.col("k_doc")) & (F.col("r_text") == F.col("k_text")))
    repeated = kept("k_rows > 1").groupBy("k_doc", "k_text").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept("k_rows = 1").select("row").unionByName(repeated.select("row")).unionByName(rows.where("not words").select("row")).select("row.*")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at five words and a similarity of 0.8."""
    return near_copies(table(spark, sf_dir, "documents"))


#: The same rows by comparing all pairs that share a shingle.
OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
spread AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM words),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM spread),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
