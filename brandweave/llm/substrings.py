"""Removal of long repeated passages by recompression.

Every text is a sequence of symbols, at first its words. In each round runs of one symbol become a
symbol, then pairs of a left and a right symbol do; names are hashes of what they name, so equal
stretches get equal names everywhere. Which symbols are left and which are right is the same for all
texts: Spark counts over all documents how many pairs each of several such divisions would name and
takes the one that names most, round by round. Of each symbol the parse also keeps the stretch of words
that its being there depends on: whatever surrounds an equal stretch, the symbol stands there too.

A window of ``width`` words is told by the highest symbol whose stretch lies inside it, and among those of
one level by the least hash, leftmost first. The choice depends on the window's words alone, so windows
with equal words choose the same symbol at the same place. Neighbouring windows choose the same one: they are one
row, an anchor, with the hash of the symbol's stretch as its key and the hash of all words of its windows
as its region. Keys that occur once have no repeats. Where all anchors of a key have one region,
all their windows are repeats. Of the others, the windows of each different region are hashed, where one of the
texts that hold it is read again, and equal ones are counted, which verifies them one by one.

What is shuffled is a row for about ten words (and a second one where the key may be shared), a row for each
window to verify, and those texts from which something may be cut. Bit sets of a fixed size tell the
tasks what may be meant; beyond some tens of millions of keys they tell less, and more is shuffled and
thrown away: they save work and decide nothing.

Words, windows and texts are equal when their 64-bit hashes are (windows: when their key and hash are).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandweave.llm.common import SAME, SPACE_CLASSES, Scratch, hash_words, mix64, slices, small_batches, stored, table, tidy, utf8

WIDTH = 35
ROUNDS = 3
#: Divisions that are tried in each round, each in both directions.
DIVISIONS = 8
#: A longer text is worked on in parts of so many words that overlap by a window.
PART_WORDS = 1 << 17
ANCHOR = "ref long, at long, key long, region long"
WINDOW = "key long, hash long, region long, at int"
#: Bits of a set that tells the tasks which keys, places or texts may be meant.
FILTER_BITS = 25
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _named(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The names of pairs."""
    with np.errstate(over="ignore"):
        return mix64(a * np.uint64(0xC2B2AE3D27D4EB4F) + mix64(b + np.uint64(salt)))


def _left(mixed: np.ndarray, division: int) -> np.ndarray:
    """Whether symbols with these scrambled names are left ones: those whose bit for the division is 1, or by an
    odd one, which is the even one before it turned round, 0."""
    return (mixed >> np.uint64(division // 2) & np.uint64(1)) != np.uint64(division % 2)


@dataclass
class Symbols:
    """A level of the parse of several texts: names, where they start and end, the words that they depend
    on (``low`` to ``high``, beyond a text's ends where it depends on these), and the number of their text."""

    names: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray

    def firsts(self) -> np.ndarray:
        return np.concatenate([[True], self.text[1:] != self.text[:-1]]) if len(self.text) else np.empty(0, dtype=bool)


def words_as_symbols(words: np.ndarray, counts: np.ndarray) -> Symbols:
    start = np.arange(len(words), dtype=np.int64)
    return Symbols(words, start, start + 1, start, start + 1, np.repeat(np.arange(len(counts)), counts))


def runs(s: Symbols, begins: np.ndarray, ends: np.ndarray) -> Symbols:
    """Names longest runs of a symbol. That a run ends depends on the symbols on both sides."""
    n = len(s.names)
    if not n:
        return s
    first = s.firsts()
    again = np.zeros(n, dtype=bool)
    again[1:] = (s.names[1:] == s.names[:-1]) & ~first[1:]
    head = np.flatnonzero(~again)
    size = np.diff(np.append(head, n))
    tail = head + size - 1
    opens, closes, text = first[head], np.append(first, True)[tail + 1], s.text[head]
    names = np.where(size > 1, _named(s.names[head], size.astype(np.uint64), 1), s.names[head])
    low = np.where(opens, begins[text] - 1, s.low[np.maximum(head - 1, 0)])
    high = np.where(closes, ends[text] + 1, s.high[np.minimum(tail + 1, n - 1)])
    return Symbols(names, s.start[head], s.end[tail], low, high, text)


def pairs(s: Symbols, division: int, salt: int, begins: np.ndarray, ends: np.ndarray) -> Symbols:
    """Names pairs of a left and a right symbol. A pair depends on its two symbols; that a symbol stays
    single, on the one that it might have paired with."""
    n = len(s.names)
    if not n:
        return s
    first, left = s.firsts(), _left(mix64(s.names), division)
    joins = np.zeros(n, dtype=bool)
    joins[:-1] = left[:-1] & ~left[1:] & ~first[1:]
    second = np.zeros(n, dtype=bool)
    second[1:] = joins[:-1]
    head = np.flatnonzero(~second)
    paired, after, text, open_right = joins[head], np.minimum(head + 1, n - 1), s.text[head], left[head]
    closes = np.append(first, True)[head + 1]
    names = np.where(paired, _named(s.names[head], s.names[after], salt), s.names[head])
    low = np.where(paired | open_right, s.low[head], np.where(first[head], begins[text] - 1, s.low[np.maximum(head - 1, 0)]))
    high = np.where(paired, s.high[after], np.where(open_right, np.where(closes, ends[text] + 1, s.high[after]), s.high[head]))
    return Symbols(names, s.start[head], np.where(paired, s.end[after], s.end[head]), low, high, text)


def levels_of(words: np.ndarray, counts: np.ndarray, divisions: list[int]) -> list[Symbols]:
    """The words, and the symbols after each round."""
    ends = np.cumsum(counts)
    begins = ends - counts
    out = [words_as_symbols(words, counts)]
    for turn, division in enumerate(divisions):
        out.append(pairs(runs(out[-1], begins, ends), division, turn + 2, begins, ends))
    return out


def _parts(words: np.ndarray, counts: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(words, counts, number of the first text, words of it before these). Only long texts are cut: a window
    chooses by its own words, so parts that overlap by all but one word of a window choose alike."""
    at = first = 0
    for i in [*np.flatnonzero(counts > PART_WORDS).tolist(), len(counts)]:
        size = int(counts[first:i].sum())
        if size:
            yield words[at : at + size], counts[first:i], first, 0
        at += size
        if i < len(counts):
            n = int(counts[i])
            for start in range(0, max(1, n - width + 1), PART_WORDS):
                own = words[at + start : at + min(n, start + PART_WORDS + width - 1)]
                yield own, np.array([len(own)]), i, start
            at += n
        first = i + 1


class Rolled:
    """Hashes of stretches of words, each in a few steps: prefix sums of words times powers."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        with np.errstate(over="ignore"):
            power = np.full(n, _BASE)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            self.back = np.full(n, _BACK)
            self.back[0] = 1
            np.multiply.accumulate(self.back, out=self.back)
            self.sums = np.zeros(n, dtype=np.uint64)
            np.cumsum(words * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of the least value from a up to b, for each a < b; the leftmost of equal ones."""
    power = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), dtype=np.int64)
    best = np.arange(len(values), dtype=np.int64)
    for p in range(int(power.max()) + 1):
        own = np.flatnonzero(power == p)
        x, y = best[a[own]], best[b[own] - (1 << p)]
        out[own] = np.where(values[y] < values[x], y, x)
        if 1 << p < len(best):
            x, y = best[: -(1 << p)], best[1 << p :]
            best = np.where(values[y] < values[x], y, x)
    return out


def anchors_of(words: np.ndarray, counts: np.ndarray, divisions: list[int], width: int) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, key, region) of all anchors; texts of fewer words have none."""
    ends = np.cumsum(counts)
    begins = ends - counts
    n = np.maximum(counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    window = np.arange(len(text), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n) + begins[text]
    left, rolled, found = np.arange(len(window)), Rolled(words), []
    for s in reversed(levels_of(words, counts, divisions)):
        if not len(left):
            break
        at = window[left]
        a, b = np.searchsorted(s.low, at), np.searchsorted(s.high, at + width, side="right")
        has = b > a
        if not has.any():
            continue
        own = left[has]
        pick = _least(mix64(s.names), a[has], b[has])
        left = left[~has]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (pick[1:] != pick[:-1]) | (own[1:] != own[:-1] + 1)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(own)))
        first, symbol = window[own[head]], pick[head]
        found.append((text[own[head]], first - begins[text[own[head]]], size, rolled.of(s.low[symbol], s.high[symbol]), rolled.of(first, first + size + width - 1)))
    if not found:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _hashed(part: pa.RecordBatch, column: int = 1) -> tuple[np.ndarray, np.ndarray]:
    return hash_words(part.column(column).to_pylist(), SPACE_CLASSES, SAME)


def _tried(divisions: list[int], width: int):
    """A task's number of pairs that each division would name next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * DIVISIONS, dtype=np.int64)
        for part in slices(batches, 0):
            for words, counts, _, _ in _parts(*_hashed(part, 0), width):
                ends = np.cumsum(counts)
                s = runs(levels_of(words, counts, divisions)[-1], ends - counts, ends)
                inside, mixed = ~s.firsts()[1:], mix64(s.names)
                for i in range(DIVISIONS):
                    left = _left(mixed, 2 * i)
                    a, b = left[:-1][inside], left[1:][inside]
                    total[2 * i] += np.count_nonzero(a & ~b)
                    total[2 * i + 1] += np.count_nonzero(b & ~a)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["division", "n"])

    return tidy(run)


def divisions_of(texts: DataFrame, rounds: int = ROUNDS, width: int = WIDTH) -> list[int]:
    """For each round the division that names most pairs of all texts; a job for each round."""
    out: list[int] = []
    for _ in range(rounds):
        counts = texts.select("text").mapInArrow(_tried(out, width), "division long, n long").groupBy("division").agg(F.sum("n").alias("n")).collect()
        out.append(max(((r.n, -r.division) for r in counts), default=(0, 0))[1] * -1)
    return out


def _bits(values: DataFrame) -> np.ndarray:
    """The bit set of the values of a column of longs: FILTER_BITS bits, or twice as many bytes on the way."""
    v = F.col(values.columns[0])
    rows = values.groupBy(F.shiftright(v.bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({values.columns[0]} & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _may_be(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether values are in a bit set, or share a bit with one that is."""
    at = values.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _rows(columns: tuple[np.ndarray, ...], layout: str) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], names=[x.split()[0] for x in layout.split(", ")])


def _anchored(divisions: list[int], width: int, keys: np.ndarray | None = None):
    """All anchors, or those whose keys may be in a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            refs = part.column(0).to_numpy()
            for words, counts, first, before in _parts(*_hashed(part), width):
                text, start, size, key, region = anchors_of(words, counts, divisions, width)
                columns = (refs[first + text], ((start + before) << 6) | size, key.view(np.int64), region.view(np.int64))
                if keys is not None:
                    meant = _may_be(keys, columns[2])
                    columns = tuple(c[meant] for c in columns)
                yield from _rows(columns, ANCHOR)

    return tidy(run)


def _windows(divisions: list[int], width: int, texts: np.ndarray, places: np.ndarray):
    """The windows of the regions that are to be verified; others may come with them and do no harm.

    Equal texts count once in a task, and as one where their windows are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            refs = batch.column(0).to_numpy()
            meant = []
            for i in np.flatnonzero(_may_be(texts, refs)).tolist():
                if (ref := int(refs[i])) not in seen:
                    seen.add(ref)
                    meant.append(i)
            for part in slices([batch.take(pa.array(meant, type=pa.int64()))]):
                refs = part.column(0).to_numpy()
                for words, counts, first, before in _parts(*_hashed(part), width):
                    text, start, size, key, region = anchors_of(words, counts, divisions, width)
                    meant_here = _may_be(places, refs[first + text] ^ (((start + before) << 6) | size))
                    text, start, size, key, region = (x[meant_here] for x in (text, start, size, key, region))
                    begins = np.cumsum(counts) - counts
                    shift = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                    at = np.repeat(begins[text] + start, size) + shift
                    yield from _rows((np.repeat(key.view(np.int64), size), Rolled(words).of(at, at + width).view(np.int64), np.repeat(region.view(np.int64), size), shift.astype(np.int32)), WINDOW)

    return tidy(run)


def spans_of(at: np.ndarray, mask: np.ndarray, width: int) -> np.ndarray:
    """Merged stretches (start, end) of words that are covered by the windows of anchors: first windows and
    sizes packed in ``at``, and of each anchor the bits of the windows that count."""
    first, size = at >> 6, at & 63
    shift = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    start = np.unique((np.repeat(first, size) + shift)[(np.repeat(mask, size) >> shift) & 1 == 1])
    if not len(start):
        return np.empty((0, 2), dtype=np.int64)
    head = np.flatnonzero(np.concatenate([[True], start[1:] > start[:-1] + width]))
    return np.stack([start[head], start[np.append(head[1:], len(start)) - 1] + width], axis=1)


def _merged(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at, mask = (x.to_numpy() for x in lists.flatten().flatten())
            ends = np.cumsum(np.diff(lists.offsets.to_numpy())).tolist()
            spans = [spans_of(at[a:b], mask[a:b], width).astype("<i8").tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, type=pa.binary())], names=["ref", "spans"])

    return tidy(run)


def repeated_spans(texts: DataFrame, scratch: Scratch, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """(ref, spans) of every text, known by the hash ``ref``, that holds words of a repeated window."""
    divisions = divisions_of(texts, rounds, width)
    found = texts.mapInArrow(_anchored(divisions, width), ANCHOR).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("region").alias("low"), F.max("region").alias("high"))
    # stored, so that the join below has nothing but its two sides, which Spark can split where a key is hot
    keys = scratch.stored(found.where("n > 1").select("key", (F.col("low") != F.col("high")).alias("mixed")), "keys", small=True)
    anchors = texts.mapInArrow(_anchored(divisions, width, _bits(keys.select("key"))), ANCHOR)
    shared = scratch.stored(anchors.join(keys, "key").select("ref", "at", *(F.when(F.col("mixed"), F.col(c)).alias(c) for c in ("key", "region"))), "shared", small=True)
    sure = shared.where("key is null").select("ref", "at", F.lit(-1).cast("long").alias("mask"))
    open_ = shared.where("key is not null")
    regions = scratch.stored(open_.groupBy("key", "region").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ref", "at")).alias("one")), "regions", small=True)
    one = regions.select("one.*")
    windows = texts.mapInArrow(_windows(divisions, width, _bits(one.select("ref")), _bits(one.select(F.col("ref").bitwiseXOR(F.col("at")).alias("place")))), WINDOW)
    place = F.struct("region", "at")
    equal = windows.groupBy("key", "hash").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("key", "hash")
    # stored, like the masks below, so that the joins have nothing but two sides
    equal = scratch.stored(equal, "equal", small=True)
    bits = windows.join(equal, ["key", "hash"]).groupBy("key", "region").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    whole = regions.where("n > 1").select("key", "region", F.lit(-1).cast("long").alias("mask"))
    masks = scratch.stored(whole.unionByName(bits).groupBy("key", "region").agg(F.bit_or("mask").alias("mask")), "masks", small=True)
    found = sure.unionByName(open_.join(masks, ["key", "region"]).select("ref", "at", "mask"))
    grouped = found.groupBy("ref").agg(F.collect_set(F.struct("at", "mask")).alias("found"))
    return scratch.stored(grouped.mapInArrow(_merged(width), "ref long, spans binary"), "spans", small=True)


def _meant(bits: np.ndarray):
    """Rows (ref, doc_id, text) from which something may be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_may_be(bits, batch.column(0).to_numpy())))

    return tidy(run)


def _cut(bits: np.ndarray | None = None):
    """What is left of rows (ref, doc_id, text, spans); with ``bits``, of rows (ref, doc_id, text) from which nothing is cut."""
    names = ["doc_id", "n_words", "spans", "text"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            if bits is not None:
                part = part.filter(pa.array(~_may_be(bits, part.column(0).to_numpy())))
            n, all_spans, kept = [], [], []
            for text, spans in zip(part.column(2).to_pylist(), part.column(3).to_pylist() if bits is None else [None] * part.num_rows, strict=True):
                words = text.split()  # bytes: at runs of bytes 20 and 09 to 0D
                own = np.frombuffer(spans or b"", dtype="<i8").reshape(-1, 2).tolist()
                n.append(len(words))
                all_spans.append([{"start": a, "end": b} for a, b in own])
                for a, b in reversed(own):
                    del words[a:b]
                kept.append(b" ".join(words).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(n, type=pa.int64()), pa.array(all_spans, type=kind), pa.array(kept, type=pa.string())], names=names)

    return tidy(run)


def without_repeats(documents: DataFrame, scratch: Scratch, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, n_words, the removed spans of words, and the text that is left, its words joined by one space.

    A word goes if it is covered by a window of ``width`` words (up to 60) that stands anywhere else too, in
    another document or the same, overlapping or not; windows are those of the input. Null and empty texts
    have no words; texts of fewer words than a window stay whole. Every row is a document, repeated rows and
    such with null or repeated doc_ids too, so a text of a window's length or more that occurs twice goes
    altogether. Further columns are not looked at. Rows are made when the result is read, from tables that go with ``scratch``.
    """
    if not 1 <= width <= 60:
        raise ValueError("width must be from 1 to 60")
    rows = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).withColumn("ref", F.xxhash64("text"))
    spans = repeated_spans(rows.select("ref", "text"), scratch, width, rounds)
    rows = rows.select("ref", "doc_id", "text")
    bits, layout = _bits(spans.select("ref")), "doc_id long, n_words long, spans array<struct<start:long,end:long>>, text string"
    meant = rows.mapInArrow(_meant(bits), rows.schema).join(spans.hint("merge"), "ref", "left").select("ref", "doc_id", "text", "spans")
    return meant.mapInArrow(_cut(), layout).unionByName(rows.mapInArrow(_cut(bits), layout))


def remove_repeats(documents: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """``without_repeats``, stored in the shared folder."""
    with Scratch(documents.sparkSession) as scratch:
        return stored(without_repeats(documents, scratch, width, rounds), "unrepeated")


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages."""
    with Scratch(spark) as scratch:
        found = without_repeats(table(spark, sf_dir, "documents"), scratch)
        removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
        return stored(found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256")), "unrepeated")


OP11_SQL = """
WITH held AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
windows AS (
  SELECT row_no, p, sha256(array_to_string(list_slice(words, p, p + 34), ' ')) AS hash
  FROM (SELECT row_no, words, unnest(range(1, len(words) - 33)) AS p FROM held)),
repeated AS (SELECT hash FROM windows GROUP BY hash HAVING count(*) > 1),
covered AS (SELECT DISTINCT row_no, unnest(range(p, p + 35)) AS p FROM windows SEMI JOIN repeated USING (hash)),
kept AS (
  SELECT row_no, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM (SELECT row_no, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM held) ANTI JOIN covered USING (row_no, p) GROUP BY row_no)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM held LEFT JOIN kept USING (row_no)"""
