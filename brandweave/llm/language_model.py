"""An interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Counting: tasks combine what they read into sorted runs of hashes and send one packed block to each
shard; a shard is a range of context hashes and merges its blocks into sorted arrays. A context that
would fill more than a quarter of a shard is split over several by its next word. The numbers of
shards of bigrams and of words follow the number of tokens, so a merge holds a bounded number of
them. Tasks write the names of the shards' files beside the arrays, LISTED to a list. What passes through the driver
is a list of at most HOT_WORDS words, whatever the corpus, and the names of the lists.

Stored form, in the shared folder: bigram shards (64-bit keys in order, counts of one byte and the
few larger ones beside them) and word shards (hash, count, number of different words before it,
and as a context its numbers of words that follow once, twice and more often). Scoring workers map
the files that a batch's sorted keys fall into and search them there; what is mapped is shared by the
machine's workers and read page by page. From a store that can't be mapped the arrays of a shard are
read when a batch asks for them and not kept; nothing is copied to local disks.

Probabilities: p(w|u) = max(c(u,w) - D, 0) / c(u) + (D1 n1(u) + D2 n2(u) + D3 n3(u)) / c(u) p(w), where
p(w) is the same rule over continuation counts, interpolated with 1 / (V + 1); a word that follows no
known context has p(w). Words equal in their 64-bit hash count as the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandweave.llm.common import fresh_path, hash_words, mix64, slices, small_batches, table, utf8

#: Tokens that a task combines at a time, and those that a bigram shard is planned for.
COMBINED = 3_000_000
SHARD_TOKENS = 2_000_000
#: Bytes of text that a word shard is planned for, about those of as many tokens.
SHARD_BYTES = 12_000_000
#: At most so many words are split over shards.
HOT_WORDS = 1_000_000
#: Shards whose files stand in one list.
LISTED = 4096
#: Arrays that a worker keeps mapped.
MAPS = 8192
END = np.uint64(0x5EED_0000_0000_0001)
START = np.uint64(0x5EED_0000_0000_0002)
#: Bytes of a file's name in a list of files.
NAME = 64
_LOW = np.uint64((1 << 40) - 1)
_BLOCKS = "shard int, kind string, a binary, b binary, c binary, d binary"
_U64, _U32 = np.dtype("<u8"), np.dtype("<u4")


def training(modulus: int = 5, held: int = 1) -> Column:
    """Whether a document is learned from: crc32 of its doc_id as text (null: empty), by remainder."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus != held


def _block(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string()] + [pa.binary()] * 4
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "kind", "a", "b", "c", "d"])


def _bounds(shards: int) -> np.ndarray:
    """First hashes of shards 1, 2, ...; shards are equal ranges of the upper 32 bits."""
    return np.array([(-(-(i << 32) // shards)) << 32 for i in range(1, shards)], dtype=np.uint64)


def _cut(values: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the parts of ascending hashes."""
    cuts = [0, *np.searchsorted(values, _bounds(shards), side="left").tolist(), len(values)]
    return ((i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b)


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, *counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(c[order].astype(np.int64), first) for c in counts)


def _read(blobs, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, dtype=kind) for b in blobs] or [np.empty(0, dtype=kind)])


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, the hash before each, and tokens by text."""
    words, n = hash_words(texts)
    ends = np.cumsum(n + 1) - 1
    tokens = np.full(len(words) + len(n), END, dtype=np.uint64)
    mask = np.ones(len(tokens), dtype=bool)
    mask[ends] = False
    tokens[mask] = words
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[ends - n] = START
    return tokens, before, n + 1


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            held.clear()
            keys, counts = _summed(tokens, np.ones(len(tokens), dtype=np.int64))
            return _block([(s, "word", keys[a:b].astype(_U64).tobytes(), counts[a:b].astype(_U32).tobytes(), b"", b"") for s, a, b in _cut(keys, shards)])

        for part in slices(batches, 0):
            held.append(_tokens(part.column(0).to_pylist())[0])
            if sum(map(len, held)) >= COMBINED:
                yield flush()
        if held:
            yield flush()

    return run


def _merge_words(group: pa.Table) -> pa.Table:
    keys, counts = _summed(_read(group["a"].to_pylist(), _U64), _read(group["b"].to_pylist(), _U32))
    return pa.Table.from_batches([_block([(group["shard"][0].as_py(), "word", keys.tobytes(), counts.astype(_U64).tobytes(), b"", b"")])])


@dataclass
class Seats:
    """Where contexts stand in the order of hashes: hot ones at several places, by the next word."""

    shards: int
    hot: np.ndarray
    splits: np.ndarray
    seats: np.ndarray = field(init=False)
    owner: np.ndarray = field(init=False)

    def __post_init__(self):
        owner = np.repeat(np.arange(len(self.hot)), self.splits)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(self.splits) - self.splits, self.splits)
        seats = self._seat(self.hot[owner], number.astype(np.uint64))
        order = np.argsort(seats)
        self.seats, self.owner = seats[order], self.hot[owner[order]]

    @staticmethod
    def _seat(context: np.ndarray, number: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(context ^ ((number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))

    def of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The seat of each bigram."""
        if not len(self.hot):
            return context
        at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
        hot = self.hot[at] == context
        out = context.copy()
        out[hot] = self._seat(context[hot], (word[hot] >> np.uint64(7)) % self.splits[at[hot]].astype(np.uint64))
        return out

    def context(self, seat: np.ndarray) -> np.ndarray:
        """The contexts that have these seats."""
        if not len(self.seats):
            return seat
        at = np.minimum(np.searchsorted(self.seats, seat), len(self.seats) - 1)
        return np.where(self.seats[at] == seat, self.owner[at], seat)


def bigram_keys(seat: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The upper 24 bits of the seat and 40 bits of a hash of seat and word."""
    with np.errstate(over="ignore"):
        return (seat & ~_LOW) | (mix64(seat * np.uint64(0xD6E8FEB86659FD93) + word) & _LOW)


def _count_bigrams(seats: Seats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            word, context = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            seat = seats.of(context, word)
            keys = bigram_keys(seat, word)
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts = np.diff(first, append=len(keys)).astype(_U32)
            seat, word = seat[order[first]], word[order[first]]
            rows = []
            for s, a, b in _cut(seat & ~_LOW, seats.shards):
                own = seat[a:b]
                runs = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                rows.append((s, "pair", own[runs].tobytes(), np.diff(runs, append=b - a).astype(_U32).tobytes(), word[a:b].tobytes(), counts[a:b].tobytes()))
            return _block(rows)

        size = 0
        for part in slices(batches, 0):
            word, context, _ = _tokens(part.column(0).to_pylist())
            held.append((word, context))
            size += len(word)
            if size >= COMBINED:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes arrays under a new name and gives it; a lost attempt's files are never named."""
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    for kind, values in arrays.items():
        with store.open_output_stream(f"{path}/{name}.{kind}") as out:
            out.write(np.ascontiguousarray(values).data if len(values) else b"")
    return name


def _merge_bigrams(seats: Seats, word_shards: int, folder: str):
    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        seat = np.repeat(_read(group["a"].to_pylist(), _U64), _read(group["b"].to_pylist(), _U32))
        word, count = _read(group["c"].to_pylist(), _U64), _read(group["d"].to_pylist(), _U32)
        keys = bigram_keys(seat, word)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.add.reduceat(count[order].astype(np.int64), first)
        keys, seat, word = keys[first], seat[order[first]], word[order[first]]
        large = count >= 255
        name = _write(folder, f"pairs{shard}", {"keys": keys, "counts": np.minimum(count, 255).astype(np.uint8), "large": np.stack([keys[large], count[large].astype(np.uint64)]).ravel()})
        histogram = np.bincount(np.minimum(count, 5), minlength=6)[1:5].astype(_U64)
        rows = [(shard, "file", name.encode(), np.array([keys[0], keys[-1], len(keys)], dtype=_U64).tobytes(), histogram.tobytes(), b"")]
        once, n = _summed(word, np.ones(len(word), dtype=np.int64))
        rows += [(s, "before", once[a:b].tobytes(), n[a:b].astype(_U64).tobytes(), b"", b"") for s, a, b in _cut(once, word_shards)]
        contexts, n1, n2, n3 = _summed(seats.context(seat), count == 1, count == 2, count >= 3)
        rows += [(s, "after", contexts[a:b].tobytes(), n1[a:b].astype(_U64).tobytes(), n2[a:b].astype(_U64).tobytes(), n3[a:b].astype(_U64).tobytes()) for s, a, b in _cut(contexts, word_shards)]
        return pa.Table.from_batches([_block(rows)])

    return run


def _finish_words(folder: str):
    def run(group: pa.Table) -> pa.Table:
        kind = np.array(group["kind"].to_pylist())
        columns = {k: [group[k].to_pylist()[i] for i in range(len(kind))] for k in "abcd"}
        take = lambda name, c, to=_U64: _read([columns[c][i] for i in np.flatnonzero(kind == name)], to)
        parts = [take(k, "a") for k in ("word", "before", "after")]
        keys = np.concatenate(parts)
        zeros = [np.zeros(len(p), dtype=np.int64) for p in parts]
        side = lambda i, values: np.concatenate([*zeros[:i], values.astype(np.int64), *zeros[i + 1 :]])
        keys, count, before, n1, n2, n3 = _summed(keys, side(0, take("word", "b")), side(1, take("before", "b")), side(2, take("after", "b")), side(2, take("after", "c")), side(2, take("after", "d")))
        shard = group["shard"][0].as_py()
        name = _write(folder, f"words{shard}", {"keys": keys, "numbers": np.stack([count, before, n1, n2, n3], axis=1).astype(_U64).ravel()})
        histogram = np.array([*(np.sum(before == i) for i in (1, 2, 3, 4)), np.sum(before >= 3), before.sum()], dtype=_U64)
        return pa.Table.from_batches([_block([(shard, "file", name.encode(), np.array([keys[0], keys[-1], len(keys)], dtype=_U64).tobytes(), histogram.tobytes(), b"")])])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many counts are 1, 2, 3 and 4; 0.5, 1, 1.5 where those are too few."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i) for i, d in enumerate(found, 1))


@dataclass
class Model:
    """What the driver keeps of a stored model: a few totals, and the names of its lists of files."""

    folder: str
    seats: Seats
    pairs: str
    words: str
    tokens: int
    vocabulary: int
    documents: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    before: int
    word_rest: float


def train(documents: DataFrame, folder: str | None = None) -> Model:
    """Counts all given documents (null text: empty, which is an end token) into a stored model."""
    spark = documents.sparkSession
    folder = folder or fresh_path(spark, "model")
    texts = small_batches(documents).select(utf8().alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    texts.mapInArrow(_count_words(shards), _BLOCKS).groupBy("shard").applyInArrow(_merge_words, _BLOCKS).write.parquet(f"{folder}/words")
    words = spark.read.schema(_BLOCKS).parquet(f"{folder}/words")

    def totals(least: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = different = documents = 0
            hot: list[tuple[int, int]] = []
            for batch in batches:
                for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    keys, counts = np.frombuffer(a, dtype=_U64), np.frombuffer(b, dtype=_U64)
                    tokens, different, documents = tokens + int(counts.sum()), different + len(keys), documents + int(counts[keys == END].sum())
                    if least:
                        hot += [(int(k), int(c)) for k, c in zip(keys[counts >= least].tolist(), counts[counts >= least].tolist())]
            rows = [(tokens, different, documents, None, None), *((None, None, None, k - (1 << 63), c) for k, c in hot)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=["tokens", "different", "documents", "word", "n"])

        return words.select("a", "b").mapInArrow(run, "tokens long, different long, documents long, word long, n long")

    tokens, different, n_documents = (x or 0 for x in totals(0).agg(F.sum("tokens"), F.sum("different"), F.sum("documents")).first())
    pair_shards = max(shards, -(-tokens // SHARD_TOKENS))
    # At most four times as many words as shards can pass this bound, and never more than HOT_WORDS.
    least = max(1000, tokens // min(4 * pair_shards, HOT_WORDS))
    hot = {int(r.word) + (1 << 63): int(r.n) for r in totals(least).where("word is not null").collect()}
    if n_documents >= least:
        hot[int(START)] = n_documents
    hot.pop(int(END), None)
    names = np.array(sorted(hot), dtype=np.uint64)
    seats = Seats(pair_shards, names, np.array([-(-hot[int(k)] // least) for k in names], dtype=np.int64))
    texts.mapInArrow(_count_bigrams(seats), _BLOCKS).groupBy("shard").applyInArrow(_merge_bigrams(seats, shards, f"{folder}/arrays"), _BLOCKS).write.parquet(f"{folder}/pairs")
    second = spark.read.schema(_BLOCKS).parquet(f"{folder}/pairs")
    merged = words.unionByName(second.where("kind <> 'file'")).groupBy("shard").applyInArrow(_finish_words(f"{folder}/arrays"), _BLOCKS)
    merged.write.parquet(f"{folder}/numbers")
    pair_files, word_files = second.where("kind = 'file'"), spark.read.schema(_BLOCKS).parquet(f"{folder}/numbers").where("kind = 'file'")
    n1, n2, n3, n4 = _totals(pair_files, 4)
    m1, m2, m3, m4, m_more, before = _totals(word_files, 6)
    d = discounts(m1, m2, m3, m4)
    rest = (d[0] * m1 + d[1] * m2 + d[2] * m_more) / before if before else 1.0
    return Model(f"{folder}/arrays", seats, _listed(pair_files, folder, "pairs"), _listed(word_files, folder, "words"), tokens, different, n_documents, discounts(n1, n2, n3, n4), d, before, rest)


def _totals(files: DataFrame, n: int) -> list[int]:
    """The sums of the files' n numbers, added up by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype=np.int64)
        for batch in batches:
            for numbers in batch.column(0).to_pylist():
                total += np.frombuffer(numbers, dtype=_U64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], names=["at", "n"])

    rows = {r.at: r.n for r in files.select("c").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    return [rows.get(i, 0) for i in range(n)]


def _list(folder: str, name: str, files: list[tuple[int, bytes]]) -> str:
    """Writes first keys, ascending, and the names that stand for them; gives the list's own name."""
    names = np.array([n for _, n in sorted(files)], dtype=f"S{NAME}")
    return _write(folder, name, {"first": np.array([k for k, _ in sorted(files)], dtype=_U64), "names": names.view(np.uint8)})


def _listed(files: DataFrame, folder: str, kind: str) -> str:
    """Writes the lists of the shards' files, a task for LISTED shards, and the list of lists; gives its name."""

    def run(group: pa.Table) -> pa.Table:
        own = [(int(np.frombuffer(b, dtype=_U64)[0]), a) for a, b in zip(group["a"].to_pylist(), group["b"].to_pylist(), strict=True)]
        return pa.table({"name": [_list(f"{folder}/arrays", f"{kind}-list", own)], "first": [np.array([min(own)[0]], dtype=_U64).tobytes()]})

    spark = files.sparkSession
    grouped = files.select(F.floor(F.col("shard") / LISTED).alias("list"), "a", "b").groupBy("list").applyInArrow(run, "name string, first binary")
    grouped.write.parquet(f"{folder}/{kind}-lists")  # first, so that only lists of tasks that ended are named
    lists = [(int(np.frombuffer(r["first"], dtype=_U64)[0]), r["name"].encode()) for r in spark.read.schema(grouped.schema).parquet(f"{folder}/{kind}-lists").collect()]
    return _list(f"{folder}/arrays", f"{kind}-lists", lists)


class Mapped:
    """A model's arrays in a worker, mapped when first needed."""

    _open: dict[str, "Mapped"] = {}

    def __init__(self, model: Model):
        self.model, self.arrays = model, {}
        self.store, self.path = pafs.FileSystem.from_uri(model.folder)
        self.mapped = isinstance(self.store, pafs.LocalFileSystem)
        self.lists = {}

    @classmethod
    def of(cls, model: Model) -> "Mapped":
        if model.folder not in cls._open:
            cls._open.clear()
            cls._open[model.folder] = cls(model)
        return cls._open[model.folder]

    def array(self, name: str, kind: np.dtype) -> np.ndarray:
        if not self.mapped:
            with self.store.open_input_file(f"{self.path}/{name}") as file:
                return np.frombuffer(file.read(), dtype=kind)
        if name not in self.arrays:
            if len(self.arrays) >= MAPS:
                self.arrays.clear()
            try:
                self.arrays[name] = np.memmap(f"{self.path}/{name}", dtype=kind, mode="r")
            except ValueError:  # an empty file can't be mapped
                self.arrays[name] = np.empty(0, dtype=kind)
        return self.arrays[name]

    def _stretches(self, name: str, keys: np.ndarray) -> Iterator[tuple[str, int, int]]:
        """What ascending keys fall into by a list, each with its stretch of them."""
        if name not in self.lists:
            if len(self.lists) >= MAPS:
                self.lists.clear()
            self.lists[name] = self.array(f"{name}.first", _U64), self.array(f"{name}.names", np.dtype(f"S{NAME}"))
        first, names = self.lists[name]
        at = np.searchsorted(first, keys, side="right") - 1
        cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
        for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
            if at[a] >= 0:
                yield names[at[a]].decode(), a, b

    def _parts(self, lists: str, keys: np.ndarray) -> Iterator[tuple[str, int, int]]:
        """The files that ascending keys fall into."""
        for name, a, b in self._stretches(lists, keys):
            for file, c, d in self._stretches(name, keys[a:b]):
                yield file, a + c, a + d

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ascending bigram keys."""
        out = np.zeros(len(keys), dtype=np.int64)
        for name, a, b in self._parts(self.model.pairs, keys):
            stored, counts = self.array(f"{name}.keys", _U64), self.array(f"{name}.counts", np.dtype("u1"))
            at = np.minimum(np.searchsorted(stored, keys[a:b]), len(stored) - 1)
            found = np.where(stored[at] == keys[a:b], counts[at].astype(np.int64), 0)
            if (found == 255).any():
                large = self.array(f"{name}.large", _U64).reshape(2, -1)
                found[found == 255] = large[1][np.searchsorted(large[0], keys[a:b][found == 255])]
            out[a:b] = found
        return out

    def words(self, keys: np.ndarray) -> np.ndarray:
        """Count, words before, and words after once, twice and more often, of ascending hashes."""
        out = np.zeros((len(keys), 5), dtype=np.int64)
        for name, a, b in self._parts(self.model.words, keys):
            stored, numbers = self.array(f"{name}.keys", _U64), self.array(f"{name}.numbers", _U64).reshape(-1, 5)
            at = np.minimum(np.searchsorted(stored, keys[a:b]), len(stored) - 1)
            same = stored[at] == keys[a:b]
            out[a:b][same] = numbers[at[same]]
        return out

    def log10(self, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's log10 probability after the one before it, and its training count."""
        m = self.model
        seen, back = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        numbers = self.words(seen)
        own, context = back[: len(tokens)], back[len(tokens) :]
        if len(at := np.flatnonzero(seen == START)):
            numbers[at, 0] = m.documents
        pair, back = np.unique(bigram_keys(m.seats.of(before, tokens), tokens), return_inverse=True)
        count = self.pairs(pair)[back]
        less = np.array([0.0, *m.pair_discounts])
        less_word = np.array([0.0, *m.word_discounts])
        continued = numbers[own, 1]
        p = np.maximum(continued - less_word[np.minimum(continued, 3)], 0) / max(1, m.before) + m.word_rest / (m.vocabulary + 1)
        # the end of a text is a token but never a context
        total = np.where(before == END, 0, numbers[context, 0])
        known = total > 0
        kept = np.maximum(count[known] - less[np.minimum(count[known], 3)], 0)
        rest = numbers[context[known], 2:] @ less[1:]
        p[known] = (kept + rest * p[known]) / total[known]
        return np.log10(p), numbers[own, 0]


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(documents: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    """Scores whole texts: tokens, tokens seen in training, and log10 probabilities.

    ``base_score`` is that of single tokens with 0.5 added to each count; ``score`` is the model's.
    A null or empty text has its end token only. Each row is scored by itself, repeated or not.
    """
    held_out = ~training() if held_out is None else held_out
    total = model.tokens + 0.5 * (model.vocabulary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Mapped.of(model)
        for part in slices(batches, limit=1 << 20 if arrays.mapped else 8 << 20):
            tokens, before, n = _tokens(part.column(1).to_pylist())
            logs, counts = arrays.log10(tokens, before)
            first = np.cumsum(n) - n
            sums = lambda x: np.add.reduceat(x, first)
            base = sums(np.log10((counts + 0.5) / total))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(n), pa.array(sums((counts > 0).astype(np.int64))), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(sums(logs))],
                names=[x.split()[0] for x in SCORED.split(", ")],
            )

    return small_batches(documents).select(F.col("doc_id").cast("long"), utf8().alias("text"), held_out.alias("held_out")).mapInArrow(run, SCORED)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those whose crc32(doc_id) mod 5 is not 1."""
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents.where(training())))
