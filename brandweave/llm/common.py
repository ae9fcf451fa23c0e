"""What the corpus operators share: tables, the shared folder, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than ASCII white space (bytes 20 and 09-0D).
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Rows of a batch that is sent to or from Python, unless the session names a number of its own.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_PIECE = 1 << 18
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(frame: DataFrame) -> DataFrame:
    """The frame, whose session from now on sends at most BATCH_ROWS rows at a time to Python.

    Spark's 10,000 rows of long texts take hundreds of MB outside the heap of an executor. A number
    that the session already has stays.
    """
    spark = frame.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    return frame


def tidy(run):
    """A function over Arrow batches that gives back what Arrow holds when it ends: workers live on."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where the cluster names none (tests on one machine), a new local folder is used.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="brandweave-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Files of a stored table of small rows, for each core.
FILES = 4


def stored(frame: DataFrame, name: str, path: str | None = None, small: bool = False) -> DataFrame:
    """The same rows, written once to the shared folder and read back: cuts the lineage.

    A table of small rows that comes out of a shuffle is written as FILES files for each core at most,
    since every file costs calls to the store.
    """
    spark = frame.sparkSession
    path = path or fresh_path(spark, name)
    (frame.coalesce(FILES * spark.sparkContext.defaultParallelism) if small else frame).write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class Scratch:
    """Intermediate tables that go when the block ends, or with ``free``: what was made of them must
    be stored by then."""

    def __init__(self, spark: SparkSession, inside: "Scratch | None" = None):
        self.spark = spark
        self.folder = f"{inside.folder}/{uuid.uuid4().hex}" if inside else fresh_path(spark, "scratch")
        self.held: list[DataFrame] = []
        self.made = 0

    def __enter__(self) -> "Scratch":
        return self

    def kept(self, frame: DataFrame) -> DataFrame:
        """The same rows, on the executors' disks once they are made; lost ones are made again from
        what they come from. For tables that are read several times and come of a short plan, since every
        plan that reads them holds theirs."""
        self.held.append(frame.persist(StorageLevel.DISK_ONLY))
        return frame

    def stored(self, frame: DataFrame, name: str, small: bool = False) -> DataFrame:
        """As ``stored``, in this block's folder."""
        self.made += 1
        return stored(frame, name, f"{self.folder}/{self.made}-{name}", small)

    def __exit__(self, *_) -> None:
        self.free()

    def free(self) -> None:
        """Drops the tables."""
        for frame in self.held:
            frame.unpersist()
        self.held.clear()
        # Hadoop's file systems, since whatever Spark can write to, they can delete from
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def utf8(text: Column | str = "text") -> Column:
    """The text's bytes; a null text counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def mix64(values: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of unsigned 64-bit values (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        v = values.astype(np.uint64, copy=True)
        v ^= v >> np.uint64(30)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(27)
        v *= np.uint64(0x94D049BB133111EB)
        v ^= v >> np.uint64(31)
    return v


def _factors(n: int) -> np.ndarray:
    """n fixed odd multipliers, one for each byte position of a word."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_FACTORS = _factors(256)


def classes(separators: bytes | None = None, words: bytes | None = None) -> np.ndarray:
    """A table of 256 classes: 0 for separators, 1 for bytes of words."""
    out = np.ones(256, dtype=np.uint8)
    if words is not None:
        out[:] = 0
        out[list(words)] = 1
    else:
        out[list(SPACES if separators is None else separators)] = 0
    return out


SPACE_CLASSES = classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def _hash_piece(raw: np.ndarray, kinds: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of one non-zero class in raw."""
    kind = kinds[raw]
    edge = np.empty(len(kind) + 1, dtype=bool)
    edge[0], edge[-1] = True, True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    cuts = np.flatnonzero(edge)
    begin, end = cuts[:-1], cuts[1:]
    keep = kind[begin] != 0
    begin, end = begin[keep], end[keep]
    if not len(begin):
        return begin, np.empty(0, dtype=np.uint64)
    size = end - begin
    first = np.zeros(len(size), dtype=np.int64)
    np.cumsum(size[:-1], out=first[1:])
    inside = kind != 0
    chars = fold[raw[inside]]
    place = np.arange(len(chars), dtype=np.int64) - np.repeat(first, size)
    longest = int(size.max())
    factors = _FACTORS if longest <= len(_FACTORS) else _factors(longest)
    with np.errstate(over="ignore"):
        values = (chars.astype(np.uint64) + np.uint64(1)) * factors[place]
        sums = np.add.reduceat(values, first)
        return begin, mix64(sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_words(texts: list[bytes], kinds: np.ndarray = SPACE_CLASSES, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, in order, and the number of words of each text.

    A word is a longest run of bytes of one non-zero class of ``kinds``; ``fold`` maps bytes before
    hashing. Texts are joined and worked on in pieces of about 256 KB, so that the temporary arrays
    stay small however long a text is; what is kept is 8 bytes a word.
    """
    counts = np.zeros(len(texts), dtype=np.int64)
    found: list[np.ndarray] = []
    gap = bytes([int(np.flatnonzero(kinds == 0)[0])])
    i = 0
    while i < len(texts):
        size, j = 0, i
        while j < len(texts) and (j == i or size + len(texts[j]) <= _PIECE):
            size += len(texts[j]) + 1
            j += 1
        if j - i == 1 and len(texts[i]) > 2 * _PIECE:
            raw, at = np.frombuffer(texts[i], dtype=np.uint8), 0
            while at < len(raw):
                to = min(len(raw), at + _PIECE)
                while to < len(raw):
                    near = kinds[raw[to : to + 65536]]
                    cut = np.flatnonzero(near == 0)
                    if len(cut):
                        to += int(cut[0])
                        break
                    to = min(len(raw), to + 65536)
                _, hashes = _hash_piece(raw[at:to], kinds, fold)
                found.append(hashes)
                counts[i] += len(hashes)
                at = to
        else:
            joined = gap.join(texts[i:j])
            begin, hashes = _hash_piece(np.frombuffer(joined, dtype=np.uint8), kinds, fold)
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
            counts[i:j] = np.diff(np.searchsorted(begin, ends, side="left"), prepend=0)
            found.append(hashes)
        i = j
    return (np.concatenate(found) if found else np.empty(0, dtype=np.uint64)), counts


def shingles(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words and their number by text.

    A text of fewer words, but at least one, has its whole sequence as its only shingle; a text
    without words has none.
    """
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.empty(0, dtype=np.int64)
    out = np.empty(int(n.sum()), dtype=np.uint64)
    if not len(out):
        return out, n
    multiply = _factors(width + 300)[300:]
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            rolled += words[k : k + len(rolled)] * multiply[k]
        long = counts >= width
        firsts = np.concatenate([[0], np.cumsum(n)[:-1]])
        where = np.arange(int(n[long].sum())) - np.repeat(np.cumsum(n[long]) - n[long], n[long])
        at = np.repeat(starts[long], n[long]) + where
        out[np.repeat(firsts[long], n[long]) + where] = mix64(rolled[at] + np.uint64(width))
        for i in np.flatnonzero((counts > 0) & ~long):
            own = words[starts[i] : starts[i] + counts[i]]
            out[firsts[i]] = mix64(np.array([np.sum(own * multiply[: len(own)]) + np.uint64(len(own))], dtype=np.uint64))[0]
    return out, n


def slices(batches, column: int = 1, limit: int = 1 << 20):
    """Parts of Arrow batches whose binary column holds about ``limit`` bytes, or one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        at = 0
        for to in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
            yield batch.slice(at, to - at)
            at = to
