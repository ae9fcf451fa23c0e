"""Vector best-fit packing of tokenized documents into sequences.

Documents are tokenized where they are read; what moves on is one small row for each piece. Pieces
are dealt by hash, or in the order of stored rows, into groups of bounded size, and each group is
packed by itself, so a group's bins are the unit of work however large the corpus is. A group of tens of thousands of pieces
leaves at most a few bins that are not full, far under one in a thousand.

A bin has three residual capacities: tokens, documents and attention cost (the sum of squared piece
lengths). A piece goes to the bin that satisfies every constraint and scores best, by ``rule``:
``residual`` takes the smallest weighted norm of what would be left, ``dot`` the largest weighted
dot product of the piece's needs with what is left.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brandweave.llm.common import Scratch, small_batches, stored, table, tidy

#: The token sequence of one white-space separated chunk is remembered up to this many chunks, until
#: the task ends.
REMEMBERED = 100_000
#: Longer chunks are encoded each time.
CHUNK = 64
GROUP_PIECES = 60_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ORDER = ", file string, row long"
PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]
#: Rows of a file whose pieces are counted together to deal groups in order.
BLOCK_ROWS = 8192
PACKED = PIECES + ", sequence_id long, offset long"


def default_tokenizer() -> str:
    """The path of the public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Irregular(Exception):
    """A chunk is empty, or white space other than single spaces stands at one of its ends."""


class _Chunks(dict):
    """Ids of a space and the chunk, by chunk; at most REMEMBERED of them are kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Irregular
        ids = array("I", self.encode(" " + chunk)).tobytes()
        if len(chunk) <= CHUNK:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Token ids, as little-endian unsigned 32-bit values, of a byte-level BPE vocabulary file.

    The ids are those of ``tokenizers`` for the same file with add_special_tokens=False: no token is
    added, and where a text holds the string of an added token of the file, it is that token. A text
    is cut before each single space that stands between two characters other than white space; the
    vocabulary's own splitting never joins across such a place, so chunks can be encoded one by one
    and remembered.
    """

    _loaded: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        added = known["added_tokens"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("an added token of the vocabulary is not plain text")
        self._added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        # the longest first, as they are found in a text
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in known["model"]["vocab"].items() if word not in self._added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known = _Chunks(self._encode)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """The encoder of this worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _whole(self, text: str) -> bytes:
        return array("I", self._encode(text)).tobytes()

    def forget(self) -> None:
        """Drops the remembered chunks."""
        self._known.clear()

    def ids(self, text: str) -> bytes:
        """The ids of the whole text."""
        if self._cut is None or not self._cut.search(text):
            return self._plain(text)
        return b"".join(self._added[part] if part in self._added else self._plain(part) for part in self._cut.split(text) if part)

    def _plain(self, text: str) -> bytes:
        parts = text.split(" ")
        first = parts[0]
        if first and not first[-1].isspace():
            try:
                return self._whole(first) + b"".join(map(self._known.__getitem__, parts[1:]))
            except _Irregular:
                pass
        out, chunk = [], first
        for part in parts[1:]:
            if part and chunk and not part[0].isspace() and not chunk[-1].isspace():
                out.append(self._whole(chunk))
                chunk = " " + part
            else:
                chunk = chunk + " " + part
        out.append(self._whole(chunk))
        return b"".join(out)


def tokenized_pieces(documents: DataFrame, tokenizer: str, max_tokens: int = 1024, end_id: int | None = 2, ordered: bool = False) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32.

    A null text is empty; it still has its end token. Only documents of more than ``max_tokens``
    are cut: all pieces but the first have ``max_tokens`` ids. Rows with the same or a null doc_id
    are separate documents. ``ordered`` adds the file and the row that the document was read from; it
    needs documents that are read from files.
    """
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    step = 4 * max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            source: list[int] = []
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                ids = encoder.ids(text.as_py() or "") + end
                head = len(ids) % step or min(step, len(ids))
                cuts = [0, *range(head, len(ids) + 1, step)] if ids else []
                rows += [(doc_id, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                source += [i] * (len(rows) - len(source))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            made = [pa.array(c, type=t) for c, t in zip(columns, kinds)] + [c.take(pa.array(source, type=pa.int64())) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "piece", "start", "length", "ids_crc32", "file", "row"][: len(made)])
        encoder.forget()  # workers live on, for other stages

    read = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").cast("long").alias("row")] if ordered else []
    return small_batches(documents).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *read).mapInArrow(tidy(run), PIECES + ORDER if ordered else PIECES)


def best_fit(lengths: np.ndarray, max_tokens: int, max_documents: int, max_cost: int, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin numbers and places of pieces given in descending order of length.

    Bins are listed by residual tokens, and in a list by their residual documents and cost, since bins
    alike in all three score alike; a bit mask shows the lists that are not empty. All kinds of bins
    that can take a piece are scored, but for those that can't win: by the residual norm, lists whose
    tokens alone score worse than what is found. Of equal scores the fewest residual tokens win, then
    the fewest residual documents, then the least residual cost, then the most recent bin.
    """
    n = len(lengths)
    chosen, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    lists: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(max_tokens + 1)]
    bins = mask = 0
    wt, wd, wc = (w / c**2 for w, c in zip(weights, (max_tokens, max_documents, max_cost)))
    for i, size in enumerate(lengths.tolist()):
        cost = size * size
        best, best_score = None, 0.0
        above, tokens = mask >> size, size - 1
        while above:
            step = (above & -above).bit_length()
            tokens, above = tokens + step, above >> step
            least = wt * (tokens - size) ** 2
            if best and rule != "dot" and least > best_score:
                break
            for kind in lists[tokens]:
                docs, left = kind
                if docs >= 1 and left >= cost:
                    if rule == "dot":
                        score = -(wt * size * tokens + wd * docs + wc * cost * left)
                    else:
                        score = least + wd * (docs - 1) ** 2 + wc * (left - cost) ** 2
                    if best is None or (score, tokens, kind) < (best_score, *best):
                        best, best_score = (tokens, kind), score
        if best is None:
            number, bins = bins, bins + 1
            tokens, kind = max_tokens, (max_documents, max_cost)
        else:
            tokens, kind = best
            own = lists[tokens][kind]
            number = own.pop()
            if not own:
                del lists[tokens][kind]
                if not lists[tokens]:
                    mask &= ~(1 << tokens)
        chosen[i], place[i] = number, max_tokens - tokens
        rest, kind = tokens - size, (kind[0] - 1, kind[1] - cost)
        if rest and kind[0] and kind[1]:
            lists[rest].setdefault(kind, []).append(number)
            mask |= 1 << rest
    return chosen, place


def _in_order(pieces: DataFrame, group_pieces: int) -> tuple[DataFrame, int]:
    """The pieces with ``at``, their document's place in the order of files and rows, and ``group``, runs
    of that order with about as many pieces each; and the number of groups. Only the files, one row for
    each, are ever added up in one task."""
    block, inside = F.floor(F.col("row") / BLOCK_ROWS).cast("long"), F.col("row") % BLOCK_ROWS
    pieces, total = pieces.withColumn("block", block), pieces.count()
    groups = max(1, -(-total // group_pieces))
    blocks = pieces.groupBy("file", "block").agg(F.max(inside).alias("last"), F.count(F.lit(1)).alias("n"))
    earlier = lambda what, order: F.coalesce(F.sum(what).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files, own = W.orderBy("file"), W.partitionBy("file").orderBy("block")
    firsts = blocks.groupBy("file").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))
    firsts = firsts.select("file", earlier("n", files).alias("first_piece"), earlier("blocks", files).alias("first_block"))
    places = blocks.select("file", "block", (F.row_number().over(own) - 1).alias("number"), earlier("n", own).alias("before"), (F.col("n") / (F.col("last") + 1)).alias("density"))
    joined = pieces.join(places.join(firsts, "file"), ["file", "block"])
    index = F.col("first_piece") + F.col("before") + inside * F.col("density")
    joined = joined.withColumn("at", (F.col("first_block") + F.col("number")) * BLOCK_ROWS + inside)
    joined = joined.withColumn("group", F.least(F.floor(index * groups / max(1, total)), F.lit(groups - 1)).cast("int"))
    return joined.select(*PIECE_NAMES, "at", "group"), groups


def pack(pieces: DataFrame, max_tokens: int = 1024, max_documents: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] | None = None, rule: str = "residual", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to stored or kept pieces.

    ``max_documents`` and ``max_cost`` default to values that any bin of ``max_tokens`` meets, and
    ``weights`` to such that a token left over outweighs documents and cost, which part the bins that
    a piece fills equally: that gives the fewest sequences. The
    number of groups follows the number of pieces; a piece's group is a hash of all its columns, so
    repeated rows and hot doc_ids spread like others. Pieces with a file and a row are dealt in that
    order instead, and sequences are numbered by the mean place of their pieces within the group's run
    of it; groups follow each other. An empty input gives an empty result. A piece
    that no empty bin can take is an error.
    """
    documents, cost = max_documents or max_tokens, max_cost or max_tokens**2
    weights = weights or (1.0, 0.25 / max_tokens**2, 0.25 / max_tokens**2)
    if rule not in ("residual", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    ordered = "row" in pieces.columns
    if ordered:
        pieces, groups = _in_order(pieces, group_pieces)
    else:
        groups = max(1, -(-pieces.count() // group_pieces))
        group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(7)), F.lit(groups)).cast("int")
        pieces = pieces.withColumn("group", group)
    ties = ["at", "piece"] if ordered else ["doc_id", "piece", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        group = rows.column("group").to_numpy()
        if rows.column("length").to_numpy().max() > max_tokens or rows.column("length").to_numpy().max() ** 2 > cost:
            raise ValueError("a piece is larger than an empty sequence")
        for g in np.unique(group):
            own = rows.filter(pa.array(group == g)).sort_by([("length", "descending"), *((c, "ascending") for c in ties)])
            bins, places = best_fit(own.column("length").to_numpy(), max_tokens, documents, cost, weights, rule)
            if ordered:
                at = own.column("at").to_numpy()
                bins = np.argsort(np.argsort(np.bincount(bins, at - at.min()) / np.bincount(bins), kind="stable"))[bins]
            own = own.select(PIECE_NAMES).append_column("sequence_id", pa.array(bins + (int(g) << 32))).append_column("offset", pa.array(places))
            yield from own.to_batches()

    return pieces.repartition(groups, "group").mapInArrow(tidy(run), PACKED)


def pack_documents(documents: DataFrame, tokenizer: str | None = None, max_tokens: int = 1024, end_id: int | None = 2, ordered: bool = False, **limits) -> DataFrame:
    """Tokenizes, cuts and packs documents: one row for each piece. ``ordered`` lets sequences follow
    the order of the files and rows that documents are read from."""
    pieces = tokenized_pieces(documents, tokenizer or default_tokenizer(), max_tokens, end_id, ordered)
    with Scratch(documents.sparkSession) as scratch:
        return stored(pack(scratch.kept(pieces), max_tokens, **limits), "packed")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
