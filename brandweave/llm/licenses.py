"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, as many as the template has words divided by the threshold,
rounded up (or the whole text, if shorter). It meets a template when it holds at least the threshold
share of the template's distinct words. Template words are ordered by their number in the whole
corpus, rarest first. A block that meets the threshold must hold one of the template's prefix words
(length filter on the block, prefix filter on the template). The place of the rarest template word
that it holds bounds what it can hold at all: no more than the template has behind that word in its
order, and no more than stand of those around it in the text (positional filter). Only blocks around
words that pass are counted out. Templates are a parameter; what is sent to the workers follows their
size, not the corpus, and they may be sentences or whole licenses.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandweave.llm.common import LOWER, classes, hash_words, slices, small_batches, table, utf8

#: Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Opening or naming sentences of common licenses, with our labels.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc0", "dedicated to the public domain under cc0 1.0 universal"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2.0"),
    ("reserved", "all rights reserved"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4.0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4.0"),
    ("cc-by-nd", "licensed under cc by nd 4.0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
)
_GPL = r"\b(?:general public )?(?<!lesser general public )(?<!affero general public )(?<!library general public )license (?:either )?(?:version )?"
#: What must stand in a template's block, over its lower-cased words joined by spaces. Templates that
#: aren't here tell themselves apart by their length.
NAMES = {
    "licensed under the apache license version 2.0": r"\bapache\b.*\b2\b",
    "licensed under cc by nc 4.0": r"\b(?:cc )?by nc\b(?! (?:sa|nd)\b)",
    "licensed under cc by sa 4.0": r"\b(?:cc )?by sa\b",
    "dedicated to the public domain under cc0 1.0 universal": r"\bcc0\b",
    "licensed under the gnu general public license version 3": _GPL + r"3\b",
    "released under the mit license": r"\bmit\b",
    "subject to the terms of the mozilla public license version 2.0": r"\bmozilla\b.*\b2\b",
    "free and unencumbered software released into the public domain": r"\bunencumbered\b",
    "released under the bsd license": r"\bbsd\b",
    "licensed under cc by 4.0": r"\bcc by\b(?! (?:nc|nd|sa)\b)",
    "licensed under cc by nc nd 4.0": r"\b(?:cc )?by nc nd\b",
    "licensed under cc by nc sa 4.0": r"\b(?:cc )?by nc sa\b",
    "licensed under cc by nd 4.0": r"\b(?:cc )?by nd\b",
    "licensed under the gnu general public license version 2": _GPL + r"2\b",
}
#: Words around a block that its name may reach into.
AROUND = 3
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Words are runs of ASCII digits and letters and of all bytes from 80 up.
KINDS = classes(words=bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
SCANNED = (
    "doc_id long, n_words long, places array<struct<label:string,start:long>>, "
    "blocks array<struct<label:string,template:int,start:long,end:long,containment:double,named:boolean>>"
)


def _words(text: str) -> np.ndarray:
    return hash_words([text.encode()], KINDS, LOWER)[0]


def word_counts(documents: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of a sorted vocabulary of hashes stands in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for part in slices(batches, 0):
            words, _ = hash_words(part.column(0).to_pylist(), KINDS, LOWER)
            at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            total += np.bincount(at[vocabulary[at] == words], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], names=["word", "n"])

    rows = small_batches(documents).select(utf8().alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary), dtype=np.int64)
    for row in rows:
        out[row.word] = row.n
    return out


class _Template:
    """A template's distinct words, rarest first, and what the filters need of them."""

    def __init__(self, number: int, label: str, words: np.ndarray, rank: dict[int, int], threshold: float):
        self.number, self.label = number, label
        self.words = sorted(set(words.tolist()), key=rank.__getitem__)
        self.need = max(1, math.ceil(threshold * len(self.words) - 1e-9))
        self.width = max(len(words), math.ceil(len(words) / threshold - 1e-9))
        self.prefix = self.words[: len(self.words) - self.need + 1]


def _leads(template: _Template, places: np.ndarray, ranks: np.ndarray, width: int) -> np.ndarray:
    """Places of prefix words that may be the rarest of a block that meets the threshold: behind them,
    in the template's order and around them in the text, enough other words are left."""
    keep = np.zeros(len(places), dtype=bool)
    for rank in np.unique(ranks[ranks < len(template.prefix)]).tolist():
        mine, behind = ranks == rank, places[ranks > rank]
        near = np.searchsorted(behind, places[mine] + width) - np.searchsorted(behind, places[mine] - width, side="right")
        keep[mine] = 1 + np.minimum(len(template.words) - rank - 1, near) >= template.need
    return places[keep]


def _blocks(template: _Template, places: np.ndarray, ranks: np.ndarray, n_words: int) -> list[tuple]:
    """Merged runs of blocks that meet the threshold, of one text.

    places and ranks: where the template's words stand, ascending, and each one's place in its order.
    """
    width, k = min(template.width, n_words), len(template.words)
    if width < template.need:
        return []
    first = _leads(template, places, ranks, width)
    if not len(first):
        return []
    spans: list[list[int]] = []
    for p in first.tolist():
        low, high = max(0, p - width + 1), min(p, n_words - width)
        if spans and low <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    out: list[tuple] = []
    for low, high in spans:
        a, b = np.searchsorted(places, [low, high + width])
        own, kinds = places[a:b].tolist(), ranks[a:b].tolist()
        held = [0] * k
        left = right = distinct = 0
        run: list | None = None
        for start in range(low, high + 1):
            while right < len(own) and own[right] < start + width:
                held[kinds[right]] += 1
                distinct += held[kinds[right]] == 1
                right += 1
            while left < right and own[left] < start:
                held[kinds[left]] -= 1
                distinct -= held[kinds[left]] == 0
                left += 1
            if distinct >= template.need:
                if run and run[1] == start + width - 1:
                    run[1], run[2] = start + width, max(run[2], distinct)
                else:
                    run = [start, start + width, distinct]
                    out.append(run)
    return [(template.label, template.number, s, e, d / k) for s, e, d in out]


def _named(text: bytes, blocks: list[tuple], names: list[re.Pattern | None]) -> list[tuple]:
    """Blocks with whether their license's name stands in them."""
    words = [w.lower().decode(errors="replace") for w in WORD.findall(text)]
    own = lambda start, end: " ".join(words[max(0, start - AROUND) : end + AROUND])
    return [(*b, names[b[1]] is None or names[b[1]].search(own(b[2], b[3])) is not None) for b in blocks]


def scan(documents: DataFrame, templates=TEMPLATES, phrases: dict[str, str] | None = None, threshold: float = 0.8, names: dict[str, str] | None = None) -> DataFrame:
    """Per document: its number of words, the base phrases' places, and the template blocks.

    ``places`` are (label, start) where a phrase's words stand consecutively, by start and label.
    ``blocks`` are (label, template number, start, end, containment, named), where overlapping blocks of a template are one
    run; ``named`` tells that the template's pattern of ``names``, if it has one, is met. Word places count from 0. A null or empty text has no words and empty
    lists; repeated rows, repeated or null doc_ids each give a row. Two words are equal when their
    64-bit hashes are.
    """
    phrases = PHRASES if phrases is None else phrases
    sets = [_words(text) for _, text in templates]
    patterns = [re.compile(n) if (n := (NAMES if names is None else names).get(text)) else None for _, text in templates]
    phrase_words = [(_words(text), label) for text, label in phrases.items()]
    vocabulary = np.unique(np.concatenate([*sets, *(w for w, _ in phrase_words)]))
    counts = word_counts(documents, vocabulary)
    rank = {int(w): i for i, w in enumerate(vocabulary[np.lexsort((vocabulary, counts))])}
    made = [_Template(i, label, words, rank, threshold) for i, ((label, _), words) in enumerate(zip(templates, sets, strict=True))]
    orders = []
    for t in made:
        order = np.full(len(vocabulary), len(vocabulary), dtype=np.int64)
        order[np.searchsorted(vocabulary, np.array(t.words, dtype=np.uint64))] = np.arange(len(t.words))
        orders.append(order)
    leads = [np.isin(np.arange(len(vocabulary)), np.searchsorted(vocabulary, np.array(t.prefix, dtype=np.uint64))) for t in made]
    chains = [(np.searchsorted(vocabulary, words), label) for words, label in phrase_words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, n = hash_words(part.column(1).to_pylist(), KINDS, LOWER)
            at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            here = np.flatnonzero(vocabulary[at] == words)
            known = at[here]
            ends = np.cumsum(n)
            begins = ends - n
            text_of = np.searchsorted(ends, here, side="right")
            places: dict[int, list] = {}
            for chain, label in chains:
                starts = np.flatnonzero(known == chain[0])
                for step in range(1, len(chain)):
                    starts = starts[starts + step < len(known)]
                    starts = starts[(known[starts + step] == chain[step]) & (here[starts + step] == here[starts] + step) & (text_of[starts + step] == text_of[starts])]
                for s in starts.tolist():
                    places.setdefault(int(text_of[s]), []).append((int(here[s] - begins[text_of[s]]), label))
            blocks: dict[int, list] = {}
            for t, order, lead in zip(made, orders, leads, strict=True):
                for i in np.unique(text_of[lead[known]]).tolist():
                    a, b = np.searchsorted(here, [begins[i], ends[i]])
                    ranks = order[known[a:b]]
                    mine = ranks < len(vocabulary)
                    blocks.setdefault(i, []).extend(_blocks(t, here[a:b][mine] - begins[i], ranks[mine], int(n[i])))
            rows = []
            for i in range(len(n)):
                own, base = sorted(blocks.get(i, []), key=lambda x: (x[2], x[1])), sorted(places.get(i, []))
                rows.append((_named(part.column(1)[i].as_py(), own, patterns) if own else [], base))
            columns = [
                part.column(0),
                pa.array(n),
                pa.array([[{"label": label, "start": s} for s, label in base] for _, base in rows], type=pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
                pa.array(
                    [[dict(zip(("label", "template", "start", "end", "containment", "named"), x, strict=True)) for x in own] for own, _ in rows],
                    type=pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64()), ("named", pa.bool_())])),
                ),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "places", "blocks"])

    return documents.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, SCANNED)


def with_labels(found: DataFrame) -> DataFrame:
    """What op10_licenses gives of a scan: labels are those of phrases, all of which stay, and of named
    blocks; the score is 1 with a phrase, else the best containment of a named block, or 0."""
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    named = F.filter("blocks", lambda b: b["named"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        labels(F.col("places.label")).alias("base_labels"),
        labels(F.concat(F.col("places.label"), F.transform(named, lambda b: b["label"]))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(named, lambda b: b["containment"])), F.lit(0.0))).alias("score"),
        "blocks",
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document: base phrases, labels of the method, best containment."""
    return with_labels(scan(table(spark, sf_dir, "documents")))
