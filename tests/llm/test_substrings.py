"""Repeated passages against plain Python, and what the parse promises."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from brandweave.llm import substrings as op
from brandweave.llm.common import SAME, SPACE_CLASSES, hash_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, width):
    """(n_words, spans, kept) of each text."""
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[p : p + width]) for w in words for p in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for p in range(len(w) - width + 1):
            if count[tuple(w[p : p + width])] > 1:
                gone |= set(range(p, p + width))
        edge = sorted(gone)
        starts = [i for i in edge if i - 1 not in gone]
        spans = [(i, next(j for j in range(i, len(w) + 1) if j not in gone)) for i in starts]
        out.append((len(w), spans, " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def texts_of(seed, n):
    draw = random.Random(seed)
    word = lambda: draw.choice(["a", "b", "ü", "A"]) if draw.random() < 0.7 else f"w{draw.randint(0, 50)}"
    line = lambda k: draw.choice([" ", "\n", "\t "]).join(word() for _ in range(k))
    common = [line(draw.randint(3, 60)) for _ in range(6)]
    out = [" ".join(draw.choice([line(draw.randint(0, 25)), draw.choice(common), "a " * draw.randint(1, 50), "x y " * draw.randint(1, 30)]) for _ in range(draw.randint(1, 4))) for _ in range(n)]
    return [*out, out[0], out[0], None, None, "", " \n ", "one", "a " * 400, " ".join(f"u{i}" for i in range(500)), "\x1f \x85 a\xa0b " * 9]


@pytest.mark.parametrize(("width", "rounds", "small"), [(35, 3, True), (35, 3, False), (8, 3, True), (3, 2, False), (1, 0, True)])
def test_against_plain_python(spark, monkeypatch, width, rounds, small):
    if small:
        monkeypatch.setattr(op, "FILTER_BITS", 7)  # full sets: all that may be meant is looked at
    texts = texts_of(width + rounds, 60)
    frame = spark.createDataFrame([(i if i % 9 else None, t, 1, "s", i) for i, t in enumerate(texts)], "doc_id long, text string, ref int, spans string, n_words long")
    found = op.remove_repeats(frame, width, rounds)
    assert found.columns == ["doc_id", "n_words", "spans", "text"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(s) for s in r.spans], r.text) for r in found.collect())
    want = sorted((not i % 9, i if i % 9 else 0, *row) for i, row in enumerate(brute(texts, width)))
    assert got == want


def test_empty_table_and_query_columns(spark, sf_dir):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.remove_repeats(empty).count() == 0
    rows = op.op11_substrings(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(texts, brute(list(texts.values()), 35), strict=True))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == {d: (n, sum(b - a for a, b in spans), hashlib.sha256(kept.encode()).hexdigest()) for d, (n, spans, kept) in want.items()}


def chosen(words, counts, divisions, width):
    """By text and window: the key and the place of the choice's region."""
    out = {}
    for text, first, size, key, region in zip(*(x.tolist() for x in op.anchors_of(words, counts, divisions, width)), strict=True):
        for i in range(size):
            assert (text, first + i) not in out
            out[text, first + i] = (key, i - size, region)
    return out


@pytest.mark.parametrize(("width", "divisions"), [(35, [3, 8, 0]), (12, [1, 2]), (5, [0]), (20, [2, 5, 7, 9])])
def test_equal_windows_choose_alike(width, divisions):
    texts = [(t or "").encode() for t in texts_of(width, 80)]
    words, counts = hash_words(texts, SPACE_CLASSES, SAME)
    found = chosen(words, counts, divisions, width)
    ends = np.cumsum(counts)
    keys = {}
    for (text, p), (key, *_) in found.items():
        at = int(ends[text] - counts[text]) + p
        assert keys.setdefault(tuple(words[at : at + width].tolist()), key) == key
    assert len(found) == int(np.maximum(counts - width + 1, 0).sum())
    # several levels are used, and a window's choice needs far fewer rows than there are windows
    assert len(op.anchors_of(words, counts, divisions, width)[0]) < len(found)


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(op, "PART_WORDS", 50)
    texts = [(t or "").encode() for t in texts_of(4, 30)] + [b" ".join(b"v%d" % (i % 97) for i in range(777))]
    words, counts = hash_words(texts, SPACE_CLASSES, SAME)
    whole = {k: v[0] for k, v in chosen(words, counts, [3, 8, 0], 20).items()}
    parts = {}
    for own, n, first, before in op._parts(words, counts, 20):
        for (text, p), (key, *_) in chosen(own, n, [3, 8, 0], 20).items():
            assert parts.setdefault((first + text, before + p), key) == key
    assert parts == whole


def test_runs_and_pairs_are_named_alike_everywhere():
    words, counts = hash_words([b"q a a a b c", b"z z a a a b c y", b"a a a b c"], SPACE_CLASSES, SAME)
    ends = np.cumsum(counts)
    level = op.runs(op.words_as_symbols(words, counts), ends - counts, ends)
    assert level.end.tolist()[:4] == [1, 4, 5, 6] and level.names[1] == level.names[5] == level.names[9]
    assert level.low[9] == ends[1] - 1 and level.high[1] == 5
    for division in range(6):
        paired = op.pairs(level, division, 2, ends - counts, ends)
        own = {(int(s), int(e)): int(n) for s, e, n in zip(paired.start, paired.end, paired.names, strict=True)}
        for (s, e), name in own.items():
            if e - s > 1 and 1 <= s < 4 and (s + 7, e + 7) in own:
                assert own[s + 7, e + 7] == name
    assert op.spans_of(np.array([(3 << 6) | 4]), np.array([0b1001]), 2).tolist() == [[3, 5], [6, 8]]
