"""Ranked search against plain Python, and the graph of shared sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from brandweave.llm import ranked_search as op

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(documents, items, k):
    held = [(d, Counter(terms(t))) for d, t in documents]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, every = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, counts, n in held:
            m = 10 + (90 * n * n_docs) // every
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in set(terms(text)) & set(counts))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_items", [op.ITEMS, 4])
def test_against_plain_python(spark, block_items):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "X", "x", "É9"]
    text = lambda n: " ".join(draw.choices(words, k=n)) + draw.choice(["", "!", "\n-", "[]"])
    documents = [(draw.choice([None, *range(60)]), draw.choice([text(draw.randint(1, 30)), text(4), None, "", "--"])) for _ in range(120)]
    documents += documents[:20] + [(500, text(30_000))]
    items = [(i if i % 5 else None, text(draw.randint(1, 12))) for i in range(17)] + [(3, "w1 w2 w3"), (3, "w1 w2 w3"), (4, None), (5, ""), (6, "nowhere")]
    frames = (spark.createDataFrame([(d, t, 1, "s") for d, t in documents], "doc_id long, text string, item_id int, score string"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"))
    found = op.search(*frames, k=4, block_items=block_items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(documents, items, 4)


def test_empty_tables(spark):
    documents = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((documents.limit(0), items), (documents, items.limit(0)), (documents.limit(0), items.limit(0))):
        assert op.search(d, i).count() == 0


def test_shared_sets_are_added_once():
    draw = random.Random(1)
    common = [set(draw.sample(range(100), 12)) for _ in range(5)]
    items = [set().union(*draw.sample(common, 2), draw.sample(range(100, 200), 3)) for _ in range(60)] + [set(), {1}, {1}]
    graph = op.graph_of(items)
    scores = np.array([[draw.randint(0, 99) for _ in range(7)] for _ in range(200)], dtype=np.int64)
    for made, item in zip(op.accumulate(graph, scores), items, strict=True):
        assert made.tolist() == scores[sorted(item)].sum(axis=0).tolist()
    alone = sum(max(0, len(i) - 1) for i in items)
    assert graph.parts and graph.additions() < alone / 3
    # what is left to share between two items is one node at most
    assert all(len(set(a) & set(b)) < 2 for i, a in enumerate(graph.items) for b in graph.items[:i])
    assert all(p < len(graph.atoms) + i for i, parts in enumerate(graph.parts) for p in parts)
