"""Merkle manifests against plain Python: trees, proofs and tampering."""

import hashlib
import random
import zlib

import pytest

from brandweave.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, idx long, path string, leaf string"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels_of(nodes, width):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + width]) for i in range(0, len(out[-1]), width)])
    return out


def brute(rows, width):
    groups = {}
    for row in rows:
        groups.setdefault("" if row[1] is None else "s" + row[1], []).append(row)
    names = sorted(groups, key=str.encode)
    trees = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees[name] = (own, levels_of([leaf_of(r, r[4]) for r in own], width))
    top = levels_of([trees[n][1][-1][0] for n in names], width)
    out = []
    for number, name in enumerate(names):
        own, levels = trees[name]
        for place, row in enumerate(own):
            odd = row[0] is None or zlib.crc32(str(row[0]).encode()) % 2
            fold, proof = leaf_of(row, row[4] if odd or row[4] is None else row[4].replace("\n", "")), ""
            for nodes, at in [*((x, place // width**i) for i, x in enumerate(levels[:-1])), *((x, number // width**i) for i, x in enumerate(top[:-1]))]:
                first = at // width * width
                left, right = "".join(nodes[first:at]), "".join(nodes[at + 1 : first + width])
                fold, proof = h(left, fold, right), proof + left + right
            out.append((row[0], levels[0][place], levels[-1][0], top[-1][0], h(proof), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def rows_of(n, seed, sources):
    draw = random.Random(seed)
    return [(draw.choice([None, 7, *range(40)]), draw.choice(sources), draw.choice(["en", None, "ü"]), draw.choice([None, 5]), draw.choice([None, "", "a\nb\n", "ö\n", "plain", "x" * 50_000]), "s1", 3, "p", "l") for _ in range(n)]


@pytest.mark.parametrize(("n", "width", "sources"), [(64, 3, [None, "", "b", "a", "ab", "Z", "ä"]), (23, 2, ["b", None]), (41, 5, ["one"]), (1, 3, ["one"]), (3, 3, ["a", "b", "c"])])
def test_against_plain_python(spark, n, width, sources):
    rows = rows_of(n, n, sources)
    rows += rows[: n // 8]
    found = merkle.proofs(spark.createDataFrame(rows, SCHEMA), width=width)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, width)


def test_empty_table(spark):
    found = merkle.proofs(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and "verified" in found.columns


def test_siblings_come_by_joins(spark):
    nodes = spark.createDataFrame([("s", i, 8, bytes([i])) for i in range(8)], "grp string, idx long, n long, digest binary")
    for width, want in ((2, {0: b"\1", 5: b"\4"}), (3, {0: b"\1\2", 4: b"\3\5", 7: b"\6"}), (9, {3: bytes([0, 1, 2, 4, 5, 6, 7])})):
        got = {r.idx: bytes(r.siblings) for r in merkle.level_of(nodes, width).collect()}
        assert want.items() <= got.items()
