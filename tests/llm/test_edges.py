"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

from brandweave.llm import common, html, jaccard, language_model, licenses, media, mixing, neighbours, packing, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key double, position int, fp long, found string"
LONG = " ".join(f"w{i % 997}" for i in range(200_000)) + " card 4078918989542222 " + "x" * 3_000_000
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33, "r", 0.5, 1, 2, "f"),
    (1, "one two three four five six seven", "en", "a", 33, "r", 0.5, 1, 2, "f"),
    (2, None, "en", "a", None, None, None, None, None, None),
    (3, "", None, "b", 0, None, None, None, None, None),
    (None, "one two three four five six seven", "en", None, 33, None, None, None, None, None),
    (None, None, None, None, None, None, None, None, None, None),
    (-4, " \t\n", "en", "", 3, None, None, None, None, None),
    (5, LONG, "en", "c", len(LONG), None, None, None, None, None),
    (6, "Mail a.b@example.com, all rights reserved. CC BY \U0001f600 \x00 end", "en", "c", 50, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, None), (6, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")


def test_media(odd, none):
    rows = media.media_features(odd).collect()
    assert sorted(r.n_bytes for r in rows) == sorted(len((r[1] or "").encode()) for r in ROWS)
    assert all(r.payload_bytes > 0 and r.payload_bytes % 576 == 0 for r in rows)
    assert media.media_features(none).count() == 0


def test_pii(odd, none):
    rows = pii.pseudonymise(odd).select("row.*", F.size("found").alias("n")).collect()
    assert len(rows) == len(ROWS) and rows[0].asDict().keys() >= {"row", "key", "found"}
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].text is None and by[3].text == "" and "4078918989542222" not in by[5].text and "a.b@example.com" not in by[6].text
    assert pii.pseudonymise(none).count() == 0


def test_quality(odd, none, labels, spark):
    weights = quality.fit(odd, labels)
    assert quality.select(odd, weights).count() == len(ROWS)
    kept = quality.keep(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= len(ROWS)
    assert quality.keep(none, labels).count() == 0
    assert quality.keep(odd, labels.limit(0)).count() == len(ROWS)
    assert quality.select(odd, weights, k=0).where("kept").count() == 0


def test_mixing(odd, none):
    plan = {(r.doc_id, r.source, r.no_text): r for r in mixing.plan(odd).collect()}
    assert sum(r.n_rows for r in plan.values()) == len(ROWS) and all(0 <= r.copies <= 3 for r in plan.values())
    assert plan[(1, "a", False)].n_rows == 2 and plan[(2, "a", True)].size == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == [*odd.columns, "_position"]
    assert mixed.count() == sum(r.copies * r.n_rows for r in plan.values())
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_language_model(odd, none):
    model = language_model.train(odd)
    rows = language_model.score(odd, model).collect()
    assert len(rows) == len(ROWS) and all(r.score < 0 and r.n_tokens >= 1 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, -4)} == {1}
    empty = language_model.train(none)
    assert empty.tokens == 0
    assert all(r.n_known == 0 and r.score <= 0 for r in language_model.score(odd, empty).collect())


def test_packing(odd, none):
    rows = packing.pack_documents(odd).collect()
    assert len([r for r in rows if r.piece == 0]) == len(ROWS)
    assert {r.length for r in rows if r.doc_id in (2, 3)} == {1}
    assert packing.pack_documents(none).count() == 0


def test_jaccard(odd, none):
    rows = jaccard.near_copies(odd).collect()
    assert len(rows) == len(ROWS)
    assert sorted(str(r.component_id) for r in rows if r.n_shingles == 3) == ["1", "1", "1"]
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 2
    assert jaccard.near_copies(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_licenses(odd, none):
    rows = {r.doc_id: r for r in licenses.scan(odd).collect() if r.doc_id is not None}
    assert rows[2].n_words == rows[3].n_words == 0 and rows[2].places == [] and rows[2].blocks == []
    assert [(p.label, p.start) for p in rows[6].places] == [("reserved", 5)]
    assert licenses.scan(none).count() == 0


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    pages = spark.createDataFrame([(1, "u", None, "x", 1), (None, None, "", "x", 1), (2, "v", "<p>a<p>b", None, 0), (2, "v", "<p>a<p>b", None, 0), (3, None, "<" * 1000, None, 0), (4, None, "<div>" * 20_000 + "deep", None, 0)], schema)
    rows = html.extract(pages).collect()
    assert len(rows) == 6 and [r.text for r in rows if r.page_id == 2] == ["a\nb"] * 2
    assert [(r.text, r.n_chars) for r in rows if r.page_id == 1] == [("", 0)]
    assert [r.text for r in rows if r.page_id == 4] == ["deep"]
    assert html.extract(pages.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id long, embedding array<float>, score double, rank int"
    rows = [(0, [1.0, 0.0], 0.0, 0), (20, [0.0, 0.0], 0.0, 0), (1, [1.0, 0.0], 0.0, 0), (2, [1.0, 0.0], 0.0, 0), (3, None, 0.0, 0), (4, [nan, 1.0], 0.0, 0), (5, [inf, 1.0], 0.0, 0), (6, [None, 1.0], 0.0, 0), (7, [], 0.0, 0), (None, [1.0, 1.0], 0.0, 0), (8, [2.0, 1.0], 0.0, 0), (9, [-1.0, 3.0], 0.0, 0)]
    vectors = spark.createDataFrame(rows, schema)
    index, books = neighbours.build(vectors)
    found = neighbours.search(index, books, neighbours.usable(vectors).where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [(0, 1, 8, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 9, -1.0)]
    more = spark.createDataFrame([(20, [0.0, 1.0], 0.0, 0), (20, [-1.0, 1.0], 0.0, 0), (21, [1.0, 2.0, 3.0], 0.0, 0), (8, [2.0, 1.5], 0.0, 0)], schema)
    index, books = neighbours.build(vectors.unionByName(more))
    found = neighbours.search(index, books, neighbours.usable(more).where("vec_id = 20"), k=3).orderBy("rank").collect()
    assert books.dim == 2 and [(r.query_id, r.vec_id, r.score) for r in found] == [(20, 9, 4.0), (20, 8, -0.5), (20, 0, -1.0)]
    index, books = neighbours.build(vectors.limit(0))
    assert neighbours.search(index, books, neighbours.usable(vectors)).count() == 0


@pytest.mark.parametrize("texts", [[b""], [b"", b" "], [b"a"], [b"a b", b""], [b"", b"a b c d e f"]])
def test_slices_of_blank_and_short_texts(texts):
    assert [len(s) for s in jaccard.sets_of(texts, 5)] == [0 if not t.split() else max(1, len(t.split()) - 4) for t in texts]
    assert len(quality.hashed_runs(texts, 64)[0]) == sum(max(0, 2 * len(t.split()) - 1) for t in texts)
    assert language_model._tokens(texts)[2].tolist() == [len(t.split()) + 1 for t in texts]


@pytest.mark.parametrize("texts", [[None, "", " "], ["a b", None]])
def test_partitions_of_blank_and_short_texts(spark, labels, texts):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1)
    n = len(texts)
    assert media.media_features(docs).count() == pii.pseudonymise(docs).count() == licenses.scan(docs).count() == n
    assert quality.select(docs, quality.fit(docs, labels)).count() == quality.keep(docs, labels).count() == n
    assert mixing.plan(docs).count() == n and mixing.mix(docs).count() <= 3 * n
    assert language_model.score(docs, language_model.train(docs)).count() == n
    assert packing.pack_documents(docs).count() == n
    assert jaccard.near_copies(docs).count() == jaccard.one_of_each(docs).count() == n


EXTRA = SCHEMA + ", k1 long, k_doc long, noise double, positions string, label string, `text hash` string"


def test_pipeline(spark, none, labels):
    import corpus_pipeline as pipeline

    rows = [(*r, 1, 2, 0.5, "p", "l", "h") for r in ROWS]
    folder = common.fresh_path(spark, "odd")
    spark.createDataFrame(rows, EXTRA).repartition(3).write.parquet(f"{folder}/some/documents.parquet")
    labels.write.parquet(f"{folder}/some/labels.parquet")
    none.write.parquet(f"{folder}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{folder}/none/labels.parquet")
    for name, most in (("some", len(ROWS)), ("none", 0)):
        docs = first = spark.read.parquet(f"{folder}/{name}/documents.parquet")
        counts = []
        for stage, step in pipeline.STAGES[:-1]:
            docs = common.stored(step(spark, docs, f"{folder}/{name}"), stage)
            assert docs.columns == first.columns and docs.dtypes == first.dtypes
            counts.append(docs.count())
        assert counts[0] <= most and counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] <= 3 * counts[2]
        if name == "some":
            assert counts[1] > 0 and "4078918989542222" not in "".join(r.text or "" for r in docs.collect())
        packed = pipeline.run(spark, f"{folder}/{name}").collect()
        assert len([r for r in packed if r.piece == 0]) == counts[3]
    # labels of nothing known, and a table without the columns that no stage needs
    spark.createDataFrame([(1, "a b c", "s"), (2, None, None)], "doc_id long, text string, source string").write.parquet(f"{folder}/few/documents.parquet")
    labels.limit(0).write.parquet(f"{folder}/few/labels.parquet")
    assert {r.doc_id for r in pipeline.run(spark, f"{folder}/few").collect()} <= {1, 2}
