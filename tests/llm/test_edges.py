"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest

import corpus_pipeline
from llm_data import docs_of, edges, frame, nothing  # noqa: F401
from mailprism.llm import decontamination, embeddings, language, packing, ppm, quality, secrets, simhash, tokencount, toxicity

IDS = [1, 2, 3, 4, 5, 6, 6, None, None, 7, 8, 9, 2**60 + 1]
LABELS = [(4, 0, 0), (5, 1, 0), (7, 0, 1), (9, 1, None), (None, 1, 1), (5, 1, 0)]


@pytest.fixture(scope="module")
def labels(frame):
    return frame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(frame):
    return frame([(1, None), (2, ""), (3, "two words"), (None, "six words make one short item"), (4, "six words make one short item")], "item_id long, text string")


def per_row(name, docs, labels):
    return {
        "toxicity": lambda: toxicity.toxicity(docs, labels),
        "tokens": lambda: tokencount.token_counts(docs),
        "ppm": lambda: ppm.scores(docs),
        "simhash": lambda: simhash.near_duplicates(docs),
        "quality": lambda: quality.quality(docs, labels),
        "language": lambda: language.languages(docs),
    }[name]()


NAMES = ["toxicity", "tokens", "ppm", "simhash", "quality", "language"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_row(name, edges, labels):
    rows = per_row(name, edges, labels).collect()
    order = lambda ids: sorted(ids, key=lambda x: (x is None, x))
    assert order([r["doc_id"] for r in rows]) == order(IDS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, nothing, labels):
    assert per_row(name, nothing, labels).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_without_labels(name, edges, labels):
    rows = per_row(name, edges, labels.where("false")).collect()
    assert {r["score"] for r in rows} == {0.0 if name == "toxicity" else 0.5}


def test_packing(edges, nothing):
    rows = packing.pack(edges).collect()
    assert sum(r["doc_tokens"] for r in rows if r["start"] == 0 and r["doc_id"] in (1, 2)) == 2
    assert sorted(r["start"] for r in rows if r["doc_id"] == 6) == [0, 0]
    assert {r["doc_id"] for r in rows} == set(IDS)
    assert packing.pack(nothing).collect() == []


def test_decontamination(docs_of, edges, nothing, bench):
    assert decontamination.overlaps(edges, bench).collect() == []
    assert decontamination.overlaps(nothing, bench).collect() == []
    assert decontamination.overlaps(edges, bench.where("false")).collect() == []
    held = docs_of([(None, "here six words make one short item again"), (2, "six words make two short items"), (3, "Six, words make one short ITEM"), (3, "Six, words make one short ITEM")])
    rows = decontamination.overlaps(held, bench).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["item_copies"]) for r in rows), key=str) == [(3, 4, 2), (None, 4, 2)]
    assert sorted(r["doc_id"] for r in decontamination.clean(held, bench).collect()) == [2]


def test_secrets(edges, nothing):
    assert secrets.findings(edges, path="source").collect() == []  # no text holds a secret
    assert secrets.findings(edges, path="source").collect() == []  # no text holds a secret
    assert secrets.findings(nothing).collect() == []
    cleaned = secrets.redact(edges, secrets.findings(edges))
    assert cleaned.columns == edges.columns and cleaned.count() == len(IDS)


def test_embeddings(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1),
            (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.01], 1), (12, [1e-30, 0.0], 1)]
    df = frame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS node", "1 AS tile", "2 AS links")
    got = sorted(((r["vec_id"], r["n_links"], r["component"], r["kept"]) for r in embeddings.near_duplicates(df).collect()), key=str)
    want = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (12, 4, 1, False), (None, 4, 1, False)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted(want, key=str)
    assert embeddings.near_duplicates(df.where("false")).collect() == []


@pytest.fixture(scope="module")
def folder(tmp_path_factory, labels, bench):
    path = str(tmp_path_factory.mktemp("tables"))
    labels.write.parquet(f"{path}/labels.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, name, edges, nothing, folder):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (edges, nothing):
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        assert (out.count() > 0) == (docs is edges)
