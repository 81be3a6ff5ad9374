"""The pipeline's stages on hard cases and on empty tables."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .conftest import SCHEMA, documents  # noqa: E402


@pytest.mark.parametrize("which", ["tables", "no_rows"])
def test_stages_keep_columns_and_take_effect(spark, request, tmp_path, which):
    folder = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == SCHEMA.names
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
    if which == "no_rows":
        assert counts == [0] * 6
        return
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    clean = spark.read.parquet(f"{tmp_path}/3")
    rows = {r.doc_id: r for r in clean.collect()}
    assert 5 in rows and 6 not in rows and 7 not in rows and rows[1].text == dict(documents())[1]
    fine = [t for i, t in documents() if i is not None and i >= 200 and "fine" in t]
    assert sum("<EMAIL>" in (r.text or "") and "@" not in r.text for r in rows.values()) > 0.8 * len(fine)


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns)
