"""Row numbers hold when a later scan of the same table is split in another way."""

from __future__ import annotations

import pytest

import corpus_pipeline
from gridledger.llm import ngram_join, private_data, shared

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SIZE = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def docs(spark, tmp_path, monkeypatch):
    """A table of several files, whose scans are split differently from the first saved table on."""
    same = " ".join(f"same{k}" for k in range(60))
    rows = [(i, f"{same} end{i}" if i % 4 == 1 else " ".join(f"w{i}x{k}" for k in range(5 + 20 * i)) + f" mail{i}@example.org", "en", "s", 1) for i in range(12)]
    for i in range(0, 12, 2):
        spark.createDataFrame(rows[i : i + 2], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    before, plain = spark.conf.get(SIZE), shared.saved

    def moved(df, name):
        out = plain(df, name)
        spark.conf.set(SIZE, "1k")
        return out

    for module in (shared, ngram_join, private_data, corpus_pipeline):
        monkeypatch.setattr(module, "saved", moved)
    spark.conf.set(SIZE, "128m")
    yield spark.read.parquet(str(tmp_path / "docs"))
    spark.conf.set(SIZE, before)


def test_links_when_splits_change(docs):
    got = {r["doc_id"]: (r["n_links"], r["kept"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: (2 if i % 4 == 1 else 0, i % 4 != 1 or i == 1) for i in range(12)}


def test_one_of_each_when_splits_change(spark, docs):
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 10, 11]


def test_masking_when_splits_change(docs):
    got = {r["doc_id"]: r["text"] for r in private_data.masked(docs).collect()}
    assert len(got) == 12
    assert all(("<EMAIL>" in t) == (i % 4 != 1) and "@" not in t for i, t in got.items())
