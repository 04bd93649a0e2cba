"""The pipeline's stages on the smallest tables: each keeps what it should, and the columns of documents."""

from __future__ import annotations

import corpus_pipeline
from gridledger.llm import entry, language_id, ngram_join, packing, quality
from gridledger.llm.shared import BATCH_BYTES, saved, table
from tests.conftest import SF


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF), name)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen.append(docs.count())
    assert seen[1] >= 0.9 * seen[0] and seen[2] < seen[1] and seen[3] < seen[2] and seen[4] == seen[3]
    assert docs.filter("text rlike '[a-z0-9]@[a-z0-9]+[.]'").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.select("doc_id").distinct().count() == seen[4]


def test_queries_by_number():
    assert sorted({int(name[2:].split("_")[0]) for name in entry.QUERIES}) == list(range(1, 14))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid bigint, text2 string, score double, spans string"


def odd_rows() -> list[tuple]:
    prose = "The house by the river was sold to a teacher who had lived there as a child, and the garden is open again."
    german = "Das Haus am Fluss wurde an eine Lehrerin verkauft, die dort als Kind gewohnt hatte, und der Garten ist wieder offen."
    rows = [(1, prose, "en"), (2, german, "de"), (3, None, "en"), (4, "", None), (5, "1234 !?", "en"), (None, german + " Ja.", None), (6, prose, "en"), (6, prose, "en"), (7, (prose + " ") * 3000, None), (8, prose + " Mail a@b.org", "en")]
    return [(d, t, lang, None, len(t or ""), 7, "x", 0.5, "y") for d, t, lang in rows]


def test_odd_rows_go_through_every_stage(spark):
    docs = saved(spark.createDataFrame(odd_rows(), SCHEMA), "odd")
    ids = lambda df: sorted((r["doc_id"] or -1 for r in df.collect()))
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, SF)
    assert ids(known) == [-1, 1, 2, 6, 6, 7, 8]
    assert {r["lang"] for r in known.collect() if r["doc_id"] in (None, 7)} <= {"de", "en"}
    assert set(ids(stages["quality"](spark, docs, SF))) <= {-1, *range(1, 9)}
    assert ids(stages["ngram_join"](spark, docs, SF)) == [1, 2, 3, 4, 5]  # 7 repeats 1's words and adds four shingles, 8 two: near copies
    clean = stages["private_data"](spark, docs, SF)
    assert ids(clean) == sorted(r[0] or -1 for r in odd_rows())
    assert [r["text"] for r in clean.collect() if r["doc_id"] in (3, 4)] in ([None, ""], ["", None])
    assert next(r["text"] for r in clean.collect() if r["doc_id"] == 8).endswith("Mail <EMAIL>")
    assert set(ids(stages["packing"](spark, docs, SF))) == {-1, *range(1, 9)}


def test_empty_tables_go_through_every_stage(spark):
    docs = saved(spark.createDataFrame([], SCHEMA), "none")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name


def in_small_batches(made):
    """made, whose functions fail on a batch of much more than BATCH_BYTES."""
    most = BATCH_BYTES + (1 << 18)

    def make(*args):
        real = made(*args)

        def run(batches):
            def seen():
                for batch in batches:
                    assert batch.nbytes <= most, f"a batch of {batch.nbytes} bytes"
                    yield batch

            yield from real(seen())

        return run

    return make


def test_texts_reach_tasks_in_small_batches(spark, monkeypatch):
    """An executor holds a batch for each core, so its bytes are bounded; before, 10,000 texts came at once."""
    for module, name in ((language_id, "_predict"), (quality, "_apply"), (ngram_join, "_signatures"), (ngram_join, "_verify"), (packing, "_pieces")):
        monkeypatch.setattr(module, name, in_small_batches(getattr(module, name)))
    text = "array_join(transform(sequence(1, 4000), x -> concat('the', pmod(hash(if(x > 20, id div 300, id), x), 5000))), ' ')"
    rows = spark.range(0, 600, 1, 1).selectExpr("id as doc_id", f"{text} as text", "if(id % 2 = 0, 'en', 'de') as lang", "'web' as source", "0L as n_chars")
    docs = saved(rows, "long")  # 17 MB in two groups of near copies
    stages = dict(corpus_pipeline.STAGES)
    assert language_id.identify(docs, language_id.new_network(["de", "en"])).count() == 600
    assert stages["quality"](spark, docs, SF).count() <= 600
    assert [r["doc_id"] for r in stages["ngram_join"](spark, docs, SF).orderBy("doc_id").collect()] == [0, 300]
    assert stages["packing"](spark, docs, SF).select("doc_id").distinct().count() == 600
