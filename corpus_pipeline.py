"""Raw documents to packed training windows: language, quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), with docs read from Parquet, works on all rows its predecessor kept, and
returns a DataFrame: the columns of documents, but for the last, whose rows are the pieces of packed windows.
All of them take nulls in any column, empty and very long texts, repeated rows, empty tables and further columns
(which are dropped before any clash of names); what each does with them stands in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import language_id, quality
from gridledger.llm.ngram_join import near_duplicates
from gridledger.llm.packing import pack
from gridledger.llm.private_data import masked
from gridledger.llm.shared import numbered, saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is in a language if the network gives it so many times the probability that a guess would have.
SURE = 1.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be determined: null and empty texts, those without a letter, and those that
    the network gives no language hardly more than chance. A null lang becomes the language found.

    Whole texts are read; repeated rows are judged each, null ids like others; without a known lang all are dropped."""
    net = language_id.fit(docs.filter(~language_id.held_out()))
    least = SURE / len(net.languages) if net and len(net.languages) > 1 else 0.0
    found = language_id.identify(docs, net, keep=COLUMNS, least=least)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier predicts to be of low quality.

    Null texts count as empty ones; repeated rows are judged each; scores of exactly a half stay, as all do without labels."""
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out())
    model = quality.fit(docs.filter(~quality.held_out()), labels)
    return quality.classify(docs, model, keep=COLUMNS, only_good=True).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the smallest id, null ids last, and one of repeated rows.

    Null and empty texts are no duplicates of each other, and stay."""
    docs = numbered(docs.select(*COLUMNS))
    kept = near_duplicates(docs, rid="rid").filter("kept").select("rid")
    return docs.join(kept, "rid", "left_semi").select(*COLUMNS)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by their kinds; all documents stay, and null and empty texts as they are."""
    return masked(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone; repeated rows are packed each; a null id stays null."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality", good_quality),
    ("ngram_join", one_of_each),
    ("private_data", without_private_data),
    ("packing", packed),
]

#: SQL can't express the trained models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
