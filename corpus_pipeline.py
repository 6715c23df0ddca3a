"""From raw documents to token ids: language, quality, near copies, benchmark leaks, tokens.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stradale.llm import decontaminate, language_id, quality_rules, sentencepiece
from stradale.llm.near_dups import ngram_jaccard_join
from stradale.plans.staging import discard, materialize

#: Ids of dropped documents that are broadcast at most; more of them are joined by a shuffle.
MAX_BROADCAST = 500_000


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator makes, and the name that each column has there."""
    names = {c: f"stage_column_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(own).alias(c) for c, own in names.items()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without text or letters, or unlikely in every language, go.

    All stay if none was learned, so an empty table stays empty. Repeated rows stay or go together; null ids and languages are not
    learned from but told like others. All columns are kept, whatever their names.
    """
    model = language_id.fit(docs)
    if not model.langs:
        return docs
    rows, names = _renamed(docs)
    told = language_id.identify(rows, model, text_col=names["text"], likelihood=True)
    return _back(told.where((F.col("lang_pred") != "und") & (F.col("likelihood") >= language_id.LEAST)), names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the policy. Null and empty texts fail; repeated rows stay or go together; all columns are kept, whatever their names."""
    rows, names = _renamed(docs)
    book = quality_rules.ledger(rows, keep=rows.columns, text_col=names["text"])
    return _back(book.where(quality_rules.passes(quality_rules.POLICY)), names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links, that with the smallest id; where ids repeat or are null, one of its rows, with an id if any has.

    Texts without words link with none and stay. All columns are kept, whatever their names; an empty table stays empty.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = ngram_jaccard_join(docs).where("doc_id <> component_id").select("doc_id")
        return _without(docs, "doc_id", gone)
    key = next(k for k in (f"row_{n}" for n in count()) if k not in docs.columns)
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    told = ngram_jaccard_join(rows, key).select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, "doc_id"), key)
    told = materialize(told, "told")
    first = told.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("f"))
    gone = told.join(first, "component_id").where(F.col(key) != F.col(f"f.{key}")).select(key)
    return _without(rows, key, gone).select(*docs.columns)


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    gone = materialize(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone, key, "left_anti").select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and empty texts and items match nothing; repeated rows stay or go together; all columns are kept."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, ``token_ids``, and whether they decode to its text, ``exact``, in place of the text.

    Null texts have no ids; repeated rows are encoded alike; the other columns are kept, but for any named like the new ones.
    """
    return sentencepiece.encode(docs, sentencepiece.load(), [c for c in docs.columns if c != "text"])


STAGES = [("language", language), ("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("tokens", tokens)]

#: Viterbi segmentation and learned languages are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
            if before is not None:
                discard(before)
            before = docs
    return docs
