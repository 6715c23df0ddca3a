"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """The fold of a row: CRC-32 of its id as text, modulo ``parts``; -1 for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)), F.lit(-1))


def bounded(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, those whose ids have the smallest hashes: the same rows however the table is laid out."""
    return rows.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(most)


def texts_of(docs: DataFrame, picked: list, id_col: str, text_col: str, max_chars: int) -> list:
    """Rows ``(id, text)`` of the picked ids, one each: of an id that repeats, the first in order of its texts with at most ``max_chars`` characters."""
    spark = docs.sparkSession
    ids = spark.createDataFrame([(x,) for x in sorted(set(picked))], f"id {docs.schema[id_col].dataType.simpleString()}")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(f"text is not null and length(text) <= {max_chars}")
    return rows.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")).collect()


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, held_fold: int, id_col: str = "doc_id", text_col: str = "text", per_class: dict[int, int] | None = None, max_chars: int = 20_000) -> tuple[list[str], list[int], float]:
    """Texts and labels of a bounded sample of labelled rows outside the fold ``held_fold`` of four, and the share of label 1 in all of them.

    ``per_class`` bounds the rows of each label. Of an id with several texts or labels the first text and the largest label count;
    null labels, ids and texts are left out.
    """
    known = labels.where((fold(id_col, 4) != held_fold) & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = {}
    for y, most in (per_class or {0: 3000, 1: 3000}).items():
        for r in bounded(known.where(F.col("y") == y), id_col, most).collect():
            picked[r[id_col]] = max(y, picked.get(r[id_col], y))
    rows = texts_of(docs, list(picked), id_col, text_col, max_chars) if picked else []
    rows = sorted((r.id, r.text) for r in rows)
    total = sum(counts.values())
    return [t for _, t in rows], [picked[i] for i, _ in rows], counts.get(1, 0) / total if total else 0.5
