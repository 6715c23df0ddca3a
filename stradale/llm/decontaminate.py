"""Benchmark decontamination: short test items found inside long documents.

An item is in a document when at least ``num / den`` of the item's set of five-word shingles is in the document's.
Items are partitioned by the size of their sets, by powers of two. The size of a partition's largest set says how many shingles a
contained item of it may lack, and so how many minima the MinHash sketch of an item keeps: as many, and ``HITS`` more. A document's
sketch for a partition is its shingle hashes up to the largest minimum kept there, and the partition is probed with these alone. An
item of which at least the minima kept, less those that it may lack, are met is a candidate; none that is contained can meet fewer,
so the search misses nothing. Candidates are then verified by exact containment.

The items are the query set. They are sent in blocks of bounded size, one at a time, and every block passes over all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stradale.llm import words
from stradale.llm.subwords import slices
from stradale.plans.staging import discard, materialize

#: Bytes of item text sent to the executors at a time; minima beyond those that a contained item may lack.
BLOCK_BYTES, HITS = 16_000_000, 3
_LOW = 20


def lacking(n: int, num: int, den: int) -> int:
    """Shingles that a contained item with ``n`` may lack."""
    return n - (num * n + den - 1) // den


class Partition:
    """The sketches of the items whose sets have more than ``upper / 2`` and up to ``upper`` shingles of one width."""

    def __init__(self, width: int, upper: int, items: list[int], sets: list[np.ndarray], num: int, den: int):
        self.width, self.upper = width, upper
        keep = lacking(upper, num, den) + HITS
        minima = [sets[k][:keep] for k in items]  # sets are sorted
        keys, owner = np.concatenate(minima), np.repeat(items, list(map(len, minima)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.largest = keys[order], owner[order], keys.max()
        self.least = {k: max(1, len(m) - lacking(len(sets[k]), num, den)) for k, m in zip(items, minima)}

    def probe(self, hashes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """Candidates ``(document, item)``, given hashes of documents' shingles and the documents that they are of."""
        sketch = hashes <= self.largest
        hashes, doc = hashes[sketch], doc[sketch]
        lo, hi = np.searchsorted(self.keys, hashes), np.searchsorted(self.keys, hashes, "right")
        met = {(d, k, a) for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist()) if b > a for k in self.owner[a:b].tolist()}
        hits: dict[tuple[int, int], int] = {}
        for d, k, _ in met:
            hits[d, k] = hits.get((d, k), 0) + 1
        return [pair for pair, n in hits.items() if n >= self.least[pair[1]]]


class Index:
    """The partitions and the whole sets of a block of items."""

    def __init__(self, texts: list[bytes | None], num: int, den: int):
        self.num, self.den, self.sets, classes = num, den, [], {}
        for k, text in enumerate(texts):
            ids = words.hashes(words.split(text))
            width = min(words.WIDTH, len(ids))
            self.sets.append(np.unique(words.grams(ids, width)) if width else np.zeros(0, np.uint64))
            if width:
                classes.setdefault((width, 1 << max(0, len(self.sets[-1]) - 1).bit_length()), []).append(k)
        self.partitions = [Partition(width, upper, items, self.sets, num, den) for (width, upper), items in sorted(classes.items())]
        self.marks: dict[int, np.ndarray] = {}  # of the minima of all partitions of a width: most shingles stop here
        for p in self.partitions:
            self.marks.setdefault(p.width, np.zeros(1 << _LOW, bool))[p.keys & np.uint64((1 << _LOW) - 1)] = True

    def search(self, texts: list[bytes | None]):
        """``(text, item, shingles in common)`` of a batch of texts, all those with enough containment."""
        tokens = [words.split(t) for t in texts]
        ids = words.hashes([w for x in tokens for w in x])
        ends = np.cumsum([len(x) for x in tokens])
        for width, mark in self.marks.items():
            grams = words.grams(ids, width)
            at = np.flatnonzero(mark[grams & np.uint64((1 << _LOW) - 1)])
            doc = np.searchsorted(ends, at, "right")
            inside = at + width <= ends[doc]  # not across the end of a text
            hashes, doc = grams[at[inside]], doc[inside]
            known: dict[int, np.ndarray] = {}
            for d, k in sorted(pair for p in self.partitions if p.width == width for pair in p.probe(hashes, doc)):
                if d not in known:
                    known = {d: np.unique(words.grams(ids[ends[d] - len(tokens[d]) : ends[d]], width))}
                common = int(np.isin(self.sets[k], known[d], assume_unique=True).sum())
                if self.den * common >= self.num * len(self.sets[k]):
                    yield d, k, common


def _blocks(items: DataFrame, id_col: str, text_col: str, num: int, den: int):
    """Bounded blocks of the items: ids, a broadcast of their index, and whether another block follows."""
    spark = items.sparkSession
    words.small_batches(spark)
    size = items.agg(F.sum(F.octet_length(F.col(text_col)) + 64)).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("b")).where("b is not null")
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("i", "b"), F.lit(n)) == k).collect()
        yield [r.i for r in block], spark.sparkContext.broadcast(Index([bytes(r.b) for r in block], num, den)), k + 1 < n


def find_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """A row for each document and item in it: ``doc_id, item_id, n_item_shingles, n_common``.

    Words are lower-cased as elsewhere. An item with fewer than five words is one shingle of its whole length, sought at that
    length. Null and empty texts match nothing; repeated documents or items match each on their own. Texts are read whole, however
    long; other columns are not read; either table empty gives no rows. No shuffle. Where the items fill more than one block, what
    each block finds is written in the shared folder, so one block is held at a time.
    """
    kinds = to_arrow_type(docs.schema[doc_id].dataType), to_arrow_type(items.schema[item_id].dataType)
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, n_item_shingles long, n_common long"
    rows = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).cast("binary").alias("body"))
    out = None
    for names, index, more in _blocks(items, item_id, item_text, num, den):

        def run(batches, names=names, index=index):
            for batch in (part for whole in batches for part in slices(whole)):
                found = list(index.value.search(batch.column(1).to_pylist()))
                ids = batch.column(0).cast(kinds[0]).take(pa.array([d for d, _, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([names[k] for _, k, _ in found], kinds[1]), pa.array([len(index.value.sets[k]) for _, k, _ in found], pa.int64()), pa.array([c for _, _, c in found], pa.int64())], ["doc_id", "item_id", "n_item_shingles", "n_common"])

        part = rows.mapInArrow(run, schema)
        if more or out is not None:
            part = materialize(part, "found")
            index.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the rows in which an item is found; all columns, whatever their names.

    Null and empty texts stay; repeated rows go or stay together; without items all stay. No shuffle. Where the items fill more
    than one block, what each block leaves is written in the shared folder.
    """
    at = docs.columns.index(doc_text)
    before = None
    for _, index, more in _blocks(items, item_id, item_text, num, den):

        def run(batches, index=index):
            for batch in (part for whole in batches for part in slices(whole)):
                hit = {d for d, _, _ in index.value.search(batch.column(at).cast(pa.binary()).to_pylist())}
                yield batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))

        left = docs.mapInArrow(run, docs.schema)
        if more:
            left = materialize(left, "left")
            index.unpersist()
            if before is not None:
                discard(before)
            before = left
        docs = left
    return docs


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def leak_sql(docs: str, items: str = "benchmark") -> str:
    """DuckDB SQL for the rows of :func:`find_items`."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
  SELECT d.doc_id, i.item_id, i.n AS n_item_shingles, count(*) AS n_common FROM (
    SELECT item_id, k, len(s) AS n, unnest(s) AS h FROM (
      SELECT item_id, least(len(w), 5) AS k, list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i+least(len(w), 5)-1], ' '))) AS s
      FROM (SELECT item_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM {items}) WHERE len(w) > 0)) i
  JOIN (
    SELECT doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' ')))) AS h
    FROM (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM {docs}),
      (SELECT 5 AS k UNION SELECT DISTINCT least(5, len(regexp_extract_all({lower}, '[^\x20\x09-\x0D]+'))) FROM {items} WHERE text <> '')
    WHERE len(w) >= k AND k > 0) d ON d.h = i.h AND d.k = i.k
  GROUP BY d.doc_id, i.item_id, i.n HAVING 100 * count(*) >= 80 * i.n"""


ORACLE = leak_sql("documents")
