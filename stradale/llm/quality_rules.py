"""Quality rules as a ledger: measures and failure bits of every document, policies applied to the bits afterwards.

Every rule is evaluated once per document. The ledger keeps the measures and one integer whose bit ``k`` says that rule ``k``
failed. A policy is a named, versioned set of rules: a mask. Applying one, comparing several or computing what each rule
contributes are bitwise expressions over the ledger; no text is read again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stradale.llm import words

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
#: Name and failing condition, in the order of the bits. Integer arithmetic only.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "15 * n_symbols > word_chars"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("shouting", "n_letters >= 40 and 2 * n_upper > n_letters"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "2 * word_chars < 3 * n_words"),
)
BASE = ("few_words", "repeated_words")
POLICIES = {"base": BASE, "v1": (*BASE, "symbols", "shouting"), "v2": tuple(name for name, _ in RULES)}
POLICY = "v2"

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_FOLLOW = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"


def _count(text: bytes, kinds: bytes) -> int:
    return len(text) - len(text.translate(None, kinds))


def repeated_words(tokens: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(tokens)
    if n < 4:
        return 0
    windows = words.grams(words.hashes(tokens), 3)
    order = np.argsort(windows)
    same = np.diff(windows[order]) == 0
    if not same.any():
        return 0
    often = np.zeros(len(windows), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : k + len(windows)] |= often
    return int(inside.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``; all zero for null."""
    if not text:
        return (0,) * len(MEASURES)
    tokens = text.split()
    points = len(text) - _count(text, _FOLLOW) - _count(text, _SPACE)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(tokens), points, _count(text, SYMBOLS), len(lines) - len(set(lines)), repeated_words(tokens), len(lines), _count(text, _UPPER), _count(text, _LETTERS))


def _measurer(kinds: list[pa.DataType], names: list[str], at: int):
    def run(batches):
        for batch in batches:
            got = np.array([measure(t) for t in batch.column(at).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(kind) for k, kind in enumerate(kinds)), *(pa.array(got[:, k]) for k in range(len(MEASURES)))], [*names, *MEASURES])

    return run


def ledger(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` (``doc_id`` alone by default), the measures, and ``failures``: bit ``k`` is set if rule ``k`` fails.

    One pass over ``docs``, no shuffle. Null and empty texts measure zero, so they fail ``few_words``. Repeated rows stay, each with
    the same measures; texts are read whole, however long. Columns of ``keep`` named like a measure or ``failures`` give way. An
    empty table gives an empty ledger.
    """
    keep = [c for c in keep or ["doc_id"] if c not in (*MEASURES, "failures")]
    kinds = [to_arrow_type(docs.schema[c].dataType) for c in keep]
    schema = ", ".join([*(f"`k{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), *(f"{m} long" for m in MEASURES)])
    words.small_batches(docs.sparkSession)
    cols = keep if text_col in keep else [*keep, text_col]
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(cols)))
    out = rows.mapInArrow(_measurer(kinds, [f"k{i}" for i in range(len(keep))], cols.index(text_col)), schema)
    bits = sum((F.expr(f"case when {rule} then {1 << k} else 0 end") for k, (_, rule) in enumerate(RULES)), F.lit(0))
    out = out.withColumn("failures", bits.cast("int"))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *MEASURES, "failures")


def mask(rules) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in set(rules))


def passes(policy: str, failures: str = "failures") -> Column:
    """Whether a document fails no rule of the policy."""
    return F.col(failures).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy keeps with and without it.

    One aggregation of the ledger; a row per rule. An empty ledger gives rows of zeros.
    """
    whole = mask(POLICIES[policy])
    hit = lambda bits: F.count_if(F.col("failures").bitwiseAND(F.lit(bits)) == 0)
    parts = [hit(whole).alias("kept"), F.count("*").alias("n")]
    for k, (name, _) in enumerate(RULES):
        if name in POLICIES[policy]:
            parts += [hit(1 << k).alias(f"free_{name}"), hit(whole & ~(1 << k)).alias(f"without_{name}")]
    one = book.agg(*parts)
    rows = F.array(*(F.struct(F.lit(name).alias("rule"), (F.col("n") - F.col(f"free_{name}")).alias("n_failed"), (F.col(f"without_{name}") - F.col("kept")).alias("n_failed_alone"), F.col("kept").alias("n_kept"), F.col(f"without_{name}").alias("n_kept_without")) for name, _ in RULES if name in POLICIES[policy]))
    return one.select(F.inline(rows))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return book.select("doc_id", *MEASURES[:5], (~passes("base")).alias("base_failed"), (passes("base") & passes(POLICY)).alias("kept"), "failures")


_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
o AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM o) GROUP BY doc_id),
m AS (
  SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters
  FROM l LEFT JOIN r ON l.doc_id = r.doc_id),
f AS (SELECT *, CAST({_BITS} AS INTEGER) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & {mask(BASE)}) <> 0 AS base_failed,
  (failures & {mask(BASE) | mask(POLICIES[POLICY])}) = 0 AS kept, failures FROM f
"""
