"""Exact order statistics of numbers that do not leave the tasks which make them: they are counted by their leading bits, then those
that share the leading bits of a wanted one are counted by all their bits. Numbers that repeat are counted by all their bits at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stradale.plans.staging import discard, materialize

#: Bits that the first count leaves out; numbers that are held before they are counted.
LOW_BITS, HELD = 40, 1 << 21
SCHEMA = "name string, key long, n long, total double, most double"
#: Of a first count that may have keys of all bits; numbers by which one such key has to stand for more, beyond a few keys.
WHOLE_SCHEMA, REPEATS, FEW = SCHEMA + ", whole boolean", 16, 4096


def keys_of(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def number_of(key: int) -> float:
    return float(np.array([key ^ ((key >> 63) & (2**63 - 1))], np.int64).view(np.float64)[0])


class Counted:
    """Counts of numbers by name in one task: by leading bits, with sums and maxima, or by all bits of those whose leading bits are ``wanted``.

    ``repeats``: the first count is by all bits too, its rows of :data:`WHOLE_SCHEMA`, wherever that makes few rows.
    """

    def __init__(self, wanted: dict[str, list[int]] | None = None, repeats: bool = False):
        self.wanted, self.held, self.size = wanted, {}, 0
        self.repeats = repeats and wanted is None

    def add(self, name: str, x: np.ndarray) -> None:
        if self.wanted is not None:
            x = x[np.isin(keys_of(x) >> LOW_BITS, self.wanted.get(name, []))]
        if len(x):
            self.held.setdefault(name, []).append(x)
            self.size += len(x)

    @property
    def full(self) -> bool:
        return self.size >= HELD

    def take(self) -> pd.DataFrame:
        """Rows of the schema for what was added since the last call."""
        out = [pd.DataFrame({"name": [], "key": [], "n": [], "total": [], "most": []}).astype({"name": str, "key": "int64", "n": "int64"})]
        out[0] = out[0].assign(whole=False) if self.repeats else out[0]
        for name, parts in self.held.items():
            x = np.concatenate(parts)
            key = keys_of(x) >> (LOW_BITS if self.wanted is None and not self.repeats else 0)
            key, n = np.unique(key, return_counts=True)
            whole = len(key) <= max(FEW, len(x) // REPEATS)
            if self.repeats and not whole:
                key, start = np.unique(key >> LOW_BITS, return_index=True)
                n = np.add.reduceat(n, start)
            total, most = np.zeros(len(key)), np.full(len(key), x.max())
            total[0] = x.sum()
            out.append(pd.DataFrame({"name": name, "key": key, "n": n, "total": total, "most": most} | ({"whole": whole} if self.repeats else {})))
        self.held, self.size = {}, 0
        return pd.concat(out[1:] or out)


def order_statistics(count: Callable[[dict | None], DataFrame], ranks: Callable[[str, int], list[int]]) -> dict[str, dict]:
    """By name: ``n``, ``total``, ``most`` and ``at``, the numbers at the ``ranks(name, n)``, counted from 0.

    ``count`` makes the rows of :class:`Counted` for all numbers; it is called with what to count, twice, but once where the first count
    is by all bits for all numbers that share the leading bits of a wanted one.
    """
    summed = lambda df, *by: df.groupBy("name", "key", *by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))
    first = count(None)
    told = "whole" in first.columns
    known = coarse = materialize(summed(first, *["whole"][:told]), "counts")
    if told:
        coarse = summed(known.withColumn("key", F.when(F.col("whole"), F.shiftright("key", LOW_BITS)).otherwise(F.col("key"))))
    out = {r["name"]: {"n": r["n"], "total": r["total"], "most": r["most"]} for r in coarse.groupBy("name").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most")).collect()}
    for name, one in out.items():
        one["ranks"], one["at"] = ranks(name, one["n"]), {}

    def holding(table: DataFrame, before: dict) -> list:
        """Rows of which the numbers have one of the ranks, with the numbers before them."""
        end = F.sum("n").over(W.partitionBy("name", "lead").orderBy("key"))
        led = table.withColumn("lead", F.col("key") if before else F.lit(0)).withColumn("lead", F.shiftright("lead", LOW_BITS)).withColumn("_end", end)
        wants = [(name, lead, r - low) for name, one in out.items() for r in one["ranks"] for lead, low in (before.get((name, r), (0, 0)),)]
        hit = [(F.col("name") == name) & (F.col("lead") == lead) & (F.col("_end") > r) & (F.col("_end") - F.col("n") <= r) for name, lead, r in wants]
        rows = led.where(F.array_contains(F.array(*hit), True)).collect() if hit else []
        return [next(x for x in rows if x["name"] == name and x["lead"] == lead and x["_end"] - x["n"] <= r < x["_end"]) for name, lead, r in wants]

    wants = [(name, r) for name, one in out.items() for r in one["ranks"]]
    found = holding(coarse, {})
    before = {k: (x["key"], x["_end"] - x["n"]) for k, x in zip(wants, found)}
    if wants:
        leads = {name: sorted({before[name, r][0] for r in one["ranks"]}) for name, one in out.items()}
        share = lambda rows, lead: rows.where(F.array_contains(F.array(*((F.col("name") == name) & lead.isin(some) for name, some in leads.items())), True))
        if told and share(known.where("NOT whole"), F.col("key")).isEmpty():
            fine = share(known.where("whole"), F.shiftright("key", LOW_BITS))
        else:
            fine = materialize(summed(count(leads)), "counts")
        for (name, r), x in zip(wants, holding(fine, before)):
            out[name]["at"][r] = number_of(x["key"])
        discard(fine)
    discard(known)
    return out


def median(one: dict) -> float:
    """Of the ranks of :func:`middle`."""
    return sum(0.5 * one["at"][r] for r in ((one["n"] - 1) // 2, one["n"] // 2))


def middle(n: int) -> list[int]:
    return sorted({(n - 1) // 2, n // 2})
