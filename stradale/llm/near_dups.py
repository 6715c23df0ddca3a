"""N-gram Jaccard join: grouped prefix join with exact verification.

Two documents link when the Jaccard similarity of their sets of five-word shingles reaches a threshold. For sets with
``|A & B| >= t * |A | B|``, the ``n - ceil(t * n) + 1`` first shingles of each, in any order common to all documents, meet.
The order used here is by document frequency, rarest first, so passages that many documents share come last.

1. *Frequencies.* Documents are dealt in small groups. Each group asks for the frequency of the shingles it holds, as
   sorted, delta-coded keys dealt by key range; each range counts what all groups ask and answers in one byte per key. Frequencies
   are exact up to collisions of the keys; these only change the order, never which pairs are found.
2. *Prefixes.* A shingle found in one document cannot link it, so a document whose prefix holds only such shingles is done.
   That leaves few documents; equal sets are collapsed into one.
3. *Groups.* Documents with equal prefix and size form one group; lists of groups by shingle are built, not of documents.
4. *Leaders.* In every group, then in every list, one leader is verified against the others. What links is one component; lists
   that lie in one component are done.
5. *Remainder.* All group pairs of a list whose sizes allow a link and whose members are still in different components are
   expanded and verified. So no link that could join two components is missed, and copies and near copies that already
   are joined are not paired.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stradale.llm import words
from stradale.operators.components import connected_components
from stradale.plans.staging import discard, materialize, release_shuffles

#: Bytes of text that one group of documents holds, and keys that one range of keys is asked for.
GROUP_BYTES, RANGE_KEYS = 2_000_000, 800_000
#: Rounds in which leaders of the lists are verified before the exact remainder.
LEADER_ROUNDS = 3
#: Links between components that one task joins (two numbers each); more, which are counted first, are joined in rounds by all.
FEW_LINKS = 100_000


def _pack(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, compressed."""
    steps = np.diff(sorted_keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _expand(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _code(count: np.ndarray) -> np.ndarray:
    """Frequencies in one byte: exact to 127, then four steps for each doubling. Only the order matters."""
    log = 127 + np.ceil(4 * np.log2(np.maximum(count, 1) / 127.0))
    return np.where(count < 128, count, np.minimum(log, 255)).astype(np.uint8)


def prefix_length(n, num: int, den: int):
    """Shingles of a set of ``n`` that any set with a similarity of ``num / den`` must meet."""
    return n - (num * n + den - 1) // den + 1


def _asker(bits: int, ranges: int):
    low = np.uint64(64 - bits)

    def ask(table: pa.Table) -> pa.Table:
        sets = [words.shingles(t) for t in table["body"].to_pylist()]
        keys, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]) >> low, return_counts=True)
        place = (keys.astype(np.float64) * (ranges / 2.0**bits)).astype(np.int64).clip(0, ranges - 1)
        cuts = np.flatnonzero(np.diff(place, prepend=-1)).tolist()
        rows = [(int(place[a]), _pack(keys[a:b]), _squeeze(counts[a:b].astype(np.uint32))) for a, b in zip(cuts, [*cuts[1:], len(keys)])]
        group = table["g"][0].as_py()
        return pa.table({"place": pa.array([r[0] for r in rows], pa.int64()), "g": pa.array([group] * len(rows), pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    return ask


def _answer(table: pa.Table) -> pa.Table:
    keys = [_unpack(x) for x in table["keys"].to_pylist()]
    counts = [_expand(x, np.uint32) for x in table["counts"].to_pylist()]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = _code(np.bincount(where, np.concatenate(counts), len(distinct)).astype(np.int64))[where]
    cuts = np.cumsum([0, *map(len, keys)])
    return pa.table({"g": table["g"], "place": table["place"], "codes": pa.array([_squeeze(total[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())})


def _prefixer(bits: int, num: int, den: int, kind: pa.DataType):
    low = np.uint64(64 - bits)

    def prefixes(docs: pa.Table, replies: pa.Table) -> pa.Table:
        sets = [words.shingles(t) for t in docs["body"].to_pylist()]
        everything = np.concatenate([*sets, np.zeros(0, np.uint64)]) >> low
        keys = np.unique(everything)
        order = np.argsort(np.array(replies["place"].to_pylist(), np.int64)) if replies.num_rows else []
        codes = [_expand(x, np.uint8) for x in replies["codes"].to_pylist()]
        codes = np.concatenate([*(codes[i] for i in order), np.zeros(0, np.uint8)])
        freq = codes[np.searchsorted(keys, everything)] if len(keys) else codes
        heads, bodies, sigs, names, known, at = [], [], [], [], [], 0
        for s in sets:
            n, f = len(s), freq[at : at + len(s)]
            at += n
            often = np.flatnonzero(f > 1)
            known.append(len(often))
            take = prefix_length(n, num, den) - (n - len(often)) if n else 0
            if take > 0:
                head = s[often[np.lexsort((s[often], f[often]))[:take]]]
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                names.append(hashlib.blake2b(n.to_bytes(8, "little") + np.sort(head).tobytes(), digest_size=16).digest())
                heads.append(head.view(np.int64))
                bodies.append(s.view(np.int64))
            else:
                heads.append(None), bodies.append(None), sigs.append(None), names.append(None)
        rid = (docs["g"][0].as_py() << 32) + np.arange(docs.num_rows, dtype=np.int64) if docs.num_rows else []
        longs = pa.list_(pa.int64())
        return pa.table({"rid": pa.array(rid, pa.int64()), "doc_id": docs["id"].cast(kind), "n": pa.array([len(s) for s in sets], pa.int64()), "m": pa.array(known, pa.int64()), "sig": pa.array(sigs, pa.binary()), "name": pa.array(names, pa.binary()), "prefix": pa.array(heads, longs), "shingles": pa.array(bodies, longs)})

    return prefixes


def shingle_prefixes(docs: DataFrame, id_col: str, text_col: str, num: int, den: int) -> DataFrame:
    """A row per document: ``rid`` (unique), ``doc_id``, ``n`` shingles; where a link is possible also ``sig`` (a digest of the
    set), ``name`` (a digest of prefix and size), ``prefix`` and ``shingles``, else nulls. Written in the shared folder."""
    words.small_batches(docs.sparkSession)
    body = F.col(text_col).cast("binary")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("x"), F.count("*").alias("n")).first()
    size, rows = total["x"] or 0, total["n"]
    groups = max(1, math.ceil(size / GROUP_BYTES), math.ceil(rows / 20_000))
    keys = size // 6 + rows + 1
    bits = min(62, max(24, math.ceil(math.log2(keys)) + 10))
    ranges = max(1, math.ceil(keys / RANGE_KEYS))
    dealt = docs.select(F.col(id_col).alias("id"), body.alias("body")).withColumn("g", F.pmod(F.xxhash64("id", "body"), F.lit(groups))).repartition("g")
    asked = dealt.groupBy("g").applyInArrow(_asker(bits, ranges), "place long, g long, keys binary, counts binary")
    told = asked.groupBy("place").applyInArrow(_answer, "g long, place long, codes binary")
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"rid long, doc_id {kind.simpleString()}, n long, m long, sig binary, name binary, prefix array<long>, shingles array<long>"
    out = dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_prefixer(bits, num, den, to_arrow_type(kind)), schema)
    return materialize(out, "prefixes")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough; the number of shingles in common is counted exactly."""
    one = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - both
    return pairs.join(one, "a").join(two, "b").where(den * both >= num * union).select("a", "b")


def _fits(one: str, two: str, num: int, den: int):
    """Sizes that allow a link, if this shingle is the first in common: then at most ``rest`` of ``n``, from it on, are."""
    return (num + den) * F.least(f"{one}.rest", f"{two}.rest") >= num * (F.col(f"{one}.n") + F.col(f"{two}.n"))


def _merged(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the components that ``links`` join made one; only these are worked on. The table given is freed if another is made."""
    if links.isEmpty():
        return members
    own = members.select("sid", "comp")
    ends = links.join(own.select(F.col("sid").alias("a"), F.col("comp").alias("c")), "a").join(own.select(F.col("sid").alias("b"), F.col("comp").alias("d")), "b")
    found = connected_components(ends.where("c <> d").select("c", "d").distinct(), "c", "d", few=FEW_LINKS).select(F.col("vertex").alias("comp"), "component")
    out = members.join(found, "comp", "left").select("sid", "n", "m", "gid", F.coalesce("component", "comp").alias("comp"))
    out = materialize(out, "members")
    discard(members)
    return out


def _linked_components(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``(sid, comp)`` of the distinct sets."""
    gids = sets.groupBy("name").agg(F.min("sid").alias("gid"))
    members = materialize(sets.select("sid", "n", "m", "name").join(gids, "name").drop("name").withColumn("comp", F.col("sid")), "members")
    lists = sets.select("sid", "prefix").join(members.where("sid = gid").select("sid", "gid", "n", "m"), "sid").select(F.posexplode("prefix").alias("at", "key"), "gid", "n", "m").select("key", "gid", "n", (F.col("m") - F.col("at")).alias("rest"))
    shared = lists.groupBy("key").agg(F.count("*").alias("groups")).where("groups > 1").select("key")
    lists = materialize(lists.join(shared, "key"), "lists")

    inside = members.where("sid <> gid").select(F.col("gid").alias("a"), F.col("sid").alias("b"))
    links = materialize(_verified(inside, sets, num, den), "links")
    members = _merged(members, links)
    discard(links)
    for turn in range(LEADER_ROUNDS):
        faces = members.groupBy("gid", "comp").agg(F.min("sid").alias("sid"))
        seen = lists.join(faces, "gid")
        # written, so that the join with the lists is of two shuffles and a long list is split among tasks
        order = F.struct(F.col("n") - F.col("rest"), F.xxhash64("sid", F.lit(turn)))
        leaders = seen.groupBy("key").agg(F.min_by(F.struct("sid", "comp", "n", "rest"), order).alias("lead"), F.min("comp").alias("p"), F.max("comp").alias("q"))
        leaders = materialize(leaders.where("p <> q").select("key", "lead"), "leaders")
        # a list whose groups are in one component stays so: only the open ones go on
        still = materialize(lists.join(leaders.select("key"), "key", "left_semi"), "lists")
        discard(lists)
        lists = still
        pairs = lists.join(faces, "gid").alias("s").join(leaders, "key").where((F.col("comp") != F.col("lead.comp")) & _fits("s", "lead", num, den))
        pairs = pairs.select(F.least("s.sid", "lead.sid").alias("a"), F.greatest("s.sid", "lead.sid").alias("b")).distinct()
        links = materialize(_verified(pairs, sets, num, den), "links")
        discard(leaders)
        done = links.isEmpty()
        members = _merged(members, links)
        discard(links)
        if done:
            break

    wide = members.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    apart = (F.col("l.low") != F.col("r.high")) | (F.col("l.high") != F.col("r.low"))
    seen = lists.join(wide, "gid")
    open_keys = materialize(seen.groupBy("key").agg(F.min("low").alias("p"), F.max("high").alias("q")).where("p <> q").select("key"), "open")
    seen = seen.join(open_keys, "key")
    pairs = seen.alias("l").join(seen.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.gid") < F.col("r.gid")) & apart & _fits("l", "r", num, den))
    pairs = pairs.select(F.col("l.gid").alias("g"), F.col("r.gid").alias("h")).distinct()
    pairs = pairs.unionByName(wide.where(F.col("low") != F.col("high")).select(F.col("gid").alias("g"), F.col("gid").alias("h")))
    left = members.select(F.col("gid").alias("g"), F.col("sid").alias("s"), F.col("comp").alias("c"))
    right = members.select(F.col("gid").alias("h"), F.col("sid").alias("t"), F.col("comp").alias("d"))
    rest = pairs.join(left, "g").join(right, "h").where("c <> d and (g <> h or s < t)")
    rest = rest.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()
    links = materialize(_verified(rest, sets, num, den), "links")
    discard(lists), discard(open_keys)
    members = _merged(members, links)
    discard(links)
    return members


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Documents link when ``den * |A & B| >= num * |A | B|`` for their sets of five-word shingles (with fewer words, the whole
    sequence as one). A document without words, or null, has no shingle and is alone. A null id counts as no id: its row keeps
    it, and its component is the smallest id of those it links with, or null. Repeated rows are documents of their own. Texts are
    read whole, however long; an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark: SparkSession = docs.sparkSession
    rows = shingle_prefixes(docs, id_col, text_col, num, den)
    release_shuffles(spark)
    slim = materialize(rows.select("rid", "doc_id", "n", "sig"), "rows")
    possible = rows.where("sig is not null")
    sets = possible.groupBy("sig").agg(F.min("rid").alias("sid"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("name").alias("name"), F.first("prefix").alias("prefix"), F.first("shingles").alias("shingles"))
    sets = materialize(sets, "sets")
    discard(rows)
    members = _linked_components(sets.drop("sig"), num, den)
    told = materialize(sets.select("sig", "sid").join(members.select("sid", "comp"), "sid").select("sig", "comp"), "told")
    discard(sets), discard(members)
    named = slim.where("sig is not null").select("rid", "doc_id", "sig").join(told, "sig")
    # written, so that a component with many of the rows is split among the tasks of the join
    least = materialize(named.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    out = named.select("rid", "comp").join(least, "comp").select("rid", "component_id")
    out = slim.select("rid", "doc_id", F.col("n").alias("n_shingles")).join(out, "rid", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: For op1: sets as lists, candidates by equal shingle, exact counts, then closure over links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(x, y) AS (SELECT x, x FROM (SELECT DISTINCT x FROM l) UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.y, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.doc_id = c.x
"""
