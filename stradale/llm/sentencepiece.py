"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The best segmentation of a text is the sequence of pieces with the largest sum of scores. A character that no piece begins with
alone may be spelled in byte pieces, at a penalty. Spaces are the marker U+2581, one of which stands before the text. No piece
goes on over a space that follows something else, so runs of spaces with the word after them are segmented apart from the rest,
and each worker keeps the ids of those it has seen. New ones are segmented together, vectorized in numpy.
"""

from __future__ import annotations

import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stradale.llm.subwords import slices
from stradale.llm.words import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Added to the lowest score for a character spelled in bytes; segments kept; segments worked on together; longest of them.
PENALTY, MAX_KNOWN, TOGETHER, LONGEST = -10.0, 120_000, 2048, 64
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)


def _fields(data: bytes):
    """``(number, value)`` of a protocol buffer message: bytes, integers or raw floats."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


class Trie:
    """Double array: the child of node ``s`` for code ``c`` is ``base[s] + c`` if ``check`` there is ``s``."""

    def __init__(self, keys: list[tuple[int, ...]]):
        top = max((max(k) for k in keys), default=0) + 1
        size = 4 * sum(map(len, keys)) + 8 * top + (1 << 14)
        base, check, value = (np.full(size, fill, np.int64) for fill in (0, -1, -1))
        check[0] = 0
        taken = np.zeros(size, bool)
        taken[0] = True
        free = hint = 1  # nodes with one child fill gaps; others look on from where the last search was long
        order = sorted(range(len(keys)), key=keys.__getitem__)
        todo = [(0, 0, len(order), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if len(keys[order[lo]]) == depth:
                value[node] = order[lo]
                lo += 1
            groups: list[list[int]] = []
            for k in range(lo, hi):
                c = keys[order[k]][depth]
                if groups and groups[-1][0] == c:
                    groups[-1][2] = k + 1
                else:
                    groups.append([c, k, k + 1])
            if not groups:
                continue
            codes = np.array([c for c, _, _ in groups])
            while taken[free]:
                free += 1
            at = begin = max(1, (free if len(groups) == 1 else hint) - int(codes[0]))
            step = 256
            while True:
                bad = np.zeros(step, bool)
                for c in codes.tolist():
                    bad |= taken[at + c : at + c + step]
                if not bad.all():
                    at += int(bad.argmin())
                    break
                at += step
            if at - begin > 256 and len(groups) > 1:
                hint = at + int(codes[0]) - 128
            base[node] = at
            check[at + codes] = node
            taken[at + codes] = True
            todo += [(at + c, p, q, depth + 1) for c, p, q in groups]
        end = int(np.flatnonzero(taken)[-1]) + top + 1
        self.base, self.check, self.value = base[:end].copy(), check[:end].copy(), value[:end].copy()

    def step(self, node: int, code: int) -> int:
        """The child, or -1."""
        to = int(self.base[node]) + code
        return to if code > 0 and to < len(self.check) and self.check[to] == node and to > 0 else -1


class Model:
    """Pieces of a model file. Only what the file holds is kept, so its size bounds what is broadcast."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        self.dummy = True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, _NORMAL))
            elif number == 3:
                self.dummy = bool(dict(_fields(value)).get(3, 1))
        self.scores = np.array(scores, np.float64)
        self.unknown = kinds.index(_UNKNOWN)
        self.bytes = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(self.pieces, kinds)) if kind == _BYTE}
        usable = [k for k, kind in enumerate(kinds) if kind in (_NORMAL, _USER) and self.pieces[k]]
        self.low = float(min(self.scores[usable])) + PENALTY
        often = Counter(c for k in usable for c in self.pieces[k])
        chars = sorted(often, key=lambda c: (-often[c], c))
        self.codes = {c: k + 1 for k, c in enumerate(chars)}
        self.plane = np.zeros(0x110000, np.int32)
        for c, k in self.codes.items():
            self.plane[ord(c)] = k
        self.plane[32], self.plane[ord(MARK)] = self.codes.get(MARK, 0), 0  # a marker in a text is spelled in bytes
        self.trie = Trie([tuple(self.codes[c] for c in self.pieces[k]) for k in usable])
        self.of_key = np.array(usable, np.int64)
        self.longest = max(len(self.pieces[k]) for k in usable)
        if any(re.search(f"[^{MARK}]{MARK}", self.pieces[k]) for k in usable):
            raise ValueError("pieces go on over spaces; texts cannot be segmented in parts")
        alone = "" if "\n" in self.codes else "\n"
        self.parts = re.compile(f"{alone or '(?!)'}| *[^ {alone}]+| +")
        self.spelled = [(bytes([int(p[3:5], 16)]) if kind == _BYTE else b"" if kind in (_UNKNOWN, _CONTROL) else p.replace(MARK, " ").encode()) for p, kind in zip(self.pieces, kinds)]

    def fallback(self, char: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in char.encode()]

    def viterbi(self, text: str) -> list[int]:
        """Ids of one string, a character at a time. Of equal sums, that with the longer last piece is taken."""
        n = len(text)
        codes = self.plane[np.fromiter(map(ord, text), np.int64, n)].tolist() if n else []
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        for i in range(n):
            node, single = 0, False
            for j in range(i, min(n, i + self.longest)):
                node = self.trie.step(node, codes[j])
                if node < 0:
                    break
                key = int(self.trie.value[node])
                if key >= 0:
                    piece = int(self.of_key[key])
                    single |= j == i
                    if best[i] + self.scores[piece] > best[j + 1]:
                        best[j + 1], back[j + 1] = best[i] + self.scores[piece], (i, piece)
            if not single and best[i] + self.low > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + self.low, (i, -1)
        out, at = [], n
        while at:
            i, piece = back[at]
            out.append([piece] if piece >= 0 else self.fallback(text[i]))
            at = i
        return [k for part in reversed(out) for k in part]

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of many strings as little-endian 32-bit integers: :meth:`viterbi` for all of them at once."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        short = [k for k in order if len(words[k]) <= LONGEST]
        for k in order[len(short) :]:
            out[k] = np.array(self.viterbi(words[k]), "<i4").tobytes()
        for a in range(0, len(short), TOGETHER):
            part = short[a : a + TOGETHER]
            for k, ids in zip(part, self._together([words[k] for k in part])):
                out[k] = ids
        return out

    def _together(self, words: list[str]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        n, most = len(words), int(sizes.max(initial=0))
        if not most:
            return [b""] * n
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        inside = np.arange(most) < sizes[:, None]
        codes = np.zeros((n, most), np.int64)
        codes[inside] = self.plane[flat]
        deep = min(self.longest, most)
        score = np.full((deep + 1, n, most), -np.inf)
        piece = np.full((deep + 1, n, most), -1, np.int32)
        w, i = np.nonzero(inside)
        node = np.zeros(len(w), np.int64)
        for d in range(1, deep + 1):
            fits = i + d <= sizes[w]
            w, i, node = w[fits], i[fits], node[fits]
            code = codes[w, i + d - 1]
            to = self.trie.base[node] + code
            ok = (code > 0) & (self.trie.check[np.minimum(to, len(self.trie.check) - 1)] == node) & (to < len(self.trie.check))
            w, i, node = w[ok], i[ok], to[ok]
            if not len(w):
                break
            key = self.trie.value[node]
            hit = key >= 0
            ids = self.of_key[key[hit]]
            score[d, w[hit], i[hit]], piece[d, w[hit], i[hit]] = self.scores[ids], ids
        lone = inside & (piece[1] < 0)
        score[1][lone] = self.low
        best, back = np.full((most + 1, n), -np.inf), np.zeros((most + 1, n), np.int64)
        best[0] = 0
        for j in range(1, most + 1):
            for d in range(min(j, deep), 0, -1):
                now = best[j - d] + score[d, :, j - d]
                more = now > best[j]
                best[j][more], back[j][more] = now[more], d
        found, at, who = np.full((n, most), -2, np.int64), sizes.copy(), np.arange(n)
        for k in range(most - 1, -1, -1):
            on = at[who] > 0
            who = who[on]
            if not len(who):
                break
            d = back[at[who], who]
            at[who] -= d
            found[who, k] = piece[d, who, at[who]]
        if not lone.any():
            keep = found >= 0
            data, cuts = found[keep].astype("<i4").tobytes(), np.cumsum(keep.sum(axis=1)) * 4
            return [data[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
        out = []
        for word, row in zip(words, found.tolist()):
            ids, p = [], 0
            for k in row:
                if k >= 0:
                    ids.append(k)
                    p += len(self.pieces[k])
                elif k == -1:
                    ids += self.fallback(word[p])
                    p += 1
            out.append(np.array(ids, "<i4").tobytes())
        return out

    def encode(self, text: str, known: dict[str, bytes]) -> bytes:
        """Ids of a text as little-endian 32-bit integers. ``known`` has to hold its parts: see :meth:`learn`."""
        return b"".join(map(known.__getitem__, self._split(text)))

    def _split(self, text: str) -> list[str]:
        return self.parts.findall(" " * self.dummy + text) if text else []

    def learn(self, texts: list[str], known: dict[str, bytes]) -> list[list[str]]:
        if len(known) > MAX_KNOWN:
            known.clear()
        parts = [self._split(t) for t in texts]
        new = list({p for x in parts for p in x if p not in known})
        known.update(zip(new, self.segment(new)))
        return parts

    def decode(self, ids: list[int]) -> str:
        """The text of ids: markers become spaces, byte pieces bytes; the space before the text goes."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def load(path: str = MODEL) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, ``token_ids`` and ``exact``: whether decoding the ids gives the text back. A row per row; null has no ids and is exact.

    Empty texts have no ids; repeated rows are encoded alike; texts are encoded whole, however long. Of segmentations with equal
    scores that with the longer last piece is taken. Columns of ``keep`` named ``token_ids`` or ``exact`` give way. No shuffle.
    """
    keep = [c for c in keep if c not in ("token_ids", "exact")]
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [to_arrow_type(docs.schema[c].dataType) for c in keep]

    def run(batches):
        known: dict[str, bytes] = {}
        for batch in batches:
            for small in slices(batch):
                texts = [t or "" for t in small.column(0).to_pylist()]
                parts = sent.value.learn(texts, known)
                rows = [np.frombuffer(b"".join(map(known.__getitem__, x)), "<i4") for x in parts]
                exact = [sent.value.decode(r.tolist()) == t for r, t in zip(rows, texts)]
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(small.column(k + 1).cast(kind) for k, kind in enumerate(kinds)), ids, pa.array(exact, pa.bool_())], [*(f"k{k}" for k in range(len(keep))), "token_ids", "exact"])

    schema = ", ".join([*(f"k{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)), "token_ids array<int>, exact boolean"])
    rows = docs.select(F.col(text_col).alias("t"), *(F.col(c).alias(f"k{k}") for k, c in enumerate(keep))).mapInArrow(run, schema)
    return rows.select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)), "token_ids", "exact")


def decode(rows: DataFrame, model: Model, keep: list[str], ids_col: str = "token_ids") -> DataFrame:
    """``keep`` and ``text``, the text of each list of ids; null lists give null. A column of ``keep`` named ``text`` gives way."""
    keep = [c for c in keep if c != "text"]
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kinds = [to_arrow_type(rows.schema[c].dataType) for c in keep]

    def run(batches):
        for batch in batches:
            texts = [None if x is None else sent.value.decode(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).cast(kind) for k, kind in enumerate(kinds)), pa.array(texts, pa.string())], [*(f"k{k}" for k in range(len(keep))), "text"])

    schema = ", ".join([*(f"k{k} {rows.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)), "text string"])
    out = rows.select(F.col(ids_col).alias("t"), *(F.col(c).alias(f"k{k}") for k, c in enumerate(keep))).mapInArrow(run, schema)
    return out.select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)), "text")


def op5(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    """Ids of every document and their number, and whether they decode to the text exactly."""
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), load(path), ["doc_id"])
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.xxhash64("token_ids").alias("ids_digest"), "exact")
