"""WARC archives: written by tasks, read in splits, with records confirmed by a chain of boundaries.

A split cannot tell a record from the bytes of one inside a payload. So each split reports every place that looks like a record,
with where its successor starts, already followed to the first place beyond the split. Jumps over these pointers from the start
of each file, doubled every round, reach the true boundaries only. Each split then is read from its first true boundary, once and
in order. Records of other writers are read as well: any version, repeated and folded fields, types other than responses and
revisits, and records that state no digest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import math
import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stradale.llm.words import small_batches
from stradale.plans.staging import discard, materialize, new_path

MAGIC = b"WARC/1.1\r\n"
_MAGIC = re.compile(rb"WARC/\d\.\d+\r\n")
#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_REVISIT = 1000
#: An archive is closed when it exceeds this; splits of this many bytes are read as a unit; what is read of a header at first.
ARCHIVE_BYTES, SPLIT_BYTES, HEADER_BYTES = 512 << 20, 16 << 20, 1 << 12
#: Bytes that a reader fetches at a time, and that a magic has at most.
FETCH_BYTES, LONGEST_MAGIC = 1 << 20, 16
#: Revisits (two numbers and a digest each) that are broadcast at most; more of them are joined by a shuffle of the pages.
MAX_BROADCAST = 200_000
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
RECORDS = "path string, offset long, record_type string, record_id string, page_id long, url string, refers_to long, digest string, length long, payload binary"
_FIELDS = ("path", "offset", "record_type", "record_id", "page_id", "url", "refers_to", "digest", "length", "payload")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _named(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record: a response, or a revisit of the page ``refers_to``, which has the same payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_named(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    head += [f"WARC-Refers-To: {_named(refers_to)}", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + _END + block + _END


def parse(head: bytes) -> dict[str, str] | None:
    """Fields of a header, by name in lower case, the first of repeated ones; null if it is none. Folded lines go on the field before."""
    fields: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name is not None:
            fields[name] += " " + line.strip()
            continue
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            return None
        name = key.strip().lower()
        if name in fields:
            name = f"{name} again"  # what folds on goes there too
        fields[name] = value.strip()
    return fields if fields.get("content-length", "").isdecimal() and fields["content-length"].isascii() else None


def _page(name: str | None) -> int | None:
    """The page that a record id of :func:`record` names; ids of other writers name none."""
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", name or "")
    return int(found[1]) if found else None


def _digest(stated: str | None) -> str | None:
    """A stated SHA-1 in lower-case hex; null for other algorithms and what is none."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() == "sha1":
        if re.fullmatch("[A-Za-z2-7]{32}", value):
            return base64.b32decode(value.upper()).hex()
        if re.fullmatch("[0-9A-Fa-f]{40}", value):
            return value.lower()
    return None


def contents(fields: dict[str, str], block: bytes) -> tuple:
    """Of a record: ``record_type, record_id, page_id, url, refers_to, digest, length, payload``.

    The payload of an HTTP response is its body, of other records the whole block; a revisit has none, and of it digest and
    length are those that it states.
    """
    kind = fields.get("warc-type")
    http = fields.get("content-type", "").lower().startswith("application/http")
    head, blank, body = block.partition(_END) if http else (b"", b"", block)
    if not blank:
        head, body = (block, b"") if http and kind == "revisit" else (b"", block)
    digest, length = _digest(fields.get("warc-payload-digest")), len(body)
    if kind == "revisit":
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        length, body = int(stated[1]) if stated else None, None
    elif digest is None:
        digest = hashlib.sha1(body).hexdigest()
    return kind, fields.get("warc-record-id"), _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), _page(fields.get("warc-refers-to")), digest, length, body


def _writer(folder: str):
    def run(batches):
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        out = path = None
        size = n = 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{place}/{uuid.uuid4().hex}.warc"  # an attempt that fails leaves a file that no row names
                    out, size, n = system.open_output_stream(path), 0, 0
                size += out.write(data := record(page_id, url, payload or b"", refers_to)) or len(data)
                n += 1
                if size > ARCHIVE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row to archives in ``folder``; return ``path, bytes, records`` of each archive.

    Of rows with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest id is a response, the others are
    revisits. Null html is an empty payload; a row without id is always a response; rows that repeat an id are all written, and
    those of the largest id among equal payloads are all responses. Payloads are written whole, however long. Other columns are
    not read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    marks = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).where(f"n >= {LEAST_REVISIT}").drop("n")
    copies = marks.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("rows")).where("rows > 1")
    again = marks.join(copies, "digest").where("page_id <> keep").select("page_id", "digest", F.col("keep").alias("refers_to")).distinct()
    again = materialize(again, "revisits")
    few = F.broadcast(again) if again.count() <= MAX_BROADCAST else again
    told = rows.withColumn("digest", F.sha1("payload")).join(few, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")
    archives = materialize(told.mapInArrow(_writer(folder), "path string, bytes long, records long"), "archives")
    discard(again)
    return archives


def _open(folder: str, path: str):
    """The file behind a buffer, so that places that follow each other closely are fetched once."""
    return io.BufferedReader(fs.FileSystem.from_uri(folder)[0].open_input_file(path), FETCH_BYTES)


def _at(stream, offset: int, n: int) -> bytes:
    stream.seek(offset)
    return stream.read(n)


def _from(stream, offset: int) -> tuple[bytes, int]:
    """Bytes from ``offset`` on and where the header in them ends: twice as many until it does, -1 if the file ends first."""
    n = HEADER_BYTES
    while True:
        data = _at(stream, offset, n)
        stop = data.find(_END)
        if stop >= 0 or len(data) < n:
            return data, stop
        n *= 2


def _chains(folder: str):
    """Of each split: every candidate and the first place beyond the split that its chain leads to."""

    def run(batches):
        for batch in batches:
            for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(folder, path) as stream:
                    data = _at(stream, start, end - start + max(HEADER_BYTES, LONGEST_MAGIC))
                    places = [m.start() for m in _MAGIC.finditer(data, 0, end - start + LONGEST_MAGIC) if m.start() < end - start]
                    heads = {}
                    for at in places:
                        stop = data.find(_END, at)
                        if stop >= 0 or start + len(data) >= size:
                            heads[at] = stop, parse(data[at:stop]) if stop >= 0 else None
                        else:
                            far, stop = _from(stream, start + at)
                            heads[at] = at + stop, parse(far[:stop]) if stop >= 0 else None
                leads: dict[int, int] = {}
                for at in reversed(places):
                    stop, fields = heads[at]
                    if fields is None:
                        continue
                    after = start + stop + 4 + int(fields["content-length"]) + 4
                    if after > size or start + len(data) >= after and data[after - start - 4 : after - start] != _END:
                        continue
                    to = leads.get(after) if after < end else after
                    if to is not None:
                        leads[start + at] = to
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(leads), pa.string()), pa.array(list(leads), pa.int64()), pa.array(list(leads.values()), pa.int64())], ["path", "offset", "jump"])

    return run


def boundaries(splits: DataFrame, folder: str) -> DataFrame:
    """``path, offset``: the first true record at or beyond the start of each split that has one, and the end of each file."""
    jumps = materialize(splits.select("path", "bytes", "start", "end").mapInArrow(_chains(folder), "path string, offset long, jump long"), "jumps")
    most = splits.agg(F.max(F.ceil(F.col("bytes") / (F.col("end") - F.col("start"))))).first()[0] or 1
    reached = splits.where("start = 0").select("path", F.lit(0).cast("long").alias("offset"))
    for _ in range(math.ceil(math.log2(most + 1))):
        further = reached.join(jumps, ["path", "offset"]).select("path", F.col("jump").alias("offset"))
        before, reached = reached, materialize(reached.unionByName(further).distinct(), "reached")
        discard(before)
        step = jumps.select("path", F.col("offset").alias("jump"), F.col("jump").alias("to"))
        doubled = materialize(jumps.join(step, ["path", "jump"], "left").select("path", "offset", F.coalesce("to", "jump").alias("jump")), "jumps")
        discard(jumps)
        jumps = doubled
    discard(jumps)
    return reached


def _reader(folder: str):
    """Records from a true boundary to the end of its split."""

    def run(batches):
        for batch in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held, at = [], 0, begin
                with _open(folder, path) as stream:
                    while at < end:
                        data, stop = _from(stream, at)
                        fields = parse(data[:stop]) if stop >= 0 and _MAGIC.match(data) else None
                        if fields is None:
                            break
                        n = int(fields["content-length"])
                        block = data[stop + 4 : stop + 4 + n] if stop + 4 + n <= len(data) else _at(stream, at + stop + 4, n)
                        if len(block) < n:
                            break
                        rows.append((path, at, *contents(fields, block)))
                        held += n
                        at += stop + 4 + n + 4
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    return run


_KINDS = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], list(_FIELDS))


def read_warc(archives: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of ``archives`` (``path, bytes``), a row each: ``path, offset, record_type, record_id, page_id, url, refers_to,
    digest, length, payload``.

    ``digest`` is the SHA-1 that the record states of its payload, or where it states none that of the payload; ``length`` the
    bytes of the payload; a revisit has no payload itself, so both are what it states. ``page_id`` and ``refers_to`` are null in
    records of other writers. Repeated records are read each. A file that breaks off gives the records before the break; what
    does not begin with a record gives none. No archives give no rows.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = archives.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes")))
    tasks = min(20_000, splits.count() + 1)  # rows are few and their work is not: they are not coalesced by size
    splits = splits.repartition(tasks, "path", "start")
    own = F.col("offset") - F.col("offset") % F.lit(split_bytes)
    firsts = boundaries(splits, folder).groupBy("path", own.alias("start")).agg(F.min("offset").alias("offset"))
    todo = firsts.join(splits.select("path", "start", "end"), ["path", "start"]).where(F.col("offset") < F.col("end"))
    return todo.select("path", "offset", "end").repartition(tasks, "path", "offset").mapInArrow(_reader(folder), RECORDS)


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    folder = new_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder, split_bytes)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    whole = F.col("payload").isNotNull()
    return rows.select("page_id", F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("length")).alias("payload_bytes"), F.when(whole, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keep FROM p WHERE n >= {LEAST_REVISIT} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND n >= {LEAST_REVISIT}
"""
