"""WARC archives with a two-level capture index (operator 6).

Writing: payloads are hashed in the JVM, the smallest page of each digest is found by partial aggregates, and each
task writes its records, one gzip member each, to a file of its own in the shared folder. File names carry the
task attempt; what a lost attempt has left is in no index.

Index: captures are dealt by ranges of (reversed-host URL key, page), sorted, and packed into compressed blocks
of BLOCK lines; a sparse directory holds each block's first and last key and its byte range. The directory is
itself packed into compressed blocks of ENTRIES, and only the range of each of these, one row for a million
captures, is sent to tasks. A look-up halves its way through that list, reads the directory's blocks by range,
halves its way through them, reads the index blocks by range, then the records by range.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh_path, written

BLOCK = 2000
#: Payloads below this are always written in full.
LEAST = 100
#: Directory entries in a block of the directory.
ENTRIES = 512
#: Directory blocks and index blocks held by a task.
HELD = 8
#: Bytes read at once.
READ = 8_000_000
#: Bytes of compressed records read by one task, about.
TASK_BYTES = 8_000_000

_CAPTURE = "key string, page_id long, url string, file string, at long, size long"
_BLOCKS = "first string, last string, file string, at long, size long, lines int"
_PLACES = "query string, key string, file string, at long, size long"


def url_key(url: str | None) -> str:
    """The URL with its host reversed, e.g. ``com,example)/a?b``: lower case, without scheme, user, a leading
    www, a default port and the fragment. Null and what has no host become the text itself after ``)``."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")" + (url or "").strip()
    if not host:
        return ")" + (url or "").strip()
    host = re.sub(r"^www\d*\.(?=.+\.)", "", host)
    default = {"http": 80, "https": 443}.get(parts.scheme.lower())
    tail = f":{port}" if port and port != default else ""
    return ",".join(reversed(host.split("."))) + tail + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One WARC record as a gzip member: a response with its payload, or a revisit without."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is None:
        block += payload or b""
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def parse(raw: bytes) -> dict:
    """Fields of a record: type, page_id, url, digest, size, refers_to, payload (None in a revisit). Raises if a
    response's payload isn't what its digest and length say."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = lambda name: (lambda m: int(m[1]) if m else None)(re.search(r":page:(-?\d+)>", fields.get(name, "")))
    out = {"type": fields["WARC-Type"], "page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "size": size, "refers_to": page("WARC-Refers-To"), "payload": None}
    if out["type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != out["digest"]:
            raise ValueError(f"record of page {out['page_id']} is damaged")
        out["payload"] = payload
    return out


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        task = TaskContext.get()
        name, at, out = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0, None
        for batch in batches:
            rows = []
            for page, url, payload, digest, size, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                raw = record(page, url, payload, digest, size, refers, date)
                out.write(raw)
                rows.append((url_key(url), page, url, name, at, len(raw)))
                at += len(raw)
            yield _batch(rows, _CAPTURE)
        if out is not None:
            out.close()

    return run


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _pack(folder: str, prefix: str, lines: int):
    """Sorted rows (first key, last key or page, ...) into compressed blocks of so many lines, one file a task; gives
    the blocks. A row's first and last key are its columns 0 and 0 in an index, 0 and 1 in a directory."""
    last = 1 if prefix == "directory" else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        task = TaskContext.get()
        name, at, out, waiting, made = f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId()}.gz", 0, None, [], []

        def flush() -> None:
            nonlocal at, out, waiting
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}", compression=None)
            raw = gzip.compress("\n".join(json.dumps(r) for r in waiting).encode(), 6, mtime=0)
            out.write(raw)
            made.append((waiting[0][0], max(r[last] for r in waiting), name, at, len(raw), len(waiting)))
            at += len(raw)
            waiting = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(row)
                if len(waiting) == lines:
                    flush()
        if waiting:
            flush()
        if out is not None:
            out.close()
        yield _batch(made, _BLOCKS)

    return run


def _lines(folder: str, blocks: Iterator[tuple[str, int, int]] | list[tuple[str, int, int]]) -> Iterator[list]:
    """The lines of blocks (file, first byte, bytes), by range reads."""
    store, top = _open(folder)
    for name, at, size in blocks:
        with store.open_input_file(f"{top}/{name}") as f:
            for line in gzip.decompress(f.read_at(size, at)).split(b"\n"):
                yield json.loads(line)


class _Within:
    """The entries (first, last, ...), sorted by both, whose ranges hold a key."""

    def __init__(self, entries: list) -> None:
        self.entries, self.firsts, self.lasts = entries, [e[0] for e in entries], [e[1] for e in entries]

    def find(self, key: str) -> list:
        return self.entries[bisect_left(self.lasts, key) : bisect_right(self.firsts, key)]


def _locate(folder: str, root: list):
    """Queries (query, key), sorted by key, to (query, key, index block), by halving in root and in directory blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, held = _Within(root), {}
        for batch in batches:
            rows = []
            for query, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for entry in top.find(key):
                    place = tuple(entry[2:5])
                    if place not in held:
                        while len(held) >= HELD:
                            held.pop(next(iter(held)))
                        held[place] = _Within(list(_lines(folder, [place])))
                    rows += [(query, key, *e[2:5]) for e in held[place].find(key)]
                if len(rows) >= 10_000:
                    yield _batch(rows, _PLACES)
                    rows = []
            yield _batch(rows, _PLACES)

    return run


def _read_records(folder: str):
    """Captures (file, at, size) of batches, sorted by place, to fields of their records; neighbours are read at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        handle, name, buffer, base = None, None, b"", 0
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            rows, held = [], 0
            for k, (file, at, size) in enumerate(places):
                if file != name:
                    if handle is not None:
                        handle.close()
                    handle, name, buffer, base = store.open_input_file(f"{top}/{file}"), file, b"", 0
                if not base <= at <= at + size <= base + len(buffer):
                    stop, j = at + size, k + 1
                    while j < len(places) and places[j][0] == file and places[j][1] <= stop + 4096 and places[j][1] + places[j][2] - at <= READ:
                        stop, j = max(stop, places[j][1] + places[j][2]), j + 1
                    buffer, base = handle.read_at(stop - at, at), at
                r = parse(buffer[at - base : at - base + size])
                rows.append((r["page_id"], r["url"], r["type"], r["digest"], r["size"], r["refers_to"], r["payload"]))
                held += len(r["payload"] or b"")
                if held >= READ:
                    yield _batch(rows, _RECORD)
                    rows, held = [], 0
            yield _batch(rows, _RECORD)
        if handle is not None:
            handle.close()

    return run


_RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


@dataclass
class Archive:
    """A written archive: the folder of its files, the block directory as a table, and the ranges of the directory's
    own blocks, sorted (one for BLOCK * ENTRIES captures, so a short list); captures and bytes of records."""

    spark: SparkSession
    folder: str
    directory: DataFrame
    root: list
    n_captures: int
    bytes: int

    def _tasks(self) -> int:
        return max(self.spark.sparkContext.defaultParallelism, -(-self.bytes // TASK_BYTES))

    def captures(self) -> DataFrame:
        """All captures of the index (key, page_id, url, file, at, size)."""

        def run(batches: Iterator[pa.RecordBatch], folder=self.folder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    yield _batch([tuple(x) for x in _lines(folder, [row])], _CAPTURE)

        return self.directory.select("file", "at", "size").repartition(self._tasks()).mapInArrow(run, _CAPTURE)

    def records(self, captures: DataFrame | None = None) -> DataFrame:
        """The records of captures (all by default), read by range in the order they are stored. Tasks are as many
        as the bytes of the archive ask for, not the few bytes of their places."""
        places = (self.captures() if captures is None else captures).select("file", "at", "size")
        return places.repartitionByRange(self._tasks(), "file", "at").sortWithinPartitions("file", "at").mapInArrow(_read_records(self.folder), _RECORD)

    def lookup(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """(query, key, page_id, url, file, at, size) of each capture with the key of each URL, for each row of urls.

        URLs that differ only in what a key leaves out (scheme, case, a leading www) find each other's captures."""

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _batch([(u, url_key(u)) for u in batch.column(0).to_pylist()], "query string, key string")

        asked = urls.select(F.col(url_col).cast("string")).mapInArrow(keyed, "query string, key string")
        places = asked.repartitionByRange("key", "query").sortWithinPartitions("key").mapInArrow(_locate(self.folder, self.root), _PLACES)

        def read(batches: Iterator[pa.RecordBatch], folder=self.folder) -> Iterator[pa.RecordBatch]:
            held, lines = None, {}
            for batch in batches:
                rows = []
                for query, key, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if block != held:
                        held, lines = block, {}
                        for x in _lines(folder, [tuple(block)]):
                            lines.setdefault(x[0], []).append(x)
                    for x in lines.get(key, ()):
                        rows.append((query, *x))
                        if len(rows) >= 10_000:
                            yield _batch(rows, "query string, " + _CAPTURE)
                            rows = []
                yield _batch(rows, "query string, " + _CAPTURE)

        # By block, so that it is read once; where very many queries need one, Spark splits them.
        return places.hint("rebalance", "file", "at").sortWithinPartitions("file", "at").mapInArrow(read, "query string, " + _CAPTURE)


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write each row of pages as a WARC record into the shared folder and index the captures.

    Of the rows with one payload of at least least bytes, that with the smallest id is a response and the others
    are revisits of it.

    * A null html is an empty payload, a null URL an empty target; both are written and indexed.
    * Repeated rows with the smallest id are all responses. Rows with a null id are revisits of the smallest id
      with the payload, if there is one.
    * An empty table gives an archive without files. Other columns of pages are not written.
    * A very long html is one record, which is written, and read again, in one piece.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "archive")
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("size"))
    firsts = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("lo"), F.count("*").alias("n")).where("n > 1")
    again = written(firsts.select("digest", "lo"), "repeated-payloads")
    refers = F.when(~F.col("lo").eqNullSafe(F.col("page_id")), F.col("lo"))
    rows = rows.join(again, "digest", "left").select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to"))
    captures = written(rows.mapInArrow(_write(folder, date), _CAPTURE), "captures")
    total = captures.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    directory = written(captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(_pack(folder, "index", BLOCK), _BLOCKS), "directory")
    tops = directory.repartitionByRange("first", "last", "file", "at").sortWithinPartitions("first", "last", "file", "at").mapInArrow(_pack(folder, "directory", ENTRIES), _BLOCKS)
    root = sorted(tuple(r)[:5] for r in written(tops, "root").collect())  # a row for BLOCK * ENTRIES captures and each task
    return Archive(spark, folder, directory, root, total["n"], total["bytes"])
