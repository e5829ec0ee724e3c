"""WARC archives with a two-level capture index.

Pages become gzip members of archive files in the shared folder. The capture
index is sorted by reversed-host URL key; its lines lie in compressed blocks,
each index file ends with a sparse directory of its blocks, and the first key of
every index file (one row per partition) is the directory above. A lookup
searches first keys, directory and block by halves and reads only byte ranges.

A task writes files named after its attempt, and only the files of attempts
that Spark committed are listed in the captures, so a lost executor leaves at
most files that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_right
from collections import OrderedDict
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder, stored
from . import textscan as ts

#: Payloads of fewer bytes are never stored as revisits.
REVISIT_BYTES = 1000
LINES = 1024
FILE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(uri: str):
    scheme, sep, rest = uri.partition(":")
    if sep and scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if sep and "/" not in scheme:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def url_key(url: str | None) -> str:
    """Host labels last to first, then port, path and query: com,example,www)/a?b=1."""
    url = (url or "").strip()
    try:
        at = urlsplit(url if "://" in url else "//" + url)
        host, port = (at.hostname or "").rstrip("."), at.port
    except ValueError:
        return quote(url, safe="/:?=&%,;@+~!$'()*-._")
    path = quote(at.path or "/", safe="/:=&%,;@+~!$'()*-._") + ("?" + quote(at.query, safe="/:?=&%,;@+~!$'()*-._") if at.query else "")
    return ",".join(reversed(quote(host, safe="-._").split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + path


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which leaves the payload out."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {quote(url or '', safe=chr(33) + '#$%&()*+,/:;=?@[]~-._' + chr(39))}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def gzip_member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


CAPTURE = "page_id long, url_key string, capture long, file string, at long, size long"
CAPTURE_NAMES = ["page_id", "url_key", "capture", "file", "at", "size"]


def _write(folder: str, date: str):
    def run(batches):
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        made, number, out, at, name = task.partitionId() << 33, 0, None, 0, ""
        for whole in batches:
            for b in ts.slices(whole, "html"):
                rows = []
                for page, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:03d}.warc.gz"
                        out, at, number = fs.open_output_stream(f"{root}/{name}", compression=None), 0, number + 1
                    member = gzip_member(record(page, url, (html or "").encode(), refers, date))
                    out.write(member)
                    rows.append((page, url_key(url), made, name, at, len(member)))
                    at, made = at + len(member), made + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], CAPTURE_NAMES)
        if out is not None:
            out.close()
    return run


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every page below ``folder``; returns where each is (page_id, url_key, capture, file, at, size).

    Of pages with equal payloads of at least REVISIT_BYTES bytes those with the
    largest page_id are responses and the others revisits of it. A null html is
    an empty payload, a null url an empty one; a null page_id is never the
    largest. Rows with equal page_id are written each.
    """
    ts.small_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha1(F.col("html").cast("binary"))))
    # digests that occur once need no revisit; written, so that the join below knows how few are left
    equal = stored(
        rows.filter("digest is not null").groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", "largest"), "equal-payloads")
    rows = rows.join(equal, "digest", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("largest")), None).otherwise(F.col("largest")).alias("refers_to"))
    return stored(rows.mapInArrow(_write(folder, date), CAPTURE), "captures")


def index_key(captures: DataFrame) -> DataFrame:
    """The line's key: URL key and capture number, unique even where a URL was captured often."""
    return captures.withColumn("key", F.concat("url_key", F.lit(" "), F.lpad(F.col("capture").cast("string"), 20, "0")))


def _index(folder: str):
    def run(batches):
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, out, at, directory, lines, first, last, total = f"index-{task.partitionId():06d}-{task.taskAttemptId()}", None, 0, [], [], None, None, 0

        def flush():
            nonlocal at, lines
            if lines:
                raw = zlib.compress("\n".join(lines).encode(), 6)
                out.write(raw)
                directory.append([lines[0].split("\t", 1)[0], at, len(raw)])
                at, lines = at + len(raw), []

        for b in batches:
            for key, page, file, offset, size in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "file", "at", "size"))):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                first, last, total = first or key, key, total + 1
                lines.append(f"{key}\t{'' if page is None else page}\t{file}\t{offset}\t{size}")
                if len(lines) == LINES:
                    flush()
        if out is not None:
            flush()
            raw = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(raw)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([last]), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([total], pa.int64())],
                                             ["first_key", "last_key", "file", "at", "size", "lines"])
    return run


def build_index(captures: DataFrame, folder: str) -> list[tuple[str, str, int, int]]:
    """Write the sorted index; returns (first key, file, directory offset, directory size) per index file, one per partition."""
    spark = captures.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = index_key(captures).select("key", "page_id", "file", "at", "size").repartitionByRange(n, "key").sortWithinPartitions("key")
    files = stored(rows.mapInArrow(_index(folder), "first_key string, last_key string, file string, at long, size long, lines long"), "index-files")
    return [tuple(r) for r in files.select("first_key", "file", "at", "size").orderBy("first_key").collect()]


class Index:
    """Finds captures; keeps the last directory, the last block and a few open files."""

    def __init__(self, folder: str, files: list[tuple[str, str, int, int]]):
        self.fs, self.root = open_folder(folder)
        self.files, self.firsts = files, [f[0] for f in files]
        self.open: OrderedDict = OrderedDict()
        self.directory = self.block = (None, None)

    def range(self, file: str, at: int, size: int) -> bytes:
        if file not in self.open:
            if len(self.open) >= 32:
                self.open.popitem(last=False)[1].close()
            self.open[file] = self.fs.open_input_file(f"{self.root}/{file}")
        self.open.move_to_end(file)
        return self.open[file].read_at(size, at)

    def find(self, key: str) -> tuple[str, str, int, int] | None:
        """(page_id or '', file, offset, size) of the capture with exactly this key."""
        i = bisect_right(self.firsts, key) - 1
        if i < 0:
            return None
        _, name, at, size = self.files[i]
        if self.directory[0] != name:
            self.directory = name, json.loads(zlib.decompress(self.range(name, at, size)))
        blocks = self.directory[1]
        j = bisect_right(blocks, key, key=lambda x: x[0]) - 1
        if self.block[0] != (name, j):
            lines = [x.split("\t") for x in zlib.decompress(self.range(name, blocks[j][1], blocks[j][2])).decode().split("\n")]
            self.block = (name, j), lines
        lines = self.block[1]
        k = bisect_right(lines, key, key=lambda x: x[0]) - 1
        if k < 0 or lines[k][0] != key:
            return None
        return lines[k][1], lines[k][2], int(lines[k][3]), int(lines[k][4])

    def read(self, key: str) -> tuple[dict[str, str], bytes] | None:
        found = self.find(key)
        return found and parse(zlib.decompress(self.range(*found[1:]), 31))


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _read(folder: str, files):
    def run(batches):
        index = Index(folder, files)
        for b in batches:
            rows = []
            for key in b.column("key").to_pylist():
                got = index.read(key)
                if got is None:
                    continue
                head, payload = got
                revisit = head["WARC-Type"] == "revisit"
                stated = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                digest = stated if revisit else hashlib.sha1(payload).hexdigest()
                if digest != stated:
                    raise ValueError(f"payload of {key} does not match its digest")
                rows.append((key, _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], None if revisit else len(payload), digest, head["WARC-Type"], _page(head["WARC-Refers-To"]) if revisit else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 7, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                ["key", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return run


def lookup(keys: DataFrame, folder: str, files: list[tuple[str, str, int, int]]) -> DataFrame:
    """The records of the keys in column ``key``: page_id, url, payload_bytes (null for revisits), payload_digest, record_type, refers_to."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = keys.select("key").repartitionByRange(n, "key").sortWithinPartitions("key")
    return near.mapInArrow(_read(folder, files), "key string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives with an index, find every capture again and describe what was read.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to,
    one row per input row; a revisit takes its size from the response it names.
    """
    folder = new_folder(pages.sparkSession, "warc")
    captures = write_archives(pages, folder)
    files = build_index(captures, folder)
    found = stored(lookup(index_key(captures), folder, files), "records")
    named = found.filter("record_type = 'revisit'").select(F.col("refers_to").alias("of"), F.col("payload_digest").alias("same")).distinct()
    sizes = found.filter("record_type = 'response'").join(named, (F.col("page_id") == F.col("of")) & (F.col("payload_digest") == F.col("same"))) \
        .groupBy("of", "same").agg(F.max("payload_bytes").alias("full"))
    return found.join(sizes, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("same")), "left").select(
        "page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
