"""WARC archives and a two-level capture index.

Writing: each task writes its pages as gzip-compressed records, one gzip member each, to files of its own.
Index: capture lines sorted by reversed-host key are compressed in blocks; a sparse directory has the first key,
offset and length of every block and stands at the end of its index file, and the files' first keys make a top
level of one row for each file.  Reading: a key's file is found by binary search in the top level, its block by
binary search in the file's directory, its line by binary search in the block, and the record by one range
read; wanted records of one archive are read in the order in which they stand there.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.llm.store import filesystem, fresh, settle

#: Payloads below this many bytes are never deduplicated.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TAIL = "<QQ"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)"
_REST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"


def url_key(url: Column) -> Column:
    """The reversed-host key: com,example,blog)/path?query in lower case, without scheme, user, www, port and fragment. A null URL has an empty key; other strings are their own."""
    lower = F.lower(F.coalesce(url, F.lit("")))
    host = F.array_join(F.reverse(F.split(F.regexp_extract(lower, _HOST, 1), r"\.")), ",")
    return F.when(lower.rlike(_HOST), F.concat(host, F.lit(")"), F.regexp_extract(lower, _REST, 1))).otherwise(lower)


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, html, key, payload_digest, payload_bytes, refers_to. A record that repeats a payload of at least 1000 bytes refers to the largest page_id with that payload."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    # sha2 decides which payloads are equal; sha1 is what archives carry
    rows = pages.select("page_id", "url", "html", url_key(F.col("url")).alias("key"), F.sha1(body).alias("payload_digest"), F.sha2(body, 256).alias("_same"), F.octet_length(body).cast("long").alias("payload_bytes"))
    long = F.col("payload_bytes") >= REVISIT_BYTES
    shared = pages.select("page_id", F.sha2(body, 256).alias("_same"), F.octet_length(body).alias("payload_bytes")).filter(long)
    shared = shared.groupBy("_same").agg(F.max("page_id").alias("_response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # settled, so that a small table of repeated payloads is sent to the pages and no html is shuffled for it
    both = rows.join(settle(shared, "repeated-payloads"), "_same", "left")
    return both.withColumn("refers_to", F.when(F.col("page_id") != F.col("_response"), F.col("_response"))).drop("_same", "_response")


def _record(row: dict, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    refers = row["refers_to"]
    url = re.sub(r"[\r\n]", " ", row["url"] or "")
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> dict:
    """One record of an archive: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for a revisit). The digest of a response is that of its payload."""
    data = zlib.decompress(raw, 31)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    named = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    digest = hashlib.sha1(payload).hexdigest() if kind == "response" else named
    if digest != named:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if kind == "response" and length != len(payload):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is cut short")
    number = re.compile(r"<urn:page:(-?\d+)>")
    refers, own = number.match(fields.get("WARC-Refers-To", "")), number.match(fields["WARC-Record-ID"])
    return {
        "page_id": int(own[1]) if own else None,
        "url": fields["WARC-Target-URI"],
        "record_type": kind,
        "refers_to": int(refers[1]) if refers else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def _archive(path: str, file_bytes: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        out, name, at = None, "", 0
        for part in parts:
            lines: dict[str, list] = {k: [] for k in ("key", "page_id", "record_type", "file", "offset", "length")}
            texts = part.column("html").cast(pa.binary())
            rest = part.drop_columns(["html"]).to_pylist()
            for row, text in zip(rest, texts, strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                raw = _record(row, text.as_py() or b"")
                out.write(raw)
                for k, v in (("key", row["key"]), ("page_id", row["page_id"]), ("record_type", "response" if row["refers_to"] is None else "revisit"), ("file", name), ("offset", at), ("length", len(raw))):
                    lines[k].append(v)
                at += len(raw)
            yield pa.RecordBatch.from_pydict(lines, pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, path: str, file_bytes: int = 256 << 20) -> DataFrame:
    """Write a record per page to WARC files under ``path``. Returns the captures: key, page_id, record_type, file, offset, length."""
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    rows = classify(pages).mapInArrow(_archive(path, file_bytes), "key string, page_id long, record_type string, file string, offset long, length long")
    return settle(rows, "captures")


def _order(key: str, page: int | None) -> tuple:
    """Captures in Spark's order: key by its bytes, then page_id, null first."""
    return key.encode(), page is not None, page or 0


def _index_file(path: str, block_lines: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        name, out, at, directory, block, last = f"captures-{uuid.uuid4().hex}.idx", None, 0, [], [], None

        def flush() -> None:
            nonlocal at
            raw = zlib.compress("\n".join(json.dumps(x) for x in block).encode(), 6)
            out.write(raw)
            directory.append([block[0][0], block[0][1], at, len(raw)])
            at += len(raw)
            block.clear()

        for part in parts:
            for row in zip(*(part.column(c).to_pylist() for c in ("key", "page_id", "record_type", "file", "offset", "length")), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                block.append(row)
                last = row
                if len(block) >= block_lines:
                    flush()
        found: list[tuple] = []
        if out is not None:
            if block:
                flush()
            raw = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(raw)
            out.write(struct.pack(_TAIL, at, len(raw)))
            out.close()
            found = [(directory[0][0], directory[0][1], last[0], last[1], name)]
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["first_key", "first_page", "last_key", "last_page", "index_file"])

    return run


def build_index(captures: DataFrame, path: str, block_lines: int = 3000) -> DataFrame:
    """Sort captures by key into compressed blocks, one file for each range. Returns the top level: a row for each file."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return settle(lines.mapInArrow(_index_file(path, block_lines), "first_key string, first_page long, last_key string, last_page long, index_file string"), "top-level")


class _Index:
    """An index file that is open in a task: its directory, and the block read last."""

    def __init__(self, fs, root: str, name: str) -> None:
        self.data = fs.open_input_file(f"{root}/{name}")
        size = self.data.size()
        at, n = struct.unpack(_TAIL, self.data.read_at(struct.calcsize(_TAIL), size - struct.calcsize(_TAIL)))
        self.blocks = json.loads(zlib.decompress(self.data.read_at(n, at)))
        self.firsts = [_order(b[0], b[1]) for b in self.blocks]
        self.number, self.lines, self.keys = -1, [], []

    def find(self, key: str, page: int | None) -> list:
        """All captures of a key and page, of which repeated rows give several."""
        want, out = _order(key, page), []
        k = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while k < len(self.blocks) and self.firsts[k] <= want:
            if k != self.number:
                _, _, at, n = self.blocks[k]
                self.number, self.lines = k, [json.loads(x) for x in zlib.decompress(self.data.read_at(n, at)).split(b"\n")]
                self.keys = [_order(x[0], x[1]) for x in self.lines]
            out += self.lines[bisect.bisect_left(self.keys, want) : bisect.bisect_right(self.keys, want)]
            k += 1
        return out


def _locate(path: str):
    """Where the wanted captures stand: file, offset, length."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        index, name = None, None
        for part in parts:
            out: list[tuple] = []
            for want in part.to_pylist():
                if want["index_file"] != name:
                    name = want["index_file"]
                    index = _Index(fs, root, name)
                out += [(file, at, n) for _, _, _, file, at, n in index.find(want["key"], want["page_id"])]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["file", "offset", "length"])

    return run


def _fetch(path: str, with_payload: bool):
    """The records at the places given."""
    fields = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] * with_payload)]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] * with_payload)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        name, archive = None, None
        for part in parts:
            places = part.to_pylist()
            for lo in range(0, len(places), 500):
                out = []
                for place in places[lo : lo + 500]:
                    if place["file"] != name:
                        name, archive = place["file"], fs.open_input_file(f"{root}/{place['file']}")
                    out.append(parse(archive.read_at(place["length"], place["offset"])))
                yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in out], k) for f, k in zip(fields, kinds, strict=True)], names=fields)

    return run


def lookup(spark: SparkSession, wanted: DataFrame, top: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the wanted (key, page_id) pairs, each pair once, by way of the index.

    The top level has one row per index file, as many as Spark has shuffle partitions, and is sent to all tasks.
    """
    files = sorted(top.collect(), key=lambda r: _order(r["first_key"], r["first_page"]))
    firsts = [_order(r["first_key"], r["first_page"]) for r in files]
    names = [r["index_file"] for r in files]

    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, pages, files_ = [], [], []
            for key, page in zip(part.column("key").to_pylist(), part.column("page_id").to_pylist(), strict=True):
                want = _order(key, page)
                # equal captures may have been cut between two files
                for k in range(max(0, bisect.bisect_left(firsts, want) - 1), bisect.bisect_right(firsts, want)):
                    keys.append(key)
                    pages.append(page)
                    files_.append(names[k])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(pages, pa.int64()), pa.array(files_, pa.string())], names=["key", "page_id", "index_file"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = wanted.select("key", "page_id").distinct().mapInArrow(route, "key string, page_id long, index_file string")
    routed = routed.repartitionByRange(n, "index_file", "key", "page_id").sortWithinPartitions("index_file", "key", "page_id")
    places = routed.mapInArrow(_locate(path), "file string, offset long, length long").repartition(n, "file").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return places.mapInArrow(_fetch(path, with_payload), schema)


def round_trip(pages: DataFrame, file_bytes: int = 256 << 20, block_lines: int = 3000) -> DataFrame:
    """Write all pages, index them and read every one back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A null html is an empty payload and a null url an empty one.  Of rows that share page_id, url and html, each is
    a record; where they have the largest page_id of a payload, all are responses.  A page without page_id is
    never the one that others refer to.  An empty table gives empty archives and no rows.
    """
    spark = pages.sparkSession
    path = fresh(spark, "warc")
    captures = write_archives(pages, path, file_bytes)
    top = build_index(captures, path, block_lines)
    wanted = pages.select(url_key(F.col("url")).alias("key"), "page_id")
    return lookup(spark, wanted, top, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {REVISIT_BYTES} AND response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND response <> page_id THEN response END AS refers_to, url FROM r
"""
