"""WARC archives as a Python data source.

Reading: the driver lists the archive's files and plans partitions of about equal bytes.
Predicates on record type, target address, record id and digest are pushed into the reader.
For each record the block of headers is decompressed and parsed first; a record whose headers
fail a pushed predicate is skipped, and so is a payload where ``payload`` is ``false``: each
gzip member carries its own length in a header field, so the reader seeks past it without
decompressing. (Members of other writers lack that field and are decompressed to their end.)

Writing: each task writes one file under a name of its own and the driver commits the list of
files in a manifest of this write, so what a lost or repeated task left behind is never read.
``append`` adds a manifest; the manifest of an ``overwrite`` names those that it replaces. Files
under other names (archives of other writers, compressed or not) are always read.

Spark keeps what was pushed down with the DataFrame of a ``load()``: load anew for another filter.

Payloads are bytes: what follows the HTTP headers in blocks of HTTP, else the whole block. Null
payloads are empty, headers without a value are left out; where a header's value can't be written
as it is (line breaks, percent signs, other than ASCII) the record's headers are percent-encoded
and marked so; headers of other writers are left as they are. A header that repeats has its
values joined by line feeds. An empty table makes an archive without records; rows without a
page_id are responses and have none when read back.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from sparkloom.llm.common import fresh, table

SCHEMA = "record_type string, record_id string, target_uri string, record_date string, payload_digest string, refers_to string, payload_length bigint, headers map<string,string>, payload binary"
ARROW = pa.schema([(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "record_date", "payload_digest", "refers_to")] + [("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
#: Columns on which predicates are pushed down, and their headers.
PUSHED = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST, OWN, HTTP = re.compile(r"_files-[0-9a-f]{32}\.json"), re.compile(r"part-[0-9a-f]{32}\.warc\.gz"), "application/http"
ENCODED = ("X-Header-Encoding", "percent")
SPLIT_BYTES, BATCH_BYTES, BATCH_ROWS = 32 << 20, 8 << 20, 1000
#: A gzip member's header with one extra field "SL": the length of the member.
GZIP = struct.Struct("<2sBBIBBH2sHI")


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path and the path in it. A path without a scheme is local here; ``common.qualified`` gives it the one that Spark would."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def member(record: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = GZIP.size + len(body) + 8
    return GZIP.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 8, b"SL", 4, size) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """One record: WARC headers, HTTP headers and, unless it is a revisit, the payload; records of other types than exchanges have the payload alone."""
    payload, kind = row["payload"] or b"", row["record_type"]
    block = payload
    if kind in ("response", "revisit", "request"):
        length = row["payload_length"] if row["payload_length"] is not None else len(payload)
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (b"" if kind == "revisit" else payload)
    heads = [("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["record_date"]), ("WARC-Payload-Digest", row["payload_digest"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", REVISIT if kind == "revisit" else None), ("Content-Type", f"{HTTP}; msgtype=response" if block is not payload else None), *(row["headers"] or ()), ("Content-Length", len(block))]
    heads = [(k, str(v)) for k, v in heads if v is not None]
    coded = [(k, urllib.parse.quote(v, safe=QUIET)) for k, v in heads]
    if coded != heads:
        coded.append(ENCODED)
    return ("WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in coded) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


#: Printable ASCII but %, which stay as they are in a header; what else it holds is percent-encoded.
QUIET = "".join(map(chr, range(32, 127))).replace("%", "")


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                kind = "starts" if isinstance(f, StringStartsWith) else "in"
                self.wanted.append((kind, PUSHED[f.attribute[0]], tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self):
        fs, root = filesystem(self.path)
        files = [f for m in manifests(fs, root).values() for f in m["files"]]
        for x in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)):
            if x.path.endswith((".warc", ".warc.gz")) and not OWN.fullmatch(x.base_name):
                files.append([posixpath.relpath(x.path, root), x.size])
        out, own, size = [], [], 0
        for name, n in sorted(files):
            if own and size + n > SPLIT_BYTES:
                out.append(Files(own))
                own, size = [], 0
            own.append(name)
            size += n
        return [*out, Files(own)]

    def _passes(self, heads: dict) -> bool:
        for kind, name, values in self.wanted:
            own = heads.get(name)
            if own is None or not (own.startswith(values) if kind == "starts" else own in values):
                return False
        return True

    def read(self, partition):
        fs, root = filesystem(self.path)
        rows, size = [], 0
        for name in partition.paths:
            with fs.open_input_file(posixpath.join(root, name)) as f:
                for row in self._records(f):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _records(self, f) -> Iterator[dict]:
        magic = f.read(2)
        return self._members(f) if magic == b"\x1f\x8b" else self._plain(f)

    def _row(self, heads: dict, block: bytes) -> dict:
        """A record from its headers and as much of its block as was read: all of it, or the HTTP headers at least."""
        length = int(heads.get("content-length") or 0)
        gap, own = -4, None
        if heads.get("content-type", "").startswith(HTTP):
            gap = block.find(b"\r\n\r\n")
            own = parse(block[: gap if gap >= 0 else len(block)]).get("content-length")
        payload = block[gap + 4 :] if self.payload and gap != -1 else None
        size = int(own) if own and own.isdigit() else length - gap - 4 if gap != -1 else None
        return {"record_type": heads.get("warc-type"), "record_id": heads.get("warc-record-id"), "target_uri": heads.get("warc-target-uri"), "record_date": heads.get("warc-date"), "payload_digest": heads.get("warc-payload-digest"), "refers_to": heads.get("warc-refers-to"), "payload_length": size, "headers": list(heads.items()), "payload": payload}

    def _needs_block(self, heads: dict) -> bool:
        return self.payload or heads.get("content-type", "").startswith(HTTP)

    def _plain(self, f) -> Iterator[dict]:
        """Records that are not compressed, one behind the other; unwanted blocks are seeked past."""
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            text = f.read(4096)
            skip = len(text) - len(text.lstrip(b"\r\n"))
            if skip:
                at += skip
                continue
            while (cut := text.find(b"\r\n\r\n")) < 0 and (chunk := f.read(1 << 16)):
                text += chunk
            if cut < 0:
                return
            heads = parse(text[:cut])
            first, length = at + cut + 4, int(heads.get("content-length") or 0)
            if self._passes(heads):
                want = length if self.payload else min(length, 1 << 16) if self._needs_block(heads) else 0
                block = text[cut + 4 : cut + 4 + want]
                if len(block) < want:
                    f.seek(first + len(block))
                    block += f.read(want - len(block))
                yield self._row(heads, block)
            at = first + length

    def _members(self, f) -> Iterator[dict]:
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            head = f.read(GZIP.size)
            fixed = len(head) == GZIP.size and head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"SL"
            size = GZIP.unpack(head)[-1] if fixed else None
            f.seek(at)
            stream = zlib.decompressobj(31)
            raw = f.read(min(4096, size) if size else 4096)
            text, left = bytearray(stream.decompress(raw, 8192)), stream.unconsumed_tail

            def more(want: int) -> bool:
                nonlocal left
                if stream.eof:
                    return False
                chunk = left or f.read(1 << 16)
                text.extend(stream.decompress(chunk, want))
                left = stream.unconsumed_tail
                return bool(chunk)

            # A member holds one record, or in some archives many.
            while True:
                while not (text := text.lstrip(b"\r\n")) and more(8192):
                    pass
                while (cut := text.find(b"\r\n\r\n")) < 0 and more(8192):
                    pass
                if cut < 0:
                    break
                heads = parse(text[:cut])
                block = cut + 4
                full = block + int(heads.get("content-length") or 0)
                if self._passes(heads):
                    if self.payload:
                        while len(text) < full and more(max(8192, full - len(text))):
                            pass
                    elif self._needs_block(heads):
                        while text.find(b"\r\n\r\n", block) < 0 and len(text) < full and more(8192):
                            pass
                    yield self._row(heads, bytes(text[block:full]))
                if size:
                    break
                while full > len(text):
                    full -= len(text)
                    text.clear()
                    if not more(1 << 16):
                        break
                del text[:full]
            if size:
                at += size
            else:
                while not stream.eof and more(1 << 16):
                    text.clear()
                # Behind the member's end stands what was read but not used; a member cut short ends the file.
                at = f.tell() - len(stream.unused_data) if stream.eof else end


def parse(block: bytes) -> dict[str, str]:
    """Header lines after the first, names in lower case."""
    pairs = [(k.strip().lower(), v.strip()) for k, sep, v in (x.partition(":") for x in bytes(block).decode("utf-8", "replace").split("\r\n")[1:]) if sep]
    mark = (ENCODED[0].lower(), ENCODED[1])
    if mark in pairs:
        pairs = [(k, urllib.parse.unquote(v)) for k, v in pairs if (k, v) != mark]
    out: dict[str, str] = {}
    for k, v in pairs:
        out[k] = f"{out[k]}\n{v}" if k in out else v
    return out


def manifests(fs: pyarrow.fs.FileSystem, root: str) -> dict[str, dict]:
    """The manifests of an archive that no later one replaces, by name."""
    found = {}
    for x in fs.get_file_info(pyarrow.fs.FileSelector(root)):
        if MANIFEST.fullmatch(x.base_name):
            with fs.open_input_stream(x.path) as f:
                found[x.base_name] = json.loads(f.read())
    gone = {name for m in found.values() for name in m["replaces"]}
    return {name: m for name, m in found.items() if name not in gone}


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", "6")), overwrite

    def write(self, iterator):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(posixpath.join(root, name), compression=None) as f:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = member(record(row), self.level)
                    f.write(data)
                    size += len(data)
        return Written(name, size)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        before = manifests(fs, root) if self.overwrite else {}
        # One file says what is there now; whatever happens after it, nothing old is read.
        with fs.open_output_stream(posixpath.join(root, f"_files-{uuid.uuid4().hex}.json"), compression=None) as f:
            f.write(json.dumps({"files": [[m.name, m.size] for m in messages if m], "replaces": sorted(before)}).encode())
        for m in before.values():
            for name, _ in m["files"]:
                fs.delete_file(posixpath.join(root, name))

    def abort(self, messages):
        fs, root = filesystem(self.path)
        for m in messages:
            if m:
                fs.delete_file(posixpath.join(root, m.name))


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, least: int = 100, salts: int = 16) -> DataFrame:
    """Records of pages (page_id, url, html): of equal payloads of ``least`` bytes or more the one with the smallest page_id is the response, the others revisit it. Rows that repeat that page_id are responses as well."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("target_uri"), body.alias("payload")).withColumn("_digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    # Only digests that two rows share meet the pages again, and those in several partitions, so that one payload may hold any share of the rows.
    firsts = rows.filter(F.col("payload_length") >= least).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    firsts = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(firsts, ["_digest", "_salt"], "left")
    again = F.col("page_id") > F.col("_first")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    return rows.select(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), name(F.col("page_id")).alias("record_id"), "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("record_date"), F.concat(F.lit("sha256:"), "_digest").alias("payload_digest"),
        F.when(again, name(F.col("_first"))).alias("refers_to"), "payload_length",
        F.map_from_entries(F.filter(F.array(head("X-Page-ID", F.col("page_id")), F.when(again, head("X-Refers-To-Page", F.col("_first")))), lambda x: x.isNotNull())).alias("headers"),
        F.when(~F.coalesce(again, F.lit(False)), F.col("payload")).alias("payload"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = fresh(spark, "warc")
    page_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").option("level", "4").save(path)
    # Revisits by their headers alone; responses with their payloads, from which length and digest are taken.
    read = lambda **options: spark.read.format("warc").options(path=path, **options).load()
    own = F.col("headers")["x-page-id"].cast("long").alias("page_id")
    responses = read().filter(F.col("record_type") == "response").select(own, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read(payload="false").filter(F.col("record_type") == "revisit").select(own, F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", F.col("headers")["x-refers-to-page"].cast("long").alias("refers_to"))
    return responses.unionByName(revisits)
