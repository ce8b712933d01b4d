"""WARC archives as a Spark data source, and the archiving of pages with revisits of equal payloads."""

from __future__ import annotations

import operator
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from ..sources.staging import stage_root
from .common import staged, table

COLUMNS = (
    "record_type string, record_id string, date string, target_uri string, content_type string, payload_digest string, "
    "refers_to string, content_length long, headers map<string,string>, payload binary"
)
#: Fixed values of the format: the header that each column comes from, and the profile of revisits.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_length": "Content-Length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, CHUNK, LONGEST_HEADER = b"\r\n\r\n", 1 << 16, 1 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it; it works alike on driver and executors."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


class Plain:
    """An uncompressed archive: what isn't wanted is sought past."""

    def __init__(self, file):
        self.file, self.ahead, self.skipped, self.size = file, b"", 0, file.size()

    def past(self, place: int) -> None:
        if place > self.size:
            raise ValueError("the archive ends within a record")
        self.file.seek(place)

    def more(self) -> bytes:
        return self.file.read(CHUNK)

    def until(self, mark: bytes) -> bytes | None:
        """All up to and with `mark`; None at the end of the archive."""
        out = bytearray(self.ahead)
        while (at := out.find(mark)) < 0:
            got = self.more()
            if not got:
                if out.strip():
                    raise ValueError("the archive ends within a header")
                return None
            out += got
            if len(out) > LONGEST_HEADER:
                raise ValueError("no WARC record: its header doesn't end")
        self.ahead = bytes(out[at + len(mark) :])
        return bytes(out[: at + len(mark)])

    def take(self, n: int) -> bytes:
        out = bytearray(self.ahead[:n])
        self.ahead = self.ahead[n:]
        while len(out) < n and (got := self.more()):
            out += got[: n - len(out)] if (extra := len(out) + len(got) - n) > 0 else got
            self.ahead = got[-extra:] if extra > 0 else b""
        if len(out) < n:
            raise ValueError("the archive ends within a record")
        return bytes(out)

    def drop(self, n: int) -> None:
        if n > len(self.ahead):
            self.past(self.file.tell() + n - len(self.ahead))
            self.skipped += n - len(self.ahead)
        self.ahead = self.ahead[n:]


class Inflated(Plain):
    """A gzip archive, inflated as far as it is asked for. A member that states its lengths (the `sl` field
    that this module's writer sets) is sought past without inflating it."""

    def __init__(self, file):
        super().__init__(file)
        self.raw, self.start, self.inner, self.sizes, self.given = b"", 0, None, None, 0

    def _open(self) -> bool:
        """Begins the member at `start`, if there is one."""
        while len(self.raw) < 24 and (got := self.file.read(CHUNK)):
            self.raw += got
        if not self.raw:
            return False
        self.inner, self.given = zlib.decompressobj(31), 0
        fits = self.raw[3:4] == b"\x04" and self.raw[12:16] == b"sl\x08\0" and len(self.raw) >= 24
        self.sizes = struct.unpack("<II", self.raw[16:24]) if fits else None
        return True

    def more(self) -> bytes:
        out = b""
        while not out:
            if self.inner is None and not self._open():
                return b""
            source = self.raw or self.file.read(CHUNK)
            if not source:
                raise ValueError("the archive ends within a member")
            out = self.inner.decompress(source, CHUNK)
            self.raw = self.inner.unconsumed_tail
            if self.inner.eof:
                self.raw, self.inner = self.inner.unused_data, None
                self.start = self.file.tell() - len(self.raw)
        self.given += len(out)
        return out

    def drop(self, n: int) -> None:
        # `given` bytes of this member are out, of which `ahead` wait: the record ends with the member.
        if self.inner is not None and self.sizes and self.given - len(self.ahead) + n == self.sizes[1]:
            self.skipped += self.sizes[1] - self.given
            self.start += self.sizes[0]
            self.past(self.start)
            self.ahead, self.raw, self.inner = b"", b"", None
            return
        while n > len(self.ahead):
            n -= len(self.ahead)
            self.ahead = self.more()
            if not self.ahead:
                raise ValueError("the archive ends within a record")
        self.ahead = self.ahead[n:]


def parsed(header: bytes) -> tuple[str, dict[str, str]]:
    """The first line and the fields (names in lower case, folded lines joined)."""
    lines = header.decode("utf-8", "replace").strip().split("\r\n")
    fields, last = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    return lines[0], fields


def entity(block: bytes) -> bytes:
    """The body of an HTTP message, with its transfer and content codings undone."""
    head, _, body = block.partition(END)
    fields = parsed(head)[1]
    if "chunked" in fields.get("transfer-encoding", "").lower():
        out, at = bytearray(), 0
        while (end := body.find(b"\r\n", at)) >= 0 and (n := int(body[at:end].split(b";")[0] or b"0", 16)):
            out += body[end + 2 : end + 2 + n]
            at = end + 2 + n + 2
        body = bytes(out)
    coding = fields.get("content-encoding", "").lower()
    return zlib.decompress(body, 47) if coding in ("gzip", "x-gzip", "deflate") else body


def archived(stream: Plain, wanted, with_payload: bool):
    """Records of an archive as dicts. Headers come first; the block of a record that `wanted` refuses, or
    whose payload nobody asks for, is skipped."""
    while (header := stream.until(END)) is not None:
        version, fields = parsed(header)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
        row["content_length"] = int(row["content_length"] or 0)
        row["headers"] = list(fields.items())
        if not wanted(row):
            stream.drop(row["content_length"] + 4)
            continue
        row["payload"] = None
        if with_payload and row["record_type"] != "revisit":
            block = stream.take(row["content_length"])
            row["payload"] = entity(block) if (row["content_type"] or "").startswith("application/http") else block
            stream.drop(4)
        else:
            stream.drop(row["content_length"] + 4)
        yield row


def test_of(f: ds.Filter):
    """A function of a record that is true, false or null as a pushed filter is; None for filters that
    aren't of headers."""
    if isinstance(f, ds.Not):
        inner = test_of(f.child)
        return inner and (lambda row: None if (v := inner(row)) is None else not v)
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if name not in HEADERS:
        return None
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        return lambda row, null=isinstance(f, ds.IsNull): (row[name] is None) == null
    value = f.value
    if isinstance(f, ds.EqualNullSafe):
        return lambda row: row[name] == value
    tests = {
        ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le,
        ds.In: lambda v, some: v in some, ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: operator.contains,
    }
    how = tests.get(type(f))
    if how is None or value is None or isinstance(f, ds.In) and None in value:
        return None
    # Spark orders text by its UTF-8 bytes, which is the order of code points here.
    return lambda row: None if row[name] is None else how(row[name], value)


@dataclass
class Files(ds.InputPartition):
    paths: tuple[str, ...]


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.options, self.filters = schema.fieldNames(), options, []
        if unknown := set(self.names) - {*HEADERS, "headers", "payload"}:
            raise ValueError(f"no columns of WARC records: {sorted(unknown)}")

    def pushFilters(self, filters):
        for f in filters:
            if test_of(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        """Whole files, small ones together up to `split_bytes`; the writer keeps files to that size."""
        system, root = file_system(self.options["path"])
        most = int(self.options.get("split_bytes", 128 << 20))
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.path) and "/_temporary/" not in f.path)
        bins, room = [], 0
        for path, size in files:
            if size > room:
                bins.append([])
                room = most
            bins[-1].append(path)
            room -= size
        return [Files(tuple(b)) for b in bins]

    def read(self, partition):
        if not isinstance(partition, Files):
            return
        system, _ = file_system(self.options["path"])
        tests = [test_of(f) for f in self.filters]
        kinds = {"content_length": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in self.names])
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                packed = file.read(2) == b"\x1f\x8b"
                file.seek(0)
                stream = Inflated(file) if packed else Plain(file)
                for row in archived(stream, lambda r: all(t(r) for t in tests), "payload" in self.names):
                    rows.append({n: row[n] for n in self.names})
                    size += len(row["payload"] or b"") + 1024
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def safe(value: str) -> bytes:
    """A header's value without control characters, which are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", value).encode()


def record(row: dict) -> bytes:
    """A record's bytes: its header, block and end. Responses have their payload in an HTTP message."""
    payload, kind = row.get("payload") or b"", row["record_type"]
    content = row.get("content_type") or ("application/http;msgtype=response" if kind in ("response", "revisit") else "application/octet-stream")
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d%s%s" % (len(payload), END, payload)
    else:
        block = b"HTTP/1.1 200 OK" + END if kind == "revisit" else payload
    fields = [(h, row.get(c)) for c, h in HEADERS.items() if c not in ("content_length", "content_type")]
    fields += [("WARC-Profile", PROFILE if kind == "revisit" else None), *(row.get("headers") or []), ("Content-Type", content), ("Content-Length", str(len(block)))]
    lines = [b"WARC/1.1", *(h.encode() + b": " + safe(v) for h, v in fields if v is not None)]
    return b"\r\n".join(lines) + END + block + END


def member(data: bytes, level: int) -> bytes:
    """A gzip member that states its length and that of its content in an extra field."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    sizes = 24 + len(body) + 8, len(data)
    if max(sizes) >= 1 << 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, *sizes) + body + tail


@dataclass
class Written(ds.WriterCommitMessage):
    names: tuple[str, ...]


class WarcWriter(ds.DataSourceArrowWriter):
    """Tasks write to a folder of their own kind; the commit moves the files of successful tasks only."""

    def __init__(self, schema, options, overwrite):
        if lacking := {"record_type", "record_id", "date"} - set(schema.fieldNames()):
            raise ValueError(f"records lack {sorted(lacking)}")
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.level, self.most = int(options.get("level", 4)), int(options.get("split_bytes", 128 << 20))

    def write(self, iterator):
        system, root = file_system(self.path)
        system.create_dir(f"{root}/_temporary", recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/_temporary/{names[-1]}", compression=None), 0
                packed = member(record(batch.slice(k, 1).to_pylist()[0]), self.level)
                out.write(packed)
                size += len(packed)
                if size >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(tuple(names))

    def commit(self, messages):
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(pafs.FileSelector(root)):
                if old.is_file:
                    system.delete_file(old.path)
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{root}/_temporary/{name}", f"{root}/{name}")
        self.abort([])

    def abort(self, messages):
        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary")


class WarcSource(ds.DataSource):
    """`spark.read.format("warc").load(path)`: records of .warc and .warc.gz files under a folder, in the
    columns of COLUMNS or those of a given schema. A schema without payload reads headers alone."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, columns: str = COLUMNS) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def write_warc(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


#: Up to so many groups of equal payloads (some 150 bytes each) are broadcast; more meet their rows in SALTS parts.
BROADCAST_GROUPS, SALTS = 200_000, 32


def met(rows: DataFrame, groups: DataFrame, on: str, salt: Column) -> DataFrame:
    """`rows` left-joined with `groups`, a table of few columns with `on` once each. A group of any size is
    spread: its row is broadcast, if all together are few, or goes to every salt."""
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), on, "left")
    salts = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(salts, [on, "_salt"], "left").drop("_salt")


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """A WARC record per page: a response, or a revisit of the response with an equal payload.

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least `least` bytes the row
    with the smallest key is the response (a null key comes last); of rows that share that key one
    is, the others revisit it. Records have an id each, so repeated and equal rows stay apart. The
    key goes to the header X-Page-ID, absent where it is null; a null url has no header. Payloads
    are compared by SHA-256. Other columns are ignored; an empty table gives no records.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("target_uri"), payload.alias("payload"), F.monotonically_increasing_id().alias("mark"))
    rows = staged(rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload")), "pages")
    first = F.struct(F.isnull("key").alias("none"), "key", "mark")
    groups = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("c")).filter("c > 1")
    joined = met(rows, staged(groups.select("digest", F.col("first.mark").alias("first")), "groups"), "digest", F.col("mark"))

    def record_id(mark: Column) -> Column:
        h = F.md5(F.concat_ws(":", F.col("digest"), mark.cast("string")).cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))

    again = F.coalesce(F.col("first") != F.col("mark"), F.lit(False))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        record_id(F.col("mark")).alias("record_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        "target_uri",
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, record_id(F.col("first"))).alias("refers_to"),
        F.map_filter(F.create_map(F.lit("X-Page-ID"), F.col("key").cast("string")), lambda _, v: v.isNotNull()).alias("headers"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archived_pages(spark: SparkSession, path: str, key: str = "page_id", kind: str = "long") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) per record of an archive of pages. What
    responses hold is measured on their payloads; a revisit takes it from the response that it names."""
    own = F.col("headers")["x-page-id"].cast(kind).alias("key")
    full = read_warc(spark, path).filter("record_type = 'response'")
    responses = staged(full.select("record_id", own, F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest")), "responses")
    slim = read_warc(spark, path, "record_type string, record_id string, refers_to string, headers map<string,string>")
    revisits = staged(slim.filter("record_type = 'revisit'").select(own, "refers_to", F.xxhash64("record_id").alias("salt")), "revisits")
    named = revisits.select("refers_to").distinct()
    originals = staged(responses.select(F.col("record_id").alias("refers_to"), F.col("key").alias("original"), "bytes", "digest").join(named, "refers_to"), "originals")
    again = met(revisits, originals, "refers_to", F.col("salt"))
    both = responses.select("key", "bytes", "digest", F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("original"))
    out = both.unionByName(again.select("key", "bytes", "digest", F.lit("revisit").alias("record_type"), "original"))
    return out.select(F.col("key").alias(key), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("original").alias("refers_to"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{stage_root(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    return archived_pages(spark, path)


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
