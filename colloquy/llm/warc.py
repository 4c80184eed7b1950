"""WARC archives as a Python data source: ``spark.read.format("warc").load(folder)`` and back.

Records are gzip members of their own whose header tells the member's length,
so a reader inflates a record's headers first, tests the pushed-down predicates
on them and steps over the rest of what it does not want. Members and plain
archives of other writers are read as well, by inflating piecewise or counting
through, however many records a member holds. An archive that ends inside a
record is an error.
"""

import base64
import hashlib
import json
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from colloquy.llm.common import filesystem

SCHEMA = ("record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, "
          "payload_length bigint, payload binary")
HEADERS = ("record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to")  # columns that predicates are tested on
FILE_BYTES = 1 << 28        # an archive is closed when it has grown to this size
PARTITION_BYTES = 1 << 26   # small archives are read together up to this size
CHUNK = 1 << 20
#: Names and texts of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {"warc-record-id": "record_id", "warc-type": "record_type", "warc-target-uri": "target_uri", "warc-date": "date",
          "warc-payload-digest": "payload_digest", "warc-refers-to": "refers_to"}


def record(row) -> bytes:
    """One record of ``row`` (columns of SCHEMA); revisits hold the HTTP headers alone."""
    clean = lambda text: "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)
    length = row["payload_length"] if row["payload_length"] is not None else len(row["payload"] or b"")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if row["record_type"] != "revisit":
        block += row["payload"] or b""
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{clean(row['record_id'])}>", f"WARC-Date: {row['date']}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {clean(row['target_uri'])}")
    if row["payload_digest"] is not None:
        lines.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{clean(row['refers_to'])}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` has its own length and that of the data."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = struct.pack("<2sHII", b"sl", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Committed(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class Writer(DataSourceWriter):
    """A task writes files under new names; those of tasks that ended are listed in one file when the job ends."""

    def __init__(self, folder):
        self.folder = folder

    def write(self, rows):
        system, root = filesystem(self.folder)
        system.create_dir(root, recursive=True)
        files, out = [], None
        for row in rows:
            if out is None:
                files.append(f"{uuid.uuid4().hex}.warc.gz")
                out, size = system.open_output_stream(f"{root}/{files[-1]}", compression=None, buffer_size=CHUNK), 0
            data = member(record(row))
            out.write(data)
            size += len(data)
            if size >= FILE_BYTES:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Committed(files)

    def commit(self, messages):
        system, root = filesystem(self.folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([name for m in messages if m is not None for name in m.files]).encode())

    def abort(self, messages):
        pass  # files that are not listed are not read


class Files(InputPartition):
    def __init__(self, paths):
        super().__init__(paths)


class Stream:
    """Bytes of a file in large steps."""

    def __init__(self, file):
        self.file, self.data, self.at = file, b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.data) - self.at < n:
            more = self.file.read(max(CHUNK, n))
            if not more:
                break
            self.data, self.at = self.data[self.at:] + more, 0
        return self.data[self.at:self.at + n]

    def skip(self, n: int):
        held = len(self.data) - self.at
        if n <= held:
            self.at += n
        else:
            self.file.seek(n - held - 1, 1)     # the last byte is read: it must be there
            self.data, self.at = self.file.read(CHUNK), 1
            if not self.data:
                raise ValueError("the archive ends inside a record")


class Inflated:
    """The data of gzip members from where ``stream`` is, inflated piece by piece, up to what is no member."""

    def __init__(self, stream):
        self.stream, self.inflater = stream, None

    def read(self, n: int) -> bytes:
        while True:
            if self.inflater is None:
                if self.stream.peek(2) != b"\x1f\x8b":
                    return b""
                self.inflater = zlib.decompressobj(31)
            part = self.stream.peek(CHUNK)
            data = self.inflater.decompress(part, n)
            taken = len(part) - len(self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail)
            self.stream.skip(taken)
            if not (data or taken or self.inflater.eof):
                raise ValueError("the archive ends inside a gzip member")
            if self.inflater.eof:
                self.inflater = None
            if data:
                return data

    def seek(self, n: int, whence: int):
        while n > 0 and (data := self.read(min(n, CHUNK))):
            n -= len(data)


def parse_head(data: bytes) -> tuple[dict, int]:
    """Header fields of a record and where its block begins; ({}, -1) if ``data`` ends before."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return {}, -1
    found = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found, end + 4


def is_http(fields: dict) -> bool:
    return fields.get("content-type", "").startswith("application/http")


def plain_records(stream, wanted, payload):
    """As ``records``, of records that are not compressed, up to the end or a gzip member."""
    while head := stream.peek(5):
        if head[:1] in b"\r\n":
            stream.skip(1)
            continue
        if head[:2] == b"\x1f\x8b" or not head.strip(b"\0"):
            return
        if not b"WARC/".startswith(head[:5]):
            raise ValueError("what follows a record is no record")
        size = 4096
        while True:
            data = stream.peek(size)
            fields, at = parse_head(data)
            if at >= 0 or len(data) < size:
                break
            size *= 4
        if at < 0:
            raise ValueError("the archive ends inside a header")
        length, block = int(fields.get("content-length", 0)), None
        if wanted(fields):
            need = length if payload else min(length, 4096)
            while block is None or is_http(fields) and need < length and b"\r\n\r\n" not in block:
                need = need if block is None else min(length, 4 * need)     # the whole of the HTTP header
                data = stream.peek(at + need)
                if len(data) < at + need:
                    raise ValueError("the archive ends inside a record")
                block = data[at:]
        stream.skip(at + length)
        if block is not None:
            yield fields, block


def records(file, wanted, payload=True):
    """(fields, block or None) of each record of an archive that ``wanted(fields)``; what is not wanted is stepped over."""
    stream = Stream(file)
    while head := stream.peek(12):
        if head[:2] == b"\x1f\x8b":
            total = None
            if len(head) == 12 and head[3] == 4:
                size = struct.unpack("<H", head[10:12])[0]
                extra = stream.peek(12 + size)[12:]
                if extra[:2] == b"sl" and size == 12:
                    total = struct.unpack("<I", extra[4:8])[0]
            if total:
                inflater = zlib.decompressobj(31)
                begin = inflater.decompress(stream.peek(min(total, 2048)), 4096)
                fields, at = parse_head(begin)
                if at < 0:
                    begin = zlib.decompress(stream.peek(total), 31)
                    fields, at = parse_head(begin)
                    inflater = None
                block = None
                if wanted(fields):
                    if payload or fields.get("warc-type") == "revisit":
                        data = begin if inflater is None else zlib.decompress(stream.peek(total), 31)
                        block = data[at:at + int(fields.get("content-length", 0))]
                    else:
                        block = begin[at:]
                        if is_http(fields) and b"\r\n\r\n" not in block:
                            block = zlib.decompress(stream.peek(total), 31)[at:]
                stream.skip(total)
            else:
                yield from plain_records(Stream(Inflated(stream)), wanted, payload)
                continue
        elif not head.strip(b"\0"):
            stream.skip(len(head))      # padding after a gzip member
            continue
        else:
            yield from plain_records(stream, wanted, payload)
            continue
        if block is not None:
            yield fields, block


def number(text: str | None) -> int | None:
    """A length that a header tells; null if it is none."""
    return int(text) if text and text.strip().isdecimal() else None


def sha1_base32(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def unchunked(content: bytes) -> bytes:
    """A body sent in chunks as one; what does not follow that form ends it."""
    parts, at = [], 0
    while (end := content.find(b"\r\n", at)) > 0:
        digits = content[at:end].split(b";")[0].strip()
        size = int(digits, 16) if digits and not digits.strip(b"0123456789abcdefABCDEF") else 0
        if not size:
            break
        parts.append(content[end + 2:end + 2 + size])
        at = end + 4 + size
    return b"".join(parts)


def row_of(fields: dict, block: bytes, payload=True, verify=True) -> tuple:
    """The columns of SCHEMA of a record."""
    row = {column: fields.get(name) for name, column in FIELDS.items()}
    for name in ("record_id", "refers_to"):
        row[name] = row[name].strip("<>") if row[name] else None
    digest = row["payload_digest"]
    row["payload_digest"] = digest.partition(":")[2] if digest and digest.lower().startswith("sha1:") else digest
    content, length, chunked = block, number(fields.get("content-length")) or 0, False
    if is_http(fields):
        http, at = parse_head(block)
        content, length = (block[at:], length - at) if at >= 0 else (block, length)
        chunked = "chunked" in http.get("transfer-encoding", "").lower()
        if row["record_type"] == "revisit":     # the payload is elsewhere; its length, if anything tells it
            length = number(http.get("content-length"))
    whole = payload and row["record_type"] != "revisit"
    if whole and verify and digest and digest.lower().startswith("sha1:"):
        told = row["payload_digest"].upper()
        row["payload_digest"] = told
        if told != sha1_base32(content) and not (chunked and told == sha1_base32(unchunked(content))):
            raise ValueError(f"the payload of {row['record_id']} does not have its digest")
    return (row["record_id"], row["record_type"], row["target_uri"], row["date"], row["payload_digest"], row["refers_to"],
            length, content if whole else None)


class Reader(DataSourceReader):
    def __init__(self, folder, payload, verify):
        self.folder, self.payload, self.verify, self.tests = folder, payload, verify, []

    def pushFilters(self, filters):
        """Equality, membership, prefix and presence of header columns are tested here, on the headers alone."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, "there", None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = filesystem(self.folder)
        found = system.get_file_info(fs.FileSelector(root))
        lists = [f.path for f in found if f.base_name.startswith("_files-")]
        listed = set()
        for path in lists:
            with system.open_input_stream(path) as file:
                listed |= set(json.loads(file.read()))
        archives = sorted((f.path, f.size) for f in found if f.is_file and (f.base_name in listed if lists else f.base_name.endswith((".warc", ".warc.gz"))))
        parts, size = [[]], 0
        for path, n in archives:
            if parts[-1] and size + n > PARTITION_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [Files(p) for p in parts]

    def read(self, partition):
        import pyarrow as pa

        columns = {column: name for name, column in FIELDS.items()}

        def wanted(fields):
            for column, test, value in self.tests:
                got = fields.get(columns[column])
                if got is None:
                    return False
                got = got.strip("<>") if column in ("record_id", "refers_to") else got.partition(":")[2] if column == "payload_digest" and got.startswith("sha1:") else got
                if test == "in" and got not in value or test == "starts" and not got.startswith(value):
                    return False
            return True

        system, _ = filesystem(self.folder)
        schema = pa.schema([(n, pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string())
                            for n in (c.split()[0] for c in SCHEMA.split(", "))])
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for path in partition.value:
            with system.open_input_file(path) as file:
                for fields, block in records(file, wanted, self.payload):
                    rows.append(row_of(fields, block, self.payload, self.verify))
                    size += len(block) + 500
                    if size > 1 << 22:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` (false: headers only), ``verify`` (digests of payloads that are read)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], self.options.get("payload", "true") == "true", self.options.get("verify", "true") == "true")

    def writer(self, schema, overwrite):
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(df: DataFrame, folder: str, id_col="page_id", url_col="url", text_col="html", date="1970-01-01T00:00:00Z", least=0) -> None:
    """Write a record per row, its payload the text in UTF-8 (null: empty).

    Of rows with equal payloads of at least ``least`` bytes, that with the
    largest id is a response and the others revisits of it; rows that repeat
    this id are responses too. A row with a null id revisits its group's
    response, or is one if its group has no id. The digests of the groups are
    joined to the rows, where adaptive execution splits a payload that a large
    share of all rows have; the largest ids are added up before the shuffle.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(url_col).cast("string").alias("target_uri"),
                     F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit("").cast("binary")).alias("payload")) \
        .withColumn("_sha1", F.sha1("payload"))
    firsts = rows.filter(F.octet_length("payload") >= least).groupBy("_sha1").agg(F.max("_id").alias("_first"))
    joined = rows.join(firsts, "_sha1", "left")
    repeats = F.coalesce((F.col("_id") != F.col("_first")) | (F.col("_id").isNull() & F.col("_first").isNotNull()), F.lit(False))
    name = lambda c: F.concat(F.lit("urn:row:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))

    joined.select(
        name("_id").alias("record_id"), F.when(repeats, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"),
        _base32("_sha1").alias("payload_digest"), F.when(repeats, name("_first")).alias("refers_to"),
        F.octet_length("payload").cast("bigint").alias("payload_length"),
        F.when(~repeats, F.col("payload")).alias("payload")).write.format("warc").mode("append").save(folder)


def _base32(hex_col: str):
    """Base32 of 40 hexadecimal digits: every five are four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(8):
        number = F.conv(F.substring(hex_col, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(number, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)
