"""WARC archives of pages: a writer with revisit records, and a reader that salvages what is sound in damaged files.

Writing: pages with equal payloads share one response record, the others become revisits of it. Each task writes files
of its own, a gzip member or a plain record after the other, and reports them; only reported files count, so what a lost
or repeated task left behind is never read.

Reading: each file is scanned in windows. A record counts if all its checks hold: the gzip checksum of its member, the
version line, the header lines, the length with the two line ends after it, and the digests of block and payload. Where
one fails, the bytes from there on are quarantined and the scan goes on at the next place that looks like a member or a
version line, until a record holds again. Records and quarantined gaps cover each file without overlap.

Defined results: a null payload is empty and written; null ids are written as such and come back null; null addresses
are left out, control characters in them are percent-encoded. Rows that repeat the largest id of equal payloads are all
responses, rows with a null id revisit it, and if all ids are null all are responses. An empty table writes no file and
gives no rows, and other columns are not read. An archive without any sound record is one gap; an empty file has
neither records nor gaps.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm.common import spread_join, stored
from lynceus.session import ensure_checkpoint_dir

END = b"\r\n\r\n"
VERSION_LINE = re.compile(rb"WARC/[01]\.\d+\r\n")
#: What a member or a plain record begins with.
BEGINNING = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.\d")
LONGEST_BEGINNING = 8
WINDOW = 4 << 20
#: Bytes within which the header lines of a record must end.
HEADER = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("path string, offset long, length long, type string, record_id string, target_uri string, refers_to string, "
           "payload_digest string, payload_bytes long, payload binary, reason string")
NAMES = [x.split(" ")[0] for x in RECORDS.split(", ")]


# ---- records ----

def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex_digest(value: str) -> str:
    """Lowercase hex of a sha1 digest given in base32 or hex."""
    name, _, digits = value.strip().partition(":")
    if name.lower() != "sha1":
        raise Damaged("unknown digest")
    try:
        return (base64.b32decode(digits.upper()) if len(digits) == 32 else bytes.fromhex(digits)).hex()
    except ValueError:
        raise Damaged("unreadable digest") from None


def _address(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), url)


def record(kind: str, record_id: str, date: str, block: bytes, **fields: str | None) -> bytes:
    """A WARC record; fields without a value are left out."""
    given = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date,
             **{k.replace("_", "-"): v for k, v in fields.items()},
             "WARC-Block-Digest": _sha1(block), "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in given.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + END


def page_record(record_id: str, url: str | None, payload: bytes, date: str, refers_to: str | None = None,
                refers_url: str | None = None) -> bytes:
    """A response with the payload, or a revisit of the record that has it."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = {"WARC_Target_URI": None if url is None else _address(url), "WARC_Payload_Digest": _sha1(payload)}
    if refers_to is None:
        return record("response", record_id, date, head + payload, Content_Type="application/http; msgtype=response", **fields)
    return record("revisit", record_id, date, head, Content_Type="application/http; msgtype=response", WARC_Profile=PROFILE,
                  WARC_Refers_To=refers_to, WARC_Refers_To_Target_URI=None if refers_url is None else _address(refers_url), **fields)


class Damaged(Exception):
    """A check that a record failed."""


def parse_record(get: Callable[[int, int], bytes], pos: int) -> tuple[dict[str, str], bytes, bytes, int]:
    """Fields (names in lower case), block, payload and end of the record at ``pos``; ``get(at, n)`` has n bytes or fewer."""
    if not VERSION_LINE.match(get(pos, 16)):
        raise Damaged("no version line")
    size = 1 << 12
    while (at := (head := get(pos, size)).find(END)) < 0:
        if size >= HEADER or len(head) < size:
            raise Damaged("header without end")
        size *= 4
    fields: dict[str, str] = {}
    name = ""
    for line in head[:at].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("unreadable header")
        name = name.strip().lower()
        fields[name] = value.strip()
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length) or not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise Damaged("no type, id or length")
    begin = pos + at + len(END)
    end = begin + int(length)
    if get(end, len(END)) != END:
        raise Damaged("length and end disagree")
    block = get(begin, int(length))
    if "warc-block-digest" in fields and _hex_digest(fields["warc-block-digest"]) != hashlib.sha1(block).hexdigest():
        raise Damaged("block digest")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(END)[2]
    if fields["warc-type"] != "revisit" and "warc-payload-digest" in fields \
            and _hex_digest(fields["warc-payload-digest"]) != hashlib.sha1(payload).hexdigest():
        raise Damaged("payload digest")
    return fields, block, payload, end + len(END)


# ---- files ----

class _Windows:
    """Bytes of an open file by position, read in windows."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.start, self.held = file, file.size(), 0, b""

    def get(self, pos: int, n: int) -> bytes:
        n = max(min(n, self.size - pos), 0)
        if not n:
            return b""
        if pos < self.start or pos + n > self.start + len(self.held):
            self.file.seek(pos)
            self.start, self.held = pos, self.file.read(max(n, min(WINDOW, self.size - pos)))
        return self.held[pos - self.start:pos - self.start + n]

    def member(self, pos: int) -> tuple[bytes, int]:
        """The unpacked gzip member at ``pos`` and its end."""
        unpack, out, at = zlib.decompressobj(31), [], pos
        while not unpack.eof:
            packed = self.get(at, 1 << 16)
            if not packed:
                raise Damaged("member without end")
            try:
                out.append(unpack.decompress(packed))
            except zlib.error:
                raise Damaged("gzip checksum or data") from None
            at += len(packed)
        return b"".join(out), at - len(unpack.unused_data)

    def next_beginning(self, pos: int) -> int:
        """The next place from ``pos`` on that looks like a member or a version line; the size, if there is none."""
        while pos < self.size:
            some = self.get(pos, 1 << 20)
            if found := BEGINNING.search(some):
                return pos + found.start()
            if pos + len(some) >= self.size:
                break
            pos += len(some) - LONGEST_BEGINNING
        return self.size


def _records_at(windows: _Windows, pos: int) -> tuple[list[tuple], int]:
    """The record at ``pos``, or all of the member there, and where they end."""
    if windows.get(pos, 2) != b"\x1f\x8b":
        fields, _, payload, end = parse_record(windows.get, pos)
        return [(fields, payload)], end
    data, end = windows.member(pos)
    found, at = [], 0
    while at < len(data):
        fields, _, payload, at = parse_record(lambda p, n: data[p:p + n], at)
        found.append((fields, payload))
    return found, end


def scan(file: pa.NativeFile) -> Iterator[tuple]:
    """(offset, length, records, None) of what is sound and (offset, length, [], reason) of each gap, in order."""
    windows, pos, bad, why = _Windows(file), 0, None, ""
    while pos < windows.size:
        try:
            found, end = _records_at(windows, pos)
        except Damaged as e:
            if bad is None:
                bad, why = pos, str(e)
            pos = windows.next_beginning(pos + 1)
            continue
        if bad is not None:
            yield bad, pos - bad, [], why
            bad = None
        yield pos, end - pos, found, None
        pos = end
    if bad is not None:
        yield bad, windows.size - bad, [], why


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder or file, and its path there."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


# ---- tables ----

def _record_id(value: Column) -> Column:
    shown = F.replace(F.url_encode(value.cast("string")), F.lit("+"), F.lit("%20"))
    return F.coalesce(F.concat(F.lit("<urn:page:"), shown, F.lit(">")), F.lit("<urn:page>"))


def page_of(record_id: Column) -> Column:
    """The id, as text, that a record's name was made of."""
    return F.when(record_id.startswith("<urn:page:"), F.url_decode(F.regexp_extract(record_id, r"^<urn:page:(.*)>$", 1)))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   min_revisit_bytes: int = 1000, max_file_bytes: int = 256 << 20, compress: bool = True,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row to archives in ``folder`` and returns them: path, n_records, n_bytes.

    Of rows with equal payloads of ``min_revisit_bytes`` or more, that with the largest id is the response. Files end
    with the record that brings them to ``max_file_bytes``. ``date`` is what the records give as theirs.
    """
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), data.alias("data"),
                        F.sha1(data).alias("digest"))
    shared = (rows.where(F.octet_length("data") >= min_revisit_bytes).groupBy("digest")
              .agg(F.max(F.struct("id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1 and top.id is not null")
              .select("digest", F.col("top.id").alias("first"), F.col("top.url").alias("first_url")))
    of = spread_join(rows, stored(shared, "warc-shared"), ["digest"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    todo = of.select(_record_id(F.col("id")).alias("name"), "url", "data",
                     F.when(revisit, _record_id(F.col("first"))).alias("refers_to"),
                     F.when(revisit, F.col("first_url")).alias("refers_url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        out, path, made, size = None, "", 0, 0

        def report() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "n_records": made, "n_bytes": size}])

        def packed(x: bytes) -> bytes:
            if not compress:
                return x
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            return pack.compress(x) + pack.flush()

        for batch in batches:
            for name, address, html, refers_to, refers_url in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    task = TaskContext.get()
                    name_of_file = f"pages-{task.partitionId():06d}-{uuid.uuid4().hex}.warc" + ".gz" * compress
                    files.create_dir(root, recursive=True)
                    out, path = files.open_output_stream(f"{root}/{name_of_file}", compression=None), f"{folder}/{name_of_file}"
                    info = packed(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", date, b"format: WARC File Format 1.1\r\n",
                                         Content_Type="application/warc-fields", WARC_Filename=name_of_file))
                    out.write(info)
                    made, size = 1, len(info)
                one = packed(page_record(name.as_py(), address.as_py(), html.as_py(), date, refers_to.as_py(), refers_url.as_py()))
                out.write(one)
                made, size = made + 1, size + len(one)
                if size >= max_file_bytes:
                    yield report()
                    out = None
        if out is not None:
            yield report()

    return stored(todo.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-files")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path of the archives in a folder, by Spark's listing; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path")


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives (``files`` has a row each, with its path) and the gaps between those that are sound.

    Columns path, offset, length (in the file), type, record_id, target_uri, refers_to, payload_digest (hex),
    payload_bytes, payload (null for revisits or if not asked for), reason. Gaps have a reason and null from type to
    payload; a revisit has the digest of what it refers to and no payload_bytes.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                dict(zip(NAMES, map(list, zip(*rows)))),
                schema=pa.schema([(n, t) for n, t in zip(NAMES, [
                    pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()])]))

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files_of, place = filesystem(path)
                with files_of.open_input_file(place) as file:
                    for offset, length, found, reason in scan(file):
                        if reason is not None:
                            rows.append((path, offset, length, *[None] * 7, reason))
                        for fields, payload in found:
                            kind, digest = fields["warc-type"], fields.get("warc-payload-digest")
                            again = kind == "revisit"
                            rows.append((
                                path, offset, length, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"),
                                fields.get("warc-refers-to"),
                                hashlib.sha1(payload).hexdigest() if not again else digest and _hex_digest(digest),
                                None if again else len(payload), payload if with_payload and not again else None, None))
                            held += len(payload) if with_payload else 0
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield batch_of()
                            rows, held = [], 0
        if rows:
            yield batch_of()

    paths = files.select("path")
    # a task a file
    return paths.repartition(max(paths.count(), 1)).mapInArrow(read, RECORDS)


def quarantine(records: DataFrame) -> DataFrame:
    """The log of quarantined gaps: path, offset, length, reason of the first failed check."""
    return records.where("reason is not null").select("path", "offset", "length", "reason")


def resolved(records: DataFrame) -> DataFrame:
    """The sound records, revisits with the payload_bytes of the response that has their digest (null if that is lost)."""
    sound = records.where("reason is null").drop("reason")
    known = sound.where("type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    again = spread_join(sound.where("type = 'revisit'"), known, ["payload_digest"], "left")
    return (sound.where("type <> 'revisit'")
            .unionByName(again.withColumn("payload_bytes", F.col("full_bytes")).select(*sound.columns)))


def archived(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to archives in the shared folder, reads these back and returns, per page, page_id,
    payload_bytes, payload_digest, record_type and refers_to."""
    folder = f"{ensure_checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    files = write_archives(pages, folder, **options)
    records = stored(read_archives(files, with_payload=False).drop("payload"), "warc-records")
    kind = pages.schema["page_id"].dataType
    return (resolved(records).where("type in ('response', 'revisit')")
            .select(page_of(F.col("record_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
                    F.col("type").alias("record_type"), page_of(F.col("refers_to")).cast(kind).alias("refers_to")))


op12 = archived
