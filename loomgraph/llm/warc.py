"""WARC archives: written with an index of every record, read back by coalesced byte ranges.

Archives are gzip files with a member for each record, as the format asks for. The index (file, offset, length, URL,
payload digest and more for each record) is what the writing tasks return and is a Parquet table; only files that it
names belong to the archive, so a repeated or lost task does no harm. Reading sorts the selected index rows by
file and offset, joins neighbouring ranges into one read, and checks every payload against its digest.

Archives live in any file system that pyarrow can open by URI (file, s3, gs, hdfs with its client library).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import fresh_path, ship, staged, tidy

INDEX = "file string, offset long, length long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_INDEX = pa.schema([("file", "string"), ("offset", "int64"), ("length", "int64"), ("page_id", "int64"), ("url", "string"), ("record_type", "string"), ("refers_to", "int64"), ("payload_digest", "string"), ("payload_bytes", "int64")])
_RECORD = pa.schema([("page_id", "int64"), ("url", "string"), ("record_type", "string"), ("refers_to", "int64"), ("payload_digest", "string"), ("payload_bytes", "int64"), ("payload", "binary")])
#: An archive file is closed beyond this size. Ranges join over gaps up to GAP, into reads up to SPAN.
FILE_BYTES, GAP, SPAN = 256 << 20, 64 << 10, 4 << 20
#: What a reading task reads, about.
READ_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, payload_digest: str) -> bytes:
    """One gzip member. A revisit has no block but keeps the digest and size of the payload that it stands for."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    block = b"" if revisit else payload
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def decode_record(member: bytes) -> dict:
    """The record of one gzip member; payload is None for revisits. A payload that misses its digest is an error."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    block, kind, found = rest[:n], fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if len(block) != n or rest[n:] != b"\r\n\r\n" or kind == "response" and digest(block) != found:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(name: str) -> int | None:
        x = fields.get(name, "<urn:page:none>")[len("<urn:page:") : -1]
        return None if x == "none" else int(x)

    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": page("WARC-Refers-To") if kind == "revisit" else None, "payload_digest": found, "payload_bytes": len(block) if kind == "response" else int(fields["X-Payload-Length"]), "payload": block if kind == "response" else None}


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder)
        out, name, offset, rows = None, "", 0, []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(rows, schema=_INDEX)
            rows.clear()
            return batch

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, sha, revisit, refers = (batch.column(k)[i].as_py() for k in range(6))
                if out is None:
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                member = encode_record(page_id, url, payload, refers, revisit, sha)
                out.write(member)
                rows.append({"file": name, "offset": offset, "length": len(member), "page_id": page_id, "url": url, "record_type": "revisit" if revisit else "response", "refers_to": refers, "payload_digest": sha, "payload_bytes": len(payload)})
                offset += len(member)
                if offset >= FILE_BYTES:
                    out.close()
                    out = None
                if len(rows) >= 4096:
                    yield flush()
        if out is not None:
            out.close()
        yield flush()

    return run


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Archives of one record for each row of pages (page_id, url, html) below folder; their index.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of least_bytes at least, those of the
    largest page_id are responses and the others revisit it; smaller payloads are all responses. A null page_id never
    is the largest unless all are null, and then all are responses. A payload's rows are joined to their class as two
    plain exchanges, so that a payload with a third of all rows is split; classes are pre-aggregated. Line breaks in a
    URL are written as %0D and %0A. Other columns are not read; an empty table gives no archive and an empty index.
    """
    spark = pages.sparkSession
    ship(spark)
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = p.withColumn("sha", F.sha1("payload")).withColumn("n", F.length("payload"))
    owners = keyed.where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("rows"))
    owners = staged(owners.where("rows > 1").select("sha", "n", "owner"), "owners")
    rows = keyed.join(owners, ["sha", "n"], "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("owner")) & F.col("owner").isNotNull(), F.lit(False))
    rows = rows.select("page_id", "url", "payload", _base32("sha").alias("digest"), revisit.alias("revisit"), F.when(revisit, F.col("owner")).alias("refers_to"))
    return staged(rows.mapInArrow(tidy(_writer(folder)), INDEX), "warc-index")


def _base32(hex_column: str) -> F.Column:
    """Upper-case base32 of a hex SHA-1 (160 bits: 32 digits, no padding)."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    parts = [F.lpad(F.conv(F.substring(hex_column, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), alphabet, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def coalesced(rows: list[tuple[str, int, int]], gap: int = GAP, span: int = SPAN) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as reads (file, start, size, parts): neighbours over small gaps are one read."""
    parts: list[tuple[int, int]] = []
    name, start, end = "", 0, 0
    for f, o, n in rows:
        if parts and (f != name or o - end > gap or o + n - start > span):
            yield name, start, end - start, parts
            parts = []
        if not parts:
            name, start, end = f, o, o
        parts.append((o - start, n))
        end = max(end, o + n)
    if parts:
        yield name, start, end - start, parts


def _reader(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder)
        opened, name = None, ""
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            for f, start, size, parts in coalesced(rows):
                if f != name:
                    if opened is not None:
                        opened.close()
                    opened, name = fs.open_input_file(f"{at}/{f}"), f
                data, out = opened.read_at(size, start), []
                for o, n in parts:
                    r = decode_record(data[o : o + n])
                    if not with_payload:
                        r["payload"] = None
                    out.append(r)
                yield pa.RecordBatch.from_pylist(out, schema=_RECORD)
        if opened is not None:
            opened.close()

    return run


def read(folder: str, selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of selected (an index, or part of one) name. Revisits have a null payload."""
    ship(selected.sparkSession)
    ranges = selected.select("file", "offset", "length")
    total = ranges.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]  # tasks by what they read, not by the index's size
    ranges = ranges.repartitionByRange(max(1, -(-total // READ_BYTES)), "file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(tidy(_reader(folder, with_payload)), RECORD)


def payloads(folder: str, index: DataFrame, selected: DataFrame) -> DataFrame:
    """(page_id, url, payload) of the selected records, revisits resolved to the response that they refer to."""
    got = read(folder, selected)
    wanted = selected.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    origin = read(folder, index.where("record_type = 'response'").join(wanted, ["page_id", "payload_digest"], "left_semi"))
    origin = origin.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("other")).dropDuplicates(["refers_to", "payload_digest"])
    return got.join(origin, ["refers_to", "payload_digest"], "left").select("page_id", "url", F.coalesce("payload", "other").alias("payload"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archives of all pages."""
    folder = fresh_path(pages.sparkSession, "warc")
    index = write(pages, folder, least_bytes)
    return read(folder, index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")



