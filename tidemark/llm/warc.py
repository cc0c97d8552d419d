"""WARC archives: writing records and reading them back sequentially.

Each record is a gzip member of its own. The reader walks an archive from its first byte:
members are inflated piece by piece with one zlib stream each, a record is framed by its
Content-Length, and payloads are checked against their digests while they pass. Neither a
member nor a payload needs to be in one read of the file.

Files are opened through pyarrow's file systems, so archives may lie in any store that both
Spark and pyarrow know. Writers make new files in a staged folder; the list of the files that
count is a staged table, so files of attempts that failed are never read.

Defined results: null html is an empty payload. Equal payloads make one response, the record
with the largest page_id (of rows with equal ids, one of them), and revisits that refer to it;
null ids are smaller than all others. Empty tables give no archives and no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import PLACE, bound_batches, placed, staged, staging_path

#: Bytes after which a writer begins another archive; bytes of one read.
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 18
LEAST_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, sha1: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record as a gzip member."""
    # Line breaks in a URL would end the header.
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + member.flush()


@dataclass
class Record:
    headers: dict[str, str]
    length: int = 0
    sha1: str = ""
    payload: bytes | None = None
    problems: list[str] = field(default_factory=list)

    @property
    def type(self) -> str:
        return self.headers.get("warc-type", "")


def members(source, chunk: int = CHUNK) -> Iterator[Iterator[bytes]]:
    """For each gzip member in turn, an iterator of its inflated pieces."""
    rest = source.read(chunk)
    while rest:
        state = {"rest": rest}

        def inflated(state=state):
            stream = zlib.decompressobj(31)
            data = state["rest"]
            while True:
                piece = stream.decompress(data, chunk)
                if piece:
                    yield piece
                if stream.eof:
                    state["rest"] = stream.unused_data or source.read(chunk)
                    return
                data = stream.unconsumed_tail or source.read(chunk)
                if not data:
                    raise EOFError("a gzip member is cut off")

        pieces = inflated()
        yield pieces
        for _ in pieces:  # what the caller left
            pass
        rest = state["rest"]


def records(source, keep_payload: bool = True) -> Iterator[Record]:
    """The records of an archive, framed by Content-Length, with their digests verified."""
    for pieces in members(source):
        head = b""
        for piece in pieces:
            head += piece
            if b"\r\n\r\n" in head:
                break
        top, gap, start = head.partition(b"\r\n\r\n")
        lines = top.decode("utf-8", "surrogatepass").split("\r\n")
        out = Record({k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])})
        if not gap or not lines[0].startswith("WARC/"):
            out.problems.append("no WARC header")
        want = int(out.headers.get("content-length", 0))
        sha1, kept, n, tail = hashlib.sha1(), [], 0, b""
        for piece in _chain(start, pieces):
            body = piece[: want - n]
            sha1.update(body)
            n += len(body)
            if keep_payload:
                kept.append(body)
            tail += piece[len(body) :]
        if n != want or tail != b"\r\n\r\n":
            out.problems.append("Content-Length does not frame the record")
        out.length, out.sha1 = n, base64.b32encode(sha1.digest()).decode()
        out.payload = b"".join(kept) if keep_payload else None
        said = out.headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if out.type != "revisit" and said != out.sha1:
            out.problems.append("digest mismatch")
        yield out


def _chain(first: bytes, rest):
    if first:
        yield first
    yield from rest


def decide(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """`pages` (page_id, url, html) with sha1, refers_to and revisit."""
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    pages = placed(pages.select("page_id", "url", "html"))
    pages = pages.select("page_id", "url", "html", F.struct(*PLACE).alias("row"), F.sha1(body).alias("sha1"), F.octet_length(body).alias("bytes"))
    groups = pages.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "row")).alias("top"))
    # Staged, so that the join below reads two plain tables and can be split at a hot payload.
    groups = staged(groups.where("n > 1").select("sha1", "top"), "payloads")
    joined = pages.join(groups, "sha1", "left")
    revisit = F.col("top").isNotNull() & (F.col("bytes") >= least_bytes) & (F.col("top.row") != F.col("row"))
    return joined.select("page_id", "url", "html", "sha1", F.when(revisit, F.col("top.page_id")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all rows of `pages`; returns the staged list (archive, n_records)."""
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or staging_path(spark, "warc")

    def run(batches):
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, n, size = None, None, 0, 0
        for batch in batches:
            for page_id, url, html, sha1, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                member = record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, revisit)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n]})

    listed = decide(pages, least_bytes).mapInArrow(run, "archive string, n_records long")
    return staged(listed.withColumn("archive", F.concat(F.lit(folder + "/"), "archive")), "archives")


def read_archives(archives: DataFrame, id_type: str = "bigint", keep_payload: bool = False) -> DataFrame:
    """Every record of the archives in column `archive`: (page_id, url, record_type,
    payload_bytes, payload_digest, refers_to, payload, problem)."""

    def number(urn: str | None):
        own = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return own or None

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(archive)
                with store.open_input_stream(path, compression=None) as source:
                    rows: list[tuple] = []
                    held = 0
                    for r in records(source, keep_payload):
                        h = r.headers
                        revisit = r.type == "revisit"
                        rows.append((number(h.get("warc-record-id")), h.get("warc-target-uri"), r.type, int(h.get("payload-length", r.length)) if revisit else r.length, h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else r.sha1, number(h.get("warc-refers-to")) if revisit else None, r.payload, "; ".join(r.problems) or None))
                        held += 1 + len(r.payload or b"") // 1000
                        if held >= 5000:
                            yield table(rows)
                            rows, held = [], 0
                    if rows:
                        yield table(rows)

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "problem"]
    types = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    # A task for each archive: ranges of distinct names hold one each, and Spark joins none of them again.
    many = max(1, archives.count())
    out = archives.select("archive").repartitionByRange(many, "archive").mapInArrow(run, "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary, problem string")
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """All rows of `pages` written to archives and read back; a record that fails its checks ends the query."""
    back = read_archives(write_archives(pages), dict(pages.dtypes)["page_id"])
    ok = F.when(F.col("problem").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("WARC record "), F.col("page_id").cast("string"), F.lit(": "), "problem")))
    return back.withColumn("payload_digest", ok)
