"""A content-addressed WARC archive.

Payload bytes are stored once under a strong digest (SHA-256, verified on reading); the
exact header bytes of each record are stored apart with the digest they refer to.  The
original records come back through a join.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import lookup_skewed, materialize

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TAIL = b"\r\n\r\n"
_URN = "urn:tessella:page:"


def payload_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_head(page_id: int | None, url: str | None, n_bytes: int, sha1: str, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """All bytes of a record before its payload: WARC header, then HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    uri = "".join(c if c >= " " else f"%{ord(c):02X}" for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if is_revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    length = len(http) + (0 if is_revisit else n_bytes)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode() + http


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != TAIL:
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield fields, data[start:stop]
        at = stop + 4


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(_URN)
    return int(number) if number.lstrip("-").isdigit() else None


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write ``path``/payloads and ``path``/headers.

    Of equal payloads of ``min_bytes`` or more the row with the largest id is a response
    and the others revisit it; smaller payloads are all responses.  A null body is an empty
    payload.  Rows that repeat the largest id are responses alike; a null id comes before
    all ids.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(map(len, bodies), pa.int64()), pa.array([hashlib.sha256(x).digest() for x in bodies], pa.binary()), pa.array(map(payload_sha1, bodies), pa.string())],
                names=["page_id", "url", "n_bytes", "digest", "sha1"],
            )

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            revisit = [r["is_revisit"] for r in rows]
            made = [record_head(r["page_id"], r["url"], r["n_bytes"], r["sha1"], r["best"], r["is_revisit"], date) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("digest")), pa.array(revisit, pa.bool_()), pa.array(made, pa.binary())], names=["digest", "is_revisit", "head"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(body_col).alias("html"))
    facts = materialize(rows.mapInArrow(digests, "page_id long, url string, n_bytes long, digest binary, sha1 string"), "warc-facts")
    groups = materialize(facts.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("uses")), "warc-groups")
    judged = lookup_skewed(facts, groups, ["digest"], "uses")
    revisits = (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("best"))
    headers = judged.withColumn("is_revisit", revisits).mapInArrow(heads, "digest binary, is_revisit boolean, head binary")
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")

    # one row for each payload: copies are dropped before the shuffle, and again behind it
    body = F.coalesce("html", F.lit("")).cast("binary")
    payloads = rows.select(F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"), F.count("*").alias("uses"))
    payloads.select("digest", F.octet_length("payload").cast("long").alias("n_bytes"), "uses", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, digest, n_bytes): the original bytes of every record, header through tail.

    A payload whose bytes don't have the digest that it is stored under fails the job.
    """
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    proven = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    whole = headers.where("not is_revisit").join(payloads.select("digest", "n_bytes", proven.alias("payload")), "digest")
    responses = whole.select(F.concat("head", "payload", F.lit(TAIL)).alias("record"), "digest", "n_bytes")
    # a revisit record has no payload of its own; it needs the length alone
    short = lookup_skewed(headers.where("is_revisit"), payloads.select("digest", "n_bytes", "uses"), ["digest"], "uses")
    return responses.unionByName(short.select(F.concat("head", F.lit(TAIL)).alias("record"), "digest", "n_bytes"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for record, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ((fields, block),) = parse_records(record)
                kind, sha1 = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    n, found = len(payload), payload_sha1(payload)
                    if found != sha1:
                        raise ValueError(f"{fields['warc-record-id']}: its payload has digest {found}, its header says {sha1}")
                out.append((_page(fields["warc-record-id"]), n, sha1, kind, _page(fields.get("warc-refers-to"))))
            columns = [*zip(*out, strict=True)] or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read_records(spark, path).select("record", "n_bytes").mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_type, record_id, target_uri, block) of each record of .warc and .warc.gz files."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = [{"path": name, "record_type": f.get("warc-type"), "record_id": f.get("warc-record-id"), "target_uri": f.get("warc-target-uri"), "block": block} for f, block in parse_records(data)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("block", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(records, "path string, record_type string, record_id string, target_uri string, block binary")
