"""WARC archives: written from captures, read back and assembled into transactions.

Writing: each row becomes a request, a response or revisit, and a metadata
record. Payloads that occur again are stored once: of equal payloads the row
with the largest id is the response, the others are revisits that refer to it.
Records go through Spark's text writer with a blank line as the line end, which
is a WARC record's end, so archives are committed task by task in any file
system Spark can write, and a lost executor's part is written again. Parts are
compressed whole.

Reading: archives are read as binary files of a bounded size (FILE_BYTES of
payload, about), cut by Content-Length, digests recomputed from the payloads.
Request and metadata records name the response they are concurrent to; a join
over that identifier emits one nested row per capture.

Defined cases: a null payload is empty; rows without an id are the smallest;
rows with equal id and payload are all responses if theirs is the largest id,
and each is a capture; a null url has no target header and is read back as
null; control characters of urls are percent-encoded; other columns play no
part; an empty table gives an archive without records and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.llm.text import materialize, prepare, rows_of, total_bytes
from rankfold.session import scratch_path

#: Payload bytes in an archive file, about.
FILE_BYTES = 16 << 20
#: Files at least over which the copies of one payload are spread.
SALTS = 32

_CRLF = "\r\n"


def base32_sha1(value: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 bits at a time in base 32, with the RFC's letters."""
    digits = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str | Column, rid: Column, body: Column, headers: list[tuple[str, Column]]) -> Column:
    """A record without its end: headers, blank line, block. Headers that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [F.lit("WARC/1.1" + _CRLF), F.lit("WARC-Type: "), kind, F.lit(_CRLF + "WARC-Record-ID: <"), rid,
            F.lit(">" + _CRLF + "WARC-Date: 2024-01-01T00:00:00Z" + _CRLF)]
    for name, value in headers:
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit("")))
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(_CRLF + _CRLF), body)


def write_archives(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> str:
    """Writes the archives to the shared folder and returns their path.
    Payloads of fewer than ``least`` bytes are not deduplicated."""
    spark = pages.sparkSession
    files = max(1, -(-total_bytes(pages, html) // FILE_BYTES))
    p = rows_of(pages, id_col, url, html).toDF("id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    p = p.select("id", "url", "html", base32_sha1(F.col("html")).alias("digest"), F.octet_length("html").alias("bytes"))
    # payloads move once: dealt by digest and salt, so that a payload that very many rows share fills many files
    files = max(int(files), int(spark.conf.get("spark.sql.shuffle.partitions")))
    salts = min(files, SALTS)
    largest = p.groupBy("digest").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    largest = materialize(largest.select("digest", "top", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    p = p.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int")).repartition(files, "digest", "salt")
    p = p.join(largest, ["digest", "salt"], "left")
    revisit = (F.col("bytes") >= least) & F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))
    page = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    unique = F.concat(F.lit("urn:capture:"), page, F.lit(":"), F.monotonically_increasing_id().cast("string"), F.lit(":"))
    p = p.select("*", unique.alias("rid"), revisit.alias("revisit"))
    target = ("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    status = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
                      F.col("bytes").cast("string"), F.lit(_CRLF + _CRLF))
    refers = F.when(F.col("revisit"), F.concat(F.lit("<urn:page:"), F.col("top").cast("string"), F.lit(">")))
    profile = F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    to = ("WARC-Concurrent-To", F.concat(F.lit("<"), F.col("rid"), F.lit("response>")))
    records = F.array(
        _record("request", F.concat("rid", F.lit("request")), F.lit(f"GET / HTTP/1.1{_CRLF}User-Agent: archive{_CRLF}{_CRLF}"),
                [target, to, ("Content-Type", F.lit("application/http; msgtype=request"))]),
        _record(F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), F.concat("rid", F.lit("response")),
                F.concat(status, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))),
                [target, digest, ("WARC-Refers-To", refers), ("WARC-Profile", profile),
                 ("Content-Type", F.lit("application/http; msgtype=response"))]),
        _record("metadata", F.concat("rid", F.lit("metadata")),
                F.concat(F.lit("page: "), page, F.lit(_CRLF + "payload-bytes: "), F.col("bytes").cast("string"), F.lit(_CRLF)),
                [target, to, ("Content-Type", F.lit("application/warc-fields"))]))
    at = scratch_path(spark, "warc")
    p.select(F.explode(records).alias("value")).write.option("lineSep", _CRLF * 2).option("compression", "gzip").text(at)
    return at


def records_of(content: bytes):
    """(headers, block) of every record of an archive, cut by Content-Length."""
    at = 0
    while at < len(content):
        cut = content.index(b"\r\n\r\n", at)
        lines = content[at:cut].decode("utf-8").split(_CRLF)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        end = cut + 4 + int(headers["Content-Length"])
        yield headers, content[cut + 4 : end]
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has no end")
        at = end + 4


_ROW = T.StructType([T.StructField(c, T.StringType()) for c in (
    "kind", "record_id", "concurrent_to", "target", "digest", "refers_to", "page", "payload")] + [T.StructField("payload_bytes", T.LongType())])


def _parse(with_payload: bool):
    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                content = content.as_py()
                if content[:2] == b"\x1f\x8b":
                    content = gzip.decompress(content)
                out = []
                for headers, block in records_of(content):
                    kind = headers["WARC-Type"]
                    row = {"kind": "response" if kind == "revisit" else kind, "record_id": headers["WARC-Record-ID"],
                           "concurrent_to": headers.get("WARC-Concurrent-To"), "target": headers.get("WARC-Target-URI"),
                           "refers_to": headers.get("WARC-Refers-To")}
                    if kind in ("response", "revisit"):
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        row["digest"] = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != row["digest"]:
                            raise ValueError(f"payload of {row['record_id']} has another digest")
                        if with_payload and kind == "response":
                            row["payload"] = payload.decode("utf-8")
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().split(_CRLF) if x)
                        row["page"], row["payload_bytes"] = fields["page"], int(fields["payload-bytes"])
                    out.append(row)
                for lo in range(0, len(out), 1000):
                    yield pa.RecordBatch.from_pylist(out[lo : lo + 1000], schema=pa.schema(
                        [(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in _ROW]))
    return run


def read_transactions(spark, path: str, with_payload: bool = False) -> DataFrame:
    """One nested row per capture: page, request, response and metadata. Records
    are joined through the identifier of the response they are concurrent to."""
    prepare(spark)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_parse(with_payload), _ROW)
    rows = rows.withColumn("capture", F.coalesce("concurrent_to", "record_id"))
    of = lambda kind, *cols: F.max(F.when(F.col("kind") == kind, F.struct(*cols))).alias(kind)
    joined = rows.groupBy("capture").agg(
        of("request", "record_id", "target"), of("response", "record_id", "target", "digest", "refers_to", "payload"),
        of("metadata", "record_id", "page", "payload_bytes"))
    return joined.where("response is not null")


__all__ = ["read_transactions", "write_archives"]
