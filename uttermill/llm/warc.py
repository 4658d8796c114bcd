"""WARC archives: written whole-file compressed, then normalised.

``write_pages`` writes one record a page through Spark's text writer with gzip
compression, so that an archive is one gzip stream (the form that random
access cannot use). ``normalise`` inflates each archive once, as a stream,
rewrites every record as a gzip member of its own and writes a sidecar index
of member offsets. ``read_archives`` reads records back by their offsets and
checks the payload digests.

Of records with equal payloads of at least ``min_bytes`` bytes the smallest
page id is a response, the others are revisits of it; shorter ones are all
responses. A null payload is empty; a null or unprintable URL is written
percent-encoded (null: no target line); rows repeated with one page id are
written once each, responses if that id is the smallest (null ids are
larger than any); an empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..session import broadcast_if_small, scratch_path
from .common import AtomicFile, open_input, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20
ARCHIVES = "path string, index string, n_records long, n_bytes long"
RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, url string, offset long, length long")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return "<urn:page:none>" if page_id is None or pd.isna(page_id) else f"<urn:page:{int(page_id)}>"


def record(page_id, url, payload: str, refers_to, revisit: bool) -> str:
    """One WARC record as text, without the newline that ends it."""
    body = payload.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    block = len(http) + (0 if revisit else len(body))
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(body)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head) + "\r\n\r\n" + http + ("" if revisit else payload) + "\r\n\r"


@pandas_udf(T.StringType())
def _record(page_id: pd.Series, url: pd.Series, payload: pd.Series, first: pd.Series, revisit: pd.Series) -> pd.Series:
    return pd.Series([record(*x) for x in zip(page_id.astype("object"), url, payload, first.astype("object"), revisit)],
                     dtype="object")


def write_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html",
                min_bytes: int = 0) -> str:
    """Folder of whole-file compressed archives of all rows, in page order."""
    key = F.coalesce("page_id", F.lit(2**63 - 1))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"),
                        F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("payload")).withColumn("key", key)
    sha1 = F.sha1(F.col("payload").cast("binary"))  # a string's bytes are its UTF-8
    narrow = written(rows.where(F.octet_length("payload") >= min_bytes).select("key", sha1.alias("sha1")),
                     "warc-digests")  # payloads are read once for both uses
    first = narrow.groupBy("sha1").agg(F.min("key").alias("first"))  # map-side first: a hot payload is a row a task
    again = written(narrow.join(first, "sha1").where(F.col("key") != F.col("first")).distinct(), "warc-revisits")
    small = broadcast_if_small(again)  # then payloads move once, not twice
    if small is not again:  # the sample for the ranges needs no digest
        joined = rows.repartitionByRange("key").withColumn("sha1", sha1).join(small, ["key", "sha1"], "left")
    else:
        joined = rows.withColumn("sha1", sha1).join(again, ["key", "sha1"], "left").repartitionByRange("key")
    revisit = F.col("first").isNotNull()
    folder = scratch_path(pages.sparkSession, "warc-whole")
    (joined.sortWithinPartitions("key", "sha1")
     .select(_record("page_id", "url", "payload", "first", revisit).alias("value"))
     .write.option("compression", "gzip").option("lineSep", "\n").text(folder))
    return folder


# --- streams ----------------------------------------------------------------

def inflated(stream):
    """The bytes of a gzip file of one or more members, in pieces."""
    z = zlib.decompressobj(31)
    while data := stream.read(READ_BYTES):
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
                if not data:
                    break
            else:
                data = b""


def records(pieces):
    """Whole records (headers, block, closing blank lines) of inflated bytes."""
    buf, done = bytearray(), False
    pieces = iter(pieces)

    def more() -> bool:
        for p in pieces:
            if p:
                buf.extend(p)
                return True
        return False

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf.strip():
                    raise ValueError("a record is cut off")
                return
        size = int(re.search(rb"(?im)^content-length: *(\d+)", buf[:end + 2])[1])
        total = end + 4 + size + 4
        while len(buf) < total:
            if not more():
                raise ValueError("a record is cut off")
        yield bytes(buf[:total])
        del buf[:total]


def headers(raw: bytes) -> tuple[dict, bytes]:
    """A record's headers by lower-case name, and its block."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in
              (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}
    return fields, block[:int(fields["content-length"])]


def normalise(folder: str, spark) -> DataFrame:
    """Rewrites the archives of ``folder`` with a gzip member for each record
    (``.warc.gz``) and an index of JSON lines beside each (offset, length, id,
    type); the table of new archives."""
    target = scratch_path(spark, "warc-members")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")

    def task(batches):
        for pdf in batches:
            for path in pdf["path"]:
                name = path.rsplit("/", 1)[1].split(".")[0]
                out, index = AtomicFile(f"{target}/{name}.warc.gz"), AtomicFile(f"{target}/{name}.index")
                n = 0
                with open_input(path) as stream:
                    for raw in records(inflated(stream)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        fields, _ = headers(raw)
                        index.write((json.dumps({"offset": out.size, "length": len(member),
                                                 "id": fields["warc-record-id"], "type": fields["warc-type"]})
                                     + "\n").encode())
                        out.write(member)
                        n += 1
                out.close()
                index.close()
                yield pd.DataFrame({"path": [f"{target}/{name}.warc.gz"], "index": [f"{target}/{name}.index"],
                                    "n_records": [n], "n_bytes": [out.size]})

    return written(files.repartition(max(1, files.count())).mapInPandas(task, ARCHIVES), "warc-archives")


def _number(urn: str | None):
    tail = (urn or "").strip("<>").rsplit(":", 1)[-1]
    return int(tail) if re.fullmatch(r"-?\d+", tail) else None


def read_archives(archives: DataFrame) -> DataFrame:
    """One row a record, read by the offsets of the index: the page, bytes and
    digest of the full payload, the record type and what it refers to. A
    response whose payload has another digest raises ValueError."""
    def task(batches):
        for pdf in batches:
            for path, index in zip(pdf["path"], pdf["index"]):
                rows = []
                with open_input(index) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with open_input(path) as f:
                    for e in entries:
                        f.seek(e["offset"])
                        raw = zlib.decompress(f.read(e["length"]), 31)
                        fields, block = headers(raw)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"{e['id']}: payload and digest differ")
                        size = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
                        rows.append((_number(e["id"]), size, digest, fields["warc-type"],
                                     _number(fields.get("warc-refers-to")), fields.get("warc-target-uri"),
                                     e["offset"], e["length"]))
                        if len(rows) == 10_000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    return archives.repartition(max(1, archives.count())).mapInPandas(task, RECORDS)


def _frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})
