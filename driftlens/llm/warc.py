"""WARC archives: written and read by Spark, and assembled into one nested row per capture.

Each page gives a request, a response or revisit, and a metadata record. Spark's text writer writes them, with the
records' two line ends as its line separator and gzip around a file, so files are committed by task and lie wherever
Spark can write. Spark's text reader reads them by the same separator as a stream, which Content-Length cuts into records,
so that neither a file's size nor its number of records matters, and one record at a time is held.

Of pages with equal payloads the one with the largest id is the response; the others are revisits that refer to it and
hold no payload. Rows that share the largest id are all responses, and the last of them is referred to. A record's id is
made of the page's id and its row, so that repeated and null ids have records of their own. Rows are numbered by place, so
pages must come from a source that gives the same rows in the same order when read again, such as files.

A null payload counts as empty, a null url as an empty one; null ids are responses only where all ids are null. Extra
columns are ignored. An empty table gives archives without records and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import checkpointed, looked_up

END = "\r\n\r\n"
#: Records of a file at most, so that several tasks read them.
FILE_RECORDS = 30_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, made from its 40 hex digits, five of them at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substr(digest, F.lit(i), F.lit(5)), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """row, id, url, payload, n_bytes, digest, refers_to and refers_row (null for responses). Payloads below least_bytes are never revisits."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    largest = checkpointed(rows.groupBy("same").agg(F.max(F.struct("id", "row")).alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "largest"))
    rows = looked_up(rows, largest, "same")
    revisits = F.col("largest").isNotNull() & (F.length("payload") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("largest.id"))
    return rows.select("row", "id", "url", "payload", F.length("payload").alias("n_bytes"), base32_sha1(F.col("payload")).alias("digest"), F.when(revisits, F.col("largest.id")).alias("refers_to"), F.when(revisits, F.col("largest.row")).alias("refers_row"))


def _record(kind: Column | str, record_id: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record; fields that are null are left out."""
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), record_id]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")))
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", **columns: str) -> None:
    """Archives of pages under path, three records a page."""
    rows = with_roles(pages, **columns)
    page = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    rows = rows.withColumn("first", F.col("refers_row").isNull())
    urn = lambda i, row, *x: F.concat(F.lit("<urn:page:"), i.cast("string"), F.lit(":"), row.cast("string"), *x, F.lit(">"))
    main = urn(page, F.col("row"))
    shared = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20"))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    answer = _record(F.when(F.col("first"), "response").otherwise("revisit"), main, [
        *shared, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", F.when(~F.col("first"), urn(F.coalesce(F.col("refers_to").cast("string"), F.lit("null")), F.col("refers_row")))),
        ("WARC-Profile", F.when(~F.col("first"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.lit("application/http;msgtype=response")),
    ], F.when(F.col("first"), F.concat(http, F.col("payload").cast("string"))).otherwise(http))
    request = _record("request", urn(page, F.col("row"), F.lit(":request")), [*shared, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http;msgtype=request"))], F.lit(f"GET / HTTP/1.1{END}"))
    metadata = _record("metadata", urn(page, F.col("row"), F.lit(":metadata")), [*shared, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))],
                       F.concat(F.lit("page: "), page, F.lit("\r\npayloadLength: "), F.col("n_bytes").cast("string"), F.lit("\r\n")))
    records = rows.select(F.explode(F.array(request, answer, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


RECORDS = "type string, record_id string, concurrent_to string, refers_to string, uri string, payload_bytes long, payload_digest string, fields string, payload binary"


def parse(pieces: Iterator[bytes], payloads: bool = True) -> Iterator[dict]:
    """Records of an archive's plain bytes, which come in pieces, in order."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        start = 0
        while (at := held.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("an archive ends within a record's headers")
                return
        head = bytes(held[:at]).decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {head[0][:40]!r}")
        h = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        n = int(h["content-length"])
        if not fill(at + 4 + n):
            raise ValueError("an archive ends within a record's block")
        block = bytes(held[at + 4 : at + 4 + n])
        fill(at + 8 + n)
        del held[: at + 8 + n]
        out = {"type": h["warc-type"], "record_id": h["warc-record-id"], "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "uri": h.get("warc-target-uri"),
               "payload_bytes": None, "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "fields": None, "payload": None}
        if out["type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            out |= {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload": payload if payloads else None}
        elif out["type"] == "metadata":
            out["fields"] = block.decode("utf-8", "replace")
        yield out


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under path, whose file names end in .gz if they are compressed. Of a response, payload_bytes and payload_digest are those of the payload that was read."""
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = END.encode()
        pieces = ((name.as_py(), piece.as_py()) for b in batches for name, piece in zip(b.column(0), b.column(1), strict=True))
        for _, of_file in groupby(pieces, key=lambda p: p[0]):
            rows, size = [], 0
            # The separator goes between pieces: whether it also ends the file is not known, and does not matter.
            plain = (x for k, (_, piece) in enumerate(of_file) for x in ((ends, piece) if k else (piece,)))
            for r in parse(plain, payloads):
                rows.append(r)
                size += len(r["payload"] or b"")
                if len(rows) >= 5000 or size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    lines = spark.read.option("lineSep", END).text(path)
    return lines.select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One row per response or revisit: the record, its requests and its metadata records, joined through concurrent-to."""
    names = [f.name for f in records.schema.fields]
    whole = F.struct(*names)
    key = F.coalesce("concurrent_to", "record_id")
    of = lambda *t: F.collect_list(F.when(F.col("type").isin(*t), whole))
    per = records.groupBy(key.alias("capture")).agg(of("response", "revisit").alias("answers"), of("request").alias("requests"), of("metadata").alias("metadata"))
    return per.select("capture", F.explode("answers").alias("answer"), "requests", "metadata")
