"""WARC archives with revisit resolution."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, key_filter, with_maybe

#: Revisits that are broadcast, at most: some 10 MB.
SMALL = 100_000
#: RFC 4648 base32.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Between the records of a file, after the payload.
GAP = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string's UTF-8: 160 bits as 4 numbers of 8 digits."""
    hexes = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexes, i + 1, 10), 16, 32), 8, "0") for i in range(0, 40, 10)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def record_uri(page: Column) -> Column:
    """A stable record id: a version-8 UUID from the digest of the page's id."""
    h = F.md5(F.concat(F.lit("page:"), page.cast("string")))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def resolve_revisits(heads: DataFrame, least: int = 0) -> DataFrame:
    """heads (page_id, payload_bytes, payload_digest, second) with record_type and refers_to.

    Only headers are shuffled by digest: the smallest page_id of each (digest, length, second digest) of at
    least `least` bytes is its response, the others refer to it; a null page_id is larger than all others. Rows repeated with
    the smallest page_id are all responses, as are those of a payload that only null page_ids have. The minimum is taken before
    the shuffle, and the join back is one whose skewed keys Spark can split.
    """
    key = ["payload_digest", "payload_bytes", "second"]
    first = heads.where(F.col("payload_bytes") >= least).groupBy(*key).agg(F.min("page_id").alias("first"))
    seen = heads.join(first, key, "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return seen.select("page_id", *key, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One WARC record, header and block, for each page (column `value`), revisits resolved, with the `size` of its payload.

    A response carries its payload; a revisit has fresh headers, an empty block and points to the
    response of the same payload: equal in length, SHA-1 and XXH64. Null payloads are empty ones, null urls the empty target.
    Rows repeated with one id and payload are records of one type. Extra columns are not read; an empty table gives none.

    Payloads don't move but for those of rows that a filter of bounded size takes for revisits. Revisits, as (page_id, digest)
    alone, are broadcast where they are few (SMALL).
    """
    scratch = Scratch(pages.sparkSession, "warc")
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    base = base.withColumn("size", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    second = F.xxhash64("payload")
    heads = base.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", second.alias("second"))
    moved = resolve_revisits(heads, least).where("record_type = 'revisit'").select("page_id", "payload_digest", "second", "refers_to").distinct()
    moved = scratch.save(moved.withColumn("h", F.xxhash64("page_id", "payload_digest", "second")))
    rows = base.withColumn("second", second).withColumn("h", F.xxhash64("page_id", "payload_digest", "second"))
    same = (F.col("h") == F.col("_h")) & F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("second") == F.col("_second"))
    known = moved.select(F.col("h").alias("_h"), F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("second").alias("_second"), "refers_to")
    columns = ["page_id", "url", "payload", "size", "payload_digest", "refers_to"]
    if moved.limit(SMALL + 1).count() <= SMALL:
        rows = rows.join(F.broadcast(known), same, "left").select(*columns)
    else:
        rows = with_maybe(rows, F.col("h"), scratch.save(key_filter(moved.select("h"))), "maybe")
        some = rows.where("maybe").join(known, same, "left").select(*columns)
        rows = some.unionByName(rows.where("not maybe").withColumn("refers_to", F.lit(None).cast(moved.schema["refers_to"].dataType)).select(*columns))
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, "").otherwise(F.col("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_uri(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<"), record_uri(F.col("refers_to")), F.lit(">"))), line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, body).alias("value"), "size")


def write_archives(rows: DataFrame, path: str, max_records: int = 2000, max_bytes: int = 128 << 20) -> None:
    """Writes records (value, size) as gzipped WARC files, in folders `class=k` below path.

    A file has at most max_records records, and at most about max_bytes of payload: records are put in classes by size,
    each of which has so many records a file as its largest size allows; a record over max_bytes is a file of its own.
    Rows stay in their tasks. The text writer puts the two line ends that close a record after each row, so a part
    file is an archive as it stands, on whatever store Spark writes to. An empty table writes no record.
    """
    largest = rows.agg(F.max("size")).first()[0] or 0
    least, limit, k = -1, max(1, max_bytes // max_records), 0
    while True:
        some = rows.where((F.col("size") > least) & (F.col("size") <= limit))
        some.select("value").write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", max(1, max_bytes // limit)).text(f"{path}/class={k}")
        if limit >= largest:
            return
        least, limit, k = limit, limit * 16, k + 1


def _parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """Records of an archive that comes in pieces; holds one record at a time."""
    held, at = bytearray(), 0
    ended = False
    chunks = iter(chunks)

    def more() -> bool:
        nonlocal ended
        piece = next(chunks, None)
        if piece is None:
            ended = True
            return False
        held.extend(piece)
        return True

    while True:
        while (stop := held.find(b"\r\n\r\n", at)) < 0 and more():
            pass
        if stop < 0:
            if bytes(held[at:]).strip():
                raise ValueError("an archive ends within a header")
            return
        lines = bytes(held[at:stop]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        begin = stop + 4
        while len(held) < begin + size + 4 and more():
            pass
        if len(held) < begin + size + 4:
            raise ValueError("an archive ends within a record")
        yield head, bytes(held[begin : begin + size])
        del held[: begin + size + 4]
        at = 0


def _inflate(data: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """Gzip members, one after another, a megabyte at a time."""
    engine, at = zlib.decompressobj(31), 0
    while at < len(data):
        piece = bytes(data[at : at + step])
        at += len(piece)
        while piece:
            out = engine.decompress(piece, 4 * step)
            if out:
                yield out
            if engine.eof:
                piece, engine = engine.unused_data, zlib.decompressobj(31)
            else:
                piece = engine.unconsumed_tail


_SCHEMA = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for content in batch.column(0):
            for head, payload in _parse(_inflate(memoryview(content.as_buffer()))):
                page, to = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                out.append((page and int(page), head["WARC-Type"], head.get("WARC-Target-URI"), head["WARC-Payload-Digest"].removeprefix("sha1:"), to and int(to), payload))
                held += len(payload) + 200
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                    out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzipped archives below path: page_id, record_type, url, payload_digest, refers_to, payload.

    Files are read by Spark, whole (they are bounded when written), inflated a megabyte at a
    time and parsed by their headers' lengths.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(_read, "page_id long, record_type string, url string, payload_digest string, refers_to long, payload binary")
