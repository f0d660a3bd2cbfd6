"""WARC archives as a chunked record table.

`records(pages)` cuts every payload once into chunk rows (record, chunk number, at most `chunk_bytes` bytes), carrying the
record's SHA-1 from chunk to chunk, so that the last chunk states digest and size; equal payloads of a stated size become
revisits of the record with the largest identifier.  `write(chunks, path)` writes WARC/1.1 files (a segment
record per chunk, continuations for all but the first, and a warcinfo record) through Spark's text writer;
`read(spark, path)` finds records by their version line and Content-Length and gives the chunk table back, and
`payloads(chunks)` carries digest and length over each record's segments in order, so no record is held
whole but as the input row that it comes from.

Files are compressed with gzip, a stream a file, as Spark's writer does it; the reader also takes archives with a stream
a record, and other writers' headers (page_id is then null).  Blocks are read as UTF-8.

Defined results: a null payload is an empty one; null identifiers are written and read back as null
(each row is still a record of its own); repeated rows are records of their own, the one of the largest row number being the
response; payloads may hold version lines and line ends; an empty table gives an archive of the warcinfo record alone and
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import keep, new_path

_END = "\r\n"
_VERSION = f"WARC/1.1{_END}"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("sha1", pa.string()), ("size", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _cut(chunk_bytes: int):
    """Chunk rows of a stream of pages; digest and size are on each record's last one."""
    chunk_bytes = max(4, chunk_bytes)  # a character at least

    def run(batches):
        for batch in batches:
            payloads = batch.column("html").cast(pa.large_binary())
            out, held = [], 0
            for row, page_id, url, payload in zip(*(batch.column(c).to_pylist() for c in ("row", "page_id", "url")), payloads, strict=True):
                buffer = payload.as_buffer()
                data = memoryview(buffer) if buffer is not None else memoryview(b"")
                digest, at, chunk, size = hashlib.sha1(), 0, 0, len(data)
                while True:
                    end = min(at + chunk_bytes, size)
                    while at < end < size and data[end] & 0xC0 == 0x80:  # not inside a character
                        end -= 1
                    digest.update(data[at:end])
                    last = end >= size
                    out.append((row, page_id, url, chunk, last, str(data[at:end], "utf-8", "replace"), digest.hexdigest() if last else None, size if last else None))
                    held += end - at
                    if held > 4 << 20:
                        yield _batch(out, _CHUNK)
                        out, held = [], 0
                    if last:
                        break
                    at, chunk = end, chunk + 1
            yield _batch(out, _CHUNK)

    return run


def revisits(marked: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """row, refers_to, refers_row for the records whose payload another record of a larger page_id (ties: larger row) holds.

    Payloads are grouped by digest and size alone; the groups of one are dropped before anything is joined.
    """
    slim = marked.where(F.col("size") >= least_bytes).select("sha1", "size", F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), "row", "page_id")
    groups = slim.groupBy("sha1", "size").agg(F.max(F.struct("id", "row", "page_id")).alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = slim.join(keep(groups, "groups").hint("merge"), ["sha1", "size"]).where(F.col("row") != F.col("response.row"))
    return found.select("row", F.col("response.page_id").alias("refers_to"), F.col("response.row").alias("refers_row"))


def records(pages: DataFrame, least_bytes: int = 1000, chunk_bytes: int = 8192, most_broadcast: int = 1_000_000) -> DataFrame:
    """The chunk table: row, page_id, url, record_type, refers_to, refers_row, chunk, last, text; sha1 and size on last chunks."""
    slim = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    rows = slim.withColumn("row", F.monotonically_increasing_id())
    kind = "row long, page_id long, url string, chunk int, last boolean, text string, sha1 string, size long"
    chunks = keep(rows.mapInArrow(_cut(chunk_bytes), kind), "chunks")
    found = keep(revisits(chunks.where("last"), least_bytes), "revisits")
    found = F.broadcast(found) if found.count() <= most_broadcast else found.hint("merge")
    joined = chunks.join(found, "row", "left")
    revisit = F.col("refers_row").isNotNull()
    return joined.where(~revisit | F.col("last")).select(
        "row", "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "refers_to", "refers_row",
        F.when(revisit, 0).otherwise(F.col("chunk")).alias("chunk"), "last", F.when(revisit, "").otherwise(F.col("text")).alias("text"), "sha1", "size",
    )


def _record_id(row: str, chunk):
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("/", row, chunk)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def write(chunks: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write gzip-compressed WARC files of a record per chunk, and one of the warcinfo record."""
    first, segmented = F.col("chunk") == 0, ~((F.col("chunk") == 0) & F.col("last"))
    revisit = F.col("record_type") == "revisit"
    headers = [
        F.concat(F.lit("WARC-Type: "), F.when(first, F.col("record_type")).otherwise("continuation")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id("row", "chunk")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), F.sha1(F.col("text").cast("binary"))),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id("refers_row", F.lit(0)))),
        F.when(segmented, F.concat(F.lit("WARC-Segment-Number: "), F.col("chunk") + 1)),
        F.when(~first, F.concat(F.lit("WARC-Segment-Origin-ID: "), _record_id("row", F.lit(0)))),
        F.when(segmented & F.col("last"), F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("size"))),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id")),
        F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to")),
        F.when(revisit, F.concat(F.lit("X-Payload-Length: "), F.col("size"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length("text")),
    ]
    record = F.concat(F.lit(_VERSION), F.concat_ws(_END, *headers), F.lit(_END * 2), F.col("text"), F.lit(_END))
    block = f"format: WARC File Format 1.1{_END}"
    info = _END.join(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{hashlib.md5(path.encode()).hexdigest()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"])
    about = chunks.sparkSession.range(1).select(F.lit(f"{_VERSION}{info}{_END * 2}{block}{_END}").alias("value"))
    chunks.select(record.alias("value")).unionAll(about).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", 100_000).text(path)


_READ = pa.schema(
    [("record", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()), ("segment", pa.int32()), ("segmented", pa.bool_()), ("text", pa.string())]
)


def _parse(batches):
    """Records of a stream of what stands between version lines, file by file: one that is shorter than its Content-Length goes on behind the next line."""
    held, held_file = "", None

    def record(part: str) -> tuple | None:
        """The columns of a whole record; None if its block goes on."""
        head, _, rest = part.partition(_END * 2)
        named = {}
        for line in head.split(_END):
            name, colon, value = line.partition(":")
            if colon:
                named[name.strip().lower()] = value.strip()
        size = int(named.get("content-length", 0))
        data = rest.encode()
        if len(data) < size:
            return None
        number = lambda name: int(named[name]) if named.get(name, "").lstrip("-").isdigit() else None
        kind = named.get("warc-type", "")
        digest = named.get("warc-payload-digest", "")
        stated = number("x-payload-length") if kind == "revisit" else number("warc-segment-total-length")
        return (
            named.get("warc-segment-origin-id") or named.get("warc-record-id"), number("x-page-id"), named.get("warc-target-uri"), kind, number("x-refers-to-page-id"),
            digest[5:] if digest.startswith("sha1:") else None, stated, number("warc-segment-number") or 1, "warc-segment-number" in named, data[:size].decode("utf-8", "replace"),
        )

    for batch in batches:
        rows, size = [], 0
        for file, part in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if file != held_file:
                held, held_file = "", file
            whole = f"{held}{_VERSION}{part}" if held else part
            if not whole:
                continue
            found = record(whole)
            held = whole if found is None else ""
            if found is not None and found[3] in ("response", "resource", "revisit", "continuation"):
                rows.append(found)
                size += len(found[-1])
            if size > 4 << 20:
                yield _batch(rows, _READ)
                rows, size = [], 0
        yield _batch(rows, _READ)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives under a path: responses, resources, revisits and their continuations."""
    parts = spark.read.option("lineSep", _VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    kind = "record string, page_id long, url string, record_type string, refers_to long, stated_digest string, stated_bytes long, segment int, segmented boolean, text string"
    return parts.mapInArrow(_parse, kind)


_PAYLOAD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _carry(batches):
    """Payloads of a stream of segments sorted by record and segment number."""
    now = None
    for batch in batches:
        rows = []
        for record, page, kind, refers, text in zip(*(batch.column(c).to_pylist() for c in ("record", "page_id", "record_type", "refers_to", "text")), strict=True):
            if now is None or now[0] != record:
                if now:
                    rows.append((now[1], now[4], now[5].hexdigest(), now[2], now[3]))
                now = [record, page, kind, refers, 0, hashlib.sha1()]
            data = text.encode()
            now[4] += len(data)
            now[5].update(data)
        yield _batch(rows, _PAYLOAD)
    if now:
        yield _batch([(now[1], now[4], now[5].hexdigest(), now[2], now[3])], _PAYLOAD)


def payloads(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: digests recomputed from what was read.

    A revisit has no payload of its own; it gives the digest and size that its header states.
    """
    columns = [f.name for f in _PAYLOAD]
    stated = F.col("record_type") == "revisit"
    whole = chunks.where(~F.col("segmented")).select(
        "page_id", F.when(stated, F.col("stated_bytes")).otherwise(F.octet_length("text").cast("long")).alias("payload_bytes"),
        F.when(stated, F.col("stated_digest")).otherwise(F.sha1(F.col("text").cast("binary"))).alias("payload_digest"), "record_type", "refers_to",
    )
    parts = chunks.where("segmented").select("record", "page_id", "record_type", "refers_to", "segment", "text")
    long = parts.repartition("record").sortWithinPartitions("record", "segment")
    return whole.unionAll(long.mapInArrow(_carry, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long").select(*columns))


def round_trip(pages: DataFrame, least_bytes: int = 1000, path: str | None = None, chunk_bytes: int = 8192) -> DataFrame:
    """Write the archives of all pages, read them back and return what each record holds."""
    path = path or new_path(pages.sparkSession, "warc")
    write(records(pages, least_bytes, chunk_bytes), path)
    return payloads(keep(read(pages.sparkSession, path), "read"))
