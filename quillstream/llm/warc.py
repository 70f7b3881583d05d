"""WARC archives: records written with segments and revisits, read back and reassembled (op 13).

Writing (``write``): a row's payload becomes the body of an HTTP response in chunked transfer framing. A
block of more than ``SEGMENT_BYTES`` is cut into a first record and ``continuation`` records that name it
as their origin; the last one states the total length. Of equal payloads the row with the smallest id is
the ``response``, the others are ``revisit`` records without a body. Equal payloads are found by the merge
index of op 9, byte verified, so that only rows with copies are shuffled and a payload that a third of all
rows share meets its rows by broadcast. Spark's text writer makes the files: a record ends with the line
separator.

Reading: ``records`` cuts the byte stream of each file by the records' own Content-Length, one record in
memory at a time (gzip files, whole or by member, are read by one task each, others are cut the same way);
``reassemble`` groups segments by origin, orders them by number and verifies that numbers have no gap and
lengths add up to the total; ``captures`` decodes the transfer framing strictly and verifies digests;
``resolve`` gives a revisit the size of what it refers to.

Defined cases: a null payload is the empty one; a null id is written without one, ranks behind all ids and
refers to the smallest id of its payload, where there is one, else it is a response; rows that repeat id and
payload are captures of their own, all of the same type; very long payloads are cut into as many segments
as they need (a reassembled one must fit a cell of 2 GB); an empty table gives no archives and an empty
result; further columns are ignored, whatever their names. A broken record gives a row with its ``fault``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup
from .common import body, table_path

#: Longest block of a record before it is cut into segments; bytes of a transfer chunk; targets with more than this share of all revisits are broadcast.
SEGMENT_BYTES, CHUNK_BYTES, HOT_SHARE = 8_192, 4_096, 10_000
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in upper-case base 32: 5 bytes give 8 signs."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _name(*parts: Column) -> Column:
    """A record's name, made from what it holds, so that a task that runs again writes the same."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _pieces(data: Column, size: int) -> Column:
    """Binary pieces of ``size`` bytes; one empty piece of empty data."""
    last = F.greatest(F.ceil(F.octet_length(data) / size) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: F.substr(data, (i * size + 1).cast("int"), F.lit(size)))


def chunked(data: Column, size: int = CHUNK_BYTES) -> Column:
    """Bytes in chunked transfer framing, as a raw string."""
    parts = F.filter(_pieces(data, size), lambda p: F.octet_length(p) > 0)
    framed = F.transform(parts, lambda p: F.concat(F.lower(F.hex(F.octet_length(p))), F.lit("\r\n"), p.cast("string"), F.lit("\r\n")))
    return F.concat(F.array_join(framed, ""), F.lit("0" + END))


def _header(fields: list[tuple[str, Column | str]], length: Column) -> Column:
    """The head of a record; fields that are null are left out."""
    lines = [F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v.cast("string")) for k, v in [*fields, ("Content-Length", length)]]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit(END))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, segment_bytes: int = SEGMENT_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record (with its continuations) per row under ``path``. Payloads of under ``least`` bytes are never revisits."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), body(f"`{payload_col}`").cast("binary").alias("payload"))
    rows = rows.select("id", F.regexp_replace("url", r"[\x00-\x20\x7f]", "").alias("url"), F.col("payload").cast("string").alias("raw"))
    index = exact_dedup.Index(rows, "id", "raw", keep="smallest")
    probed = index.probed(rows.withColumn("digest", exact_dedup.sha256(F.col("raw"))), "digest", "hit")
    told = index.parted(probed.filter("hit"), "digest", "raw", "first", "copies").select("id", "url", "raw", "first")
    every = probed.filter("not hit").select("id", "url", "raw", F.lit(None).cast("long").alias("first")).unionByName(told)

    data = F.col("raw").cast("binary")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.octet_length("raw") >= least)
    made = every.select("id", "url", "first", again.alias("again"), base32_sha1(data).alias("digest"), F.when(~again, F.concat(F.lit(HTTP), chunked(data))).otherwise("").cast("binary").alias("block"))
    key = lambda c: _name(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col("digest"))
    made = made.select("*", key("id").alias("name"), key("first").alias("target"), F.octet_length("block").alias("total"))
    cut = made.select("id", "url", "again", "digest", "name", "target", "total", F.posexplode(_pieces(F.col("block"), segment_bytes)).alias("at", "part"))

    first, one, last = F.col("at") == 0, F.col("total") <= segment_bytes, (F.col("at") + 1) * segment_bytes >= F.col("total")
    fields = [
        ("WARC-Type", F.when(F.col("again"), "revisit").when(first, "response").otherwise("continuation")),
        ("WARC-Record-ID", F.when(first, F.col("name")).otherwise(_name(F.col("name"), F.col("at").cast("string")))),
        ("WARC-Date", date),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Capture-Key", F.col("id")),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest"))),
        ("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("part")))),
        ("WARC-Profile", F.when(F.col("again"), IDENTICAL)),
        ("WARC-Refers-To", F.when(F.col("again"), F.col("target"))),
        ("WARC-Segment-Number", F.when(~one, F.col("at") + 1)),
        ("WARC-Segment-Origin-ID", F.when(~first, F.col("name"))),
        ("WARC-Segment-Total-Length", F.when(~one & last, F.col("total"))),
        ("Content-Type", F.when(F.col("total") > 0, "application/http; msgtype=response")),
    ]
    record = F.concat(_header(fields, F.octet_length("part")), F.col("part").cast("string"))
    # The level of compression that costs least; the default takes four times as long for a tenth less.
    cut.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


class Cutter:
    """Cuts a byte stream, fed in pieces, into records (head, block, fault) by their Content-Length."""

    def __init__(self):
        self.held, self.wanted = bytearray(), 1

    def feed(self, piece: bytes) -> Iterator[tuple[bytes, bytes, str | None]]:
        self.held += piece
        while len(self.held) >= self.wanted:
            found = self._next()
            if found is None:
                return
            yield found

    def _next(self) -> tuple[bytes, bytes, str | None] | None:
        blank = len(self.held) - len(self.held.lstrip(b"\r\n"))
        del self.held[:blank]
        end = self.held.find(b"\r\n\r\n")
        if end < 0:
            self.wanted = len(self.held) + 1
            return None
        head = bytes(self.held[:end])
        length = re.search(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?=\r\n|$)", head, re.IGNORECASE)
        if not head.startswith(b"WARC/") or not length:
            # Not a record: what stands before the next one is told as broken.
            after = self.held.find(b"\r\n\r\nWARC/", end)
            if after < 0:
                self.wanted = len(self.held) + 1
                return None
            del self.held[: after + 4]
            self.wanted = 1
            return head, b"", "head"
        stop = end + 4 + int(length[1])
        if len(self.held) < stop:
            self.wanted = stop
            return None
        block = bytes(self.held[end + 4 : stop])
        del self.held[:stop]
        self.wanted = 1
        return head, block, None

    def end(self) -> Iterator[tuple[bytes, bytes, str | None]]:
        rest = bytes(self.held).strip(b"\r\n")
        if rest:
            yield rest.partition(b"\r\n\r\n")[0], b"", "truncated"
        self.held.clear()
        self.wanted = 1


def _fields(head: bytes) -> list[tuple[str, str]]:
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    return list({k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k.strip()}.items())


_RECORDS = pa.schema([("fields", pa.map_(pa.string(), pa.string())), ("segmented", pa.bool_()), ("block", pa.binary()), ("http_head", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fault", pa.string())])
_RECORDS_DDL = "fields map<string, string>, segmented boolean, block binary, http_head string, payload binary, payload_bytes long, payload_digest string, fault string"


def records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path``, which are compressed files: fields with lower-case names; the block of
    a segment; of an unsegmented record its HTTP head, payload (``with_payload``), size and digest; fault."""
    # Lines between separators, put together again: so the file comes as a stream and not as one cell.
    lines = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def row(head: bytes, block: bytes, fault: str | None) -> tuple:
        fields = _fields(head)
        names = dict(fields)
        if fault or "warc-segment-number" in names:
            return fields, "warc-segment-number" in names, block, None, None, None, None, fault
        if names.get("warc-type") == "revisit":
            return fields, False, None, None, None, None, None, None
        shown, payload, size, digest, wrong = http_payload(block)
        return fields, False, None, shown, payload if with_payload else None, size, digest, wrong

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, cutter, found, size = None, Cutter(), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(_RECORDS)], schema=_RECORDS)

        for part in batches:
            for name, line in zip(part.column(0), part.column(1), strict=True):
                if name.as_py() != file:
                    found += [row(*got) for got in cutter.end()]
                    file = name.as_py()
                for got in cutter.feed(line.as_py() + b"\r\n\r\n"):
                    found.append(row(*got))
                    size += len(got[1])
                if len(found) >= 5_000 or size > 8 << 20:
                    yield batch()
                    found, size = [], 0
        found += [row(*got) for got in cutter.end()]
        if found:
            yield batch()

    return lines.mapInArrow(run, _RECORDS_DDL)


def reassemble(rows: DataFrame) -> DataFrame:
    """(fields, block, fault) of the segmented ``records``, continuations joined to their first segment; a fault where segments are missing or lengths do not add up.

    Segments meet by origin, equal ones in their task first: only what an origin's block needs is gathered.
    """
    field = lambda name: F.col("fields")[name]
    number = F.try_to_number(field("warc-segment-number"), F.lit("999999999")).cast("int")
    parts = rows.filter("segmented").select(
        F.coalesce(field("warc-segment-origin-id"), field("warc-record-id")).alias("origin"), number.alias("number"), field("warc-segment-total-length").try_cast("long").alias("total"), "fields", "block", "fault"
    )
    met = parts.groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.min("total").alias("least"),
        F.first(F.when(F.col("number") == 1, F.col("fields")), ignorenulls=True).alias("fields"),
        F.count_if(F.col("number") == 1).alias("times"),
        F.max("fault").alias("fault"),
    )
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    gap = F.exists(F.transform("parts", lambda p, i: F.coalesce(p["number"] != i + 1, F.lit(True))), lambda x: x)
    fault = F.coalesce("fault", F.when(gap, "segments").when(F.col("total").isNull() | (F.col("total") != F.col("least")) | (size != F.col("total")), "total length"))
    joined = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    made = met.select(F.coalesce("fields", F.create_map(F.lit("warc-record-id"), F.coalesce("origin", F.lit("")))).alias("fields"), joined.alias("block"), fault.alias("fault"), F.explode(F.array_repeat(F.lit(0), F.greatest(F.col("times"), F.lit(1)).cast("int"))))
    return made.drop("col")


def dechunk(data: bytes) -> bytes:
    """The bytes of a body in chunked framing; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        stop = data.index(b"\r\n", at)
        size = data[at:stop].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("chunk size")
        n, at = int(size, 16), stop + 2
        if not n:
            break
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk end")
        out.append(data[at : at + n])
        at += n + 2
    # Trailer fields may follow; an empty line ends the body.
    if data[at : at + 2] != b"\r\n" and b"\r\n\r\n" not in data[at:]:
        raise ValueError("trailer")
    return b"".join(out)


def http_payload(block: bytes | None) -> tuple[str | None, bytes | None, int | None, str | None, str | None]:
    """(HTTP head, payload, its size, its digest, fault) of an HTTP response."""
    if block is None:
        return None, None, None, None, "block"
    head, found, data = block.partition(b"\r\n\r\n")
    if not found:
        return None, None, None, None, "http head"
    shown = head.decode("latin-1")
    if re.search(rb"\r\ntransfer-encoding:[^\r\n]*\bchunked\b", head, re.IGNORECASE):
        try:
            data = dechunk(data)
        except ValueError:
            return shown, None, None, None, "transfer framing"
    return shown, data, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), None


_PAYLOAD = pa.struct([("http_head", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("wrong", pa.string())])


def _decoded(blocks: pa.Array) -> pa.Array:
    made = [http_payload(b.as_py()) for b in blocks]
    return pa.StructArray.from_arrays([pa.array([m[k] for m in made], _PAYLOAD.field(k).type) for k in range(5)], fields=list(_PAYLOAD))


def captures(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Responses and revisits of the archives: record_id, record_type, key, url, http_head, payload (``with_payload``),
    payload_bytes, payload_digest (of a revisit: as stated), refers_to_record, fault.

    The archives are read once, into a table in the shared folder; segments meet from there.
    """
    records(spark, path, with_payload).write.parquet(kept := table_path(spark, "records"))
    rows = spark.read.parquet(kept)
    decode = F.arrow_udf(_decoded, "http_head string, payload binary, payload_bytes long, payload_digest string, wrong string")
    joined = reassemble(rows).withColumn("made", decode("block")).select("fields", "made.http_head", F.col("made.payload") if with_payload else F.lit(None).cast("binary").alias("payload"), "made.payload_bytes", "made.payload_digest", F.coalesce("fault", "made.wrong").alias("fault"))
    every = rows.filter("not segmented").select("fields", "http_head", "payload", "payload_bytes", "payload_digest", "fault").unionByName(joined)
    field = lambda name: F.col("fields")[name]
    stated = F.regexp_replace(field("warc-payload-digest"), "(?i)^sha1:", "")
    return every.select(
        field("warc-record-id").alias("record_id"), F.coalesce(field("warc-type"), F.lit("unknown")).alias("record_type"), field("warc-capture-key").try_cast("long").alias("key"), field("warc-target-uri").alias("url"), "http_head",
        *(["payload"] if with_payload else []), "payload_bytes", F.coalesce("payload_digest", stated).alias("payload_digest"), field("warc-refers-to").alias("refers_to_record"),
        F.coalesce("fault", F.when(stated != F.col("payload_digest"), "digest")).alias("fault"),
    )


def resolve(found: DataFrame) -> DataFrame:
    """``captures`` without payloads: a revisit gets the key (``refers_to``) and size of the response that it refers to; fault ``target`` where that is missing or of another digest.

    Read ``found`` from a table: it is used several times. Targets of more than a ``HOT_SHARE``-th of all
    revisits, fewer than ``HOT_SHARE`` by count, meet their revisits by broadcast.
    """
    rows = found.select("record_id", "record_type", "key", "url", "payload_bytes", "payload_digest", "refers_to_record", "fault")
    full = rows.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    again = rows.filter("record_type = 'revisit'").drop("payload_bytes")
    asked = again.groupBy("refers_to_record").count()
    most = again.count() // HOT_SHARE + 1
    targets = full.dropDuplicates(["record_id"]).select(F.col("record_id").alias("refers_to_record"), F.col("key").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("theirs"))
    told = targets.join(asked, "refers_to_record")
    hot, cold = told.filter(F.col("count") > most).drop("count"), told.filter(F.col("count") <= most).drop("count")
    rest = again.join(F.broadcast(hot.select("refers_to_record")), "refers_to_record", "left_anti").join(cold, "refers_to_record", "left")
    joined = again.join(F.broadcast(hot), "refers_to_record").unionByName(rest)
    wrong = F.when(F.col("theirs").isNull() | (F.col("theirs") != F.col("payload_digest")), "target")
    return full.unionByName(joined.withColumn("fault", F.coalesce("fault", wrong)).drop("theirs"))
