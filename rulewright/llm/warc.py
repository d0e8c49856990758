"""WARC archives: writing with payload dedup, and reading by boundary-chain verification.

Files are written by Spark's text writer, a record a line, with the record terminator as line separator. They are
read with the magic as line separator, so every split yields candidate records wherever the magic stands, inside
payloads too. A task emits each candidate's offset within its split and, from the declared length, that of its successor; split sums make
offsets absolute. Pointer jumping from offset 0 of each file, with links that double every round, retains what is
reachable: a magic inside a payload is on no chain. A payload that such a magic has cut is put together again.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import FILE, LOCATOR, ROW, drop_table, materialise, or_empty, read_table, shared_path, with_locator

MAGIC, GAP = "WARC/1.1\r\n", "\r\n\r\n"
RECORDS_PER_FILE = 20_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCAN = "file long, block long, seq long, local long, size long, length long, whole boolean, kind string, id string, refers string, payload_bytes long, digest string"
_SCHEMA = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("seq", pa.int64()), ("local", pa.int64()), ("size", pa.int64()), ("length", pa.int64()), ("whole", pa.bool_()), ("kind", pa.string()), ("id", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string())])


def base32_sha1(c: Column) -> Column:
    """SHA-1 in upper-case base32: five hexadecimal digits are four of base32."""
    h = F.sha1(c.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def assign_revisits(located: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Locator, digest, n_bytes, id (urn) and refers (urn of the response for revisits, else null) of every page.

    Of equal payloads of at least min_bytes bytes the page of the largest page_id (null last, then the last row) is the response.
    """
    payload = or_empty(F.col("html")).cast("binary")
    urn = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.col(FILE).cast("string"), F.lit(":"), F.col(ROW).cast("string"))
    rows = materialise(located.select(*LOCATOR, F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("same"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"), urn.alias("id")), "payloads")
    best = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("same").agg(F.max(F.struct("page_id", *LOCATOR, "id")).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("same", "best.id")
    best = best.select("same", F.col("id").alias("to"))
    refers = F.when((F.col("to") != F.col("id")) & (F.col("n_bytes") >= min_bytes), F.col("to"))
    return rows.join(best, "same", "left").select(*LOCATOR, "digest", "n_bytes", "id", refers.alias("refers"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "none", date: str = "2024-01-01T00:00:00Z") -> None:
    """A record for each row of pages (page_id, url, html), in files of at most RECORDS_PER_FILE records; null html is empty."""
    located = with_locator(pages.select("page_id", "url", "html"))
    rows = located.join(assign_revisits(located, min_bytes), LOCATOR)
    again = F.col("refers").isNotNull()
    url = F.replace(F.replace(or_empty(F.col("url")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(GAP))
    body = F.when(again, F.lit("")).otherwise(or_empty(F.col("html")))
    length = F.octet_length(http) + F.octet_length(body)
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <"), F.col("id"), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT}\r\nWARC-Refers-To: <"), F.col("refers"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(GAP),
    )
    rows.select(F.concat(head, http, body).alias("value")).write.option("lineSep", GAP).option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _number(text: str) -> int | None:
    """A decimal that a file's offset can hold; None for all else."""
    return int(text) if len(text) <= 15 and text.isascii() and text.isdigit() else None


def parse_record(data: bytes) -> dict | None:
    """What stands after a magic: length (with both gaps), whole, kind, id, refers, payload_bytes, digest. None if it is no record's head.

    A head without a length of at most 15 digits, or with a line without a colon, is none; payload_bytes of a revisit is null where
    its HTTP head names no such length. Nothing that a page holds raises an error.
    """
    cut = data.find(b"\r\n\r\n")
    if cut < 0:
        return None
    head = {}
    for line in data[:cut].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    declared = _number(head.get(b"content-length", ""))
    if declared is None:
        return None
    end = cut + 4 + declared
    kind = head.get(b"warc-type", "")
    out = {"length": end + 4, "whole": len(data) >= end, "kind": kind, "id": head.get(b"warc-record-id", "").strip("<>"), "refers": head.get(b"warc-refers-to", "").strip("<>") or None, "payload_bytes": None, "digest": None}
    if not out["whole"]:
        return out
    block = memoryview(data)[cut + 4 : end]
    at = data.find(b"\r\n\r\n", cut + 4, end)
    payload = block[at + 4 - (cut + 4) :] if at >= 0 else block[:0]
    if kind == "revisit":
        for line in bytes(block[: max(0, at - cut - 4)]).split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                out["payload_bytes"] = _number(line.split(b":", 1)[1].strip().decode("utf-8", "replace"))
        out["digest"] = head.get(b"warc-payload-digest", "").removeprefix("sha1:")
    else:
        out["payload_bytes"], out["digest"] = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return out


def _text(spark: SparkSession, path: str) -> DataFrame:
    """A file goes by a hash of its path: a path in every row would compress to nothing on disk, and rows that seem few would be broadcast."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _numbered(batches):
    """(batch, row, file, block, seq, local) of every row in the order of its split."""
    at, seq, local = None, 0, 0
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        for i in range(batch.num_rows):
            if at != (files[i], blocks[i]):
                at, seq, local = (files[i], blocks[i]), 0, 0
            value = batch.column("value")[i].as_py()
            yield value, *at, seq, local
            seq, local = seq + 1, local + len(value) + len(MAGIC)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row wherever the magic stands: file, off, succ (the offset after the record it declares, null if it declares none), and what it holds."""

    def scan(batches):
        held = []
        for value, file, block, seq, local in _numbered(batches):
            row = {"file": file, "block": block, "seq": seq, "local": local, "size": len(value) + len(MAGIC)}
            held.append(row | (parse_record(value) or {}))
            if len(held) == 1024:
                yield pa.RecordBatch.from_pylist(held, _SCHEMA)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _SCHEMA)

    rows = materialise(_text(spark, path).mapInArrow(scan, _SCAN), "warc-candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("file", "block").agg(F.sum("size").alias("bytes")).select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    off = F.col("base") + F.col("local") - len(MAGIC)
    return rows.join(base, ["file", "block"]).select(*rows.columns, off.alias("off"), (off + len(MAGIC) + F.col("length")).alias("succ"))


def reachable(rows: DataFrame) -> DataFrame:
    """file, off of the candidates on the chain from offset 0 of each file, by pointer jumping."""
    known = rows.filter("off >= 0 and succ is not null").select("file", "off", "succ")
    links = materialise(known.join(known.select("file", F.col("off").alias("succ")), ["file", "succ"], "left_semi").select("file", "off", "succ"), "warc-links")
    reach = materialise(known.filter("off = 0").select("file", "off"), "warc-reach")
    while not links.isEmpty():
        ahead = links.join(reach, ["file", "off"], "left_semi").select("file", F.col("succ").alias("off"))
        far = links.select("file", F.col("off").alias("succ"), F.col("succ").alias("next"))
        was = reach, links
        reach = materialise(reach.union(ahead).distinct(), "warc-reach")
        links = materialise(links.join(far, ["file", "succ"]).select("file", "off", F.col("next").alias("succ")), "warc-links")
        for table in was:
            drop_table(table)
    return reach


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file (xxhash64 of its path), off, kind, id, refers, payload_bytes, digest of every record that the chains reach; a response's digest is that of the payload read."""
    rows = candidates(spark, path)
    chain = reachable(rows)
    fields = ["kind", "id", "refers", "payload_bytes", "digest"]
    found = rows.join(chain, ["file", "off"])
    records = found.filter("whole").select("file", "off", *fields)
    if found.filter("not whole").isEmpty():
        return records
    # A magic inside a payload has cut these: their rows are put together again.
    marked = rows.filter("off >= 0").join(chain.withColumn("on", F.lit(True)), ["file", "off"], "left")
    upto = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("on"), F.struct("off", "whole")), ignorenulls=True).over(upto)
    cut = marked.withColumn("owner", owner).filter("not owner.whole").select("file", "block", "seq", F.col("owner.off").alias("off"), F.col("off").alias("part"))

    def number(batches):
        for value, file, block, seq, _ in _numbered(batches):
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "seq": seq, "value": value}], pa.schema([("file", pa.int64()), ("block", pa.int64()), ("seq", pa.int64()), ("value", pa.binary())]))

    parts = _text(spark, path).mapInArrow(number, "file long, block long, seq long, value binary").join(cut, ["file", "block", "seq"])
    whole = parts.groupBy("file", "off").agg(F.array_sort(F.collect_list(F.struct("part", "value"))).alias("parts"))

    def rebuild(batches):
        kept = pa.schema([("file", pa.int64()), ("off", pa.int64()), *[(n, _SCHEMA.field(n).type) for n in fields]])
        for batch in batches:
            for row in batch.to_pylist():
                got = parse_record(MAGIC.encode().join(p["value"] for p in row["parts"]))
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "off": row["off"]} | {n: got[n] for n in fields}], kept)

    return records.unionByName(whole.mapInArrow(rebuild, "file long, off long, kind string, id string, refers string, payload_bytes long, digest string"))


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    page = lambda c: F.when(F.split(c, ":")[2] != "", F.split(c, ":")[2].cast("long"))
    return records.select(page(F.col("id")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), page(F.col("refers")).alias("refers_to"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path, compression="gzip")
    return pages_of(read_warc(spark, path))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS best, sha1(body) AS h FROM p),
d AS (SELECT g.*, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_reduce(list_transform(string_split(substr(bits, 5 * i + 1, 5), ''), lambda x: CAST(x AS INTEGER)), lambda a, b: 2 * a + b) AS INTEGER), 1), '' ORDER BY i) FROM generate_series(0, 31) AS s(i)) AS b32
  FROM (SELECT g.*, (SELECT string_agg(substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(h, k, 1)) - 1) + 1, 4), '' ORDER BY k) FROM generate_series(1, 40) AS t(k)) AS bits FROM g) AS g)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM d
"""
