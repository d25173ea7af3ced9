"""WARC archives, written by Spark's text writer and read back by boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import BROADCAST_IDS, shared_folder, small_batches, stored

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
RECORD = "urn:siltstone:page:"
NUMERALS = "0123456789abcdefghijklmnopqrstuv"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base 32: four groups of 40 bits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.lower(F.concat(*groups)), NUMERALS, BASE32)


def records(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and the whole WARC record of each row of pages (page_id, url, html), without its final END.

    Of rows with equal payloads of at least `least_bytes` bytes, that with the largest page_id is a
    response and the others are revisits of it. Null html is an empty payload. A row without a page_id
    is a response. The largest id of a payload is a partial aggregate, however many share it; only digests
    that several rows have are joined, so payloads stay where they are unless those are very many.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload")})
    first = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = stored(first, f"{folder}/first")
    rows = rows.join(F.broadcast(first) if first.count() <= BROADCAST_IDS // 4 else first, "digest", "left")  # a wide key: fewer
    again = F.col("page_id") < F.col("first")
    name = lambda c: F.concat(F.lit(f"<{RECORD}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    uri = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " "), F.lit("\r\n"))).otherwise(F.lit(""))
    revisit = F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit(""))
    header = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit("\r\n"), uri,
        F.lit(f"WARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"), revisit,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return rows.select("page_id", F.concat(header, block).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "none", most_records: int = 50_000) -> None:
    """Write archives of the pages below path: text files of records, each ended by END.

    Files hold at most `most_records` records and are read in splits; those that are compressed as a whole
    (compression "gzip") are read by one task each.
    """
    rows = records(pages, shared_folder(pages.sparkSession, "warc"), least_bytes).select("value")
    rows.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", most_records).text(path)


_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d+)[ \t]*\r?$")
_FIELD = re.compile(rb"(?m)^([A-Za-z-]+):[ \t]*([^\r\n]*?)[ \t]*\r?$")
#: bytes that stand between two records, besides the content: the magic, the header's end, the record's end
_MAGIC, _END = len(MAGIC), len(END)


def _page(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<" + RECORD.encode() + rb"(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def _payload(block: bytes) -> bytes:
    """The HTTP body of a record's block."""
    return block.partition(END.encode())[2]


CANDIDATE = "file string, part long, start long, size long, next long, leap long, type string, page_id long, refers_to long, digest string, whole boolean, payload_bytes long, payload_digest string"


def leaps(start: np.ndarray, following: np.ndarray, last: int) -> np.ndarray:
    """Where each candidate's chain leaves the part: pointer jumping over those that stay in it; -1 for a broken chain."""
    at = np.searchsorted(start, following)
    at = np.minimum(at, len(start) - 1)
    stays = (following >= 0) & (following <= last)
    sound = stays & (start[at] == following)
    place = np.where(sound, at, np.arange(len(start)))
    while True:
        further = place[place]
        if (further == place).all():
            break
        place = further
    end = following[place]
    return np.where((end >= 0) & (end > last), end, -1)


def _candidates(batches):
    """The rows between magics of each file part, as candidate records with their successors' offsets."""
    parts: dict[tuple, list] = {}

    def told(key: tuple, rows: list) -> pa.RecordBatch:
        start = np.array([r[0] for r in rows], np.int64)
        following = np.array([r[2] for r in rows], np.int64)
        leap = leaps(start, following, int(start[-1]))
        columns = [[key[0]] * len(rows), [key[1]] * len(rows), start, [r[1] for r in rows], following, leap, *([r[k] for r in rows] for k in range(3, 10))]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in CANDIDATE.split(", ")])

    key, rows, at = None, [], 0
    for batch in batches:
        for file, part, value in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), batch.column("value"), strict=True):
            if (file, part) != key:
                if rows:
                    yield told(key, rows)
                # a part begins after a magic, which the start of its first record counts; only a file's first row is before any
                key, rows, at = (file, part), [], 0
            text = value.as_py()
            size = len(text) + _MAGIC
            row = [at - _MAGIC, size, -1, None, None, None, None, False, None, None]
            head, mark, body = text.partition(END.encode())
            length = _LENGTH.search(head) if mark else None
            if length and (part or at):
                content = int(length[1])
                row[2] = at + len(head) + _END + content + _END
                fields = {k.lower(): v for k, v in _FIELD.findall(head)}
                row[3] = fields.get(b"warc-type", b"").decode("latin-1").lower()
                row[4], row[5] = _page(fields.get(b"warc-record-id")), _page(fields.get(b"warc-refers-to"))
                row[6] = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
                if len(body) >= content:
                    payload = _payload(body[:content])
                    row[7], row[8], row[9] = True, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            rows.append(tuple(row))
            at += size
    if rows:
        yield told(key, rows)


def _reached(group: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a part that the chain passes, from where it enters: marks spread by pointer jumping."""
    group = group.sort_values("start", ignore_index=True)
    start, following = group["start"].to_numpy(), group["next"].to_numpy()
    mark = start == group["entry"].to_numpy()
    at = np.minimum(np.searchsorted(start, following), len(start) - 1)
    jump = np.where(start[at] == following, at, np.arange(len(start)))
    while True:
        mark[jump[mark]] = True
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    return group[mark].drop(columns="entry")


def read(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """page_id, type, refers_to, payload_bytes, payload_digest of each record in archives below path.

    Files are read in splits, cut at each magic. Tasks emit each candidate with the offset of the record
    that would follow it; offsets are counted from the part's start, and parts' sizes give theirs in
    the file. Chains from the file's start then decide, part by part and, where a file has several
    parts, over parts: what they don't reach is payload that looks like a record, or lies after a break.
    """
    small_batches(spark, 200)
    texts = spark.read.option("lineSep", MAGIC).text(path)
    texts = texts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.col("value").cast("binary").alias("value"))
    found = stored(texts.mapInArrow(_candidates, CANDIDATE), f"{folder}/candidates")

    parts = found.groupBy("file", "part").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    entries = parts.where("base = 0").select("file", "part", F.lit(0).cast("long").alias("entry"))
    if parts.where("base > 0").take(1):
        jumps = found.join(parts, ["file", "part"]).where("next >= 0").select("file", (F.col("start") + F.col("base")).alias("a"), F.when(F.col("leap") >= 0, F.col("leap") + F.col("base")).alias("b"))
        jumps = stored(jumps, f"{folder}/jumps")
        reach, count, k = stored(jumps.select("file").distinct().withColumn("a", F.lit(0).cast("long")), f"{folder}/reach"), -1, 0
        while reach.count() != count:  # marks double: each round passes twice as many parts
            count, k = reach.count(), k + 1
            reach = stored(reach.union(reach.join(jumps, ["file", "a"]).where("b is not null").select("file", F.col("b").alias("a"))).distinct(), f"{folder}/reach{k}")
            twice = jumps.select("file", "a", F.col("b").alias("c")).join(jumps.select("file", F.col("a").alias("c"), "b"), ["file", "c"], "left")
            jumps = stored(twice.select("file", "a", "b"), f"{folder}/jumps{k}")
        inside = reach.join(parts, "file").where(f"a >= base - {_MAGIC} and a < base + bytes - {_MAGIC}")
        entries = inside.select("file", "part", (F.col("a") - F.col("base")).alias("entry"))
    schema = f"{CANDIDATE}, entry long"
    reached = found.join(entries, ["file", "part"]).select(*[x.split()[0] for x in schema.split(", ")]).groupBy("file", "part").applyInPandas(_reached, CANDIDATE)
    reached = stored(reached.where("type is not null"), f"{folder}/reached")

    torn = reached.where("not whole")
    if torn.take(1):  # a payload that has magics: put its rows together again
        spans = torn.join(parts, ["file", "part"]).select("file", (F.col("start") + F.col("base")).alias("a"), (F.col("next") + F.col("base")).alias("b"))
        reached = reached.where("whole").unionByName(_rejoined(texts, spans, torn, parts))
    return reached.select("page_id", "type", "refers_to", "digest", "payload_bytes", "payload_digest")


def _rejoined(texts: DataFrame, spans: DataFrame, torn: DataFrame, parts: DataFrame) -> DataFrame:
    """The torn records with their payloads, each from the rows that its span covers."""

    def placed(batches):
        key, at = None, 0
        for batch in batches:
            out = []
            for file, part, value in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), batch.column("value"), strict=True):
                if (file, part) != key:
                    key, at = (file, part), 0
                text = value.as_py()
                out.append((file, part, at - _MAGIC, text))
                at += len(text) + _MAGIC
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["file", "part", "start", "value"])

    rows = texts.mapInArrow(placed, "file string, part long, start long, value binary").join(parts, ["file", "part"])
    rows = rows.select("file", (F.col("start") + F.col("base")).alias("at"), "value")
    held = rows.join(spans, (rows["file"] == spans["file"]) & (F.col("at") >= F.col("a")) & (F.col("at") < F.col("b"))).select(spans["file"].alias("file"), "a", "at", "value")
    whole = held.groupBy("file", "a").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("rows"))  # the rows of one record

    def payload(batches):
        for batch in batches:
            sizes, digests = [], []
            for pieces in batch.column("rows"):
                text = MAGIC.encode().join(p["value"].as_py() for p in pieces)
                head, _, body = text.partition(END.encode())
                body = _payload(body[: int(_LENGTH.search(head)[1])])
                sizes.append(len(body))
                digests.append(base64.b32encode(hashlib.sha1(body).digest()).decode())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("a"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["file", "a", "payload_bytes", "payload_digest"])

    whole = whole.mapInArrow(payload, "file string, a long, payload_bytes long, payload_digest string")
    named = torn.join(parts, ["file", "part"]).withColumn("a", F.col("start") + F.col("base")).drop("bytes", "base", "payload_bytes", "payload_digest")
    return named.join(whole, ["file", "a"]).drop("a").select(*[x.split()[0] for x in CANDIDATE.split(", ")])


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, read back from archives.

    A revisit's size is that of the response it names. Repeated rows give a record each; a null
    page_id gives a response with a null id. An empty table gives no archive records.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write(pages, f"{folder}/archives", least_bytes)
    rows = read(spark, f"{folder}/archives", folder)
    sizes = rows.where("type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("full"))
    again = rows.where("type = 'revisit'").select("page_id", "refers_to", "digest").join(sizes, ["refers_to", "digest"], "left")
    responses = rows.where("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return responses.union(again.select("page_id", "full", "digest", F.lit("revisit"), "refers_to"))
