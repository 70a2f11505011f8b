"""WARC archives with an index: write, select in the index, read coalesced byte ranges.

Every input partition becomes one archive of gzip members, one per record, written under another
name and moved into place when it is whole. Each attempt of a task names its own file, and the index
that is committed has only those of the attempts that counted. The
index has file, offset, length, URL and digest of each record. Reading sorts the selected index
rows by file and offset, joins neighbouring ranges into one read, and checks each payload's digest.
Files are reached through the file system that the folder's URI names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import folder
from .common import stored

#: Payloads below this many bytes are always stored.
MIN_SHARED = 1000
#: Ranges that are this near are read together, up to so many bytes at once.
GAP, MOST = 64 << 10, 8 << 20
#: Payloads that are each more than this part of all repeated ones are broadcast.
MOST_OFTEN = 100_000

INDEX = "key bigint, url string, file string, offset bigint, length bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _record(kind: str, url: str | None, key, digest: str, payload: bytes, refers_to, size: int) -> bytes:
    """One record in the standard's layout; a revisit has no block and names the record that has it."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:quire:{key}:{digest}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        f"X-Page: {'' if key is None else key}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:quire:{refers_to}:{digest}>", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def _parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def marked(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = MIN_SHARED) -> DataFrame:
    """(key, url, payload) rows with digest, size, record_type and refers_to.

    Of equal payloads of `least` bytes or more the one with the largest key is the response and the
    others revisit it; rows that tie for the largest key are all responses; a null key is smaller
    than any. Only payloads that occur again take part in the join, and only by their digest. Those that occur in a large
    share of the rows, of which there are few, are broadcast; so no digest's rows meet in one task."""
    size = F.coalesce(F.octet_length(payload), F.lit(0)).cast("long")
    rows = pages.withColumn("payload_bytes", size).withColumn("payload_digest", F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary")))
    heads = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.max(key).alias("head"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("head").isNotNull())
    )
    # a table, so that its size is known where the join is planned: small ones are broadcast, others shuffle
    heads = stored(heads, "heads")
    often = F.col("n") > max(1000, (heads.agg(F.sum("n")).first()[0] or 0) // MOST_OFTEN)
    many = heads.where(often).select("payload_digest", F.col("head").alias("often"))  # fewer than MOST_OFTEN rows
    few = heads.where(~often).select(F.col("payload_digest").alias("by"), "head")
    # rows that need no such head are dealt evenly
    alone = (F.col("payload_bytes") < least) | F.col("often").isNotNull()
    rows = rows.join(F.broadcast(many), "payload_digest", "left")
    rows = rows.withColumn("by", F.when(alone, F.concat(F.lit("-"), F.xxhash64(key, payload).cast("string"))).otherwise(F.col("payload_digest"))).join(few, "by", "left")
    rows = rows.withColumn("head", F.coalesce("often", "head"))
    revisit = F.col("head").isNotNull() & (F.col("payload_bytes") >= least) & (F.col(key).isNull() | (F.col(key) < F.col("head")))
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("head"))).drop("head", "often", "by")


def write(pages: DataFrame, base: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = MIN_SHARED) -> DataFrame:
    """Archive every row (null payload: empty) below base and return the index, a stored table."""
    rows = marked(pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("payload")), "key", "payload", least)
    rows = rows.select("key", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to").withColumn("shard", F.spark_partition_id())

    def archive(batches):
        fs, root = _filesystem(base)
        out, name, at, temporary = None, None, 0, None
        for b in batches:
            found = []
            for r in b.to_pylist():
                if out is None:
                    name = f"part-{r['shard']:06d}-{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(root, recursive=True)
                    temporary = f"{root}/.{name}"
                    out = fs.open_output_stream(temporary, compression=None)  # members are compressed one by one
                body = (r["payload"] or "").encode()
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = pack.compress(_record(r["record_type"], r["url"], r["key"], r["payload_digest"], body, r["refers_to"], r["payload_bytes"])) + pack.flush()
                out.write(raw)
                found.append({"key": r["key"], "url": r["url"], "file": f"{base}/{name}", "offset": at, "length": len(raw), "payload_bytes": r["payload_bytes"], "payload_digest": r["payload_digest"], "record_type": r["record_type"], "refers_to": r["refers_to"]})
                at += len(raw)
            yield pa.RecordBatch.from_pylist(found, index_schema)
        if out is not None:
            out.close()
            fs.move(temporary, f"{root}/{name}")

    index_schema = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string()}[t]) for n, t in (x.split() for x in INDEX.split(", "))])
    return stored(rows.mapInArrow(archive, INDEX), "index")


def read(index: DataFrame, gap: int = GAP, most: int = MOST) -> DataFrame:
    """The records of the given index rows: key, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to.

    A record whose payload does not have its digest raises an error."""
    schema = "key bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"
    arrow = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def fetch(batches):
        opened, name = None, None
        for b in batches:
            rows = b.select(["url", "file", "offset", "length"]).to_pylist()
            i = 0
            while i < len(rows):
                j, end = i + 1, rows[i]["offset"] + rows[i]["length"]
                while j < len(rows) and rows[j]["file"] == rows[i]["file"] and rows[j]["offset"] - end <= gap and rows[j]["offset"] + rows[j]["length"] - rows[i]["offset"] <= most:
                    end = max(end, rows[j]["offset"] + rows[j]["length"])
                    j += 1
                if rows[i]["file"] != name:
                    if opened:
                        opened.close()
                    fs, _ = _filesystem(rows[i]["file"])
                    name = rows[i]["file"]
                    opened = fs.open_input_file(_filesystem(name)[1])
                start = rows[i]["offset"]
                opened.seek(start)
                chunk = opened.read(end - start)
                out = []
                for r in rows[i:j]:
                    fields, body = _parse(zlib.decompress(chunk[r["offset"] - start : r["offset"] - start + r["length"]], 31))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    stored_here = fields["WARC-Type"] == "response"
                    if stored_here and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"digest of {r['file']} at {r['offset']}")
                    to = fields.get("X-Refers-To-Page")
                    out.append(
                        {
                            "key": int(fields["X-Page"]) if fields["X-Page"] else None,
                            "url": r["url"],
                            "record_type": fields["WARC-Type"],
                            "payload": body if stored_here else None,
                            "payload_bytes": len(body) if stored_here else int(fields["X-Payload-Length"]),
                            "payload_digest": digest,
                            "refers_to": int(to) if to else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, arrow)
                i = j
        if opened:
            opened.close()

    wanted = index.select("url", "file", "offset", "length")
    return wanted.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(fetch, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = write(pages, folder(spark, "warc"))
    return read(index).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < head THEN head END AS refers_to
FROM h
"""
