"""WARC records and a Merkle fixity audit of their replicas."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import stored

#: Bytes of record offsets that a range of the lowest level spans, and children of a node.
SPAN, FANOUT = 64 << 10, 16
#: What ends a record.
END = "\r\n\r\n"


def page_records(pages: DataFrame, per_file: int = 1000) -> DataFrame:
    """WARC/1.0 resource records of ``pages(page_id, url, html)``: (file, page_id, place, head, body, raw).

    File f holds the pages with ``page_id div per_file = f`` in the order of id, then of the
    record's digest, ``place``, so repeated rows are records of their own. Null urls and
    texts count as empty; rows without an id are dealt by their digests to the files -1 to
    -4096, which no other row uses (ids are not negative).
    """
    body, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    named = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), named, F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), head.alias("head"), body.alias("body"))
    whole = parts.withColumn("raw", F.concat("head", "body", F.lit(END))).withColumn("place", F.sha2("raw", 256))
    dealt = -1 - F.conv(F.substring("place", 1, 3), 16, 10).cast("long")
    return whole.select(F.coalesce(F.floor(F.col("page_id") / per_file).cast("long"), dealt).alias("file"), "page_id", "place", "head", "body", "raw")


def record_index(records: DataFrame) -> DataFrame:
    """(file, offset, page_id, length, sha256) of a replica's records, offsets being where each begins in its file.

    Records lie in a file by (``later``, page_id, ``place``), repeated and null ids included.
    Where ``lost`` holds, the record's bytes can't be read: it has its length but no row.
    ``later`` and ``lost`` may be missing. Only lengths and digests pass through the window
    that sums the offsets.
    """
    flags = [F.col(c) if c in records.columns else F.lit(0 if c == "later" else False).alias(c) for c in ("later", "lost")]
    sized = records.select("file", "page_id", "place", *flags, F.octet_length("raw").cast("long").alias("length"), F.sha2("raw", 256).alias("sha256"))
    before = Window.partitionBy("file").orderBy("later", "page_id", "place").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).where("not lost").select("file", "offset", "page_id", "length", "sha256")


@dataclass
class Level:
    """Nodes (replica, file, k, sha256) of a level, and (file, k) of a node's parent as SQL; None at the root."""

    nodes: DataFrame
    above: tuple[str, str] | None = None


def merkle_levels(leaves: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> list[Level]:
    """Levels of the hash trees of all replicas in ``leaves(replica, file, offset, sha256)``, the lowest first.

    A node is keyed by (file, k): at the lowest level k is the range of ``span`` bytes in
    which its records begin, and a level up it is ``k div fanout``. When each file is one
    node, files are joined in the same way until one node is left. A node's hash is the
    SHA-256 of its children's places and hashes in order, so a node has a bounded number of
    children and no task needs a whole file.
    """

    def digest(at):
        items = F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), "sha256")))
        return F.sha2(F.concat_ws(",", F.transform(items, lambda x: F.concat_ws(":", x["at"], x["sha256"]))), 256).alias("sha256")

    nodes = leaves.withColumn("k", F.expr(f"offset div {span}")).groupBy("replica", "file", "k").agg(digest("offset"))
    levels = [Level(stored(nodes, "merkle"))]
    k, high, low = levels[0].nodes.agg(F.max("k"), F.max("file"), F.min("file")).first()
    while k is not None and (k > 0 or high > low):
        if k > 0:
            above, at, k = ("file", f"k div {fanout}"), "k", k // fanout
        else:
            high, low = high // fanout, low // fanout
            above, at = (f"cast(floor(file / {fanout}) as bigint)", "0L"), "file"
            if (low, high) == (-1, 0):  # files of rows without an id and the others would never meet
                above, low = ("0L", "0L"), 0
        levels[-1].above = above
        up = levels[-1].nodes.select("replica", F.expr(above[0]).alias("file"), F.expr(above[1]).alias("k"), F.col(at).alias("at"), "sha256")
        levels.append(Level(stored(up.groupBy("replica", "file", "k").agg(digest("at")), "merkle")))
    return levels


def audit(leaves: DataFrame, wanted: str, found: str, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two replicas: (file, offset, page_id, status, want_sha256, found_sha256).

    ``leaves`` has (replica, file, offset, page_id, sha256), each replica's own index. Roots
    are compared first, and at each level only the children of nodes that differ are read
    on; equal subtrees are never opened. ``status`` is changed, missing or extra.
    """
    differing = None
    for level in reversed(merkle_levels(leaves, span, fanout)):
        nodes = level.nodes
        if differing is not None:
            parent = differing.select(F.col("file").alias("pf"), F.col("k").alias("pk"))
            nodes = nodes.join(parent, (F.expr(level.above[0]) == F.col("pf")) & (F.expr(level.above[1]) == F.col("pk")), "left_semi")
        pair = nodes.where(F.col("replica") == wanted).join(nodes.where(F.col("replica") == found).select("file", "k", F.col("sha256").alias("other")), ["file", "k"], "full")
        differing = stored(pair.where(~F.col("sha256").eqNullSafe(F.col("other"))).select("file", "k"), "merkle-differ")
    own = leaves.withColumn("k", F.expr(f"offset div {span}")).join(differing, ["file", "k"], "left_semi")
    want = own.where(F.col("replica") == wanted).select("file", "offset", "page_id", F.col("sha256").alias("want_sha256"))
    have = own.where(F.col("replica") == found).select("file", "offset", F.col("page_id").alias("found_id"), F.col("sha256").alias("found_sha256"))
    both = want.join(have, ["file", "offset"], "full").where(~F.col("want_sha256").eqNullSafe(F.col("found_sha256")))
    status = F.when(F.col("found_sha256").isNull(), "missing").when(F.col("want_sha256").isNull(), "extra").otherwise("changed")
    return both.select("file", "offset", F.coalesce("page_id", "found_id").alias("page_id"), status.alias("status"), "want_sha256", "found_sha256")


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file's bytes, plain or of gzip members: offset, length, headers, payload.

    ``offset`` and ``length`` count the stored bytes of a member, or of a plain record. A
    broken record ends the file; what precedes it is returned.
    """
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            unzip, plain, size = zlib.decompressobj(31), bytearray(), 0
            try:
                while not unzip.eof and at + size < len(data):  # in pieces, so that no member copies the rest of the file
                    piece = data[at + size : at + size + (64 << 10)]
                    plain += unzip.decompress(piece)
                    size += len(piece) - len(unzip.unused_data)
            except zlib.error:
                return
            if not unzip.eof:
                return
            records = list(parse_warc(bytes(plain)))
            for r in records:
                yield r | {"offset": at, "length": size}
            at += size
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            return
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = headers.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            return
        stop = end + 4 + int(size)
        payload = data[end + 4 : stop]
        stop += 4 * (data[stop : stop + 4] == b"\r\n\r\n")
        yield {"offset": at, "length": stop - at, "headers": headers, "payload": payload}
        at = stop


def join_warc(records: list[bytes], compress: bool = False) -> bytes:
    """A WARC file's bytes of whole records, each its own gzip member if ``compress``."""
    return b"".join(gzip.compress(r, mtime=0) if compress else r for r in records)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``: (path, offset, length, type, uri, record_id, payload)."""

    def parse(frames):
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(file, r["offset"], r["length"], r["headers"].get("warc-type"), r["headers"].get("warc-target-uri"), r["headers"].get("warc-record-id"), r["payload"]) for r in parse_warc(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "offset", "length", "type", "uri", "record_id", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, offset long, length long, type string, uri string, record_id string, payload binary")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known damage, for the audit to find.

    Of ids 97k+5 the last character of the body is overwritten, byte for byte; ids 101k+7
    can't be read; ids 103k+9 were written a second time at the end of their file.
    """
    last = F.substring("body", -1, 1)
    broken = F.concat("head", F.expr("substring(body, 1, char_length(body) - 1)"), F.expr("repeat('!', octet_length(substring(body, -1, 1)))"), F.lit(END))
    hit = F.coalesce((F.col("page_id") % 97 == 5) & (last != ""), F.lit(False))
    kept = records.withColumns({"raw": F.when(hit, broken).otherwise(F.col("raw")), "later": F.lit(0), "lost": F.coalesce(F.col("page_id") % 101 == 7, F.lit(False))})
    again = records.where("page_id % 103 = 9").withColumns({"later": F.lit(1), "lost": F.lit(False)})
    return kept.unionByName(again)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Audit of all pages' records against a replica with known damage.

    Each replica is indexed by itself; what differs is found by descent from the roots. Rows
    without an id, repeated rows and null or empty pages are records like others; other
    columns are ignored; an empty table gives no rows.
    """
    from cadenza.llm.common import table

    records = page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    replicas = {"original": records, "copy": damaged(records)}
    indexes = [record_index(r).select(F.lit(name).alias("replica"), "file", "offset", "page_id", "sha256") for name, r in replicas.items()]
    return audit(stored(indexes[0].union(indexes[1]), "warc-leaves"), "original", "copy")


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS head,
  chr(13) || chr(10) || chr(13) || chr(10) AS tail FROM pages),
r AS (SELECT *, head || h || tail AS raw, sha256(head || h || tail) AS place FROM p),
f AS (SELECT *, CASE WHEN page_id IS NULL THEN -1 - ('0x' || left(place, 3))::BIGINT ELSE page_id // 1000 END AS file FROM r),
o AS (SELECT file, page_id, place AS want_sha256, coalesce(sum(strlen(raw)) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM f),
c AS (SELECT file, page_id, place, 0 AS later, coalesce(page_id % 101 = 7, false) AS lost, CASE WHEN page_id % 97 = 5 AND h <> '' THEN head || left(h, length(h) - 1) || repeat('!', strlen(right(h, 1))) || tail ELSE raw END AS raw FROM f
  UNION ALL SELECT file, page_id, place, 1, false, raw FROM f WHERE page_id % 103 = 9),
d AS (SELECT file, page_id, lost, sha256(raw) AS found_sha256, coalesce(sum(strlen(raw)) OVER (PARTITION BY file ORDER BY later, page_id NULLS FIRST, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM c)
SELECT file::BIGINT AS file, "offset", coalesce(o.page_id, e.page_id) AS page_id, CASE WHEN found_sha256 IS NULL THEN 'missing' WHEN want_sha256 IS NULL THEN 'extra' ELSE 'changed' END AS status, want_sha256, found_sha256
FROM o FULL JOIN (SELECT * FROM d WHERE NOT lost) e USING (file, "offset") WHERE found_sha256 IS DISTINCT FROM want_sha256
"""
