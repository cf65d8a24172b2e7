"""WARC archives of pages: writing with payload deduplication, and reading by boundary chains.

Writing: of records with equal payloads of at least ``MINIMUM`` bytes the smallest page_id is a response and the others are
revisits without payload; every row becomes one record (rows that repeat the smallest page_id are responses too).
Archives are WARC 1.1 files in the shared folder, written by Spark's text writer: compressed as a whole, with at most
``FILE_RECORDS`` records each, or plain.

Reading: the reader splits archives at the record magic wherever it stands, so each row is one candidate and none
crosses a split. Tasks emit (offset, successor offset), the successor coming from the content length in the header. Offsets
inside a split become file offsets by prefix sums over the split sizes. From the start of each file the chain is
followed by pointer jumping: first to the exit of each zone of the file, then over zones with doubled jumps, and
only records on the chain are kept. A magic inside a payload is never reached; its bytes go back to the record around it.

Null html is an empty payload; null urls are written empty; a null page_id comes back as null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pairwright.llm.registry import query
from pairwright.llm.text import map_rows
from pairwright.operators.keyed import attach
from pairwright.session import cut_lineage, shared_folder
from pairwright.sources.tables import table

MAGIC = "WARC/1.1\r\n"
MINIMUM = 100
ZONE = 4 << 20
FILE_RECORDS = 20_000
DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def with_roles(pages: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, refers_to``; ``refers_to`` is null for responses."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2("html", 256)}
    )
    keys = rows.drop("url", "html")
    owners = keys.groupBy("payload_digest").agg(F.min("page_id").alias("_owner"))
    joined = attach(rows, owners, ["payload_digest"], how="left", spread=["page_id"], hot_from=keys)
    revisit = (F.col("payload_bytes") >= minimum) & (F.col("page_id") > F.col("_owner"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("_owner"))).drop("_owner")


def record_texts(rows: DataFrame) -> DataFrame:
    """One WARC record per row, without the line end that the writer adds."""
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.lit("\r\nPayload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("_block").cast("string"), F.lit("\r\n\r\n"), F.col("_block"), F.lit("\r\n"),
    )
    return rows.withColumn("_block", block).select(head.alias("value"))


def write_archives(rows: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Plain archives (``none``) are read in splits; compressed ones a file at a time."""
    record_texts(rows).write.option("lineSep", "\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(folder, compression=compression)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        meta.file_path.alias("file"), meta.file_block_start.alias("block"), F.col("value").cast("binary").alias("body")
    )


_NUMBER = re.compile(rb"(?:^|\r\n)Content-Length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", re.I)


def _field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?:^|\r\n)" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head, re.I)
    return found[1].decode("utf-8", "replace") if found else None


def _parse(body: bytes) -> dict:
    """What follows a magic, read as a record: header fields, where the block starts and how long it is."""
    end = body.find(b"\r\n\r\n")
    head = body[: max(end, 0)]
    number = _NUMBER.search(head)
    if end < 0 or number is None:
        return {"size": None, "head": None, "ready": False, "digest": None, "payload": None} | dict.fromkeys(FIELDS)
    start, size = end + 4, int(number[1])
    ready = start + size <= len(body)
    fields = {key: _field(head, name) for key, name in FIELDS.items()}
    digest = payload = None
    if ready:
        payload, digest = _payload(body[start : start + size])
    return {"size": size, "head": start, "ready": ready, "digest": digest, "payload": payload} | fields


def _payload(block: bytes) -> tuple[int, str]:
    cut = block.find(b"\r\n\r\n")
    content = block[cut + 4 :] if cut >= 0 else b""
    return len(content), hashlib.sha256(content).hexdigest()


FIELDS = {
    "kind": b"WARC-Type", "record": b"WARC-Record-ID", "refers": b"WARC-Refers-To", "stated": b"WARC-Payload-Digest",
    "stated_size": b"Payload-Length", "uri": b"WARC-Target-URI",
}


def candidates(segments: DataFrame) -> DataFrame:
    """One narrow row per candidate, with file offsets ``pos`` of its magic and ``next`` of its successor's."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        at: dict[tuple[str, int], int] = {}
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for file, block, body in zip(batch["file"], batch["block"], batch["body"], strict=True):
                rel = at.get((file, block), 0)
                at[file, block] = rel + len(body) + len(MAGIC)
                row = {"file": file, "block": block, "rel": rel, "span": len(body) + len(MAGIC)} | _parse(body)
                for name in names:
                    out[name].append(row[name])
            yield out

    names = ["file", "block", "rel", "span", "size", "head", "ready", "digest", "payload", *FIELDS]
    schema = "file string, block long, rel long, span long, size long, head long, ready boolean, digest string, payload long, " + ", ".join(f"{key} string" for key in FIELDS)
    found = cut_lineage(map_rows(segments, ["file", "block", "body"], schema, run))
    spans = found.groupBy("file", "block").agg(F.sum("span").alias("_span"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.select("file", "block", F.coalesce(F.sum("_span").over(before), F.lit(0)).alias("_base"))
    placed = attach(found, bases, ["file", "block"], spread=["rel"])
    # a row's bytes follow its magic; the row in front of a file's first magic is no candidate
    start = F.col("_base") + F.col("rel")
    placed = placed.withColumns({"pos": start - len(MAGIC), "next": start + F.col("head") + F.col("size") + 4})
    return cut_lineage(placed.drop("_base", "head").where("pos >= 0"))


def reachable(found: DataFrame) -> DataFrame:
    """Candidates on the chain that starts at offset 0 of their file."""
    links = found.select("file", "pos", "next", F.floor(F.col("pos") / ZONE).alias("zone"))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        after = dict(zip(pdf["pos"], pdf["next"], strict=True))
        leave: dict[int, int] = {}
        for pos in sorted(after, reverse=True):
            target = after[pos]
            leave[pos] = -1 if pd.isna(target) else leave.get(int(target), int(target))
        return pd.DataFrame({"file": pdf["file"], "pos": pdf["pos"], "exit": pdf["pos"].map(leave)})

    jumps = cut_lineage(links.groupBy("file", "zone").applyInPandas(exits, "file string, pos long, exit long").where("exit > pos"))
    entries = cut_lineage(links.where("pos = 0").select("file", "pos"))
    while True:
        met = entries.join(jumps, ["file", "pos"]).select("file", F.col("exit").alias("pos"))
        grown = cut_lineage(entries.unionByName(met).distinct())
        if grown.count() == entries.count():
            break
        entries = grown
        onward = jumps.select("file", F.col("pos").alias("exit"), F.col("exit").alias("_far"))
        jumps = cut_lineage(jumps.join(onward, ["file", "exit"], "left").select("file", "pos", F.coalesce("_far", "exit").alias("exit")))

    def walk(key, entry: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        after = dict(zip(pdf["pos"], pdf["next"], strict=True))
        kept = []
        for pos in sorted(entry["start"]):
            while pos in after and (not kept or pos > kept[-1]):
                kept.append(pos)
                pos = after[pos]
        return pd.DataFrame({"file": [key[0]] * len(kept), "pos": pd.Series(kept, dtype="int64")})

    # new column identities, since both sides come from one frame
    zone = F.floor(F.col("pos") / ZONE)
    zoned = entries.select(F.col("file").alias("_file"), zone.alias("_zone"), F.col("pos").alias("start"))
    return zoned.groupBy("_file", "_zone").cogroup(links.groupBy("file", "zone")).applyInPandas(walk, "file string, pos long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``file, pos, kind, record, uri, refers, stated, stated_size, payload, digest`` of every verified record."""
    segments = _segments(spark, folder)
    found = candidates(segments)
    chain = cut_lineage(reachable(found).withColumn("_on", F.lit(True)))
    marked = found.join(chain, ["file", "pos"], "left")
    records = marked.where("_on").drop("_on", "span", "size", "rel", "block", "next")
    if found.count() == chain.count():
        return records
    # payloads that hold a magic: the rows up to the next record on the chain belong to them
    upto = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = marked.withColumn("owner", F.last(F.when(F.col("_on"), F.col("pos")), ignorenulls=True).over(upto))
    broken = owned.where("_on and not ready").select("file", F.col("pos").alias("owner"), F.col("size").alias("_size"))
    parts = owned.select("file", "block", "rel", "pos", "owner").join(broken, ["file", "owner"])
    whole = _gather(segments, parts)
    fixed = records.join(whole, ["file", "pos"], "left")
    return fixed.withColumns({"digest": F.coalesce("_digest", "digest"), "payload": F.coalesce("_payload", "payload")}).drop("_digest", "_payload")


def _gather(segments: DataFrame, parts: DataFrame) -> DataFrame:
    """Payload size and digest of records whose rows are named in ``parts``."""

    def place(batches):
        import pyarrow as pa

        at: dict[tuple[str, int], int] = {}
        for batch in batches:
            rel = []
            for file, block, body in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                rel.append(at.get((file, block), 0))
                at[file, block] = rel[-1] + len(body) + len(MAGIC)
            yield from pa.Table.from_batches([batch]).append_column("rel", pa.array(rel, pa.int64())).to_batches()

    placed = segments.mapInArrow(place, StructType([*segments.schema, StructField("rel", LongType())]))

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        bodies = pdf.sort_values("pos")["body"]
        body = MAGIC.encode().join(bytes(value) for value in bodies)
        start = body.find(b"\r\n\r\n") + 4
        size, digest = _payload(body[start : start + int(pdf["_size"].iloc[0])])
        return pd.DataFrame({"file": pdf["file"].iloc[:1], "pos": pdf["owner"].iloc[:1], "_payload": [size], "_digest": [digest]})

    joined = placed.join(parts, ["file", "block", "rel"])
    return joined.groupBy("file", "owner").applyInPandas(assemble, "file string, pos long, _payload long, _digest string")


def archive_pages(pages: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """Write one record per page, read the archives back, and tell what each page's record holds."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(with_roles(pages, minimum), folder)
    records = read_archives(spark, folder)

    def page(column: str) -> Column:
        return F.regexp_extract(F.coalesce(column, F.lit("")), r"<urn:page:(-?\d+)>", 1)

    def number(column: str) -> Column:
        return F.when(page(column) != "", page(column)).cast("long")

    response = F.col("kind") == "response"
    stated = F.regexp_extract("stated", "^sha256:([0-9a-f]{64})$", 1)
    return records.select(
        number("record").alias("page_id"),
        F.when(response, F.col("payload")).otherwise(F.col("stated_size").cast("long")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(stated).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        number("refers").alias("refers_to"),
    )


OP8_SQL = """
with rows as (
  select page_id, coalesce(html, '') as html from pages
), hashed as (
  select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest from rows
), owned as (
  select *, min(page_id) over (partition by payload_digest) as owner from hashed
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id > owner then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id > owner then owner end as refers_to
from owned
"""


@query("op8_warc", OP8_SQL)
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_pages(table(spark, folder, "pages"))
