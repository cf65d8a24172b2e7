"""Session audits, byte budgets, percentile reports and the streaming forms."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from pairwright.catalogue.identities import stale, cents, order_id, order_id_sql
from pairwright.catalogue.registry import query
from pairwright.functions.canonical import byte_length, sha256_hex
from pairwright.functions.scalars import epoch_micros
from pairwright.operators import audit
from pairwright.session import cut_lineage, delete_folder, shared_folder
from pairwright.sources.tables import table
from pairwright.streaming import sessions
from pairwright.streaming.publish import publish_stream

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_CAP = 70


@query(
    "session_audit",
    f"""with c as (select user_id, count(*) as n_events, {", ".join(f"count_if(event_type = '{t}')::bigint as n_{t}" for t in EVENT_TYPES)} from events group by 1)
        select *, least(n_events, {EVENT_CAP}) as n_recorded, n_events > {EVENT_CAP} as overflow,
               concat_ws(',', case when n_events > {EVENT_CAP} then 'event_overflow' end, case when n_error > 12 then 'page_errors' end, case when n_click <> n_view then 'unrouted_requests' end) as taints
        from c""",
)
def session_audit(spark, sf):
    kind = F.col("event_type")
    counts = audit.session_counts(table(spark, sf, "events"), "user_id", {t: kind == t for t in EVENT_TYPES})
    reasons = {"page_errors": F.col("n_error") > 12, "unrouted_requests": F.col("n_click") != F.col("n_view")}
    return audit.session_taints(counts, EVENT_CAP, reasons)


@query(
    "session_expectations",
    """with c as (select user_id, count_if(event_type = 'signup')::bigint as s, count_if(event_type = 'purchase')::bigint as p from events group by 1)
       select user_id, 'signup' as event_type, 12::bigint as expected, s as actual from c where s <> 12
       union all select user_id, 'purchase', 13, p from c where p <> 13""",
)
def session_expectations(spark, sf):
    return audit.count_expectations(table(spark, sf, "events"), "user_id", "event_type", {"signup": 12, "purchase": 13})


HOST_PATTERN = "^[a-z]+://([^/]+)"


@query(
    "owned_bytes",
    f"""select regexp_extract(url, '{HOST_PATTERN}', 1) as host, count(*) as n_resources,
               coalesce(sum(case when not contains(url, 'utm_source') then strlen(html) end), 0)::bigint as owned_bytes,
               coalesce(sum(case when not contains(url, 'utm_source') then strlen(html) end), 0) <= 16384 as within_budget
        from pages group by 1""",
)
def owned_bytes(spark, sf):
    pages = table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", HOST_PATTERN, 1))
    return audit.owned_bytes(pages, "host", byte_length(F.col("html")), F.col("url").contains("utm_source"), 16384)


@query(
    "asset_reuse",
    """with a as (select source, sha256(unnest(string_split(text, chr(10)))) as sha256 from documents),
            b as (select sha256(unnest(string_split(text, chr(10)))) as sha256 from benchmark)
       select sha256, count(distinct source) as n_owners, min(source) as first_owner, count(*) as n_uses from a
       where sha256 not in (select sha256 from b) group by 1 having count(distinct source) > 1""",
)
def asset_reuse(spark, sf):
    lines = table(spark, sf, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    allowed = table(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("line"))
    assets = lines.select("source", sha256_hex(F.col("line")).alias("sha256"))
    return audit.asset_reuse(assets, "sha256", "source", allowed.select(sha256_hex(F.col("line")).alias("sha256")))


@query(
    "perf_report",
    """with v as (select event_type, case when event_id % 13 <> 0 then round_even(value * 100, 0)::bigint end as cents from events),
            r as (select *, row_number() over (partition by event_type order by cents nulls last) as rn, count(cents) over (partition by event_type) as n from v)
       select event_type, count(cents) as n_rows, count(*) - count(cents) as n_null, max(cents) as max_value, sum(cents)::bigint as sum_value,
              max(cents) filter (where rn = ceil(n * 50 / 100)) as p50, max(cents) filter (where rn = ceil(n * 95 / 100)) as p95 from r group by 1""",
)
def perf_report(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 13 != 0, F.rint(F.col("value") * 100)).cast("long").alias("cents"))
    return audit.percentile_report(rows, ["event_type"], "cents", {"p50": 500, "p95": 950}, F.expr("cents div 1024"))


def stream_of(spark, sf, name):
    """The given table, one file or a folder of files, as a stream of its files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid4().hex}"


def settled(spark, rows, folder):
    """The result of a finished stream, without the tables it was made from."""
    rows = cut_lineage(rows)
    delete_folder(spark, folder)
    return rows


@query(
    "stream_publish",
    f"select o_orderkey, {order_id_sql()} as publication_id from orders",
)
def stream_publish(spark, sf):
    """Orders arrive twice, the second copy of finished urgent orders altered: the first copy wins."""
    folder = scratch(spark)
    total = cents(F.col("o_totalprice"))
    copies = F.array(
        F.struct((F.col("o_orderkey") * 2).alias("ordinal"), order_id().alias("publication_id")),
        F.struct((F.col("o_orderkey") * 2 + 1).alias("ordinal"), F.when(stale(), order_id(total + 1)).otherwise(order_id()).alias("publication_id")),
    )
    incoming = stream_of(spark, sf, "orders").select("o_orderkey", F.explode(copies).alias("c")).select("o_orderkey", "c.*")
    publish_stream(
        incoming, f"{folder}/store", f"{folder}/checkpoint", "o_orderkey", "publication_id", "ordinal"
    ).awaitTermination()
    return settled(spark, spark.read.parquet(f"{folder}/store").select("o_orderkey", "publication_id"), folder)


@query(
    "stream_session_counts",
    "select user_id, event_type, (epoch_us(ts) // 86400000000)::bigint as day, count(*) as n from events group by 1, 2, 3",
)
def stream_session_counts(spark, sf):
    folder = scratch(spark)
    events = stream_of(spark, sf, "events").withColumn("at", F.timestamp_micros(epoch_micros("ts")))

    def added(batch):
        return sessions.session_counts(batch, "user_id", "event_type", "at")

    sessions.log_batches(events, added, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    logged = spark.read.parquet(f"{folder}/counts")
    day = F.floor(F.unix_micros("span_start") / 86_400_000_000).cast("long").alias("day")
    return settled(spark, sessions.total_counts(logged.select("user_id", "event_type", day, "n"), ["user_id", "event_type", "day"]), folder)


@query(
    "stream_late_activity",
    """with f as (select user_id, min(ts) as f from events where event_type = 'purchase' group by 1)
       select event_id, e.user_id, event_type from events e join f on e.user_id = f.user_id where ts > f""",
)
def stream_late_activity(spark, sf):
    folder = scratch(spark)
    done = (
        table(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("completed"))
    )

    def added(batch):
        late = sessions.late_activity(batch, done, "user_id", "ts", "completed", ["event_id"])
        return late.select("event_id", "user_id", "event_type")

    sessions.log_batches(stream_of(spark, sf, "events"), added, f"{folder}/late", f"{folder}/checkpoint").awaitTermination()
    return settled(spark, spark.read.parquet(f"{folder}/late").drop("batch"), folder)
