"""Fixed-point, colour, parsing and path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.catalogue.registry import query
from pairwright.functions import scalars as S
from pairwright.sources.tables import table

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


@query(
    "quantize_q64",
    """select l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 8 + l_discount, 0)::bigint as rounded,
              case when abs(round_even((l_extendedprice * 4) * 64, 0)) <= 16777216 then round_even((l_extendedprice * 4) * 64, 0)::bigint end as q64 from lineitem""",
)
def quantize_q64(spark, sf):
    return table(spark, sf, "lineitem").select(
        *LINE_KEYS,
        S.round_ties_even(F.col("l_quantity") / 8 + F.col("l_discount")).alias("rounded"),
        S.quantize_q64(F.col("l_extendedprice") * 4).alias("q64"),
    )


@query(
    "box_clip",
    """with b as (select *, l_quantity as x, l_extendedprice / 1000 as y, l_linenumber * 3.0 as cx, l_tax * 100 as cy, l_discount * 100 as sx, l_suppkey * 0.5 as sy,
                  l_returnflag <> 'N' or l_linestatus <> 'O' as clips from lineitem)
       select l_orderkey, l_linenumber, l_partkey, round_even((x - sx) * 64, 0)::bigint as box_x, round_even((y - sy) * 64, 0)::bigint as box_y,
              case when clips then round_even((x + cx - sx) * 64, 0)::bigint end as clip_x, case when clips then round_even((y + cy - sy) * 64, 0)::bigint end as clip_y,
              case when clips then round_even(x * 64, 0)::bigint end as clip_width from b""",
)
def box_clip(spark, sf):
    def box(x, y):
        return F.struct(x.alias("x"), y.alias("y"), F.col("l_quantity").alias("width"), F.lit(1.0).alias("height"))

    scroll_x, scroll_y = F.col("l_discount") * 100, F.col("l_suppkey") * 0.5
    page = box(F.col("l_quantity"), F.col("l_extendedprice") / 1000)
    client = box(F.col("l_linenumber") * 3.0, F.col("l_tax") * 100)
    overflow_x = F.when(F.col("l_returnflag") == "N", "visible").otherwise("hidden")
    overflow_y = F.when(F.col("l_linestatus") == "O", "visible").otherwise("auto")
    rows = table(spark, sf, "lineitem").select(
        *LINE_KEYS,
        S.shift_box(page, scroll_x, scroll_y).alias("box"),
        S.overflow_clip(page, client, overflow_x, overflow_y, scroll_x, scroll_y).alias("clip"),
    )

    def q64(path, name):
        return S.round_ties_even(F.col(path) * S.Q64_SCALE).alias(name)

    return rows.select(
        *LINE_KEYS,
        q64("box.x", "box_x"),
        q64("box.y", "box_y"),
        q64("clip.x", "clip_x"),
        q64("clip.y", "clip_y"),
        q64("clip.width", "clip_width"),
    )


LINEAR_SQL = "case when {c} / 255.0::double <= 0.04045 then {c} / 255.0::double / 12.92 else pow(({c} / 255.0::double + 0.055) / 1.055, 2.4) end"


def luminance_sql(r: str, g: str, b: str) -> str:
    return (
        f"0.2126::double * ({LINEAR_SQL.format(c=r)}) + 0.7152::double * ({LINEAR_SQL.format(c=g)}) "
        f"+ 0.0722::double * ({LINEAR_SQL.format(c=b)})"
    )


@query(
    "contrast_ratio",
    f"""with c as (select p_partkey, p_partkey % 256 as r, (p_partkey * 7) % 256 as g, p_size * 6 as b, p_size * 4 as k from part),
             l as (select *, {luminance_sql("r", "g", "b")} as f, {luminance_sql("k", "k", "k")} as h from c)
        select p_partkey, case when b <= 255 and k <= 255 then floor((greatest(f, h) + 0.05) / (least(f, h) + 0.05) * 1000 + 0.5)::bigint end as ratio_milli from l""",
)
def contrast_ratio(spark, sf):
    def rgb(*channels):
        parts = [c.cast("string") for c in channels]
        return F.concat(F.lit("rgb("), F.concat_ws(", ", *parts), F.lit(")"))

    part, grey = F.col("p_partkey"), F.col("p_size") * 4
    texts = table(spark, sf, "part").select(
        "p_partkey",
        rgb(part % 256, (part * 7) % 256, F.col("p_size") * 6).alias("foreground"),
        rgb(grey, grey, grey).alias("background"),
    )
    ratio = S.contrast_milli(S.parse_rgb(F.col("foreground")), S.parse_rgb(F.col("background")))
    return texts.select("p_partkey", ratio.alias("ratio_milli"))


@query(
    "numeric_parse",
    """with t as (select event_id, case event_type when 'click' then '0.' || lpad((round_even(value * 100, 0)::bigint % 1000)::varchar, 3, '0') when 'error' then '1.0' when 'view' then '.5' when 'signup' then '0' else '1.5' end as o,
                  case event_type when 'click' then (event_id - 5000)::varchar when 'error' then 'auto' when 'view' then '-0' when 'signup' then '0' || event_id else (event_id * 1000000)::varchar end as z from events)
       select event_id, case when regexp_matches(o, '^(?:0(?:\\.\\d+)?|1(?:\\.0+)?)$') then round_even(o::double * 1000, 0)::bigint end as opacity_milli,
              case when regexp_matches(z, '^-?(?:0|[1-9]\\d*)$') and z <> '-0' and abs(try_cast(z as hugeint)) <= 2147483647 then try_cast(z as bigint) end as z_index,
              z <> 'auto' and not (regexp_matches(z, '^-?(?:0|[1-9]\\d*)$') and z <> '-0' and abs(try_cast(z as hugeint)) <= 2147483647) as z_malformed from t""".replace("\\\\", "\\"),
)
def numeric_parse(spark, sf):
    kind, key = F.col("event_type"), F.col("event_id")
    milli = F.rint(F.col("value") * 100).cast("long") % 1000
    opacity = (
        F.when(kind == "click", F.concat(F.lit("0."), F.lpad(milli.cast("string"), 3, "0")))
        .when(kind == "error", "1.0")
        .when(kind == "view", ".5")
        .when(kind == "signup", "0")
        .otherwise("1.5")
    )
    z_index = (
        F.when(kind == "click", (key - 5000).cast("string"))
        .when(kind == "error", "auto")
        .when(kind == "view", "-0")
        .when(kind == "signup", F.concat(F.lit("0"), key.cast("string")))
        .otherwise((key * 1_000_000).cast("string"))
    )
    texts = table(spark, sf, "events").select("event_id", opacity.alias("opacity"), z_index.alias("z"))
    return texts.select(
        "event_id",
        S.parse_opacity(F.col("opacity")).alias("opacity_milli"),
        S.parse_z_index(F.col("z")).alias("z_index"),
        S.z_index_malformed(F.col("z")).alias("z_malformed"),
    )


URL_PATH = "^[a-z]+://[^/]+/([^?#]*)"


@query(
    "path_safety",
    f"""with p as (select page_id, regexp_extract(url, '{URL_PATH}', 1) as path, case when url like 'http://%' then '../' else '' end || regexp_extract(url, '{URL_PATH}', 1) || case when url like '%#top' then '%2f' else '' end as q from pages)
        select page_id, path, (path like '/%' or path like '%/' or path like '%//%') as unsafe,
               (q like '/%' or q like '%/' or q like '%//%' or q like '../%' or contains(q, chr(92)) or contains(q, '%')) as strictly_unsafe from p""",
)
def path_safety(spark, sf):
    path = F.regexp_extract("url", URL_PATH, 1)
    climbed = F.concat(
        F.when(F.col("url").startswith("http://"), "../").otherwise(""),
        path,
        F.when(F.col("url").endswith("#top"), "%2f").otherwise(""),
    )
    rows = table(spark, sf, "pages").select("page_id", path.alias("path"), climbed.alias("climbed"))
    return rows.select(
        "page_id",
        "path",
        S.unsafe_path(F.col("path")).alias("unsafe"),
        S.unsafe_path(F.col("climbed"), strict=True).alias("strictly_unsafe"),
    )


@query(
    "path_ancestors",
    f"""with p as (select distinct regexp_extract(url, '^[a-z]+://([^?#]*)', 1) as path from pages), s as (select path, string_split(path, '/') as parts from p),
             d as (select array_to_string(list_slice(parts, 1, n), '/') as directory from s, range(1, 20) r(n) where n < len(parts))
        select distinct directory from d""",
)
def path_ancestors(spark, sf):
    paths = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))
    return paths.select(F.explode(S.path_ancestors(F.col("path"))).alias("directory")).distinct()


@query(
    "param_order",
    r"""with q as (select page_id, regexp_extract(url, '\?([^#]*)', 1) || case when url like 'https://%' then '&page=9' else '' end as query from pages),
             n as (select page_id, query, list_transform(string_split(query, '&'), lambda p: string_split(p, '=')[1]) as names from q)
        select page_id, query, query <> '' and list_sort(list_distinct(names)) <> names as out_of_order from n""",
)
def param_order(spark, sf):
    text = F.concat(
        F.regexp_extract("url", r"\?([^#]*)", 1), F.when(F.col("url").startswith("https://"), "&page=9").otherwise("")
    )
    rows = table(spark, sf, "pages").select("page_id", text.alias("query"))
    return rows.select("page_id", "query", S.parameters_out_of_order(F.col("query"), "&").alias("out_of_order"))
