"""Shingle, vector and component queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.catalogue.registry import query
from pairwright.catalogue.splits import block_sql
from pairwright.functions.canonical import sha256_hex
from pairwright.operators import graph, similarity as V, splits
from pairwright.session import cut_lineage
from pairwright.sources.tables import table


@query(
    "shingle_jaccard",
    r"""with t as (select doc_id as app, lang, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') as w from documents),
            s as (select app, lang, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) as h from t where len(w) >= 5),
            h as (select distinct 'all' as language, app, h from s union all select distinct lang, app, h from s),
            z as (select language, app, count(*) as n, sha256(string_agg(h, chr(10) order by h)) as d from h group by 1, 2),
            f as (select *, min(app) over (partition by language, d) as first from z),
            k as (select h.language, h.app, h.h, n from h join f on h.language = f.language and h.app = f.app where f.app = first),
            p as (select a.language, a.app as "left", b.app as "right", a.n as n_left, b.n as n_right, count(*) as n_both
                  from k a join k b on a.language = b.language and a.h = b.h and a.app < b.app group by all
                  union all select language, first, app, n, n, n from f where app <> first)
       select *, n_both * 1000000 // (n_left + n_right - n_both) as jaccard_ppm from p
       where n_both * 1000000 >= (case when language = 'all' then 550000 else 700000 end) * (n_left + n_right - n_both)""",
)
def shingle_jaccard(spark, sf):
    # a document stands for an application
    return V.shingle_similarity(table(spark, sf, "documents"), "doc_id", "lang", "text")


PAIRS_SQL = """p as (select a.vec_id // 2 as pair, a.embedding::double[] as x, b.embedding::double[] as y from embeddings a join embeddings b on a.vec_id // 2 = b.vec_id // 2
    where a.vec_id % 2 = 0 and b.vec_id % 2 = 1)"""
MOMENTS_SQL = (
    PAIRS_SQL
    + """, m as (select pair, len(x) as n, list_sum(x) / len(x) as mx, list_sum(y) / len(y) as my, list_sum(list_transform(x, lambda v: v * v)) as xx,
       list_sum(list_transform(y, lambda v: v * v)) as yy, list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])) as xy from p),
     r as (select pair, xy / sqrt(xx * yy) as layout, ((2 * mx * my + 0.0001::double) * (2 * (xy / n - mx * my) + 0.0009::double)) /
        ((mx * mx + my * my + 0.0001::double) * (xx / n - mx * mx + yy / n - my * my + 0.0009::double)) as structure from m)"""
)


def vector_pairs(spark, sf):
    return V.matched_vectors(
        table(spark, sf, "embeddings"), F.expr("vec_id div 2"), F.col("vec_id") % 2 == 0, "embedding"
    )


@query(
    "array_change",
    f"with {PAIRS_SQL} select pair, round_even(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) * 1000000, 0)::bigint as change_ppm from p",
)
def array_change(spark, sf):
    change = V.absolute_change(F.col("before"), F.col("after"))
    return vector_pairs(spark, sf).select("pair", F.rint(change * 1_000_000).cast("long").alias("change_ppm"))


@query(
    "array_ssim",
    f"with {MOMENTS_SQL} select pair, round_even(structure * 1000000, 0)::bigint as structure_ppm from r",
)
def array_ssim(spark, sf):
    index = V.structure_index(F.col("before"), F.col("after"))
    return vector_pairs(spark, sf).select("pair", F.rint(index * 1_000_000).cast("long").alias("structure_ppm"))


@query(
    "dual_similarity",
    f"""with {MOMENTS_SQL} select pair, round_even(layout * 1000000, 0)::bigint as layout_ppm, round_even(structure * 1000000, 0)::bigint as structure_ppm,
        layout >= 0.1 and structure >= 0.1 as flagged from r""",
)
def dual_similarity(spark, sf):
    before, after = F.col("before"), F.col("after")
    flags = V.conjunctive_flags(
        vector_pairs(spark, sf), ["pair"], V.cosine(before, after), V.structure_index(before, after), 0.1, 0.1
    )
    return flags.select(
        "pair",
        F.rint(F.col("layout") * 1_000_000).cast("long").alias("layout_ppm"),
        F.rint(F.col("structure") * 1_000_000).cast("long").alias("structure_ppm"),
        "flagged",
    )


RELATION_SQL = """m as (select distinct doc_id, h from (select doc_id, sha256(unnest(string_split(text, chr(10)))) as h, unnest(string_split(text, chr(10))) as line from documents) where line <> ''),
   e as (select doc_id as u, first_value(doc_id) over (partition by h order by doc_id) as v from m)"""


def shared_line_edges(spark, sf):
    """Documents related by sharing a whole line."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    members = lines.where("line <> ''").select("doc_id", sha256_hex(F.col("line")).alias("digest")).distinct()
    return graph.star_edges(cut_lineage(members), "digest", "doc_id")


@query(
    "dup_components",
    f"""with recursive {RELATION_SQL}, s as (select u, v from e where u <> v union select v, u from e where u <> v),
          r(node, root) as (select u, u from s union select s.v, r.root from r join s on r.node = s.u where r.root < s.v),
          c as (select node, min(root) as component from r group by 1),
          b as (select c.*, {block_sql("source")} as block from c join documents on node = doc_id)
        select component, count(*) as n_items, count(distinct block) as n_blocks, count(distinct block) > 1 as crosses from b group by 1""",
)
def dup_components(spark, sf):
    labels = graph.connected_components(shared_line_edges(spark, sf))
    blocks = table(spark, sf, "documents").select("doc_id", splits.block_of(F.col("source")).alias("block"))
    return graph.crossing_components(labels, blocks, "doc_id", "block")
