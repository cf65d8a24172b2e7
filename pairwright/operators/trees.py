"""Bounded rooted trees kept as node tables ``(scope..., node, parent, ordinal)``.

Everything rests on pointer jumping over rows of constant size: a row holds one link to an ancestor, and each round the link and what
was summed on the way double their reach. A tree 64 edges deep needs seven rounds, a chain of 100,000 nodes seventeen; rounds follow
the depth, not the size, and no row ever lists ancestors or children. No depth is cut: rounds go on until every link has ended or is
proven to run in a circle. Children are only ever counted, summed or numbered, so fan-out is not bounded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.keyed import attach, blocked_window, null_safe_join
from pairwright.operators.rules import violations
from pairwright.session import Rounds, cut_lineage

MAXIMUM_DEPTH = 64
SIBLING_BLOCK = 1 << 16

ROOTED, LOST, CIRCLE, ENDLESS = "rooted", "lost", "circle", "endless"


def climb(
    nodes: DataFrame, node: str = "node", parent: str = "parent", scope: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None, sizes: bool = False, carry: Sequence[str] = (),
) -> DataFrame:
    """``(scope..., node, carry..., top, depth, state, sums..., size)`` of every node; node ids are unique.

    ``top`` is the last node above and ``depth`` the number of edges, counting one to a missing parent. ``sums`` are totals along the line from the
    node itself upwards; ``size`` counts the nodes of the subtree. ``state`` is ``rooted``, ``lost`` (the line ends at a
    parent that is no node), ``circle`` (on one) or ``endless`` (below one); sums and sizes of the last two mean nothing.

    A link that is still open reaches over 2^round edges, so sizes grow by what exactly that many edges below has gathered.
    """
    scope = list(scope)
    keys = [*scope, node]
    sums = dict(sums or {})
    carried = ["depth", *sums]
    rows = nodes.select(
        *keys, *[F.col(name).alias(f"_carry_{name}") for name in carry], F.col(parent).alias("_jump"), F.col(node).alias("top"), F.col(parent).isNotNull().cast("long").alias("depth"),
        *[value.cast("long").alias(name) for name, value in sums.items()], F.lit(False).alias("_lost"), F.lit(1).cast("long").alias("size"),
    )
    kept = [f"_carry_{name}" for name in carry]
    rounds = Rounds(nodes.sparkSession)
    rows, last = rounds.keep(rows), (0, 0)
    while (now := _still(rows, scope, last)) != (0, 0) and now != last:
        last = now
        target = rows.select(
            *scope, F.col(node).alias("_jump"), F.col("_jump").alias("_next"), F.col("top").alias("_top"), F.col("_lost").alias("_ends"),
            *[F.col(name).alias(f"_{name}") for name in carried],
        )
        grown = rows
        if sizes:
            below = rows.where("_jump is not null").groupBy(*scope, F.col("_jump").alias(node)).agg(F.sum("size").alias("_below"))
            more = F.col("size") + F.coalesce("_below", F.lit(0))
            grown = null_safe_join(rows, below, keys, "left").withColumn("size", more).select(*rows.columns)
        still = rows.where("_jump is not null")
        moved = attach(grown.where("_jump is not null"), target, [*scope, "_jump"], how="left", spread=[node], hot_from=still)
        moved = moved.select(
            *keys, *kept, F.col("_next").alias("_jump"), F.coalesce("_top", "top").alias("top"),
            *[(F.col(name) + F.coalesce(f"_{name}", F.lit(0))).alias(name) for name in carried],
            # a link that meets no node is lost
            F.coalesce("_ends", F.lit(True)).alias("_lost"), "size",
        ).select(*rows.columns)
        moved = grown.where("_jump is null").unionByName(moved)
        rows = rounds.keep(moved)
    rows = rounds.close(rows)
    carried = [F.col(f"_carry_{name}").alias(name) for name in carry]
    out = [*keys, *carried, "top", "depth", "state", *sums, *(["size"] if sizes else [])]
    if now == (0, 0):
        return rows.withColumn("state", F.when(F.col("_lost"), LOST).otherwise(ROOTED)).select(*out)
    # the targets that are left are the circles
    met = rows.where(F.col("_jump").isNotNull()).select(*scope, F.col("_jump").alias(node)).distinct().withColumn("_met", F.lit(True))
    state = F.when(F.col("_met"), CIRCLE).when(F.col("_jump").isNotNull(), ENDLESS).when(F.col("_lost"), LOST).otherwise(ROOTED)
    return null_safe_join(rows, met, keys, "left").withColumn("state", state).select(*out)


def _still(rows: DataFrame, scope: Sequence[str], last: tuple[int, int]) -> tuple[int, int]:
    """How many links are open and, once a round has closed none, how many targets they have.

    A line that ends has nodes at every distance from its end, so each round closes some of it: when a round closes none, what is open
    never ends. Targets only become fewer, and when a round leaves them as many, the links map them onto themselves: they are
    the nodes of the circles.
    """
    open_ = rows.where("_jump is not null")
    count = open_.count()
    return count, open_.select(*scope, "_jump").distinct().count() if count == last[0] else 0


def tree_issues(
    nodes: DataFrame, node: str = "node", parent: str = "parent", scope: Sequence[str] = (), maximum_depth: int = MAXIMUM_DEPTH
) -> DataFrame:
    """Integrity of the trees: ``(scope..., node, code)``; the root count violation has a null node."""
    keys = [*scope, node]
    facts = nodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(parent).alias(parent), F.max(parent).alias("_other"),
        F.count_if(F.col(parent).isNull()).alias("_roots"),
    )
    repeated = violations(
        facts,
        keys,
        {
            "tree.duplicate_id": F.col("_n") > 1,
            "tree.two_parents": (F.col(parent) != F.col("_other")) | ((F.col("_roots") > 0) & F.col(parent).isNotNull()),
        },
    )
    reach = reach_issues(climb(facts, node, parent, scope), keys, "tree", maximum_depth)
    roots = nodes.groupBy(*scope).agg(F.count_if(F.col(parent).isNull()).alias("_roots"))
    wrong = roots.where("_roots <> 1").select(
        *scope, F.lit(None).cast("string").alias(node), F.lit("tree.root_count").alias("code")
    )
    return repeated.unionByName(reach).unionByName(wrong)


def reach_issues(climbed: DataFrame, keys: Sequence[str], prefix: str, maximum_depth: int = MAXIMUM_DEPTH) -> DataFrame:
    """What is wrong with the way from each node to its root."""
    state, depth = F.col("state"), F.col("depth")
    rules = {
        f"{prefix}.dangling_parent": (state == LOST) & (depth == 1),
        f"{prefix}.disconnected": ((state == LOST) & (depth > 1)) | (state == ENDLESS),
        f"{prefix}.cycle": state == CIRCLE,
        f"{prefix}.depth": state.isin(ROOTED, LOST) & (depth > maximum_depth),
    }
    return violations(climbed, keys, rules)


def child_list_issues(
    nodes: DataFrame, lists: DataFrame, node: str = "node", parent: str = "parent", child: str = "child", ignored: str | None = None,
    scope: Sequence[str] = (), maximum_depth: int = MAXIMUM_DEPTH, prefix: str = "accessibility",
) -> DataFrame:
    """Trees told twice, by parent pointers and by child lists: ``(scope..., node, child, code)``.

    ``lists`` has a row ``(scope..., node, child)`` for every entry of a child list, so no list is ever held whole. The lists decide: the
    parent of a node is the node that lists it (the smallest, if several do), and a pointer that is not null must agree. Both
    tables are merged in one aggregation per id.

    ``dangling_child`` names the listing node and the unknown child, ``duplicate_child`` every node that lists a child listed
    more than once, ``parent_mismatch`` the listing node (null: none) and the child. The other codes name the child alone:
    ``duplicate_node_id``, ``dangling_parent`` for pointers, ``cycle``, ``disconnected`` and ``depth`` along the lists, ``root`` for an ignored
    root. ``root_count`` has neither: nodes nobody lists are roots, and a scope must have one. Null ids and entries are null nodes,
    one to a scope.
    """
    scope = list(scope)
    kind = dict(nodes.dtypes)[node]
    nothing = F.lit(None).cast(kind)
    own = nodes.select(
        *scope, F.col(node).alias("_id"), F.lit(1).alias("_is"), F.col(parent).cast(kind).alias("_parent"),
        (F.coalesce(F.col(ignored), F.lit(False)) if ignored else F.lit(False)).alias("_ignored"), nothing.alias("_lister"), F.lit(0).alias("_entry"),
    )
    entries = lists.select(
        *scope, F.col(child).cast(kind).alias("_id"), F.lit(0).alias("_is"), nothing.alias("_parent"), F.lit(None).cast("boolean").alias("_ignored"),
        F.col(node).cast(kind).alias("_lister"), F.lit(1).alias("_entry"),
    )
    ids = cut_lineage(
        own.unionByName(entries).groupBy(*scope, "_id").agg(
            F.sum("_is").alias("_n"), F.sum("_entry").alias("_listed"), F.min("_parent").alias("_parent"), F.min("_lister").alias("_lister"),
            F.bool_or("_ignored").alias("_ignored"),
        )
    )
    known = ids.where("_n > 0")

    def named(frame: DataFrame, lister: Column, code: str) -> DataFrame:
        return frame.select(*scope, lister.alias(node), F.col("_id").alias(child), F.lit(f"{prefix}.{code}").alias("code"))

    faulty = ids.where("_n = 0 or _listed > 1").select(*scope, F.col("_id").alias(child), "_n", "_listed")
    listing = lists.select(*scope, F.col(node).cast(kind).alias(node), F.col(child).cast(kind).alias(child)).distinct()
    entry_rules = {f"{prefix}.dangling_child": F.col("_n") == 0, f"{prefix}.duplicate_child": F.col("_listed") > 1}
    entry_issues = violations(attach(listing, faulty, [*scope, child], spread=[node]), [*scope, node, child], entry_rules)

    targets = known.select(*scope, F.col("_id").alias("_parent")).withColumn("_named", F.lit(True))
    pointed = attach(known.where("_parent is not null"), targets, [*scope, "_parent"], how="left", spread=["_id"])
    lost = named(pointed.where("_named is null"), nothing, "dangling_parent")
    differs = pointed.where("_named and _listed <= 1 and not (_parent <=> _lister)")
    mismatched = named(differs, F.col("_lister"), "parent_mismatch")

    climbed = climb(known.select(*scope, F.col("_id").alias(child), F.when(F.col("_listed") > 0, F.col("_lister")).alias("_up")), child, "_up", scope)
    # the lists' own parents exist unless the lister is no node, which cuts its children off
    state = F.when((F.col("state") == LOST) & (F.col("depth") == 1), F.lit(ENDLESS)).otherwise(F.col("state"))
    reach = reach_issues(climbed.withColumn("state", state), [*scope, child], prefix, maximum_depth).withColumn(node, nothing)
    tops = known.where("_listed = 0")
    hidden = named(tops.where("_ignored"), nothing, "root")
    roots = known.groupBy(*scope).agg(F.count_if(F.col("_listed") == 0).alias("_roots"))
    count = roots.where("_roots <> 1").select(*scope, nothing.alias(node), nothing.alias(child), F.lit(f"{prefix}.root_count").alias("code"))
    doubled = named(ids.where("_n > 1"), nothing, "duplicate_node_id")
    out = doubled
    for part in (entry_issues, lost, mismatched, reach, hidden, count):
        out = out.unionByName(part)
    return out.select(*scope, node, child, "code")


def intervals(
    nodes: DataFrame, node: str = "node", parent: str = "parent", ordinal: str = "ordinal", scope: Sequence[str] = ()
) -> DataFrame:
    """``(scope..., node, parent, top, depth, size, enter, above)``: a subtree is the indexes from ``enter`` to ``enter + size - 1`` of its tree.

    ``above`` is the parent's index. A node's index is the sum, along its line, of one plus the sizes of the earlier siblings' subtrees. Sizes and sums climb by
    pointer jumping and sibling sums run in blocks: no sort sees a whole tree. Nodes on or below circles have no index.
    """
    scope = list(scope)
    keys = [*scope, node]
    rows = nodes.select(*keys, F.col(parent).alias("_up"), F.col(ordinal).alias("_at"))
    sized = climb(rows, node, "_up", scope, sizes=True, carry=["_up", "_at"])
    block = F.floor(F.col("_at") / SIBLING_BLOCK)
    summed = blocked_window(sized.where("_up is not null"), [*scope, "_up"], ["_at"], block, running={"_upto": F.col("size")})
    # a node whose parent is missing heads its own tree
    heads = F.col("top").eqNullSafe(F.col(node))
    summed = summed.withColumn("_step", F.when(heads, 0).otherwise(F.col("_upto") - F.col("size") + 1)).drop("_upto")
    steps = summed.unionByName(sized.where("_up is null").withColumn("_step", F.lit(0)))
    told = {"_top": F.col("top"), "_depth": F.col("depth"), "_size": F.col("size")}
    indexed = climb(steps.withColumns(told), node, "_up", scope, sums={"_enter": F.col("_step")}, carry=["_up", *told, "_step"])
    fine = F.col("state").isin(ROOTED, LOST)
    return indexed.select(
        *keys, F.col("_up").alias(parent), F.col("_top").alias("top"), F.col("_depth").alias("depth"), F.col("_size").alias("size"),
        F.when(fine, F.col("_enter")).alias("enter"), F.when(fine & (F.col("_top") != F.col(node)), F.col("_enter") - F.col("_step")).alias("above"),
    )


def preorder(
    nodes: DataFrame, node: str = "node", parent: str = "parent", ordinal: str = "ordinal", scope: Sequence[str] = ()
) -> DataFrame:
    """``(scope..., node, parent, index, parent_index, depth)`` in depth-first order; indexes on or below circles are null."""
    placed = intervals(nodes, node, parent, ordinal, scope)
    return placed.select(*scope, node, parent, F.col("enter").alias("index"), F.col("above").alias("parent_index"), "depth")


def nearest_retained(
    nodes: DataFrame, retained: Column, node: str = "node", parent: str = "parent", scope: Sequence[str] = ()
) -> DataFrame:
    """``(scope..., node, nearest, distance)``: the closest proper ancestor that is retained, for nodes that have one.

    Links double only while they point at nodes that are not retained, so rounds follow the longest run of those.
    """
    scope = list(scope)
    keys = [*scope, node]
    rounds = Rounds(nodes.sparkSession)
    rows = rounds.keep(
        nodes.select(
            *keys, F.coalesce(retained, F.lit(False)).alias("_kept"), F.col(parent).alias("_jump"),
            F.lit(None).cast(dict(nodes.dtypes)[parent]).alias("nearest"), F.lit(1).cast("long").alias("distance"),
        )
    )
    last = 0
    while (count := rows.where("_jump is not null").count()) != last:
        last = count
        target = rows.select(
            *scope, F.col(node).alias("_jump"), F.col("_kept").alias("_stop"), F.col("_jump").alias("_next"),
            F.col("nearest").alias("_found"), F.col("distance").alias("_more"),
        )
        moved = attach(rows.where("_jump is not null"), target, [*scope, "_jump"], how="left", spread=[node])
        stop = F.col("_stop")
        moved = moved.select(
            *keys, "_kept", F.when(~stop, F.col("_next")).alias("_jump"), F.when(stop, F.col("_jump")).otherwise(F.col("_found")).alias("nearest"),
            # a parent that is no node ends the line
            (F.col("distance") + F.when(~stop, F.col("_more")).otherwise(0)).alias("distance"),
        )
        moved = rows.where("_jump is null").unionByName(moved)
        rows = rounds.keep(moved)
    return rounds.close(rows).where("nearest is not null").select(*keys, "nearest", "distance")


def exclude_subtrees(
    nodes: DataFrame, excluded: DataFrame, node: str = "node", parent: str = "parent", scope: Sequence[str] = ()
) -> DataFrame:
    """Nodes that are not excluded and have no excluded ancestor."""
    keys = [*scope, node]
    flags = excluded.select(*keys).distinct().withColumn("_cut", F.lit(1).cast("long"))
    marked = null_safe_join(nodes.select(*keys, parent), flags, keys, "left")
    return climb(marked, node, parent, scope, sums={"_cuts": F.coalesce("_cut", F.lit(0))}).where("_cuts = 0").select(*keys)


def splice(
    nodes: DataFrame, ignored: Column, node: str = "node", parent: str = "parent", ordinal: str = "ordinal", scope: Sequence[str] = ()
) -> DataFrame:
    """Drop ignored nodes and lift their children, in order, to the nearest kept ancestor.

    ``(scope..., node, parent, ordinal)``: new sibling ordinals follow the original depth-first order.
    """
    scope = list(scope)
    keys = [*scope, node]
    order = intervals(nodes, node, parent, ordinal, scope).select(*keys, "enter")
    lifted = nearest_retained(nodes, ~ignored, node, parent, scope)
    kept = nodes.where(~ignored).select(*keys)
    rows = cut_lineage(null_safe_join(null_safe_join(kept, order, keys), lifted, keys, "left"))
    children = rows.where("nearest is not null").select(*keys, F.col("nearest").alias(parent), "enter")
    block = F.floor(F.col("enter") / SIBLING_BLOCK)
    numbered = blocked_window(children, [*scope, parent], ["enter"], block, position=ordinal).drop("enter")
    zero = F.lit(0).cast("long")
    tops = rows.where("nearest is null").select(*keys, F.lit(None).cast(dict(nodes.dtypes)[parent]).alias(parent), zero.alias(ordinal))
    return numbered.select(*keys, parent, ordinal).unionByName(tops)


def preorder_issues(
    rows: DataFrame, index: str = "index", parent: str = "parent_index", ordinal: str = "child_ordinal",
    scope: Sequence[str] = (), maximum_depth: int = MAXIMUM_DEPTH,
) -> DataFrame:
    """Validity of stored preorder arrays: ``(scope..., index, code)``.

    A subtree is reopened when a node's parent is neither the previous node nor one of its ancestors, which two intervals of the
    tree that the parents make decide. A parent that is no node is only dangling, one that lies ahead is only out of order, and
    depth counts along parents that lie before.
    """
    scope = list(scope)
    keys = [*scope, index]
    block = F.floor(F.col(index) / SIBLING_BLOCK)
    lies_before = F.col(parent) < F.col(index)
    backward = rows.select(*keys, F.when(lies_before, F.col(parent)).alias("_up"), F.col(index).alias("_order"))
    spans = cut_lineage(
        intervals(backward, index, "_up", "_order", scope).select(
            *keys, F.col("top").alias("_top"), F.col("enter").alias("_from"), "size", F.col("depth").alias("_depth")
        )
    )
    placed = blocked_window(rows, scope, [index], block, position="_at")
    siblings = blocked_window(placed.where(lies_before), [*scope, parent], [index], block, position="_expected").select(*keys, "_expected")
    before = spans.select(*scope, (F.col(index) + 1).alias(index), F.col("_top").alias("_last_top"), F.col("_from").alias("_last_from"))
    above = spans.select(*scope, F.col(index).alias(parent), F.col("_top").alias("_above_top"), F.col("_from").alias("_above_from"), F.col("size").alias("_above_size"))
    joined = null_safe_join(null_safe_join(null_safe_join(placed, siblings, keys, "left"), before, keys, "left"), spans.select(*keys, "_depth"), keys)
    joined = attach(joined, above, [*scope, parent], how="left", spread=[index], hot_from=rows)
    root = F.col(index) == 0
    exists = F.col("_above_from").isNotNull() & F.col(parent).isNotNull()
    offset = F.col("_last_from") - F.col("_above_from")
    inside = (F.col("_above_top") == F.col("_last_top")) & (offset >= 0) & (offset < F.col("_above_size"))
    rules = {
        "tree.node_index": F.col(index) != F.col("_at"),
        "tree.root_parent": root & F.col(parent).isNotNull(),
        "tree.root_ordinal": root & (F.col(ordinal) != 0),
        "tree.dangling_parent": ~root & ~exists,
        "tree.parent_order": ~root & exists & ~lies_before,
        "tree.preorder": ~root & exists & lies_before & ~F.coalesce(inside, F.lit(False)),
        "tree.child_order": ~root & exists & lies_before & (F.col(ordinal) != F.col("_expected")),
        "tree.depth": F.col("_depth") > maximum_depth,
    }
    return violations(joined, keys, rules)


def edit_costs(baseline: DataFrame, candidate: DataFrame, scope: str, path: str, label: str) -> DataFrame:
    """Keyed edit cost of two trees per scope: nodes inserted, deleted and relabelled by path key.

    This is a declared cost over path keys and not a minimal tree edit distance; paths are unique per
    side.
    """
    marked = baseline.select(scope, path, F.col(label).alias("_b"), F.lit(None).cast("string").alias("_c")).unionByName(
        candidate.select(scope, path, F.lit(None).cast("string").alias("_b"), F.col(label).alias("_c"))
    )
    merged = marked.groupBy(scope, path).agg(F.max("_b").alias("_b"), F.max("_c").alias("_c"))
    costs = merged.groupBy(scope).agg(
        F.count_if(F.col("_b").isNull()).alias("inserts"),
        F.count_if(F.col("_c").isNull()).alias("deletes"),
        F.count_if(F.col("_b") != F.col("_c")).alias("relabels"),
    )
    return costs.withColumn("cost", F.col("inserts") + F.col("deletes") + F.col("relabels"))


# Normalized accessibility roles, and the aliases browsers report for them.
ROLES = (
    "alert", "article", "banner", "button", "cell", "checkbox", "columnheader", "combobox", "complementary",
    "contentinfo", "definition", "dialog", "document", "form", "generic", "group", "heading", "img", "link",
    "list", "listbox", "listitem", "main", "menu", "menuitem", "navigation", "option", "paragraph",
    "progressbar", "radio", "region", "row", "rowheader", "search", "separator", "slider", "spinbutton",
    "status", "switch", "tab", "table", "tabpanel", "term", "text", "textbox",
)
ROLE_ALIASES = {
    "RootWebArea": "document",
    "WebArea": "document",
    "LabelText": "generic",
    "MenuListPopup": "listbox",
    "StaticText": "text",
    "InlineTextBox": "text",
    "LineBreak": "text",
    "LayoutTable": "table",
    "LayoutTableRow": "row",
    "LayoutTableCell": "cell",
    "DescriptionList": "list",
    "sectionfooter": "generic",
    "sectionheader": "heading",
    "strong": "generic",
    "none": "generic",
    "presentation": "generic",
}


def role_alias(raw: Column, aliases: dict[str, str] = ROLE_ALIASES, roles: Sequence[str] = ROLES) -> Column:
    """Alias first, then the allowlist; null for any other role."""
    table = F.create_map(*[F.lit(part) for pair in aliases.items() for part in pair])
    return F.coalesce(F.try_element_at(table, raw), F.when(raw.isin(*roles), raw))


# Accessibility properties by how their value becomes a state.
BOOLEAN_STATES = (
    "busy", "disabled", "focused", "hidden", "modal", "multiline", "multiselectable", "readonly", "required",
    "selected",
)
TRISTATE = ("checked", "pressed")
EDITABLE_VALUES = ("true", "plaintext", "richtext")
INVALID_VALUES = ("true", "grammar", "spelling")


def property_state(name: Column, value: Column) -> Column:
    """State of one property (values as text); null when it sets none or the property is unknown."""
    return (
        F.when(name.isin(*BOOLEAN_STATES), F.when(value == "true", name))
        .when(
            name.isin(*TRISTATE),
            F.when(value == "true", name).when(value == "mixed", F.concat(name, F.lit(":mixed"))),
        )
        .when(name == "expanded", F.when(value == "true", "expanded").when(value == "false", "collapsed"))
        .when(name == "editable", F.when(value.isin(*EDITABLE_VALUES), "editable"))
        .when(name == "invalid", F.when(value.isin(*INVALID_VALUES), "invalid"))
    )


# What the value of a property may be; other properties are not looked at.
STATE_VALUES = {
    **{name: ("true", "false") for name in (*BOOLEAN_STATES, "expanded")},
    **{name: ("true", "false", "mixed") for name in TRISTATE},
    "editable": (*EDITABLE_VALUES, "false", "none"),
    "invalid": (*INVALID_VALUES, "false"),
}
LONGEST_PROPERTY_NAME = 64


def state_issues(properties: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """``(keys..., name, code)``: names that are null, empty or over 64 characters, names a node has twice, and values no state knows.

    A null value of a known property is bad. One row per node, name and code.
    """
    table = F.create_map(*[part for key, allowed in STATE_VALUES.items() for part in (F.lit(key), F.array(*map(F.lit, allowed)))])
    allowed = F.try_element_at(table, F.coalesce(F.col(name), F.lit("")))
    bad = allowed.isNotNull() & ~F.coalesce(F.array_contains(allowed, F.col(value)), F.lit(False))
    named = properties.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(bad).alias("_bad"))
    length = F.length(name)
    rules = {
        "accessibility.property_name": length.isNull() | ~length.between(1, LONGEST_PROPERTY_NAME),
        "accessibility.duplicate_property": F.col("_n") > 1,
        "accessibility.state_value": F.col("_bad"),
    }
    return violations(named, [*keys, name], rules)


# The closed vocabulary of states, sorted.
STATES = tuple(
    sorted([*BOOLEAN_STATES, *TRISTATE, *[f"{name}:mixed" for name in TRISTATE], "collapsed", "editable", "expanded", "invalid"])
)


def state_sets(properties: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """Sorted state set per node; properties outside the closed vocabulary are ignored.

    States are numbered bits of one integer per node, so nothing is collected.
    """
    vocabulary = F.array(*[F.lit(state) for state in STATES])
    state = property_state(F.col(name), F.col(value))
    at = F.array_position(vocabulary, state).cast("int") - 1
    bit = F.when(at >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), at))
    masks = properties.select(*keys, bit.alias("_bit")).groupBy(*keys).agg(
        F.coalesce(F.bit_or("_bit"), F.lit(0).cast("long")).alias("_mask")
    )
    present = F.filter(vocabulary, lambda state, i: F.getbit(F.col("_mask"), i) == 1)
    return masks.select(*keys, present.alias("states"))
