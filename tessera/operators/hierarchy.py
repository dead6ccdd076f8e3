"""Parent-child links to full hierarchies: root, depth, path, descendants and circles.

Connected components are found by label propagation with pointer jumping; each component is
co-located in one task and walked depth-first with node colouring. A component that is too big for
one task is resolved by pointer doubling over the whole cluster instead; both give the same rows.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.scale import discard, materialize

LINEAGE_TYPES = ("superseded_by", "merged_into", "fulfilled_by")
#: Nodes of a component up to which one task walks it.
WALK_NODES = 5_000
#: Components are packed into tasks by a hash with so many values for each shuffle partition.
PACKS = 8
RESULT = T.StructType([T.StructField("relationship_type", T.StringType()), T.StructField("memory_id", T.LongType()), T.StructField("root_id", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("cycle", T.ArrayType(T.LongType()))])


def type_form(c: Column) -> Column:
    """Type names without regard to case, outer spaces and how the words are joined."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[-_\s]+", "_")


def lineage_links(links: DataFrame, types: tuple[str, ...] = LINEAGE_TYPES) -> DataFrame:
    """(relationship_type, child, parent); rows with a null end or another type are left out."""
    e = links.select(type_form(F.col("relationship_type")).alias("relationship_type"), F.col("source_memory_id").cast("bigint").alias("child"), F.col("target_memory_id").cast("bigint").alias("parent"))
    return e.where(F.col("relationship_type").isin(*types) & F.col("child").isNotNull() & F.col("parent").isNotNull())


def lineage_edges(links: DataFrame, types: tuple[str, ...] = LINEAGE_TYPES) -> DataFrame:
    """Distinct :func:`lineage_links`; a child with several parents in a type keeps the one with the least id, so that a path is unique."""
    return lineage_links(links, types).groupBy("relationship_type", "child").agg(F.min("parent").alias("parent"))


def other_parents(links: DataFrame, types: tuple[str, ...] = LINEAGE_TYPES) -> DataFrame:
    """(relationship_type, child, parent): distinct links by which no path goes, as the child has a lesser parent."""
    kept = lineage_edges(links, types).withColumnRenamed("parent", "least")
    return lineage_links(links, types).distinct().join(kept, ["relationship_type", "child"]).where("parent <> least").drop("least")


def connected_components(edges: DataFrame, a: str, b: str, keys: list[str] | None = None, max_rounds: int = 60) -> DataFrame:
    """(keys, node, component): component is the least node id reachable over undirected edges.

    Each round hooks the larger of two neighbouring labels to the smaller one and then halves the
    label chains, so rounds grow with the logarithm of the longest chain. Every round is written to
    the shared folder; only a count reaches the driver.
    """
    keys = keys or []
    e = materialize(edges.where(F.col(a) != F.col(b)).select(*keys, F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    nodes = edges.select(*keys, F.explode(F.array(a, b)).alias("node")).distinct()
    label = materialize(nodes.withColumn("component", F.col("node")))
    for _ in range(max_rounds):
        if e.limit(1).count() == 0:
            break
        # hook: the roots of two neighbours; the larger root points to the least root beside it
        least = e.select(*keys, F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).groupBy(*keys, "node").agg(F.min("to").alias("to"))
        # jump: follow hooks of hooks until none moves; chains are short as targets are always smaller
        hooks = last = materialize(least)
        while True:
            up = hooks.select(*keys, F.col("node").alias("to"), F.col("to").alias("up"))
            nxt = materialize(hooks.join(up, [*keys, "to"], "left").select(*keys, "node", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved")))
            moved = nxt.where("moved").limit(1).count()
            discard(last)
            hooks, last = nxt.drop("moved"), nxt
            if not moved:
                break
        h = hooks.withColumnRenamed("node", "component")
        old = (label, e, last)
        label = materialize(label.join(h, [*keys, "component"], "left").select(*keys, "node", F.coalesce("to", "component").alias("component")))
        ha, hb = hooks.select(*keys, F.col("node").alias("a"), F.col("to").alias("ta")), hooks.select(*keys, F.col("node").alias("b"), F.col("to").alias("tb"))
        e = e.join(ha, [*keys, "a"], "left").withColumn("a", F.coalesce("ta", "a")).drop("ta").join(hb, [*keys, "b"], "left").withColumn("b", F.coalesce("tb", "b")).drop("tb")
        e = materialize(e.where("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(*old)  # what a round was made from is not read again
    else:  # each round at least halves the labels that have neighbours
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return label


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Depth-first traversal of whole components with node colouring (white, grey, black)."""
    out: list[tuple] = []
    for kind, part in rows.groupby("relationship_type", sort=False):
        child, parent = part["child"].tolist(), part["parent"].tolist()
        up = dict(zip(child, parent, strict=True))
        down: dict[int, list[int]] = defaultdict(list)
        for c, p in up.items():
            down[p].append(c)
        colour = dict.fromkeys([*child, *parent], 0)
        for root in sorted(n for n in colour if n not in up):
            stack = [(root, 0, str(root))]
            while stack:
                node, depth, path = stack.pop()
                colour[node] = 2
                out.append((kind, node, root, depth, path, None))
                stack += [(c, depth + 1, f"{path}/{c}") for c in sorted(down[node], reverse=True)]
        for start in sorted(n for n, k in colour.items() if k == 0):
            trail, node = [], start
            while colour[node] == 0:  # grey: on the trail; meeting a grey node closes a circle
                colour[node] = 1
                trail.append(node)
                node = up[node]
            circle = sorted(trail[trail.index(node) :]) if colour[node] == 1 else []
            for n in trail:
                colour[n] = 2
                out.append((kind, n, -1, -1, "", circle if n in circle else None))
    return pd.DataFrame(out, columns=[f.name for f in RESULT.fields])


def _doubled(edges: DataFrame) -> DataFrame:
    """The same rows for components of any size: pointer doubling with joins, log2(depth) rounds.

    A pointer that has not come to a root after more steps than there are nodes is in a circle. All nodes
    of a circle meet themselves in the same round, where their pointers have the whole circle.
    """
    nodes = edges.select("relationship_type", F.explode(F.array("child", "parent")).alias("memory_id")).distinct()
    limit = edges.count() + 1
    p = nodes.join(edges.withColumnRenamed("child", "memory_id"), ["relationship_type", "memory_id"], "left")
    p = materialize(p.select("relationship_type", "memory_id", F.col("parent").alias("at"), F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<bigint>")).alias("up"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("bigint").alias("steps"), F.lit(None).cast("array<bigint>").alias("cycle")))
    step = 1
    while step < limit:
        # pointers with a next stop are joined with that stop's own pointer; the others are done
        q = p.select("relationship_type", F.col("memory_id").alias("at"), F.col("at").alias("at2"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        open_, done = p.where("at IS NOT NULL"), p.where("at IS NULL")
        # a node on a circle would make its path grow without end: it is cut when the node meets itself
        moved = open_.join(q, ["relationship_type", "at"], "left")
        circling = F.array_contains("up", F.col("memory_id")) | F.exists("up2", lambda x: x == F.col("memory_id")) | (F.size(F.array_distinct(F.concat("up", "up2"))) < F.size("up") + F.size("up2")) | (F.col("steps2") < 0)
        moved = moved.select("relationship_type", "memory_id", F.when(circling, F.lit(None).cast("bigint")).otherwise(F.col("at2")).alias("at"), F.when(circling, F.array().cast("array<bigint>")).otherwise(F.concat("up", "up2")).alias("up"), F.when(circling, F.lit(-1).cast("bigint")).otherwise(F.col("steps") + F.col("steps2")).alias("steps"), F.when(circling & F.array_contains(F.concat("up", "up2"), F.col("memory_id")), F.array_sort(F.slice(F.concat("up", "up2"), 1, F.array_position(F.concat("up", "up2"), F.col("memory_id")).cast("int")))).alias("cycle"))
        old, p = p, materialize(done.unionByName(moved))
        discard(old)
        if p.where("at IS NOT NULL").limit(1).count() == 0:
            break
        step *= 2
    circle = (F.col("steps") < 0) | F.col("at").isNotNull()
    return p.select(
        "relationship_type",
        "memory_id",
        F.when(circle, F.lit(-1).cast("bigint")).when(F.size("up") == 0, F.col("memory_id")).otherwise(F.element_at("up", -1)).alias("root_id"),
        F.when(circle, F.lit(-1)).otherwise(F.size("up")).cast("int").alias("depth"),
        F.when(circle, F.lit("")).otherwise(F.array_join(F.concat(F.reverse("up"), F.array("memory_id")), "/")).alias("path"),
        "cycle",
    )


def hierarchies(links: DataFrame, types: tuple[str, ...] = LINEAGE_TYPES, walk_nodes: int = WALK_NODES) -> DataFrame:
    """(relationship_type, memory_id, root_id, depth, path, cycle) for each id of each lineage type.

    Ids on a circle, or whose parents lead into one, have root_id -1, depth -1 and an empty path; an
    id on a circle also has the circle's ids in ``cycle``. A link to itself is a circle. A child goes by its
    least parent; an id that is only another parent of it is a root of its own. Repeated and null-ended links change nothing; no links give no rows.
    """
    edges = materialize(lineage_edges(links, types))
    component = connected_components(edges, "child", "parent", ["relationship_type"])
    sizes = component.groupBy("relationship_type", "component").agg(F.count(F.lit(1)).alias("nodes"))
    placed = edges.join(component.join(sizes, ["relationship_type", "component"]).withColumnRenamed("node", "child"), ["relationship_type", "child"])
    placed = materialize(placed)
    packs = PACKS * int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = placed.where(F.col("nodes") <= walk_nodes).withColumn("pack", F.pmod(F.xxhash64("relationship_type", "component"), F.lit(packs)))
    walked = small.groupBy("pack").applyInPandas(_walk, RESULT)
    lone = lineage_links(links, types).select("relationship_type", F.col("parent").alias("node")).distinct().join(component, ["relationship_type", "node"], "left_anti")
    walked = walked.unionByName(lone.select("relationship_type", F.col("node").alias("memory_id"), F.col("node").alias("root_id"), F.lit(0).alias("depth"), F.col("node").cast("string").alias("path"), F.lit(None).cast("array<bigint>").alias("cycle")))
    if placed.where(F.col("nodes") > walk_nodes).limit(1).count() == 0:
        return walked
    return walked.unionByName(_doubled(placed.where(F.col("nodes") > walk_nodes).select("relationship_type", "child", "parent")))


def descendants(tree: DataFrame) -> DataFrame:
    """(relationship_type, memory_id, descendant_id, distance): one row for each pair on a path.

    ``tree`` comes from :func:`hierarchies`; ids in circles have no descendants here.
    """
    d = tree.where("depth > 0").select("relationship_type", F.col("memory_id").alias("descendant_id"), "depth", F.split("path", "/").alias("p"))
    d = d.select("relationship_type", "descendant_id", "depth", F.posexplode(F.slice("p", 1, F.col("depth"))).alias("i", "a"))
    return d.select("relationship_type", F.col("a").cast("bigint").alias("memory_id"), "descendant_id", (F.col("depth") - F.col("i")).alias("distance"))
