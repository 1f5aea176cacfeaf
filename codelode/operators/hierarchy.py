"""Parent-child links to paths, depths, roots and descendants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.operators.skew import spread_join
from codelode.session import cut

#: Siblings are ordered by id within runs of this many ids, then run by run; so no task
#: orders more siblings than this at once, however many one parent has.
RUN_BITS = 16


def edges(rows: DataFrame, node: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): distinct nodes ``v``, and ``(v, p)`` for those whose parent exists.

    Rows without an id are dropped. A node delivered with different parents keeps the least one.
    """
    pairs = rows.select(F.col(node).cast("long").alias("v"), F.col(parent).cast("long").alias("p")).where(F.col("v").isNotNull())
    pairs = cut(pairs.groupBy("v").agg(F.min("p").alias("p")))
    nodes = pairs.select("v")
    links = spread_join(pairs.where(F.col("p").isNotNull()), nodes.withColumnRenamed("v", "p"), ["p"], "left_semi", ["v"])
    return pairs, cut(links.select("v", "p"))


def peel(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(endless, cycle): nodes whose way up never ends, and those among them that lie on a cycle.

    Peels leaves in strides that double: the 2^k-th ancestors of all nodes are what is left
    after 2^k rounds of removing leaves. A node leaves the table when its way up is shorter
    than the stride. What neither leaves nor is peeled any more is the cycles and what
    hangs below them. Rounds are logarithmic in the depth.
    """
    jump = links.select("v", F.col("p").alias("up"))
    left, kept = jump.count(), -1
    while left:
        ahead = jump.select(F.col("v").alias("up"), F.col("up").alias("_next"))
        longer = cut(spread_join(jump, ahead, ["up"], "inner", ["v"]).select("v", F.col("_next").alias("up")))
        now = longer.count()
        if now == left:
            image = longer.select("up").distinct().count()
            if image == kept:
                break
            kept = image
        jump, left = longer, now
    return jump.select("v"), jump.select(F.col("up").alias("v")).distinct()


def next_siblings(links: DataFrame) -> DataFrame:
    """links plus ``nxt``, the next child of the same parent in order of ids, null for the last."""
    runs = links.withColumn("_run", F.shiftright("v", RUN_BITS))
    inside = runs.withColumn("nxt", F.lead("v").over(Window.partitionBy("p", "_run").orderBy("v")))
    # One row per run: its first child, and so the follower of the run before it.
    firsts = runs.groupBy("p", "_run").agg(F.min("v").alias("_first"))
    several = firsts.groupBy("p").agg(F.count(F.lit(1)).alias("_runs")).where("_runs > 1").select("p")
    # Only parents whose children fill several runs need the second level.
    chain = firsts.join(several, "p", "left_semi").withColumn("_first", F.lead("_first").over(Window.partitionBy("p").orderBy("_run"))).dropna()
    ends = inside.join(chain, ["p", "_run"], "left")
    return ends.select("v", "p", F.coalesce("nxt", "_first").alias("nxt"))


def euler_tour(links: DataFrame) -> DataFrame:
    """The tours of all trees as linked lists of arcs: (arc, nxt, n, w, root).

    Going down to node v is arc 2v, coming up from it is arc 2v + 1; at a leaf both are one
    element, 2v, that counts twice (``n``). ``w`` is the change of depth. The last arc of
    a tour has no ``nxt`` and knows the root. Ids must lie within 2^62 of zero.
    """
    down, up = F.col("v") * 2, F.col("v") * 2 + 1
    child = links.groupBy("p").agg(F.min("v").alias("first")).withColumnRenamed("p", "v")
    with_first = next_siblings(links).join(child, "v", "left")
    inner = spread_join(with_first, links.select(F.col("v").alias("p"), F.lit(True).alias("p_inner")), ["p"], "left", ["v"])
    # After the last child the tour comes up from the parent, or ends there if that is the root.
    after = F.when(F.col("nxt").isNotNull(), F.col("nxt") * 2).when(F.col("p_inner"), F.col("p") * 2 + 1)
    root = F.when(after.isNull(), F.col("p"))
    leaf = F.struct(down.alias("arc"), after.alias("nxt"), F.lit(2).cast("long").alias("n"), F.lit(0).cast("long").alias("w"), root.alias("root"))
    enter = F.struct(down.alias("arc"), (F.col("first") * 2).alias("nxt"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("w"), F.lit(None).cast("long").alias("root"))
    leave = F.struct(up.alias("arc"), after.alias("nxt"), F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("w"), root.alias("root"))
    return inner.select(F.explode(F.when(F.col("first").isNull(), F.array(leaf)).otherwise(F.array(enter, leave))).alias("a")).select("a.*")


def rank_lists(arcs: DataFrame) -> DataFrame:
    """List ranking by pointer jumping: (arc, n, w, root), n and w summed from the arc to its list's end.

    Every round doubles the stride of each arc that has not reached the end; finished arcs
    are not written again.
    """
    arcs = cut(arcs)
    done = arcs.where(F.col("nxt").isNull())
    active = arcs.where(F.col("nxt").isNotNull())
    while not active.isEmpty():
        ahead = done.unionByName(active).select(F.col("arc").alias("nxt"), F.col("nxt").alias("_nxt"), F.col("n").alias("_n"), F.col("w").alias("_w"), F.col("root").alias("_root"))
        stepped = cut(active.join(ahead, "nxt").select("arc", F.col("_nxt").alias("nxt"), (F.col("n") + F.col("_n")).alias("n"), (F.col("w") + F.col("_w")).alias("w"), F.col("_root").alias("root")))
        done = done.unionByName(stepped.where(F.col("nxt").isNull()))
        active = stepped.where(F.col("nxt").isNotNull())
    return done.select("arc", "n", "w", "root")


def ranked_nodes(links: DataFrame) -> DataFrame:
    """Per non-root node of a forest: v, root_id, depth, tour_in, tour_out.

    Tour positions count from the tour's end: a node's descendants are the nodes of the
    same root whose tour_in lies strictly between its tour_out and tour_in.
    """
    arcs = rank_lists(euler_tour(links))
    down = arcs.where(F.pmod("arc", F.lit(2)) == 0).select(F.expr("arc div 2").alias("v"), F.col("root").alias("root_id"), (1 - F.col("w")).alias("_d"), F.col("n").alias("tour_in"))
    up = arcs.where(F.pmod("arc", F.lit(2)) == 1).select(F.expr("(arc - 1) div 2").alias("v"), F.col("n").alias("_out"))
    both = down.join(up, "v", "left")
    # A leaf's single element has no change of depth, an inner node's way down has one.
    depth = F.when(F.col("_out").isNull(), F.col("_d")).otherwise(F.col("_d"))
    return both.select("v", "root_id", depth.alias("depth"), "tour_in", F.coalesce(F.col("_out"), F.col("tour_in") - 1).alias("tour_out"))


def depths_and_roots(rows: DataFrame, node: str = "id", parent: str = "parent_symbol_id") -> DataFrame:
    """(id, root_id, depth) of each node whose parent exists; root and depth are -1 if its way up never ends.

    Repeated rows count once, rows without an id are dropped, a parent that does not exist
    counts as none. No rows give no rows.
    """
    _, links = edges(rows, node, parent)
    endless, _ = peel(links)
    forest = links.join(endless, "v", "left_anti")
    ranked = ranked_nodes(forest).select(F.col("v").alias("id"), "root_id", "depth")
    minus = F.lit(-1).cast("long")
    return ranked.unionByName(endless.select(F.col("v").alias("id"), minus.alias("root_id"), minus.alias("depth")))


def paths(links: DataFrame) -> DataFrame:
    """(v, path): ids from the root to the node, for all nodes of a forest but its roots, by doubling strides."""
    done = None
    active = links.select("v", F.col("p").alias("up"), F.array("p").alias("path"))
    inner = links.select(F.col("v").alias("up"))
    active = cut(spread_join(active, inner.withColumn("_inner", F.lit(True)), ["up"], "left", ["v"]).withColumn("up", F.when(F.col("_inner"), F.col("up"))).drop("_inner"))
    done, active = active.where(F.col("up").isNull()), active.where(F.col("up").isNotNull())
    while not active.isEmpty():
        ahead = done.unionByName(active).select(F.col("v").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        stepped = cut(spread_join(active, ahead, ["up"], "inner", ["v"]).select("v", F.col("_up").alias("up"), F.concat("_path", "path").alias("path")))
        done = done.unionByName(stepped.where(F.col("up").isNull()))
        active = stepped.where(F.col("up").isNotNull())
    return done.select("v", F.concat("path", F.array("v")).alias("path"))


def full_hierarchy(rows: DataFrame, node: str = "id", parent: str = "parent_symbol_id") -> DataFrame:
    """One row per node: id, root_id, depth, path, n_descendants, tour_in, tour_out, status.

    status is ``root``, ``inner``, ``on_cycle`` or ``below_cycle``; nodes without a way up
    that ends have root and depth -1 and no path, tour or descendants. Descendants of a
    node are the nodes of its root with tour_in between its tour_out and its tour_in, so
    they are told by two numbers instead of a list that may hold every node.
    Nulls, repeats and empty input are treated as in ``depths_and_roots``.
    """
    pairs, links = edges(rows, node, parent)
    endless, cycle = peel(links)
    forest = cut(links.join(endless, "v", "left_anti"))
    ranked = cut(ranked_nodes(forest))
    inner = ranked.join(paths(forest), "v").select(
        F.col("v").alias("id"), "root_id", "depth", "path", F.expr("(tour_in - tour_out - 1) div 2").alias("n_descendants"), "tour_in", "tour_out", F.lit("inner").alias("status")
    )
    sizes = ranked.groupBy(F.col("root_id").alias("v")).agg(F.max("tour_in").alias("_n"))
    roots = pairs.select("v").join(links.select("v"), "v", "left_anti").join(sizes, "v", "left")
    n, zero, nothing, minus = F.coalesce(F.col("_n"), F.lit(0)), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(-1).cast("long")
    top = roots.select(F.col("v").alias("id"), F.col("v").alias("root_id"), zero.alias("depth"), F.array("v").alias("path"), F.expr("coalesce(_n, 0) div 2").alias("n_descendants"), (n + 1).alias("tour_in"), zero.alias("tour_out"), F.lit("root").alias("status"))
    lost = endless.join(cycle.withColumn("_on", F.lit(True)), "v", "left").select(
        F.col("v").alias("id"), minus.alias("root_id"), minus.alias("depth"), F.lit(None).cast("array<bigint>").alias("path"), nothing.alias("n_descendants"), nothing.alias("tour_in"), nothing.alias("tour_out"),
        F.when(F.col("_on"), "on_cycle").otherwise("below_cycle").alias("status"),
    )
    return top.unionByName(inner).unionByName(lost)
