"""Graph operators on edge tables, by joins iterated until nothing new is found; RuntimeError after `most` rounds where given."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.session import materialise


def _rounds(most: int | None, what: str) -> Iterator[int]:
    for n in count():
        if most is not None and n >= most:
            raise RuntimeError(f"{what} did not settle in {most} rounds")
        yield n


def closure(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node): every node reachable from each start (node), itself included.

    Cycles end by themselves, as only new pairs go on; unknown nodes are their own closure.
    """
    step = edges.select(F.col("src"), F.col("dst")).distinct()
    reached = materialise(starts.select(F.col("node").alias("start"), F.col("node")).distinct(), "reach")
    front = reached
    for _ in _rounds(most, "closure"):
        nxt = front.join(step, front["node"] == step["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = materialise(nxt.join(reached, ["start", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        reached = materialise(reached.unionByName(front), "reach")
    return reached


def cycle_nodes(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node): nodes that lie on a cycle, a loop included."""
    return strong_components(edges, most).select("node")


def _merged(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round of trimming and merging of edges (src, dst, loops included): (edges left, cyclic nodes, merges, loops of merged nodes).

    A node that has no other node before it or behind it is on no cycle but its loop. A node with a single one before it,
    or a single one behind it, is merged into that node if it is not itself merged: of neighbours that could be, the one
    of least hash is, so chains and rings lose about a third of their nodes in each round.
    """
    real = edges.where("src <> dst")
    into = real.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("src").alias("before"))
    out = real.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("after"))
    loop = edges.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    one_in = F.coalesce(F.col("n_in") == 1, F.lit(False))
    nodes = into.join(out, "node", "full").join(loop, "node", "full").select(
        "node", F.coalesce("loop", F.lit(False)).alias("loop"), (F.col("n_in").isNull() | F.col("n_out").isNull()).alias("gone"), one_in.alias("by_in"),
        F.when(one_in, F.col("before")).when(F.col("n_out") == 1, F.col("after")).alias("partner"), F.xxhash64("node", F.lit(n)).alias("h"),
    )
    nodes = materialise(nodes, "nodes")
    wish = nodes.where("NOT gone AND partner IS NOT NULL")
    rival = wish.groupBy(F.col("partner").alias("node")).agg(F.min("h").alias("rival"))
    other = nodes.select(F.col("node").alias("partner"), F.when(F.col("partner").isNotNull(), F.col("h")).alias("partner_h"), F.col("gone").alias("partner_gone"))
    free = wish.join(other, "partner").join(rival, "node", "left").where("NOT partner_gone AND (partner_h IS NULL OR h < partner_h) AND (rival IS NULL OR h < rival)")
    role = free.select("node", "partner", "by_in", "loop").unionByName(nodes.where("gone").select("node", F.lit(None).cast(nodes.schema["partner"].dataType).alias("partner"), F.lit(False).alias("by_in"), "loop"))
    role = materialise(role, "roles")
    of = lambda side: role.select(F.col("node").alias(side), F.lit(True).alias(f"{side}_role"), F.col("partner").alias(f"{side}_to"), F.col("by_in").alias(f"{side}_in"))
    e = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    e = e.where("NOT (src_role IS NOT NULL AND src_to IS NULL) AND NOT (dst_role IS NOT NULL AND dst_to IS NULL)")
    # neither the edge that ties a node to its partner nor its loop goes on
    e = e.where("NOT coalesce(dst_in AND src = dst_to, false) AND NOT coalesce(NOT src_in AND dst = src_to, false) AND NOT (src = dst AND src_role IS NOT NULL)")
    e = e.withColumn("s", F.coalesce("src_to", "src")).withColumn("d", F.coalesce("dst_to", "dst"))
    e = materialise(e.select("src", "dst", "src_to", "src_in", "dst_to", "dst_in", "s", "d"), "mapped")
    merges = e.where("src_in").select(F.col("src").alias("node"), F.col("src_to").alias("partner"), F.col("d").alias("other"))
    merges = merges.unionByName(e.where("NOT dst_in").select(F.col("dst").alias("node"), F.col("dst_to").alias("partner"), F.col("s").alias("other")))
    left = materialise(e.select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct(), "left")
    cyclic = role.where("loop AND partner IS NULL").select("node")
    return left, cyclic, merges, role.where("partner IS NOT NULL").select("node", "loop")


def _coloured(edges: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """(node, component) of one strong component at least in each part of edges, and the edges that may hold others.

    Forwards each node takes the least node that reaches it as its colour; backwards a colour's node collects those of its
    colour that reach it. Edges between colours are in no cycle.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colour = materialise(nodes.withColumn("colour", F.col("node")), "colours")
    front = colour
    for _ in _rounds(most, "strong_components"):
        offered = edges.join(front, edges["src"] == front["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
        front = materialise(offered.join(colour, "node").where("new < colour").select("node", F.col("new").alias("colour")), "front")
        if front.isEmpty():
            break
        colour = materialise(colour.unionByName(front).groupBy("node").agg(F.min("colour").alias("colour")), "colours")
    of = lambda side: colour.select(F.col("node").alias(side), F.col("colour").alias(f"{side}_colour"))
    inner = edges.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour")
    inner = materialise(inner.select("src", "dst", F.col("src_colour").alias("colour")), "inner")
    reached = front = materialise(colour.where("node = colour"), "reached")
    for _ in _rounds(most, "strong_components"):
        back = inner.drop("colour").join(front, inner["dst"] == front["node"]).select(F.col("src").alias("node"), "colour").distinct()
        front = materialise(back.join(reached, ["node", "colour"], "left_anti"), "front")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)  # parts that stay as they were written
    reached = materialise(reached, "reached")
    loops = edges.where("src = dst").select(F.col("src").alias("colour"))
    several = reached.where("node <> colour").select("colour").union(loops).distinct()
    found = materialise(reached.join(several, "colour", "left_semi").select("node", F.col("colour").alias("component")), "found")
    gone = reached.select("node")
    left = inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return found, materialise(left.select("src", "dst"), "left")


def strong_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component): nodes of edges (src, dst) that lie on a cycle, by the least node of their strongly connected component.

    Rounds of trimming and merging shrink chains, trees and rings by a constant share each; where they stall, forward
    and backward colouring takes components out, in as many rounds as paths in what is left are long. What is shuffled
    are edges and nodes, never pairs of nodes. Merged nodes are judged afterwards, last ones first: one is in its
    partner's component if its other edges lead there. Null ends are dropped; an empty table gives no rows.
    """
    left = materialise(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "strong")
    size, found, levels = left.count(), [], []
    for n in _rounds(most, "strong_components"):
        if not size:
            break
        left, cyclic, merges, merged = _merged(left, n)
        found.append(cyclic.select("node", F.col("node").alias("component")))
        levels.append((len(found), merges, merged))
        now = left.count()
        if now and now > 0.9 * size:
            strong, left = _coloured(left, most)
            found.append(strong)
            now = left.count()
        size = now
    kind = edges.select("src").schema["src"].dataType
    part = lambda parts: reduce(DataFrame.unionByName, parts) if parts else edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    done: list[DataFrame] = []
    for k, merges, merged in reversed(levels):
        done, found = found[k:] + done, found[:k]
        known = part(done)
        a, b = (known.select(F.col("node").alias(x), F.col("component").alias(f"{x}_of")) for x in ("partner", "other"))
        inside = merges.join(a, "partner").join(b, "other").where("partner_of = other_of").select("node", F.col("partner_of").alias("component")).distinct()
        # its own component, if a loop is all that it is on
        judged = merged.join(inside, "node", "left").select("node", F.coalesce("component", F.when(F.col("loop"), F.col("node"))).alias("component")).where("component IS NOT NULL")
        done.append(materialise(judged, "judged"))
    all_ = part(found + done)
    least = all_.groupBy("component").agg(F.min("node").alias("least"))
    return all_.join(least, "component").select("node", F.col("least").alias("component"))


def bounded_bfs(members: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, depth) within `depth` steps over shared keys: members (node, key), starts (node)."""
    if not 0 <= depth <= 3:
        raise ValueError("depth has to be 0 to 3")
    seen = starts.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        keys = members.join(front.select("node"), "node", "left_semi").select("key").distinct()
        found = members.join(keys, "key", "left_semi").select("node").distinct().join(seen.select("node"), "node", "left_anti")
        front = materialise(found.withColumn("depth", F.lit(d)), "bfs")
        seen = seen.unionByName(front)
    return seen


def components(edges: DataFrame, nodes: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the least node reachable over undirected edges (src, dst)."""
    found = stars(edges.select(F.col("src").alias("x"), F.col("dst").alias("y")), most)
    own = nodes.select("node").distinct()
    return own.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def stars(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of links (x, y), for each node but the least of its component, by alternating stars.

    Each round hangs neighbours on the least node around, first the greater then the smaller
    ones, until the edges stay as they are; hubs are met by partial aggregates and joins that
    can be split. Edges get fewer by the round, and only they are shuffled.
    """
    ordered = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(ordered(links.select(F.col("x").alias("u"), F.col("y").alias("v"))), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(edges)
    for _ in range(most):
        if not was[0]:
            break
        # large star: greater neighbours of u go to the least node around u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ordered(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: u and its smaller neighbours go to the least of them
        large = materialise(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        own = large.join(least, "u")
        small = own.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(ordered(small), "edges")
        now = mark(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def clusters(members: DataFrame) -> DataFrame:
    """(node, component) of nodes that share keys: members (node, key). Each node is linked with the
    least node of its key, so a key with many nodes gives as many edges and no more."""
    hub = members.groupBy("key").agg(F.min("node").alias("dst"))
    edges = members.join(hub, "key").select(F.col("node").alias("src"), "dst").distinct()
    return components(edges, members.select("node").distinct())


def shortest(edges: DataFrame, sources: DataFrame, held: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """(start, node, distance) from each of sources (node) over edges (src, dst, weight[, needs]).

    An edge counts only if all it needs is held. Distances are relaxed round by round until no
    one falls, which weights of 0 or more make sure of; ValueError if one is less.
    """
    usable = edges
    if "needs" in edges.columns:
        usable = edges.where(F.size(F.array_except(F.coalesce("needs", F.array().cast("array<string>")), F.lit(list(held or [])).cast("array<string>"))) == 0)
    step = usable.groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight"))
    if not step.where("weight < 0").isEmpty():
        raise ValueError("weights have to be 0 or more")
    best = materialise(sources.select(F.col("node").alias("start"), "node", F.lit(0.0).alias("distance")).distinct(), "dist")
    front = best
    for _ in _rounds(most, "shortest"):
        tried = front.join(step, front["node"] == step["src"]).groupBy("start", F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("new"))
        front = tried.join(best, ["start", "node"], "left").where("distance IS NULL OR new < distance").select("start", "node", F.col("new").alias("distance"))
        front = materialise(front, "front")
        if front.isEmpty():
            break
        best = materialise(best.unionByName(front).groupBy("start", "node").agg(F.min("distance").alias("distance")), "dist")
    return best
