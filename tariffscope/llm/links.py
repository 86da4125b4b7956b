"""Components of links within buckets without all pairs, and connected components, as rounds of joins."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffscope.llm.common import Scratch


# Members of a bucket that are all compared with each other; in a larger one, so many of them at first lead the others, and
# four times as many in each later round, so that a bucket of S members takes about log4(S / 16) rounds.
FEW, LEADERS, GROWTH = 16, 4, 4
BROADCAST_BUCKETS = 1_000_000


def linked_roots(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    plausible: Column | None = None,
    thin: Callable[[DataFrame], DataFrame] | None = None,
    fits: Column | None = None,
) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for members (bucket, node) linked to others. Links are the
    pairs in one bucket that ``verify`` accepts.

    In a bucket of at most FEW members, all are compared. In a larger one some lead: one of each of so many groups of its
    nodes, and one of each of so many groups of its components. They are compared with all members of other components and then leave
    the bucket. A bucket goes when one component holds what is left of it. So no pair is given up unless it was
    compared or its ends are connected, and a bucket of one family costs a few comparisons for each
    member, however large it is.

    ``verify`` takes distinct pairs (node, leader) and returns those that match, stored; pairs that are not
    ``plausible`` by their values alone never reach it. ``thin`` takes the members of large buckets before any is
    compared, and gives them buckets in which those that match still meet, with ``held``, whatever tells of a member in a bucket that it need not meet
    another there: pairs in these buckets whose ``held`` and ``leader_held`` do not make ``fits`` are passed over.
    """
    # Most members share no bucket with any other: they go before rows are dealt out by bucket or stored.
    shared = scratch.keep(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    small = shared.count() <= BROADCAST_BUCKETS
    rest, tried, roots = members.join(F.broadcast(shared) if small else shared, "bucket"), None, None
    held, meet = F.lit(None).cast("long").alias("held"), F.lit(True)
    if thin is not None:
        crowded = scratch.keep(rest.where(f"n > {FEW}").select("bucket", "node"), "crowded")
        if not crowded.isEmpty():
            thinned = thin(crowded).select("bucket", "node", "held")
            held, meet = F.lit(None).cast(thinned.schema["held"].dataType).alias("held"), F.expr("held is null or leader_held is null") | fits
            rest = rest.where(f"n <= {FEW}").select("bucket", "node", held).union(thinned)
    rest = rest if "held" in rest.columns else rest.select("bucket", "node", held)
    for n in count():
        root = F.lit(None).cast(members.schema["node"].dataType) if roots is None else F.col("root")
        labelled = rest if roots is None else rest.join(roots, "node", "left")
        labelled = scratch.keep(labelled.select("bucket", "node", "held", F.coalesce(root, "node").alias("root")), f"labelled{n}")
        if n:
            scratch.drop(f"placed{n - 1}", f"leaders{n - 1}", f"labelled{n - 1}")
        sizes = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
        placed = scratch.keep(labelled.join(sizes.where("low != high").select("bucket", "size"), "bucket"), f"placed{n}")
        if placed.isEmpty():
            break
        few, many = placed.where(f"size <= {FEW}"), placed.where(f"size > {FEW}")
        groups = LEADERS * GROWTH**n
        by = F.explode(F.array(*(
            F.struct(F.lit(k).alias("kind"), F.pmod(F.xxhash64(c, F.lit(n)), F.lit(groups)).alias("group")) for k, c in enumerate(("node", "root"))
        )))
        first = F.min(F.struct(F.xxhash64("node").alias("order"), "node", "root", "held")).alias("first")
        leaders = many.select("bucket", "node", "root", "held", by.alias("by")).groupBy("bucket", "by").agg(first)
        leaders = scratch.keep(leaders.select("bucket", *_leading("first.")).distinct(), f"leaders{n}")
        pairs = few.join(few.select("bucket", *_leading()), "bucket")
        pairs = pairs.where("node > leader and root != leader_root").where(meet).select("node", "leader")
        led = many.join(leaders, "bucket").where("root != leader_root").where(meet)
        pairs = pairs.union(led.select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader")))
        pairs = (pairs if plausible is None else pairs.where(plausible)).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["node", "leader"], "left_anti")
        pairs = scratch.keep(pairs, f"pairs{n}")
        tried = pairs if tried is None else tried.union(pairs)
        if not pairs.isEmpty():
            roots = _joined(roots, verify(pairs).toDF("a", "b"), scratch, n)
        rest = many.select("bucket", "node", "held").join(leaders.select("bucket", F.col("leader").alias("node")), ["bucket", "node"], "left_anti")
    if roots is None:
        return members.select("node", F.col("node").alias("root")).limit(0)
    return roots


def _leading(of: str = "") -> list[Column]:
    return [F.col(of + c).alias(name) for c, name in (("node", "leader"), ("root", "leader_root"), ("held", "leader_held"))]


def _joined(roots: DataFrame | None, links: DataFrame, scratch: Scratch, n: int) -> DataFrame | None:
    """``roots`` (node, root) after components at both ends of ``links`` (a, b) became one. Only roots are
    nodes of the graph that is searched, so later rounds cost as much as they add."""
    if links.isEmpty():
        return roots
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    if roots is None:
        known = scratch.keep(ends.select("node", F.col("node").alias("root")), f"known{n}")
    else:
        known = scratch.keep(roots.union(ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))), f"known{n}")
    edges = links.join(known.toDF("a", "root_a"), "a").join(known.toDF("b", "root_b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    merged = components(edges, scratch).toDF("root", "low")
    return scratch.keep(known.join(merged, "root", "left").select("node", F.coalesce("low", "root").alias("root")), f"joined{n}")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The smallest node of each node's component, for the nodes in ``edges`` (a, b).

    Each round every node points to the smallest of its neighbours and itself, and edges move to what their
    ends point to, until none is left. Sizes halve at least, apart from long descending chains'
    ends, and a node with many neighbours is one row of a partial aggregate.
    """
    scratch = Scratch(scratch.spark, "components")
    edges = scratch.keep(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges"
    )
    roots = None
    for n in count():
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("at"), F.least("a", "b").alias("low"))
        lowest = scratch.keep(lowest, f"lowest{n}")
        if roots is None:
            roots = lowest.select(F.col("at").alias("node"), F.col("low").alias("root"))
        else:
            roots = roots.join(lowest, roots.root == lowest["at"], "left").select(
                "node", F.coalesce("low", "root").alias("root")
            )
        roots = scratch.keep(roots, f"roots{n}")
        moved = edges.join(lowest.toDF("a", "low_a"), "a").join(lowest.toDF("b", "low_b"), "b")
        moved = moved.select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))
        edges = scratch.keep(moved.where("a != b").distinct(), f"edges{n}")
        scratch.drop(f"lowest{n}", *([f"roots{n - 1}", f"edges{n - 1}"] if n else ["edges"]))
        if edges.isEmpty():
            return roots
