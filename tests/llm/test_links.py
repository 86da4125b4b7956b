import random

from pyspark.sql import functions as F

from tariffscope.llm.common import Scratch
from tariffscope.llm.links import FEW, LEADERS, components, linked_roots


def roots_of(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_chains_stars_and_cycles(spark):
    draw = random.Random(1)
    chain = draw.sample(range(1000), 40)
    edges = list(zip(chain, chain[1:])) + [(2000, k) for k in range(2001, 2060)] + [(5, 5), (3001, 3002), (3002, 3003), (3003, 3001)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    want = roots_of((a, b) for a, b in edges if a != b)
    assert {r.node: r.root for r in found.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_a_large_bucket_is_linked_without_all_pairs(spark):
    size, families = 600, 3
    members = spark.range(size).select(F.lit(7).cast("long").alias("bucket"), F.col("id").alias("node"))
    compared = []

    def verify(pairs):
        compared.append(pairs.count())
        return pairs.where(F.col("node") % families == F.col("leader") % families)

    roots = {r.node: r.root for r in linked_roots(members, verify, Scratch(spark, "t"), F.expr("node % 3 = leader % 3")).collect()}
    assert roots == {k: k % families for k in range(size)}
    assert sum(compared) <= 2 * LEADERS * size

    small = members.where(F.col("node") < FEW)
    roots = linked_roots(small, lambda p: p, Scratch(spark, "t"), F.expr("node - leader = 1"))
    assert {r.node: r.root for r in roots.collect()} == {k: 0 for k in range(FEW)}


def test_no_link_is_lost_in_a_large_bucket(spark):
    """Only neighbours of a chain match, and one in ten of its nodes matches nothing; the chain is found whole, beyond FEW members too."""
    for size in (FEW + 1, 120):
        members = spark.range(size).select(F.lit(1).cast("long").alias("bucket"), F.xxhash64("id", F.lit(4)).alias("node"), "id")
        places = members.select("node", "id").cache()
        chained = lambda a, b: f"abs({a} - {b}) <= 2 and {a} % 10 != 9 and {b} % 10 != 9"

        def verify(pairs):
            placed = pairs.join(places.toDF("node", "x"), "node").join(places.toDF("leader", "y"), "leader")
            return placed.where(chained("x", "y")).select("node", "leader")

        roots = linked_roots(members.select("bucket", "node"), verify, Scratch(spark, "t"))
        found = roots.join(places, "node").select("id", "root").collect()
        assert sorted(r.id for r in found) == [k for k in range(size) if k % 10 != 9] and len({r.root for r in found}) == 1


def test_members_alone_in_their_buckets_are_not_stored(spark):
    """Before, each member's every bucket was stored and dealt out, though hardly any is shared."""
    kept = {}

    class Counted(Scratch):
        def keep(self, df, name):
            stored = super().keep(df, name)
            kept[name] = stored.count()
            return stored

    members = spark.range(1000).select(F.col("id").alias("bucket"), F.col("id").alias("node"))
    members = members.union(spark.createDataFrame([(1, 2), (5, 900)], "bucket long, node long"))
    roots = linked_roots(members, lambda pairs: pairs, Counted(spark, "t"))
    assert {r.node: r.root for r in roots.collect()} == {1: 1, 2: 1, 5: 5, 900: 5}
    assert kept["shared"] == 2 and kept["labelled0"] == 4
