"""Connected components of a link table by alternating star contractions.

Every round hangs the neighbours of a node on the smallest node around it, first the
larger neighbours, then the smaller ones. The number of rounds grows with the
logarithm of the longest chain. Only link rows are shuffled; the centre of a large
star is spread over salts, and nothing is gathered per node.
"""

from pyspark.sql import functions as F

from contrast.llm.common import settle

SALTS = 16


def _with_least(edges, label):
    """Every edge (u, v) with the least v of its u; the edges of one u are salted."""
    least = edges.groupBy("u").agg(F.min("v").alias(label))
    copies = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["u", "_salt"]).drop("_salt")


def _down(u, v):
    return F.greatest(u, v).alias("u"), F.least(u, v).alias("v")


def _mark(edges):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h"))
    return tuple(row.first())


def components(links, left, right):
    """``node``, ``component`` (least node reachable) for every node that has a link.

    Links are taken both ways; repeated links and links to oneself do no harm; rows
    with a null end are left out. An empty table gives an empty table.
    """
    edges = links.select(
        *_down(F.col(left).cast("long"), F.col(right).cast("long"))
    ).where("u > v").distinct()
    edges = settle(edges, "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_least(both, "m")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        starred = _with_least(large, "m")
        small = (
            starred.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges = settle(small, "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
