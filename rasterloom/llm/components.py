"""Connected components of a graph in a table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, small_batches


#: Edges that one task takes without noticing: 16 bytes each.
ONE_TASK = 500_000


def joined(batches):
    """(node, root) of all edges of a task, by joining trees."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(x, x)
            root.setdefault(y, y)
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], names=["node", "root"])


def met_by_key(big: DataFrame, small: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``big`` joined to ``small``, which has one row a key and in ``n`` the key's rows in ``big``.

    Keys with over a quarter of a partition's share of the ``total`` rows, of
    which there can be no more than four a partition, are broadcast; so their
    rows stay where they are and no task gathers them. All others are joined
    by a shuffle.
    """
    hot = F.col(n) > max(1000, total // (4 * partitions(big.sparkSession)))
    few = F.broadcast(small.filter(hot))
    rest = big.join(F.broadcast(small.filter(hot).select(*keys)), keys, "left_anti")
    return big.join(few, keys).unionByName(rest.join(small.filter(~hot), keys))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an edge can reach.

    Alternates large-star and small-star rounds, which converge in a number of
    rounds that grows with the logarithm of a component's size. Minima and
    degrees are aggregated before the shuffle; where they are joined back, hubs
    are broadcast, so a node with very many neighbours is never gathered in one
    task. Edges that one task holds easily are joined there. Every round is cut with a reliable checkpoint. Self links are
    ignored; an empty graph gives no rows.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (got.n, got.h) == seen or not got.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        if got.n <= ONE_TASK and dict(now.dtypes)["u"] == "bigint":  # the rounds' result, without shuffles of next to nothing
            small_batches(now.sparkSession)
            return now.coalesce(1).mapInArrow(joined, "node long, root long")
        seen = (got.n, got.h)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = met_by_key(both, least, ["u"], "n", 2 * got.n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = met_by_key(large, down, ["u"], "n", 2 * got.n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
