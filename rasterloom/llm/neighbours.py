"""Neighbours in a sorted table, without one task that sees it all."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .common import small_batches

#: Keys a part that are looked at to balance the parts.
SAMPLE = 20


def sorted_parts(df: DataFrame, key: str, tie: str, n: int, apart: bool = False, wrap: bool = False, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows in at most n sorted parts with the rows next to them: adds part and edge (int).

    Rows are ordered by (key, tie), columns without nulls; rows with an equal
    key are split between parts by their tie, and only rows alike in both stay
    together. edge is 0 for a part's own rows and 1 for copies of the rows after
    them (``wrap``: after the last part come the first rows of all). With
    ``apart``, neighbours have another key: edge 1 is there only if the rows
    after the part have one, and edge -1 stands for copies of the last rows
    before the part that have another key than its first.

    A partition holds one part in the order edge, key, tie, and the columns
    ``then``. Where parts begin
    and end, a few keys a part, goes to the driver and into every task, which
    finds a row's part by bisection.
    """
    small_batches(df.sparkSession)
    narrow = df.select(key, tie)
    found = sorted(tuple(r) for r in narrow.orderBy(F.xxhash64(key, tie)).limit(SAMPLE * n).collect())
    bounds = sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []
    kinds = dict(narrow.dtypes)
    dealt = narrow.mapInArrow(_placed(bounds, {}, 0, 1), f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, part int, edge int")
    whole = F.struct(key, tie)
    ends = sorted((r.part, tuple(r.a), tuple(r.z)) for r in dealt.groupBy("part").agg(F.min(whole).alias("a"), F.max(whole).alias("z")).collect())
    copies: dict[tuple, list[tuple[int, int]]] = {}
    for i, (part, a, _) in enumerate(ends):
        if apart and i:
            if ends[i - 1][2][0] == a[0]:
                continue
            copies.setdefault(ends[i - 1][2], []).append((part, -1))
        if i or wrap:
            copies.setdefault(a, []).append((ends[i - 1][0], 1))
    if apart:  # parts that begin with the key that the one before ends with
        last = {part: z[0] for part, _, z in ends}
        least = dealt.mapInArrow(_below(last), dealt.schema).groupBy("part").agg(F.max(whole).alias("y"))
        second = {r.part: tuple(r.y) for r in least.collect()}
        for i, (part, a, _) in enumerate(ends):
            if i and ends[i - 1][2][0] == a[0]:
                before = next((second[p] for p, _, _ in reversed(ends[:i]) if p in second), None)
                if before is not None:
                    copies.setdefault(before, []).append((part, -1))
    names = df.columns
    schema = StructType([*df.schema.fields]).add("part", IntegerType()).add("edge", IntegerType())
    placed = df.mapInArrow(_placed(bounds, copies, names.index(key), names.index(tie)), schema)
    return placed.repartitionById(n, F.col("part")).sortWithinPartitions("edge", key, tie, *then)


def _placed(bounds: list[tuple], copies: dict[tuple, list[tuple[int, int]]], at: int, tie_at: int):
    def run(batches):
        for batch in batches:
            full = list(zip(batch.column(at).to_pylist(), batch.column(tie_at).to_pylist(), strict=True))
            parts, edges = [bisect_right(bounds, x) for x in full], [0] * len(full)
            rows = [*range(len(full))]
            if copies:
                for i, x in enumerate(full):
                    for part, edge in copies.get(x, ()):
                        rows.append(i)
                        parts.append(part)
                        edges.append(edge)
            out = batch.take(pa.array(rows)) if len(rows) > len(full) else batch
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(parts, pa.int32()), pa.array(edges, pa.int32())], names=[*batch.schema.names, "part", "edge"])

    return run


def _below(last: dict):
    """Rows with a smaller key than the last of their part."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([k < last[p] for k, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.bool_()))

    return run
