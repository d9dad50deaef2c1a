"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Upper bound of one Arrow batch that goes to a Python worker.
ARROW_BATCH = "16m"
ARROW_ROWS = "2000"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) a temporary
    folder is made and set as the checkpoint folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        found = getattr(sc, "_llm_checkpoint_dir", None)
        if not found:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
            sc._llm_checkpoint_dir = found
            sc.setCheckpointDir(found)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of ids and hashes that may be broadcast.
FEW = 300_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """Marked for broadcast if a table of narrow rows has at most so many; counting stops beyond. ``df`` should be cut or stored."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; ``clear_scratch`` removes those made so far."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc._llm_scratch = [*getattr(sc, "_llm_scratch", []), path]
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the intermediate tables of all operators of a session, once their results are stored."""
    for path in getattr(spark.sparkContext, "_llm_scratch", []):
        remove_path(spark, path)
    spark.sparkContext._llm_scratch = []


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, for tables with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Applies a function on columns (dict of lists) batch by batch.

    ``make`` runs once a task and returns the function, so that models and
    caches are built on the executor.
    """
    small_batches(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        for batch in batches:
            if batch.num_rows:
                call = call or make()
                got = call({k: batch.column(i).to_pylist() for i, k in enumerate(batch.schema.names)})
                yield to_batch(got, arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def to_batch(got: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)


def chunks(rows: Iterable[tuple], arrow: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(dict(zip(arrow.names, zip(*held), strict=True)), arrow)
            held = []
    if held:
        yield to_batch(dict(zip(arrow.names, zip(*held), strict=True)), arrow)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
