"""Shared helpers of the training-data operators: tables, scratch tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trialloom.sources.tables import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read back: cuts lineage and
    survives lost executors. Partitioning and order are not kept."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # for drop_written
    return out


def drop_written(df: DataFrame | None) -> None:
    """Delete a table made by written() once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def held_out(doc_id: Column, of: int = 4, rest: int = 2) -> Column:
    """True for the rows that no model may learn labels from: crc32(doc_id as text) mod 4 is 2, or
    mod of is rest."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(False))


def bounded_sample(df: DataFrame, label: str, key: str | list[str], total: int, seed: int = 7) -> DataFrame:
    """About total rows, as many of each label, chosen by a hash of key, the same on every run.

    The share kept of each label follows from its exact count, so that no task has to
    rank all rows of one label. Rows with null label never count. Rows with equal keys are
    chosen together: keys must tell rows apart, or few may share one.
    """
    rows = df.where(F.col(label).isNotNull())
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    per_label = total / max(1, len(counts))
    share = F.lit(0.0)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(seed), *([key] if isinstance(key, str) else key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw < share)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, as_arrow: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow where fn gets batches as {column: list} and yields such dicts, or Arrow arrays in them.

    Batches are cut to 256 rows so that long texts do not pile up in a worker. Columns named
    in as_arrow come as Arrow arrays.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[dict]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    cut = batch.slice(at, 256)
                    yield {n: c if n in as_arrow else c.to_pylist() for n, c in zip(cut.schema.names, cut.columns, strict=True)}

        for out in fn(parts()):
            arrays = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)
