"""Helpers shared by the training-data operators: scratch tables on the shared
folder, table loading and batches of bounded size for Arrow functions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it, in a regular expression.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`). Where it is unset, a temporary one in local mode; on a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="pulseloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """`stage`, as a table bucketed by `column`: a join or group by it reads the buckets where they are, without a shuffle."""
    spark, table_name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, column).option("path", f"{shared_dir(spark)}/{table_name}").saveAsTable(table_name)
    return spark.table(table_name)


def drop_stage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_held: dict = {}


def forget() -> None:
    """Drop what a worker has kept for another operator: workers outlive stages, and their memory adds up."""
    if _held:
        import gc

        import pyarrow as pa

        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def kept(key: tuple, build):
    """The one large object of a worker, kept over its tasks; another one takes its place."""
    if key not in _held:
        forget()
        _held[key] = build()
    return _held[key]


def small_batches(spark: SparkSession, rows: int = 20_000, size: str = "4m") -> None:
    """Bound Arrow batches by their bytes, as texts may be long, and by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def text_slices(frames: Iterator[pd.DataFrame], column: str = "text", most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Cut batches so that a slice holds about `most` characters, or one row."""
    for pdf in frames:
        if not len(pdf):
            continue
        sizes = pdf[column].str.len().fillna(0).cumsum()
        for _, part in pdf.groupby((sizes // most).to_numpy(), sort=False):
            yield part


def map_texts(docs: DataFrame, fn, out: str, carry: list[str], text_col: str = "text", most: int = 2_000_000) -> DataFrame:
    """Apply `fn` to slices of texts inside Spark tasks (Arrow); ids travel as Arrow columns, so nulls and 64 bits survive.

    `fn(texts, batch)` gets the list of texts (null: empty) of a slice of about
    `most` characters and returns (row numbers or None, list of output columns).
    `out` is the DDL of the output columns, which follow the carried ones.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    import pyarrow as pa

    taken = docs.select(*carry, F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    schema = StructType(taken.schema.fields[:-1] + StructType.fromDDL(out).fields)
    arrow = to_arrow_schema(schema)
    small_batches(docs.sparkSession)

    def run(batches):
        import numpy as np

        for batch in batches:
            texts = batch.column(len(carry)).to_pylist()
            ends = np.cumsum([len(t) for t in texts]) // most if texts else []
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(texts)] if texts else [0, 0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                rows, columns = fn(texts[lo:hi], part)
                kept = [part.column(i) for i in range(len(carry))]
                if rows is not None:
                    rows = pa.array(np.asarray(rows, np.int64))
                    kept = [c.take(rows) for c in kept]
                made = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[len(carry) :], strict=True)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, *made], arrow, strict=True)], schema=arrow)

    return taken.mapInArrow(run, schema)
