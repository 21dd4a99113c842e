"""What the operators of this subpackage share: Arrow mapping, checkpoints, table access."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.storage import shared_folder  # noqa: F401  also for the operators

#: Rows, and bytes, in an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches (a row goes whole, so one of a very long text may be over the bytes), and a checkpoint folder: the cluster's own. Where none is set, a temporary one in a single process, and an error on a cluster."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_folder(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) under fixed names; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def map_batches(df: DataFrame, per_batch: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """One output batch for an input batch; per_batch returns the columns as lists or Arrow arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = per_batch(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def is_held_out(id_name: str = "doc_id") -> Column:
    """The fold that no model is fitted on: crc32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_name).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or a longer name that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
