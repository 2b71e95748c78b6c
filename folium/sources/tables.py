"""The tables that queries read, and how Python steps take and give rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of texts and contents that a Python step holds before it passes them on.
MOST_ROWS, MOST_BYTES = 4_000, 4 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows dealt over all partitions by a key. Small rows that make much work stay otherwise in the few tasks that their bytes fill."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def batched(rows: Iterable[tuple], schema: pa.Schema, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    made = lambda held: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    held, size = [], 0
    for r in rows:
        held.append(r)
        for v in r:
            if isinstance(v, str | bytes):
                size += len(v)
        if len(held) >= most_rows or size >= most_bytes:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def by_row(frame: DataFrame, make: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The tuples of schema that make gives for each row's values.

    Only one row's values at a time become Python's objects, and what is made is passed on in batches of bounded size, so that a
    worker's memory does not grow with the rows of a batch from Spark.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((r for batch in batches for row in zip(*batch.columns, strict=True) for r in make(*(v.as_py() for v in row))), arrow)

    return frame.mapInArrow(run, schema)
