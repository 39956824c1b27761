"""Small tables made of literal rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_table(spark: SparkSession, schema: str, rows: Iterable[Sequence]) -> DataFrame:
    """DataFrame over literal rows.

    Built from an Arrow table, so that Catalyst sees a local relation of
    known size: joins with it are broadcast because it is small, not on faith.
    """
    struct = T.StructType.fromDDL(schema)
    rows = list(rows)
    columns = {name: [row[i] for row in rows] for i, name in enumerate(struct.names)}
    return spark.createDataFrame(pa.table(columns), schema=struct)
