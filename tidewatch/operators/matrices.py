"""Rows of a table times a fixed matrix, in Arrow batches: hundreds of columns cost no planning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.array_sums import matrix


def apply_matrix(
    df: DataFrame, columns: list[str], keep: list[str], shift: np.ndarray, weights: np.ndarray, names: list[str], lengths: bool = False
) -> DataFrame:
    """The kept columns and, as ``names``, the columns less ``shift`` times ``weights`` (columns × names).

    With ``lengths`` there is one new column, the squared length of that product. A missing value in any of the
    columns makes the new ones null.
    """
    fields = [df.schema[k] for k in keep]
    schema = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = (matrix(batch.column(batch.num_columns - 1)) - shift) @ weights
            found = (found**2).sum(axis=1, keepdims=True) if lengths else found
            made = [pa.array(c, pa.float64(), mask=np.isnan(c)) for c in found.T]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[f.name for f in schema])

    rows = df.select(*[F.col(f"`{k}`") for k in keep], F.array(*[F.col(f"`{c}`").cast("double") for c in columns]))
    return rows.mapInArrow(run, schema)
