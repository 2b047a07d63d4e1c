"""What the document operators share: batches of bounded size, stored tables, whole-table readers.

Conventions of every operator here: only the id and text columns are read, so other columns of any
name neither matter nor clash; a null text counts as an empty one; null and repeated ids are ordinary
values and each row gets its own result; an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import scratch_path

BATCH_BYTES = 2_000_000


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: later steps neither recompute them nor lose them with an executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_share(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows while they are at most ``bound``; else those of the least key hash, about ``bound`` of them.

    A later exact limit then takes few rows from each task, however many tasks there are.
    """
    n = rows.select(key).count()
    if n <= bound:
        return rows
    scale = 1 << 40
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(scale))
    return rows.where(place < int(scale * bound / n))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bounded_slices(batches, text_col: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of at most ``limit`` bytes of text; a longer text makes a range of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings one after the other, and the n + 1 borders between them."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, borders - borders[0]


def attach(df: DataFrame, text_col: str, make: Callable, fields: str, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of df and new ones computed from the text, batch by batch.

    ``make()`` runs once per task and gives a function from a string array to the arrays of ``fields``
    (a DDL string). New columns replace kept ones of the same name, whatever the case.
    """
    new = T._parse_datatype_string(fields)
    names = {f.name.lower() for f in new.fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    schema = T.StructType([df.schema[c] for c in keep] + new.fields)
    sent = list(dict.fromkeys([*keep, text_col]))
    place = [sent.index(c) for c in keep]
    text_at = sent.index(text_col)

    def run(batches):
        compute = make()
        for part in bounded_slices(batches, text_col):
            made = compute(part.column(text_at))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in place), *made], names=[f.name for f in schema])

    return df.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, schema)


def flat_lists(lengths, values: pa.Array) -> pa.Array:
    """A list array from the length of each list and all values."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), values)
