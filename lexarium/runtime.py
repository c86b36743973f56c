"""How Python workers find the library, and passes over texts that run in them."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string

ROOT = str(Path(__file__).resolve().parents[1])
#: Python workers keep freed arrays of a slice for the next one instead of asking the system for each anew.
ALLOCATOR = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows that go to a Python worker at once, and characters of text that it works on at once.
BATCH_ROWS = 2000
SLICE = 1 << 19


def prepare(spark: SparkSession) -> SparkSession:
    """Workers on this machine get the library's folder on their path; a cluster gets it with --py-files or on its image."""
    env = spark.sparkContext.environment
    for name, value in ALLOCATOR.items():
        env.setdefault(name, value)
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default; whole texts make such batches large
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def slices(texts: list[str | None], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about ``most`` characters each, of one row at least."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if texts:
        yield first, len(texts)


def map_texts(df: DataFrame, text_col: str, fields: str | StructType, work: Callable[..., tuple[np.ndarray | None, list]], keep_text: bool = False, also: str | None = None) -> DataFrame:
    """``df`` without its text and with the columns ``fields`` (a DDL string or a schema), in one Arrow pass: no grouping and no shuffle.

    ``work`` gets a slice of texts.  It returns the new columns and, unless there is one value for each text, the places of the texts that its rows belong to.
    With ``also`` it gets a second column of texts, which is left out as well.
    """
    prepare(df.sparkSession)
    new = _parse_datatype_string(fields) if isinstance(fields, str) else fields
    kept = [i for i, f in enumerate(df.schema.fields) if f.name not in ([also] if keep_text else [text_col, also])]
    schema = StructType([*(df.schema.fields[i] for i in kept), *new.fields])
    names, at, at2 = schema.names, df.columns.index(text_col), df.columns.index(also) if also else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in new.fields]
        for b in batches:
            texts = b.column(at).to_pylist()
            second = None if at2 is None else b.column(at2).to_pylist()
            for low, high in slices(texts):
                rows, columns = work(texts[low:high], *([] if second is None else [second[low:high]]))
                own = [b.column(i).slice(low, high - low) for i in kept]
                if rows is not None:
                    if not len(rows):
                        continue
                    own = [c.take(pa.array(rows)) for c in own]
                made = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(own + made, names=names)

    return df.mapInArrow(run, schema)
