"""Arrow helpers shared by the operators: kernels see bounded slices of whole texts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel works on at a time; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives an empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes of text, in order, nothing left out."""
    n = batch.num_rows
    if not n:
        return
    sizes = batch.column(batch.schema.get_field_index(column))
    lengths = np.asarray(pa.compute.binary_length(sizes).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = used = 0
    for i in range(n):
        if used and used + lengths[i] > limit:
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += int(lengths[i])
    yield batch.slice(start, n - start)


def replaced(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    """The batch with other texts, and n_chars to match where it has such a column."""
    arrays = list(batch.columns)
    for k, field in enumerate(batch.schema):
        if field.name == "text":
            arrays[k] = pa.array(texts, field.type)
        elif field.name == "n_chars" and pa.types.is_integer(field.type):
            arrays[k] = pa.array([None if t is None else len(t) for t in texts], field.type)
    return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


import pyarrow.compute  # noqa: E402,F401  (registers pa.compute)


def ensure_checkpoints(spark) -> None:
    """The cluster's spark.checkpoint.dir; a folder of our own only where that is unset and all runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="talus-"))


def few(frame):
    """The rows in a sixteenth of the partitions that shuffles have (6 at least), for small rows.

    Each partition of a checkpoint is a file, and Hadoop starts processes to set the permissions of a local one.
    """
    return frame.coalesce(max(6, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16))


@contextmanager
def settings(spark, **values: str) -> Iterator[None]:
    """Session settings (with __ for dots) for the actions inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
