"""Reading vector columns: arrays of numbers become bytes beside their length, bad vectors become null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def element_type(frame: DataFrame) -> str:
    """Numpy type that holds the components as they are stored."""
    return "<f4" if isinstance(frame.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def packed(frame: DataFrame, kind: str, change=None, zero_ok: bool = True) -> DataFrame:
    """(vec_id, dim, vec): the number of components and their bytes, whatever the length.

    ``vec`` is null if the vector is null, empty, holds null or non-finite components, or is zero
    where ``zero_ok`` is false.  ``change`` maps the matrix.
    """

    def apply(frames):
        for batch in frames:
            column = batch.column(1)
            out = [None] * len(column)
            sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0).astype(np.int32)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == dim)
                flat = column.take(pa.array(rows)).flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)  # nulls turn into nan
                good = np.isfinite(x).all(1)
                if not zero_ok:
                    good &= (x != 0).any(1)
                x = change(x) if change else x
                for r, v in zip(rows[good].tolist(), x[good]):
                    out[r] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(out, pa.binary())], ["vec_id", "dim", "vec"])

    source = frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>") if kind == "<f8" else F.col("embedding"))
    return source.mapInArrow(apply, "vec_id long, dim int, vec binary")


def matrix(column, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)
