"""Optional reader of HDF5 count matrices, where h5py is installed: coordinates by row range, one task a range."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

try:
    import h5py
except ImportError:  # not installed: only open_matrix() needs it
    h5py = None


def locate(name: str) -> str:
    return {"X": "X", "raw": "raw/X"}.get(name, f"layers/{name}")


def open_matrix(spark: SparkSession, path: str, name: str = "X", rows_per_task: int = 4096) -> DataFrame:
    """(row, gene, value) of a row-compressed, column-compressed or dense matrix in a file that all executors can open."""
    if h5py is None:
        raise RuntimeError("reading HDF5 needs h5py")
    where = locate(name)
    with h5py.File(path) as f:
        node = f[where]
        dense = isinstance(node, h5py.Dataset)
        kind = "dense" if dense else node.attrs["encoding-type"]
        n = node.shape[0] if dense else len(node["indptr"]) - 1
    ranges = spark.createDataFrame([(i, min(n, i + rows_per_task)) for i in range(0, n, rows_per_task)], "lo long, hi long").repartition(max(1, -(-n // rows_per_task)))

    def read(parts: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        with h5py.File(path) as f:
            node = f[where]
            for part in parts:
                for lo, hi in part.itertuples(index=False):
                    if kind == "dense":
                        block = node[lo:hi]
                        major, minor = np.nonzero(block)
                        values = block[major, minor]
                    else:
                        ptr = node["indptr"][lo : hi + 1]
                        minor, values = node["indices"][ptr[0] : ptr[-1]], node["data"][ptr[0] : ptr[-1]]
                        major = np.repeat(np.arange(hi - lo), np.diff(ptr))
                    major = major + lo
                    row, gene = (minor, major) if kind == "csc_matrix" else (major, minor)
                    yield pd.DataFrame({"row": np.asarray(row, np.int64), "gene": np.asarray(gene, np.int32), "value": np.asarray(values, float)})

    return ranges.mapInPandas(read, "row long, gene int, value double")
