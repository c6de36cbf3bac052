"""Rows of a written table that are found again without moving the table: only their ids are shuffled.

The ids are those of `monotonically_increasing_id` when the table was written: the partition's number above PART bits,
the place in the partition below. The chosen ids are written to the shared folder by ranges, in a folder for each
partition. A task that reads the table meets the rows of a few partitions and reads those folders only, so that no
table of marks is broadcast or held whole, whatever the size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.llm import store
from strandlog.runtime import fresh_path, ship, width

PART = 33
#: The ids of the partitions that a worker met last.
_HELD: dict[tuple[str, int], np.ndarray] = {}
_MOST = 4


def _ids(folder: str, part: int) -> np.ndarray:
    """The chosen ids of a partition, sorted."""
    key = folder, part
    if key not in _HELD:
        system, path = store.locate(folder)
        found = system.get_file_info(fs.FileSelector(f"{path}/part={part}", allow_not_found=True))
        files = [f.path for f in found if f.path.endswith(".parquet")]
        ids = [pq.read_table(system.open_input_file(f), columns=["row"]).column(0).to_numpy() for f in files]
        while len(_HELD) >= _MOST:
            del _HELD[next(iter(_HELD))]
        _HELD[key] = np.sort(np.concatenate([np.empty(0, np.int64), *ids]))
    return _HELD[key]


def among(folder: str, rows: np.ndarray) -> np.ndarray:
    """Which of the row ids are marked."""
    out = np.zeros(len(rows), bool)
    part = rows >> PART
    for p in np.unique(part).tolist():
        own = np.flatnonzero(part == p)
        ids = _ids(folder, p)
        if len(ids):
            at = np.minimum(np.searchsorted(ids, rows[own]), len(ids) - 1)
            out[own] = ids[at] == rows[own]
    return out


def mark(rows: DataFrame) -> str:
    """Write the ids of a one-column table; returns their folder."""
    spark = rows.sparkSession
    ship(spark)
    path = fresh_path(spark, "marks")
    ids = rows.toDF("row").repartitionByRange(width(spark), "row")
    ids.withColumn("part", F.shiftright("row", PART)).write.partitionBy("part").parquet(path)
    return path


def marked(row: Column, folder: str) -> Column:
    """Whether a row id is among those written to the folder; other columns don't reach Python."""

    def run(rows: pa.Array) -> pa.Array:
        return pa.array(among(folder, rows.to_numpy(zero_copy_only=False)))

    return F.arrow_udf(run, "boolean")(row)
