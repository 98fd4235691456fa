"""A bit table of fixed size over 64-bit keys, to drop rows that can't join before they are shuffled.

It only saves work: rows that pass by chance are dropped by the join that follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BITS = 24


def bit_table(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Set bits of xxhash64(key); at most 2**bits / 32 rows of 16 bytes reach the driver, whatever the input."""
    at = F.shiftrightunsigned(F.xxhash64(column), 64 - bits).alias("at")
    rows = keys.select(at).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("set")).toArrow()
    table = np.zeros((1 << bits) // 32, np.uint32)
    table[rows.column("word").to_numpy()] = rows.column("set").to_numpy().astype(np.uint32)
    return table


def sieve(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among ``keys`` (same column name).

    The table is one broadcast row that a semi join looks into: texts don't go to Python and back for it.
    """
    bits = pa.table({"__bits": pa.array([bit_table(keys, column).view(np.int32)], pa.list_(pa.int32()))})
    at = f"shiftrightunsigned(xxhash64(`{column}`), {64 - BITS})"
    there = F.expr(f"(get(__bits, cast(shiftright({at}, 5) as int)) & shiftleft(1, cast({at} & 31 as int))) <> 0")
    return df.join(F.broadcast(df.sparkSession.createDataFrame(bits)), there, "left_semi")
