"""Running sums within groups of any size, without one task per group.

Rows are dealt by range over (group, order), so a large group spans many partitions.
Each partition sums up its own rows; a group that reaches over partition borders is the
last of one and the first of the next, so two totals a partition are all that has to
be known of the others: at most 2 rows a partition reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from prepcast.llm.scratch import partitions, written


def running(df: DataFrame, group: str, order: list[str], values: list[str], name: str, xor: bool = False) -> DataFrame:
    """``df`` with each column of ``values`` (long) as its running sum, modulo 2**64, within ``group`` (long, not null) by ``order``.

    ``xor``: the running exclusive or instead. Rows that are equal in ``group`` and ``order`` may come in any sequence.
    """
    spark = df.sparkSession
    plus, minus = (np.bitwise_xor, np.bitwise_xor) if xor else (np.add, np.subtract)
    # the last key splits rows that are equal in all others
    dealt = df.withColumn("__row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(spark), group, *order, "__row").sortWithinPartitions(group, *order, "__row").drop("__row")
    schema = StructType([*dealt.schema.fields, StructField("__pid", IntegerType()), StructField("__n", LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, n, last, carry = TaskContext.get().partitionId(), 0, None, [np.zeros(1, np.uint64)] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(group).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            run = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
            cols = {n: batch.column(n) for n in batch.schema.names}
            for k, v in enumerate(values):
                x = pc.fill_null(batch.column(v), 0).to_numpy(zero_copy_only=False).view(np.uint64)
                total = plus.accumulate(x)
                before = np.concatenate([np.zeros(1, np.uint64), total])[starts]
                if key[0] == last:
                    before[:1] = minus(before[:1], carry[k])
                total = minus(total, before[run])
                carry[k] = total[-1:]
                cols[v] = pa.array(total.view(np.int64))
            last = key[-1]
            cols |= {"__pid": pa.array(np.full(len(key), pid, np.int32)), "__n": pa.array(np.arange(n, n + len(key)))}
            n += len(key)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    parts = written(dealt.mapInArrow(local, schema), name)
    edge = parts.groupBy("__pid").agg(F.min(group).alias("first"), F.max(group).alias("last"))
    ends = parts.join(F.broadcast(edge), "__pid").where(F.col(group).isin(F.col("first"), F.col("last")))
    sums = ends.groupBy(group, "__pid").agg(*[F.max_by(v, "__n").alias(v) for v in values])
    before: dict[int, tuple[int, list[int]]] = {}  # partition -> its first group and that group's sums in earlier partitions
    seen: dict[int, list[int]] = {}
    for r in sorted(sums.collect(), key=lambda r: r["__pid"]):
        now = seen.setdefault(r[group], [0] * len(values))
        if any(now):
            before[r["__pid"]] = (r[group], now)
        seen[r[group]] = [(a ^ r[v] if xor else a + r[v]) % 2**64 for a, v in zip(now, values)]
    shared = spark.sparkContext.broadcast(before)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pids, key = batch.column("__pid").to_numpy(), batch.column(group).to_numpy()
            cols = {n: batch.column(n) for n in batch.schema.names if n not in ("__pid", "__n")}
            for pid in np.unique(pids):
                first, sums_ = shared.value.get(int(pid), (None, []))
                hit = (pids == pid) & (key == first)
                for v, s in zip(values, sums_):
                    x = cols[v].to_numpy().view(np.uint64).copy()
                    x[hit] = plus(x[hit], np.uint64(s))
                    cols[v] = pa.array(x.view(np.int64))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return parts.mapInArrow(add, df.schema)
