"""User aggregates that merge: partial states by task, put together in a tree, finished once."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import written

#: States that a task keeps before it hands them on; a key may then have several from one task.
MOST_STATES = 10_000
#: States of a key that one task merges at a time.
FAN_IN = 64


class Aggregate(Protocol):
    """What a user writes. States are small, whatever the number of rows, and can be pickled.

    ``merge`` must not depend on the order or grouping of states. None of the methods may
    keep its arguments' data beyond what the state says.
    """

    def zero(self) -> Any:
        """The state of no rows."""

    def update(self, state: Any, rows: pa.RecordBatch) -> Any:
        """The state with some more rows of the aggregated columns."""

    def merge(self, a: Any, b: Any) -> Any:
        """The state of the rows of both."""

    def finish(self, state: Any) -> Any:
        """The value of the result column."""


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each key of a batch, put together by a sort of the keys' numbers."""
    if not keys:
        yield (), batch
        return
    codes: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)):
        codes.setdefault(key, []).append(i)
    for key, places in codes.items():
        yield key, batch.take(pa.array(places)) if len(codes) > 1 else batch


def merged_aggregate(
    df: DataFrame, keys: list[str], columns: list[str], aggregate: Aggregate, result: str, result_type: str, most_states: int = MOST_STATES, fan_in: int = FAN_IN
) -> DataFrame:
    """``keys`` and ``result``: the aggregate of ``columns`` over the rows of each key.

    Each task makes one state for a key, batch by batch; ``fan_in`` states at a
    time are then merged, level by level, so neither the rows nor the states
    of a key ever are in one task, however many rows it has.

    * Null keys are a key. No keys make one of the table, even if it is empty.
    * Nulls in ``columns`` are handed to ``update``.
    * An empty table gives no rows where there are keys.
    * Keys may be of any type that can be grouped by, but NaN keys count as different.
    """
    spark = df.sparkSession
    ks = [f"k{i}" for i in range(len(keys))]
    vs = [f"v{i}" for i in range(len(columns))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(keys, ks, strict=True)), *(F.col(c).alias(v) for c, v in zip(columns, vs, strict=True)))
    fields = [f"{k} {df.schema[c].dataType.simpleString()}" for c, k in zip(keys, ks, strict=True)]
    state_ddl = ", ".join([*fields, "part int, state binary"])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(state_ddl))

    def out(states: dict[tuple, Any], part: int) -> pa.RecordBatch:
        listed = [dict(zip(ks, key, strict=True), part=part, state=pickle.dumps(s)) for key, s in states.items()]
        return pa.RecordBatch.from_pylist(listed, schema=schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, states = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, own in _runs(batch, ks):
                if key not in states and len(states) >= most_states:
                    yield out(states, part)
                    states = {}
                values = own.select(vs).rename_columns(columns)
                states[key] = aggregate.update(states[key] if key in states else aggregate.zero(), values)
        if states:
            yield out(states, part)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key: one state is held at a time."""
        part, now, state = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for *key, data in zip(*(batch.column(c).to_pylist() for c in (*ks, "state")), strict=True):
                if now != tuple(key):
                    if now is not None:
                        yield out({now: state}, part)
                    now, state = tuple(key), pickle.loads(data)
                else:
                    state = aggregate.merge(state, pickle.loads(data))
        if now is not None:
            yield out({now: state}, part)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [aggregate.finish(pickle.loads(s)) for s in batch.column("state").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ks), pa.array(values, end_type)], names=[*ks, "value"])

    end_type = to_arrow_schema(StructType.fromDDL(f"value {result_type}")).field("value").type
    states = written(rows.mapInArrow(partial, state_ddl), "states")
    # the tree is as high as the key with the most states needs
    most = states.groupBy(*ks).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    levels = 0
    while most > fan_in:
        most, levels = -(-most // fan_in), levels + 1
    for level in range(levels, -1, -1):
        branch = F.pmod(F.col("part"), F.lit(fan_in**level)).alias("branch")
        dealt = states.withColumn("branch", branch) if level else states.withColumn("branch", F.lit(0))
        dealt = dealt.repartition(*ks, "branch") if ks or level else dealt.coalesce(1)
        states = dealt.sortWithinPartitions(*ks, "branch").select(*ks, "part", "state").mapInArrow(combine, state_ddl)
    if not keys:
        empty = spark.createDataFrame([(0, pickle.dumps(aggregate.zero()))], state_ddl)
        states = states.unionAll(empty).coalesce(1).mapInArrow(combine, state_ddl)
    ddl = ", ".join([*fields, f"value {result_type}"])
    done = states.mapInArrow(finished, ddl)
    return done.select(*(F.col(k).alias(c) for k, c in zip(ks, keys, strict=True)), F.col("value").alias(result))
