"""Running sums and fingerprints along keys of any length, by numpy scans over range partitions.

Rows are range-partitioned and sorted by key and order, so a key may stretch
over several partitions, and each partition is scanned batch by batch. What a
key brings along from the partitions before is a few numbers for a partition,
as only a partition's first key can have begun earlier.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import arrow_schema, mapped, materialize


@dataclass(frozen=True)
class Sum:
    """The running sum of a column of longs, the row's own value included."""

    column: str


@dataclass(frozen=True)
class Fingerprint:
    """The sum of value * base**place modulo a prime below 2**31, over the rows so far; places count from 1.

    The column ``<name>_before`` has the sum without the row's own value.
    """

    column: str
    base: int
    prime: int


class _Powers:
    """Powers of a base modulo a prime, as far as they have been asked for."""

    def __init__(self, base: int, prime: int):
        self.base, self.prime, self.known = base, prime, np.ones(1, np.int64)

    def __call__(self, places: np.ndarray) -> np.ndarray:
        top = int(places.max(initial=0)) + 1
        while len(self.known) < top:
            step = pow(self.base, len(self.known), self.prime)
            self.known = np.concatenate([self.known, self.known * step % self.prime])
        return self.known[places]


def _local_scan(key: str, columns: dict[str, Sum | Fingerprint], schema: pa.Schema):
    """Scan a sorted partition: each row's place in its key, and its running values, from the partition's start on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        powers = {n: _Powers(c.base, c.prime) for n, c in columns.items() if isinstance(c, Fingerprint)}
        last, held = None, dict.fromkeys([*columns, "place"], 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            index = np.arange(len(keys))
            new = np.append(keys[0] != last or last is None, keys[1:] != keys[:-1])
            begin = np.maximum.accumulate(np.where(new, index, 0))
            goes_on = begin == 0 if not new[0] else np.zeros(len(keys), bool)  # the key that the last batch ended with
            place = index - begin + 1 + np.where(goes_on, held["place"], 0)
            added = {"place": place, "part": np.full(len(keys), part)}
            for name, c in columns.items():
                values = batch.column(c.column).to_numpy()
                if isinstance(c, Fingerprint):
                    values = (values.view(np.uint64) % np.uint64(c.prime)).astype(np.int64) * powers[name](place) % c.prime
                total = np.cumsum(values)
                total = total - (total - values)[begin] + np.where(goes_on, held[name], 0)
                if isinstance(c, Fingerprint):
                    total %= c.prime
                    added[f"{name}_before"] = (total - values) % c.prime
                added[name] = total
            last, held = keys[-1], {n: int(added[n][-1]) for n in held}
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) if f.name in batch.schema.names else pa.array(added[f.name], f.type) for f in schema], schema=schema
            )

    return run


def scan(df: DataFrame, key: str, order: list[Column], columns: dict[str, Sum | Fingerprint], name: str) -> DataFrame:
    """``df`` with ``place``, which counts each key's rows from 1, and the running values ``columns``.

    ``key`` is a long, not null; ``order`` begins with it, leaves no ties that
    matter, and may be descending behind it. The result is written.
    """
    spark = df.sparkSession
    extra = ["place", *(x for n, c in columns.items() for x in ([n, f"{n}_before"] if isinstance(c, Fingerprint) else [n]))]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{x} long" for x in extra), "part int"])
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = materialize(mapped(dealt, _local_scan(key, columns, arrow_schema(spark, ddl)), ddl), name)
    # a row for each partition
    edges = local.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    ends = local.join(F.broadcast(edges.select("part", F.col("last").alias(key))), ["part", key]).groupBy("part").agg(
        F.max("place").alias("place"), *(F.max_by(n, "place").alias(n) for n in columns)
    )
    held, state = [], None
    for r in edges.join(ends, "part").orderBy("part").collect():
        now = {n: r[n] for n in ("place", *columns)}
        if state and state[0] == r["first"]:
            before = state[1]
            held.append((r["part"], r["first"], before["place"], *(x for n, c in columns.items() for x in _carried(before, n, c))))
            if r["last"] == r["first"]:
                now = {n: _joined(before, now, n, columns.get(n)) for n in now}
        state = r["last"], now
    held_ddl = ", ".join(["h_part int", "h_key long", "h_place long", *(f"h_{n} long, p_{n} long" for n in columns)])
    table = F.broadcast(spark.createDataFrame(held, held_ddl))
    out = local.join(table, (F.col("part") == F.col("h_part")) & (F.col(key) == F.col("h_key")), "left")
    whole = {"place": F.col("place") + F.coalesce("h_place", F.lit(0))}
    for n, c in columns.items():
        if isinstance(c, Sum):
            whole[n] = F.col(n) + F.coalesce(f"h_{n}", F.lit(0))
        else:
            for x in (n, f"{n}_before"):
                whole[x] = F.when(F.col("h_key").isNull(), F.col(x)).otherwise((F.col(x) * F.col(f"p_{n}") + F.col(f"h_{n}")) % c.prime)
    return out.select(*df.columns, *(whole[x].alias(x) for x in extra))


def _carried(before: dict, name: str, c: Sum | Fingerprint) -> tuple[int, int]:
    return before[name], pow(c.base, before["place"], c.prime) if isinstance(c, Fingerprint) else 1


def _joined(before: dict, now: dict, name: str, c: Sum | Fingerprint | None) -> int:
    if isinstance(c, Fingerprint):
        value, factor = _carried(before, name, c)
        return (value + factor * now[name]) % c.prime
    return before[name] + now[name]
