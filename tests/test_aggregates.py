"""User aggregates by merged states, against the same aggregate over all rows at once."""

import math
import random

import pytest

from millrace.functions import aggregates
from millrace.plans.scale import Spread


def longest():
    """An aggregate made here, so that workers need not import this file."""

    class Longest:
        """The longest string and how many rows there were; says how many states one merge has seen together."""

        def zero(self):
            return (0, "", 1)

        def update(self, state, rows):
            words = [w for w in rows.column("w").to_pylist() if w is not None]
            return state[0] + rows.num_rows, max([state[1], *words], key=lambda w: (len(w), w)), 1

        def merge(self, a, b):
            return a[0] + b[0], max(a[1], b[1], key=lambda w: (len(w), w)), a[2] + b[2]

        def finish(self, state):
            return f"{state[0]} {state[1]}"

    return Longest()


@pytest.mark.parametrize("most_states,fan_in,parts", [(10_000, 64, 4), (1, 3, 9), (2, 2, 17)])
def test_states_are_those_of_all_rows(spark, most_states, fan_in, parts):
    rng = random.Random(1)
    rows = [("hot" if i % 2 else rng.choice(["a", None, "c"]), i % 2 and rng.choice([1, None]), rng.choice([None, "x" * rng.randint(0, 30)])) for i in range(800)]
    df = spark.createDataFrame(rows, "k0 string, part int, w string").repartition(parts)
    got = aggregates.merged_aggregate(df, ["k0", "part"], ["w"], longest(), "state", "string", most_states, fan_in).collect()
    want = {}
    for k, p, w in rows:
        n, best = want.get((k, p), (0, ""))
        want[k, p] = n + 1, max(best, w or "", key=lambda w: (len(w), w))
    assert {(r.k0, r.part): r.state for r in got} == {k: f"{n} {w}" for k, (n, w) in want.items()} and len(got) == len(want)


def test_no_keys_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "k string, x double").repartition(3)
    whole = lambda d: aggregates.merged_aggregate(d, [], ["x"], Spread(), "s", "struct<lse: double, top: array<double>>").collect()
    (row,) = whole(df)
    assert math.isclose(row.s.lse, math.log(math.e + math.e**2)) and row.s.top == [2.0, 1.0]
    (row,) = whole(df.limit(0))
    assert row.s.lse is None and row.s.top == []
    assert aggregates.merged_aggregate(df.limit(0), ["k"], ["x"], Spread(), "s", "struct<lse: double, top: array<double>>").collect() == []
