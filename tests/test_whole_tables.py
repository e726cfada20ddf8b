"""Queries over whole tables, against counts taken from the parquet files."""

import pyarrow.parquet as pq

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_join_full(spark, tmp_path):
    for name in ("supplier", "customer"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "customer":  # keys beyond any small bound
            rows = rows.withColumn("c_custkey", rows.c_custkey + 1000)
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.a_key, r.b_key) for r in QUERIES["join_full"](spark, str(tmp_path)).collect()}
    a = {r["s_suppkey"]: r["s_nationkey"] for r in table("supplier") if r["s_nationkey"] < 5}
    b = {r["c_custkey"] + 1000: r["c_nationkey"] for r in table("customer") if r["c_nationkey"] > 3}
    want = {(x, y) for x in a for y in b if a[x] == b[y]}
    want |= {(x, None) for x in a if a[x] not in b.values()} | {(None, y) for y in b if b[y] not in a.values()}
    assert got == want and {y for _, y in got} - {None} == set(b)


def test_vector_similarity(spark):
    got = {(r.query_id, r.vec_id) for r in QUERIES["vector_similarity"](spark, SF).collect()}
    ids = {r["vec_id"] for r in table("embeddings")}
    assert got == {(q, v) for q in ids if q % 100 == 0 for v in ids} and len({q for q, _ in got}) > 1


def test_posexplode_vector(spark):
    got = {(r.vec_id, r.pos): r.value for r in QUERIES["posexplode_vector"](spark, SF).collect()}
    assert got == {(r["vec_id"], k): x for r in table("embeddings") for k, x in enumerate(r["embedding"])}
