import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import records

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, shard int"


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    rng = random.Random(1)
    data = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 3, 4, 5, 8, 511, 512, 513, 1024, 3000, 9]]
    assert records.crc32c([b"123456789"]).tolist() == [0xE3069283]
    assert records.crc32c(data).tolist() == [slow_crc32c(d) for d in data]
    assert records.crc32c([]).tolist() == []


def test_damage_is_found():
    raw = bytearray(records.frame([b"abc", b"", b"hello world"]))
    index = np.array([(0, 3, 0, 0), (19, 0, 0, 0), (35, 11, 0, 0)], records.INDEX)
    assert records.unframe(bytes(raw), index) == [b"abc", b"", b"hello world"]
    for at in range(len(raw)):
        raw[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(raw), index)
        raw[at] ^= 1


def test_round_trip(spark):
    rng = random.Random(2)
    rows = [(None, "no id"), (5, None), (6, ""), (7, "same"), (7, "same"), (-3, "before\tall")]
    rows += [(i * 3 + 10, " ".join(rng.choice(["one", "two,", "Ärger", "x\n"]) for _ in range(rng.randint(0, 50)))) for i in range(300)]
    rows += [(8, "long " * 30_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = records.round_trip(spark, df, PATH).collect()
    plain = Tokenizer.from_file(PATH)
    want, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_shuffled_read(spark):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    shard = records.write_records(df, PATH).filter("records > 3").collect()[0]
    plain = Tokenizer.from_file(PATH)
    all_ids = {tuple([*plain.encode(f"text number {i}", add_special_tokens=False).ids, 1]) for i in range(20)}
    for got in records.read_at(shard.path, [3, 0, 2]):
        assert tuple(got.tolist()) in all_ids


def test_shards_roll_and_ranges_split(spark, monkeypatch):
    monkeypatch.setattr(records, "INDEX_ROWS", 7)
    df = spark.createDataFrame([(i, f"text number {i} " * (i % 9)) for i in range(400)], "doc_id long, text string").coalesce(2)
    manifest = records.write_records(df, PATH, shard_bytes=4000)
    # slices of texts are written whole; a task begins a new shard behind one that is full
    assert manifest.agg({"records": "sum"}).first()[0] == 400
    want = sorted(map(tuple, records.read_records(manifest, with_ids=False).collect()), key=lambda r: r[1])
    small = records.read_records(manifest, chunk_bytes=100, with_ids=False, range_bytes=500)
    assert small.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, small.collect()), key=lambda r: r[1]) == want and [r[0] for r in want] == list(range(400))
    shard = manifest.collect()[0]
    with pytest.raises(IndexError):
        records.read_at(shard.path, [shard.records])


def test_special_tokens(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|STARTOFTEXT|>")], "doc_id long, text string")
    plain = Tokenizer.from_file(PATH)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in records.read_records(records.write_records(df, PATH)).collect()}
    want = {d: [*plain.encode(t, add_special_tokens=False).ids, 1] for d, t in ((1, "a <|endoftext|> b"), (2, "<|STARTOFTEXT|>"))}
    assert got == want and 49407 in want[1] and 49406 not in want[2]


def test_empty_table(spark):
    assert records.round_trip(spark, spark.createDataFrame([], SCHEMA), PATH).collect() == []
