import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing
from millrace.llm.tokenization import ChunkEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, salt string, length string"


def bins_of(sizes, capacity):
    counts = np.bincount(sizes, minlength=capacity + 1)
    return packing.plan_packing(counts, capacity)


def fewest(sizes, capacity):
    """Brute force: the fewest bins."""
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                go(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_dominance_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 30])
    sizes = [rng.randint(1 + capacity // 8, capacity) for _ in range(rng.randint(1, 11))]
    counts = np.bincount(sizes, minlength=capacity + 1)
    left = counts.copy()
    fixed = packing.reduce_by_dominance(left, capacity)
    rest = list(itertools.chain.from_iterable([s] * int(n) for s, n in enumerate(left)))
    assert sum(g.bins for g in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity)


@pytest.mark.parametrize("seed", range(10))
def test_plan_holds_every_piece_once(seed):
    rng = random.Random(seed)
    sizes = [min(100, 1 + int(rng.expovariate(0.05))) for _ in range(3000)]
    groups = bins_of(sizes, 100)
    got = np.zeros(101, int)
    for g in groups:
        assert sum(s * k for s, k in g.entries) + g.room == 100 and g.room >= 0
        for s, k in g.entries:
            got[s] += k * g.bins
    assert (got == np.bincount(sizes, minlength=101)).all()
    assert sum(g.bins for g in groups) <= 1.02 * -(-sum(sizes) // 100) + 1


def test_cut_puts_the_short_piece_first():
    assert packing.cut(5, 10) == [(0, 5)]
    assert packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)]


def test_documents(spark):
    rng = random.Random(3)
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (None, "no id here", "x", "y"), (3, "same", "x", "y"), (3, "same", "x", "y")]
    rows += [(10 + i, " ".join(rng.choice(["alpha", "beta,", "x\ny", "  z"]) for _ in range(rng.randint(1, 60))), "", "") for i in range(150)]
    rows += [(999, "word " * 500, "", "")]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), PATH, capacity=64).collect()
    plain = Tokenizer.from_file(PATH)
    want = []
    for doc, text, *_ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, (start, n) in enumerate(packing.cut(len(ids), 64)):
            want.append((doc, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for spots in held.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 64
    assert len(held) <= 1.1 * -(-sum(w[3] for w in want) // 64)


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (2, "four"), (None, None)], "doc_id long, text string")
    pieces = packing.token_pieces(docs, PATH, 8, with_ids=True)
    packed = packing.pack_pieces(pieces.drop("ids"), 8)
    rows = packing.sequences(pieces, packed, 8).collect()
    assert sum(r.n_tokens for r in rows) == sum(r.length for r in pieces.collect())
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows)


def test_names_that_clash_and_alike_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_SLICES", 4)
    rows = [(None, 0, 0, 1 + i % 5, 7, i, "x", i, i, i) for i in range(500)] + [(1, 0, 0, 3, 7, 0, "x", 0, 0, 0)] * 400
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, salt int, before string, rank int, place int, slices int"
    out = packing.pack_pieces(spark.createDataFrame(rows, schema), 16)
    assert out.columns[5:10] == ["salt", "before", "rank", "place", "slices"]
    got = out.collect()
    assert sorted(map(str, (tuple(r)[:10] for r in got))) == sorted(map(str, rows))
    spots = {(r.sequence_id, r.offset + k) for r in got for k in range(r.length)}
    assert len(spots) == sum(r[3] for r in rows) and max(o for _, o in spots) < 16
    with pytest.raises(ValueError):
        packing.pack_pieces(out, 16)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(name):
    model = ChunkEncoder(public_tokenizers.path(name), memo_entries=300)
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(5)
    parts = ["a", "Word", " ", "  ", "\n", "\n\n", "\t", "　", "\x85", "\x1c", ",", "é", "'s", "12", "́", "\r\n", "İ", "Σ", "~", "\0", "🙂", "<|", "|>"]
    parts += ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endof", "text|>"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for at in range(0, len(rows), 500):
        part = rows[at : at + 500]
        got = [np.frombuffer(b, model.dtype).tolist() for b in model.encode(part)]
        assert got == [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]
