import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import substring

SCHEMA = "doc_id long, text string, n int, tie string, start int, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """Per row: words, removed words, hash of what is kept."""
    split = [WORDS.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, _), words in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["é\xa0x", "a\x1cb"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "\t ", "  "]).join(words)))
    rows += [(100, None), (101, ""), (102, "  "), (None, rows[3][1]), (4, rows[4][1]), (103, "x " * 300), (104, rows[5][1] + " " + rows[5][1])]
    return rows


@pytest.mark.parametrize("window,gram,cells", [(10, 5, 1 << 20), (10, 10, 1 << 20), (35, 18, 1 << 20), (7, 4, 1 << 16), (35, 18, 1 << 17)])
def test_against_brute_force(spark, window, gram, cells):
    rows = corpus(window)
    df = spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in rows], SCHEMA).repartition(5)
    got = substring.removal_digests(df, window, gram=gram, max_cells=cells).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, window), key=key)


def test_saturated_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring, "sketch_size", lambda n, most: (1 << 16, 1))
    rng = random.Random(0)
    rows = [(i, " ".join(str(rng.randint(0, 10**6)) for _ in range(4000))) for i in range(40)]
    rows += [(50, rows[0][1][500:5000])]
    got = substring.removal_digests(spark.createDataFrame(rows, "doc_id long, text string"), 8, gram=4).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 8))


def test_slices_keep_the_share_of_windows_flat(spark, monkeypatch):
    """With a bound on a worker's cells, texts ten times as long pass on no larger a share of their unique windows."""
    rng = random.Random(0)
    monkeypatch.setattr(substring, "MIN_CELLS", 1 << 16)
    passed = []
    for n in (20, 200):
        rows = [(i, " ".join(str(rng.randint(0, 10**6)) for _ in range(3000))) for i in range(n)] + [(n, "one two three four " * 3)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        n_bytes = sum(len(t) for _, t in rows)
        cells, slices = substring.sketch_size(n_bytes, 1 << 16)
        docs = df.selectExpr("text", "spark_partition_id() as part")
        docs = substring.materialize(docs, "t")
        sketch = substring.build_sketch(docs, cells, slices, 35, 18)
        assert cells == 1 << 16 and slices == max(1, (1 << (n_bytes // 12 - 1).bit_length()) // cells)
        routed = substring.route_anchors(docs, sketch, cells, slices, 35, 18) if slices > 1 else None
        share = 0
        for r in docs.collect():
            hashes = substring.hash_words(r.text.encode())[0]
            if routed:
                found = substring.candidates(hashes, lambda k: substring._held(k, substring._load_keys(routed, r.part)), 35, 18)  # noqa: B023
            else:
                bits = substring._load_sketch(sketch, cells)
                found = substring.candidates(hashes, lambda k: substring.estimated_repeated(k, bits, cells), 35, 18)  # noqa: B023
            share += len(found)
        passed.append(share / (n * 2966))
        got = substring.removal_digests(df, 35, max_cells=1 << 16).collect()
        assert sorted(map(tuple, got)) == sorted(brute(rows, 35))
    assert slices >= 8 and passed[1] <= 1.5 * passed[0] + 0.01 and passed[1] < 0.2


def test_other_names(spark):
    rows = corpus(10)
    df = spark.createDataFrame(rows, "key long, body string")
    got = substring.removal_digests(df, 10, gram=5, id_col="key", text_col="body")
    assert got.columns[0] == "key" and got.count() == len(rows)


@pytest.mark.parametrize("cells", [1 << 30, 1 << 16])
def test_kept_text_and_columns(spark, cells):
    rows = corpus(3)
    df = spark.createDataFrame([(d, t, 1, "x", 2, len(t or "")) for d, t in rows], SCHEMA)
    out = substring.without_repeats(df, 10, gram=5, max_cells=cells)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text, r.n_chars) for r in out.collect())
    want = Counter()
    for (doc, text), (_, n, gone, _) in zip(rows, brute(rows, 10), strict=True):
        if gone:
            words, keep = WORDS.findall(text), None
            texts = [x for x in got if x[0] == doc and hashlib.sha256((x[1] or "").encode()).hexdigest() == brute(rows, 10)[rows.index((doc, text))][3]]
            keep = texts[0][1]
            assert len(WORDS.findall(keep)) == n - gone and len(words) == n
            want[(doc, keep, len(keep))] += 1
        else:
            want[(doc, text, len(text or ""))] += 1
    assert got == want


def test_anchors_are_those_of_equal_windows():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    words[300:360] = words[100:160]
    grams, places = substring.anchors(words, 35, 18)
    for i in range(26):
        assert places[100 + i] - (100 + i) == places[300 + i] - (300 + i)
        assert grams[places[100 + i]] == grams[places[300 + i]]


@pytest.mark.parametrize("cells", [1 << 30, 1 << 16])
def test_texts_without_a_window(spark, cells, monkeypatch):
    monkeypatch.setattr(substring, "sketch_size", lambda n, most: (1 << 16, 1 if most > 1 << 16 else 4))
    rows = [(1, None), (2, ""), (3, "short"), (None, "also short"), (3, "short")]
    df = spark.createDataFrame([(d, t, 1, "x", 2, len(t or "")) for d, t in rows], SCHEMA).repartition(3)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = substring.removal_digests(df, max_cells=cells).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 35), key=key)
    assert sorted(substring.without_repeats(df, max_cells=cells).collect(), key=key) == sorted(df.collect(), key=key)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring.removal_digests(empty).collect() == []
    assert substring.without_repeats(empty).collect() == []


def thue_morse(n, zero="a", one="b"):
    return "".join(one if i.bit_count() % 2 else zero for i in range(n))


@pytest.mark.parametrize("size", [8, 16, 64, 512, 1024, 4096])
def test_structured_words_differ(spark, size):
    """A Thue-Morse word and its complement, alone and inside windows that are else equal."""
    x, y = thue_morse(size), thue_morse(size, "b", "a")
    for lane in (0, 1):
        hashes = substring.hash_words(f"{x} {y} {x}".encode(), lane)[0]
        assert hashes[0] == hashes[2] != hashes[1]
    rows = [(k, " ".join([*(f"w{i}" for i in range(17)), word, *(f"v{i}" for i in range(17))])) for k, word in enumerate((x, y))]
    rows += [(2, f"{x} " * 36), (3, f"{y} " * 36), (4, rows[0][1] + " end")]
    got = substring.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 35))
    assert {r.doc_id: r.n_removed for r in got} == {0: 35, 1: 0, 2: 36, 3: 36, 4: 35}


def test_word_hashes_follow_the_words_only():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab\x00é") for _ in range(rng.randint(1, 40))) for _ in range(30_000)})
    for lane in (0, 1):
        found = {}
        for text in (" ".join(words), "\n ".join(reversed(words))):
            hashes, starts, ends = substring.hash_words(text.encode(), lane)
            for h, a, b in zip(hashes.tolist(), starts.tolist(), ends.tolist(), strict=True):
                assert found.setdefault(text.encode()[a:b], h) == h
        assert len(set(found.values())) == len(words)
    assert not np.array_equal(substring.hash_words(b"a b")[0], substring.hash_words(b"a b", 1)[0])
