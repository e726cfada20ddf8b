"""N-gram Jaccard self-join with Bayesian candidate pruning (after BayesLSH).

Texts are sets of word 5-grams; two texts are linked if their Jaccard
similarity is at least 0.8. Copies (equal sets) are one *node*.

1. Each node gets MinHash values, in 40 bands of 6. Nodes that share a band are
   candidates: a pair at 0.8 shares none once in 200,000 times. A shared band is
   a star around its smallest node, never all pairs, and the connected
   components of the stars are groups within which all candidates lie.
   A group that has grown beyond ``large_nodes``, as chains of chance candidates
   may in a large corpus, is taken apart again into its buckets, the nodes of
   one band key; of buckets with the same nodes one is enough, and a pair counts
   in the first band that it shares.
2. A group or bucket is dealt into blocks, bounded in nodes and in grams. Each
   text goes to its block once, where it becomes a gram set and MinHash values.
   Pairs that share a band are compared MinHash value by MinHash value: after
   every 48 the posterior probability that the similarity reaches the threshold
   (uniform prior) is looked at, and the pair is dropped once that is below
   ``tolerance``. The rest is verified exactly on the sets.
3. Where there are several blocks, each is also written to the shared folder,
   and a task for each block reads the others there, one at a time. Nothing but
   a row for each node and the edges of a forest comes out of it, however many
   pairs it has seen.
4. Local roots are joined to classes by connected components.

The work on a group of n near-equal texts is that of its links, in blocks; the
rows that are shuffled are n. Nothing is sampled or capped.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import (
    RowBuffer,
    arrow_schema,
    key_filter,
    left_join_few,
    map_rows,
    materialize,
    passes,
    shared_dir,
    sliced,
    source_columns,
    store,
    text_bytes,
)
from millrace.llm.graph import connected_components, join_counted
from millrace.llm.substring import _MULTIPLIERS, _mix, _rolling, hash_words

N_GRAM = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction, so that the exact check has no rounding
BANDS, BAND_ROWS = 40, 6
STEP = 48  # MinHash values compared between two looks at the posterior
TOLERANCE = 1e-6
#: Nodes of a block, and grams of a block (8 bytes each), on average.
BLOCK_NODES = 512
BLOCK_GRAMS = 1 << 20
#: Nodes of a group from which on its buckets are verified instead: no node meets more than so many others by chance.
LARGE_NODES = 8192

_RNG = np.random.default_rng(20_240_601)
_A = _RNG.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32) | np.uint32(1)  # odd: permutations of the 32-bit numbers
_B = _RNG.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32)


# ---------------------------------------------------------------- one text


def shingles(data: bytes, n: int = N_GRAM) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; a shorter text is one gram; no words, none."""
    hashes = hash_words(data)[0]
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(_mix(_rolling(hashes, min(n, len(hashes)), _MULTIPLIERS[0])))


def minhash(grams: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each, of a set that isn't empty, from the upper halves of its hashes."""
    upper = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for low in range(0, len(upper), 1024):
        np.minimum(out, (upper[None, low : low + 1024] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """[text, band]: a 64-bit key of each band of MinHash values."""
    rows = signatures.reshape(len(signatures), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.full(rows.shape[:2], 0x9E3779B97F4A7C15, np.uint64)
    for k in range(BAND_ROWS):
        key = _mix((key ^ rows[:, :, k]) * np.uint64(0xD6E8FEB86659FD93))
    return key


@lru_cache(maxsize=8)
def least_matches(threshold: tuple[int, int], tolerance: float, step: int, top: int) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on) at each look.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1),
    and P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, out = threshold[0] / threshold[1], []
    for n in range(step, top + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


# ---------------------------------------------------------------- one block


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


@dataclass
class Block:
    """Gram sets of some nodes, one after the other, and what follows from them."""

    nodes: np.ndarray  # ascending
    sizes: np.ndarray
    grams: np.ndarray  # of the first node, of the second, ..
    signatures: np.ndarray
    roots: np.ndarray | None = None  # the smallest node that a node is connected to within the block

    def __post_init__(self):
        self.bands = band_keys(self.signatures)
        self.edges = np.append(0, np.cumsum(self.sizes))

    @classmethod
    def of(cls, nodes: list[int], sets: list[np.ndarray]) -> Block:
        sizes = np.array([len(s) for s in sets], np.int64)
        return cls(np.array(nodes, np.int64), sizes, np.concatenate(sets), np.stack([minhash(s) for s in sets]))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, nodes=self.nodes, sizes=self.sizes, grams=self.grams, signatures=self.signatures, roots=self.roots)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Block:
        with np.load(io.BytesIO(data)) as found:
            return cls(*(found[k] for k in ("nodes", "sizes", "grams", "signatures", "roots")))


def shared_grams(a: Block, b: Block, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Grams that the sets of each pair share."""
    same = a is b
    names, codes = np.unique(a.grams if same else np.concatenate([a.grams, b.grams]), return_inverse=True)
    own, other = codes[: len(a.grams)], codes if same else codes[len(a.grams) :]
    # a product of matrices is cheaper where most pairs are asked for, and the sets are alike
    if len(a.sizes) * len(b.sizes) * len(names) < 20_000 * len(xs):
        total = np.zeros((len(a.sizes), len(b.sizes)), np.float32)  # counts far below 2**24 are exact
        rows, columns = np.repeat(np.arange(len(a.sizes)), a.sizes), np.repeat(np.arange(len(b.sizes)), b.sizes)
        for low in range(0, len(names), 4096):
            parts = []
            for block, at, where in ((a, own, rows), (b, other, columns)):
                inside = (at >= low) & (at < low + 4096)
                table = np.zeros((len(block.sizes), min(4096, len(names) - low)), np.float32)
                table[where[inside], at[inside] - low] = 1
                parts.append(table)
            total += parts[0] @ parts[1].T
        return total[xs, ys].astype(np.int64)
    out, mark, last = np.empty(len(xs), np.int64), np.zeros(len(names), bool), -1
    for k, (x, y) in enumerate(zip(xs.tolist(), ys.tolist(), strict=True)):
        if x != last:
            if last >= 0:
                mark[own[a.edges[last] : a.edges[last + 1]]] = False
            mark[own[a.edges[x] : a.edges[x + 1]]] = True
            last = x
        out[k] = np.count_nonzero(mark[other[b.edges[y] : b.edges[y + 1]]])
    return out


def linked_pairs(
    a: Block, b: Block, threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE, band: int = -1
) -> tuple[np.ndarray, np.ndarray]:
    """Indices (in ``a``, in ``b``) of the linked pairs; of one block with itself each pair once.

    ``band`` (a bucket): only pairs count whose first shared band it is.
    """
    looks = least_matches(threshold, tolerance, STEP, a.signatures.shape[1])
    up, down = threshold
    none = np.empty(0, np.int64)
    xs, ys = [none], [none]
    for x in range(len(a.sizes)):
        low = x + 1 if a is b else 0
        shares = b.bands[low:] == a.bands[x]
        y = low + np.flatnonzero(shares.any(axis=1) if band < 0 else shares[:, band] & ~shares[:, :band].any(axis=1))
        matches, before = np.zeros(len(y), np.int64), 0
        for count, least in looks:
            if not len(y):
                break
            matches += (b.signatures[y, before:count] == a.signatures[x, before:count]).sum(axis=1)
            y, matches, before = y[matches >= least], matches[matches >= least], count
        xs.append(np.full(len(y), x, np.int64))
        ys.append(y)
    x, y = np.concatenate(xs), np.concatenate(ys)
    if not len(x):
        return x, y
    shared = shared_grams(a, b, x, y)
    keep = down * shared >= up * (a.sizes[x] + b.sizes[y] - shared)
    return x[keep], y[keep]


def link_within(block: Block, threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE, band: int = -1) -> np.ndarray:
    """Links of each node inside its block; sets the block's roots."""
    x, y = linked_pairs(block, block, threshold, tolerance, band)
    n, forest = len(block.sizes), _Forest(len(block.sizes))
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        forest.join(i, j)
    block.roots = block.nodes[[forest.root(k) for k in range(n)]]
    return np.bincount(x, minlength=n) + np.bincount(y, minlength=n)


# ---------------------------------------------------------------- Spark


def signatures(df: DataFrame, id_col: str, text_col: str, n_gram: int) -> DataFrame:
    """``id, tie, s1, s2, size, bands``: a 128-bit hash of the set, its grams, and its band keys. Texts without words: nulls."""
    import xxhash  # noqa: F401  needed on the executors; missing it should show here

    def run(batch: pa.RecordBatch):
        import xxhash

        columns = (batch.column(c).to_pylist() for c in ("id", "tie"))
        for doc, tie, data in zip(*columns, text_bytes(batch.column("text")), strict=True):
            grams = shingles(data, n_gram)
            if not len(grams):
                yield (doc, tie, None, None, None, None), 64
                continue
            pair = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64).tolist()
            yield (doc, tie, *pair, len(grams), band_keys(minhash(grams)[None])[0].view(np.int64)), 400

    rows = source_columns(df, id=id_col, text=text_col).withColumn("tie", F.xxhash64("text"))
    return map_rows(rows, run, "id long, tie long, s1 long, s2 long, size int, bands array<long>")


def candidate_stars(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """Edges (a, b) from the nodes of each shared band to its smallest node."""
    rows = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    # counts and minima are summed before the shuffle, so a band that many share is no burden
    hubs = rows.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    found = join_counted(rows, hubs, ["band", "key"], BANDS * n_nodes)
    return found.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def large_buckets(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """``band, key, n, grams, node`` of the shared buckets of some nodes; of buckets with the same nodes the one of the first band.

    ``n`` and ``grams`` count the nodes of the bucket and their grams.
    """
    rows = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    mark = F.xxhash64("node")
    buckets = rows.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.sum("size").alias("grams"), F.sum(mark.cast("decimal(38,0)")).alias("total"), F.bit_xor(mark).alias("parity")
    )
    first = buckets.filter("n > 1").groupBy("n", "grams", "total", "parity").agg(F.min(F.struct("band", "key")).alias("bucket"))
    first = first.select("bucket.band", "bucket.key", "n", "grams")
    return join_counted(rows.drop("size"), first, ["band", "key"], BANDS * n_nodes)


def _dealt(members: DataFrame, block_nodes: int) -> DataFrame:
    """Members with the number of blocks of their group or bucket, and their block."""
    blocks = F.greatest(F.ceil(F.col("n") / block_nodes), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    return members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


_FOUND = "node long, links long, root long, whole boolean, band int, key long, block int, attempt long"


def _block_path(folder: str, band: int, key: int, block: int, attempt: int) -> str:
    return f"{folder}/{block % 256:02x}/{band}.{key}.{block}.{attempt}.npz"


def verify_blocks(rows: DataFrame, folder: str, n_gram: int, threshold: tuple[int, int], tolerance: float) -> DataFrame:
    """Links within the blocks of ``band, key, block, blocks, node, text``; a band of -1 stands for a whole group.

    A row for each node, ``whole`` if its root is final. Blocks that aren't the
    only one are also written below ``folder``; a row without a node names the
    attempt whose file counts.
    """
    schema = arrow_schema(rows.sparkSession, _FOUND)
    names = ["band", "key", "block"]

    def close(key: tuple, found: dict[int, bytes], blocks: int, buffer: RowBuffer) -> None:
        band, group, number = key
        nodes = sorted(found)
        block = Block.of(nodes, [shingles(found[x], n_gram) for x in nodes])
        links = link_within(block, threshold, tolerance, band)
        for x, count, root in zip(nodes, links.tolist(), block.roots.tolist(), strict=True):
            buffer.add((x, count, root, band < 0 and blocks == 1, band, group, number, None), 64)
        if blocks > 1:
            attempt = TaskContext.get().taskAttemptId()
            fs, path = store(_block_path(folder, band, group, number, attempt))
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(block.dump())
            buffer.add((None, None, None, None, band, group, number, attempt), 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, key, found, size = RowBuffer(schema), None, {}, 0
        for batch in sliced(batches):
            columns = [batch.column(c).to_pylist() for c in (*names, "node", "blocks")]
            for *now, node, blocks, data in zip(*columns, text_bytes(batch.column("text")), strict=True):
                if tuple(now) != key:
                    if found:
                        close(key, found, size, buffer)
                    key, found = tuple(now), {}
                    if buffer.full:
                        yield buffer.take()
                found[node], size = data, blocks
        if found:
            close(key, found, size, buffer)
        if buffer.rows:
            yield buffer.take()

    dealt = rows.select(*names, "node", "blocks", "text")
    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, _FOUND)


def verify_across(found: DataFrame, folder: str, threshold: tuple[int, int], tolerance: float) -> DataFrame:
    """Links between the blocks of a group: a task for each block, which reads the others one at a time.

    Links of its own nodes, and edges ``node, root`` (links 0) that join roots
    of two blocks, as few as connect them.
    """
    spark = found.sparkSession
    schema = arrow_schema(spark, _FOUND)
    files = found.filter("attempt is not null").groupBy("band", "key", "block").agg(F.max("attempt").alias("attempt"))
    lists = files.groupBy("band", "key").agg(F.sort_array(F.collect_list(F.struct("block", "attempt"))).alias("files"))
    strips = lists.select("band", "key", "files", F.explode("files.block").alias("block"))

    def read(band: int, key: int, block: int, attempt: int) -> Block:
        fs, path = store(_block_path(folder, band, key, block, attempt))
        with fs.open_input_stream(path) as f:
            return Block.load(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = RowBuffer(schema)
        for batch in sliced(batches, 1):
            band, key, number = (batch.column(c)[0].as_py() for c in ("band", "key", "block"))
            files = {f["block"]: f["attempt"] for f in batch.column("files")[0].as_py()}
            own = read(band, key, number, files[number])
            links, up = np.zeros(len(own.nodes), np.int64), {}

            def root(x: int, up=up) -> int:
                while up.get(x, x) != x:
                    x = up[x]
                return x

            for other, attempt in files.items():
                if other == number:
                    continue
                block = read(band, key, other, attempt)
                x, y = linked_pairs(own, block, threshold, tolerance, band)
                links += np.bincount(x, minlength=len(links))
                if other > number:  # the other block's task sees the same links
                    pairs = np.unique(np.stack([own.roots[x], block.roots[y]], axis=1), axis=0)
                    for p, q in pairs.tolist():
                        a, b = root(p), root(q)
                        if a != b:
                            up[max(a, b)] = min(a, b)
                            buffer.add((max(p, q), 0, min(p, q), False, band, key, number, None), 64)
            for node, count in zip(own.nodes.tolist(), links.tolist(), strict=True):
                buffer.add((node, count, node, False, band, key, number, None), 64)
            if buffer.full:
                yield buffer.take()
        if buffer.rows:
            yield buffer.take()

    return strips.repartition("band", "key", "block").mapInArrow(run, _FOUND)


def near_duplicates(
    df: DataFrame,
    n_gram: int = N_GRAM,
    threshold: tuple[int, int] = THRESHOLD,
    tolerance: float = TOLERANCE,
    block_nodes: int = BLOCK_NODES,
    large_nodes: int = LARGE_NODES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, tie, class_id, n_copies, n_links, first``.

    ``class_id`` is the smallest id that the row is connected to by links;
    ``n_copies`` counts the rows with its set of grams, itself included;
    ``n_links`` counts the different sets linked to it. ``first`` marks the rows
    that are the class's first by id and ``tie``, a hash of the text.

    * Words are runs without ASCII white space. Texts of fewer than ``n_gram``
      words have one gram; null, empty and blank texts have none, and are
      classes of their own.
    * Very long texts count whole. Repeated rows are copies.
    * Null ids are kept; a class of null ids only has a null ``class_id``.
    * An empty table gives no rows. Further columns are not read.
    """
    spark = df.sparkSession
    signed = materialize(signatures(df, id_col, text_col, n_gram), "signatures")
    sets = signed.filter("s1 is not null").groupBy("s1", "s2").agg(
        F.min("id").alias("least_id"),
        F.min(F.struct("id", "tie")).alias("rep"),
        F.count("*").alias("n_copies"),
        F.first("size").alias("size"),
        F.first("bands").alias("bands"),
    )
    # the numbers are fixed once written
    nodes = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n_nodes = nodes.count()
    groups = connected_components(candidate_stars(nodes, n_nodes)).join(nodes.select("node", "size"), "node")
    groups = materialize(groups, "groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    groups = join_counted(groups.drop("size"), sizes, ["component"], n_nodes)
    members = groups.filter(F.col("n") <= large_nodes)
    members = members.select(F.lit(-1).alias("band"), F.col("component").alias("key"), "n", "grams", "node")
    inside = groups.filter(F.col("n") > large_nodes).select("node")
    if not inside.isEmpty():
        members = members.unionByName(large_buckets(nodes.join(inside, "node", "left_semi"), n_nodes))
    members = members.join(nodes.select("node", "rep.id", "rep.tie"), "node").withColumnsRenamed({"id": "rep_id", "tie": "rep_tie"})
    members = materialize(_dealt(members, block_nodes), "members")
    docs = source_columns(df, id=id_col, text=text_col).withColumn("tie", F.xxhash64("text"))
    docs = passes(docs, "tie", key_filter(members, "rep_tie", members.count()), "may_match").filter("may_match")
    on = docs["id"].eqNullSafe(members["rep_id"]) & docs["tie"].eqNullSafe(members["rep_tie"])
    folder = shared_dir(spark, "blocks")
    found = materialize(verify_blocks(docs.join(members, on), folder, n_gram, threshold, tolerance), "links")
    if not found.filter("attempt is not null").isEmpty():
        across = materialize(verify_across(found, folder, threshold, tolerance), "across")
        found = found.unionByName(across)
    found = found.filter("node is not null")
    per_node = found.groupBy("node").agg(F.sum("links").alias("n_links"), F.max(F.when(F.col("whole"), F.col("root"))).alias("label"))
    slim = nodes.select("s1", "s2", "node", "least_id", "rep", "n_copies").join(per_node, "node", "left")
    cut = found.filter("not whole and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not cut.isEmpty():
        slim = slim.join(connected_components(cut), "node", "left").withColumn("label", F.coalesce("component", "label")).drop("component")
    slim = slim.withColumn("label", F.coalesce("label", "node"))
    slim = materialize(slim, "labels")
    classes = slim.groupBy("label").agg(F.min("least_id").alias("class_id"), F.min("rep").alias("class_rep"), F.count("*").alias("n"))
    known = join_counted(slim, classes, ["label"], n_nodes).select("s1", "s2", "class_id", "class_rep", "n_copies", "n_links")
    out = signed.select("id", "tie", "s1", "s2").join(known, ["s1", "s2"], "left")
    bare = F.col("s1").isNull()
    return out.select(
        F.col("id").alias(id_col),
        "tie",
        F.when(bare, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (bare | F.struct("id", "tie").eqNullSafe(F.col("class_rep"))).alias("first"),
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that are the first of their class; of rows alike in id and text, one.

    Texts without words are classes of their own, so all their rows stay.
    """
    marks = near_duplicates(df, id_col=id_col, text_col=text_col, **options)
    # rows that go, and rows alike in id and text, of which one stays; all others are passed on without a shuffle
    few = marks.groupBy(F.col(f"`{id_col}`").alias("k_id"), F.col("tie").alias("k_tie"))
    few = few.agg(F.max("first").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1").drop("n")
    few = materialize(few, "few")
    columns = df.columns
    body = df.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"),
        F.col(f"`{id_col}`").alias("b_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("b_tie"),
        (F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) == 0).alias("bare"),
    )
    joined = left_join_few(body, few, [("b_id", "k_id"), ("b_tie", "k_tie")], "b_tie", "k_tie")
    single = joined.filter("stays is null or bare")
    alike = joined.filter("stays and not bare").dropDuplicates(["b_id", "b_tie"])
    return single.unionByName(alike).select(*(F.col("row").getField(c).alias(c) for c in columns))
