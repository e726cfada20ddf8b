"""The trie of conversation prefixes: which conversations share their first turns.

1. *Turns* become a digest of role and text (128 bits of SHA-256) and a word
   count; texts aren't shuffled. Conversations are put in order and rebuilt.
2. *Fingerprints.* numpy scans roll two polynomials, modulo two primes, along
   each conversation: one 62-bit fingerprint for each of its prefixes.
   Prefixes of one length with one fingerprint are a candidate group.
3. *Verification.* In each group every member's last turn is compared with that
   of its representative, the smallest conversation. As the fingerprint without
   that turn is then equal too, a member that passes here and at all shorter
   lengths has the representative's turns. From the first turn on in which a
   conversation differs it is keyed by a chain of digests instead, so groups
   that collide are split.
4. *Rollup.* A node belongs to its smallest member, so nodes form paths, one for
   a conversation at most. Sums over whole paths are carried up the tree of paths
   by pointer doubling, in as many rounds as its depth has bits; within a path
   they are running sums from its end.

Prefixes that very many share are counted before the shuffle, joins with them
broadcast fixed-size rows of the few heavy ones, and very long conversations are
scanned over several partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import RowBuffer, arrow_schema, discard, map_rows, mapped, materialize, sliced, source_columns, text_bytes
from millrace.llm.graph import join_counted
from millrace.llm.ranks import tagged
from millrace.llm.scans import Fingerprint, Sum, scan

#: Primes and bases of the two fingerprints.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_123)
#: Conversations of one block share turns of its first; of these at most HEAD - 1.
BLOCK, HEAD = 20, 4
#: Bytes of ids that are one row on their way to a node's digest.
CHUNK_BYTES = 1 << 16

KEY = ["d", "fp", "k1", "k2"]  # of a node: depth, fingerprint, and digests where fingerprints collide
UP = ["d_up", "fp_up", "k1_up", "k2_up"]


def turn_digest(role: bytes, text: bytes) -> tuple[int, int]:
    """The first 128 bits of a turn's SHA-256, as two signed numbers in the order of the digests."""
    digest = hashlib.sha256(b"%d:" % len(role) + role + text).digest()
    return tuple(int.from_bytes(digest[i : i + 8], "big") - (1 << 63) for i in (0, 8))


def turn_rows(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turn, t1, t2, words`` of each turn of a conversation; the text's words are runs without ASCII white space."""

    def run(batch: pa.RecordBatch):
        columns = (batch.column(c).to_pylist() for c in ("conv", "turn"))
        for conv, turn, role, text in zip(*columns, text_bytes(batch.column("role")), text_bytes(batch.column("text")), strict=True):
            yield (conv, turn, *turn_digest(role, text), len(text.split())), 64

    rows = source_columns(df, conv=id_col, turn=turn_col, role=role_col, text=text_col).filter("conv is not null")
    rows = rows.withColumns({"conv": F.col("conv").cast("long"), "turn": F.col("turn").cast("long")})
    return map_rows(rows, run, "conv long, turn long, t1 long, t2 long, words long")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv, segment, place, t1, t2, words``: turns taken over from the first of the block, then the conversation's own."""
    heads = turns.filter((F.col("conv") % BLOCK == 0) & (F.col("place") < HEAD))
    heads = heads.groupBy(F.col("conv").alias("base")).agg(F.collect_list(F.struct("place", "t1", "t2", "words")).alias("head"))  # HEAD - 1 at most
    taken = F.crc32(F.col("conv").cast("string")) % HEAD
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", (F.col("conv") - F.col("conv") % BLOCK).alias("base"))
    first = convs.join(heads, "base").select("conv", F.inline("head")).filter(F.col("place") <= taken)
    own = turns.filter(F.col("place") > taken)
    columns = ["conv", "segment", "place", "t1", "t2", "words"]
    return first.withColumn("segment", F.lit(0)).select(*columns).unionAll(own.withColumn("segment", F.lit(1)).select(*columns))


def prefixes(rows: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """``conv, d, fp, fp_up, t1, t2, words``: each prefix's length, fingerprint, that of the prefix before, and last turn."""
    columns = {f"f{i}": Fingerprint(f"t{i}", BASES[i - 1], primes[i - 1]) for i in (1, 2)}
    rows = rows.withColumnRenamed("place", "own_place")
    order = [F.col("conv"), F.col("segment"), F.col("own_place")]
    out = scan(rows, "conv", order, columns, "prefixes")
    pair = lambda a, b: F.shiftleft(F.col(a), 31).bitwiseOR(F.col(b))
    return out.select("conv", F.col("place").alias("d"), pair("f1", "f2").alias("fp"), pair("f1_before", "f2_before").alias("fp_up"), "t1", "t2", "words")


def split_collisions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``k1, k2`` and ``k1_up, k2_up``: 0, or a digest of the whole prefix where its fingerprint stands for others too."""
    groups = rows.groupBy("d", "fp").agg(
        F.count("*").alias("n"), *(f(t).alias(f"{t}_{f.__name__}") for t in ("t1", "t2") for f in (F.min, F.max)), *(F.min_by(t, "conv").alias(f"r{t[1]}") for t in ("t1", "t2"))
    )
    mixed = materialize(groups.filter("t1_min <> t1_max or t2_min <> t2_max").select("d", "fp", "n", "r1", "r2"), "mixed")
    plain = {c: F.lit(0).cast("long") for c in ("k1", "k2", "k1_up", "k2_up")}
    if mixed.isEmpty():
        return rows.withColumns(plain)
    total = rows.count()
    differ = join_counted(rows, mixed, ["d", "fp"], total).filter("t1 <> r1 or t2 <> r2")
    lengths = rows.groupBy("conv").agg(F.count("*").alias("n"))
    differ = materialize(differ.groupBy("conv").agg(F.min("d").alias("from_d")).join(lengths, "conv"), "differ")
    ddl = "conv long, d long, k1 long, k2 long, k1_up long, k2_up long"

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, conv, digest, before = RowBuffer(arrow), None, b"", (0, 0)
        for batch in sliced(batches):
            for now, d, t1, t2, from_d in zip(*(batch.column(c).to_pylist() for c in ("conv", "d", "t1", "t2", "from_d")), strict=True):
                if now != conv:
                    conv, digest, before = now, b"", (0, 0)
                digest = hashlib.sha256(digest + np.array([t1, t2], "<i8").tobytes()).digest()
                if d >= from_d:
                    key = tuple(np.frombuffer(digest[:16], "<i8").tolist())
                    buffer.add((conv, d, *key, *before), 48)
                    before = key
                    if buffer.full:
                        yield buffer.take()
        if buffer.rows:
            yield buffer.take()

    arrow = arrow_schema(rows.sparkSession, ddl)
    chains = join_counted(rows.select("conv", "d", "t1", "t2"), differ, ["conv"], total)
    # a stream of constant memory for each conversation that collides
    keys = mapped(chains.repartition("conv").sortWithinPartitions("conv", "d"), chain, ddl)
    return rows.join(keys, ["conv", "d"], "left").fillna(0, list(plain))


def tree_sums(paths: DataFrame, columns: list[str]) -> DataFrame:
    """``m`` and the sums of ``columns`` over m and all below it, in a forest of rows ``m, up``.

    Pointer doubling: after k rounds a row has the sums of what lies less than
    2**k steps below it, and points 2**k steps up.
    """
    current = materialize(paths.select("m", "up", *columns), "paths")
    while not (live := current.filter("up is not null")).isEmpty():
        arrived = live.groupBy(F.col("up").alias("m")).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"{c}_below") for c in columns))
        arrived = materialize(arrived, "arrived")
        grown = current.join(arrived, "m", "left").select("m", "up", *((F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in columns))
        # where the row that is pointed to points; many may point to one
        further = arrived.select("m", "n").join(current.select("m", "up"), "m").select(F.col("m").alias("up"), "n", F.col("up").alias("next"))
        moved = join_counted(grown.filter("up is not null"), further, ["up"], live.count()).select("m", F.col("next").alias("up"), *columns)
        before = current
        current = materialize(moved.unionByName(grown.filter("up is null")), "paths")
        discard(before, arrived)
    return current.drop("up")


def end_digests(ends: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A node's key and ``ends_sha256``, of the ascending ids, comma-joined, of the rows ``key, conv``.

    Range partitions pack the ids of a node into chunks; a node's digest is then
    made from its chunks, one at a time, so a node where very many end costs few rows.
    """
    spark = ends.sparkSession
    chunk_ddl = "d long, fp long, k1 long, k2 long, first long, ids binary"
    chunk_schema, out_ddl = arrow_schema(spark, chunk_ddl), "d long, fp long, k1 long, k2 long, ends_sha256 string"
    out_schema = arrow_schema(spark, out_ddl)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, key, ids, size = RowBuffer(chunk_schema), None, [], 0
        for batch in sliced(batches):
            for *now, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv")), strict=True):
                if now != key or size >= chunk_bytes:
                    if ids:
                        buffer.add((*key, ids[0], b",".join(b"%d" % x for x in ids)), size)
                    key, ids, size = now, [], 0
                    if buffer.full:
                        yield buffer.take()
                ids.append(conv)
                size += len(str(conv)) + 1
        if ids:
            buffer.add((*key, ids[0], b",".join(b"%d" % x for x in ids)), size)
        if buffer.rows:
            yield buffer.take()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, key, state = RowBuffer(out_schema), None, None
        for batch in sliced(batches, 64):
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if now == key:
                    state.update(b"," + ids)
                    continue
                if key:
                    buffer.add((*key, state.hexdigest()), 128)
                    if buffer.full:
                        yield buffer.take()
                key, state = now, hashlib.sha256(ids)
        if key:
            buffer.add((*key, state.hexdigest()), 128)
        if buffer.rows:
            yield buffer.take()

    dealt = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    chunks = mapped(dealt.select(*KEY, "conv"), pack, chunk_ddl)
    return mapped(chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first"), digest, out_ddl)


def prefix_trie(
    df: DataFrame,
    primes: tuple[int, int] = PRIMES,
    chunk_bytes: int = CHUNK_BYTES,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node.

    Conversation c is rebuilt from the first crc32(c) % 4 turns of conversation
    c - c % 20 and its own turns behind as many. A node is a distinct sequence of
    first turns (role, text); the root, depth 0, has no turn.

    * A null role or text is empty. Turns are ordered by ``turn``, null first;
      ties by the turn's SHA-256, so that repeated rows are repeated turns.
    * A conversation may have no turns left; it then ends at the root.
    * Rows without an id belong to no conversation and count nowhere.
    * Very long texts count whole; very long conversations are scanned in parts.
    * An empty table gives no rows, not even a root. Further columns are not read.
    """
    turns = tagged(turn_rows(df, id_col, turn_col, role_col, text_col), "turns")
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("t1"), F.col("t2"), F.col("nr")]
    ordered = scan(turns, "conv", order, {}, "ordered")
    rows = split_collisions(prefixes(rebuilt(ordered.drop("turn", "nr")), primes))
    convs = ordered.groupBy("conv").agg(F.count("*").alias("n")).drop("n")

    # nodes and their children
    nodes = rows.groupBy(*KEY).agg(F.min("conv").alias("m"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("words", "fp_up", "k1_up", "k2_up")))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv").alias("m"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.withColumns({**dict.fromkeys([*KEY, "words"], zero), **dict.fromkeys(UP[1:], none)})
    nodes = materialize(nodes.withColumn("d_up", F.col("d") - 1).unionByName(root.withColumn("d_up", none)), "nodes")
    children = nodes.filter("d > 0").groupBy(*(F.col(u).alias(k) for k, u in zip(KEY, UP, strict=True))).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "nodes")
    above = nodes.filter("n_children > 0").select(*(F.col(k).alias(u) for k, u in zip(KEY, UP, strict=True)), F.col("m").alias("parent"), F.col("n_children").alias("n"))
    below = join_counted(nodes.filter("d > 0"), above, UP, nodes.count()).drop("n")
    nodes = below.unionByName(nodes.filter("d = 0").withColumn("parent", none))
    own = {"saved": (F.col("n_convs") - 1) * F.col("words"), "leaves": (F.col("n_children") == 0).cast("long")}
    nodes = materialize(nodes.withColumns(own).drop(*UP, "words"), "nodes")

    # sums over subtrees, path by path
    paths = nodes.groupBy("m").agg(F.min("d").alias("top"), F.min_by("parent", "d").alias("up"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    paths = materialize(paths, "tops")
    sums = tree_sums(paths, ["saved", "leaves"]).join(paths.select("m", "up", "top"), "m").filter("up is not null")
    hung = sums.groupBy(F.col("up").alias("m"), (F.col("top") - 1).alias("d")).agg(F.sum("saved").alias("saved_in"), F.sum("leaves").alias("leaves_in"))
    values = {c: F.col(c) + F.coalesce(f"{c}_in", zero) for c in ("saved", "leaves")}
    nodes = nodes.join(hung, ["m", "d"], "left").withColumns(values).drop("saved_in", "leaves_in")
    nodes = scan(nodes, "m", [F.col("m"), F.desc("d")], {"saved_tokens": Sum("saved"), "n_leaves": Sum("leaves")}, "subtrees")

    # where conversations end
    ends = rows.groupBy("conv").agg(F.max("d").alias("last"), *(F.max_by(k, "d").alias(k) for k in KEY[1:])).withColumnRenamed("last", "d")
    ends = convs.join(ends, "conv", "left").fillna(0, KEY)
    nodes = nodes.join(end_digests(ends, chunk_bytes), KEY, "left")
    return nodes.select(
        F.col("m").alias(id_col),
        F.col("d").alias("depth"),
        F.col("parent").alias(f"parent_{id_col}"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
