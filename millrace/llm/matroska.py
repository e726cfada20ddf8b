"""Matroska media columns: mux samples into a file, parse files into packet tables.

The parser walks EBML elements (variable-length ids and sizes, known or
unknown size), reads tracks, clusters, simple blocks and block groups with any
lacing (none, Xiph, fixed, EBML), and cues. It never copies payloads: a packet
is a byte range of the file with a track, a timestamp and flags.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._common import map_rows, source_columns, text_bytes

# Fixed values of the Matroska format (RFC 9559 and RFC 8794).
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CONTENT_ENCODINGS = 0x6D80
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that may follow a cluster or segment of unknown size, and so end a cluster.
TOP_LEVEL = {0x114D9B74, INFO, TRACKS, CLUSTER, CUES, 0x1941A469, 0x1043A770, 0x1254C367, SEGMENT, EBML}

FRAME_BYTES = 576
SAMPLE_RATE = 48_000  # a frame of 8-bit samples lasts 12 ms
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 64

PACKETS = (
    "packet long, track long, timestamp_ns long, duration_ns long, keyframe boolean, lacing string, "
    "cluster long, byte_offset long, byte_length long, cued boolean"
)


class MatroskaError(ValueError):
    """The bytes are no Matroska file, or are damaged."""


# ---------------------------------------------------------------- reading


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """Value, position behind it, and whether all value bits are set (unknown size)."""
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MatroskaError(f"variable-length integer cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    mask = (1 << 7 * width) - 1
    return value if keep_marker else value & mask, at + width, value & mask == mask


def elements(data: bytes, at: int, end: int, ends_at: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int, bool]]:
    """(id, start of the content, its end, size known) of the elements from ``at`` to ``end``."""
    while at < end:
        name, start, _ = read_vint(data, at, True)
        if name in ends_at:
            return
        size, start, unknown = read_vint(data, start, False)
        stop = end if unknown else start + size
        if stop > end:
            raise MatroskaError(f"element {name:X} at {at} ends behind its parent")
        yield name, start, stop, not unknown
        at = stop


def _uint(data: bytes, start: int, stop: int) -> int:
    return int.from_bytes(data[start:stop], "big")


#: Nanoseconds of a tick where a segment doesn't say.
DEFAULT_SCALE = 1_000_000


@dataclass
class Media:
    """What a file holds, payloads by byte range only."""

    timestamp_scale: int = DEFAULT_SCALE
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)  # columns of PACKETS without the first and the last
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster position in the file
    clusters: list[int] = field(default_factory=list)  # positions in the file


    def cued(self) -> list[bool]:
        """For each packet, whether a cue leads to it: same track, time and cluster."""
        spots = {(track, time * self.timestamp_scale, position) for time, track, position in self.cues}
        return [(p[0], p[1], self.clusters[p[5]]) in spots for p in self.packets]


def _lace_sizes(data: bytes, at: int, stop: int, kind: int) -> tuple[list[int], int]:
    """Sizes of the frames of a laced block, and where the first starts."""
    if at >= stop:
        raise MatroskaError("lacing header cut off")
    n, at = data[at] + 1, at + 1
    if kind == 2:  # fixed
        if (stop - at) % n:
            raise MatroskaError("fixed lacing doesn't divide the block")
        return [(stop - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == 1:  # Xiph: bytes of 255 go on
            size = 0
            while True:
                if at >= stop:
                    raise MatroskaError("Xiph lacing cut off")
                size, more, at = size + data[at], data[at] == 255, at + 1
                if not more:
                    break
        else:  # EBML: the first size, then signed differences
            before = at
            value, at, _ = read_vint(data, at, False)
            size = value if not k else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1)
        sizes.append(size)
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("lacing sizes exceed the block")
    return sizes, at


_LACING = ("none", "xiph", "fixed", "ebml")


def _block(data: bytes, start: int, stop: int, base: int, media: Media, key: bool | None, ticks: int | None) -> None:
    """Packets of a block. ``key``: of a block group; None for a simple block, which has a flag."""
    number, at, _ = read_vint(data, start, False)
    if at + 3 > stop:
        raise MatroskaError(f"block header cut off at {start}")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    sizes, at = _lace_sizes(data, at, stop, kind) if kind else ([stop - at], at)
    scale = media.timestamp_scale
    each = media.tracks.get(number, {}).get("frame_ns", 0)
    if not each and ticks is not None:
        each = ticks * scale // len(sizes)
    when = (base + relative) * scale
    key = bool(flags & 0x80) if key is None else key
    cluster, add = len(media.clusters) - 1, media.packets.append
    if not all(-(1 << 63) <= x < 1 << 63 for x in (when, when + len(sizes) * each, each)):
        raise MatroskaError(f"times of the block at {start} exceed 64 bits")
    for k, size in enumerate(sizes):
        add((number, when + k * each, each, key, _LACING[kind], cluster, at, size))
        at += size


def _cluster(data: bytes, start: int, stop: int, media: Media, known: bool) -> int:
    """Read a cluster; returns where it really ends."""
    base, at = 0, start
    for name, a, b, _ in elements(data, start, stop, frozenset() if known else TOP_LEVEL):
        if name == TIMESTAMP:
            base = _uint(data, a, b)
        elif name == SIMPLE_BLOCK:
            _block(data, a, b, base, media, None, None)
        elif name == BLOCK_GROUP:
            inner = {n: (x, y) for n, x, y, _ in elements(data, a, b)}
            ticks = _uint(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None
            if BLOCK in inner:
                _block(data, *inner[BLOCK], base, media, REFERENCE_BLOCK not in inner, ticks)
        at = b
    return at


def _tracks(data: bytes, start: int, stop: int, media: Media) -> None:
    for name, a, b, _ in elements(data, start, stop):
        if name != TRACK_ENTRY:
            continue
        entry: dict = {}
        for n, x, y, _ in elements(data, a, b):
            if n == CODEC_ID:
                entry["codec"] = data[x:y].rstrip(b"\0").decode("ascii", "replace")
            elif n == DEFAULT_DURATION:
                entry["frame_ns"] = _uint(data, x, y)
            elif n in (TRACK_NUMBER, TRACK_TYPE):
                entry["number" if n == TRACK_NUMBER else "type"] = _uint(data, x, y)
            elif n == CONTENT_ENCODINGS:
                raise MatroskaError("compressed or encrypted track: its byte ranges aren't its frames")
            elif n == AUDIO:
                for m, p, q, _ in elements(data, x, y):
                    if m == BIT_DEPTH:
                        entry["bits"] = _uint(data, p, q)
        media.tracks[entry.get("number", 0)] = entry


def parse(data: bytes) -> Media:
    """Parse a file. MatroskaError if it is damaged."""
    media, at, found = Media(), 0, False
    while at < len(data):
        name, start, stop, known = next(elements(data, at, len(data)))
        if name == EBML:
            kinds = [data[a:b].rstrip(b"\0") for n, a, b, _ in elements(data, start, stop) if n == DOC_TYPE]
            if kinds and kinds[0] not in (b"matroska", b"webm"):
                raise MatroskaError("neither matroska nor webm")
            found = True
        elif name == SEGMENT and found:
            had = len(media.packets), len(media.clusters), len(media.cues)
            if _segment(data, start, stop, media, None):  # the scale stands behind packets: once more with it
                for rows, n in zip((media.packets, media.clusters, media.cues), had, strict=True):
                    del rows[n:]
                _segment(data, start, stop, media, media.timestamp_scale)
        elif not found:
            raise MatroskaError("no EBML header")
        at = stop
    if not found:
        raise MatroskaError("no EBML header")
    return media


def _segment(data: bytes, start: int, stop: int, media: Media, scale: int | None) -> bool:
    """Read a segment; ``scale`` is its time scale, if that is known. Returns whether packets came before another scale."""
    media.timestamp_scale = scale or DEFAULT_SCALE
    at, late = start, False
    while at < stop:
        name, a, b, size_known = next(elements(data, at, stop))
        if name == CLUSTER:
            media.clusters.append(at)
            b = _cluster(data, a, b, media, size_known)
        elif name == INFO:
            for m, x, y, _ in elements(data, a, b):
                if m == TIMESTAMP_SCALE and not scale:
                    found = _uint(data, x, y)
                    late |= bool(media.clusters) and found != media.timestamp_scale
                    media.timestamp_scale = found
        elif name == TRACKS:
            _tracks(data, a, b, media)
        elif name == CUES:
            _cues(data, a, b, media, start)
        at = b
    return late


def _cues(data: bytes, start: int, stop: int, media: Media, segment: int) -> None:
    for name, a, b, _ in elements(data, start, stop):
        if name != CUE_POINT:
            continue
        time = 0
        for n, x, y, _ in elements(data, a, b):
            if n == CUE_TIME:
                time = _uint(data, x, y)
            elif n == CUE_TRACK_POSITIONS:
                spot = {m: _uint(data, p, q) for m, p, q, _ in elements(data, x, y)}
                media.cues.append((time, spot.get(CUE_TRACK, 0), segment + spot.get(CUE_CLUSTER_POSITION, 0)))


# ---------------------------------------------------------------- writing


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, content: bytes | int | str) -> bytes:
    if isinstance(content, int):
        content = content.to_bytes(max(1, (content.bit_length() + 7) // 8), "big")
    elif isinstance(content, str):
        content = content.encode("ascii")
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def lace(frames: list[bytes], kind: str) -> bytes:
    """The lacing header and the frames."""
    body = b"".join(frames)
    if kind == "none":
        return body
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == "xiph":
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == "ebml":
        head += _size(sizes[0]) if len(sizes) > 1 else b""
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = 1
            while not -((1 << 7 * width - 1) - 1) < b - a < (1 << 7 * width - 1):
                width += 1
            head += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    elif kind != "fixed" or len(set(sizes)) > 1:
        raise ValueError(f"{kind} lacing can't hold these frames")
    return head + body


_FLAGS = {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}


def mux(payload: bytes, lacing: str = "ebml") -> bytes:
    """A file with one track of unsigned 8-bit samples that holds ``payload``.

    Its length is a positive multiple of 576; each frame has 576 samples.
    """
    if not payload or len(payload) % FRAME_BYTES:
        raise ValueError("the payload is no positive multiple of a frame")
    n = len(payload) // FRAME_BYTES
    frame_ms = 1000 * FRAME_BYTES // SAMPLE_RATE
    head = element(EBML, element(DOC_TYPE, "matroska") + element(DOC_TYPE_VERSION, 4) + element(DOC_TYPE_READ_VERSION, 2))
    info = element(
        INFO,
        element(TIMESTAMP_SCALE, 1_000_000)
        + element(DURATION, struct.pack(">d", float(n * frame_ms)))
        + element(MUXING_APP, "millrace")
        + element(WRITING_APP, "millrace"),
    )
    audio = element(SAMPLING_FREQUENCY, struct.pack(">d", float(SAMPLE_RATE))) + element(CHANNELS, 1) + element(BIT_DEPTH, 8)
    tracks = element(
        TRACKS,
        element(
            TRACK_ENTRY,
            element(TRACK_NUMBER, 1)
            + element(TRACK_UID, 1)
            + element(TRACK_TYPE, 2)
            + element(FLAG_LACING, 1)
            + element(DEFAULT_DURATION, frame_ms * 1_000_000)
            + element(CODEC_ID, "A_PCM/INT/LIT")
            + element(AUDIO, audio),
        ),
    )
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    per = FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for first in range(0, n, per):
        blocks = [element(TIMESTAMP, first * frame_ms)]
        for k in range(first, min(n, first + per), FRAMES_A_BLOCK):
            frames = [payload[i * FRAME_BYTES : (i + 1) * FRAME_BYTES] for i in range(k, min(n, first + per, k + FRAMES_A_BLOCK))]
            kind = lacing if len(frames) > 1 else "none"
            header = b"\x81" + struct.pack(">hB", (k - first) * frame_ms, 0x80 | _FLAGS[kind])
            blocks.append(element(SIMPLE_BLOCK, header + lace(frames, kind)))
        cues.append(
            element(
                CUE_POINT,
                element(CUE_TIME, first * frame_ms)
                + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, at)),
            )
        )
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (max(FRAME_BYTES, -(-len(data) // FRAME_BYTES) * FRAME_BYTES) - len(data))


def track_payload(data: bytes, media: Media, track: int) -> bytes:
    """The frames of a track, in order of time."""
    rows = sorted((p[1], i, p[6], p[7]) for i, p in enumerate(media.packets) if p[0] == track)
    return b"".join(data[at : at + size] for _, _, at, size in rows)


def feature(media: Media, payload: bytes) -> str:
    """Counts of the container and statistics of the samples, as ``name=value`` joined by semicolons."""
    samples = np.frombuffer(payload, np.uint8)
    centred = samples.astype(np.int32) - 128
    counts = np.bincount(samples, minlength=256)
    shares = counts[counts > 0] / max(1, len(samples))
    crossings = int(np.count_nonzero(np.diff(centred < 0)))
    length = max((p[1] + p[2] for p in media.packets), default=0)
    return (
        f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={length // 1_000_000};"
        f"mean={centred.mean() if len(samples) else 0:.4f};rms={math.sqrt(float((centred.astype(np.int64) ** 2).mean())) if len(samples) else 0:.4f};"
        f"crossings={crossings};entropy={float(-(shares * np.log2(shares)).sum()):.4f}"
    )


# ---------------------------------------------------------------- Spark


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lacing: str = "ebml") -> DataFrame:
    """``doc_id, n_bytes, media``: each text, padded, in a Matroska file of its own. Null counts as empty."""

    def run(batch: pa.RecordBatch):
        for doc, data in zip(batch.column("id").to_pylist(), text_bytes(batch.column("text")), strict=True):
            media = mux(pad(data), lacing)
            yield (doc, len(data), media), len(media)

    return map_rows(source_columns(df, id=id_col, text=text_col), run, "doc_id long, n_bytes long, media binary")


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: the id, the columns of PACKETS, and ``error``.

    ``cued`` marks the packets that the file's cues lead to. A null, empty or
    damaged file, and one with compressed or encrypted tracks, gives one row
    that holds its error and no packet; a file without packets gives no row.
    Null ids are kept, repeated rows give their packets each, an empty table
    gives none.
    """

    def run(batch: pa.RecordBatch):
        for doc, data in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            try:
                media = parse(data or b"")
            except MatroskaError as e:
                yield (doc, *[None] * 10, str(e)), 100
            else:
                for k, (p, cued) in enumerate(zip(media.packets, media.cued(), strict=True)):
                    yield (doc, k, *p, cued, None), 100

    return map_rows(source_columns(df, id=id_col, media=media_col), run, f"{id_col} long, {PACKETS}, error string")


def read_media(df: DataFrame) -> DataFrame:
    """Digests of ``doc_id, n_bytes, media``: what is stored, and what its packets hold when read back.

    The payload comes from the byte ranges of the packets of the file's first
    track. A damaged or null file has nulls in place of its digests.
    """

    def run(batch: pa.RecordBatch):
        for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            try:
                media = parse(data or b"")
            except MatroskaError:
                yield (doc, n, *[None] * 6), 100
                continue
            payload = track_payload(data, media, min(media.tracks, default=0))
            yield (
                doc,
                n,
                len(payload),
                hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-32:]),
                len(data),
                hashlib.sha256(data).hexdigest(),
                feature(media, payload),
            ), 400

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    return map_rows(df, run, schema)


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a Matroska file in a column, parse it, and return its digests.

    * Null and empty texts: one frame of bytes 255. Very long texts: more clusters.
    * Null ids are kept; repeated rows give equal rows. An empty table: no rows.
    * Further columns are not read.
    """
    return read_media(media_column(df, id_col, text_col))
