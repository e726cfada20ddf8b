import hashlib
import itertools
import math
import random
import struct
import zlib
from collections import Counter

import pytest

from millrace.llm import matroska as mk

SCHEMA = "doc_id long, text string, media string, n_bytes int"


CASES = [("none", 1)] + [(k, n) for k in ("xiph", "fixed", "ebml") for n in (1, 2, 8, 9, 511, 512, 513, 1100)]


@pytest.mark.parametrize("lacing,frames", CASES)
def test_round_trip(lacing, frames):
    payload = random.Random(frames).randbytes(576 * frames)
    data = mk.mux(payload, lacing)
    media = mk.parse(data)
    assert mk.track_payload(data, media, 1) == payload
    assert len(media.packets) == frames
    assert [p[1] for p in media.packets] == [i * 12_000_000 for i in range(frames)]
    assert {p[2] for p in media.packets} == {12_000_000} and all(p[3] for p in media.packets)
    assert [p[7] for p in media.packets] == [576] * frames
    # each cue leads to the cluster of its time
    assert [c[2] for c in media.cues] == media.clusters
    assert [c[0] for c in media.cues] == [512 * 12 * i for i in range(len(media.clusters))]
    assert media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8


@pytest.mark.parametrize("kind", ["xiph", "ebml"])
def test_uneven_lacing(kind):
    rng = random.Random(4)
    for _ in range(200):
        frames = [rng.randbytes(rng.choice([0, 1, 5, 254, 255, 256, 600, 5000, 70_000])) for _ in range(rng.randint(1, 9))]
        body = mk.lace(frames, kind)
        sizes, at = mk._lace_sizes(body, 0, len(body), {"xiph": 1, "ebml": 3}[kind])
        assert sizes == [len(f) for f in frames] and body[at:] == b"".join(frames)


def by_hand(unknown: bool) -> bytes:
    """Two tracks, block groups, a void element, and clusters of unknown size."""
    size = lambda body: b"\x01\xff\xff\xff\xff\xff\xff\xff" if unknown else mk._size(len(body))
    tracks = mk.element(
        mk.TRACKS,
        b"".join(mk.element(mk.TRACK_ENTRY, mk.element(mk.TRACK_NUMBER, n) + mk.element(mk.CODEC_ID, "S_TEXT/UTF8")) for n in (1, 2)),
    )
    clusters = b""
    for time in (0, 1000):
        block = b"\x82" + struct.pack(">hB", -5, 0) + b"second"
        group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, block) + mk.element(mk.BLOCK_DURATION, 40) + mk.element(mk.REFERENCE_BLOCK, 1))
        simple = mk.element(mk.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 7, 0x80) + b"first")
        body = mk.element(mk.TIMESTAMP, time) + simple + mk.element(0xEC, b"\0" * 9) + group
        clusters += mk.CLUSTER.to_bytes(4, "big") + size(body) + body
    body = tracks + clusters
    return mk.element(mk.EBML, mk.element(mk.DOC_TYPE, "webm")) + mk.SEGMENT.to_bytes(4, "big") + size(body) + body


@pytest.mark.parametrize("unknown", [False, True])
def test_tracks_groups_and_unknown_sizes(unknown):
    data = by_hand(unknown)
    media = mk.parse(data)
    got = [(p[0], p[1] // 1_000_000, p[2] // 1_000_000, p[3], p[5], data[p[6] : p[6] + p[7]]) for p in media.packets]
    assert got == [
        (1, 7, 0, True, 0, b"first"),
        (2, -5, 40, False, 0, b"second"),
        (1, 1007, 0, True, 1, b"first"),
        (2, 995, 40, False, 1, b"second"),
    ]


def test_damage_never_crashes():
    data = mk.mux(b"\x07" * 576 * 20)
    rng = random.Random(9)
    for _ in range(400):
        bad = bytearray(data[: rng.randint(0, len(data))] if rng.random() < 0.5 else data)
        for _ in range(rng.randint(0, 4)):
            if bad:
                bad[rng.randrange(min(len(bad), 400))] = rng.randrange(256)
        try:
            mk.parse(bytes(bad))
        except mk.MatroskaError:
            pass


def test_digests(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 288), (5, "x" * 577), (None, "abc"), (1, "abc"), (6, "long " * 200_000)]
    df = spark.createDataFrame([(*r, "m", 1) for r in rows], SCHEMA)
    got = {r.doc_id: r for r in mk.media_digests(df).collect()}
    assert mk.media_digests(df).count() == len(rows)
    for doc, text in rows:
        raw = (text or "").encode()
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-32:]) and r.media_bytes > r.payload_bytes
    assert got[None][1:] == got[1][1:]
    assert got[4].payload_bytes == 576 and got[5].payload_bytes == 1152
    assert mk.media_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_packet_table(spark):
    data = mk.mux(bytes(range(192)) * 30)
    df = spark.createDataFrame([(1, data, "x"), (2, None, "x"), (3, b"rubbish", "x")], "doc_id long, media binary, track string")
    rows = mk.packet_table(df).collect()
    mine = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.packet)
    assert b"".join(data[r.byte_offset : r.byte_offset + r.byte_length] for r in mine) == bytes(range(192)) * 30
    assert {r.doc_id for r in rows if r.error} == {2, 3}
    assert [r.packet for r in mine if r.cued] == [0]


def test_cues_lead_to_packets():
    media = mk.parse(mk.mux(bytes(576 * 1100)))
    assert [k for k, cued in enumerate(media.cued()) if cued] == [0, 512, 1024]
    assert [media.packets[k][1] for k in (0, 512, 1024)] == [t * 1_000_000 for t, _, _ in media.cues]


def test_encoded_tracks_are_refused():
    entry = mk.element(mk.TRACK_ENTRY, mk.element(mk.TRACK_NUMBER, 1) + mk.element(mk.CONTENT_ENCODINGS, b"\x62\x40\x80"))
    data = mk.element(mk.EBML, mk.element(mk.DOC_TYPE, "matroska")) + mk.element(mk.SEGMENT, mk.element(mk.TRACKS, entry))
    with pytest.raises(mk.MatroskaError):
        mk.parse(data)


def test_stored_form_and_feature(spark):
    """The digest of the stored form, and the feature by its definition, sample by sample."""
    texts = ["abc", "", "x" * 5000, "é~\x00" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {r.doc_id: bytes(r.media) for r in mk.media_column(df).collect()}
    for r in mk.media_digests(df).collect():
        payload = mk.pad(texts[r.doc_id].encode())
        assert r.media_sha256 == hashlib.sha256(stored[r.doc_id]).hexdigest() and r.media_bytes == len(stored[r.doc_id])
        n, centred = len(payload), [b - 128 for b in payload]
        shares = [c / n for c in Counter(payload).values()]
        found = dict(x.split("=") for x in r.feature.split(";"))
        want = {
            "packets": n // 576,
            "clusters": -(-n // (576 * 512)),
            "cues": -(-n // (576 * 512)),
            "ms": n // 576 * 12,
            "mean": sum(centred) / n,
            "rms": math.sqrt(sum(c * c for c in centred) / n),
            "crossings": sum((a < 0) != (b < 0) for a, b in itertools.pairwise(centred)),
            "entropy": -sum(p * math.log2(p) for p in shares),
        }
        assert {k: float(v) for k, v in found.items()} == pytest.approx(want, abs=1e-4)


def build(*children):
    return mk.element(mk.EBML, mk.element(mk.DOC_TYPE, "matroska")) + b"".join(mk.element(mk.SEGMENT, b"".join(c)) for c in children)


def cluster(time, payload=b"ab"):
    return mk.element(mk.CLUSTER, mk.element(mk.TIMESTAMP, time) + mk.element(mk.SIMPLE_BLOCK, b"\x81\x00\x00\x80" + payload))


def test_damaged_files_give_packets_or_an_error(spark):
    """10,000 mutated files through Spark: each gives packets, an error row, or nothing where it holds no packet."""
    data = mk.mux(b"\x07" * 576 * 6)
    rng = random.Random(4)
    rows = []
    for i in range(10_000):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(min(len(bad), 260))] = rng.choice([0, 255, rng.randrange(256)])
        rows.append((i, bytes(bad)))
    times = mk.element(mk.INFO, mk.element(mk.TIMESTAMP_SCALE, 1 << 62))
    rows += [(10_000, build([times, cluster(9)])), (10_001, build([cluster(1 << 63)])), (10_002, build([cluster(5)]))]
    table = mk.packet_table(spark.createDataFrame(rows, "doc_id long, media binary").repartition(8)).collect()
    assert all((r.error is None) != (r.packet is None) for r in table)
    got = {r.doc_id: r for r in table if r.doc_id >= 10_000}
    assert "64 bits" in got[10_000].error and "64 bits" in got[10_001].error and got[10_002].packet == 0
    digests = mk.read_media(spark.createDataFrame([(d, 1, m) for d, m in rows[-3:]], "doc_id long, n_bytes long, media binary")).collect()
    assert {r.doc_id: r.payload_bytes for r in digests} == {10_000: None, 10_001: None, 10_002: 0}  # no track is described


def test_scale_behind_the_clusters_and_second_segment():
    scale = mk.element(mk.INFO, mk.element(mk.TIMESTAMP_SCALE, 1000))
    cue = lambda t, position: mk.element(mk.CUES, mk.element(mk.CUE_POINT, mk.element(mk.CUE_TIME, t) + mk.element(mk.CUE_TRACK_POSITIONS, mk.element(mk.CUE_TRACK, 1) + mk.element(mk.CUE_CLUSTER_POSITION, position))))
    late = mk.parse(build([cluster(7), scale]))
    early = mk.parse(build([scale, cluster(7)]))
    assert [p[1] for p in late.packets] == [p[1] for p in early.packets] == [7000]
    two = mk.parse(build([cluster(3)], [cluster(3), cue(3, 0)]))
    assert two.cued() == [False, True] and len(set(two.clusters)) == 2
