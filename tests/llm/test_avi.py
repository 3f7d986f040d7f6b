import hashlib
import random
import statistics
import zlib

import numpy as np
import pytest

from stratagraph.llm import avi


def brute_jpeg(image):
    """Bit by bit, from the standard's description."""
    scan, lengths, (rows, cols) = avi._parse_jpeg(image)
    codes = {(n, c): s for s, (c, n) in avi.canonical(lengths).items()}
    bits = iter("".join(f"{b:08b}" for b in scan.replace(b"\xff\x00", b"\xff")))
    out = np.zeros((rows, cols), int)
    for y in range(rows):
        for x in range(cols):
            code = n = 0
            while (n, code) not in codes:
                code, n = code * 2 + int(next(bits)), n + 1
            category = codes[n, code]
            extra = int("".join(next(bits) for _ in range(category)) or "0", 2)
            diff = extra if category == 0 or extra >= 1 << (category - 1) else extra - (1 << category) + 1
            out[y, x] = diff + (out[y, x - 1] if x else out[y - 1, 0] if y else 128)
    assert set(bits) <= {"1"}
    return out.astype(np.uint8).ravel()


def test_frames_round_trip_and_brute_force():
    rng = np.random.default_rng(0)
    frames = np.stack([np.zeros(576), np.full(576, 255), np.tile([0, 255], 288), np.tile([255, 0, 0], 192), *rng.integers(0, 256, (20, 576)), *rng.integers(97, 123, (20, 576))]).astype(np.uint8)
    images = avi.encode_frames(frames)
    assert (avi.decode_frames(images) == frames).all()
    for f, i in zip(frames, images, strict=True):
        assert (brute_jpeg(i) == f).all()


def test_container():
    payload = bytes(range(256)) * 9 * 5
    media = avi.write_media(payload)
    images, fps = avi.demux(media)
    assert fps == avi.FPS and avi.decode_frames(images).tobytes() == payload
    assert media[:4] == b"RIFF" and int.from_bytes(media[4:8], "little") == len(media) - 8
    for bad in (b"", b"RIFF", media[:-20], media.replace(b"idx1", b"idx2")):
        with pytest.raises(ValueError):
            avi.demux(bad)


def test_shots():
    rng = np.random.default_rng(1)
    dark, light = rng.integers(0, 60, (30, 576)), rng.integers(150, 220, (20, 576))
    assert avi.cuts(np.concatenate([dark, light, dark]).astype(np.uint8)) == [30, 50]
    assert avi.cuts(dark.astype(np.uint8)[:2]) == []


def brute_cuts(frames):
    def counts(f):
        return [sum(int(x) // 16 == b for x in f) for b in range(16)]

    bins = [counts(f) for f in frames]
    diff = [sum(abs(a - b) for a, b in zip(x, y)) / 1152 for x, y in zip(bins, bins[1:])]
    found = []
    for i, d in enumerate(diff):
        near = diff[max(i - 12, 0) : i] + diff[i + 1 : i + 13]
        if near and d > 0.2:
            usual = statistics.median(near)
            if d > usual + 2.5 * 1.4826 * statistics.median(abs(x - usual) for x in near):
                found.append(i + 1)
    return found


def test_short_films_and_fast_cuts():
    black, white = np.zeros((6, 576), np.uint8), np.full((6, 576), 255, np.uint8)
    assert avi.cuts(np.concatenate([black[:4], white[:4]])) == [4]
    assert avi.cuts(np.concatenate([black[:2], white[:1]])) == [2]
    assert avi.cuts(np.concatenate([black, white] * 5)) == list(range(6, 60, 6))
    assert avi.cuts(np.concatenate([black[:1], white[:1]] * 20)) == []  # flicker: every difference is the usual one
    assert avi.cuts(black) == []


def test_shots_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        shots = [rng.integers(lo := int(rng.integers(0, 200)), lo + int(rng.integers(2, 56)), (int(rng.integers(1, 15)), 576)) for _ in range(int(rng.integers(1, 9)))]
        frames = np.concatenate(shots).astype(np.uint8)
        assert avi.cuts(frames) == brute_cuts(frames)


def test_query(spark):
    rng = random.Random(0)
    texts = [None, "", "é" * 288, "x" * 576, "y" * 577, "z" * 300_000] + ["".join(rng.choice("ab cdé日\n") for _ in range(rng.randrange(4000))) for _ in range(30)] + ["same"] * 2
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    media = avi.encode_media(df)
    got = {r.doc_id: r for r in avi.features(media).collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.collect()}
    clips = {}
    for r in avi.clip_rows(media).orderBy("doc_id", "clip").collect():
        clips.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        n, payload = avi.padded(t or "")
        g = got[i]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert payload[: n].decode() == (t or "") and set(payload[n:]) <= {255} and len(payload) % 576 == 0 and payload
        assert g.tail_crc32 == zlib.crc32(payload[-32:])
        assert (g.media_bytes, g.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        assert sum(c.n_frames for c in clips[i]) == len(payload) // 576 and clips[i][0].start_s == 0
        assert all(a.end_s == b.start_s for a, b in zip(clips[i], clips[i][1:]))
    assert got[len(texts) - 1].feature == got[len(texts) - 2].feature
    assert avi.features(avi.encode_media(df.limit(0))).count() == 0
