"""FLAC: round trips of all forms, damage of any kind, and the query against hashlib."""

import hashlib
import zlib

import numpy as np
import pytest

from veilcount.llm import flac


def signal(rng, kind, n, bits):
    top = (1 << bits - 1) - 1
    if kind == "wave":
        return np.rint(0.7 * top * np.sin(np.arange(n) / 9 + rng.random())).astype(np.int64)
    if kind == "noise":
        return rng.integers(-top - 1, top + 1, n)
    if kind == "walk":
        return np.clip(np.cumsum(rng.integers(-9, 10, n)), -top - 1, top)
    return np.full(n, -3)


def test_round_trips():
    rng = np.random.default_rng(0)
    for payload in (b"", bytes(64), b"abc" * 3000, rng.integers(0, 256, 9000, dtype=np.uint8).tobytes(), "héllo ".encode() * 2000):
        media = flac.encode(payload)
        assert (np.frombuffer(b"".join(b[3] for b in flac.decode(media)), np.uint8) ^ 0x80).tobytes() == payload


@pytest.mark.parametrize("bits", [8, 12, 16, 20, 24])
@pytest.mark.parametrize("joint", [None, flac.LEFT_SIDE, flac.SIDE_RIGHT, flac.MID_SIDE])
def test_channels_and_depths(bits, joint):
    rng = np.random.default_rng(bits)
    for kinds in (("wave", "walk"), ("noise", "wave"), ("same", "noise"), ("walk", "same")):
        for n in (1, 5, 70, 4096, 5000):
            samples = np.stack([signal(rng, k, n, bits) for k in kinds])
            blocks = list(flac.decode(flac.encode_samples(samples, bits, 44100, joint=joint)))
            assert b"".join(b[3] for b in blocks) == flac.pcm_bytes(samples, bits)
            assert [b[0] for b in blocks] == list(range(0, n, flac.BLOCK))


def test_pcm_is_little_endian():
    assert flac.pcm_bytes(np.array([[1, -1], [2, -2]]), 24) == b"\1\0\0\2\0\0\xff\xff\xff\xfe\xff\xff"


def test_linear_prediction_is_used_and_undone():
    rng = np.random.default_rng(7)
    wave = signal(rng, "wave", 4096, 16)
    bits = flac._subframe(wave, 16)
    assert int("".join(map(str, bits[1:7])), 2) == 31 + flac.ORDER and len(bits) < 16 * 4096 * 0.6
    channel = flac._channel(flac._Bits(np.packbits(bits)), 4096, 16)
    # One step at a time, as the format says.
    done = channel.warm.tolist()
    for r in channel.residual.tolist():
        done.append(r + (sum(int(c) * done[-1 - i] for i, c in enumerate(channel.factors)) >> channel.shift))
    flac.undo_predictions([channel])
    assert done == wave.tolist() == channel.samples.tolist()


def test_text_is_predicted_linearly():
    text = ("The quick brown fox jumps over the lazy dog, and so on it goes. " * 80).encode()
    stream = flac.open_stream(flac.encode(text))
    kinds = [c.factors is not None for f in flac.frames(flac.encode(text), stream) for c in f.channels]
    assert kinds and any(kinds)


def test_any_damage_is_told():
    rng = np.random.default_rng(1)
    samples = np.stack([signal(rng, "wave", 300, 16), signal(rng, "walk", 300, 16)])
    for media in (flac.encode(b"some text to keep, " * 12), flac.encode_samples(samples, 16, joint=flac.MID_SIDE, block=128)):
        whole = list(flac.decode(media))
        for n in range(len(media)):
            with pytest.raises(flac.BadStream):
                list(flac.decode(media[:n]))
        for i in range(0, 8 * len(media)):
            bad = bytearray(media)
            bad[i // 8] ^= 1 << i % 8
            try:
                assert list(flac.decode(bytes(bad))) == whole or i < 8 * flac.open_stream(bytes(bad)).frames_at
            except flac.BadStream:
                pass


def test_blocks_of_a_column(spark):
    rng = np.random.default_rng(4)
    good = flac.encode_samples(signal(rng, "walk", 10_000, 16)[None, :], 16)
    rows = [(1, good), (1, flac.encode(b"x" * 70)), (2, None), (3, b"nothing"), (4, good[:-9]), (None, good), (5, flac.encode(b""))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id long, media binary, pcm string, block int")
    got = flac.decode_blocks(df).collect()
    assert {r["id"]: r["error"] is not None for r in got} == {1: False, 3: True, 4: True, None: False}
    assert sorted((r["block"], r["sample_offset"], r["n_samples"]) for r in got if r["id"] is None) == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 1808)]
    third = next(r for r in got if r["id"] is None and r["block"] == 2)
    at = flac.open_stream(good).frames_at + dict((s, b) for s, b, _ in flac.open_stream(good).seek)[8192]
    assert third["byte_offset"] == at and good[at] == 0xFF
    assert flac.decode_blocks(df.limit(0)).count() == 0


def test_digests_against_hashlib(spark):
    texts = ["", None, "a", "é" * 32, "x" * 64, "one more text " * 400, "🙂 \x00" * 999, "a longer text of many words " * 110_000]
    df = spark.createDataFrame([(i, t, 1, "m") for i, t in enumerate(texts)] + [(0, "again", 1, "m"), (None, "x", 1, "m")], "doc_id long, text string, n_bytes int, media string")
    media = flac.encode_texts(df)
    stored = {(r["id"], r["n_bytes"]): bytes(r["media"]) for r in media.collect()}
    got = flac.digests(flac.stored_blocks(media)).collect()
    assert len(got) == df.count()
    want = {}
    for r in df.collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        want[r["doc_id"], len(raw)] = payload
    for r in got:
        payload, one = want[r["doc_id"], r["n_bytes"]], stored[r["doc_id"], r["n_bytes"]]
        assert r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_bytes"] == len(one)
        assert r["media_sha256"] == hashlib.sha256(one).hexdigest()
        signed = np.frombuffer(payload, np.uint8).astype(int) - 128
        assert f"sum={signed.sum()};energy={(signed**2).sum()};peak={np.abs(signed).max()}" in r["feature"]
    assert flac.digests(flac.stored_blocks(flac.encode_texts(df.limit(0)))).count() == 0
