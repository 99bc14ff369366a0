"""Media columns: exact round trips, and a decoder that another library's frames go through."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from plumbline.llm import media


def test_round_trip():
    r = random.Random(3)
    for n in (0, 1, 64, 1023, 1024, 1025, 5000):
        payload = r.randbytes(n)
        assert media.read_avi(media.write_avi(payload))[0] == payload


def test_general_decoder_reads_the_same_frames():
    samples = np.random.default_rng(1).integers(0, 256, (2, media.FRAME), dtype=np.uint8)
    for frame, row in zip(media.encode_frames(samples), samples):
        assert (media.decode_frame(frame)[0] == row).all()
        assert (media._decode_any(frame)[0] == row).all()


def other_frame(r, across, down, sampling, interval):
    """A baseline frame with AC coefficients, several components and restarts, and the first component's DC levels."""

    def segment(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    ac_symbols = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    tables = segment(0xC4, bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12)])) + segment(0xC4, bytes([0x10, *[0] * 7, len(ac_symbols), *[0] * 8, *ac_symbols]))
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    head = b"\xff\xd8" + segment(0xDB, bytes([0, 16, *[3] * 63])) + tables + segment(0xDD, interval.to_bytes(2, "big"))
    head += segment(0xC0, bytes([8, *(8 * most_v * down).to_bytes(2, "big"), *(8 * most_h * across).to_bytes(2, "big"), len(sampling), *(x for k, (h, v) in enumerate(sampling) for x in (k + 1, h << 4 | v, 0))]))
    head += segment(0xDA, bytes([len(sampling), *(x for k in range(len(sampling)) for x in (k + 1, 0)), 0, 63, 0]))
    levels = np.zeros((down * sampling[0][1], across * sampling[0][0]), dtype=int)

    def signed(value, size):
        return f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else ""

    out, bits, last, restarts = head, "", [0] * len(sampling), 0

    def flushed(bits):
        bits += "1" * (-len(bits) % 8)
        return b"".join(bytes([x, 0]) if x == 0xFF else bytes([x]) for x in (int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))

    for m in range(across * down):
        if m and m % interval == 0:
            out, bits, last, restarts = out + flushed(bits) + bytes([0xFF, 0xD0 + restarts % 8]), "", [0] * len(sampling), restarts + 1
        for k, (h, v) in enumerate(sampling):
            for y in range(v):
                for x in range(h):
                    dc = r.randint(-64, 63)
                    if k == 0:
                        levels[m // across * v + y, m % across * h + x] = 128 + 2 * dc
                    step, last[k] = dc - last[k], dc
                    bits += f"{abs(step).bit_length():04b}" + signed(step, abs(step).bit_length())
                    at = 1
                    while at < 64:
                        run, size = r.randint(0, 15), r.randint(1, 10)
                        if at + run > 63 or r.random() < 0.3:
                            bits += f"{ac_symbols.index(0):08b}"
                            break
                        bits += f"{ac_symbols.index(run << 4 | size):08b}" + signed(r.choice([-1, 1]) * r.randint(1 << (size - 1), (1 << size) - 1), size)
                        at += run + 1
    return out + flushed(bits) + b"\xff\xd9", np.clip(levels, 0, 255)


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1)]])
def test_other_frames(sampling):
    frame, want = other_frame(random.Random(9), 5, 3, sampling, 4)
    got, across = media.decode_frame(frame)
    assert across == want.shape[1] and (got == want.reshape(-1)).all()


def test_shots():
    dark, light = np.eye(media.LEVELS)[1], np.eye(media.LEVELS)[12]
    assert media.shots(np.array([dark] * 10 + [light] * 10 + [dark] * 5)) == [0, 10, 20]
    assert media.shots(np.array([dark])) == [0] and media.shots(np.zeros((0, media.LEVELS))) == []
    payload = b"\x10" * media.FRAME * 4 + b"\xf0" * media.FRAME * 3
    clips = media.read_avi(media.write_avi(payload))[1]
    assert [(c[0], c[1], c[2]) for c in clips] == [(0.0, 0.16, 4), (0.16, 0.28, 3)]


def test_documents(spark, documents, odd):
    df = documents(odd, extra=True)
    rows = media.features(media.store(df)).collect()
    assert sorted(r["n_bytes"] for r in rows) == sorted(len((t or "").encode()) for _, t, _ in odd)
    for r in rows:
        text = next(t for i, t, _ in odd if i == r["doc_id"]) or ""
        raw = media.padded(text)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    assert media.clip_rows(media.features(media.store(df))).count() >= len(odd)
    named = media.features(media.store(df).withColumn("clips", media.F.lit("clash")))
    assert named.columns.count("clips") == 1 and named.where("size(clips) > 0").count() == len(odd)
    broken = spark.createDataFrame([(1, None), (2, b"RIFFxxxx"), (3, b"")], "doc_id long, media binary")
    assert [r["clips"] for r in media.features(broken).collect()] == [None] * 3
    assert media.features(media.store(df.limit(0))).count() == 0
