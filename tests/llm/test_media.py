import hashlib
import zlib

import numpy as np
import pytest

from rasterloom.llm import media


@pytest.mark.parametrize("kind", range(5))
def test_png_round_trip_with_every_line_filter(kind):
    payload = np.random.default_rng(kind).integers(0, 256, 12 * 40, dtype=np.uint8).tobytes()
    image = media.encode_png(payload, 40, kind)
    assert media.decode_png(image).tobytes() == payload


def unfiltered(kinds, lines):
    want = np.zeros_like(lines)
    for y in range(lines.shape[0]):
        for x in range(lines.shape[1]):
            a = int(want[y, x - 1]) if x else 0
            b = int(want[y - 1, x]) if y else 0
            c = int(want[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            want[y, x] = (int(lines[y, x]) + (0, a, b, (a + b) // 2, near)[kinds[y]]) & 255
    return want


def test_mixed_filters_by_definition():
    rng = np.random.default_rng(7)
    images = [rng.integers(0, 256, (h, 10), dtype=np.uint8) for h in (10, 1, 3, 25, 2)]
    for x in images:
        x[:, 0] %= 5
    images[0][:, 0] = [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]
    for x, got in zip(images, media._unfiltered(images), strict=True):
        assert (got == unfiltered(x[:, 0], x[:, 1:])).all()


def test_the_best_filter_of_each_line():
    rng = np.random.default_rng(2)
    payloads = [rng.integers(90, 120, 40 * h, dtype=np.uint8).tobytes() for h in (1, 4, 9)]
    payloads[1] = bytes(range(40)) * 4
    for payload, image in zip(payloads, media.encode_pngs(payloads, 40), strict=True):
        lines = media._inflated(image)
        assert lines[:, 0].any() and (unfiltered(lines[:, 0], lines[:, 1:]).tobytes()) == payload
        for y, line in enumerate(lines):
            costs = [np.abs(media._inflated(media.encode_png(payload, 40, k))[y, 1:].astype(np.int8).astype(int)).sum() for k in range(5)]
            assert costs[line[0]] == min(costs) and line[0] == int(np.argmin(costs))


def test_damage_is_found():
    image = bytearray(media.encode_png(b"x" * media.LINE))
    for at in (0, 20, len(image) // 2, len(image) - 3):
        bad = bytearray(image)
        bad[at] ^= 1
        with pytest.raises(media.MediaError):
            media.decode_png(bytes(bad))
    with pytest.raises(media.MediaError):
        media.decode_png(bytes(image[:40]))


def brute_hash(samples):
    """Means of 32 x 32 equal parts, cosine transform by its sum, signs against the median of all but the constant."""

    def shares(n):
        edges = np.linspace(0, n, 33)
        return np.array([[max(0.0, min(e, j + 1) - max(s, j)) for j in range(n)] for s, e in zip(edges[:-1], edges[1:])]) * (32 / n)

    small = shares(samples.shape[0]) @ samples @ shares(samples.shape[1]).T
    low = [sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) * (1 if u else 0.5**0.5) * (1 if v else 0.5**0.5) / 16 for u in range(8) for v in range(8)]
    low = np.round(low, 6)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def test_hash_of_like_and_unlike_images():
    rng = np.random.default_rng(1)
    coarse = rng.integers(0, 256, (8, 10)).astype(float)
    smooth = np.kron(coarse, np.ones((8, 8)))
    near = np.clip(smooth + rng.normal(0, 2, smooth.shape), 0, 255)
    other = smooth[::-1, ::-1]
    bits = lambda a, b: bin(int(media.dct_hash(a), 16) ^ int(media.dct_hash(b), 16)).count("1")
    assert bits(smooth, near) <= 4 < bits(smooth, other)


def test_contract_columns(spark, tmp_path):
    texts = {1: "abc", 2: None, 3: "", 4: "é" * 5000, 5: "abc", 6: "x" * 576, None: "no id"}
    spark.createDataFrame([(k, v, "extra") for k, v in texts.items()], "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in media.op2_media(spark, str(tmp_path)).collect()}
    for k, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.encode_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        if k in (1, 4):
            assert r.feature == brute_hash(np.frombuffer(payload, np.uint8).reshape(-1, 576).astype(float))
    assert rows[None].n_bytes == 5
    assert rows[1][1:] == rows[5][1:] and rows[2][1:] == rows[3][1:]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert media.op2_media(spark, str(tmp_path)).count() == 0
