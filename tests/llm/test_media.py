import hashlib
import struct
import zlib

import numpy as np
import pytest

from graphloom.llm import jpeg, queries

from .cases import TEXTS, frame


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 40, 1000])
def test_payload_round_trip(n):
    rng = np.random.default_rng(n)
    for payload in (rng.integers(0, 256, 64 * n, np.uint8).tobytes(), b"\xff" * 64 * n, bytes(64 * n)):
        image = jpeg.Image(jpeg.store(payload))
        assert jpeg.load(image) == payload
        assert image.rgb().shape == (image.height, image.width, 3)


class Writer:
    """Plain bit-by-bit progressive writer with general code tables, for the reader's slow path."""

    def __init__(self):
        self.bits = []

    def put(self, x, n):
        self.bits += [x >> i & 1 for i in range(n - 1, -1, -1)]

    def out(self):
        return jpeg._stuffed(np.array(self.bits, np.uint8)) if self.bits else b""


def symbol_table(kind, number, symbols):
    """All symbols with 8-bit codes (at most 255)."""
    return jpeg.segment(0xC4, bytes([kind << 4 | number, *[0] * 7, len(symbols), *[0] * 8, *symbols])), {s: i for i, s in enumerate(symbols)}


def magnitude(w, v, size):
    w.put(v if v > 0 else v + (1 << size) - 1, size)


def general_file(planes, sampling, width, height, quant, restart=0):
    """DC interleaved with point transform 1 then refined; AC in bands, with end-of-band runs, refined with new coefficients."""
    symbols = [r << 4 | s for r in range(16) for s in range(11)]
    ac, code = symbol_table(1, 0, symbols)
    dc, dcode = symbol_table(0, 0, list(range(12)))
    frame_ = struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    out = [b"\xff\xd8", jpeg.segment(0xDB, b"\x00" + bytes(quant.tolist())), jpeg.segment(0xC2, frame_), dc, ac]
    image = jpeg.Image(b"".join(out) + b"\xff\xd9")
    for c, p in zip(image.components, planes):
        assert c.blocks.shape == p.shape
    own = image.components
    which, where, unit = image._order(own)
    for high, low in ((0, 1), (1, 0)):
        w, last = Writer(), [0] * len(own)
        for i, at in zip(which, where):
            v = int(planes[i].reshape(-1, 64)[at, 0])
            if high:
                w.put(v & 1, 1)
            else:
                d, last[i] = (v >> 1) - last[i], v >> 1
                size = abs(d).bit_length()
                w.put(dcode[size], 8)
                if size:
                    magnitude(w, d, size)
        out += [jpeg.segment(0xDA, bytes([len(own), *[x for c in own for x in (c.ident, 0)], 0, 0, high << 4 | low])), w.out()]
    point = lambda v, low: (abs(v) >> low) * (1 if v >= 0 else -1)
    for i, c in enumerate(own):
        _, blocks, _ = image._order([c])
        flat = planes[i].reshape(-1, 64)[blocks].tolist()
        for a, b in ((1, 9), (10, 63)):
            w, run = Writer(), 0

            def flush():
                nonlocal run
                while run:
                    n = min(14, run.bit_length() - 1)
                    w.put(code[n << 4], 8)
                    w.put(min(run, (1 << (n + 1)) - 1) - (1 << n), n)
                    run -= min(run, (1 << (n + 1)) - 1)

            for block in flat:
                zeros, some = 0, [k for k in range(a, b + 1) if point(block[k], 1)]
                if some:
                    flush()
                for k in range(a, (some[-1] if some else a - 1) + 1):
                    v = point(block[k], 1)
                    if not v:
                        zeros += 1
                        continue
                    while zeros > 15:
                        w.put(code[0xF0], 8)
                        zeros -= 16
                    size = abs(v).bit_length()
                    w.put(code[zeros << 4 | size], 8)
                    magnitude(w, v, size)
                    zeros = 0
                if not some or some[-1] < b:
                    run += 1
            flush()
            out += [jpeg.segment(0xDA, bytes([1, c.ident, 0, a, b, 1])), w.out()]
        w = Writer()
        for block in flat:  # refinement of the whole band, end of band block by block
            old = [point(block[k], 1) for k in range(64)]
            new = [k for k in range(1, 64) if not old[k] and block[k]]
            k, zeros, held = 1, 0, []
            for k in range(1, (new[-1] if new else 0) + 1):
                if old[k]:
                    held.append(abs(block[k]) & 1)
                elif block[k]:
                    w.put(code[zeros << 4 | 1], 8)
                    w.put(1 if block[k] > 0 else 0, 1)
                    for x in held:
                        w.put(x, 1)
                    zeros, held = 0, []
                else:
                    zeros += 1
                    if zeros == 16:
                        w.put(code[0xF0], 8)
                        for x in held:
                            w.put(x, 1)
                        zeros, held = 0, []
            end = (new[-1] if new else 0) + 1
            if end <= 63:
                w.put(code[0], 8)
                for k in range(end, 64):
                    if old[k]:
                        w.put(abs(block[k]) & 1, 1)
        out += [jpeg.segment(0xDA, bytes([1, c.ident, 0, 1, 63, 0x10])), w.out()]
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_general_progressive_files(sampling):
    rng = np.random.default_rng(5)
    width, height = 37, 29
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    cols, rows = -(-width // (8 * hm)), -(-height // (8 * vm))
    quant = rng.integers(1, 20, 64)
    planes = []
    for h, v in sampling:
        p = np.where(rng.random((rows * v, cols * h, 64)) < 0.15, rng.integers(-40, 41, (rows * v, cols * h, 64)), 0)
        p[..., 0] = rng.integers(-60, 60, p.shape[:2])
        p[0, 0, 1:] = 0
        planes.append(p)
    image = jpeg.Image(general_file(planes, sampling, width, height, quant))
    want = []
    for c, p, (h, v) in zip(image.components, planes, sampling):
        # blocks beyond the image are only in interleaved scans: their AC coefficients aren't coded
        real_cols, real_rows = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
        q = p.copy()
        q[real_rows:, :, 1:] = 0
        q[:, real_cols:, 1:] = 0
        assert np.array_equal(c.blocks, q)
        grid = np.zeros((rows * v * 8, cols * h * 8))
        for y in range(rows * v):
            for x in range(cols * h):
                f = np.zeros(64)
                f[jpeg.ZIGZAG] = q[y, x] * quant
                f = f.reshape(8, 8)
                k = np.arange(8)
                basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1) / 2
                grid[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = basis @ f @ basis.T + 128
        want.append(np.kron(np.clip(np.rint(grid), 0, 255), np.ones((vm // v, hm // h)))[:height, :width])
    got = image.rgb().astype(int)
    if len(want) == 1:
        assert np.abs(got[:, :, 0] - want[0]).max() <= 1
    else:
        y, cb, cr = want[0], want[1] - 128, want[2] - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        assert np.abs(got - np.clip(rgb, 0, 255)).max() <= 3


def test_media_query(spark, sf, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), sf):
        texts = {}
        for r in spark.read.parquet(f"{d}/documents.parquet").collect():
            texts[r.doc_id] = (r.text or "").encode()
        for r in queries.op10_progressive_jpeg(spark, d).collect():
            if r.doc_id == 9:
                continue
            x = texts[r.doc_id]
            p = x + bytes(-len(x) % 64 if x else 64)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(x), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
            file = jpeg.store(p)
            assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert jpeg.media(frame(spark, [])).count() == 0 and len(TEXTS)
