"""Progressive JPEG media columns in numpy.

decode() accumulates spectral-selection and successive-approximation scans into coefficient arrays, transforms them back,
upsamples chroma and gives a full-resolution RGB tensor. Scans whose code tables hold a single code have records of
predictable width and are read as whole bit arrays; all others are read code by code.

store()/load() keep a payload of bytes in the format's own unit: each quantised coefficient of a 4:2:0 image holds one
byte, so nothing is lost whatever the samples become.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import mapped, pieces, raw_texts

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_k = np.arange(8)
_DCT = np.where(_k[:, None] == 0, math.sqrt(1 / 8), math.sqrt(1 / 4)) * np.cos((2 * _k[None, :] + 1) * _k[:, None] * math.pi / 16)
#: Coefficients of a block (row by row) to its samples, as one matrix.
INVERSE = np.einsum("ux,vy->uvxy", _DCT, _DCT).reshape(64, 64)


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table
        self.dc = self.ac = 0
        self.blocks = np.zeros((0, 0, 64), np.int32)  # in zigzag order


class _Bits:
    """Code by code reading of one restart interval."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.left = data, 0, 0, 0

    def bit(self) -> int:
        if not self.left:
            self.value = self.data[self.at] if self.at < len(self.data) else 0xFF
            self.at += 1
            self.left = 8
        self.left -= 1
        return self.value >> self.left & 1

    def bits(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = x << 1 | self.bit()
        return x

    def code(self, table: dict[tuple[int, int], int]) -> int:
        x = n = 0
        while n < 17:
            x = x << 1 | self.bit()
            n += 1
            if (n, x) in table:
                return table[n, x]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        x = self.bits(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, at = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            table[n, code] = symbols[at]
            code += 1
            at += 1
        code <<= 1
    return table


_LAST = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _intervals(data: bytes, start: int) -> tuple[list[bytes], int]:
    """The entropy-coded parts between restart markers, unstuffed, and where the next marker is."""
    m = _LAST.search(data, start)
    end = m.start() if m else len(data)
    parts = _RESTART.split(data[start:end])
    return [p.replace(b"\xff\x00", b"\xff") if b"\xff" in p else p for p in parts], end


class Image:
    """A parsed file: components with all coefficients."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], dict] = {}
        self.components: list[Component] = []
        self.orders: dict[tuple, tuple] = {}
        self.comment, self.restart, self.width, self.height, self.progressive, self.adobe = b"", 0, 0, 0, False, None
        at = 2
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            m = data[at + 1]
            if m == 0xFF:
                at += 1
                continue
            if m == 0xD9:
                break
            n = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if m == 0xDB:
                while body:
                    wide, size = body[0] >> 4, 128 if body[0] >> 4 else 64
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1").astype(np.int32)
                    body = body[1 + size :]
            elif m == 0xC4:
                while body:
                    total = sum(body[1:17])
                    self.tables[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + total])
                    body = body[17 + total :]
            elif m in (0xC0, 0xC1, 0xC2):
                self.progressive = m == 0xC2
                _, self.height, self.width, count = struct.unpack(">BHHB", body[:6])
                self.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
                self._allocate()
            elif m == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif m == 0xFE:
                self.comment = body
            elif m == 0xEE and body[:5] == b"Adobe":
                self.adobe = body[11]
            elif m == 0xDA:
                at = self._scan(body, data, at)
            elif 0xC3 <= m <= 0xCF:
                raise ValueError("unsupported coding process")

    def _allocate(self) -> None:
        self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        self.cols, self.rows = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.components:
            c.blocks = np.zeros((self.rows * c.v, self.cols * c.h, 64), np.int32)

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        count = body[0]
        own = []
        for i in range(count):
            c = next(c for c in self.components if c.ident == body[1 + 2 * i])
            c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            own.append(c)
        first, last, approx = body[1 + 2 * count : 4 + 2 * count]
        if not self.progressive:
            first, last, approx = 0, 63, 0
        parts, at = _intervals(data, at)
        order = self._order(own)
        if not self._wide(parts, own, order, first, last, approx >> 4, approx & 15):
            self._narrow(parts, own, order, first, last, approx >> 4, approx & 15)
        return at

    def _order(self, own: list[Component]) -> tuple[np.ndarray, np.ndarray, int]:
        """Which component's and block's turn it is, flat, and the number of blocks of a unit."""
        key = tuple(c.ident for c in own)
        if key not in self.orders:
            self.orders[key] = self._make_order(own)
        return self.orders[key]

    def _make_order(self, own: list[Component]) -> tuple[np.ndarray, np.ndarray, int]:
        if len(own) == 1:
            c = own[0]
            cols = -(-(-(-self.width * c.h // self.hmax)) // 8)
            rows = -(-(-(-self.height * c.v // self.vmax)) // 8)
            return np.zeros(rows * cols, np.int64), (np.arange(rows)[:, None] * c.blocks.shape[1] + np.arange(cols)).ravel(), 1
        which, where = [], []
        y, x = np.arange(self.rows)[:, None, None], np.arange(self.cols)[None, :, None]
        for i, c in enumerate(own):
            v, h = np.divmod(np.arange(c.h * c.v), c.h)
            where.append((y * c.v + v) * c.blocks.shape[1] + x * c.h + h)
            which.append(np.full(where[-1].shape, i))
        return np.concatenate(which, 2).ravel(), np.concatenate(where, 2).ravel(), sum(c.h * c.v for c in own)

    def _wide(self, parts, own, order, first, last, high, low) -> bool:
        """Reads a scan of predictable records at once; False if it isn't one."""
        which, where, unit = order
        per = self.restart * unit if self.restart else len(where)
        if len(parts) != -(-len(where) // per) or not self.progressive:
            return False
        n = len(where)
        if len(own) == 1 and self._even(parts, own[0], where, first, last, high, low):
            return True
        begin = np.concatenate([[0], np.cumsum([8 * len(p) for p in parts])])[:-1]
        within = np.arange(n) % per
        start = np.repeat(begin, per)[:n]
        bits = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8))
        if first == 0 and high:
            got = bits[start + within].astype(np.int32) << low
            for i, c in enumerate(own):
                c.blocks.reshape(-1, 64)[where[which == i], 0] |= got[which == i]
            return True
        if first == 0:
            tables = [self.tables.get((0, c.dc), {}) for c in own]
            if any(len(t) != 1 or t != tables[0] for t in tables):
                return False
            ((size, _), k), = tables[0].items()
            diff = _fields(bits, start + within * (size + k) + size, k)
            for i, c in enumerate(own):
                mine = which == i
                d, part = diff[mine], (np.arange(n) // per)[mine]
                total = np.cumsum(d)
                head = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                base = np.where(head > 0, total[head - 1], 0)
                c.blocks.reshape(-1, 64)[where[mine], 0] = (total - np.repeat(base, np.diff(np.r_[head, len(d)]))) << low
            return True
        c = own[0]
        table = self.tables.get((1, c.ac), {})
        if len(table) != 1:
            return False
        ((size, _), symbol), = table.items()
        width = last - first + 1
        flat = c.blocks.reshape(-1, 64)
        if not high and symbol >> 4 == 0 and symbol & 15:
            k = symbol & 15
            value = _fields(bits, (start + within * width * (size + k))[:, None] + np.arange(width) * (size + k) + size, k)
            flat[where, first : last + 1] = value << low
            return True
        if high and symbol == 0:
            band = flat[where, first : last + 1]
            held = band != 0
            many = size + held.sum(axis=1)
            ends = np.cumsum(many)
            opens = ends - many
            at = start + opens - opens[(np.arange(n) // per) * per] + size
            spot = at[:, None] + np.cumsum(held, axis=1) - 1
            grow = np.where(held, bits[np.where(held, spot, 0)], 0).astype(np.int32) << low
            flat[where, first : last + 1] = band + np.where(band < 0, -grow, grow)
            return True
        return False

    def _even(self, parts, c, where, first, last, high, low) -> bool:
        """The commonest of those: one component, records of one width, blocks in a row."""
        n = len(where)
        if n != len(c.blocks) * c.blocks.shape[1]:
            return False
        flat, data = c.blocks.reshape(-1, 64), np.frombuffer(b"".join(parts) if len(parts) > 1 else parts[0], np.uint8)
        table = self.tables.get((0, c.dc) if first == 0 else (1, c.ac), {})
        if first == 0 and high:
            if len(parts) > 1:
                return False
            flat[:, 0] |= np.unpackbits(data, count=n).astype(np.int32) << low
            return True
        if len(table) != 1:
            return False
        ((size, _), symbol), = table.items()
        if first == 0:  # every block an interval of its own
            if len(parts) != n or len(data) != n * len(parts[0]) or not 0 < symbol <= 8:
                return False
            value = _packed(np.unpackbits(data.reshape(n, -1), axis=1)[:, size : size + symbol], symbol)
            flat[:, 0] = value << low
            return True
        if len(parts) > 1:
            return False
        width = last - first + 1
        if not high and 0 < symbol <= 8:
            bits = np.unpackbits(data, count=n * width * (size + symbol)).reshape(n, width, size + symbol)
            flat[:, first : last + 1] = _packed(bits[:, :, size:], symbol) << low
            return True
        if high and symbol == 0 and flat[:, first : last + 1].min() > 0:
            bits = np.unpackbits(data, count=n * (size + width)).reshape(n, size + width)
            flat[:, first : last + 1] += bits[:, size:].astype(np.int32) << low
            return True
        return False

    def _narrow(self, parts, own, order, first, last, high, low) -> None:
        """Reads a scan code by code."""
        which, where, unit = order
        per = self.restart * unit if self.restart else len(where)
        for p, data in enumerate(parts):
            bits, dc, run = _Bits(data), [0] * len(own), 0
            for i, w in zip(which[p * per : (p + 1) * per], where[p * per : (p + 1) * per]):
                c, block = own[i], own[i].blocks.reshape(-1, 64)[w]
                k = first
                if k == 0:
                    if high:
                        block[0] |= bits.bit() << low
                    else:
                        dc[i] += bits.signed(bits.code(self.tables[0, c.dc]))
                        block[0] = dc[i] << low
                    k = 1
                if last and not high:
                    if run:
                        run -= 1
                        continue
                    table = self.tables[1, c.ac]
                    while k <= last:
                        s = bits.code(table)
                        zeros, size = s >> 4, s & 15
                        if size:
                            k += zeros
                            block[k] = bits.signed(size) * (1 << low)
                            k += 1
                        elif zeros == 15:
                            k += 16
                        else:
                            run = (1 << zeros) - 1 + bits.bits(zeros)
                            break
                elif last:
                    run = self._refine(bits, block, self.tables[1, c.ac], k, last, low, run)

    @staticmethod
    def _refine(bits: _Bits, block: np.ndarray, table: dict, k: int, last: int, low: int, run: int) -> int:
        one = 1 << low

        def correct(j):
            if bits.bit() and not (abs(int(block[j])) & one):
                block[j] += one if block[j] > 0 else -one

        if not run:
            while k <= last:
                s = bits.code(table)
                zeros, size = s >> 4, s & 15
                value = 0
                if size:
                    value = one if bits.bit() else -one
                elif zeros < 15:
                    run = (1 << zeros) + bits.bits(zeros)
                    break
                while k <= last:
                    if block[k]:
                        correct(k)
                    elif zeros:
                        zeros -= 1
                    else:
                        if value:
                            block[k] = value
                        k += 1
                        break
                    k += 1
        if run:
            for j in range(k, last + 1):
                if block[j]:
                    correct(j)
            run -= 1
        return run

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor: height x width x 3, 8 bits."""
        planes = []
        for c in self.components:
            rows, cols, _ = c.blocks.shape
            flat = np.empty((rows * cols, 64))
            flat[:, ZIGZAG] = c.blocks.reshape(-1, 64) * self.quant[c.table]
            samples = np.clip(np.rint(flat @ INVERSE + 128), 0, 255).astype(np.uint8)
            plane = samples.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
            if self.vmax // c.v > 1:
                plane = plane.repeat(self.vmax // c.v, axis=0)
            if self.hmax // c.h > 1:
                plane = plane.repeat(self.hmax // c.h, axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        if self.adobe == 0:
            return np.stack(planes[:3], 2)
        y, cb, cr = (p.astype(np.float32) for p in planes[:3])
        cb -= 128
        cr -= 128
        out = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], 2)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _fields(bits: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Signed magnitudes of k bits that begin at these bits."""
    value = np.zeros(at.shape, np.int32)
    for i in range(k):
        value = value << 1 | bits[at + i]
    return np.where(value >> max(0, k - 1) & 1, value, value - (1 << k) + 1) if k else value


def _packed(bits: np.ndarray, k: int) -> np.ndarray:
    """Signed magnitudes from their k <= 8 bits along the last axis."""
    value = (np.packbits(bits, axis=-1)[..., 0] >> (8 - k)).astype(np.int32)
    top = bits[..., 0]
    return value if top.all() else np.where(top, value, value - (1 << k) + 1)


def decode(data: bytes) -> np.ndarray:
    """The RGB tensor of a JPEG file, progressive or sequential."""
    return Image(data).rgb()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones, 0xFF escaped."""
    extra = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(extra, np.uint8)]) if extra else bits).tobytes().replace(b"\xff", b"\xff\x00")


def _binary(values: np.ndarray, k: int) -> np.ndarray:
    """k bits of each value, high first, along a new last axis."""
    return (values[..., None] >> np.arange(k - 1, -1, -1, dtype=values.dtype) & 1).astype(np.uint8)


def _single(kind: int, symbol: int) -> bytes:
    """A code table of one code, 0, for one symbol."""
    return segment(0xC4, bytes([kind << 4, 1, *[0] * 15, symbol]))


#: A payload byte b is the coefficient b + 256, so that every coefficient has nine bits. Spectral bands of the first scans.
OFFSET, BANDS = 256, ((1, 20), (21, 63))


def store(payload: bytes) -> bytes:
    """A progressive 4:2:0 file whose coefficients are the payload (a positive multiple of 64 bytes): four blocks of
    luminance, one of each chroma to a unit; blocks to fill the image are of zero bytes. The comment has the length."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    units = -(-len(payload) // 384)
    cols = min(4095, math.isqrt(units - 1) + 1)
    rows = -(-units // cols)
    if rows > 4095:
        raise ValueError("a payload is at most 6 GB")
    units = rows * cols
    flat = np.zeros((units * 6, 64), np.uint16)
    flat.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    flat += OFFSET
    split = [flat[: 4 * units], flat[4 * units : 5 * units], flat[5 * units :]]
    out = [
        b"\xff\xd8",
        segment(0xFE, struct.pack(">Q", len(payload))),
        segment(0xDB, b"\x00" + b"\x01" * 64),
        segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
    ]
    # DC first, one restart interval for each block so that each difference is the value itself
    for i, s in enumerate(split):
        dc = s[:, 0] >> 1
        bits = np.concatenate([np.zeros((len(dc), 1), np.uint8), _binary(dc, 8), np.ones((len(dc), 7), np.uint8)], 1)
        two = np.packbits(bits, axis=1)
        full = np.full((len(dc), 5), 0, np.uint8)
        full[:, :2], full[:, 3] = two, 0xFF
        full[:, 4] = 0xD0 + np.arange(len(dc)) % 8
        there = np.ones(full.shape, bool)
        there[:, 2] = two[:, 1] == 0xFF
        there[-1, 3:] = False
        out += [segment(0xDD, b"\x00\x01"), _single(0, 8), segment(0xDA, bytes([1, i + 1, 0x00, 0, 0, 0x01])), full[there].tobytes()]
    out.append(segment(0xDD, b"\x00\x00"))
    for i, s in enumerate(split):
        for a, b in BANDS:
            value = s[:, a : b + 1] >> 1
            bits = np.zeros((*value.shape, 9), np.uint8)
            bits[:, :, 1:] = _binary(value, 8)
            out += [_single(1, 8), segment(0xDA, bytes([1, i + 1, 0x00, a, b, 0x01])), _stuffed(bits.ravel())]
    for i, s in enumerate(split):
        out += [segment(0xDA, bytes([1, i + 1, 0x00, 0, 0, 0x10])), _stuffed((s[:, 0] & 1).astype(np.uint8))]
        bits = np.zeros((len(s), 64), np.uint8)
        bits[:, 1:] = s[:, 1:] & 1
        out += [_single(1, 0), segment(0xDA, bytes([1, i + 1, 0x00, 1, 63, 0x10])), _stuffed(bits.ravel())]
    return b"".join([*out, b"\xff\xd9"])


def load(image: Image) -> bytes:
    """The payload that store() laid into an image's coefficients."""
    (n,) = struct.unpack(">Q", image.comment)
    flat = np.concatenate([c.blocks.reshape(-1) for c in image.components])
    return (flat[:n] - OFFSET).astype(np.uint8).tobytes()


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), media (a progressive JPEG file that holds the text, filled up with zero bytes to
    a positive multiple of 64), payload (read back from that file), height, width and rgb (the decoded tensor, row by row).

    Null and empty texts are 64 zero bytes; texts up to the format's 6 GB are whole. Equal texts have equal values. Rows
    are independent: repeated rows and null ids give their own rows, an empty table none; other columns aren't read.
    """
    names = [id_col, "n_bytes", "media", "payload", "height", "width", "rgb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = raw_texts(b, "text")
            for i, j in pieces([9 * max(64, len(x)) for x in texts]):
                rows = []
                for x in texts[i:j]:
                    file = store(x + bytes(-len(x) % 64 if x else 64))
                    image = Image(file)
                    rows.append((len(x), file, load(image), image.height, image.width, image.rgb().tobytes()))
                n, files, payloads, height, width, rgb = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(files, pa.binary()), pa.array(payloads, pa.binary()), pa.array(height, pa.int32()), pa.array(width, pa.int32()), pa.array(rgb, pa.binary())], names=names
                )

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary, payload binary, height int, width int, rgb binary"
    return mapped(docs.select(F.col(id_col), F.col(text_col).alias("text")), run, schema)
