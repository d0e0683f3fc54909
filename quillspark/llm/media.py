"""Media columns: baseline JPEG, decoded to DC-only luminance thumbnails in numpy.

``thumbnails`` parses the markers of each image, Huffman-decodes the scan that holds the luminance component and
keeps its DC coefficients only: DC * q / 8 + 128 is the mean of an 8 x 8 block, so the thumbnail has one pixel for each
block and no inverse transform is made. Decoding runs in lockstep: every image of a batch (and every restart interval
of it) is a lane, and one numpy step decodes a symbol of all lanes; when few lanes are left (one very large image), a
scalar loop finishes them. AC coefficients are decoded only to be passed over.

The result holds the dimensions, a digest of the thumbnail, and two perceptual hashes of 64 bits: ``dhash`` (signs of
horizontal differences of a 9 x 8 reduction) and ``ahash`` (above the mean of an 8 x 8 reduction).

The tables of this project hold no images, so the query draws a preview of every page (``previews``: the ink of all its
characters, eight to a pixel), encodes it as a baseline JPEG with ``encode`` and decodes that column like any other.

Defined results (``status``): a null image gives ``missing`` and nulls; anything that isn't a JPEG, is cut short or has a
damaged scan gives ``corrupt`` and the dimensions if they were read; progressive, arithmetic, lossless or 12-bit images give
``unsupported`` with their dimensions; all others ``ok``. Rows with a null id are decoded like any other; repeated
rows give repeated results; images of any size are decoded; equal thumbnails have equal hashes; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: Luminance quantisation of the JPEG standard (Annex K), row by row.
Q_LUMA = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
])
#: Huffman tables of Annex K: numbers of codes by length, and the symbols.
DC_BITS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
AC_BITS = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125])
AC_SYMBOLS = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
#: Fewer lanes than this are finished by the scalar loop.
FEW_LANES = 12
#: Bytes of images that are decoded together.
GROUP = 4 << 20


class Corrupt(ValueError):
    pass


class Unsupported(ValueError):
    pass


def codes(bits: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            if k >= len(symbols) or code >= 1 << length:
                raise Corrupt("Huffman table")
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def look_up(bits: bytes, symbols: bytes) -> np.ndarray:
    """Length * 256 + symbol by the next 16 bits; 0 where no code fits."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, code, length in codes(bits, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


class Image:
    """What the markers of one image say, and the lanes of its luminance scan."""

    def __init__(self, data: bytes):
        self.width = self.height = None
        self.lanes: list[bytes] = []
        if data[:2] != b"\xff\xd8":
            raise Corrupt("no start of image")
        self.quant: dict[int, np.ndarray] = {}
        self.huff: dict[int, tuple[bytes, bytes]] = {}
        self.parts: list[tuple[int, int, int, int]] = []
        self.restart = 0
        self.data = data

    def parse(self) -> None:
        data, at = self.data, 2
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 2 > len(data):
                raise Corrupt("no luminance scan")
            marker = data[at + 1]
            if marker in (0x00, 0xFF, 0x01) or 0xD0 <= marker <= 0xD8:
                at += 1 if marker == 0xFF else 2
                continue
            if marker == 0xD9:
                raise Corrupt("no luminance scan")
            if at + 4 > len(data):
                raise Corrupt("cut short")
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            if size < 2 or len(body) != size - 2:
                raise Corrupt("cut short")
            at += 2 + size
            if marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                self._frame(marker, body)
            elif marker == 0xDA and self._scan(body, at):
                return

    def _quantisation(self, body: bytes) -> None:
        while body:
            wide, which = body[0] >> 4, body[0] & 15
            n = 64 * (1 + (wide > 0))
            if len(body) < 1 + n:
                raise Corrupt("quantisation table")
            self.quant[which] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
            body = body[1 + n :]

    def _huffman(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            if len(body) < 17 + n:
                raise Corrupt("Huffman table")
            self.huff[body[0]] = (body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, marker: int, body: bytes) -> None:
        if len(body) < 6 or len(body) < 6 + 3 * body[5]:
            raise Corrupt("frame")
        self.height, self.width = struct.unpack(">HH", body[1:5])
        if marker not in (0xC0, 0xC1) or body[0] != 8 or not self.height:
            raise Unsupported("not a baseline frame")
        self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        if not self.width or not self.parts or any(not 1 <= h <= 4 or not 1 <= v <= 4 for _, h, v, _ in self.parts):
            raise Corrupt("frame")

    def _scan(self, body: bytes, at: int) -> bool:
        """Whether this scan holds the first component; then its lanes are cut out."""
        n = body[0] if body else 0
        if not self.parts or not n or len(body) < 4 + 2 * n:
            raise Corrupt("scan")
        chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(n)}
        if self.parts[0][0] not in chosen:
            return False
        h0, v0 = self.parts[0][1:3]
        hm, vm = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        up = lambda a, b: -(-a // b)
        self.across, self.down = up(up(self.width * h0, hm), 8), up(up(self.height * v0, vm), 8)
        # One MCU: (DC table, AC table, is it luminance) of each block.
        self.unit = []
        for ident, h, v, _ in self.parts:
            if ident in chosen:
                tables = (self.huff.get(chosen[ident] >> 4), self.huff.get(16 + (chosen[ident] & 15)))
                if None in tables:
                    raise Corrupt("no Huffman table")
                self.unit += [(*tables, ident)] * (h * v if n > 1 else 1)
        if n > 1:
            self.mcus, self.mcu_across = up(self.width, 8 * hm) * up(self.height, 8 * vm), up(self.width, 8 * hm)
            self.tile = (h0, v0)
        else:
            self.mcus, self.mcu_across, self.tile = self.across * self.down, self.across, (1, 1)
        if self.parts[0][3] not in self.quant:
            raise Corrupt("no quantisation table")
        self.step = int(self.quant[self.parts[0][3]][0])
        self._cut(at)
        return True

    def _cut(self, at: int) -> None:
        """The scan's bytes without stuffing, one lane for each restart interval."""
        data, start = self.data, at
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                at = len(data)
                break
            m = data[at + 1]
            if m == 0 or m == 0xFF:
                at += 2 if m == 0 else 1
            elif 0xD0 <= m <= 0xD7:
                self.lanes.append(data[start:at].replace(b"\xff\x00", b"\xff"))
                at += 2
                start = at
            else:
                break
        self.lanes.append(data[start:at].replace(b"\xff\x00", b"\xff"))
        need = -(-self.mcus // self.restart) if self.restart else 1
        if len(self.lanes) < need:
            raise Corrupt("cut short")
        del self.lanes[need:]

    def plane(self, dc: np.ndarray) -> np.ndarray:
        """The thumbnail: luminance DCs in the order of the scan, as block means."""
        h, v = self.tile
        rows = len(dc) // (h * v * self.mcu_across)
        grid = dc.reshape(rows, self.mcu_across, v, h).transpose(0, 2, 1, 3).reshape(rows * v, self.mcu_across * h)
        grid = grid[: self.down, : self.across]
        return np.clip(np.rint(grid * self.step / 8 + 128), 0, 255).astype(np.uint8)


def _lane_units(images: list[Image]) -> list[tuple[int, int, int]]:
    """(image, first MCU, MCUs) of each lane."""
    out = []
    for i, im in enumerate(images):
        per = im.restart or im.mcus
        out += [(i, k * per, min(per, im.mcus - k * per)) for k in range(len(im.lanes))]
    return out


def decode_dc(images: list[Image], few: int = FEW_LANES) -> tuple[list[np.ndarray], np.ndarray]:
    """Luminance DCs of each parsed image in the order of its scan, and which images are damaged."""
    lanes = _lane_units(images)
    kinds: dict[tuple[bytes, bytes], int] = {}
    luts: list[np.ndarray] = []
    programs: dict[tuple, int] = {}
    unit_dc, unit_ac, unit_part, unit_luma = [], [], [], []
    program_at, program_n = [], []
    which = []
    for im in images:
        key = tuple(im.unit)
        if key not in programs:
            programs[key] = len(program_at)
            program_at.append(len(unit_dc))
            program_n.append(len(key))
            names: dict[int, int] = {}
            for dc, ac, ident in key:
                for t in (dc, ac):
                    if t not in kinds:
                        kinds[t] = len(luts)
                        luts.append(look_up(*t))
                unit_dc.append(kinds[dc])
                unit_ac.append(kinds[ac])
                unit_part.append(names.setdefault(ident, len(names)))
                unit_luma.append(ident == im.parts[0][0])
        which.append(programs[key])
    lut = np.concatenate(luts)
    unit_dc, unit_ac, unit_part, unit_luma = (np.array(x, np.int64) for x in (unit_dc, unit_ac, unit_part, unit_luma))
    luma = [int(unit_luma[program_at[w] : program_at[w] + program_n[w]].sum()) for w in which]
    out_at = np.concatenate([[0], np.cumsum([im.mcus * n for im, n in zip(images, luma)])]).astype(np.int64)
    out = np.zeros(int(out_at[-1]), np.int64)
    chunks = [im.lanes[k] for im in images for k in range(len(im.lanes))]
    # Lanes stand one after another, with padding bytes, as 64-bit big-endian windows at every byte.
    pad = b"\xff" * 16
    start = np.concatenate([[0], np.cumsum([len(c) + len(pad) for c in chunks])])[:-1].astype(np.int64)
    raw = np.frombuffer(pad.join([*chunks, b""]) + pad, np.uint8)
    window = np.zeros(len(raw) - 8, np.uint64)
    for k in range(8):
        window |= raw[k : k + len(window)].astype(np.uint64) << np.uint64(56 - 8 * k)
    limit = (start + np.array([len(c) for c in chunks])) * 8
    owner = np.array([i for i, _, _ in lanes], np.int64)
    base = np.array([program_at[which[i]] for i in owner], np.int64)
    units = np.array([program_n[which[i]] for i in owner], np.int64)
    left = np.array([m for _, _, m in lanes], np.int64) * units
    write = np.array([out_at[i] + first * luma[i] for i, first, _ in lanes], np.int64)
    bad = np.zeros(len(images), bool)
    bit, k, unit, pred = start * 8, np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64), np.zeros((len(lanes), 4), np.int64)
    live = np.flatnonzero(left > 0)
    u16, u63 = np.uint64(48), np.uint64(63)
    while len(live) > few:
        b = bit[live]
        w = window[b >> 3] << (b & 7).astype(np.uint64)
        first = k[live] == 0
        slot = base[live] + unit[live]
        code = lut[(np.where(first, unit_dc[slot], unit_ac[slot]) << 16) + (w >> u16).astype(np.int64)].astype(np.int64)
        length, symbol = code >> 8, code & 255
        s = np.where(first, symbol, symbol & 15)
        wrong = (length == 0) | (first & (s > 11))
        s = np.where(wrong, 0, s)
        value = (((w << length.astype(np.uint64)) >> np.uint64(1)) >> (u63 - s.astype(np.uint64))).astype(np.int64)
        value = np.where((s > 0) & (value < (1 << np.maximum(s - 1, 0))), value - (1 << s) + 1, value)
        b = b + length + s
        wrong |= b > limit[live]
        bit[live] = b
        d = live[first & ~wrong]
        if len(d):
            q = slot[first & ~wrong]
            part = unit_part[q]
            pred[d, part] += value[first & ~wrong]
            lum = unit_luma[q] > 0
            out[write[d[lum]]] = pred[d[lum], part[lum]]
            write[d[lum]] += 1
        run = symbol >> 4
        ahead = np.where(first, 1, np.where((s > 0) | (run == 15), run + 1, 64))
        nk = k[live] + ahead
        wrong |= ~first & (s > 0) & (nk > 64)
        over = nk >= 64
        k[live] = np.where(over, 0, nk)
        if over.any():
            e = live[over]
            left[e] -= 1
            unit[e] += 1
            e = e[unit[e] == units[e]]
            unit[e] = 0
        if wrong.any():
            bad[owner[live[wrong]]] = True
            left[live[wrong]] = 0
        if over.any() or wrong.any():
            live = live[left[live] > 0]
    tables = [t.tolist() for t in luts] if len(live) else []
    for lane in live:
        own = slice(base[lane], base[lane] + units[lane])
        program = list(zip((tables[t] for t in unit_dc[own]), (tables[t] for t in unit_ac[own]), unit_part[own].tolist(), unit_luma[own].tolist()))
        got = _finish(chunks[lane], int(bit[lane] - start[lane] * 8), program, int(k[lane]), int(unit[lane]), int(left[lane]), pred[lane].tolist())
        if got is None:
            bad[owner[lane]] = True
        else:
            out[write[lane] : write[lane] + len(got)] = got
    return [out[a:z] for a, z in zip(out_at[:-1], out_at[1:])], bad


def _finish(data: bytes, bit: int, program: list[tuple], at: int, u: int, left: int, pred: list[int]) -> list[int] | None:
    """Luminance DCs of the rest of one lane, symbol by symbol; None where it is damaged."""
    size = len(data) * 8
    data += b"\xff" * 8
    got = []
    while left:
        w = int.from_bytes(data[bit >> 3 : (bit >> 3) + 5], "big") << (bit & 7) & 0xFFFFFFFFFF
        dc, ac, part, luma = program[u]
        code = (ac if at else dc)[w >> 24]
        length, symbol = code >> 8, code & 255
        s = symbol & 15 if at else symbol
        bit += length + s
        if not length or bit > size or (not at and s > 11):
            return None
        if not at:
            value = (w >> (40 - length - s)) & ((1 << s) - 1)
            if s and value < 1 << (s - 1):
                value -= (1 << s) - 1
            pred[part] += value
            if luma:
                got.append(pred[part])
            at = 1
        elif s or symbol == 0xF0:
            at += (symbol >> 4) + 1
            if s and at > 64:
                return None
        else:
            at = 64
        if at >= 64:
            at, u, left = 0, (u + 1) % len(program), left - 1
    return got


def reduce_to(plane: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Area means over a grid of ``rows`` x ``cols``; a smaller plane is repeated."""
    h, w = plane.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = plane.astype(np.float64).cumsum(0).cumsum(1)
    def edges(n, parts):
        lo = np.arange(parts) * n // parts
        return lo, np.maximum(lo + 1, (np.arange(parts) + 1) * n // parts)
    (a, b), (c, d) = edges(h, rows), edges(w, cols)
    return (total[b][:, d] - total[a][:, d] - total[b][:, c] + total[a][:, c]) / ((b - a)[:, None] * (d - c)[None, :])


def hashes(plane: np.ndarray) -> tuple[int, int]:
    """(dhash, ahash) as signed 64-bit numbers."""
    wide, small = reduce_to(plane, 8, 9), reduce_to(plane, 8, 8)
    bits = np.stack([(wide[:, 1:] > wide[:, :-1]).ravel(), (small > small.mean()).ravel()])
    return tuple(int.from_bytes(np.packbits(b).tobytes(), "big", signed=True) for b in bits)


def decode(data: list[bytes | None], few: int = FEW_LANES) -> list[tuple[str, int | None, int | None, np.ndarray | None]]:
    """(status, width, height, thumbnail) of each image."""
    out: list = [None] * len(data)
    group: list[tuple[int, Image]] = []
    held = 0

    def flush():
        nonlocal group, held
        if group:
            dcs, bad = decode_dc([im for _, im in group], few)
            for (i, im), dc, wrong in zip(group, dcs, bad):
                out[i] = ("corrupt", im.width, im.height, None) if wrong else ("ok", im.width, im.height, im.plane(dc))
        group, held = [], 0

    for i, x in enumerate(data):
        if x is None:
            out[i] = ("missing", None, None, None)
            continue
        im = None
        try:
            im = Image(x)
            im.parse()
        except (Corrupt, Unsupported) as e:
            out[i] = ("unsupported" if isinstance(e, Unsupported) else "corrupt", im and im.width, im and im.height, None)
            continue
        group.append((i, im))
        held += len(x)
        if held > GROUP:
            flush()
    flush()
    return out


SCHEMA = "id long, status string, width int, height int, thumb_width int, thumb_height int, mean_luma double, dhash long, ahash long, thumb_md5 string"


def _rows(ids: pa.Array, data: list[bytes | None], keep: bool) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(9 + keep)]
    for status, width, height, plane in decode(data):
        if plane is None:
            row = (status, width, height, None, None, None, None, None, None, None)
        else:
            row = (status, width, height, plane.shape[1], plane.shape[0], round(float(plane.mean()), 4), *hashes(plane), hashlib.md5(struct.pack(">II", *plane.shape) + plane.tobytes()).hexdigest(), plane.tobytes())
        for c, x in zip(cols, row):
            c.append(x)
    types = [pa.string()] + [pa.int32()] * 4 + [pa.float64()] + [pa.int64()] * 2 + [pa.string()] + [pa.binary()] * keep
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["thumbnail"] * keep
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types))], names=names)


def thumbnails(images: DataFrame, ident: str | Column = "id", image: str | Column = "image", keep: bool = False) -> DataFrame:
    """``SCHEMA`` for every row; with ``keep`` also the thumbnail's pixels, row by row."""

    def run(batches):
        for b in batches:
            yield _rows(b.column("id"), b.column("image").to_pylist(), keep)

    col = lambda c: F.col(c) if isinstance(c, str) else c
    return images.select(col(ident).cast("long").alias("id"), col(image).cast("binary").alias("image")).mapInArrow(run, SCHEMA + ", thumbnail binary" * keep)


# A baseline encoder: it draws the query's previews and lets tests make images.

_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _code_arrays(bits: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, c, n in codes(bits, symbols):
        code[s], length[s] = c, n
    return code, length


_DC_CODE, _AC_CODE = _code_arrays(DC_BITS, DC_SYMBOLS), _code_arrays(AC_BITS, AC_SYMBOLS)


def quantisation(quality: int) -> np.ndarray:
    """The standard luminance table at a quality of 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((Q_LUMA * scale + 50) // 100, 1, 255)


def _magnitude(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def _pack(code: np.ndarray, length: np.ndarray) -> bytes:
    """Bits of all codes, one after another, filled up with ones and stuffed."""
    at = np.cumsum(length)
    n = int(at[-1]) if len(at) else 0
    bits = np.ones(-(-n // 8) * 8, np.uint8)
    own = np.repeat(np.arange(len(length)), length)
    down = (at[own] - 1 - np.arange(n)).astype(np.uint64)
    bits[:n] = (code[own] >> down) & np.uint64(1)
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def entropy_code(blocks: list[np.ndarray]) -> bytes:
    """One interval: blocks (n, 64 in zigzag order) of each component, taken in turn block by block."""
    z = np.stack(blocks, 1).reshape(-1, 64) if len(blocks) > 1 else blocks[0]
    parts = len(blocks)
    dc = z[:, 0].copy()
    dc[parts:] -= z[:-parts, 0]
    cat = _magnitude(dc)
    extra = np.where(dc < 0, dc + (1 << cat) - 1, dc).astype(np.uint64)
    n = len(z)
    r, c = np.nonzero(z[:, 1:])
    v = z[r, c + 1]
    prev = np.where(np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.zeros(0, bool), -1, np.concatenate([[-1], c[:-1]]) if len(c) else c)
    run = c - prev - 1
    ac_cat = _magnitude(v)
    symbol = (run % 16) << 4 | ac_cat
    ac_extra = np.where(v < 0, v + (1 << ac_cat) - 1, v).astype(np.uint64)
    last = np.full(n, -1)
    last[r] = c
    # (order, code, length) of DCs, long runs of zeros, ACs and block ends; the order is block * 512 + place
    skips = run // 16
    skip_at = np.repeat(r * 512 + (c + 1) * 4, skips)
    end = np.flatnonzero(last < 62)
    order = np.concatenate([np.arange(n) * 512, skip_at, r * 512 + (c + 1) * 4 + 1, end * 512 + 511])
    code = np.concatenate([_DC_CODE[0][cat] << cat.astype(np.uint64) | extra, np.full(len(skip_at), _AC_CODE[0][0xF0]), _AC_CODE[0][symbol] << ac_cat.astype(np.uint64) | ac_extra, np.full(len(end), _AC_CODE[0][0])])
    length = np.concatenate([_DC_CODE[1][cat] + cat, np.full(len(skip_at), _AC_CODE[1][0xF0]), _AC_CODE[1][symbol] + ac_cat, np.full(len(end), _AC_CODE[1][0])])
    k = np.argsort(order, kind="stable")
    return _pack(code[k], length[k])


def blocks_of(plane: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Quantised blocks in zigzag order, row by row; the edges are repeated up to whole blocks."""
    h, w = plane.shape
    p = np.pad(plane.astype(np.float64), ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    f = _DCT @ b @ _DCT.T
    return np.rint(f.reshape(-1, 64) / quant).astype(np.int64)[:, ZIGZAG]


def encode(plane: np.ndarray, quality: int = 50, restart: int = 0, chroma: bool = False) -> bytes:
    """A baseline JPEG of a luminance plane (rows x columns of bytes); ``chroma`` adds two grey components."""
    quant = quantisation(quality)
    b = blocks_of(plane, quant)
    parts = 3 if chroma else 1
    seg = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    out = [b"\xff\xd8", seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), seg(0xDB, b"\0" + quant[ZIGZAG].astype(np.uint8).tobytes())]
    out.append(seg(0xC0, struct.pack(">BHHB", 8, *plane.shape, parts) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(parts))))
    out += [seg(0xC4, b"\0" + DC_BITS + DC_SYMBOLS), seg(0xC4, b"\x10" + AC_BITS + AC_SYMBOLS)]
    if restart:
        out.append(seg(0xDD, struct.pack(">H", restart)))
    out.append(seg(0xDA, bytes([parts]) + b"".join(bytes([k + 1, 0]) for k in range(parts)) + b"\0\x3f\0"))
    for k, a in enumerate(range(0, len(b), restart or len(b))):
        own = b[a : a + restart] if restart else b
        if k:
            out.append(bytes([0xFF, 0xD0 + (k - 1) % 8]))
        out.append(entropy_code([own] + [np.zeros_like(own)] * (parts - 1)))
    return b"".join(out) + b"\xff\xd9"


_INK = np.full(256, 110, np.uint8)  # letters of other scripts
_INK[[9, 10, 11, 12, 13, 32]] = 255
_INK[33:127] = 60 + (np.arange(33, 127) * 37) % 100
_INK[ord("<")] = _INK[ord(">")] = 0

#: Pixels of a preview from left to right, and bytes of the page to a pixel.
ACROSS, PER_PIXEL = 64, 8


def preview(page: bytes) -> np.ndarray:
    """Mean ink of each ``PER_PIXEL`` bytes of the whole page, ``ACROSS`` pixels to a row; an empty page is one white pixel row.

    A page of over 65,535 rows, which a JPEG can't have, gets rows of a multiple of ``ACROSS``.
    """
    ink = _INK[np.frombuffer(page, np.uint8)]
    across = ACROSS * max(1, -(-len(ink) // (ACROSS * PER_PIXEL * 65535)))
    cell = across * PER_PIXEL
    full = np.full(max(1, -(-len(ink) // cell)) * cell, 255, np.uint8)
    full[: len(ink)] = ink
    return np.rint(full.reshape(-1, across, PER_PIXEL).mean(2)).astype(np.uint8)


def previews(pages: DataFrame) -> DataFrame:
    """(id, image): a JPEG of the preview of every page; null for a page without html."""

    def run(batches):
        for b in batches:
            images = [None if x is None else encode(preview(x.encode())) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(images, pa.binary())], names=["id", "image"])

    return pages.select(F.col("page_id").cast("long").alias("id"), "html").mapInArrow(run, "id long, image binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thumbnails(previews(spark.read.parquet(f"{sf_dir}/pages.parquet"))).withColumnRenamed("id", "page_id")
