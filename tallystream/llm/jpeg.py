"""Progressive JPEG media columns.

`store` writes bytes losslessly as the coefficients of a progressive JPEG (4:2:0, all quantisers 1): a byte less 128 is one
coefficient.  `read` is a decoder for progressive JPEG: spectral-selection and successive-approximation scans add up in
coefficient arrays, which are inverse-transformed in numpy, chroma is upsampled, and the full-resolution RGB tensor is kept.

Entropy decoding is sequential within a restart interval, so all intervals of all images of a batch are decoded in
step: each numpy operation takes one symbol of thousands of intervals.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads are padded with bytes 255 to a positive multiple of this; restart intervals hold so many blocks.
UNIT, INTERVAL = 576, 4
#: Payload bytes handled at once.
AT_ONCE = 1 << 21


def _zigzag() -> np.ndarray:
    """Row-major position of each coefficient in scan order: along the anti-diagonals, turning at the edges."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([i * 8 + j for i, j in cells])


ZIGZAG = _zigzag()
_c = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
#: Scan-ordered coefficients to pixels, in whole 1/2**14, so that sums are exact in any order.
_IDCT = np.round(np.einsum("xu,yv->uvxy", _c, _c).reshape(64, 64)[ZIGZAG] * (1 << 14))

# --- Huffman tables -------------------------------------------------------------------------------


def _codes(lengths: dict[int, int]) -> tuple[dict[int, tuple[int, int]], bytes]:
    """Canonical codes (code, length) of symbols with given lengths, and the table as DHT holds it."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    out, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (code, last)
        code += 1
    counts = [sum(n == i for n in lengths.values()) for i in range(1, 17)]
    return out, bytes(counts) + bytes(order)


# A size-s value takes a code of 8-s bits and s bits more; zeros, runs and ends of block take longer codes.
_DC, _DC_TABLE = _codes({s: 8 - s for s in range(1, 8)} | {0: 9, **{s: 16 for s in range(8, 12)}})
_AC, _AC_TABLE = _codes({s: 8 - s for s in range(1, 8)} | {r << 4 | s: 16 for r in range(16) for s in range(1, 8) if r} | {0: 12, 0xF0: 16, 8: 16})
_FINE, _FINE_TABLE = _codes({0: 1, 0xF0: 6, **{r << 4 | 1: 6 for r in range(16)}})
_DC_CODE, _AC_CODE = (np.zeros((256, 2), np.int64) for _ in range(2))
for _table, _array in ((_DC, _DC_CODE), (_AC, _AC_CODE)):
    for _s, _v in _table.items():
        _array[_s] = _v
_SIZE = np.array([int(i).bit_length() for i in range(4096)])


class _Lookup:
    """Symbol and code length for every 16 bits ahead (length 0: no code)."""

    def __init__(self, table: bytes) -> None:
        counts, symbols = table[:16], table[16:]
        self.symbol, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code, at = 0, 0
        for bits, n in enumerate(counts, 1):
            for _ in range(n):
                lo, hi = code << (16 - bits), (code + 1) << (16 - bits)
                self.symbol[lo:hi], self.length[lo:hi] = symbols[at], bits
                code, at = code + 1, at + 1
            code <<= 1


_lookups: dict[bytes, _Lookup] = {}


def _lookup(table: bytes) -> _Lookup:
    if table not in _lookups:
        if len(_lookups) > 64:
            _lookups.clear()
        _lookups[table] = _Lookup(table)
    return _lookups[table]


# --- Encoding -------------------------------------------------------------------------------------


def _grid(payload: int) -> tuple[int, int]:
    """Rows and columns of 16 x 16 units that hold a payload of so many bytes."""
    units = -(-payload // (6 * 64))
    rows = max(-(-units // 256), 1) if units <= 256 * 4000 else 4000
    return rows, -(-units // rows)


def _packed(value: np.ndarray, length: np.ndarray, segment: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of bit strings (value, length up to 24), by ascending segment; each segment starts on a byte and is padded with ones.
    Returns the bytes and each segment's end."""
    bits = np.bincount(segment, length, segments).astype(np.int64)
    ends = np.cumsum(-(-bits // 8))
    starts = ends - -(-bits // 8)
    order = np.concatenate([[0], np.cumsum(length)])
    first = np.concatenate([[0], np.cumsum(bits)])[:-1]
    at = order[:-1] - first[segment] + starts[segment] * 8
    n = int(ends[-1]) if segments else 0
    shifted = value.astype(np.uint64) << (32 - length - (at & 7)).astype(np.uint64)
    out = np.zeros(n + 4)
    for i in range(4):
        out += np.bincount((at >> 3) + i, ((shifted >> np.uint64(24 - 8 * i)) & np.uint64(255)).astype(np.float64), n + 4)[: n + 4]
    out = out[:n].astype(np.uint8)
    pad = (ends * 8 - starts * 8 - bits).astype(np.int64)
    some = bits > 0
    out[ends[some] - 1] |= ((1 << pad[some]) - 1).astype(np.uint8)
    return out, ends


def _stuffed(data: np.ndarray, ends: np.ndarray, last: np.ndarray, nth: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy data with zero bytes after 255 and restart markers after all but the last segment of a scan; and where each segment ends."""
    full = data == 255
    extra = full.astype(np.int64)
    inner = ends[~last] - 1
    np.add.at(extra, inner, 2)
    to = np.arange(len(data)) + np.cumsum(extra) - extra
    out = np.zeros(len(data) + int(extra.sum()), np.uint8)
    out[to] = data
    mark = to[inner] + 1 + full[inner]
    out[mark] = 255
    out[mark + 1] = 0xD0 + (nth[~last] & 7)
    return out.tobytes(), to[ends - 1] + 1 + extra[ends - 1]


def _value_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _first_ac(t: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit strings of a first scan of a band (blocks x band): value, length, block."""
    block, pos = np.nonzero(t)
    v = t[block, pos].astype(np.int64)
    new = np.ones(len(block), bool)
    new[1:] = block[1:] != block[:-1]
    run = pos - np.where(new, -1, np.concatenate([[0], pos[:-1]])) - 1
    size = _SIZE[np.abs(v)]
    code = _AC_CODE[(run & 15) << 4 | size]
    value, length = code[:, 0] << size | _value_bits(v, size), code[:, 1] + size
    skips = np.repeat(np.arange(len(block)), run >> 4)
    last = np.full(len(t), -1)
    last[block] = pos
    ends = np.flatnonzero(last < t.shape[1] - 1)
    where = np.concatenate([skips, np.searchsorted(block, ends, "right")])
    more = np.concatenate([np.tile(_AC_CODE[0xF0], (len(skips), 1)), np.tile(_AC_CODE[0], (len(ends), 1))]).astype(np.int64)
    own = np.concatenate([block[skips], ends])
    return np.insert(value, where, more[:, 0]), np.insert(length, where, more[:, 1]), np.insert(block, where, own)


def _fine_block(v: np.ndarray) -> list[tuple[int, int]]:
    """Bit strings of one block's refinement (63 coefficients, last bit)."""
    size = np.abs(v).tolist()
    ones = [i for i, x in enumerate(size) if x == 1]
    out, run, held = [], 0, []
    for i, x in enumerate(size):
        if x == 0:
            run += 1
            continue
        while run > 15 and ones and i <= ones[-1]:
            out += [_FINE[0xF0], *held]
            held, run = [], run - 16
        if x > 1:
            held.append((x & 1, 1))
        else:
            out += [_FINE[run << 4 | 1], (int(v[i] > 0), 1), *held]
            held, run = [], 0
    if run or held:
        out += [_FINE[0], *held]
    return out


def _fine_ac(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit strings of the refinement of all blocks (blocks x 63): value, length, block."""
    size = np.abs(v)
    slow = (size == 1).any(axis=1)
    old = (size > 1) & ~slow[:, None]
    # Without new coefficients a block is an end-of-block code and its correction bits, in pieces of at most 21 bits.
    value, length, block = [], [], []
    for i in range(0, 63, 21):
        w = np.zeros(len(v), np.int64)
        n = np.zeros(len(v), np.int64)
        for k in range(i, i + 21):
            w = np.where(old[:, k], w << 1 | (size[:, k] & 1), w)
            n += old[:, k]
        if not i:
            w += _FINE[0][0] << n
            n = n + _FINE[0][1]
        n[slow] = 0
        w[slow] = 0
        value.append(w)
        length.append(n)
    order = np.arange(len(v))
    value, length, block = np.stack(value, 1).ravel(), np.stack(length, 1).ravel(), np.repeat(order, 3)
    if slow.any():
        parts = [(b, _fine_block(v[b])) for b in np.flatnonzero(slow).tolist()]
        own = np.array([b for b, p in parts for _ in p])
        more = np.array([x for _, p in parts for x in p], np.int64).reshape(-1, 2)
        where = np.searchsorted(block, own)
        value, length, block = np.insert(value, where, more[:, 0]), np.insert(length, where, more[:, 1]), np.insert(block, where, own)
    return value, length, block


_SCANS = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0))


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload (lengths are positive multiples of UNIT)."""
    grids = [_grid(len(p)) for p in payloads]
    blocks = np.array([6 * r * c for r, c in grids])
    coef = np.full(int(blocks.sum()) * 64, 128, np.uint8)
    base = np.concatenate([[0], np.cumsum(blocks)])
    for p, b in zip(payloads, base.tolist(), strict=False):
        coef[b * 64 : b * 64 + len(p)] = np.frombuffer(p, np.uint8)
    coef = coef.reshape(-1, 64).astype(np.int16) - 128
    # A segment is INTERVAL blocks of one component of one image; components follow each other: 4/6, 1/6, 1/6.
    parts = np.array([(r * c * 4, r * c, r * c) for r, c in grids])
    sizes = parts.ravel()
    segs = -(-sizes // INTERVAL)
    owner = np.repeat(np.arange(len(sizes)), segs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(segs) - segs, segs)
    within = np.arange(len(coef)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    segment = np.repeat(np.cumsum(segs) - segs, sizes) + within // INTERVAL
    last = nth == np.repeat(segs, segs) - 1
    scans = []
    for lo, hi, high, low in _SCANS:
        if hi == 0 and not high:
            t = (coef[:, 0] >> 1).astype(np.int64)
            diff = t - np.where(within % INTERVAL == 0, 0, np.concatenate([[0], t[:-1]]))
            size = _SIZE[np.abs(diff)]
            code = _DC_CODE[size]
            got = code[:, 0] << size | _value_bits(diff, size), code[:, 1] + size, np.arange(len(coef))
        elif hi == 0:
            got = (coef[:, 0] & 1).astype(np.int64), np.ones(len(coef), np.int64), np.arange(len(coef))
        elif not high:
            band = coef[:, lo : hi + 1]
            got = _first_ac(np.sign(band) * (np.abs(band) >> 1), lo)
        else:
            got = _fine_ac(coef[:, 1:])
        data, ends = _packed(got[0], got[1], segment[got[2]], len(owner))
        out, cut = _stuffed(data, ends, last, nth)
        edge = np.concatenate([[0], cut[np.cumsum(segs) - 1]]).tolist()
        scans.append((out, edge))
    out = []
    for i, (p, (rows, cols)) in enumerate(zip(payloads, grids, strict=True)):
        note = b"payload %d" % len(p)
        head = [b"\xff\xd8", b"\xff\xfe", struct.pack(">H", len(note) + 2), note, b"\xff\xdb\x00\x43\x00" + b"\x01" * 64]
        head.append(b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, rows * 16, cols * 16, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
        for name, t in ((0x00, _DC_TABLE), (0x10, _AC_TABLE), (0x11, _FINE_TABLE)):
            head.append(b"\xff\xc4" + struct.pack(">HB", len(t) + 3, name) + t)
        head.append(b"\xff\xdd\x00\x04" + struct.pack(">H", INTERVAL))
        for (data, edge), (lo, hi, high, low) in zip(scans, _SCANS, strict=True):
            for c in range(3):
                head.append(b"\xff\xda\x00\x08\x01" + bytes([c + 1, 0x01 if high and hi else 0x00, lo, hi, high << 4 | low]))
                head.append(data[edge[3 * i + c] : edge[3 * i + c + 1]])
        head.append(b"\xff\xd9")
        out.append(b"".join(head))
    return out


# --- Decoding -------------------------------------------------------------------------------------


class _Image:
    """Frame, tables in force and scans of one file; blocks are numbered from `base` in the batch."""

    def __init__(self, data: bytes, start: int, base: int) -> None:
        self.height = self.width = 0
        self.parts: list[dict] = []
        self.note = b""
        quant: dict[int, bytes] = {}
        tables: dict[int, bytes] = {}
        orders: dict[bytes, tuple] = {}
        interval, at, self.blocks = 0, 2, 0
        self.jobs: list[tuple[tuple, np.ndarray, list[tuple[int, int]], int, tuple]] = []
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        while at + 4 <= len(data):
            if data[at] != 255:
                raise ValueError("marker expected")
            mark = data[at + 1]
            if mark == 0xD9:
                break
            if mark == 255:
                at += 1
                continue
            n = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if mark == 0xFE:
                self.note = body
            elif mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = body[1 : 65 + 64 * wide]
                    body = body[65 + 64 * wide :]
            elif mark == 0xC4:
                while body:
                    k = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:k]
                    body = body[k:]
            elif mark == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif mark == 0xC2:
                self.height, self.width, count = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
                raw = [body[6 + 3 * i : 9 + 3 * i] for i in range(count)]
                self.hmax, self.vmax = max(x[1] >> 4 for x in raw), max(x[1] & 15 for x in raw)
                self.units = (-(-self.height // (8 * self.vmax)), -(-self.width // (8 * self.hmax)))
                for x in raw:
                    h, v = x[1] >> 4, x[1] & 15
                    part = {"id": x[0], "h": h, "v": v, "q": x[2], "rows": self.units[0] * v, "cols": self.units[1] * h, "base": base + self.blocks}
                    part["used"] = (-(-(-(-self.height * v // self.vmax)) // 8), -(-(-(-self.width * h // self.hmax)) // 8))
                    self.parts.append(part)
                    self.blocks += part["rows"] * part["cols"]
            elif 0xC0 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
                raise ValueError("not progressive")
            elif mark == 0xDA:
                count = body[0]
                chosen = [(next(p for p in self.parts if p["id"] == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(count)]
                lo, hi, high, low = body[1 + 2 * count], body[2 + 2 * count], body[3 + 2 * count] >> 4, body[3 + 2 * count] & 15
                key = body[1 : 1 + 2 * count : 2]
                if key not in orders:
                    orders[key] = self._order([p for p, _ in chosen])
                order, per, which = orders[key]
                cuts = []
                while True:  # restart markers part the data; any other marker ends it
                    end = data.find(b"\xff", at)
                    begin = at
                    while end >= 0 and data[end + 1] == 0:
                        end = data.find(b"\xff", end + 2)
                    end = len(data) if end < 0 else end
                    cuts.append((start + begin, start + end))
                    if end < len(data) and 0xD0 <= data[end + 1] <= 0xD7:
                        at = end + 2
                        continue
                    at = end
                    break
                names = tuple(tables.get((0x10 if hi else 0) | ((t & 15) if hi else t >> 4), b"") for _, t in chosen)
                self.jobs.append(((lo, hi, high, low, names), order, cuts, interval * per if interval else len(order), which))
        for p in self.parts:
            p["quant"] = quant.get(p["q"], b"\x01" * 64)

    def _order(self, parts: list[dict]) -> tuple[np.ndarray, int, tuple]:
        """Block numbers in the order of a scan, blocks to a unit, and the component of each block of a unit."""
        if len(parts) == 1:
            p = parts[0]
            rows, cols = p["used"]
            return (p["base"] + np.arange(rows)[:, None] * p["cols"] + np.arange(cols)).ravel(), 1, (0,)
        grid = []
        for p in parts:
            y, x = np.arange(self.units[0])[:, None] * p["v"], np.arange(self.units[1])[None, :] * p["h"]
            grid += [p["base"] + (y + v) * p["cols"] + x + h for v in range(p["v"]) for h in range(p["h"])]
        which = tuple(i for i, p in enumerate(parts) for _ in range(p["h"] * p["v"]))
        return np.stack(grid, axis=-1).reshape(-1), len(grid), which


class _Bits:
    """Bits of many intervals at once."""

    def __init__(self, raw: np.ndarray) -> None:
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != 0) | (raw[:-1] != 255)
        self.to = np.concatenate([[0], np.cumsum(keep)])
        data = np.concatenate([raw[keep], np.zeros(16, np.uint8)]).astype(np.uint32)
        self.word = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        return (self.word[at >> 3] >> (16 - (at & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

    def read(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.peek(at) >> (16 - n)


def _signed(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)


def _dc(bits, coef, order, lane, count, at, high, low, luts, which) -> None:
    pred = np.zeros((len(at), max(1, int(which.max()) + 1)), np.int64)
    for k in range(int(count.max())):
        on = np.flatnonzero(k < count)
        block = order[lane[on] + k]
        if high:
            coef[block, 0] |= (bits.read(at[on], np.ones(len(on), np.int64)) << low).astype(coef.dtype)
            at[on] += 1
            continue
        part = int(which[k % len(which)])
        ahead = bits.peek(at[on])
        size = luts[part].symbol[ahead]
        at[on] += luts[part].length[ahead]
        pred[on, part] += _signed(bits.read(at[on], size), size)
        at[on] += size
        coef[block, 0] = pred[on, part] << low


def _ac(bits, coef, order, lane, count, at, lo, hi, low, lut) -> None:
    flat = coef.reshape(-1)
    done, k, skip = np.zeros(len(at), np.int64), np.full(len(at), lo), np.zeros(len(at), np.int64)
    ids = np.arange(len(at))
    while len(ids):
        ahead = bits.peek(at)
        rs = lut.symbol[ahead]
        run, size = rs >> 4, rs & 15
        at = at + lut.length[ahead]
        plain = size > 0
        n = np.where(plain, size, np.where(run < 15, run, 0))
        v = bits.read(at, n)
        at = at + n
        k = k + np.where(plain, run, np.where(run == 15, 16, 0))
        put = np.flatnonzero(plain & (k <= hi))
        flat[order[lane[put] + done[put]] * 64 + k[put]] = _signed(v[put], size[put]) << low
        k = k + plain
        over = k > hi
        ended = ~plain & (run < 15)
        if ended.any():
            over |= ended
            skip = np.where(ended, (1 << np.where(ended, run, 0)) - 1 + v, 0)
            done = done + over + skip
        else:
            done = done + over
        k = np.where(over, lo, k)
        live = done < count
        if not live.all():
            at, lane, count, done, k, ids = at[live], lane[live], count[live], done[live], k[live], ids[live]


def _ac_fine(bits, coef, order, lane, count, at, lo, hi, low, lut) -> None:
    done, k, skip = np.zeros(len(at), np.int64), np.full(len(at), lo), np.zeros(len(at), np.int64)
    span = np.arange(lo, hi + 1)
    one = 1 << low
    while len(at):
        block = order[lane + done]
        v = coef[block, lo : hi + 1]
        old = (v != 0) & (span >= k[:, None])
        empty = (v == 0) & (span >= k[:, None])
        fresh = skip == 0  # a symbol is due; else the block is within a run of ended ones
        ahead = bits.peek(at)
        rs = np.where(fresh, lut.symbol[ahead], 0)
        run, size = rs >> 4, rs & 15
        at = at + np.where(fresh, lut.length[ahead], 0)
        ended = ~fresh | ((size == 0) & (run < 15))
        n = np.where(fresh & ended, run, np.where(size > 0, 1, 0))
        extra = bits.read(at, n)
        at = at + n
        skip = np.where(fresh & ended, (1 << np.where(ended, run, 0)) + extra, skip)
        # The walk ends at the (run + 1)-th empty place, or with the band.
        stop = np.where(ended, len(span), 0)
        going = np.flatnonzero(~ended)
        if len(going):
            hit = np.cumsum(empty[going], axis=1) == (run[going] + 1)[:, None]
            stop[going] = np.where(hit.any(axis=1), hit.argmax(axis=1), len(span))
        passed = old & (np.arange(len(span)) < stop[:, None])
        r, c = np.nonzero(passed)
        nth = (np.cumsum(passed, axis=1) - 1)[r, c]
        where = at[r] + nth
        fix = (bits.word[where >> 3] >> (31 - (where & 7)).astype(np.uint32)) & 1
        was = v[r, c]
        coef[block[r], lo + c] = was + np.where(fix.astype(bool), np.where(was > 0, one, -one), 0).astype(coef.dtype)
        at = at + passed.sum(axis=1)
        new = going[(size[going] > 0) & (stop[going] < len(span))]
        coef[block[new], lo + stop[new]] = np.where(extra[new] > 0, one, -one)
        k = lo + stop + 1
        skip = np.where(ended, skip - 1, skip)
        over = ended | (k > hi)
        done = done + over
        k = np.where(over, lo, k)
        live = done < count
        if not live.all():
            at, lane, count, done, k, skip = at[live], lane[live], count[live], done[live], k[live], skip[live]


def coefficients(files: list[bytes]) -> tuple[list[_Image], np.ndarray]:
    """The images of progressive JPEGs and all their coefficients (blocks x 64, in scan order)."""
    images, base, start = [], 0, 0
    for f in files:
        images.append(_Image(f, start, base))
        base += images[-1].blocks
        start += len(f)
    coef = np.zeros((base, 64), np.int16)
    bits = _Bits(np.frombuffer(b"".join(files), np.uint8))
    # The same step of all images is one job: scans build on each other, intervals and images do not.
    for step in range(max((len(i.jobs) for i in images), default=0)):
        groups: dict[tuple, list] = {}
        for i in images:
            if step < len(i.jobs):
                job = i.jobs[step]
                groups.setdefault((job[0], job[4]), []).append(job)
        for ((lo, hi, high, low, names), which), jobs in groups.items():
            order = np.concatenate([j[1] for j in jobs])
            lane, count, at, offset = [], [], [], 0
            for _, own, cuts, per, _ in jobs:
                first = np.arange(len(cuts)) * per
                lane.append(offset + first)
                count.append(np.clip(len(own) - first, 0, per))
                at.append(bits.to[[a for a, _ in cuts]] * 8)
                offset += len(own)
            lane, count, at = np.concatenate(lane), np.concatenate(count), np.concatenate(at)
            live = count > 0
            lane, count, at = lane[live], count[live], at[live]
            luts = [_lookup(t) if t else None for t in names]
            if not hi:
                _dc(bits, coef, order, lane, count, at, high, low, luts, np.array(which))
            elif high:
                _ac_fine(bits, coef, order, lane, count, at, lo, hi, low, luts[0])
            else:
                _ac(bits, coef, order, lane, count, at, lo, hi, low, luts[0])
    return images, coef


def pixels(images: list[_Image], coef: np.ndarray) -> np.ndarray:
    """Every block's 64 samples: dequantised and inverse-transformed, 0 to 255."""
    out = np.empty(coef.shape, np.uint8)
    by: dict[bytes, list[tuple[int, int]]] = {}
    for p in (p for i in images for p in i.parts):
        spans, n = by.setdefault(p["quant"], []), p["rows"] * p["cols"]
        if spans and spans[-1][1] == p["base"]:
            spans[-1] = (spans[-1][0], p["base"] + n)
        else:
            spans.append((p["base"], p["base"] + n))
    for table, spans in by.items():
        q = np.frombuffer(table, ">u2" if len(table) == 128 else np.uint8).astype(np.float64)
        matrix = q[:, None] * _IDCT
        for lo, hi in spans:
            for i in range(lo, hi, 4096):
                x = coef[i : min(hi, i + 4096)].astype(np.float64) @ matrix
                x += (128 << 14) + (1 << 13)
                np.maximum(x, 0, out=x)
                np.minimum(x, 255 << 14, out=x)
                out[i : min(hi, i + 4096)] = (x.astype(np.int32) >> 14).astype(np.uint8)
    return out


def tensor(image: _Image, samples: np.ndarray) -> np.ndarray:
    """The RGB tensor (height x width x 3, uint8) of an image, from pixels(); one component is grey."""
    planes, ups = [], []
    for p in image.parts:
        x = samples[p["base"] : p["base"] + p["rows"] * p["cols"]]
        planes.append(x.reshape(p["rows"], p["cols"], 8, 8).transpose(0, 2, 1, 3).reshape(p["rows"] * 8, p["cols"] * 8).astype(np.int32))
        ups.append((image.vmax // p["v"], image.hmax // p["h"]))

    def up(x: np.ndarray, by: tuple[int, int]) -> np.ndarray:
        for axis in (0, 1):
            x = np.repeat(x, by[axis], axis=axis) if by[axis] > 1 else x
        return x[: image.height, : image.width]

    if len(planes) == 1:
        return np.repeat(up(planes[0], ups[0])[:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = up(planes[0], ups[0]), planes[1] - 128, planes[2] - 128
    half = 1 << 15
    if ups[1] != ups[2]:
        cb, cr = up(cb, ups[1]), up(cr, ups[2])
        ups[1] = (1, 1)
    rgb = np.empty((*y.shape, 3), np.uint8)
    # What chroma adds is worked out before it is upsampled.
    for c, add in enumerate(((91881 * cr + half) >> 16, -((22554 * cb + 46802 * cr - half) >> 16), (116130 * cb + half) >> 16)):
        x = y + up(add, ups[1])
        np.maximum(x, 0, out=x)
        np.minimum(x, 255, out=x)
        rgb[..., c] = x
    return rgb


def payload(image: _Image, coef: np.ndarray) -> bytes:
    """The bytes that `store` put into the coefficients."""
    n = int(image.note.rpartition(b" ")[2] or 0) if image.note.startswith(b"payload ") else 0
    first = image.parts[0]["base"]
    return (coef[first : first + -(-n // 64)].reshape(-1)[:n] + 128).astype(np.uint8).tobytes()


# --- Spark ----------------------------------------------------------------------------------------


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    i, total = 0, 0
    for j, n in enumerate(sizes):
        if j > i and total + n > AT_ONCE:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(x or "").encode("utf-8") for x in batch.column(1).to_pylist()]
        full = [x + b"\xff" * (max(1, -(-len(x) // UNIT)) * UNIT - len(x)) for x in raw]
        for i, j in _runs([len(x) for x in full]):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([len(x) for x in raw[i:j]], pa.int64()), pa.array(encode_batch(full[i:j]), pa.binary())], names=["doc_id", "n_bytes", "media"]
            )


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (UTF-8 bytes of text) and media (a progressive JPEG) of every row; a null text is empty.

    The stored payload is the text's bytes and bytes 255 up to a positive multiple of UNIT.  Equal texts have equal media.  Other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame, *, tensors: bool = True) -> DataFrame:
    """The columns of media (doc_id, n_bytes, media), payload, height, width, feature, and with tensors rgb (height x width x 3 bytes).

    feature is 'WxHx3' and the sums of the three channels.  A null media gives null; bytes that are no progressive JPEG fail.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _runs([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(2)]):
                part = batch.slice(i, j - i)
                files = part.column(2).to_pylist()
                images, coef = coefficients([f for f in files if f is not None])
                samples, rows, found = pixels(images, coef), [], iter(images)
                for f in files:
                    if f is None:
                        rows.append((None,) * 5)
                        continue
                    image = next(found)
                    rgb = tensor(image, samples)
                    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
                    rows.append((payload(image, coef), image.height, image.width, f"{image.width}x{image.height}x3:{sums[0]},{sums[1]},{sums[2]}", rgb.tobytes() if tensors else None))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.binary()), strict=True)]
                names = ["doc_id", "n_bytes", "media", "payload", "height", "width", "feature", "rgb"]
                yield pa.RecordBatch.from_arrays([*part.columns, *(arrays if tensors else arrays[:-1])], names=names if tensors else names[:-1])

    schema = "doc_id long, n_bytes long, media binary, payload binary, height int, width int, feature string" + ", rgb binary" * tensors
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """What a text's stored form holds, read back from it: sizes, digests and the feature."""
    got = read(store(docs), tensors=False)
    return got.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
