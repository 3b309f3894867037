"""Lossless WebP as a media column: bytes become pixel arrays, images of one chunk each, and come back exactly.

The decoder reads prefix codes, back-references, the colour cache and entropy groups, and inverts the predictor,
cross-colour, subtract-green and palette transforms.  The encoder writes palette images with back-references and prefix
codes of varying length, or codes of fixed length where those take no more bits.  Two forms are read faster than the
general one, with the same result: codes of fixed length as one array, and images of one varying channel by looking up
the token at every bit of a stretch together and following the places where tokens begin.

Null text is the empty text, stored as 64 zero bytes.  A payload beyond 1 MiB becomes several images, one after
another.  Equal texts give equal media.  Only the key and the text are read from the input.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the format.
SIDE = 16384
_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_CACHE_FACTOR = 0x1E35A7BD
#: The offsets of the 120 short distance codes: the nearer pixels, above or to the left.
_NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
WIDTH = 64


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0

        self.end = 8 * len(data)

    def peek(self, n: int) -> int:
        at = self.at
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 5], "little") >> (at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        at = self.at
        self.at = after = at + n
        if after > self.end:
            raise ValueError("the bit stream is cut short")
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 5], "little") >> (at & 7)) & ((1 << n) - 1)


class Code:
    """A canonical prefix code, by the lengths of its symbols."""

    def __init__(self, lengths: list[int]):
        used = list(compress(range(len(lengths)), lengths))
        self.single = used[0] if len(used) == 1 else None
        self.flat = 0
        if not used:
            raise ValueError("a prefix code without symbols")
        if self.single is not None:
            return
        used.sort(key=lengths.__getitem__)
        sizes = [lengths[s] for s in used]
        self.most = sizes[-1]
        if sum([32768 >> n for n in sizes]) != 32768:
            raise ValueError("a prefix code that is not complete")
        if sizes[0] == self.most:
            self.flat, self.symbols = self.most, np.array(used, np.int64)
        self._used, self._sizes = used, sizes
        self._table: list[int] | None = None

    def array(self) -> np.ndarray:
        """16 * symbol + length for each value of the next bits; a lone symbol takes none."""
        if self.single is not None:
            return np.array([self.single << 4], np.int64)
        sizes = np.array(self._sizes, np.int64)
        found = np.array(self._used, np.int64) << 4 | sizes
        return found.repeat(1 << (self.most - sizes)).take(_mirrored(self.most))

    def table(self) -> list[int]:
        if self._table is None:
            if self.single is None and self.most <= 7:  # a small one is made faster without arrays
                plain = []
                for s, n in zip(self._used, self._sizes):
                    plain += [s << 4 | n] * (1 << (self.most - n))
                self._table = [plain[i] for i in _mirrors(self.most)]
            else:
                self._table = self.array().tolist()
        return self._table

    def next(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        found = (self._table or self.table())[bits.peek(self.most)]
        bits.at += found & 15
        return found >> 4


@cache
def _mirrored(n: int) -> np.ndarray:
    """The n-bit numbers with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


@cache
def _mirrors(n: int) -> list[int]:
    return _mirrored(n).tolist()


@lru_cache(1024)
def _simple_code(size: int, *symbols: int) -> Code:
    lengths = [0] * size
    for s in symbols:
        lengths[s] = 1
    return Code(lengths)


def _read_code(bits: Bits, size: int) -> Code:
    held = bits.peek(19)
    if held & 1:
        if held & 4:
            first, n = held >> 3 & 255, 11
        else:
            first, n = held >> 3 & 1, 4
        if held & 2:
            bits.read(n + 8)
            return _simple_code(size, first, held >> n & 255)
        bits.read(n)
        return _simple_code(size, first)
    lengths = [0] * size
    inner = [0] * 19
    n = 4 + (held >> 1 & 15)
    place = bits.at + 5
    held = int.from_bytes(bits.data[place >> 3 : (place >> 3) + 9], "little") >> (place & 7)
    for s in _ORDER[:n]:
        inner[s] = held & 7
        held >>= 3
    bits.at = place
    bits.read(3 * n)
    code = Code(inner)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    table, place = code.table(), bits.at
    mask = len(table) - 1
    held = have = 0
    while at < size and left:
        left -= 1
        if have < 14:  # a length takes 14 bits at most
            held = int.from_bytes(bits.data[place >> 3 : (place >> 3) + 8], "little") >> (place & 7)
            have = 64 - (place & 7)
        s = table[held & mask]
        n = s & 15
        s >>= 4
        held >>= n
        if s < 16:
            place += n
            have -= n
            lengths[at] = s
            at += 1
            if s:
                last = s
            continue
        if s == 16:
            value, times, more = last, 3 + (held & 3), 2
        elif s == 17:
            value, times, more = 0, 3 + (held & 7), 3
        else:
            value, times, more = 0, 11 + (held & 127), 7
        held >>= more
        place += n + more
        have -= n + more
        if at + times > size:
            raise ValueError("code lengths beyond the alphabet")
        if value:
            lengths[at : at + times] = [value] * times
        at += times
    bits.at = place
    bits.read(0)  # raises beyond the end
    return Code(lengths)


def _prefixed(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _back(value: int, width: int) -> int:
    """The pixels that a distance value goes back: the first 120 name near pixels."""
    if value > 120:
        return value - 120
    x, y = _NEAR[value - 1]
    return max(1, x + y * width)


#: Bytes of a stream whose bit positions are looked up at once: arrays of 8 bytes for each bit stay below the 128 KiB from
#: which the C library asks the system for new pages.
STRETCH = 1920


@lru_cache(8)
def _bit_places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For all bits of n bytes: their places, and their places in their byte."""
    places = np.arange(8 * n)
    return places, places & 7


#: By prefix code, of lengths or distance values: the extra bits and the least value.
_EXTRA = np.array([max(0, (c - 2) >> 1) for c in range(40)])
_LEAST = np.array([c + 1 if c < 4 else ((2 + (c & 1)) << ((c - 2) >> 1)) + 1 for c in range(40)])
_EXTRA_MASK = (1 << _EXTRA) - 1
#: By symbol of the green code: a literal takes no more bits than its code, a length its extra bits, marked by 64.
_LITERAL_HOP = np.concatenate([np.zeros(256, np.int64), 64 + _EXTRA[:24]])


@lru_cache(64)
def _nearest(width: int) -> np.ndarray:
    """The pixels that the first 120 distance values go back."""
    return np.array([0, *(_back(v, width) for v in range(1, 121))])


def _one_channel(bits: Bits, total: int, width: int, green: Code, distance: Code) -> np.ndarray:
    """The green values of an image whose other channels take no bits.

    The token that would begin at each bit of a stretch is looked up for all bits together; then the places where tokens
    do begin are followed from one to the next, by eights.
    """
    if green.single is not None:
        raise ValueError("a back-reference beyond the image")  # a lone literal was read before
    near, far = green.array(), distance.array()
    near_mask, far_mask = len(near) - 1, len(far) - 1
    # the bits from a token's beginning to the next token, or 64 more than to its distance's code, and from there to the next token
    near_hop, far_hop = (near & 15) + _LITERAL_HOP.take(near >> 4), (far & 15) + _EXTRA.take(far >> 4)
    begin, have, parts = bits.at, 0, []
    while have < total:
        byte = begin >> 3
        n = min(STRETCH, len(bits.data) - 8 - byte)
        if n <= 0:
            raise ValueError("the bit stream is cut short")
        end = 8 * n
        # a token takes 58 bits at most, so it ends within the 8 bytes after its stretch; zeros stand beyond the end
        words = np.ndarray((n + 8,), "<i8", bits.data[byte : byte + n + 16].ljust(n + 16, b"\0"), 0, (1,))
        places, in_byte = _bit_places(STRETCH + 8)
        ahead = words.repeat(8)
        ahead >>= in_byte[: len(ahead)]  # 57 bits
        hop = near_hop.take(ahead[:end] & near_mask)
        refs = (hop >= 64).nonzero()[0]
        after = places[: end + 64].copy()
        after[:end] += hop
        at = after.take(refs) - 64
        after[refs] = at + far_hop.take(ahead.take(at) & far_mask)
        two = after.take(after)
        four = two.take(two)
        jump = memoryview(four.take(four))
        steps, at = [], begin - 8 * byte
        while at < end:
            steps.append(at)
            at = jump[at]
        tokens = np.empty((len(steps), 8), np.int64)
        tokens[:, 0] = steps
        tokens[:, 4] = four.take(tokens[:, 0])
        tokens[:, 2::4] = two.take(tokens[:, ::4])
        tokens[:, 1::2] = after.take(tokens[:, ::2])
        tokens = tokens[tokens < end]
        found = near.take(ahead.take(tokens) & near_mask)
        symbol, gain, back = found >> 4, np.ones(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        rows = (symbol >= 256).nonzero()[0]
        found = found.take(rows)
        at, code = tokens.take(rows) + (found & 15), (found >> 4) - 256
        gain[rows] = _LEAST.take(code) + (ahead.take(at) & _EXTRA_MASK.take(code))
        at += _EXTRA.take(code)
        held = ahead.take(at)
        code = far.take(held & far_mask)
        held >>= code & 15
        code >>= 4
        back[rows] = _LEAST.take(code) + (held & _EXTRA_MASK.take(code))
        reached = gain.cumsum() + have
        used = int(reached.searchsorted(total)) + 1
        if used <= len(tokens):
            at = int(after[tokens[used - 1]])
            have = int(reached[used - 1])
            parts.append((symbol[:used], gain[:used], back[:used]))
        else:
            at = int(after[tokens[-1]])
            have = int(reached[-1])
            parts.append((symbol, gain, back))
        begin = 8 * byte + at
    bits.at = begin
    bits.read(0)  # raises beyond the end
    symbol, gain, back = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
    rows = back.nonzero()[0]
    value = back.take(rows)
    back[rows] = np.where(value > 120, value - 120, _nearest(width).take(np.minimum(value, 120)))
    first = gain.cumsum() - gain
    if have > total or (first < back).any():
        raise ValueError("a back-reference beyond the image")
    # every pixel takes what stands where it points, until all point at literals
    source = np.arange(total) - back.repeat(gain)
    while True:
        nearer = source.take(source)
        source = nearer.take(nearer)
        if (nearer == source).all():
            break
    return symbol.astype(np.uint8).repeat(gain).take(source)


def _image(bits: Bits, width: int, height: int, whole: bool) -> np.ndarray:
    """One entropy-coded image as an array of 32-bit ARGB values; only a whole image can have entropy groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, tile, which = 1, 0, None
    if whole and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width >> tile)
        which = (_image(bits, across, -(-height >> tile), False) >> 8) & 0xFFFF
        groups = int(which.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    green, red, blue, alpha, distance = codes[0]
    constant = red.single is not None and blue.single is not None and alpha.single is not None
    if groups == 1 and not cache_bits and constant:
        rest = (alpha.single << 24) | (red.single << 16) | blue.single
        if green.single is not None and green.single < 256:
            return np.full(total, rest | green.single << 8, np.uint32)
        if green.flat and green.symbols[-1] < 256:
            k = green.flat
            first, last = bits.at >> 3, (bits.at + total * k + 7) >> 3
            if last > len(bits.data) - 8:
                raise ValueError("the bit stream is cut short")
            raw = np.unpackbits(np.frombuffer(bits.data, np.uint8, last - first, first), bitorder="little")
            fields = raw[bits.at & 7 :][: total * k].reshape(total, k)
            value = np.packbits(fields, axis=1)[:, 0] >> (8 - k) if k <= 8 else fields @ (1 << np.arange(k - 1, -1, -1))
            bits.at += total * k
            return np.uint32(rest) | (green.symbols[value].astype(np.uint32) << np.uint32(8))
        return np.uint32(rest) | (_one_channel(bits, total, width, green, distance).astype(np.uint32) << np.uint32(8))
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    at = 0
    while at < total:
        if which is not None:
            green, red, blue, alpha, distance = codes[which[(at // width >> tile) * across + (at % width >> tile)]]
        s = green.next(bits)
        if s < 256:
            r = red.next(bits)
            b = blue.next(bits)
            made = [(alpha.next(bits) << 24) | (r << 16) | (s << 8) | b]
        elif s < 280:
            length = _prefixed(bits, s - 256)
            back = _back(_prefixed(bits, distance.next(bits)), width)
            if back > at or at + length > total:
                raise ValueError("a back-reference beyond the image")
            made = (out[at - back : at] * (length // back + 1))[:length]
        else:
            made = [cache[s - 280]]
        out[at : at + len(made)] = made
        at += len(made)
        if cache_bits:
            for v in made:
                cache[((_CACHE_FACTOR * v) & 0xFFFFFFFF) >> shift] = v
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(n,) values to (n, 4) signed channels in the order A, R, G, B."""
    return argb.astype(">u4").view(np.uint8).reshape(-1, 4).astype(np.int32)


def _values(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view(">u4").reshape(-1).astype(np.uint32)


def _guess(mode: int, left, top, top_left, top_right):
    """The predicted channels of one pixel."""
    half = lambda a, b: (a + b) >> 1
    if mode in (0, 14, 15):
        return np.array([255, 0, 0, 0])
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode < 11:
        return (half(half(left, top_right), top), half(left, top_left), half(left, top), half(top_left, top), half(top, top_right), half(half(left, top_left), half(top, top_right)))[mode - 5]
    if mode == 11:
        whole = left + top - top_left
        return left if np.abs(whole - left).sum() < np.abs(whole - top).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = half(left, top)
    return np.clip(mean + ((mean - top_left) / 2).astype(np.int32), 0, 255)


def _predicted(argb: np.ndarray, width: int, modes: np.ndarray, size_bits: int, sign: int) -> np.ndarray:
    """sign 1 adds the predictions to residuals, -1 takes them from pixels."""
    src = _channels(argb)
    pixels = src.copy()
    across = -(-width >> size_bits)
    for i in range(len(src)):
        y, x = divmod(i, width)
        if not i:
            guess = np.array([255, 0, 0, 0])
        elif not y:
            guess = pixels[i - 1]
        elif not x:
            guess = pixels[i - width]
        else:
            guess = _guess(int(modes[(y >> size_bits) * across + (x >> size_bits)] >> 8) & 15, pixels[i - 1], pixels[i - width], pixels[i - width - 1], pixels[i - width + 1])
        if sign > 0:
            pixels[i] = (src[i] + guess) & 255
        else:
            src[i] = (pixels[i] - guess) & 255
    return _values(pixels if sign > 0 else src)


def _crossed(argb: np.ndarray, width: int, factors: np.ndarray, size_bits: int, sign: int) -> np.ndarray:
    """sign 1 adds the colour deltas, -1 takes them away."""
    c = _channels(argb)
    at = np.arange(len(c))
    f = _channels(factors)[(at // width >> size_bits) * -(-width >> size_bits) + (at % width >> size_bits)]
    small = lambda v: ((v + 128) & 255) - 128
    delta = lambda t, v: (small(t) * small(v)) >> 5
    red, green, blue = c[:, 1], c[:, 2], c[:, 3]
    new_red = (red + sign * delta(f[:, 3], green)) & 255
    true_red = new_red if sign > 0 else red
    new_blue = (blue + sign * (delta(f[:, 2], green) + delta(f[:, 1], true_red))) & 255
    return _values(np.stack([c[:, 0], new_red, green, new_blue], 1))


def _green(argb: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(argb)
    c[:, 1] += sign * c[:, 2]
    c[:, 3] += sign * c[:, 2]
    return _values(c & 255)


def _bundle(colours: int) -> int:
    """log2 of the pixels that share one index byte."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _coloured(argb: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    share = _bundle(len(palette))
    index = (argb >> 8).astype(np.uint8).reshape(height, -(-width >> share))
    if share:
        each = 8 >> share
        index = ((index[:, :, None] >> (np.arange(1 << share) * each).astype(np.uint8)) & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full.take(index).reshape(-1)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The (height, width) ARGB pixels of the first image, and the bytes it takes."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP image")
    size, inner = struct.unpack("<I", data[4:8])[0], struct.unpack("<I", data[16:20])[0]
    bits = Bits(data[20 : 20 + inner])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo = []
    inner_width = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            tile = bits.read(3) + 2
            table = _image(bits, -(-inner_width >> tile), -(-height >> tile), False)
            undo.append((_predicted if kind == 0 else _crossed, (inner_width, table, tile, 1)))
        elif kind == 2:
            undo.append((_green, (1,)))
        else:
            colours = bits.read(8) + 1
            steps = _image(bits, colours, 1, False).astype("<u4").view(np.uint8).reshape(-1, 4)
            palette = steps.cumsum(0, np.uint8).view("<u4").reshape(-1)
            undo.append((_coloured, (inner_width, height, palette)))
            inner_width = -(-inner_width >> _bundle(colours))
    pixels = _image(bits, inner_width, height, True)
    for back, rest in reversed(undo):
        pixels = back(pixels, *rest)
    return pixels.reshape(height, width), 8 + size


class Writer:
    """Writes little-endian bit fields, all into one integer."""

    def __init__(self):
        self.held, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.held |= value << self.n
        self.n += n

    def array(self, bits: np.ndarray) -> None:
        self.put(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"), len(bits))

    def bytes(self) -> bytes:
        return self.held.to_bytes(-(-self.n // 8), "little")


def code_lengths(counts: list[int], most: int = 15) -> list[int]:
    """Lengths of an optimal prefix code; rare symbols count as more until no length is beyond ``most``."""
    floor = 1
    used = list(compress(range(len(counts)), counts))
    n = len(used)
    beyond = (sum(counts) + 1) << 15
    while True:
        heavy = counts if floor == 1 else [max(c, floor) for c in counts]
        order = sorted(used, key=heavy.__getitem__)
        # nodes by weight: the leaves, then the joined ones in the order they were made; one that is not there weighs most
        weight, sums = [heavy[s] for s in order], [beyond] * n
        weight.append(beyond)
        parent = [0] * (2 * n - 1)
        leaf = joined = 0
        for made in range(n - 1):
            node = n + made
            if weight[leaf] <= sums[joined]:
                total = weight[leaf]
                parent[leaf] = node
                leaf += 1
            else:
                total = sums[joined]
                parent[n + joined] = node
                joined += 1
            if weight[leaf] <= sums[joined]:
                total += weight[leaf]
                parent[leaf] = node
                leaf += 1
            else:
                total += sums[joined]
                parent[n + joined] = node
                joined += 1
            sums[made] = total
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth, default=0) <= most:
            lengths = [0] * len(counts)
            for s, d in zip(order, depth):
                lengths[s] = d or 1
            return lengths
        floor = 2 * floor + 1


def _canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (mirrored code, length); a lone symbol takes no bits."""
    used = list(compress(range(len(lengths)), lengths))
    if len(used) == 1:
        return {used[0]: (0, 0)}
    used.sort(key=lengths.__getitem__)
    out, code, last = {}, 0, 0
    for s in used:
        n = lengths[s]
        if n != last:
            code <<= n - last
            last, mirrored = n, _mirrors(n)
        out[s] = (mirrored[code], n)
        code += 1
    return out


def put_code(w: Writer, lengths: list[int]) -> None:
    used = list(compress(range(len(lengths)), lengths))
    if len(used) <= 2 and max(used) < 256:
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return
    tokens = []
    for value, run in groupby(lengths):
        left = len(list(run))
        if value:
            tokens.append((value, 0, 0))
            left -= 1
        while left:
            step = min(left, 6 if value else 138)
            if step < 3:
                tokens += [(value, 0, 0)] * step
            elif value:
                tokens.append((16, step - 3, 2))
            elif step < 11:
                tokens.append((17, step - 3, 3))
            else:
                tokens.append((18, step - 11, 7))
            left -= step
    counts = [0] * 19
    for t, _, _ in tokens:
        counts[t] += 1
    inner = code_lengths(counts, 7)
    n = max(i + 1 for i, s in enumerate(_ORDER) if inner[s] or i < 4)
    held, at = n - 4 << 1, 5
    for s in _ORDER[:n]:
        held |= inner[s] << at
        at += 3
    at += 1
    codes = _canonical(inner)
    for t, extra, k in tokens:
        code, size = codes[t]
        held |= (extra << size | code) << at
        at += size + k
    w.put(held, at)


@cache
def _flat_codes(k: int, most: int | None, alpha: int) -> tuple[int, int]:
    """The five codes of an image whose red and blue are 0: k bits for each green value, or one value without bits."""
    w = Writer()
    lengths = [0] * 280
    if most is not None:
        lengths[most] = 1
    else:
        lengths[: 1 << k] = [k] * (1 << k)
    put_code(w, lengths)
    for value in (0, 0, alpha):
        put_code(w, [int(i == value) for i in range(256)])
    put_code(w, [1] + [0] * 39)
    return w.held, w.n


@cache
def _lone_codes(*values: int) -> tuple[int, int]:
    """Codes of one symbol each."""
    w = Writer()
    for value in values:
        put_code(w, [int(i == value) for i in range(256)])
    return w.held, w.n


def put_flat_image(w: Writer, green: np.ndarray, whole: bool, alpha: int = 255) -> None:
    """An image whose red and blue are 0: every green value takes the bits of the largest."""
    w.put(0, 2 if whole else 1)
    most = int(green.max())
    k = max(1, most.bit_length())
    single = int(green.min()) == most
    w.put(*_flat_codes(k, most if single else None, alpha))
    if not single:
        w.array(np.unpackbits(green.astype(np.uint8)[:, None], axis=1)[:, 8 - k :].reshape(-1))


#: Matches are of this many pixels at least, and of 4,096 at most by the format.
MATCH, _LONGEST = 4, 4096


def _matches(green: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of the back-references: greedy, to the last place that began with the same pixels,
    going on while its neighbours' last places lie equally far back."""
    n = len(green) - MATCH + 1
    placed = np.ndarray((n,), "<u4", green.astype(np.uint8).tobytes(), 0, (1,)).astype(np.uint64)
    placed <<= np.uint64(32)
    placed |= np.arange(n, dtype=np.uint64)
    placed.sort()
    again = ((placed[1:] ^ placed[:-1]) <= 0xFFFFFFFF).nonzero()[0]
    order = (placed & np.uint64(0xFFFFFFFF)).view(np.int64)
    later = order[1:].take(again)
    back = np.zeros(n, np.int64)
    back[later] = later - order.take(again)
    # runs of neighbours whose last places lie equally far back, or that have none; the first has none
    changed = back[1:] != back[:-1]
    ends = _with(changed.nonzero()[0] + 1, n)
    if n > (most := _LONGEST - MATCH + 1):  # a run may be too long for one match
        sizes = np.diff(ends, prepend=0)
        within = np.arange(n) - (ends - sizes).repeat(sizes)
        changed |= ((within % most == 0) & (back > 0))[1:]
        ends = _with(changed.nonzero()[0] + 1, n)
    far, last = _with(back.take(ends - 1), 1), len(ends)
    run = np.zeros(n + MATCH, np.int64)
    np.cumsum(changed, out=run[1:n])
    run[n:] = last
    # the first match at or after each run's end, and its run; followed by fours
    stop = ends + (MATCH - 1)
    following = run.take(stop)
    without = far.take(following) == 0
    following += without
    place = np.where(without, ends.take(following - 1), stop)
    following = _with(following, last)
    two = following.take(following)
    jump = memoryview(two.take(two))
    fours, at = [], 1
    while at < last:
        fours.append(at)
        at = jump[at]
    steps = np.empty((len(fours), 4), np.int64)
    steps[:, 0] = fours
    steps[:, 2] = two.take(steps[:, 0])
    steps[:, 1::2] = following.take(steps[:, ::2])
    steps = steps[steps < last]
    starts = np.empty(len(steps), np.int64)
    starts[:1] = ends[0]
    starts[1:] = place.take(steps[:-1])
    return starts, stop.take(steps) - starts, far.take(steps)


def _with(values: np.ndarray, last: int) -> np.ndarray:
    """The values and one more."""
    out = np.empty(len(values) + 1, np.int64)
    out[:-1] = values
    out[-1] = last
    return out


#: Values whose prefix codes are looked up.
_LOOKED_UP = 1 << 14


def _prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = value - 1
    high = np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1
    extra = np.maximum(high - 1, 0)
    code = np.where(v < 2, v, 2 * high + ((v >> extra) & 1))
    return code, v & ((1 << extra) - 1), extra


@cache
def _prefixes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, held, extra = _prefix_of(np.arange(1, _LOOKED_UP + 1))
    return tuple(np.concatenate([[0], x]) for x in (code, held, extra))


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix codes, extra bits and their number, of lengths or distance values."""
    if not len(value) or value.max() > _LOOKED_UP:
        return _prefix_of(value)
    code, held, extra = _prefixes()
    return code.take(value), held.take(value), extra.take(value)


def _coded(counts: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Lengths of a prefix code, and by symbol 16 * bits + their number."""
    lengths = code_lengths(counts.tolist(), 11)
    both = [0] * len(lengths)
    for s, (code, n) in _canonical(lengths).items():
        both[s] = code << 4 | n
    return lengths, np.array(both, np.int64)


def put_image(w: Writer, green: np.ndarray) -> None:
    """A whole image whose red and blue are 0, with back-references; of codes of fixed length where those take no more bits."""
    flat = len(green) * max(1, int(green.max()).bit_length())
    if flat <= 512:  # the descriptions of the codes alone take about as many
        return put_flat_image(w, green, True)
    starts, lengths, distances = _matches(green)
    code, extra, n_extra = _prefix(lengths)
    far, far_extra, n_far = _prefix(distances + 120)
    symbol = green.astype(np.int64)
    symbol[starts] = 256 + code
    inside = np.zeros(len(green) + 1, np.int64)
    inside[starts + 1] += 1  # matches share no pixel, but one may begin where another ends
    inside[starts + lengths] -= 1
    kept = inside[:-1].cumsum() == 0
    kept[starts] = True
    symbol = symbol[kept]
    own, own_bits = _coded(np.bincount(symbol, minlength=280))
    far_lengths, far_bits = _coded(np.bincount(far, minlength=40)) if len(far) else ([1] + [0] * 39, None)
    # a token's code, and for a match the length's extra bits, the distance's code and its extra bits: 11 + 10 + 11 + 18 bits at most
    value = own_bits.take(symbol)
    size = value & 15
    value >>= 4
    if len(far):
        rows = (symbol >= 256).nonzero()[0]
        far_code = far_bits.take(far)
        held, more = value.take(rows), size.take(rows)
        held |= extra << more
        more += n_extra
        held |= far_code >> 4 << more
        more += far_code & 15
        held |= far_extra << more
        more += n_far
        value[rows], size[rows] = held, more
    head = Writer()
    head.put(0, 2)
    put_code(head, own)
    head.put(*_lone_codes(0, 0, 255))
    put_code(head, far_lengths)
    ends = size.cumsum()
    if head.n + int(ends[-1]) >= flat:
        return put_flat_image(w, green, True)
    w.put(head.held, head.n)
    # no two tokens share a bit, so sums put the tokens that begin in a word of 64 bits together; the last may reach into the next
    began = ends - size
    word, shift = began >> 6, began & 63
    lasts = _with((word[1:] != word[:-1]).nonzero()[0], len(word) - 1)
    words = np.zeros(int(ends[-1] >> 6) + 2, np.int64)
    word = word.take(lasts)
    words[word] = np.add.reduceat(value << shift, np.concatenate([[0], lasts[:-1] + 1]))
    words[word + 1] |= value.take(lasts) >> 1 >> (63 - shift.take(lasts))
    w.put(int.from_bytes(words.astype("<i8").tobytes(), "little"), int(ends[-1]))


def riff(w: Writer) -> bytes:
    body = w.bytes()
    padded = body + bytes(len(body) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded


def start(width: int, height: int) -> Writer:
    w = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    return w


def encode_samples(samples: np.ndarray) -> bytes:
    """(height, width) 8-bit samples as the green channel of a palette image."""
    height, width = samples.shape
    present = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256))
    w = start(width, height)
    w.put(1, 1)
    w.put(3, 2)
    w.put(len(present) - 1, 8)
    steps = present.copy()
    steps[1:] -= present[:-1]
    put_flat_image(w, steps, False, alpha=0)
    w.put(0, 1)
    place = np.zeros(256, np.uint8)
    place[present] = np.arange(len(present))
    index, share = np.frombuffer(samples.tobytes().translate(place.tobytes()), np.uint8).reshape(height, width), _bundle(len(present))
    if share:
        each = 8 >> share
        padded = np.zeros((height, -(-width >> share) << share), np.uint8)
        padded[:, :width] = index
        index = (padded.reshape(height, -1, 1 << share) << (np.arange(1 << share) * each).astype(np.uint8)).sum(2).astype(np.uint8)
    put_image(w, index.reshape(-1))
    return riff(w)


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as one image, or several beyond 64 x 16384 bytes."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(encode_samples(samples[i : i + SIDE]) for i in range(0, len(samples), SIDE))


def pixel_arrays(media: bytes) -> list[np.ndarray]:
    """The pixel arrays of all images of a stored form."""
    out, at = [], 0
    while at < len(media):
        pixels, size = decode(media[at:] if at else media)
        out.append(pixels)
        at += size
    return out


def samples_of(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([(a >> 8).astype(np.uint8).reshape(-1) for a in arrays])


def feature_text(samples: np.ndarray) -> str:
    """Rows, distinct samples, mean, deviation and the entropy of the samples in bits."""
    counts = np.bincount(samples, minlength=256)
    n = len(samples)
    mean = float(counts @ np.arange(256)) / n
    spread = float(counts @ (np.arange(256) - mean) ** 2) / n
    share = counts[counts > 0] / n
    return f"rows={n // WIDTH};levels={len(share)};mean={mean:.4f};sd={spread ** 0.5:.4f};bits={float(-(share * np.log2(share)).sum()):.4f}"


def media_column(df: DataFrame, key: str = "doc_id", text: str = "text", pixels: bool = False) -> DataFrame:
    """One row per input row: the key, n_bytes, the stored form (media) and what reading it back gives: payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, on request, samples (the pixel array's bytes).

    ``media`` is null unless ``pixels`` is asked for, so that the digest needs no bytes outside the task.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    own = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"))
    kind = own.schema["key"].dataType
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "samples"]
    types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                media = store(raw + bytes(-len(raw) % WIDTH if raw else WIDTH))
                samples = samples_of(pixel_arrays(media))
                back = samples.tobytes()
                rows.append((k, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(samples), media if pixels else None, back if pixels else None))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = f"key {kind.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, samples binary"
    return own.mapInArrow(run, schema).withColumnRenamed("key", key)
