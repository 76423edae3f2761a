"""Codecs for the values and times of chunks: bytes and back, without loss.

Chunks lie end to end: chunk i has values starts[i] to starts[i + 1], and its bytes are ends[i] to ends[i + 1] of one
buffer. All chunks are coded in the same array operations, as a call for each chunk would cost more than its values.

chimp: XOR of neighbours with classes of leading zeros. alp: decimal integers in as many bits as they need, and
exceptions. delta: zlib over the differences of the bits. raw: the bits. times: differences of differences as varints.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The classes of leading zeros that the chimp format names in three bits.
LEADING = (0, 8, 12, 16, 18, 20, 22, 24)
#: A gain in trailing zeros must pay for the length that it takes to write.
TRAILING = 6
#: Powers of ten that alp tries.
POWERS = 18
TENS = np.array([10.0**p for p in range(POWERS + 1)])
ALP_HEADER = np.dtype([("n", "<u4"), ("power", "u1"), ("width", "u1"), ("least", "<i8"), ("m", "<u4")])
#: Chunks of more values are decoded from chimp one by one, as they share too few steps with others.
SHARED_STEPS = 64
#: Bits 0 to 7 of a byte in the other order.
MIRROR = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8)[:, ::-1], axis=1).ravel()

Coded = tuple[np.ndarray, np.ndarray]


def _bits(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, "<f8").view("<u8")


def _u(n: int) -> np.uint64:
    return np.uint64(n)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _inner(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value, its chunk and its place there."""
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return of, np.arange(len(of)) - starts[of]


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each chunk."""
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    return total[starts[1:]] - total[starts[:-1]]


def _steps(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of neighbours; the first of a chunk stays."""
    out = x.copy()
    out[1:] -= x[:-1]
    first = starts[:-1][np.diff(starts) > 0]
    out[first] = x[first]
    return out


def _climbed(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Their sums again; both wrap around."""
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    return total[1:] - np.repeat(total[starts[:-1]], np.diff(starts))


def _written(n_bytes: int, at: np.ndarray, size: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Bytes with each value in `size` (up to 64) bits from bit `at` on, the highest first; none overlap."""
    some = size > 0
    at, size, value = at[some].astype(np.int64), size[some].astype(np.uint64), value[some]
    words = np.zeros(n_bytes // 8 + 2, np.uint64)
    word, skip = at >> 6, (at & 63).astype(np.uint64)
    top = value << (_u(64) - size)
    np.add.at(words, word, top >> skip)
    np.add.at(words, word + 1, (top << (_u(63) - skip)) << _u(1))
    return words.astype(">u8").view(np.uint8)[:n_bytes]


def _words(data: np.ndarray) -> np.ndarray:
    """Bytes as 64-bit numbers for _read, with room behind."""
    return np.concatenate([data, np.zeros(24 - len(data) % 8, np.uint8)]).view(">u8").astype(np.uint64)


def _read(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    word, skip = at >> 6, (at & 63).astype(np.uint64)
    top = (words[word] << skip) | ((words[word + 1] >> (_u(63) - skip)) >> _u(1))
    return np.where(size > 0, top >> (64 - np.maximum(size, 1)).astype(np.uint64), _u(0))


def _mirrored(x: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The lowest `width` bits in the other order."""
    turned = MIRROR[x.astype(">u8").view(np.uint8)].view("<u8")
    return np.where(width > 0, turned >> (64 - np.maximum(width, 1)).astype(np.uint64), _u(0))


def _length(x: np.ndarray) -> np.ndarray:
    """Bits up to the highest set one. The bit below it is cleared, so that no rounding lifts it."""
    return np.frexp((x & ~(x >> _u(1))).astype(np.float64))[1].astype(np.int64)


def _copied(out: np.ndarray, at: np.ndarray, items: np.ndarray) -> None:
    """Fixed-size items into the buffer, from byte `at` on each."""
    size = items.dtype.itemsize
    out[at[:, None] + np.arange(size)] = np.ascontiguousarray(items).view(np.uint8).reshape(-1, size)


def _found(data: np.ndarray, at: np.ndarray, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(data[at[:, None] + np.arange(dtype.itemsize)]).view(dtype).ravel()


def chimp_chunks(values: np.ndarray, starts: np.ndarray) -> Coded:
    b, n = _bits(values), np.diff(starts)
    if not len(b):
        return np.zeros(0, np.uint8), np.zeros(len(starts), np.int64)
    of, place = _inner(starts)
    first = place == 0
    x = np.where(first, _u(0), b ^ np.roll(b, 1))
    zeros, tail = 64 - _length(x), _length(x & (~x + _u(1))) - 1
    k = np.searchsorted(LEADING, zeros, side="right") - 1
    some = x != 0
    cut = some & (tail > TRAILING)
    lead = np.where(some & ~cut, k, -1)
    before = np.roll(lead, 1)
    before[first] = -1
    again = (lead >= 0) & (lead == before)
    fresh = (lead >= 0) & ~again
    rest = 64 - np.array(LEADING)[k]
    size = np.where(cut, rest - tail, 0)
    head = np.select([cut, again, fresh], [(1 << 9) | (k << 6) | (size - 1), 2, (3 << 3) | k], 0).astype(np.uint64)
    head_size = np.where(first, 0, np.select([cut, fresh], [11, 5], 2))
    body = np.where(first, b, np.where(cut, x >> np.maximum(tail, 0).astype(np.uint64), x))
    body_size = np.select([first, cut, some], [64, size, rest], 0)
    bits = _sums(head_size + body_size, starts)
    ends = _ends(np.where(n > 0, 4 + (bits + 8) // 8, 0))
    full = n > 0
    # The count in four bytes, then a set bit after as many clear ones as fill its byte, then the values.
    at = 8 * ends[1:][of] - bits[of] + _climbed(head_size + body_size, starts) - head_size - body_size
    counts = n[full].astype("<u4").byteswap().view("<u4").astype(np.uint64)
    every = [(8 * ends[:-1][full], np.full(int(full.sum()), 32), counts), (8 * ends[1:][full] - bits[full] - 1, np.ones(int(full.sum()), np.int64), np.ones(int(full.sum()), np.uint64)), (at, head_size, head), (at + head_size, body_size, body)]
    return _written(int(ends[-1]), *[np.concatenate(c) for c in zip(*every, strict=True)]), ends


def chimp_unchunked(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(np.diff(ends) > 0)
    n = _found(data, ends[full], "<u4").astype(np.int64)
    starts = _ends(n)
    out = np.zeros(int(starts[-1]), np.uint64)
    for i in np.flatnonzero(n > SHARED_STEPS).tolist():
        out[starts[i] : starts[i + 1]] = _bits(_chimp_decoded(data[ends[full[i]] : ends[full[i] + 1]].tobytes()))
    go = np.flatnonzero(n <= SHARED_STEPS)
    words, leading = _words(data), np.array(LEADING)
    at = 8 * ends[full[go]] + 32
    at += 9 - _length(data[at >> 3].astype(np.uint64))
    last, lead = _read(words, at, np.full(len(at), 64)), np.zeros(len(at), np.int64)
    out[starts[go]] = last
    at = at + 64
    for step in range(1, SHARED_STEPS):
        on = n[go] > step
        go, at, last, lead = go[on], at[on], last[on], lead[on]
        if not len(go):
            break
        head = _read(words, at, np.full(len(at), 11)).astype(np.int64)
        kind = head >> 9
        lead = np.where(kind & 1, leading[(head >> 6) & 7], lead)
        size = np.select([kind == 0, kind == 1], [0, (head & 63) + 1], 64 - lead)
        shift = np.where(kind == 1, 64 - lead - size, 0)
        at = at + np.array([2, 11, 2, 5])[kind]
        last = last ^ (_read(words, at, size) << shift.astype(np.uint64))
        at = at + size
        out[starts[go] + step] = last
    return out.view("<f8")


def _chimp_decoded(data: bytes) -> np.ndarray:
    """One chunk, value by value."""
    (n,), bits = struct.unpack_from("<I", data), bin(int.from_bytes(data[4:], "big"))[3:]
    out, at, lead = [int(bits[:64], 2)], 64, 0
    while len(out) < n:
        kind, at = bits[at : at + 2], at + 2
        tail, size = 0, 0
        if kind in ("01", "11"):
            lead, at = LEADING[int(bits[at : at + 3], 2)], at + 3
        if kind == "01":
            size, at = int(bits[at : at + 6], 2) + 1, at + 6
            tail = 64 - lead - size
        elif kind != "00":
            size = 64 - lead
        x = int(bits[at : at + size], 2) << tail if size else 0
        at += size
        out.append(out[-1] ^ x)
    return np.array(out, "<u8").view("<f8")


def _exact(values: np.ndarray, tens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values times powers of ten as whole numbers, and which of them give back every bit."""
    with np.errstate(all="ignore"):
        near = np.rint(values * tens)
        fits = np.abs(near) < 2.0**52
        whole = np.where(fits, near, 0).astype(np.int64)
        return whole, fits & (_bits(whole / tens) == _bits(values))


def _alp_powers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each chunk, the least power of ten that leaves the fewest exceptions."""
    best, fewest = np.zeros(len(starts) - 1, np.int64), np.diff(starts) + 1
    for p, tens in enumerate(TENS):
        n = _sums((~_exact(values, tens)[1]).astype(np.int64), starts)
        best, fewest = np.where(n < fewest, p, best), np.minimum(n, fewest)
    return best


def alp_chunks(values: np.ndarray, starts: np.ndarray) -> Coded:
    v, n = np.ascontiguousarray(values, "<f8"), np.diff(starts)
    if not len(v):
        return np.zeros(0, np.uint8), np.zeros(len(starts), np.int64)
    of, place = _inner(starts)
    power, full = _alp_powers(v, starts), n > 0
    whole, ok = _exact(v, TENS[power][of])
    most = np.int64(1) << 53
    least, width = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    least[full] = np.minimum.reduceat(np.where(ok, whole, most), starts[:-1][full])
    least[least == most] = 0
    offsets = np.where(ok, whole - least[of], 0).astype(np.uint64)
    width[full] = _length(np.maximum.reduceat(offsets, starts[:-1][full]))
    m = _sums((~ok).astype(np.int64), starts)
    head = ALP_HEADER.itemsize
    ends = _ends(np.where(full, head + 12 * m + (n * width + 7) // 8, 0))
    at = ends[:-1] + head + 12 * m
    out = _written(int(ends[-1]), 8 * at[of] + place * width[of], width[of], _mirrored(offsets, width[of]))
    header = np.zeros(len(n), ALP_HEADER)
    for name, x in (("n", n), ("power", power), ("width", width), ("least", least), ("m", m)):
        header[name] = x
    _copied(out, ends[:-1][full], header[full])
    odd = np.flatnonzero(~ok)
    chunk, rank = of[odd], _climbed((~ok).astype(np.int64), starts)[odd] - 1
    _copied(out, ends[chunk] + head + 4 * rank, place[odd].astype("<u4"))
    _copied(out, ends[chunk] + head + 4 * m[chunk] + 8 * rank, v[odd])
    return out, ends


def alp_unchunked(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    begin = ends[:-1][np.diff(ends) > 0]
    header = _found(data, begin, ALP_HEADER)
    n, power, width, least, m = (header[c].astype(np.int64) for c in ALP_HEADER.names)
    starts, head = _ends(n), ALP_HEADER.itemsize
    of, place = _inner(starts)
    at = 8 * (begin + head + 12 * m)[of] + place * width[of]
    offsets = _mirrored(_read(_words(data), at, width[of]), width[of])
    out = (offsets.astype(np.int64) + least[of]) / TENS[power][of]
    chunk, rank = _inner(_ends(m))
    out[starts[chunk] + _found(data, begin[chunk] + head + 4 * rank, "<u4")] = _found(data, begin[chunk] + head + 4 * m[chunk] + 8 * rank, "<f8")
    return out


def delta_chunks(values: np.ndarray, starts: np.ndarray) -> Coded:
    steps = memoryview(_steps(_bits(values).view("<i8"), starts).tobytes())
    cuts = (8 * starts).tolist()
    parts = [zlib.compress(steps[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.frombuffer(b"".join(parts), np.uint8), _ends(np.array([len(x) for x in parts], np.int64))


def delta_unchunked(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw, cuts = memoryview(data.tobytes()), ends.tolist()
    parts = [zlib.decompress(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    steps = np.frombuffer(b"".join(parts), "<i8")
    return _climbed(steps, _ends(np.array([len(x) // 8 for x in parts], np.int64))).view("<f8")


def raw_chunks(values: np.ndarray, starts: np.ndarray) -> Coded:
    return _bits(values).view(np.uint8), 8 * starts


def raw_unchunked(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes(), "<f8")


#: By name: chunks to bytes, and bytes to the values of all chunks.
CHUNKED = {"alp": (alp_chunks, alp_unchunked), "chimp": (chimp_chunks, chimp_unchunked), "delta": (delta_chunks, delta_unchunked), "raw": (raw_chunks, raw_unchunked)}


def times_chunks(us: np.ndarray, starts: np.ndarray) -> Coded:
    """The first time, then the differences of differences, zigzag and seven bits to a byte."""
    d = _steps(_steps(np.asarray(us, np.int64), starts), starts)
    z = ((d << 1) ^ (d >> 63)).view(np.uint64)
    sizes = np.maximum((_length(z) + 6) // 7, 1)
    at = _ends(sizes)
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        more = np.where(sizes[has] > k + 1, 128, 0)
        out[at[:-1][has] + k] = ((z[has] >> _u(7 * k)) & _u(127)).astype(np.uint8) | more.astype(np.uint8)
    return out, at[starts]


def times_unchunked(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    stop = data < 128
    starts = np.concatenate([[0], np.cumsum(stop)])[ends]
    first = np.concatenate([[0], np.flatnonzero(stop)[:-1] + 1])
    _, place = _inner(np.append(first, len(data)))
    z = np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)
    d = (z >> _u(1)).astype(np.int64) ^ -(z & _u(1)).astype(np.int64)
    return _climbed(_climbed(d, starts), starts)


def _one(chunks, unchunked):
    """Both ways for a single chunk."""

    def encode(values: np.ndarray) -> bytes:
        return chunks(np.asarray(values), np.array([0, len(values)]))[0].tobytes()

    def decode(data: bytes) -> np.ndarray:
        return unchunked(np.frombuffer(data, np.uint8), np.array([0, len(data)]))

    return encode, decode


CODECS = {name: _one(*both) for name, both in CHUNKED.items()}
chimp_encode, chimp_decode = CODECS["chimp"]
times_encode, times_decode = _one(times_chunks, times_unchunked)


def best(values: np.ndarray) -> tuple[str, bytes]:
    """The codec with the fewest bytes, and they; the first by name of several."""
    return min(((k, enc(values)) for k, (enc, _) in sorted(CODECS.items())), key=lambda x: len(x[1]))
