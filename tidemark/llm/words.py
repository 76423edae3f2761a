"""Word splitting and block building on numpy arrays, for use inside Arrow workers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: A-Z become a-z, digits, a-z and every non-ASCII byte stay, all else separates.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, unchanged; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def count_words(texts: list[str | None]) -> int:
    """How many plain_words() they have."""
    data = np.frombuffer(" ".join(["", *[t for t in texts if t]]).encode("utf-8", "surrogatepass"), np.uint8)
    gap = (data == 32) | (data - np.uint8(9) < 5)
    return int(np.count_nonzero(gap[:-1] & ~gap[1:]))


def blocks(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[list[tuple]]:
    """Rows as tuples, the text last, in blocks of about `limit` characters (a longer text stands alone)."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            n = len(row[-1] or "")
            if rows and size + n > limit:
                yield rows
                rows, size = [], 0
            rows.append(row)
            size += n
    if rows:
        yield rows


class WordBlock:
    """The words of some texts end to end: `ids` numbers them by first sight, `terms` has the words by
    number, text i has words starts[i] to starts[i + 1], and `owner` has the text of each word."""

    def __init__(self, texts: Iterable[list[bytes]]):
        vocab: defaultdict = defaultdict()
        vocab.default_factory = vocab.__len__
        ids, counts = [], []
        for words in texts:
            ids.append(np.fromiter(map(vocab.__getitem__, words), np.int32, len(words)))
            counts.append(len(words))
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.counts = np.array(counts, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.terms = list(vocab)
        self.owner = np.repeat(np.arange(len(counts)), self.counts)

    def term_hashes(self, seed: int = 0) -> np.ndarray:
        """A stable 64-bit hash of each term."""
        import xxhash

        return np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in self.terms), np.uint64, len(self.terms))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """That of each word."""
        return self.term_hashes(seed)[self.ids]


class HashedWords:
    """The words of some texts end to end, as 128-bit hashes in two halves, name and check; starts, counts and owner
    as in WordBlock."""

    def __init__(self, texts: Iterable[list[bytes]]):
        import xxhash

        every = list(texts)
        self.counts = np.array([len(x) for x in every], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(every)), self.counts)
        halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(every))), ">u8").reshape(-1, 2)
        self.name, self.check = halves[:, 0].astype(np.uint64), halves[:, 1].astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` items, by its start; one that would pass the end is left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out + hashes[k : k + n] + np.uint64(k + 1))
    return out


def pack_varints(values: np.ndarray) -> bytes:
    """Seven bits to a byte, the high bit set on all but a number's last byte."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 9):
        sizes += values >= np.uint64(1 << (7 * k))
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        part = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[has] + k] = part.astype(np.uint8) | ((sizes[has] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def unpack_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, ends - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)
