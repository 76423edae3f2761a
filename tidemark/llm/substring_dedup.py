"""Repeated passages by recompression.

Rounds rename every document's word sequence: first maximal runs of one symbol, then pairs of a left and a right
symbol, where a symbol's side is a bit of its hash in that round. A name is a 128-bit hash of what it stands
for, so it is the same in all documents and equal passages get equal symbols but for a few at their edges. Each
symbol knows the stretch of words that determines it.

Spark exchanges symbols, by hash, between segments of the corpus:
1. High symbols (of 13 words and more, up to whole documents) that a document with a smaller id holds settle
   all windows within them: copies and long repeats.
2. Low symbols (of the second round) that no other document holds rule out every window that determines them.
3. Windows that are left are compared by their digests. The last pass over the texts gets two bits a word of what the
   one before found, so that it needs no symbols again.
A segment sends a symbol once, so a passage in a third of all documents costs a row a segment.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, few_records, partitions, save
from .words import HashedWords, blocks, count_words, mix, plain_words

WINDOW = 13
SEGMENT_CHARS = 3 << 20
#: Symbols and windows that meet in one task.
BUCKET_KEYS = 500_000
LOW, HIGH, MOST_ROUNDS = 2, (12, 16, 20, 26), 64
FAR = 1 << 40
HIGH_KIND, LOW_KIND, WINDOW_KIND, FOUND_KIND = 0, 1, 2, 3

SEGMENTS = "segment long, n_words long, doc_ids array<long>, texts array<string>"
SENT = "bucket int, segment long, kind int, keys binary, docs binary"
ANSWERS = "segment long, kind int, bucket int, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for n, rows in enumerate(blocks(batches, SEGMENT_CHARS)):
        words = count_words([r[1] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), pa.array([words]), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.string()))], names=["segment", "n_words", "doc_ids", "texts"])


class Symbols:
    """A level of the rename: parallel arrays by symbol. name and check: two 64-bit hashes; start, end: its
    words; left, right: the words that determine it, beyond reach where a document's edge would be needed."""

    def __init__(self, block: HashedWords):
        n = len(block.owner)
        self.name, self.check = block.name, block.check
        self.start = np.arange(n, dtype=np.int64)
        self.end = self.start + 1
        self.left, self.right = self.start.copy(), self.end.copy()
        self.doc = block.owner

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """left of the symbol before and right of the symbol after, within the document."""
        same = self.doc[1:] == self.doc[:-1]
        before = np.concatenate([[-FAR], np.where(same, self.left[:-1], -FAR)])
        after = np.concatenate([np.where(same, self.right[1:], FAR), [FAR]])
        return before, after

    def runs(self, seed: int) -> None:
        head = np.concatenate([[True], (self.name[1:] != self.name[:-1]) | (self.check[1:] != self.check[:-1]) | (self.doc[1:] != self.doc[:-1])])
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(head)) - 1
        size = (last - first + 1).astype(np.uint64)
        before, after = self._neighbours()
        self.left, self.right = np.minimum(before[first], self.left[first]), np.maximum(after[last], self.right[last])
        self.start, self.end, self.doc = self.start[first], self.end[last], self.doc[first]
        long = np.flatnonzero(size > 1)
        for key, odd in (("name", 3), ("check", 5)):
            own = getattr(self, key)[first]
            own[long] = mix(own[long] * np.uint64(odd) + mix(size[long] + np.uint64(seed)))
            setattr(self, key, own)

    def pairs(self, seed: int) -> None:
        right_side = (mix(self.name + np.uint64(seed)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(right_side), bool)
        joins[:-1] = ~right_side[:-1] & right_side[1:] & (self.doc[1:] == self.doc[:-1])
        joined = np.concatenate([[False], joins[:-1]])
        before, after = self._neighbours()
        alone = ~joins & ~joined
        left = np.where(alone & right_side, np.minimum(self.left, before), self.left)
        right = np.where(alone & ~right_side, np.maximum(self.right, after), self.right)
        i = np.flatnonzero(~joined)
        two = np.flatnonzero(joins[i])
        j = i[two] + 1
        end = self.end[i]
        end[two] = self.end[j]
        lower, upper = left[i], right[i]
        lower[two], upper[two] = np.minimum(lower[two], left[j]), np.maximum(upper[two], right[j])
        self.left, self.right = lower, upper
        self.start, self.end, self.doc = self.start[i], end, self.doc[i]
        for key, odd in (("name", 7), ("check", 9)):
            own = getattr(self, key)
            new = own[i]
            new[two] = mix(mix(new[two] * np.uint64(odd) + np.uint64(seed)) + own[j])
            setattr(self, key, new)


class Split:
    """A segment's words."""

    def __init__(self, doc_ids: list, texts: list):
        self.words = [plain_words(t) for t in texts]
        self.block = HashedWords(self.words)
        self.doc_ids = np.array([-1 if x is None else x for x in doc_ids], np.int64)
        self.known = np.array([x is not None for x in doc_ids], bool)

    def covered(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which positions lie in any of the ranges [lo, hi)."""
        n = len(self.block.owner)
        ok = hi > lo
        edge = np.bincount(np.clip(lo[ok], 0, n), minlength=n + 1) - np.bincount(np.clip(hi[ok], 0, n), minlength=n + 1)
        return np.cumsum(edge[:-1]) > 0


class Parsed(Split):
    """A segment's words, its high and low symbols, and its windows."""

    def __init__(self, doc_ids: list, texts: list):
        super().__init__(doc_ids, texts)
        block = self.block
        level = Symbols(block)
        high, self.low = [], None
        for r in range(1, MOST_ROUNDS + 1):
            if not len(level.doc):
                break
            level.runs(2 * r)
            level.pairs(2 * r + 1)
            whole = not (level.doc[1:] == level.doc[:-1]).any()
            if r == LOW:
                self.low = (level.name, level.left, level.right, level.doc)
            if r in HIGH or whole or r == MOST_ROUNDS:
                long = level.end - level.start >= WINDOW
                high.append((level.name[long], level.check[long], level.start[long], level.end[long], level.doc[long]))
            if whole:
                break
        if self.low is None:
            self.low = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        self.high = [np.concatenate(x) for x in zip(*high, strict=True)] if high else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
        self.windows = block.starts[1:] - block.starts[:-1] >= WINDOW
        # A position opens a window if the document goes on for 13 words and has an id.
        at = np.arange(len(block.owner))
        self.opens = (block.starts[block.owner + 1] - at >= WINDOW) & self.known[block.owner] if len(at) else np.zeros(0, bool)


class Sending:
    """The distinct keys of some occurrences in the order that they are sent: by name. For each,
    the least id of the documents that hold it here."""

    def __init__(self, name: np.ndarray, check: np.ndarray, docs: np.ndarray, buckets: int):
        order = np.argsort(name)
        n, c = name[order], check[order]
        head = np.ones(len(order), bool)
        head[1:] = (n[1:] != n[:-1]) | (c[1:] != c[:-1])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(head) - 1
        self.name, self.check = n[head], c[head]
        # Buckets are ranges of names, which are hashes: the order by name is that by bucket.
        self.bucket = ((self.name >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(head)
        self.least = np.minimum.reduceat(docs[order], first) if len(first) else docs
        self.several = np.maximum.reduceat(docs[order], first) != self.least if len(first) else head
        cuts = [*np.flatnonzero(np.diff(self.bucket, prepend=-1)).tolist(), len(self.bucket)]
        self.parts = list(zip(cuts[:-1], cuts[1:], strict=True))

    def rows(self, segment: int, kind: int) -> Iterator[tuple]:
        for a, b in self.parts:
            if kind == LOW_KIND:  # 47 bits of the name and whether several documents hold it: a filter only
                word = (self.name[a:b] >> np.uint64(17) << np.uint64(1)) | self.several[a:b].astype(np.uint64)
                keys, docs = word.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), b""
            else:
                keys = np.stack([self.name[a:b], self.check[a:b]], axis=1).tobytes()
                docs = self.least[a:b].tobytes()
            yield int(self.bucket[a]), segment, kind, keys, docs

    def answers(self, rows: list[dict], kind: int) -> np.ndarray:
        """The bits that came back, by key."""
        bits = {r["bucket"]: r["bits"] for r in rows if r["kind"] == kind}
        parts = [np.unpackbits(np.frombuffer(bits[int(self.bucket[a])], np.uint8), count=b - a) for a, b in self.parts]
        return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _high_and_low(p: Parsed, buckets: int) -> tuple[Sending, Sending, np.ndarray, np.ndarray]:
    own = p.known[p.high[4]]
    high = Sending(p.high[0][own], p.high[1][own], p.doc_ids[p.high[4][own]], buckets)
    name, left, right, doc = p.low
    use = (right - left <= WINDOW) & p.known[doc]
    low = Sending(name[use] >> np.uint64(17) << np.uint64(17), np.zeros(int(use.sum()), np.uint64), p.doc_ids[doc[use]], buckets)
    return high, low, own, use


def _open_windows(p: Parsed, buckets: int, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(settled, open): positions of windows that a smaller document holds, and of those still to compare."""
    high, low, own, use = _high_and_low(p, buckets)
    start, end, doc = (x[own] for x in p.high[2:])
    smaller = high.answers(answers, HIGH_KIND)[high.of] | (p.doc_ids[doc] > high.least[high.of])
    settled = p.covered(start[smaller], end[smaller] - WINDOW + 1) & p.opens
    shared = low.answers(answers, LOW_KIND)[low.of]
    alone_left, alone_right = p.low[1][use][~shared], p.low[2][use][~shared]
    ruled_out = p.covered(np.maximum(alone_right - WINDOW, 0), alone_left + 1)
    return np.flatnonzero(settled), np.flatnonzero(p.opens & ~settled & ~ruled_out)


def _windows(h: np.ndarray) -> np.ndarray:
    """The hash of the 13 words from each position on: of eight, four and one, each of two halves."""
    n = len(h) - WINDOW + 1

    def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b))

    two = both(h[:-1], h[1:])
    four = both(two[:-2], two[2:])
    eight = both(four[:-4], four[4:])
    return both(both(eight[:n], four[8 : 8 + n]), h[12 : 12 + n])


def _window_sending(p: Split, at: np.ndarray, buckets: int) -> Sending:
    name, check = (_windows(h)[at] if len(at) else np.zeros(0, np.uint64) for h in (p.block.name, p.block.check))
    return Sending(name, check, p.doc_ids[p.block.owner[at]], buckets)


def _found_row(segment: int, settled: np.ndarray, at: np.ndarray, n: int, buckets: int) -> tuple:
    """Which of a segment's n positions are settled and which open, for its next pass: a bit each."""
    bits = np.zeros((2, n), bool)
    bits[0, settled] = bits[1, at] = True
    bucket = int(mix(np.array([segment], np.uint64))[0] % np.uint64(buckets))
    return bucket, segment, FOUND_KIND, np.packbits(bits, axis=1).tobytes(), b""


def _found(answers: list[dict], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(settled, open) of _found_row()."""
    (bits,) = (r["bits"] for r in answers if r["kind"] == FOUND_KIND)
    both = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(2, -1), axis=1, count=n)
    return np.flatnonzero(both[0]), np.flatnonzero(both[1])


def _answered(table: pa.Table) -> pa.Table:
    """For each row of a bucket, a bit for each key: high symbols and windows that a smaller document of any
    segment holds; low symbols that several documents hold. What a segment found goes back to it."""
    out: list[tuple] = []
    rows = table.to_pylist()
    for kind in {r["kind"] for r in rows}:
        some = [r for r in rows if r["kind"] == kind]
        if kind == FOUND_KIND:
            out += [(r["segment"], kind, r["bucket"], r["keys"]) for r in some]
            continue
        if kind == LOW_KIND:
            raw = [np.frombuffer(r["keys"], np.uint8).reshape(-1, 6) for r in some]
            sizes = [len(x) for x in raw]
            wide = np.zeros((sum(sizes), 8), np.uint8)
            wide[:, :6] = np.concatenate(raw)
            word = wide.view("<u8").ravel()
            key, several = word >> np.uint64(1), (word & np.uint64(1)).astype(bool)
            _, of, n = np.unique(key, return_inverse=True, return_counts=True)
            many = n > 1
            np.logical_or.at(many, of[several], True)
            flag = many[of]
        else:
            keys = [np.frombuffer(r["keys"], np.uint64).reshape(-1, 2) for r in some]
            sizes = [len(x) for x in keys]
            both, docs = np.concatenate(keys), np.concatenate([np.frombuffer(r["docs"], np.int64) for r in some])
            order = np.lexsort((both[:, 1], both[:, 0]))
            x = both[order]
            head = np.ones(len(order), bool)
            head[1:] = (x[1:] != x[:-1]).any(axis=1)
            least = np.minimum.reduceat(docs[order], np.flatnonzero(head))[np.cumsum(head) - 1]
            flag = np.empty(len(order), bool)
            flag[order] = least < docs[order]
        for r, part in zip(some, np.split(flag, np.cumsum(sizes)[:-1]), strict=True):
            out.append((r["segment"], kind, r["bucket"], np.packbits(part).tobytes()))
    cols = list(zip(*out, strict=True))
    return pa.table({"segment": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.int32()), "bucket": pa.array(cols[2], pa.int32()), "bits": pa.array(cols[3], pa.binary())})


def _sent_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["bucket", "segment", "kind", "keys", "docs"])


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _segment_table(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """The corpus as segments in a table bucketed by segment, in the session's warehouse, so that texts are
    never shuffled: only answers move to them."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(_segments, SEGMENTS).write.option("compression", "zstd").bucketBy(partitions(spark), "segment").saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT, a row per input row: words covered by 13-word windows whose words also start in a document with a
    smaller id are removed, judged on the input. A null text has no words; a document without an id neither
    loses words nor counts as a source; rows with the same id are no sources for each other. The result is a written
    table; the table of segments is dropped, however the run ends."""
    spark = docs.sparkSession
    bounded_batches(spark)
    name = f"tidemark_segments_{uuid.uuid4().hex}"
    try:
        with few_records(spark, 200):
            return _repeats_removed(_segment_table(docs, id_col, text_col, name))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _repeats_removed(segments: DataFrame) -> DataFrame:
    total = segments.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(64, total // (2 * BUCKET_KEYS))

    def symbols(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            high, low, _, _ = _high_and_low(Parsed(r["doc_ids"], r["texts"]), buckets)
            yield _sent_batch([*high.rows(r["segment"], HIGH_KIND), *low.rows(r["segment"], LOW_KIND)])

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            p = Parsed(r["doc_ids"], r["texts"])
            settled, at = _open_windows(p, buckets, r["answers"] or [])
            found = _found_row(r["segment"], settled, at, len(p.block.owner), buckets)
            yield _sent_batch([found, *_window_sending(p, at, buckets).rows(r["segment"], WINDOW_KIND)])

    def removed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            p = Split(r["doc_ids"], r["texts"])
            settled, at = _found(r["answers"], len(p.block.owner))
            sent = _window_sending(p, at, buckets)
            again = sent.answers(r["answers"], WINDOW_KIND)[sent.of] | (p.doc_ids[p.block.owner[at]] > sent.least[sent.of])
            start = np.concatenate([settled, at[again]])
            gone = p.covered(start, start + WINDOW)
            out = []
            for i, words in enumerate(p.words):
                mask = gone[p.block.starts[i] : p.block.starts[i + 1]]
                kept = [w for w, g in zip(words, mask.tolist(), strict=True) if not g] if mask.any() else words
                out.append((r["doc_ids"][i], len(words), int(mask.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3])], names=[x.split()[0] for x in RESULT.split(", ")])

    def with_answers(answers: DataFrame) -> DataFrame:
        own = answers.groupBy("segment").agg(F.collect_list(F.struct("kind", "bucket", "bits")).alias("answers"))
        return segments.join(own.hint("shuffle_hash"), "segment", "left").select("segment", "doc_ids", "texts", "answers")

    first = save(segments.select("segment", "doc_ids", "texts").mapInArrow(symbols, SENT).groupBy("bucket").applyInArrow(_answered, ANSWERS), "symbol-answers")
    second = save(with_answers(first).mapInArrow(windows, SENT).groupBy("bucket").applyInArrow(_answered, ANSWERS), "window-answers")
    return save(with_answers(second).mapInArrow(removed, RESULT), "repeats-removed")
