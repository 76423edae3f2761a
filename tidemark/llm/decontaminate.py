"""Benchmark decontamination with a positional inverted index.

The index is cut by document, as search engines cut theirs: a row is a segment of a bounded number of words
with its terms and, by term, the delta-coded positions. Segments are built and searched where their
documents lie, so no posting is shuffled and a hot source or term only adds to its own segments. Benchmark windows
are filed under their rarest term in the benchmark, so a segment looks only at windows whose rarest term it holds;
of these it intersects the position lists of the terms, moved by their offset in the window, from the one that is
rarest in the segment on.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ROW_KEY, bounded_batches, row_key, save, temporary
from .words import WordBlock, blocks, folded_words, pack_varints, unpack_varints

WINDOW = 13
#: Share of hit words from which a document counts as contaminated: 1 in 20.
ONE_IN = 20
#: Windows of the benchmark, of about 100 bytes, that one pass sends to the executors; a larger one is searched block by block.
BLOCK_WINDOWS = 500_000
SEGMENT_CHARS = 4 << 20

INDEX = "segment long, doc_ids array<long>, doc_keys array<binary>, doc_words array<long>, terms array<binary>, freqs array<int>, postings binary"
FOUND = "doc_id long, row_key binary, segment long, ordinal int, n_words long, hits binary, items array<string>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all documents. Null texts have no words; repeated rows are indexed each."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return save(rows.mapInArrow(_segments, INDEX), "postings")


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_keys", pa.list_(pa.binary())), ("doc_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("freqs", pa.list_(pa.int32())), ("postings", pa.binary())])
    for n, rows in enumerate(blocks(batches, SEGMENT_CHARS)):
        block = WordBlock(folded_words(r[-1]) for r in rows)
        order = np.argsort(block.ids, kind="stable")
        freqs = np.bincount(block.ids, minlength=len(block.terms)).astype(np.int32)
        gaps = np.diff(order, prepend=0)
        first = np.cumsum(freqs) - freqs
        gaps[first] = order[first]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([(part << 32) + n, [r[0] for r in rows], [r[1] for r in rows], block.counts.tolist(), block.terms, freqs.tolist(), pack_varints(gaps)], schema.types, strict=True)], schema=schema)


class Windows:
    """The distinct windows of some benchmark items as arrays: terms has a row of term numbers a window, padded with
    -1; filed[filed_at[t] : filed_at[t + 1]] are the windows whose rarest term in the benchmark is t; the names of
    window w's items are names[item_of[item_at[w] : item_at[w + 1]]]."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], width: int = WINDOW):
        vocab: dict[bytes, int] = {}
        rows, owners, names = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)], []
        uses = np.zeros(0, np.int64)
        for item, words in items:
            ids = np.array([vocab.setdefault(w, len(vocab)) for w in words], np.int32)
            if not len(ids):
                continue
            uses = np.bincount(ids, minlength=len(vocab)) + np.pad(uses, (0, len(vocab) - len(uses)))
            own = np.lib.stride_tricks.sliding_window_view(ids, width) if len(ids) >= width else np.pad(ids, (0, width - len(ids)), constant_values=-1)[None, :]
            rows.append(own)
            owners.append(np.full(len(own), len(names) if item is not None else -1))
            names += [] if item is None else [item]
        self.words = list(vocab)
        self.names = names
        self.terms, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.terms >= 0).sum(axis=1)
        pairs = np.unique(np.stack([of.ravel(), np.concatenate(owners)], axis=1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        self.item_of, self.item_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))
        cost = np.where(self.terms >= 0, np.append(uses, 0)[self.terms], np.iinfo(np.int64).max)
        rarest = self.terms[np.arange(len(self.terms)), cost.argmin(axis=1)] if len(self.terms) else np.zeros(0, np.int32)
        self.filed = np.argsort(rarest, kind="stable")
        self.filed_at = np.searchsorted(rarest[self.filed], np.arange(len(self.words) + 1))

    def items(self, window: int) -> list[str]:
        return [self.names[k] for k in self.item_of[self.item_at[window] : self.item_at[window + 1]].tolist()]

    def under(self, terms: np.ndarray) -> np.ndarray:
        """The windows that are filed under the terms."""
        return self.filed[_ranges(self.filed_at[terms], self.filed_at[terms + 1] - self.filed_at[terms])]


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., sizes[0] of them, then those from first[1] on, and so forth."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


class Segment:
    """A segment as a search sees it: the position lists of the terms that the benchmark has, end to end by term
    (term t's are positions[first[t] : first[t] + freq[t]]), and term * size + position of each in order."""

    def __init__(self, row: dict, vocab: dict[bytes, int]):
        self.counts = np.array(row["doc_words"], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.size = int(self.counts.sum())
        freqs = np.array(row["freqs"], np.int64)
        gaps = unpack_varints(row["postings"])
        first = np.cumsum(freqs) - freqs
        run = np.cumsum(gaps)
        positions = run - np.repeat(run[first] - gaps[first], freqs) if self.size else gaps
        known = np.fromiter((vocab.get(t, -1) for t in row["terms"]), np.int64, len(freqs))
        has = np.flatnonzero(known >= 0)
        has = has[np.argsort(known[has])]
        self.terms, sizes = known[has], freqs[has]
        self.positions = positions[_ranges(first[has], sizes)] if len(has) else np.zeros(0, np.int64)
        self.freq, self.first = np.zeros(len(vocab) + 1, np.int64), np.zeros(len(vocab) + 1, np.int64)
        self.freq[self.terms], self.first[self.terms] = sizes, np.cumsum(sizes) - sizes
        self.placed = np.repeat(self.terms, sizes) * self.size + self.positions
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in its term's list."""
        wanted = term * self.size + position
        at = np.searchsorted(self.placed, wanted)
        return self.placed[np.minimum(at, len(self.placed) - 1)] == wanted


def phrase_starts(seg: Segment, win: Windows, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, positions): every occurrence of every window within one document of the segment."""
    near = win.under(seg.terms)
    for some in np.array_split(near, max(1, len(near) * WINDOW // chunk)):
        freq = np.where(win.terms[some] >= 0, seg.freq[win.terms[some]], np.iinfo(np.int64).max)
        alive = np.flatnonzero(freq.min(axis=1, initial=np.iinfo(np.int64).max) > 0)
        if not len(alive):
            continue
        some, freq = some[alive], freq[alive]
        rarest = np.argsort(freq, axis=1, kind="stable")
        load = freq[np.arange(len(some)), rarest[:, 0]]
        cuts = np.flatnonzero(np.diff(np.cumsum(load) // chunk, prepend=0))
        for part in np.split(np.arange(len(some)), cuts):
            if len(part):
                yield _intersected(seg, win, some[part], rarest[part], load[part])


def _intersected(seg: Segment, win: Windows, w: np.ndarray, order: np.ndarray, load: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    anchor = win.terms[w, order[:, 0]]
    of = np.repeat(np.arange(len(w)), load)
    start = seg.positions[_ranges(seg.first[anchor], load)] - order[of, 0]
    fits = (start >= 0) & (start + win.lengths[w][of] <= seg.size)
    of, start = of[fits], start[fits]
    for k in range(1, order.shape[1]):
        offset = order[of, k]
        term = win.terms[w[of], offset].astype(np.int64)
        same = term < 0
        same[~same] = seg.holds(term[~same], (start + offset)[~same])
        of, start = of[same], start[same]
    one = seg.owner[start] == seg.owner[start + win.lengths[w][of] - 1]
    return w[of[one]], start[one]


def near_docs(seg: Segment, win: Windows, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, positions of their rarest term): where each other term stands within `slop` words of it in
    the same document, in any order."""
    for w in win.under(seg.terms).tolist():
        terms = np.unique(win.terms[w, : win.lengths[w]])
        terms = terms[np.argsort(seg.freq[terms], kind="stable")]
        at = seg.positions[seg.first[terms[0]] :][: seg.freq[terms[0]]]
        for t in terms[1:]:
            own = seg.positions[seg.first[t] :][: seg.freq[t]]
            lo = np.maximum(at - slop, seg.starts[seg.owner[at]])
            hi = np.minimum(at + slop, seg.starts[seg.owner[at]] + seg.counts[seg.owner[at]] - 1)
            at = at[np.searchsorted(own, hi, "right") > np.searchsorted(own, lo, "left")]
        if len(at):
            yield np.full(len(at), w), at


def _benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Windows]:
    """The benchmark's windows in blocks of a bounded number, at least one block; an item beyond it is cut into
    pieces that overlap by a window less a word. The driver holds a block at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    block: list[tuple[str | None, list[bytes]]] = []
    n, none = 0, True
    for r in items.toLocalIterator():
        words = folded_words(r.text)
        for a in range(0, max(1, len(words) - WINDOW + 1), BLOCK_WINDOWS):
            block.append((r.item, words[a : a + BLOCK_WINDOWS + WINDOW - 1]))
            n += min(BLOCK_WINDOWS, max(1, len(words) - WINDOW + 1 - a))
            if n >= BLOCK_WINDOWS:
                yield Windows(block)
                block, n, none = [], 0, False
    if block or none:
        yield Windows(block)


def _search(index: DataFrame, shared, slop: int | None) -> DataFrame:
    names = [x.split()[0] for x in FOUND.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.string())], strict=True)))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = shared.value
        vocab = {w: i for i, w in enumerate(win.words)}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                seg = Segment(row, vocab)
                edge = np.zeros(seg.size + 1, np.int64)
                of_doc: dict[int, set[str]] = {}
                for w, at in phrase_starts(seg, win) if slop is None else near_docs(seg, win, slop):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + (win.lengths[w] if slop is None else 1), -1)
                    for d, x in set(zip(seg.owner[at].tolist(), w.tolist(), strict=True)):
                        of_doc.setdefault(d, set()).update(win.items(x))
                hit = np.cumsum(edge[:-1]) > 0
                n = len(seg.counts)
                bits = [np.packbits(hit[a : a + c]).tobytes() if d in of_doc else b"" for d, (a, c) in enumerate(zip(seg.starts.tolist(), seg.counts.tolist(), strict=True))]
                out = [row["doc_ids"], row["doc_keys"], [row["segment"]] * n, list(range(n)), row["doc_words"], bits, [sorted(of_doc.get(d, ())) for d in range(n)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types, strict=True)], schema=schema)

    return index.mapInArrow(search, FOUND)


def matches(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", slop: int | None = None) -> DataFrame:
    """One row per indexed document: doc_id, row_key, n_words, hits (a bit per word), items (ids of the items
    found, as strings). slop None: exact phrases of 13 words. A number: proximity, that is every term of a
    window within that many words of its rarest term. Items without an id count for hits but aren't listed. An empty benchmark
    finds nothing."""
    context = index.sparkSession.sparkContext
    blocks = _benchmark_blocks(benchmark, item_col, text_col)
    shared = context.broadcast(next(blocks))
    every = _search(index, shared, slop)
    second = next(blocks, None)
    if second is None:
        return every.drop("segment", "ordinal")
    every = save(every, "block")
    shared.destroy()
    for win in itertools.chain([second], blocks):
        shared = context.broadcast(win)
        every = every.unionByName(save(_search(index, shared, slop).where(F.length("hits") > 0), "block"))
        shared.destroy()
    merged = every.groupBy("segment", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("row_key").alias("row_key"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("all_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    @F.pandas_udf("binary")
    def either(lists):
        def one(xs):
            xs = [np.frombuffer(x, np.uint8) for x in xs if len(x)]
            return np.bitwise_or.reduce(xs).tobytes() if xs else b""

        return lists.map(one)

    return merged.select("doc_id", "row_key", "n_words", either("all_hits").alias("hits"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """matches() of all documents with n_hit, n_items and contaminated: n_hit > 0 and 20 n_hit >= n_words."""
    found = matches(build_index(docs), benchmark)

    @F.pandas_udf("long")
    def ones(bits):
        return bits.map(lambda x: int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()))

    return found.withColumns({"n_hit": ones("hits"), "n_items": F.size("items").cast("long")}).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    with temporary(docs.sparkSession):
        bad = contamination(docs, benchmark).where("contaminated").select(F.col("row_key").alias(ROW_KEY)).distinct()
        bad = save(bad, "contaminated", keep=True)
    return docs.withColumn(ROW_KEY, row_key()).join(bad, ROW_KEY, "left_anti").drop(ROW_KEY)
