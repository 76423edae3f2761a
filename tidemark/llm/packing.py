"""Order-preserving packing of tokenized documents into sequences by dynamic programming.

Each partition is a stream of documents in the input's order. Cuts may fall at a document's end (free), after a
sentence (a small penalty), or at a grid position within a sentence (a larger one). The least sum of padding
and penalties is found with a monotone queue: all starts within one sequence length of a cut compete by one key.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches
from .words import blocks

LENGTH = 2048
END_ID = 1
#: Penalties in tokens of padding, and the grid within a sentence.
SENTENCE_CUT, TRUNCATION, GRID = 4.0, 24.0, 32
#: Tokens of the stream that are cut at a time, be it within a document; the last, open sequence is carried on.
BLOCK_TOKENS = 1 << 19

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"


class Encoder:
    """The ids that the tokenizers library gives for `byte_bpe_50k.json`, by an encoder of the same vocabulary's ranks;
    texts with a special token go to the library itself."""

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.library = json_path, None

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            return np.array(self.plain.encode_ordinary(text), np.uint32)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.json_path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def sentence_ends(self) -> np.ndarray:
        """By id: whether the token ends a sentence or a line."""
        marks = (b".", b"!", b"?", b"\n")
        out = np.zeros(self.plain.n_vocab + 1, bool)
        for i in range(self.plain.n_vocab):
            out[i] = self.plain.decode_single_token_bytes(i).rstrip(b" \"')").endswith(marks)
        return out


def cuts(ends: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> list[int]:
    """Where to cut a stream of docs[-1] tokens: the positions of the sequences' ends, the last included.
    ends: positions after a sentence; docs: after each document. The cost of a sequence is its padding (none at
    a power of two) and the penalty of its end. Ties go to the latest start."""
    total = int(docs[-1])
    kind = np.full(total + 1, -1.0)
    edges = np.unique(np.concatenate([[0], ends, docs]))
    grid = min(GRID, length)
    inside = (np.diff(edges) - 1) // grid
    nth = np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside)
    kind[np.repeat(edges[:-1], inside) + (nth + 1) * grid] = TRUNCATION
    kind[ends] = SENTENCE_CUT
    kind[docs] = 0.0
    kind[0] = 0.0
    at = np.flatnonzero(kind >= 0)
    price = kind[at].tolist()
    place = np.full(total + 1, -1)
    place[at] = np.arange(len(at))
    # For each cut, the cuts that lie a power of two before it.
    exact = [np.where(at >= 1 << k, place[np.maximum(at - (1 << k), 0)], -1) for k in range(5, length.bit_length()) if 1 << k < length]
    to, power = np.nonzero(np.array(exact, np.int64).reshape(-1, len(at)).T >= 0)
    first = np.searchsorted(to, np.arange(len(at) + 1)).tolist()
    before = np.array(exact, np.int64).reshape(-1, len(at))[power, to].tolist()
    at = at.tolist()
    best, back = [0.0], [0]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0][1]] < p - length:
            queue.popleft()
        low, i = queue[0]
        cost = low + length - p
        for k in before[first[j] : first[j + 1]]:
            if best[k] < cost:
                cost, i = best[k], k
        cost += price[j]
        best.append(cost)
        back.append(i)
        key = cost + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def _last(size: int, length: int) -> list[int]:
    """The final piece of a stream, in powers of two where padding it would cost more than cutting."""
    bits = [1 << k for k in range(size.bit_length() - 1, -1, -1) if size >> k & 1]
    return bits if size < length and length - size > TRUNCATION * (len(bits) - 1) else [size]


def pack(docs: DataFrame, json_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """PIECES of the documents, with their token_ids if asked for, the final END_ID included. A null or empty text is its END_ID
    alone. Repeated rows are packed each. sequence_id: the partition's number in the upper bits."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    schema = PIECES + ", token_ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = Encoder(json_path, ranks_path)
        sentence = encoder.sentence_ends()
        open_docs: list[tuple] = []  # (id, ids, first token not yet placed)
        waiting, number = 0, 0

        def placed(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal open_docs, waiting, number
            parts, left = [], BLOCK_TOKENS
            for _, ids, done in open_docs:
                parts.append(ids[done : done + left])
                left -= len(parts[-1])
                if not left:
                    break
            stream, edge = np.concatenate(parts), np.cumsum([len(x) for x in parts])
            marks = np.flatnonzero(sentence[stream]) + 1
            at = cuts(marks, edge, length)
            if final:
                before = at[-2] if len(at) > 1 else 0
                at = at[:-1] + (before + np.cumsum(_last(at[-1] - before, length))).tolist()
            else:
                at = at[:-1]
            out: list[tuple] = []
            d, taken, a = 0, open_docs[0][2] if open_docs else 0, 0
            for b in at:
                offset = 0
                while a + offset < b:
                    i, ids, _ = open_docs[d]
                    n = min(len(ids) - taken, b - a - offset)
                    piece = ids[taken : taken + n]
                    out.append((i, taken, n, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), (part << 32) + number, offset, piece.astype(np.int32)))
                    offset, taken = offset + n, taken + n
                    if taken == len(ids):
                        d += 1
                        taken = open_docs[d][2] if d < len(open_docs) else 0
                a, number = b, number + 1
            open_docs = [(i, ids, taken if k == 0 else done) for k, (i, ids, done) in enumerate(open_docs[d:])]
            waiting = sum(len(ids) - done for _, ids, done in open_docs)
            for k in range(0, len(out), 4000):
                cols = list(zip(*out[k : k + 4000], strict=True))
                sizes = np.cumsum([0, *map(len, cols[-1])]).astype(np.int32)
                arrays = [pa.array(c, pa.int64()) for c in cols[:-1]]
                arrays += [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(cols[-1])))] if with_ids else []
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        for block in blocks(batches, 1 << 20):
            for i, text in block:
                ids = encoder.ids(text or "")
                open_docs.append((i, np.append(ids, np.uint32(END_ID)), 0))
                waiting += len(ids) + 1
            while waiting >= BLOCK_TOKENS:
                yield from placed(False)
        if open_docs:
            yield from placed(True)

    return rows.mapInArrow(run, schema)
