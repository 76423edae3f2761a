"""Near-duplicate documents with Order MinHash and banded alignment.

A sketch keeps, for each of some hash functions, the least few occurrence-labelled 5-word shingles in their
text order. Documents that agree on one sketch are candidates. Two documents link if the longest common
subsequence of their shingles, aligned within the band that the threshold allows, gives a similarity of
common / (shingles of both - common) of 0.8 or more. Equal word sequences are one class from the start. Within
a bucket of equal sketches all classes are first compared with one centre, which links most copies at a cost in
proportion to their number. Only pairs over the components that this leaves meet afterwards, in blocks of bounded
size, where plain MinHash signatures rule out most before any text moves.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import ROW_KEY, bounded_batches, row_key, save, temporary
from .words import HashedWords, blocks, folded_words, mix, rolled

SHINGLE, SIMILARITY = 5, 0.8
#: Sketches of a document, and the shingles that each keeps. Documents of fewer than SHORT shingles have sketches
#: of two, those of at least SIMILARITY * SHORT have sketches of six: any linked pair shares a sort. Of pairs
#: at the threshold a share of about (1 - 0.8 ** 6) ** 30 = 0.0001 shares no sketch.
SKETCHES, KEPT, KEPT_SHORT, SHORT = 30, 6, 2, 80
#: Plain MinHash values that tell candidates of crowded buckets apart; a pair at the threshold falls short of
#: LEAST_AGREEING of them with a chance of 0.00003.
SIGNATURE = 256
LEAST_AGREEING = int(SIGNATURE * SIMILARITY - 4 * (SIGNATURE * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
#: Documents of a bucket, and bytes of their shingles, that meet in one task, at most twice.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Words of texts whose shingles a worker keeps for the next pairs.
KEPT_WORDS = 2_000_000

SKETCHED = "doc_id long, row_key binary, n_words long, shingles long, digest binary, sketches array<long>"


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five of the words' hashes; fewer words are one run, none are none."""
    return rolled(words, min(SHINGLE, len(words))) if len(words) else words


def labelled(x: np.ndarray) -> np.ndarray:
    """The shingles, each but the first of equal ones told apart by its occurrence."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    runs = np.flatnonzero(np.diff(x[order], prepend=~x[order[:1]]) != 0)
    if len(runs) < n:
        nth = np.empty(n, np.uint64)
        nth[order] = np.arange(n) - np.repeat(runs, np.diff(np.append(runs, n)))
        x = np.where(nth > 0, mix(x + nth), x)
    return x


def signature(x: np.ndarray) -> bytes:
    """The low 16 bits of the least labelled shingle under each of SIGNATURE hash functions."""
    x = labelled(x)
    seeds = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) << np.uint64(20))
    step = max(1, (1 << 20) // max(1, len(x)))
    least = [mix(x[None, :] ^ part[:, None]).min(axis=1) for part in np.split(seeds, range(step, SIGNATURE, step))]
    return np.concatenate(least).astype("<u2").tobytes()


def sketch(x: np.ndarray) -> np.ndarray:
    """The Order MinHash sketches of a shingle sequence; one shingle has none, as only equals link."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.uint64)
    x = labelled(x)
    out = []
    for kept in [KEPT_SHORT] * (n < SHORT) + [KEPT] * (n >= SIMILARITY * SHORT):
        seeds = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(kept))
        step = max(1, (1 << 20) // n)
        for part in np.split(seeds, range(step, SKETCHES, step)):
            rank = mix(x[None, :] ^ part[:, None])
            least = np.sort(np.argpartition(rank, kept - 1, axis=1)[:, :kept], axis=1) if n > kept else np.broadcast_to(np.arange(n), (len(part), n))
            value = part.copy()
            for k in range(least.shape[1]):
                value = mix(value * np.uint64(31) + x[least[:, k]])
            out.append(value)
    return np.concatenate(out)


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, np.ndarray] = {}
    for rows in blocks(batches, 2 << 20):
        words = [folded_words(r[-1]) for r in rows]
        block = HashedWords(words)
        out: list[tuple] = []
        for k, row in enumerate(rows):
            own = words[k]
            digest = hashlib.blake2b(b" ".join(own), digest_size=16).digest() if own else None
            got = known.get(digest) if own else np.zeros(0, np.uint64)
            if got is None:
                got = sketch(shingles(block.name[block.starts[k] : block.starts[k + 1]]))
                if len(known) > 5000:
                    known.clear()
                known[digest] = got
            n = len(own)
            out.append((row[0], row[1], n, max(n - SHINGLE + 1, min(n, 1)), digest, got.view(np.int64)))
        cols = list(zip(*out, strict=True))
        sizes = np.cumsum([0, *map(len, cols[5])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols[:5], (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(cols[5])))], names=[x.split()[0] for x in SKETCHED.split(", ")])


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest common subsequence of two sequences over pairs at most `band` positions apart."""
    common = 0
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, common = a[head:], b[head:], head
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b, common = a[: len(a) - tail], b[: len(b) - tail], common + tail
    if not len(a) or not len(b):
        return common
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    if int((hi - lo).sum()) > 2_000_000:
        return common + _dense(a, b, band)
    tails: list[int] = []
    places = order.tolist()
    for i, (x, y) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        for j in reversed(places[x:y]):
            if abs(i - j) <= band:
                k = bisect_left(tails, j)
                tails[k : k + 1] = [j]
    return common + len(tails)


def _dense(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """As aligned(), a row at a time over the band: for sequences that repeat themselves."""
    best = np.zeros(len(b) + 1, np.int32)
    for i, x in enumerate(a):
        lo, hi = max(0, i - band), min(len(b), i + band + 1)
        if lo >= hi:
            break
        step = np.maximum(best[lo + 1 : hi + 1], best[lo:hi] + (b[lo:hi] == x))
        best[lo + 1 : hi + 1] = np.maximum.accumulate(np.maximum(step, best[lo]))
        best[hi + 1 :] = np.maximum(best[hi + 1 :], best[hi])
    return int(best[-1])


class Shingled:
    """A document's shingles, and the distinct ones in order."""

    def __init__(self, own: np.ndarray):
        self.all, self.distinct = own, np.unique(own)


def _shingled(text: str) -> np.ndarray:
    return shingles(HashedWords([folded_words(text)]).name)


def similarity(a: Shingled, b: Shingled, least: float = SIMILARITY) -> float:
    """common / (shingles of both - common) by banded alignment; 0 where it can't reach `least`."""
    total = len(a.all) + len(b.all)
    need = least * total / (1 + least) - 1e-9
    if min(len(a.all), len(b.all)) < need:
        return 0.0
    at = np.minimum(np.searchsorted(b.distinct, a.distinct), len(b.distinct) - 1)
    if int((b.distinct[at] == a.distinct).sum()) < need - (total - len(a.distinct) - len(b.distinct)):
        return 0.0
    common = aligned(a.all, b.all, int(total * (1 - least) / (1 + least)) + 1)
    return common / (total - common) if common >= need else 0.0


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of digests that link."""
    both = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Shingled] = {}
        words = 0
        for batch in batches:
            links: list[tuple] = []
            digests = [batch.column(c).to_pylist() for c in ("a", "b")]
            for i, pair in enumerate(zip(*digests, strict=True)):
                for digest, column in zip(pair, ("text_a", "text_b"), strict=True):
                    if digest not in known:
                        known[digest] = x = Shingled(_shingled(batch.column(column)[i].as_py()))
                        words += len(x.all)
                if similarity(known[pair[0]], known[pair[1]]):
                    links.append(pair)
                if words > KEPT_WORDS:
                    known, words = {}, 0
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _signed(texts: DataFrame) -> DataFrame:
    """By digest: the signature, the sketches (short ones, then long ones, 0 where there are none), the shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_shingled(x) for x in batch.column("text").to_pylist()]
            placed = []
            for x in own:
                row = np.zeros(2 * SKETCHES, np.uint64)
                got = sketch(x)
                row[0 if len(x) < SHORT else SKETCHES :][: len(got)] = got
                placed.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *(pa.array(c, pa.binary()) for c in ([signature(x) for x in own], placed, [x.tobytes() for x in own]))], names=["digest", "signature", "sketches", "sequence"])

    return texts.mapInArrow(run, "digest binary, signature binary, sketches binary, sequence binary")


def _crossing(table: pa.Table) -> pa.Table:
    """Links between two blocks of a bucket over the components known so far. Pairs that an earlier sketch brings
    together elsewhere, and those whose signatures are too far apart, are passed over; the others are aligned, the
    likeliest first, unless links found here join them already. So the links are a forest: fewer than documents."""
    bucket, lo, hi = (table.column(c)[0].as_py() for c in ("bucket", "lo", "hi"))
    digest, own, component, sequence = (table.column(c).to_pylist() for c in ("digest", "own", "component", "sequence"))
    own, size = np.array(own), np.array(table.column("shingles").to_pylist())
    code = np.unique(np.array([x.hex() for x in component]), return_inverse=True)[1]
    signs = np.stack([np.frombuffer(x, "<u2") for x in table.column("signature").to_pylist()])
    sketches = np.stack([np.frombuffer(x, np.int64) for x in table.column("sketches").to_pylist()])
    here = sketches == bucket
    at = here.argmax(axis=1)
    right = np.flatnonzero(own == hi)
    near: list[tuple] = []
    for i in np.flatnonzero(own == lo).tolist():
        j = right[right > i] if lo == hi else right
        j = j[(code[j] != code[i]) & (size[j] >= SIMILARITY * size[i]) & (size[i] >= SIMILARITY * size[j])]
        if len(j):
            j = j[~((sketches[j, : at[i]] == sketches[i, : at[i]]) & (sketches[i, : at[i]] != 0)).any(axis=1)]
        if len(j):
            agree = (signs[j] == signs[i]).sum(axis=1)
            near += [(-n, i, x) for n, x in zip(agree.tolist(), j.tolist(), strict=True) if n >= LEAST_AGREEING]
    parent = list(range(len(digest)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found, known = [], {}
    for _, i, j in sorted(near):
        a, b = root(code[i]), root(code[j])
        if a == b:
            continue
        for x in (i, j):
            if x not in known:
                known[x] = Shingled(np.frombuffer(sequence[x], np.uint64))
        if similarity(known[i], known[j]):
            parent[a] = b
            found.append((min(digest[i], digest[j]), max(digest[i], digest[j])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})


def _rest(members: DataFrame, signed: DataFrame) -> DataFrame:
    """Links over the components in each bucket, from blocks that meet two by two."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("shingles") * 8 / BLOCK_BYTES)).cast("int")
    sizes = members.groupBy("bucket").agg(blocks.alias("blocks"))
    placed = members.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(signed, "digest")
    meets = meets.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    columns = ["bucket", "lo", "hi", "own", "digest", "component", "shingles", "signature", "sketches", "sequence"]
    return meets.select(*columns).groupBy("bucket", "lo", "hi").applyInArrow(_crossing, "a binary, b binary")


def _stars(members: DataFrame) -> DataFrame:
    """(bucket, centre) of each bucket, and its pairs with the members of other components near its size."""
    centre = members.groupBy("bucket").agg(F.min(F.struct("digest", "component", "shingles")).alias("c"))
    other = (F.col("digest") != F.col("c.digest")) & (F.col("component") != F.col("c.component"))
    near = (F.col("shingles") >= SIMILARITY * F.col("c.shingles")) & (F.col("c.shingles") >= SIMILARITY * F.col("shingles"))
    return members.join(centre, "bucket").where(other & near).select(F.least("digest", "c.digest").alias("a"), F.greatest("digest", "c.digest").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, n_words, class_id, kept, a row per input row. class_id: the least doc_id of the
    document's component; kept: the row has the least (doc_id, content) of it, which repeated rows share.
    A document without words (null, empty, only separators) is a class of its own."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    all_rows = save(rows.mapInArrow(_sketched, SKETCHED), "sketches")
    first = all_rows.where("digest is not null").groupBy("digest").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "row_key")).alias("least"), F.first("shingles").alias("shingles"), F.first("sketches").alias("sketches"))
    first = save(first, "classes")
    every = first.select("digest", "shingles", F.explode("sketches").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = save(every.join(shared, "bucket"), "buckets")
    wanted = members.select("digest").distinct().join(first.select("digest", F.col("least.row_key").alias("row_key")), "digest")
    texts = save(rows.select("row_key", "text").join(wanted, "row_key").dropDuplicates(["digest"]).select("digest", "text"), "texts")
    members = members.withColumn("component", F.col("digest"))
    stars = save(_stars(members), "stars")
    links = save(_verified(stars, texts), "links")
    known = components(links).withColumnRenamed("node", "digest")
    members = members.drop("component").join(known, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    mixed = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo != hi and n > 2").select("bucket")
    members = save(members.join(mixed, "bucket"), "crowded")
    if not members.isEmpty():
        crowd = texts.join(members.select("digest").distinct(), "digest", "left_semi")
        rest = save(_rest(members, save(_signed(crowd), "signatures")), "rest")
        links = save(links.unionByName(rest), "links")
    groups = components(links).withColumnRenamed("node", "digest")
    first = first.select("digest", "least")
    named = first.join(groups, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    least = named.groupBy("component").agg(F.min("least").alias("top"))
    of = named.join(least, "component").select("digest", "top")
    out = all_rows.join(of, "digest", "left")
    own = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "row_key")
    class_id = F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.nullif("top.doc_id", F.lit((1 << 63) - 1)))
    return out.select("doc_id", "row_key", "n_words", class_id.alias("class_id"), F.when(F.col("top").isNull(), True).otherwise((own["doc_id"] == F.col("top.doc_id")) & (F.col("row_key") == F.col("top.row_key"))).alias("kept"), F.col("digest").isNotNull().alias("has_words"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns; of rows repeated in full content, one."""
    with temporary(docs.sparkSession):
        found = save(classes(docs), "class-rows", keep=True)
    drop = found.where("not kept").select(F.col("row_key").alias(ROW_KEY)).distinct()
    rest = docs.withColumn(ROW_KEY, row_key()).join(drop, ROW_KEY, "left_anti")
    again = found.where("kept and has_words").groupBy("row_key").count().where("count > 1").select(F.col("row_key").alias(ROW_KEY))
    if again.isEmpty():
        return rest.drop(ROW_KEY)
    again = save(again, "repeated")
    once = rest.join(again, ROW_KEY, "left_anti")
    return once.unionByName(rest.join(again, ROW_KEY, "left_semi").dropDuplicates([ROW_KEY])).drop(ROW_KEY)
