"""Quality selection by importance resampling.

Two generative models over hashed word and punctuation n-grams (singles and pairs) are counted: one of target
text, one of all raw text. A document's log importance weight is log p_target - log p_raw, summed over its n-grams.
Standard Gumbel noise on these weights and an exact top-k draw the sample, without replacement and in proportion to
the weights. k is a share of the documents: a parameter, or else the share of labelled documents of good quality,
taken two standard errors high.

Toxic documents may be well written, so a model of their own finds them: words and word prefixes that more
labelled toxic than other labelled documents hold, and two at least, are weighed by the lower bound of the log ratio
of these shares.
A document's toxicity is the sum of its STRONGEST heaviest words, so that a few insults count in a long text too,
and documents above a calibrated cut are taken out of the sample whatever their weight.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ROW_KEY, bounded_batches, row_key, save, temporary
from .words import WordBlock, blocks, mix

BUCKETS = 1 << 15
#: Labelled rows that fit the models, at most; of the toxic model even ones by hash fit the weights, odd ones the cut.
LABELLED = 20_000
#: Lost clean documents weigh so much more than kept toxic ones when the cut is chosen.
LOSS = 10.0
#: Seed of the Gumbel noise, and standard errors that the share of good labels is raised by.
SEED, RAISED = 20240131, 2.0

#: Toxic words: buckets of their hashes, lengths of prefixes in bytes, standard errors that a log ratio is
#: lowered by, toxic documents that a form must be in, and words that make up a document's toxicity.
TOXIC_BUCKETS, PREFIXES, ERRORS, LEAST_TOXIC, STRONGEST = 1 << 18, range(4, 9), 1.0, 2, 5

SCORED = "doc_id long, row_key binary, toxic int, fold int, n_grams long, log_weight double, toxicity double"
_GRAM = re.compile(r"\w+|[^\w\s]+")


def split(texts: list[str | None]) -> WordBlock:
    """The words and punctuation of the texts, in lower case."""
    return WordBlock([t.encode("utf-8", "surrogatepass") for t in _GRAM.findall(x.lower())] if x else [] for x in texts)


def grams(block: WordBlock) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): the hashed n-grams of the texts, each text's end to end, singles before pairs."""
    h = block.hashes(7)
    pair = np.zeros(len(h), bool)
    pair[: len(h) - 1] = block.owner[1:] == block.owner[:-1] if len(h) else False
    both = mix(h + mix(np.roll(h, -1)))[pair]
    owner = np.concatenate([block.owner, block.owner[pair]])
    order = np.argsort(owner, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(block.counts)))]).astype(np.int64)
    return (np.concatenate([h, both])[order] % np.uint64(BUCKETS)).astype(np.int64), starts


def marks(block: WordBlock) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, terms): the hashed forms of the block's terms, that is each word and its prefixes, with its number."""
    n = len(block.terms)
    sizes = np.fromiter(map(len, block.terms), np.int64, n)
    heads = np.frombuffer(b"".join([t[:8].ljust(8, b"\0") for t in block.terms]), "<u8")
    forms, terms = [block.term_hashes(11)], [np.arange(n)]
    for k in PREFIXES:
        longer = np.flatnonzero(sizes > k)
        forms.append(mix((heads[longer] & np.uint64((1 << 8 * k) - 1)) + mix(np.full(len(longer), k, np.uint64))))
        terms.append(longer)
    return (np.concatenate(forms) % np.uint64(TOXIC_BUCKETS)).astype(np.int64), np.concatenate(terms)


def toxicity(block: WordBlock, table: np.ndarray) -> np.ndarray:
    """The summed weights of each text's STRONGEST different words; a word weighs as much as its heaviest form."""
    buckets, terms = marks(block)
    heaviest = np.zeros(len(block.terms))
    np.maximum.at(heaviest, terms, table[buckets])
    heavy = np.flatnonzero(heaviest[block.ids] > 0)
    pairs = np.unique(np.stack([block.owner[heavy], block.ids[heavy]], 1), axis=0)
    owner, weight = pairs[:, 0], heaviest[pairs[:, 1]]
    order = np.lexsort([-weight, owner])
    owner, weight = owner[order], weight[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return np.bincount(owner[place < STRONGEST], weight[place < STRONGEST], minlength=len(block.counts)).astype(float)


def _labelled(labels: DataFrame, limit: int) -> DataFrame:
    """doc_id, label (1: good and not toxic), toxic, good (of good quality), fold of a fixed sample of the labels; a doc_id once."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.when(good, 1).otherwise(0)).alias("label"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"), F.min(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"))
    return rows.withColumn("h", F.xxhash64("doc_id", F.lit(SEED))).orderBy("h", "doc_id").limit(limit).select("doc_id", "label", "toxic", "good", F.pmod("h", F.lit(2)).cast("int").alias("fold"))


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for rows in blocks(batches, 2 << 20):
        buckets, starts = grams(split([r[-1] for r in rows]))
        total[0] += np.bincount(buckets, minlength=BUCKETS)
        for k, (_, _, label, _, _, _) in enumerate(rows):
            if label == 1:
                total[1] += np.bincount(buckets[starts[k] : starts[k + 1]], minlength=BUCKETS)
    model, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[model, bucket])], names=["model", "bucket", "n"])


def log_ratios(rows: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket, half a count added to each; the two count vectors are all that
    reaches the driver. All 0 without target text."""
    counted = rows.mapInArrow(_counts, "model int, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n"))
    total = np.zeros((2, BUCKETS))
    for r in counted.toLocalIterator():
        total[r.model, r.bucket] = r.n
    raw, target = ((x + 0.5) / (x.sum() + 0.5 * BUCKETS) for x in total)
    if not total[1].sum():
        return np.zeros(BUCKETS)
    return np.log(target / raw)


def _mark_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, TOXIC_BUCKETS), np.int64)
    docs = np.zeros(2, np.int64)
    for rows in blocks(batches, 2 << 20):
        for toxic, text in rows:
            total[toxic, np.unique(marks(split([text]))[0])] += 1
            docs[toxic] += 1
    model, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(model, [0, 1]).astype(np.int32)), pa.array(np.append(bucket, [-1, -1]).astype(np.int32)), pa.array(np.append(total[model, bucket], docs))], names=["model", "bucket", "n"])


def toxic_weights(rows: DataFrame) -> np.ndarray:
    """The weight of each bucket of marks, 0 or more, from the labelled documents that fit models: by how much its
    share of toxic ones exceeds that of others, for sure. All 0 where no document is toxic."""
    fit = rows.where("fold = 0 and text is not null").select("toxic", "text")
    counted = fit.mapInArrow(_mark_counts, "model int, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n"))
    total, docs = np.zeros((2, TOXIC_BUCKETS)), np.zeros(2)
    for r in counted.toLocalIterator():
        if r.bucket < 0:
            docs[r.model] = r.n
        else:
            total[r.model, r.bucket] = r.n
    if not docs[1]:
        return np.zeros(TOXIC_BUCKETS)
    other, toxic = total + 0.5
    weight = np.log(toxic / (docs[1] + 1)) - np.log(other / (docs[0] + 1)) - ERRORS * np.sqrt(1 / toxic + 1 / other)
    return np.where(total[1] >= LEAST_TOXIC, np.maximum(weight, 0.0), 0.0)


def best_cut(good: np.ndarray, bad: np.ndarray, loss: float = LOSS) -> float:
    """The score below which documents go: it maximises the share of bad ones below less `loss` times that of
    good ones, with ties to the lower cut. Without bad ones it loses at most one good one in a thousand."""
    if not len(good):
        return -np.inf
    if not len(bad):
        return float(np.quantile(good, 0.001))
    cuts = np.unique(np.concatenate([good, bad]))
    gain = np.searchsorted(np.sort(bad), cuts) / len(bad) - loss * np.searchsorted(np.sort(good), cuts) / len(good)
    best = int(np.argmax(gain))
    return float((cuts[best] + cuts[best - 1]) / 2) if best else float(cuts[0])


def kth_largest(df: DataFrame, col: str, k: int, small: int = 2000) -> float:
    """The k-th largest value of a finite column, exactly, by counting in ever narrower bins."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    k = min(max(k, 1), n)
    above = 0
    while True:
        inside = df.where((F.col(col) >= lo) & (F.col(col) <= hi))
        width = (hi - lo) / 1024
        if width == 0 or lo + width == lo:
            return lo
        bins = {r.b: r for r in inside.groupBy(F.least(F.floor((F.col(col) - lo) / width), F.lit(1023)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b].n >= k:
                break
            above += bins[b].n
        lo, hi = bins[b].lo, bins[b].hi
        if bins[b].n <= small:
            values = sorted((r[0] for r in df.where((F.col(col) >= lo) & (F.col(col) <= hi)).select(col).collect()), reverse=True)
            return values[k - above - 1]


def good_share(sample: DataFrame) -> float:
    """The share of good quality among labelled documents, RAISED standard errors high; 1 without labels."""
    n, p = sample.agg(F.count(F.lit(1)), F.avg("good")).first()
    return min(1.0, p + RAISED * (p * (1 - p) / n) ** 0.5) if n else 1.0


def select(docs: DataFrame, labels: DataFrame, share: float | None = None, labelled: int = LABELLED) -> DataFrame:
    """doc_id, row_key, n_grams, log_weight, key (the weight and its noise), marked (toxic), selected, a row per input
    row. The k = share * n documents of the highest keys are drawn, of n with n-grams; toxic ones are taken out of
    them. Texts without n-grams (null, empty) have no weight and aren't selected. Rows equal in doc_id and content
    share their noise, so they stay or go together. Without good labelled documents all weights are 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = save(_labelled(labels, labelled), "labelled")
    share = good_share(sample) if share is None else share
    sample = F.broadcast(sample)  # at most `labelled` rows of five integers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("string").alias("text")).join(sample, "doc_id", "left").select("doc_id", "row_key", "label", "toxic", "fold", "text")
    ratio = spark.sparkContext.broadcast(log_ratios(rows).tolist())
    heavy = toxic_weights(rows)
    marked = spark.sparkContext.broadcast((np.flatnonzero(heavy).tolist(), heavy[heavy > 0].tolist()))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, toxic = np.array(ratio.value), np.zeros(TOXIC_BUCKETS)
        toxic[np.array(marked.value[0], np.int64)] = marked.value[1]
        for part in blocks(batches, 2 << 20):
            block = split([r[-1] for r in part])
            buckets, starts = grams(block)
            run = np.concatenate([[0.0], np.cumsum(table[buckets])])
            ids, keys, _, is_toxic, fold = zip(*(r[:5] for r in part), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(is_toxic, pa.int32()), pa.array(fold, pa.int32()), pa.array(np.diff(starts)), pa.array(run[starts[1:]] - run[starts[:-1]]), pa.array(toxicity(block, toxic))], names=[x.split()[0] for x in SCORED.split(", ")])

    scored = save(rows.mapInArrow(score, SCORED), "importance")
    held = scored.where("fold = 1 and n_grams > 0").select("toxic", "toxicity").limit(2 * labelled).toPandas()
    # Of each document's negative toxicity, as best_cut() rejects what is below; without toxic ones to learn from nothing.
    safe = best_cut(-held.toxicity[held.toxic == 0].to_numpy(), -held.toxicity[held.toxic == 1].to_numpy()) if (held.toxic == 1).any() and heavy.any() else -np.inf
    weight = F.when(F.col("n_grams") > 0, F.col("log_weight"))
    uniform = (F.pmod(F.xxhash64("row_key", F.lit(SEED)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = save(scored.select("doc_id", "row_key", "n_grams", weight.alias("log_weight"), (weight - F.log(-F.log(uniform))).alias("key"), (-F.col("toxicity") < F.lit(safe)).alias("marked")), "keys")
    k = math.ceil(share * keyed.where("key is not null").count())
    if not k:
        return keyed.withColumn("selected", F.lit(False))
    least = kth_largest(keyed.where("key is not null"), "key", k)
    return keyed.withColumn("selected", F.coalesce((F.col("key") >= F.lit(least)) & ~F.col("marked"), F.lit(False)))


def keep_selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The selected documents, with all their columns."""
    with temporary(docs.sparkSession):
        rejected = save(select(docs, labels).where("not selected").select(F.col("row_key").alias(ROW_KEY)).distinct(), "rejected", keep=True)
    return docs.withColumn(ROW_KEY, row_key()).join(rejected, ROW_KEY, "left_anti").drop(ROW_KEY)
