"""Personal data: fixed patterns, then bootstrapped contextual extraction. DataFrame functions only.

Identifiers that the fixed patterns find are seeds. The two words before an identifier-shaped token (one that
holds a digit or @) are a lexical pattern, whatever they are: earlier identifiers count by their shape, and a text's
start counts as a word. In each round, patterns that stand before enough different likely instances are scored on the
graph of patterns and instances: a pattern's confidence is the share of all its occurrences in the corpus, ordinary
words after it included, that precede likely instances; an instance's score joins the confidences of its patterns.
Instances that one round finds induce further patterns in the next. Tokens after confident patterns become spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import ROW_KEY, row_key, save

# Fixed patterns, in possessive form so that long runs take linear time; a look-behind lets a match start
# only where a run starts or the last match ended, which finds the same matches.
KINDS = ("email", "ip", "card", "phone", "context")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

#: Different likely instances that a pattern must stand before, at every size of corpus; the least confidence of a
#: pattern and score of an instance; the rounds.
MIN_SEEDS, MIN_CONFIDENCE, ROUNDS = 5, 0.5, 3
#: Rows of about 100 bytes up to which a checked table is broadcast.
BROADCAST_ROWS = 50_000
#: Patterns up to which their hashes are listed in the filter of the corpus's word pairs.
LISTED_PATTERNS = 20_000
#: The word that stands for a text's start.
START = "^"
SPAN = "struct<start:int,rank:int,end:int>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once: lambdas evaluate what they take from outside for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of all matches, by code points. Starts are summed within chunks of 256
    matches and over chunks, so that many matches don't cost their square."""
    kind = "array<struct<start:int,end:int,hit:string>>"

    def entry(at: Column, x: Column) -> Column:
        return F.struct((at + x["g"]).alias("start"), (at + x["g"] + x["n"]).alias("end"), x["hit"].alias("hit"))

    def within(chunk: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(chunk, first, lambda acc, x: F.struct((acc["at"] + x["g"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(entry(acc["at"], x))).alias("out")))

    def moved(acc: Column, part: Column) -> Column:
        shifted = F.transform(part["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["hit"].alias("hit")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(shifted)).alias("out"))

    def summed(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / 256).cast("int")), lambda c: within(F.slice(pairs, c * 256 + 1, 256)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.when(F.size(pairs) == 0, F.array().cast(kind)).otherwise(F.flatten(F.aggregate(chunks, zero, moved)["out"]))

    def measured(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        sizes = F.zip_with(gaps, hits, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("hit")))
        return F.when(F.size(hits) == 0, F.array().cast(kind)).otherwise(_let(sizes, summed))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), measured)


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _card(x: Column) -> Column:
    return F.when(F.length(_digits(x)).between(12, 19), _luhn(_digits(x))).otherwise(False)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end>> of the fixed kinds by start, then kind; null and empty texts: none."""
    text = F.coalesce(text, F.lit(""))
    kinds: list[tuple[str, Column, Callable[[Column], Column]]] = [
        (EMAIL, F.contains(text, F.lit("@")), lambda x: F.lit(True)),
        (IP, text.rlike(r"[0-9]\.[0-9]"), lambda x: x.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")),
        (CARD, text.rlike(r"[0-9][\x20-]?[0-9]"), _card),
        (PHONE, F.contains(text, F.lit("+")), lambda x: F.length(_digits(x)).between(9, 15)),
    ]
    none = F.array().cast(f"array<{SPAN}>")

    def of(k: int, pattern: str, valid: Callable[[Column], Column]) -> Column:
        hits = F.filter(_placed(text, pattern), lambda x: valid(x["hit"]))
        return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), x["end"].alias("end")))

    every = [F.when(maybe, of(k, pattern, valid)).otherwise(none) for k, (pattern, maybe, valid) in enumerate(kinds)]
    return F.array_sort(F.concat(*every))


def _last_two(gap: Column) -> Column:
    """struct<first, second>: the last two words of the gap in lower case, empty where it has fewer."""

    def cut(flat: Column) -> Column:
        second = F.substring_index(flat, " ", -1)
        return _let(F.rtrim(F.substring(flat, F.lit(1), F.length(flat) - F.length(second))), lambda rest: F.struct(F.lower(F.substring_index(rest, " ", -1)).alias("first"), F.lower(second).alias("second")))

    return _let(F.rtrim(F.translate(gap, "\t\n\x0b\f\r", "     ")), cut)


def _shape(text: Column) -> Column:
    """The text in lower case, where a word with @ becomes @ and a run of digits 0."""
    text = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, r"(?<!\S)[^\s@]*+@\S*+", "@")).otherwise(text)
    return F.regexp_replace(F.lower(text), "[0-9]++", "0")


def _tokens(text: Column) -> Column:
    """array<struct<start, end, instance, pattern>> of the identifier-shaped tokens; pattern: the two words before."""

    def of(s: Column) -> Column:
        def pattern(i: Column) -> Column:
            own, last = F.get(s["before"], i), F.get(s["before"], i - 1)
            one, two = F.coalesce(F.get(s["shapes"], i - 1), F.lit(START)), F.coalesce(F.get(s["shapes"], i - 2), F.lit(START))
            further = F.when(i == 0, F.lit(START)).when(last["second"] != "", last["second"]).otherwise(two)
            return F.when(own["first"] != "", F.concat_ws(" ", own["first"], own["second"])).when(own["second"] != "", F.concat_ws(" ", one, own["second"])).when(i > 0, F.concat_ws(" ", further, one))

        def token(t: Column, i: Column) -> Column:
            return _let(F.regexp_replace(t["hit"], r"[.,;:!?]+$", ""), lambda x: F.struct(t["start"].alias("start"), (t["start"] + F.length(x)).alias("end"), x.alias("instance"), pattern(i).alias("pattern")))

        return F.transform(s["placed"], token)

    parts = _let(_placed(text, TOKEN), lambda p: F.struct(p.alias("placed"), F.transform(p, lambda t: _shape(t["hit"])).alias("shapes"), F.when(F.size(p) > 0, F.transform(F.split(text, TOKEN, -1), _last_two)).alias("before")))
    return _let(parts, of)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, which have ROW_KEY, with base (the fixed kinds' spans) and tokens, as a written table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,instance:string,pattern:string>>")
    return save(docs.select("*", base_spans(text).alias("base"), F.when(text.rlike("[0-9@]"), _tokens(text)).otherwise(none).alias("tokens")), "scanned")


def _occurrences(scanned: DataFrame) -> DataFrame:
    """Identifier-shaped tokens after two words: key, pattern, instance, start, end, seed (kind or null). Spans and
    tokens of a text meet in order, so a text's tokens cost no more than a sort however many there are."""
    blank = F.lit(None).cast("string")
    span = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), blank.alias("instance"), blank.alias("pattern")))
    token = F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(None).cast("int").alias("rank"), t["instance"].alias("instance"), t["pattern"].alias("pattern")))
    rows = scanned.where(F.size("tokens") > 0).select(F.col(ROW_KEY).alias("key"), F.explode(F.concat(span, token)).alias("x")).select("key", "x.*")
    up = Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("key").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("until", F.max(F.when(F.col("rank").isNotNull(), F.col("end"))).over(up))
    found = found.withColumn("next", F.min(F.when(F.col("rank").isNotNull(), F.struct("start", "rank"))).over(down))
    free = F.coalesce(F.col("until") <= F.col("start"), F.lit(True))
    one = found.where(F.col("rank").isNull() & free & F.col("pattern").isNotNull() & F.col("instance").rlike("[0-9@]"))
    return one.select("key", "pattern", "instance", "start", "end", F.when(F.col("next.start") < F.col("end"), F.col("next.rank")).alias("seed"))


def _corpus_counts(docs: DataFrame, patterns: DataFrame, text_col: str) -> DataFrame:
    """Occurrences in the whole corpus, before any word, of each of the patterns: pattern, total."""
    words = F.concat(F.array(F.lit(START)), F.split(F.regexp_replace(_shape(F.coalesce(F.col(text_col), F.lit(""))), r"^\s+", ""), r"\s+"))
    pairs = docs.select(words.alias("w")).where(F.size("w") >= 3).select(F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 2), F.slice("w", 2, F.size("w") - 2), lambda a, b: F.xxhash64(a, b))).alias("pair"))
    wanted = patterns.select("pattern", F.xxhash64(F.get(F.split("pattern", " "), F.lit(0)), F.get(F.split("pattern", " "), F.lit(1))).alias("pair"))
    if patterns.count() <= LISTED_PATTERNS:  # other pairs go before the aggregation, which has a row a pattern and task
        pairs = pairs.where(f"pair in ({','.join(str(r.pair) for r in wanted.select('pair').distinct().toLocalIterator())})")
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("total")).join(wanted, "pair").select("pattern", "total")


def discover(scanned: DataFrame, docs: DataFrame, text_col: str = "text", min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(spans, patterns) that the bootstrapping finds in docs and their scan(). spans: key, start, end of tokens that
    are no base spans; patterns: pattern, seeds (likely instances), total, confidence. Either may be empty."""
    seen = save(_occurrences(scanned), "identifiers")
    edges = seen.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.min("seed").alias("seed"))
    # Only these can ever have enough likely instances; the rest need no totals.
    patterns = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances")).where(F.col("instances") >= min_seeds).select("pattern")
    graph = save(edges.join(patterns, "pattern"), "graph")
    good = graph.select("pattern", F.lit(0).cast("long").alias("seeds"), F.lit(0).cast("long").alias("total"), F.lit(0.0).alias("confidence")).limit(0)
    none = seen.select("key", "start", "end").limit(0)
    if graph.where("seed is not null").isEmpty():
        return none, good
    totals = save(_corpus_counts(docs, graph.select("pattern").distinct(), text_col), "pattern-totals")
    scored = graph.groupBy("instance").agg(F.max(F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0)).alias("score"))
    for _ in range(rounds):
        likely = graph.join(scored, "instance").where("score > 0").groupBy("pattern").agg(F.sum(F.when(F.col("score") >= min_confidence, 1).otherwise(0)).alias("seeds"), F.sum(F.col("n") * F.col("score")).alias("likely"))
        likely = likely.where(F.col("seeds") >= min_seeds).join(totals, "pattern").withColumn("confidence", F.col("likely") / (F.col("total") + 1.0))
        good = save(likely.where(F.col("confidence") >= min_confidence).select("pattern", "seeds", "total", "confidence"), "confidence")
        left = F.log1p(-F.least(F.col("confidence"), F.lit(1 - 1e-9)))
        found = graph.join(good, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(left))).alias("score"))
        seeds = graph.where("seed is not null").select("instance", F.lit(1.0).alias("score"))
        scored = save(found.unionByName(seeds).groupBy("instance").agg(F.max("score").alias("score")), "scores")
    new = seen.where("seed is null").join(good.select("pattern"), "pattern").join(scored.where(F.col("score") >= min_confidence), "instance")
    return save(new.select("key", "start", "end").distinct(), "discovered"), good


def _with_spans(docs: DataFrame, text_col: str, keep_text: bool) -> DataFrame:
    """docs with ROW_KEY, base and spans; without their text unless asked for."""
    docs = docs.withColumn(ROW_KEY, row_key("doc_id", text_col))
    scanned = scan(docs, text_col)
    found, _ = discover(scanned, docs, text_col)
    new = found.groupBy("key").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("context")).alias("rank"), "end")).alias("new")).withColumnRenamed("key", ROW_KEY)
    scanned = scanned.drop("tokens", *([] if keep_text else [text_col]))
    n = found.count()
    if n == 0:
        return scanned.withColumn("spans", F.col("base"))
    joined = scanned.join(F.broadcast(new) if n <= BROADCAST_ROWS else new, ROW_KEY, "left")
    return joined.withColumn("spans", F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.col("new").cast(f"array<{SPAN}>"))))).drop("new")


def written(spans: str) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of start, rank in KINDS and end, in code points), a row per input row."""
    return _with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", False).select("doc_id", "base", "spans")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind, as <EMAIL>; overlapping spans become the first
    of them. n_chars, if there, is counted anew. Null stays null."""
    names = docs.columns
    rows = _with_spans(docs.select(F.col("doc_id"), F.col(text_col), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__all")), text_col, True)
    text = F.col(text_col)
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        cut = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(tags, s["rank"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], cut)).otherwise(acc["out"]).alias("out"))

    clean = F.when(F.size("spans") == 0, text).otherwise(F.aggregate("spans", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))))
    out = rows.select("__all", clean.alias("__clean"))
    return out.select(*[F.col("__clean").alias(c) if c == text_col else F.coalesce(F.length("__clean").cast(docs.schema[c].dataType), F.col("__all")[c]).alias(c) if c == "n_chars" else F.col("__all")[c].alias(c) for c in names])
