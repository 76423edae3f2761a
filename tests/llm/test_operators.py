"""The operators on Spark: edge cases with defined results, and brute force on the small tables."""

import hashlib
import itertools
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, decontaminate, embedding_dedup, licenses, near_dedup, oracles, packing, pii, quality, queries, sharding, substring_dedup, url_rules
from tidemark.llm.queries import tokenizer_files
from tidemark.llm.words import folded_words

DIR = "/root/testdata/sf0.001"
W = [f"word{i}" for i in range(400)]
LONG = " ".join(W)
NEAR = " ".join([*W[:200], "other", *W[201:]])
#: Nulls, empty and long texts, repeated rows, ties of id, extra columns with clashing names.
ROWS = [(1, LONG), (2, LONG), (3, NEAR), (4, None), (5, ""), (6, " ., "), (None, "no id here"), (7, "one two three"), (7, "one two three"), (7, "four five six"), (8, "x " * 30_000), (9, "mail a.b@c.de or +1 (555) 123-4567 at 10.0.0.1, 4111 1111 1111 1111.")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    extra = {c: F.lit("x") for c in ("key", "class", "segment", "base", "spans", "bucket", "component", "shard", "id", "value", "a.b")}
    return df.withColumns(extra).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (8, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(W[50:70])), (2, "one two three"), (3, None), (4, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()


def test_decontamination(docs, none, benchmark, spark):
    got = decontaminate.contamination(docs, benchmark).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.n_words): (r.n_hit, list(r["items"]), r.contaminated) for r in got}
    assert by[1, 400] == (20, ["1"], True) and by[7, 3][0] in (0, 3) and by[4, 0] == (0, [], False) and by[8, 30_000] == (0, [], False)
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for i, t in ROWS if t not in (LONG, NEAR, "one two three"))
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.where("false")).where("n_hit > 0").count() == 0


def test_benchmark_items_without_id(docs, spark):
    nameless = spark.createDataFrame([(None, " ".join(W[50:70]))], "item_id long, text string")
    by = {(r.doc_id, r.n_words): (r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, nameless).collect()}
    assert by[1, 400] == (20, [], True) and by[7, 3] == (0, [], False)


def test_decontamination_in_blocks(docs, benchmark, monkeypatch):
    whole = decontaminate.contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "items").collect()
    for n in (1, 3):  # the longer item is cut into several blocks
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", n)
        split = decontaminate.contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "items").collect()
        assert sorted(map(str, whole)) == sorted(map(str, split))


def test_proximity(docs, benchmark):
    index = decontaminate.build_index(docs)
    near = decontaminate.matches(index, benchmark.where("item_id = 2"), slop=2)
    assert {r.doc_id for r in near.collect() if r["items"]} == {7}


def test_urls(spark):
    urls = [None, "", "example.org/es/1", "HTTP://WWW.Example.ORG/es/x?q#f", "x://example.org/en/12/3", "x://example.org", "x://u@example.com:80/de/", "x://badexample.org/es/", "x://a.example.org/en/2", "x://fr.com/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df.unionByName(df.where("page_id = 3")), url_rules.rule_table(spark)).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/12/3", "example.org/en/1", "block") and got[5] == ("example.org", "", None, "allow")
    assert got[6][2:] == (None, "allow") and got[7][2:] == ("org/", "allow") and got[8][2:] == ("org/", "allow") and got[9][2:] == ("com/fr/", "allow")
    assert url_rules.judge(df.where("false"), url_rules.rule_table(spark)).count() == 0
    assert url_rules.judge(df, url_rules.rule_table(spark).where("false")).where("rule is null").count() == 10


def test_many_rules(spark, monkeypatch):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    few = sorted(map(str, url_rules.judge(pages, url_rules.rule_table(spark)).collect()))
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 1)
    assert sorted(map(str, url_rules.judge(pages, url_rules.rule_table(spark)).collect())) == few


KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def personal(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d or "0"), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


TRICKY = ["a@b.c_x@d.e.f", "é 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111-1111-1111-1111 41111111111111112", "+1 555 123 4567+44 (20) 7946-0958 +12", "x" * 3000 + "@" + "y" * 3000, "9" * 5000, "\n".join(["a@b.cd"] * 700), "1 2 3 4 5 6 7 8 9 0 1 2 8", "a..b@c-d.e.", "\U0001f600 q@r.st"]


def test_personal_data(spark, docs, none):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TRICKY, *(t for _, t in texts())])], "doc_id long, text string")
    for r in df.withColumn("base", pii.base_spans(F.col("text"))).select("text", pii.written("base").alias("w")).collect():
        assert r.w == personal(r.text), r.text[:80]
    assert pii.find(none).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect() if r.doc_id in (4, 5, 9)}
    assert clean == {4: None, 5: "", 9: "mail <EMAIL> or <PHONE> at <IP>, <CARD>."}
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)


def contexts(spark, rows):
    """The found spans by doc_id, of texts whose base spans are left out."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    of = {}
    for r in pii.find(df).select("doc_id", F.expr("filter(spans, s -> s.rank = 4)").alias("s")).collect():
        for s in r.s:
            of.setdefault(r.doc_id, []).append((s.start, s.end))
    return of


@pytest.mark.parametrize("more", [0, 400, 4000])
def test_contexts_are_learned(spark, more):
    """The same spans however many unrelated documents and seeds there are."""
    rows = [(i, f"some words here {w} my contact: user{i}@mail.example.com and more") for i, w in enumerate(W[:30])]
    rows += [(100 + i, f"they said please my contact: handle_{i}x soon") for i in range(10)]
    rows += [(200 + i, f"of the year 19{i:02d} and of the town") for i in range(60)]
    rows += [(300 + i, f"of the a{i}@b.cd") for i in range(6)]
    # The handles that the first round finds stand before `reach me`, which no fixed kind ever follows.
    rows += [(400 + i, f"reach\tme  via handle_{i}x.") for i in range(10)] + [(450, "reach me via newcomer7 or\n line 24")]
    # At a text's start, and after another identifier.
    rows += [(500 + i, f"id w{i}@x.example.org 2024 w{i}@y.example.org") for i in range(8)] + [(550, "id own_5 and w1@z.example.org 1999 own_6")]
    rows += [(1000 + i, f"see the page{i} word{i} u{i}@mail.example.com") for i in range(more)]
    texts = dict(rows)
    found = {i: [texts[i][a:b] for a, b in sorted(s)] for i, s in contexts(spark, rows).items()}
    want = {100 + i: [f"handle_{i}x"] for i in range(10)} | {400 + i: [f"handle_{i}x"] for i in range(10)}
    assert found == want | {450: ["newcomer7"], 550: ["own_5", "own_6"]}


def test_contexts_of_a_large_corpus(spark, monkeypatch):
    """A pattern with five different seeds is scored however many seeds the corpus has, listed or joined."""
    rows = [(i, f"write to rare contact: user{i}@mail.example.com and more") for i in range(8)]
    rows += [(100, "write to rare contact: handle_7x soon"), (101, "write to rare contact: handle_7x soon")]
    rows += [(1000 + i, f"see the page{i} word{i} u{i}@mail.example.com") for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.withColumn(pii.ROW_KEY, F.col("doc_id"))
    for listed in (pii.LISTED_PATTERNS, 0):
        monkeypatch.setattr(pii, "LISTED_PATTERNS", listed)
        _, patterns = pii.discover(pii.scan(keyed), keyed)
        assert [(r.pattern, r.seeds, r.total) for r in patterns.where("pattern like '%contact:'").collect()] == [("rare contact:", 9, 10)]
    assert contexts(spark, rows[:10]) == {100: [(23, 32)], 101: [(23, 32)]}


def test_near_duplicates(docs, none, small):
    got = near_dedup.classes(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.class_id, r.kept))
    assert len(got) == len(ROWS) and by[2] == [(1, False)] and by[3] == [(1, False)] and by[1] == [(1, True)]
    assert by[4] == [(4, True)] and by[5] == [(5, True)] and by[6] == [(6, True)] and by[None] == [(None, True)]
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, None, 7, 7, 8, 9]))
    assert near_dedup.classes(none).count() == 0 and near_dedup.deduplicate(none).count() == 0


def near_classes(rows):
    """The class of each (id, text), by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = folded_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_duplicate_classes(small):
    assert {r.doc_id: r.class_id for r in near_dedup.classes(small).collect()} == near_classes(texts())


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_quality(docs, none, labels, spark):
    got = {(r.doc_id, r.n_grams): r.selected for r in quality.select(docs, labels).collect()}
    assert got[4, 0] is False and got[5, 0] is False
    assert quality.select(none, labels).count() == 0
    every = quality.select(docs, labels.where("false")).where("n_grams > 0")
    assert every.where("not selected").count() == 0 and every.count() == 10
    kept = quality.keep_selected(docs, labels)
    assert kept.columns == docs.columns


def test_importance_resampling(spark):
    """Weights against plain counting, unit Gumbel noise, and the k greatest keys, which no cut of the weights gives."""
    documents, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.select(documents, labels, share=0.7).toPandas()
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    raw, target, of = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS), {}
    for r in documents.collect():
        of[r.doc_id] = x = quality.grams(quality.split([r.text]))[0]
        raw += np.bincount(x, minlength=quality.BUCKETS)
        target += np.bincount(x, minlength=quality.BUCKETS) * (r.doc_id in good)
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * quality.BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * quality.BUCKETS))
    some = got[got.n_grams > 0]
    assert np.allclose(some.log_weight, [ratio[of[i]].sum() for i in some.doc_id], atol=1e-6)
    noise = np.sort(some.key - some.log_weight)
    below = np.exp(-np.exp(-noise))
    assert np.abs(below - (np.arange(len(noise)) + 0.5) / len(noise)).max() < 1.63 / len(noise) ** 0.5  # Kolmogorov, 1 %
    k = math.ceil(0.7 * len(some))
    drawn = set(some.sort_values("key", ascending=False).doc_id[:k])
    assert drawn - set(some.doc_id[some.marked]) == set(got.doc_id[got.selected])
    assert drawn != set(some.sort_values("log_weight", ascending=False).doc_id[:k])


def test_grams():
    """The hashed n-grams are the words, marks and pairs of neighbours."""
    block = quality.split(["A b, a", None, "b"])
    buckets, starts = quality.grams(block)
    assert starts.tolist() == [0, 7, 7, 8]
    one = lambda *x: sorted(quality.grams(quality.split([" ".join(x)]))[0].tolist())
    assert sorted(buckets[:7].tolist()) == one("a", "b", ",", "a") and buckets[7:].tolist() == one("b")


def test_quality_accuracy(spark):
    """Held out: labels that the model hasn't seen."""
    d = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = labels.where("doc_id % 3 = 0")
    found = quality.select(documents, labels.where("doc_id % 3 <> 0")).join(held, "doc_id").toPandas()
    good, bad = found[(found.quality == 1) & (found.toxic == 0)], found[found.quality == 0]
    print("good kept", good.selected.mean(), "bad kept", bad.selected.mean())
    assert good.selected.mean() > 0.98 and bad.selected.mean() < 0.1
    # Toxic documents of good quality go, though by their weight they would stay.
    toxic = found[(found.quality == 1) & (found.toxic == 1)]
    print("toxic kept", toxic.selected.mean())
    assert (toxic.log_weight > good.log_weight.quantile(0.01)).mean() > 0.9 and toxic.selected.mean() < 0.25


def test_kth_largest(spark):
    xs = [float(x) for x in np.random.default_rng(3).normal(size=5000)] + [1.5] * 50
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 17, 400, 5050):
        assert quality.kth_largest(df, "x", k, small=10) == sorted(xs, reverse=True)[k - 1]


def test_packing(docs, none):
    got = packing.pack(docs, *tokenizer_files()).toPandas()
    assert sorted(got.groupby("doc_id", dropna=False).length.sum().tolist())[0] == 1
    assert got.groupby("sequence_id").length.sum().max() <= packing.LENGTH
    whole = got.groupby(["doc_id"]).apply(lambda g: g.length.sum() == g.drop_duplicates(["doc_tokens", "start", "sequence_id", "offset"]).length.sum(), include_groups=False)
    assert whole.all() and len(got[got.doc_id.isna()]) >= 1
    one = got[got.doc_id == 8].sort_values("start")
    assert np.concatenate(one.token_ids.tolist()).tolist()[-1] == packing.END_ID and one.length.sum() == one.doc_tokens.iloc[0]
    assert packing.pack(none, *tokenizer_files()).count() == 0


def test_packing_is_whole_and_tight(small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_files()[0])
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts()}
    got = packing.pack(small, *tokenizer_files()).toPandas().sort_values(["doc_id", "start"])
    for i, g in got.groupby("doc_id"):
        assert np.concatenate(g.token_ids.tolist()).tolist() == want[i]
    sizes = got.groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else packing.LENGTH - n for n in sizes)
    assert padding < 0.02 * sizes.sum()
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()


def test_packing_of_very_long_texts(spark, monkeypatch):
    """A stream is cut in slices within a document, and comes out whole and about as tight."""
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 6000)
    rows = [(1, "A few words. " * 9000), (2, None), (3, "z " * 30_000), (4, "short")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), *tokenizer_files()).toPandas().sort_values(["doc_id", "start"])
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_files()[0])
    for i, t in rows:
        assert np.concatenate(got[got.doc_id == i].token_ids.tolist()).tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1]
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.max() <= packing.LENGTH and sum(0 if n & (n - 1) == 0 else packing.LENGTH - n for n in sizes) < 0.02 * sizes.sum()


def test_repeats(docs, none, small):
    got = {}
    for r in substring_dedup.remove_repeats(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1][0][1] == 0 and got[2] == [(400, 400, empty)] and got[3][0][1] == 399 and got[4] == [(0, 0, empty)] and got[None][0][1] == 0 and got[8][0][1] == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert not [t for t in small.sparkSession.catalog.listTables() if t.name.startswith("tidemark_segments")]
    first, want = {}, {}
    for d, t in sorted(texts()):
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), d) < d:
                gone.update(range(k, k + 13))
        want[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(small).collect()} == want


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(20, 16))
    rows = []
    for i in range(200):
        v = base[i % 20] + r.normal(size=16) * r.choice([0.02, 0.3])
        rows.append((i, [float(x) for x in v], i % 3))
    rows += [(500 + i, rows[0][1], 0) for i in range(5)] + [(600, None, 0), (601, [], 0), (602, [0.0] * 16, 0), (603, [float("nan")] * 16, 0), (604, rows[0][1], None), (605, [1.0, None], 0), (606, [1.0, 2.0], 0), (None, rows[0][1], 0), (607, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"class": F.lit(1), "key": F.lit(2), "tab": F.lit(3)})
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_duplicates(df).collect()}
    ok = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i, _, _ in ok}, {i: i for i, _, _ in ok}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, va, la), (b, vb, lb) in itertools.combinations(ok, 2):
        if la == lb and va @ vb / np.sqrt((va @ va) * (vb @ vb)) >= 0.98:
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    for i, _, _ in ok:
        assert got[i] == (links[i], root(i), root(i) == i)
    assert all(got[i][:2] == (0, i) for i in (600, 601, 602, 603, 604, 605, 606, 607)) and got[None] == (0, None, True)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_embeddings_of_crowded_buckets(spark, monkeypatch):
    """Blocks that meet two by two give the links and components of whole buckets."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(9)
    base = r.normal(size=(3, 8))
    v = base[np.arange(240) % 3] + r.normal(size=(240, 8)) * 0.12
    df = spark.createDataFrame([(-i, [float(x) for x in v[i]], "x") for i in range(240)], "vec_id long, embedding array<double>, label string")
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.near_duplicates(df).collect()}
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    near = unit @ unit.T >= 0.98
    reach = np.linalg.matrix_power(near.astype(float), 64) > 0
    assert got == {-i: (int(near[i].sum()) - 1, -int(np.flatnonzero(reach[i]).max())) for i in range(240)}


def test_embedding_labels_with_commas(spark):
    """Neither a label that looks like numbers nor one that is a part of another links across labels."""
    rows = [(1, [1.0, 2.0], "a"), (2, [2.0], "a,1.0"), (3, [1.0, 2.0], "a,"), (4, [1.0, 2.0], ""), (5, [1.0, 2.0], "a")]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (1, 1)}


def test_sharding(docs, none, spark, tmp_path):
    got = sharding.assign(docs, 2000).toPandas()
    sizes = got.groupby("shard").n_bytes.sum()
    assert len(got) == len(ROWS) and (sizes[~got.groupby("shard").oversized.first()] <= 2000).all()
    names = sorted(sizes.index)
    assert not any(b.startswith(a) for a, b in itertools.pairwise(names))
    assert got[got.oversized].doc_id.isin([1, 2, 3, 8]).all()
    same = spark.createDataFrame([(1, "x" * 100)] * 60, "doc_id long, text string")
    spread = sharding.assign(same, 1000).toPandas().groupby("shard").n_bytes.sum()
    assert spread.max() <= 1000 and spread.sum() == 6000
    assert sharding.assign(none, 2000).count() == 0 and sharding.assign(docs).select("shard").distinct().count() == 1
    clashing = docs.withColumns({c: F.lit("x") for c in ("shard_bits", "__shard", "__h1", "__row", "n_bytes", "depth")})
    directory = sharding.write_shards(clashing, str(tmp_path / "s"), 2000).toPandas()
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.columns == [*clashing.columns, "shard_bits_"]
    assert back.count() == len(ROWS) and back.select("shard_bits_").distinct().count() == len(directory)


def test_licenses(docs, none, small):
    assert licenses.scan(docs).where("size(licenses) > 0").count() == 0 and licenses.scan(docs).count() == len(ROWS)
    assert licenses.scan(none).count() == 0
    want = {}
    for i, t in texts():
        w = folded_words(t)
        have = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for name, text in licenses.TEMPLATES.items():
            x = folded_words(text)
            shingles = {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
            if shingles and shingles <= have:
                want.setdefault(i, set()).add(name)
    got = {r.doc_id: {m.license for m in r.licenses} for r in licenses.scan(small).collect() if r.licenses}
    assert got == want and want


def test_licenses_of_like_wording(spark):
    """Each license and notice, amid other words, is reported as itself and as no like one on the same stretch."""
    gpl3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    names = sorted(licenses.TEMPLATES)
    rows = [(i, f"{LONG} {licenses.TEMPLATES[k]} {LONG}") for i, k in enumerate(names)]
    found = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame([*rows, (-1, gpl3)], "doc_id long, text string")).collect()}
    assert [m.license for m in found[-1]] == ["GPL-3.0-notice"]
    for i, k in enumerate(names):
        n = len(folded_words(licenses.TEMPLATES[k]))
        whole = [m for m in found[i] if m.last_word - m.first_word + 1 > n / 2]
        assert [(m.license, m.first_word, m.last_word) for m in whole] == [(k, 400, 399 + n)], k


def test_short_licenses(spark):
    rows = [(1, "x y. All rights reserved. z, all RIGHTS reserved"), (2, "all rights"), (3, "reserved"), (4, "SPDX-License-Identifier: MIT"), (5, "all rights not reserved"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 3):
        found = licenses.scan(df.repartition(n), licenses.TEMPLATES | licenses.SHORT | {"SPDX-MIT": "SPDX-License-Identifier: MIT"})
        got = {r.doc_id: [tuple(m) for m in r.licenses] for r in found.collect()}
        assert got == {1: [("all-rights-reserved-notice", 2, 4, 1, 1), ("all-rights-reserved-notice", 6, 8, 1, 1)], 4: [("SPDX-MIT", 0, 3, 1, 1)], 2: [], 3: [], 5: [], 6: []}
    shown = {r.doc_id for r in queries.QUERIES["op4_license_scan"](spark, DIR).where("matches like '%all-rights-reserved-notice%'").collect()}
    assert shown == {i for i, t in texts() if re.search(r"all rights reserved\.", t or "", re.I)} and shown


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracles(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, DIR).toPandas(), db.sql(oracles.ORACLES[name]).df()
    a, b = (sorted(map(str, x[sorted(x.columns)].astype(object).where(x.notna(), None).itertuples(index=False, name=None))) for x in (a, b))
    assert a == b


def contaminated(rows, items):
    """The ids of (id, text) rows of which one word in 20 or more lies in 13-word passages of the items."""
    windows = set()
    for text in items:
        w = folded_words(text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    out = set()
    for i, text in rows:
        w, hit = folded_words(text), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            out.add(i)
    return out


def redacted(text):
    out, at = [], 0
    for span in personal(text).split(",") if text and personal(text) else []:
        kind, a, b = span.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], f"<{kind.upper()}>"]
        at = max(at, int(b))
    return text if text is None else "".join(out) + text[at:]


def test_pipeline_by_brute_force(spark):
    """Each stage's rows against plain Python on that stage's own input."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    def after(name, docs):
        out = corpus_pipeline.store.save(stages[name](spark, docs, DIR), "stage")
        assert out.columns == columns
        return out, {r.doc_id: r for r in out.collect()}

    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    drawn = quality.select(docs, labels).toPandas()
    p, n = labels.toPandas().quality.mean(), labels.count()
    share = min(1.0, p + 2 * (p * (1 - p) / n) ** 0.5)
    with_grams = drawn[drawn.n_grams > 0].sort_values("key", ascending=False)
    top = with_grams[: math.ceil(share * len(with_grams) - 1e-9)]
    docs, kept = after("quality classifier", docs)
    assert kept == {i: rows[i] for i in top[~top.marked].doc_id}

    rows = kept
    docs, kept = after("MinHash near-dedup", docs)
    of = near_classes([(i, r.text) for i, r in rows.items()])
    assert kept == {i: r for i, r in rows.items() if of[i] == i} and len(kept) < len(rows)

    rows = kept
    docs, kept = after("benchmark decontamination", docs)
    bad = contaminated([(i, r.text) for i, r in rows.items()], [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()])
    assert kept == {i: r for i, r in rows.items() if i not in bad} and bad

    rows = kept
    docs, kept = after("PII", docs)
    assert {i: (r.text, r.n_chars) for i, r in kept.items()} == {i: (redacted(r.text), len(redacted(r.text))) for i, r in rows.items()}
    assert any(r.text != kept[i].text for i, r in rows.items())

    library = Tokenizer.from_file(tokenizer_files()[0])
    packed = stages["packing"](spark, docs, DIR).toPandas().sort_values(["doc_id", "start"])
    assert {i: np.concatenate(g.token_ids.tolist()).tolist() for i, g in packed.groupby("doc_id")} == {i: [*library.encode(r.text, add_special_tokens=False).ids, 1] for i, r in kept.items()}
    assert packed.groupby("sequence_id").length.sum().max() <= packing.LENGTH


def test_edits_and_similarity():
    """What 0.8 of five-word shingles means in edited words, and that such copies share a sketch."""
    r = np.random.default_rng(8)
    reach, met, near = {}, 0, 0
    for rate in (0.01, 0.02, 0.04, 0.08):
        linked = 0
        for _ in range(60):
            a = r.integers(0, 1 << 62, 300).astype(np.uint64)
            b = a.copy()
            at = r.choice(300, int(300 * rate), replace=False)
            b[at] = r.integers(0, 1 << 62, len(at))
            x, y = near_dedup.shingles(a), near_dedup.shingles(b)
            if near_dedup.similarity(near_dedup.Shingled(x), near_dedup.Shingled(y)):
                linked += 1
                met += bool(set(near_dedup.sketch(x).tolist()) & set(near_dedup.sketch(y).tolist()))
        near += linked
        reach[rate] = linked / 60
    print(reach, met, near)
    assert met >= 0.99 * near and reach[0.01] == 1.0 and reach[0.08] == 0.0
