"""Parts of the operators that need no Spark, against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontaminate, licenses, near_dedup, packing, quality, substring_dedup, words
from tidemark.llm.queries import tokenizer_files


def test_folded_words():
    assert words.folded_words("Ab-c9 É_ñ\x00z") == ["ab".encode(), b"c9", "É".encode(), "ñ".encode(), b"z"]
    assert words.folded_words(None) == words.folded_words("") == words.folded_words(" .,") == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 40))))
def test_varints(xs):
    assert words.unpack_varints(words.pack_varints(np.array(xs, np.int64))).tolist() == xs


def _lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_alignment(a, b):
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    assert near_dedup.aligned(x, y, 100) == near_dedup._dense(x, y, 100) == _lcs(a, b)


def test_sketches_find_copies():
    r = np.random.default_rng(1)
    hits = 0
    for n in [6, 12, 30, 70, 90, 400] * 20:
        a = r.integers(0, 1 << 62, n).astype(np.uint64)
        b = a.copy()
        b[: max(0, int(n * 0.09))] = r.integers(0, 1 << 62, max(0, int(n * 0.09)))
        hits += bool(set(near_dedup.sketch(a).tolist()) & set(near_dedup.sketch(b).tolist()))
    assert hits == 120


def _recompressed(docs, n_segments, buckets=5):
    """remove_repeats() without Spark: the removed positions of each document."""
    parsed = [substring_dedup.Parsed([d for d, _ in s], [t for _, t in s]) for s in (docs[i::n_segments] for i in range(n_segments)) if s]

    def answers(sent):
        out = []
        for b in {x[0] for x in sent}:
            batch = substring_dedup._sent_batch([x for x in sent if x[0] == b])
            out += substring_dedup._answered(pa.Table.from_batches([batch])).to_pylist()
        return out

    def own(rows, k):
        return [r for r in rows if r["segment"] == k]

    sent = []
    for k, p in enumerate(parsed):
        high, low, _, _ = substring_dedup._high_and_low(p, buckets)
        sent += [*high.rows(k, substring_dedup.HIGH_KIND), *low.rows(k, substring_dedup.LOW_KIND)]
    first, sent = answers(sent), []
    for k, p in enumerate(parsed):
        _, at = substring_dedup._open_windows(p, buckets, own(first, k))
        sent += list(substring_dedup._window_sending(p, at, buckets).rows(k, substring_dedup.WINDOW_KIND))
    second, out = answers(sent), {}
    for k, p in enumerate(parsed):
        settled, at = substring_dedup._open_windows(p, buckets, own(first, k))
        s = substring_dedup._window_sending(p, at, buckets)
        again = s.answers(own(second, k), substring_dedup.WINDOW_KIND)[s.of] | (p.doc_ids[p.block.owner[at]] > s.least[s.of])
        start = np.concatenate([settled, at[again]])
        gone = p.covered(start, start + substring_dedup.WINDOW)
        for i, d in enumerate(p.doc_ids.tolist()):
            out[d] = np.flatnonzero(gone[p.block.starts[i] : p.block.starts[i + 1]]).tolist()
    return out


def repeats(docs):
    first, out = {}, {}
    for d, text in sorted(docs):
        w, gone = (text or "").split(), set()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), d) < d:
                gone.update(range(k, k + 13))
        out[d] = sorted(gone)
    return out


def test_recompression():
    r = random.Random(5)
    for _ in range(250):
        letters = [str(x) for x in range(r.choice([1, 2, 3, 5, 50]))]
        base = [r.choice(letters) for _ in range(r.randint(1, 120))]
        docs = []
        for d in r.sample(range(100), r.randint(1, 7)):
            w = []
            for _ in range(r.randint(0, 4)):
                x = r.randint(0, len(base) - 1)
                w += base[x : x + r.randint(1, 60)] if r.random() < 0.6 else [r.choice(letters) for _ in range(r.randint(0, 20))]
            docs.append((d, " ".join(w)))
        assert _recompressed(docs, r.randint(1, 3)) == repeats(docs)


@pytest.mark.parametrize("n", [0, 1, 8, 1000])
def test_last_pass_gets_what_was_found(n):
    """Removal needs a segment's words and what its windows' pass found, but no symbols."""
    r = np.random.default_rng(n)
    settled, at = (np.flatnonzero(r.random(n) < 0.3) for _ in range(2))
    rows = [substring_dedup._found_row(k, settled if k else at, at, n, 7) for k in range(3)]
    back: list[dict] = []
    for b in {x[0] for x in rows}:
        back += substring_dedup._answered(pa.Table.from_batches([substring_dedup._sent_batch([x for x in rows if x[0] == b])])).to_pylist()
    for k in range(3):
        found = substring_dedup._found([x for x in back if x["segment"] == k], n)
        assert [x.tolist() for x in found] == [(settled if k else at).tolist(), at.tolist()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x0b\x0c\r\x1c\x85a"), st.characters(exclude_categories=["Cs"])))), max_size=6))
def test_count_words(texts):
    assert words.count_words(texts) == sum(len(words.plain_words(t)) for t in texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.a1é<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encoder(text):
    assert encoder().ids(text).tolist() == library().encode(text, add_special_tokens=False).ids


_known = {}


def encoder():
    if "e" not in _known:
        _known["e"] = packing.Encoder(*tokenizer_files())
    return _known["e"]


def library():
    if "t" not in _known:
        from tokenizers import Tokenizer

        _known["t"] = Tokenizer.from_file(tokenizer_files()[0])
    return _known["t"]


def test_encoder_special_token():
    text = "a <|endoftext|> it's  b"
    assert encoder().ids(text).tolist() == library().encode(text, add_special_tokens=False).ids


def test_cuts_are_optimal():
    r = random.Random(3)
    for _ in range(30):
        docs = np.cumsum([r.randint(1, 90) for _ in range(r.randint(1, 8))])
        total = int(docs[-1])
        ends = np.array(sorted(r.sample(range(1, total + 1), min(total, 6))))
        length = 64
        at = packing.cuts(ends, docs, length)
        assert at[-1] == total and all(b - a <= length for a, b in zip([0, *at], at, strict=False))
        kind = {}
        edges = sorted({0, *ends.tolist(), *docs.tolist()})
        for a, b in zip(edges, edges[1:], strict=False):
            kind |= {p: packing.TRUNCATION for p in range(a + packing.GRID, b, packing.GRID)}
        kind |= {int(p): packing.SENTENCE_CUT for p in ends} | {int(p): 0.0 for p in docs}
        pad = lambda n: 0 if n == 32 else length - n
        best = {0: 0.0}
        for p in sorted(kind):
            best[p] = kind[p] + min(best[q] + pad(p - q) for q in best if p - q <= length)
        cost = sum(pad(b - a) + kind[b] for a, b in zip([0, *at], at, strict=False))
        assert abs(cost - best[total]) < 1e-9


def _segment(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([b"k"] * len(texts)), pa.array(texts)], names=["id", "key", "text"])
    block = words.WordBlock(words.folded_words(t) for t in texts)
    order = np.argsort(block.ids, kind="stable")
    freqs = np.bincount(block.ids, minlength=len(block.terms))
    gaps, first = np.diff(order, prepend=0), np.cumsum(freqs) - freqs
    gaps[first] = order[first]
    assert batch.num_rows == len(texts)
    return {"doc_words": block.counts.tolist(), "terms": block.terms, "freqs": freqs.tolist(), "postings": words.pack_varints(gaps)}


def test_phrases_of_intersected_lists():
    """Every occurrence of every window, against plain comparison."""
    r = random.Random(7)
    for _ in range(150):
        letters = [f"t{x}" for x in range(r.choice([1, 2, 4, 12]))]
        texts = [" ".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 4))]
        items = [(str(k), " ".join(r.choice(letters) for _ in range(r.randint(0, 20))).encode().split()) for k in range(r.randint(0, 5))]
        items += [(None, items[0][1])] if items else []
        for text in texts[:2]:
            w = text.encode().split()
            items.append(("cut", w[3 : r.randint(3, 30)]))
        win = decontaminate.Windows(items)
        seg = decontaminate.Segment(_segment(texts), {w: i for i, w in enumerate(win.words)})
        got = sorted((int(at), win.items(int(x))) for ws, ats in decontaminate.phrase_starts(seg, win, 64) for x, at in zip(ws, ats, strict=True))
        want, base = [], 0
        of = {}
        for name, w in items:
            for k in range(max(1, len(w) - 12) if w else 0):
                of.setdefault(tuple(w[k : k + 13]), set()).update([] if name is None else [name])
        for text in texts:
            w = text.encode().split()
            want += [(base + i, sorted(names)) for x, names in of.items() for i in range(len(w) - len(x) + 1) if tuple(w[i : i + len(x)]) == x]
            base += len(w)
        assert sorted((a, sorted(set(n))) for a, n in got) == sorted(want)


def test_windows_are_small():
    """A block of windows takes some 110 bytes a window, and an item's name is told however often it occurs."""
    win = decontaminate.Windows((str(k), f"a{k} b{k % 7} c d e f g h i j k l m n o".encode().split()) for k in range(2000))
    size = sum(x.nbytes for x in (win.terms, win.lengths, win.item_of, win.item_at, win.filed, win.filed_at))
    assert len(win.terms) == 2000 + 7 + 1 and size < 120 * len(win.terms)
    assert len(win.items(int(np.flatnonzero(win.item_at[1:] - win.item_at[:-1] == 2000)[0]))) == 2000


def test_best_cut():
    good, bad = np.linspace(0.1, 1, 100), np.linspace(-1, 0, 50)
    assert 0 <= quality.best_cut(good, bad) <= 0.1
    assert quality.best_cut(np.array([]), bad) == -np.inf


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 100, 50)
    for width, stride in ((1, 1), (4, 1), (7, 3), (60, 2)):
        assert licenses.sliding_min(x, width, stride).tolist() == [x[i : i + width].min() for i in range(0, 50, stride)]


def test_license_bands_guarantee():
    known = licenses.Templates({str(n): " ".join(f"w{n}-{i}" for i in range(n)) for n in (5, 6, 8, 13, 40, 200, 257)})
    for (width, _), members in known.classes.items():
        for k in members:
            assert (1 - licenses.least_similarity(len(known.shingles[k]), width)) ** known.bands[width, _] <= licenses.MISS


def test_licenses_at_the_threshold():
    """Altered copies are found just when they hold 80 % of the shingles."""
    r = random.Random(11)
    texts = {f"t{n}": " ".join(f"w{n}x{i}" for i in range(n)) for n in (5, 9, 24, 60, 150, 700)}
    known = licenses.Templates(texts)
    near, seen = 0, [0, 0]
    for _ in range(60):
        for name, text in texts.items():
            w = text.split()
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                w[r.randrange(len(w))] = f"changed{r.random()}"
            own = text.split()
            have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            held = sum(tuple(own[i : i + 5]) in have for i in range(len(own) - 4))
            noise = [" ".join(f"n{r.random()}" for _ in range(r.randint(0, 900))) for _ in range(2)]
            block = words.HashedWords([words.folded_words(" ".join([noise[0].replace(".", "y"), *(x.replace(".", "z") for x in w), noise[1].replace(".", "y")]))])
            found = [m[4] for m in licenses._scan(block, known)[0] if m[0] == name]
            assert found == ([held] if held >= 0.8 * (len(own) - 4) - 1e-9 else []), (name, held)
            near += held < len(own) - 4
            seen[bool(found)] += 1
    assert near > 150 and min(seen) > 50


def test_license_scan_finds_planted():
    r = random.Random(1)
    known = licenses.Templates(licenses.TEMPLATES)
    texts, planted = [], []
    for k in known.names * 4:
        w = licenses.TEMPLATES[k].split()
        if len(w) > 40:
            w[len(w) // 2] = "changed"
        noise = [[f"w{r.randint(0, 9999)}" for _ in range(r.randint(0, 90))] for _ in range(2)]
        texts.append(" ".join([*noise[0], *w, *noise[1]]))
        planted.append((k, len(noise[0])))
    block = words.HashedWords(words.folded_words(t) for t in texts)
    for got, (k, at) in zip(licenses._scan(block, known), planted, strict=True):
        assert [(m[0], m[1]) for m in got if m[0] == k] == [(k, at)]
        assert all(m[4] >= licenses.CONTAINMENT * m[3] for m in got)
    assert zlib.crc32(b"") == 0


@pytest.mark.parametrize("length", [1, 2, 16, 31, 33])
def test_cuts_of_short_sequences(length):
    rng = np.random.default_rng(length)
    for _ in range(20):
        docs = np.cumsum(rng.integers(1, 200, rng.integers(1, 9)))
        at = packing.cuts(np.unique(rng.integers(1, docs[-1] + 1, 9)), docs, length)
        assert at[-1] == docs[-1] and 0 < np.diff([0, *at]).min() and np.diff([0, *at]).max() <= length
