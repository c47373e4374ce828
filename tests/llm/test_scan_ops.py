import collections
import functools
import gzip
import itertools
import math
import random
import resource
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.llm import hilbert, lm, packing, sketch, warc
from lumenfold.llm import queries as Q
from lumenfold.llm.common import fold, load, text_chunks, tidy, word_hashes, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab É.é \n世", max_size=12)), max_size=8), st.integers(1, 20))
def test_words(texts, limit):
    import re

    got = []
    for _, data, off in text_chunks(pa.array(texts, pa.string()), limit):
        s, e, at = words(data, off)
        got += [[bytes(data[s[k] : e[k]]) for k in range(at[i], at[i + 1])] for i in range(len(off) - 1)]
    assert got == [re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode()) for t in texts]


def test_word_hash_is_of_the_word():
    data = np.frombuffer("abc x abc É é abcd".encode(), np.uint8)
    d = fold(data)
    s, e, _ = words(d, np.array([0, len(d)]))
    h = word_hashes(d, s, e)
    assert h[0] == h[2] and h[3] == h[4] and len(set(h.tolist())) == 4


def _brute(texts):
    count, kids = defaultdict(lambda: [0, 0]), defaultdict(set)

    def bits(t):
        b = b"\0" * lm.DEPTH + t.encode()
        for i in range(lm.DEPTH, len(b)):
            v = 1
            for j in range(7, -1, -1):
                bit = (b[i] >> j) & 1
                yield b[i - lm.DEPTH : i], v, bit
                v = 2 * v + bit

    for t in texts:
        for c, v, bit in bits(t or ""):
            for d in range(lm.DEPTH + 1):
                k = (c[lm.DEPTH - d :], v)
                count[k][bit] += 1
                if d < lm.DEPTH:
                    kids[k].add((c[lm.DEPTH - d - 1 :], v))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    @functools.cache
    def pw(k):
        own = kt(*count[k])
        return own if len(k[0]) == lm.DEPTH else np.logaddexp(own, sum(pw(x) for x in kids[k])) - math.log(2)

    def p1(c, v, d):
        k = (c[lm.DEPTH - d :], v)
        a, b = count[k]
        q = (b + 0.5) / (a + b + 1)
        if d == lm.DEPTH:
            return q
        w = math.exp(kt(a, b) - math.log(2) - pw(k))
        return w * q + (1 - w) * p1(c, v, d + 1)

    def less(c, v, bit, d):
        """The bit's probability without this occurrence of it."""
        k = (c[lm.DEPTH - d :], v)
        a, b = count[k]
        q = ((b if bit else a) - 0.5) / (a + b)
        if d == lm.DEPTH:
            return q
        w = math.exp(kt(a, b) - math.log(2) - pw(k))
        return w * q + (1 - w) * less(c, v, bit, d + 1)

    plain = [None if t is None else sum(-math.log2(p1(c, v, 0) if b else 1 - p1(c, v, 0)) for c, v, b in bits(t)) for t in texts]
    loo = [None if t is None else sum(-math.log2(less(c, v, b, 0)) for c, v, b in bits(t)) for t in texts]
    return [None if x is None else (x, y) for x, y in zip(plain, loo)]


@pytest.mark.parametrize("slice_rows", [lm.SLICE, 20, 3])
def test_lm_brute_force(spark, slice_rows):
    texts = ["abab", "abcabcab", None, "", "zz é", "abab", "q\0q", "abcabcabab cabcabz"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm.score_documents(d, slice_rows).collect()}
    for i, want in enumerate(_brute(texts)):
        if want is None:
            assert got[i].bits is None and got[i].plain_bits is None
        else:
            assert (got[i].plain_bits, got[i].bits) == pytest.approx(want, abs=1e-6)
    assert got[3].bits_per_byte is None and got[2].n_bytes == 0
    assert got[0].bits_per_byte == pytest.approx(got[0].bits / 4) and got[0].plain_bits_per_byte == pytest.approx(got[0].plain_bits / 4)


def test_lm_slices_and_pieces(spark, sf_dir, monkeypatch):
    """Scores are the same to the last bit however the model and its contexts are cut."""
    d = load(spark, sf_dir, "documents").limit(40).repartition(2)
    text = [r.text for r in d.collect()]
    counts = {}
    for t in text:
        b = np.frombuffer((t or "").encode(), np.uint8)
        for g in lm.grams(b, np.array([0, len(b)])).tolist():
            counts[g] = counts.get(g, 0) + 1
    g = np.array(sorted(counts), np.uint64)
    g = g[np.argsort((g >> np.uint64(8)) & np.uint64(0xFFFF), kind="stable")]
    n = np.array([counts[x] for x in g.tolist()])
    near = ((g >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)
    batch = lambda: iter([pa.record_batch([pa.array(near), pa.array(g.view(np.int64)), pa.array(n)], names=["near", "gram", "n"])])
    key = lambda bs: sorted(r for b in bs for r in zip(*(c.to_pylist() for c in b.columns)))
    want = key(lm._roots(batch()))
    monkeypatch.setattr(lm, "_BATCH", 100)
    monkeypatch.setattr(lm, "_SPLIT", 50)
    assert key(lm._roots(batch())) == want
    monkeypatch.undo()
    rows = [sorted(lm.score_documents(d, k).collect(), key=repr) for k in (10**9, 20_000, 1000)]
    assert rows[0] == rows[1] == rows[2]


def test_lm_repeats_stand_apart(spark):
    """A text that stands elsewhere too costs fewer bits, which the plain score hardly shows."""
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    texts = [" ".join(r.choice(vocab) for _ in range(60)) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string")
    got = sorted(lm.score_documents(d).collect())
    twice, once = [x.bits_per_byte for x in got[:20]], [x.bits_per_byte for x in got[20:200]]
    assert max(twice) < sorted(once)[len(once) // 10]


def _peak(f):
    """What f() gives, and the most bytes that numpy held meanwhile."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _random_texts(n, size):
    rng = np.random.default_rng(5)
    return pa.array([rng.integers(97, 123, size, np.uint8).tobytes().decode() for _ in range(n)])


def test_lm_count_memory(monkeypatch):
    """A task merges its grams in two thirds of what arrays over all of them at once take, and to the same counts."""
    monkeypatch.setattr(lm, "_FLUSH", 1 << 19)
    monkeypatch.setattr(lm, "CHUNK", 1 << 17)
    texts = _random_texts(14, 1 << 16)
    got, peak = _peak(lambda: [pa.Table.from_batches([x]) for x in lm._count([pa.record_batch([texts], names=["text"])])])
    assert peak < 60 * (1 << 19)
    counts = Counter()
    for t in got:
        for g, n in zip(t["gram"].to_pylist(), t["n"].to_pylist()):
            counts[g] += n
    want = Counter(g for _, data, off in text_chunks(texts) for g in lm.grams(data, off).astype(np.int64).tolist())
    assert counts == want


def test_lm_grams_memory():
    """Grams take two words a byte, and their places in order less than five."""
    data, off = np.random.default_rng(3).integers(97, 123, 1 << 18, np.uint8), np.array([0, 1 << 18])
    g, peak = _peak(lambda: lm.grams(data, off))
    assert peak < 20 * len(data)
    (k, at), peak = _peak(lambda: lm._ranked(g))
    assert peak < 40 * len(data)
    assert (k[at] == g).all() and (k[1:] > k[:-1]).all()


def test_worker_gives_back():
    """What a task has freed doesn't stay with its worker."""

    def rss():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()

    def run(it):
        for b in it:
            held = [np.ones(1 << 15) for _ in range(400)]
            keep.append(np.ones(1 << 10))  # stands above what is freed
            del held
            yield b

    keep, b = [], pa.record_batch([pa.array([1])], names=["x"])
    assert list(tidy(run)([b])) == [b]
    before = rss()
    assert list(tidy(run)([b] * 3)) == [b] * 3
    assert rss() < before + (20 << 20)


def test_lm_odd(odd, none):
    assert lm.score_documents(odd).count() == odd.count()
    assert lm.score_documents(none).count() == 0


def test_kt_far():
    a, b = np.array([5000.0, 4095, 4096]), np.array([3.0, 4096, 1e7])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.log(math.pi) - math.lgamma(x + y + 1) for x, y in zip(a, b)]
    assert lm.log_kt(a, b) == pytest.approx(want, rel=1e-9)


def test_sketch_estimates(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(100000)]
    base = [r.choice(vocab) for _ in range(3000)]
    other = base[:2000] + [r.choice(vocab) for _ in range(1000)]
    part = base[500:2500]
    d = spark.createDataFrame([(0, " ".join(base)), (1, " ".join(other)), (2, " ".join(part)), (3, "A b c"), (4, "a B C")], "doc_id long, text string")
    s = {x.doc_id: x for x in sketch.sketch_documents(d, 256).collect()}
    assert s[3].sketch == s[4].sketch and s[3].n_shingles == 1 and s[3].distinct_shingles == 1
    assert s[0].distinct_shingles == pytest.approx(2996, rel=0.25)
    pair = spark.createDataFrame([(s[0].sketch, s[1].sketch, s[2].sketch)], "a array<long>, b array<long>, c array<long>")
    e = pair.select(sketch.resemblance(F.col("a"), F.col("b"), 256).alias("r"), sketch.containment(F.col("c"), F.col("a"), 256).alias("c"), sketch.merge(F.col("a"), F.col("b"), 256).alias("m"), sketch.resemblance(F.col("a"), F.col("a"), 256).alias("one")).first()
    assert e.r == pytest.approx(1996 / 3996, abs=0.1) and e.c > 0.8 and e.one == 1
    whole = {f"{a}" for a in s[0].sketch} | {f"{b}" for b in s[1].sketch}
    assert e.m == sorted(map(int, whole))[:256]


def test_sketch_brute_force(spark):
    texts = ["a b c d e f g", "a b", "", None, "a b c d e a b c d e a"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sketch.sketch_documents(d, 4).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        shingles = [tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))] if w else []
        assert got[i].n_shingles == len(shingles)
        assert len(got[i].sketch) == min(4, len(set(shingles))) and got[i].sketch == sorted(got[i].sketch)


def test_sketch_null_sides(spark):
    d = spark.createDataFrame([([1, 2, 3], None), (None, [1, 2, 3]), (None, None), ([], [5])], "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    got = d.select(sketch.merge(a, b, 2).alias("m"), sketch.resemblance(a, b, 2).alias("r"), sketch.containment(a, b, 2).alias("c"), sketch.distinct_count(a, 4).alias("n")).collect()
    assert [(r.m, r.r, r.c, r.n) for r in got] == [([1, 2], 0, 0, 3), ([1, 2], 0, 0, 0), ([], 0, 0, 0), ([5], 0, 0, 0)]


def _hashes(texts):
    """Every text's whole set of shingle hashes: a sketch that nothing is cut from."""
    return [set(s.tolist()) for s, _ in sketch.text_sketches(pa.array(texts, pa.string()), 1 << 40)]


def _estimate(s, k):
    return float(len(s)) if len(s) < k else (k - 1) / ((s[k - 1] + 2.0**63) / 2.0**64)


def _bottom(sets, k):
    return sorted(set().union(*sets))[:k]


def test_fingerprints_of_corpus_brute_force(spark):
    """Every row of the query, by plain sets, and the estimates against the exact shares."""
    k = 64
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(5000)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.choice([0, 3, 40, 300]))) for _ in range(120)]
    source = ["hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 4}" for i in range(120)]
    d = spark.createDataFrame([(f"id{i}", t, s, "x") for i, (t, s) in enumerate(zip(texts, source))], "doc_id string, text string, source string, sketch string")
    got = sketch.fingerprint_corpus(d, k).collect()
    sets = _hashes(texts)
    docs = {x.doc_id: x for x in got if x.level == "document"}
    for i, s in enumerate(sets):
        own = _bottom([s], k)
        assert docs[f"id{i}"].sketch == own and docs[f"id{i}"].source == source[i]
        assert docs[f"id{i}"].distinct_shingles == pytest.approx(_estimate(own, k))
    whole = set().union(*sets)
    (corpus,) = [x for x in got if x.level == "corpus"]
    assert corpus.sketch == _bottom(sets, k) and corpus.n_documents == 120 and corpus.n_shingles == sum(x.n_shingles for x in docs.values())
    assert corpus.distinct_shingles == pytest.approx(len(whole), rel=0.4)
    found = {x.source: x for x in got if x.level == "source"}
    assert set(found) == set(source)
    for name, x in found.items():
        own = [s for s, n in zip(sets, source) if n == name]
        a, u = _bottom(own, k), corpus.sketch
        assert x.sketch == a and x.n_documents == len(own)
        r = len(set(a) & set(u) & set(_bottom([set(a), set(u)], k))) / k
        assert x.resemblance == pytest.approx(r) and x.containment == pytest.approx(min(1, r))
        assert x.containment == pytest.approx(len(set().union(*own)) / len(whole), abs=0.25)


def test_sketch_odd(odd, none):
    assert sketch.sketch_documents(odd).count() == odd.count()
    assert sketch.sketch_documents(none).count() == 0
    assert sketch.fingerprint_corpus(odd).count() == odd.count() + 4 + 1
    (r,) = sketch.fingerprint_corpus(none).collect()
    assert (r.level, r.n_documents, r.sketch, r.distinct_shingles) == ("corpus", 0, [], 0)


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 12), st.data())
def test_windows_are_best(capacity, data):
    sizes = data.draw(st.lists(st.integers(1, capacity), min_size=1, max_size=12))
    price = data.draw(st.lists(st.sampled_from([0, 2, 5]), min_size=len(sizes), max_size=len(sizes)))
    n = len(sizes)
    best = [0] + [10**9] * n
    for j in range(1, n + 1):
        for i in range(j):
            t = sum(sizes[i:j])
            if t <= capacity:
                best[j] = min(best[j], best[i] + capacity - t + (price[j - 1] if j < n else 0))
    cost, cuts = packing.cut_windows(sizes, price, capacity)
    assert cost == best[n] and cuts[-1] == n - 1
    a = paid = 0
    for c in cuts:
        assert (t := sum(sizes[a : c + 1])) <= capacity
        paid += capacity - t + (price[c] if c < n - 1 else 0)
        a = c + 1
    assert paid == cost


def test_packing_covers_every_token(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["wort ", "a ", "end. ", "é!\n", "\n", "x? "]) for _ in range(r.randint(0, 80))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = packing.pack_documents(d, capacity=32, shard_tokens=2000).collect()
    pieces = defaultdict(list)
    for w in sorted(got, key=lambda w: (w.shard, w.window)):
        assert w.n_tokens + w.padding == 32 and w.padding >= 0
        assert w.doc_ids == sorted(w.doc_ids)
        assert sum(len(texts[i][a:b].split()) for i, a, b in zip(w.doc_ids, w.starts, w.ends)) == w.n_tokens
        for i, a, b in zip(w.doc_ids, w.starts, w.ends):
            pieces[i].append((a, b))
    assert sorted(pieces) == [i for i, t in enumerate(texts) if t.split()]
    for i, ps in pieces.items():
        assert ps[0][0] == 0 and texts[i][ps[-1][1] :].strip() == ""
        assert all(x[1] == y[0] for x, y in zip(ps, ps[1:]))


def test_packing_hard_cut(spark):
    d = spark.createDataFrame([(1, "w " * 70)], "doc_id long, text string")
    got = packing.pack_documents(d, capacity=32).orderBy("window").collect()
    assert [w.n_tokens for w in got] == [32, 32, 6] and [w.cut for w in got] == ["hard", "hard", "document"]


def test_packing_hard_ranges(spark):
    """Hard windows hold in their ranges the tokens that they count."""
    texts = ["w " * 70, "é  " * 32 + "b. " + "lang " * 100 + "\nend", "a b. c", "ü " * 64]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack_documents(d, capacity=32).orderBy("window").collect()
    assert "hard" in {w.cut for w in got}
    read = defaultdict(list)
    for w in got:
        assert sum(len(texts[i][a:b].split()) for i, a, b in zip(w.doc_ids, w.starts, w.ends)) == w.n_tokens <= 32
        for i, a, b in zip(w.doc_ids, w.starts, w.ends):
            read[i] += texts[i][a:b].split()
    assert read == {i: t.split() for i, t in enumerate(texts)}


def test_packing_sparse_ids(spark):
    """Far-apart ids are packed as near ones are, and into the same windows."""
    got = []
    for gap in (1, 10**15 + 7):
        d = spark.createDataFrame([((i - 150) * gap, "wort " * (1 + i % 9)) for i in range(300)], "doc_id long, text string").repartition(7)
        w = packing.pack_documents(d, capacity=32, shard_tokens=500).orderBy("shard", "window").collect()
        got.append([(x.shard, x.window, x.n_tokens, [i // gap for i in x.doc_ids]) for x in w])
    assert got[0] == got[1]
    assert len({x[0] for x in got[0]}) == 3
    assert [i for x in got[0] for i in dict.fromkeys(x[3])] == sorted(i for x in got[0] for i in dict.fromkeys(x[3]))


def _windows(docs, capacity, shard_tokens, cut=packing.CUT_PENALTY, hard=packing.HARD_PENALTY):
    """Packing by the plain recurrence: docs are (id, text) in order."""
    import re

    shards, total = defaultdict(list), 0
    for i, t in docs:
        spans = [m.span() for m in re.finditer(r"[^ \t\n\v\f\r]+", t or "")]
        size, own = 0, []
        for k, (x, y) in enumerate(spans):
            size += 1
            last = k == len(spans) - 1
            stop = last or t[y - 1] in ".!?" or "\n" in t[y : spans[k + 1][0]]
            if stop or size == capacity:
                own.append((i, size, y, "document" if last else "sentence" if stop else "hard"))
                size = 0
        if spans:
            shards[total // shard_tokens].append(own)
            total += len(spans)
    out = []
    for s, groups in shards.items():
        u = [x for g in groups for x in g]
        price = {"document": 0, "sentence": cut, "hard": hard}
        best, back = [0] + [10**12] * len(u), [0] * (len(u) + 1)
        for j in range(1, len(u) + 1):
            for i in range(j - 1, -1, -1):
                n = sum(x[1] for x in u[i:j])
                if n > capacity:
                    break
                c = best[i] + capacity - n + (price[u[j - 1][3]] if j < len(u) else 0)
                if c <= best[j]:  # of equal costs the longest window
                    best[j], back[j] = c, i
        cuts, j = [], len(u)
        while j:
            cuts.append((back[j], j))
            j = back[j]
        for w, (i, j) in enumerate(reversed(cuts)):
            pieces = []
            for k in range(i, j):
                start = u[k - 1][2] if k and u[k - 1][0] == u[k][0] and u[k - 1][3] != "document" else 0
                if pieces and k > i and u[k - 1][3] != "document":
                    pieces[-1][2] = u[k][2]
                else:
                    pieces.append([u[k][0], start, u[k][2]])
            n = sum(x[1] for x in u[i:j])
            out.append((s, w, n, capacity - n, u[j - 1][3], *(tuple(x) for x in zip(*pieces))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: f"d{i:05}", lambda i: None if i < 3 else i])
def test_packing_brute_force(spark, ids):
    """Every window of the query, whatever the type of the ids."""
    r = random.Random(8)
    texts = ["".join(r.choice(["wort ", "a ", "end. ", "é!\n", "\n", "x? ", "lang " * 40]) for _ in range(r.randint(0, 30))) for _ in range(80)]
    if ids(0) is None:  # equal ids are ordered by their lengths
        texts[0], texts[1], texts[2] = "a b.", "a b.", "a b."
    rows = [(ids(i), t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, f"doc_id {'string' if isinstance(ids(9), str) else 'long'}, text string").repartition(4)
    got = sorted(((w.shard, w.window, w.n_tokens, w.padding, w.cut, tuple(w.doc_ids), tuple(w.starts), tuple(w.ends)) for w in packing.pack_documents(d, capacity=32, shard_tokens=700).collect()), key=repr)
    assert got == _windows(rows, 32, 700) and {x[4] for x in got} == {"hard", "sentence", "document"}


def test_packing_query_brute_force(spark, sf_dir):
    """The registered query over its whole table, with production parameters."""
    docs = [(r.doc_id, r.text) for r in load(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    got = sorted(((w.shard, w.window, w.n_tokens, w.padding, w.cut, tuple(w.doc_ids), tuple(w.starts), tuple(w.ends)) for w in Q.QUERIES["op9_packing"](spark, sf_dir).collect()), key=repr)
    assert got == _windows(docs, packing.CAPACITY, packing.SHARD_TOKENS)


def test_packing_odd(odd, none):
    got = packing.pack_documents(odd).collect()
    total = sum(len((r.text or "").split()) for r in odd.collect())
    assert sum(w.n_tokens for w in got) == total
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 3), (3, 3), (4, 2)])
def test_hilbert_curve(dims, bits):
    g = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    h = hilbert.hilbert_index(g, bits)
    assert sorted(h) == list(range(len(g)))
    assert (np.abs(np.diff(g[np.argsort(h)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("dims,bits,more", [(2, 2, 1), (3, 2, 2)])
def test_hilbert_prefix(dims, bits, more):
    """A finer curve runs through the cells of the coarse one one after another."""
    g = np.array(list(itertools.product(range(1 << bits + more), repeat=dims)))
    coarse = (g >> more)[np.argsort(hilbert.hilbert_index(g, bits + more))]
    runs = 1 + (np.diff(coarse, axis=0) != 0).any(1).sum()
    assert runs == 1 << bits * dims


def _shards(rows, bits, shard_size):
    """Cells by rank, the curve by walking all cells in use, runs by one running sum."""
    def cells(values, number):
        def fine(v):
            if not number:
                return "" if v is None else "v" + v
            return -(1 << 40) if v is None else (1 if v > 0 else -1 if v < 0 else 0) * math.floor(math.log2(abs(v) + 1) * 46)

        keys = [fine(v) for v in values]
        n, out, before = collections.Counter(keys), {}, 0
        for k in sorted(n, key=lambda x: x.encode() if isinstance(x, str) else x):
            out[k] = min((2 * before + n[k]) * (1 << bits) // (2 * len(keys)), (1 << bits) - 1)
            before += n[k]
        return [out[k] for k in keys]

    c = np.array(list(zip(cells([r[3] for r in rows], True), cells([r[1] for r in rows], False), cells([r[2] for r in rows], False))))
    h = hilbert.hilbert_index(c, bits).tolist()
    w = collections.Counter()
    for x, r in zip(h, rows):
        w[x] += max(r[3] or 0, 0) + 1
    base, total = {}, 0
    for x in sorted(w):
        base[x] = (total // shard_size, -(-w[x] // shard_size))
        total += w[x]
    return {r[0]: (x, base[x]) for x, r in zip(h, rows)}


def test_shards_brute_force(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, r.choice(["en", "en", "de", None]), "hot" if i % 3 == 0 else f"s{r.randrange(300)}", r.choice([None, -4, 0, r.randrange(9), r.randrange(5000)])) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long")
    want = _shards(rows, hilbert.BITS, 100_000)
    got = hilbert.shard_documents(d.withColumn("shard", F.lit("x")), str(tmp_path / "s"), shard_size=100_000).collect()
    assert len(got) == 3000
    for x in got:
        h, (first, split) = want[x.doc_id]
        assert x.hilbert_index == h and first <= x.shard < first + split
    by = defaultdict(list)
    for x in got:
        by[x.shard].append(rows[x.doc_id])
    for x in got:
        own = by[x.shard]
        some = [v[3] for v in own if v[3] is not None]
        assert x.shard_documents == len(own) and (x.min_n_chars, x.max_n_chars) == (min(some), max(some))


def test_shards(spark, tmp_path):
    rows = [(i, ["en", "de", None][i % 3], f"s{i % 11}", (i * 37) % 5000) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long")
    w = hilbert.write_shards(d, str(tmp_path / "out"), shard_size=1_000_000)
    a = w.toPandas()
    assert sorted(a.doc_id) == list(range(4000))
    by = a.groupby("shard")
    assert len(by) >= 10 and by.n_chars.sum().max() < 1_300_000
    # runs of the curve: shards don't interleave
    span = by.hilbert_index.agg(["min", "max"]).sort_index()
    assert (span["max"].to_numpy()[:-1] <= span["min"].to_numpy()[1:]).all()
    # each shard's rows lie in files of its own, in order of the curve
    assert w.select("shard", F.input_file_name().alias("f")).distinct().count() == len(by)


def test_shards_prune_better_than_one_key(spark):
    r = random.Random(1)
    d = spark.createDataFrame([(i, r.choice(["en", "de", "fr", "es"]), f"s{r.randrange(16):02}", r.randrange(5000)) for i in range(4000)], "doc_id long, lang string, source string, n_chars long")
    a = hilbert.assign_shards(d, shard_size=100_000).toPandas()
    # a filter on any one of the columns reads well under all shards
    n = a.shard.nunique()
    assert a[a.lang == "fr"].shard.nunique() < 0.6 * n
    assert a[a.n_chars.between(1000, 1300)].shard.nunique() < 0.6 * n
    assert a[a.source == "s07"].shard.nunique() < 0.6 * n


def test_shards_odd(odd, none):
    a = hilbert.assign_shards(odd)
    assert a.columns == [*odd.columns, "_hilbert_index", "_shard"] and a.count() == odd.count()
    assert hilbert.assign_shards(odd.withColumn("doc_id", F.col("doc_id").cast("string")), shard_size=20).count() == odd.count()
    assert hilbert.assign_shards(none).count() == 0


@pytest.mark.parametrize("split", [100, 333, 5000, 1 << 20])
def test_warc_round_trip(spark, split):
    inner = warc.record(9, "a", "b").decode()
    rows = [(1, None, None), (2, "", "x" * 1000 + inner * 5), (None, "u\r\n%0A", "é"), (2, "", ""), (2, "", ""), (3, "z", warc.record(4, "http", "q" * 500).decode() * 50), (4, "WARC/1.0", "WARC/1.0\r\nContent-Length: 3\r\n\r\n")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("path", "off", "bytes")}).repartition(2)
    got = warc.archive_round_trip(spark, d, split).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))


@pytest.mark.parametrize("split", [50_000, 1 << 20])
def test_warc_long_url(spark, split):
    """A header of any length is read whole, and the pages behind it aren't lost."""
    rows = [(1, "u", "a"), (2, "data:" + "xé%" * 50_000, "b"), (3, "v", "c" * 1000), (4, "WARC/1.0 " * 25_000, ""), (5, None, "WARC/1.0" * 20_000), (6, "w", "d")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.archive_round_trip(spark, d, split).collect()
    assert sorted(map(tuple, got)) == rows


def test_warc_empty(spark):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(spark, d).count() == 0


def test_warc_broken_file(spark, tmp_path):
    """What follows a broken record isn't reached; a file that doesn't begin with a record has none."""
    good = warc.record(1, "u", "a") + warc.record(2, "u", "b")
    (tmp_path / "a.warc").write_bytes(good + b"garbage" + warc.record(3, "u", "c"))
    (tmp_path / "b.warc").write_bytes(b"x" + good)
    files = spark.createDataFrame([(str(tmp_path / f), (tmp_path / f).stat().st_size, 0) for f in ("a.warc", "b.warc")], "path string, bytes long, records long")
    assert sorted(r.record_id for r in warc.read_archives(files, 64).collect()) == ["<urn:page:1>", "<urn:page:2>"]


def test_warc_decoy_chain(spark, tmp_path):
    """A payload whose fake records chain on into the real ones is still told from them."""
    fake = warc.record(66, "evil", "zz")
    (tmp_path / "d.warc").write_bytes(warc.record(1, "u", fake.decode() * 3) + warc.record(2, "u", "b"))
    p = tmp_path / "d.warc"
    files = spark.createDataFrame([(str(p), p.stat().st_size, 2)], "path string, bytes long, records long")
    for split in (50, 150, 10_000):
        assert sorted(r.record_id for r in warc.read_archives(files, split).collect()) == ["<urn:page:1>", "<urn:page:2>"]


def _public(i, body, fields=(), http=None):
    """A record as crawlers write them."""
    block = (http + b"\r\n\r\n" + body) if http is not None else body
    kind = b"application/http; msgtype=response" if http is not None else b"text/plain"
    head = [b"WARC/1.1", b"warc-type: response", b"WARC-RECORD-ID: <urn:uuid:%08d-0000>" % i, b"Warc-Target-Uri:  http://x/%d%%20y " % i, b"Content-Type: " + kind, *fields, b"CONTENT-LENGTH:%d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


PUBLIC = [
    (_public(0, "plain é".encode()), "plain é"),
    (_public(1, "latin é".encode("latin-1")), "latin é"),
    (_public(2, bytes(range(256)), [b"WARC-Truncated: length"]), bytes(range(256)).decode("latin-1")),
    (_public(3, "<p>ключ".encode("cp1251"), http=b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\ncontent-type: text/html; charset=windows-1251"), "<p>ключ"),
    (_public(4, b"odd", http=b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=no-such"), "odd"),
    (_public(5, b"", [b"X-Long: " + b"z" * 70_000, b"X-Folded: a", b" b"]), ""),
    (_public(6, _public(66, b"inner")), _public(66, b"inner").decode()),
]


@pytest.mark.parametrize("split", [300, 1 << 20])
@pytest.mark.parametrize("zipped", [0, 1, 2])
def test_warc_public_records(spark, tmp_path, split, zipped):
    """Any record id, names in any case, other charsets, bytes that are no text, HTTP heads, gzip members of one or two records."""
    parts = [r for r, _ in PUBLIC]
    if zipped == 2:
        parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    body = b"".join(gzip.compress(p) for p in parts) if zipped else b"".join(parts)
    p = tmp_path / ("a.warc.gz" if zipped else "a.warc")
    p.write_bytes(body)
    files = warc.archive_files(spark, str(tmp_path))
    got = {r.record_id: r for r in warc.read_archives(files, split).collect()}
    assert {k: v.html for k, v in got.items()} == {f"<urn:uuid:{i:08}-0000>": t for i, (_, t) in enumerate(PUBLIC)}
    assert all(r.type == "response" and r.url == f"http://x/{int(r.record_id[10:18])}%20y" for r in got.values())
    assert warc.read_archives(files, split).filter(warc.page_id().isNotNull()).count() == 0


def test_warc_string_ids_and_blanks(spark, tmp_path):
    rows = [("a b", " u ", "x"), (" \n%", "\t", None), (None, "%20", ""), ("é>", None, "<urn:page:1>")]
    d = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = warc.archive_round_trip(spark, d).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))


def test_warc_damaged_gzip(spark, tmp_path):
    """A member that ends too soon ends its file; one that is no WARC text is no candidate."""
    good = gzip.compress(_public(0, b"x" * 500))
    (tmp_path / "a.warc.gz").write_bytes(good + gzip.compress(b"other") + good)
    (tmp_path / "b.warc.gz").write_bytes(good + gzip.compress(_public(1, random.Random(1).randbytes(5000)))[:-40])
    files = warc.archive_files(spark, str(tmp_path))
    assert warc.read_archives(files, 200).count() == 2
