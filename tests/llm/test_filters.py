import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import common, mixing, packing, quality, simhash, toxicity
from lumenfold.llm.common import load


def _distance(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_brute_force():
    terms = ("abc", "abcab", "bacba", "cabcabcabc", "aabbaabbaab")
    auto = toxicity.Automaton(terms)
    r = random.Random(7)
    for n in range(8000):
        w = [r.choice("abcd") for _ in range(r.randint(1, 13))] if n % 2 else list(r.choice(terms))
        for _ in range(r.randint(0, 3) if n % 2 == 0 else 0):
            i, k = r.randrange(len(w)), r.randrange(4)
            if k == 0:
                w.insert(i, r.choice("abcd"))
            elif k == 1 and len(w) > 1:
                w.pop(i)
            elif k == 2:
                w[i] = r.choice("abcd")
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        word = "".join(w)
        _, _, q, _ = auto.run(auto.classes[[ord(c) for c in word]])
        want = min(((d, t) for t in terms if (d := _distance(t, word)) <= toxicity.max_edits(t)), default=None)
        assert (auto.accept[q[0]] if len(q) else None) == want, word


def score(text, lex=toxicity.Lexicon.plain()):
    return next((x for _, x, _ in toxicity.text_hits([text], lex)), 0.0)


def test_contexts():
    assert score("what an idiot") == 1.0
    assert score("you are an IDIOT") == score("you're such an utter idiot") == score("du idiot") == pytest.approx(2.0)
    assert score('she wrote "idiot" on the wall') == pytest.approx(0.3)
    assert score("the word idiot is old") == pytest.approx(0.3)
    assert score("an idoit") == pytest.approx(0.6) and score("a scumbga") == pytest.approx(0.9)
    assert score("you are an idoit") == pytest.approx(1.2)
    assert score("idoit and morno") == pytest.approx(1.2)
    assert score("idiot " * 3) == pytest.approx(1.75) and score("an idoit. " * 3) == pytest.approx(1.05)
    assert score("clean words only") == 0 and score("") == 0
    assert score("scumbags of the earth") > 0 and score("scums") == 0  # short terms match exactly


@pytest.mark.parametrize("text", ["Take out the trash on Monday.", "The circus had two clowns.", "The parasite Toxoplasma lives in cats.", "Worthless securities are written off.", "Do you like clowns?", "You take out the trash.", "Your trash is out."])
def test_innocent(text):
    assert 0 < score(text) < toxicity.THRESHOLD


def test_length_counts():
    """One word of abuse in a long book isn't what it is in a line."""
    book = "the cat sat on the mat and then it slept. " * 2000
    assert score("what an idiot") >= toxicity.THRESHOLD > score(book + "what an idiot") > 0
    assert score(book + "idiot moron scum " * 20) >= toxicity.THRESHOLD


def test_significance_has_no_size():
    assert toxicity.significant(4, 4, 0, 0.1, 50) and not toxicity.significant(2, 2, 0, 0.1, 50)
    assert not toxicity.significant(4, 4, 0, 0.1, 50_000) and toxicity.significant(8, 8, 0, 0.1, 50_000)
    assert not toxicity.significant(40, 2, 0, 0.1, 50) and not toxicity.significant(40, 40, 9, 0.1, 50)
    assert not toxicity.significant(4, 4, 0, 1.0, 50)


def test_text_hits_any_split():
    lex = toxicity.Lexicon.plain()
    texts = [None, "", "an idiot", "clean", "x" * 3000, "moron and trash"]
    want = list(toxicity.text_hits(texts, lex))
    assert [i for i, _, _ in want] == [2, 5]
    assert list(toxicity.text_hits(texts, lex, 5)) == want


@pytest.fixture(scope="module")
def labelled(spark):
    """40 documents with an invented curse among varied words, 400 clean ones."""
    r = random.Random(2)
    vocab = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(600)]
    rows, labels = [], []
    for i in range(880):
        w = [r.choice(vocab) for _ in range(r.randint(20, 60))]
        bad = i % 11 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["grunkwort", "zzyxlik"]))
        rows.append((i, " ".join(w)))
        if i < 440:
            labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), {i for i in range(880) if i % 11 == 0}


def test_learned_and_held_out(labelled):
    docs, labels, bad = labelled
    lex = toxicity.learn(docs, labels)
    assert {"grunkwort", "zzyxlik"} <= set(lex.weight) and score("grunkwrot", lex) > 0.8 and score("zzyxlk", lex) > 0.8
    got = {r.doc_id for r in toxicity.toxic_documents(docs, labels).collect()}
    held = {i for i in bad if i >= 440}
    assert len(got & held) >= 0.9 * len(held) and len(got - bad) <= 2
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == set(range(880)) - got


def test_copies_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "alpha oddword beta") for i in range(20)] + [(i, "alpha beta") for i in range(20, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(60)], "doc_id long, toxic int")
    assert "oddword" not in toxicity.learn(docs, labels).weight


def test_listed_words_follow_the_labels(spark):
    """A listed word that clean documents use too is weighed down, or left out."""
    r = random.Random(5)
    w = lambda: " ".join(r.choice("red blue tall small house tree river stone".split()) for _ in range(12))
    docs = spark.createDataFrame([(i, w() + (" bitch " if i % 2 == 0 else " scumbag " if i % 3 == 0 else " ") + w()) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0 or (i % 3 == 0 and i % 9 != 0))) for i in range(200)], "doc_id long, toxic int")
    lex = toxicity.learn(docs, labels)
    assert "bitch" not in lex.weight and 0.5 <= lex.weight["scumbag"] < 0.9 and lex.weight["idiot"] == 1


def plain_scores(texts, lex):
    """Scores by the table of edit distances, each word on its own, and contexts by walking back over words."""
    import re

    link = set(toxicity._LINK.replace("une?", "un|une").split("|"))
    edits = dict(zip((t for t, _ in lex.terms), lex.edits))
    out = []
    for text in texts:
        forms = collections.defaultdict(list)
        words = list(re.finditer(r"[^\W_]+", text or ""))
        for m in words:
            form = m[0].lower()
            near = min(((d, t) for t, n in edits.items() if abs(len(t) - len(form)) <= n and (d := _distance(t, form)) <= n), default=None)
            if near is None or (near[0] and form in lex.words):
                continue
            x = lex.weight[near[1]]
            if near[0]:
                x *= 0.6 if near[0] == 2 else 0.9 if len(near[1]) >= 7 else 0.6
            left = text[max(0, m.start() - 60) : m.start()].split("\n")[-1]
            right = text[m.end() : m.end() + 60].split("\n")[0]
            quoted = any(q in left or q in right for q in "\"“«„‘'”»’") and toxicity.context_weight(text, m.start(), m.end()) == toxicity.QUOTED
            if quoted or re.search(r"\b(said|says|quoted?|quotes|quoting|called|wrote|writes|the (word|term|phrase|slur|insult)|so-called|reads?|reported)\b", left, re.I):
                x *= 0.3
            else:
                said = re.split(r"[.!?]", left)[-1].lower().replace("’", "'")
                said = re.findall(r"[\w']+", said)
                faces = {"you", "u", "you're", "youre", "ur", "your're", "tu", "vous", "du", "ihr", "tú", "usted", "eres", "sois", "t'es"}
                link_here = lambda ws: all(v in link for v in ws)
                hit = bool(said) and any(said[i] in faces and ((not (rest := said[i + 1 :])) or link_here(rest) or (len(rest) > 1 and link_here(rest[:-1]))) for i in range(len(said)))
                x *= 2 if hit and left.rstrip(" ,\t'’\"").lower()[-1:] not in ".!?" else 1
            forms[form].append(x)
        score = sum(x / 2**i for own in forms.values() for i, x in enumerate(sorted(own, reverse=True)[:50]))
        score *= min(1, sum(map(sum, forms.values())) * 2000 / max(1, len(words)))
        out.append(round(score, 6))
    return out


def test_query_brute_force(spark, sf_dir):
    """The registered query's rows over all documents, by a second implementation."""
    from lumenfold.llm import queries as Q

    docs = load(spark, sf_dir, "documents")
    rows = docs.collect()
    lex = toxicity.learn(docs, load(spark, sf_dir, "labels"))
    want = {r.doc_id: x for r, x in zip(rows, plain_scores([r.text for r in rows], lex)) if x >= toxicity.THRESHOLD}
    got = {r.doc_id: r.score for r in Q.QUERIES["op6_toxicity"](spark, sf_dir).collect()}
    assert got == pytest.approx(want) and got


def test_toxic_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.toxic_documents(odd, labels).count() == 0
    text = odd.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("text", F.lit("you idiot"))
    assert {r.doc_id for r in toxicity.toxic_documents(text, labels.withColumn("doc_id", F.col("doc_id").cast("string"))).collect()} == {"1", "2", "3", "4", "5", "6", "7", None}
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.drop_toxic(none, labels.limit(0)).count() == 0


def _bits(sets):
    out = []
    for s in sets:
        f = [0, 0]
        for w in range(2):
            for b in range(64):
                n = sum((int(h if w == 0 else simhash.mix(np.array([h], np.uint64) ^ simhash._SECOND)[0]) >> b) & 1 for h in s)
                f[w] |= (2 * n > len(s)) << b
        out.append(f)
    return np.array(out, np.uint64)


def test_fingerprints_brute_force():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 2, 7, 255, 256, 700, 0)]
    a, b = simhash.fingerprints(sets), _bits(sets)
    pop = lambda x: np.bitwise_count(x).sum()
    assert [pop(x) for x in a] == [pop(x) for x in b]
    for i in range(len(sets)):
        for j in range(len(sets)):
            assert pop(a[i] ^ a[j]) == pop(b[i] ^ b[j])


@pytest.mark.parametrize("block", [3, 64, 512])
def test_close_pairs_brute_force(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = np.random.default_rng(1)
    f = r.integers(0, 1 << 62, (90, 2)).astype(np.uint64)
    for i in range(45):
        f[45 + i] = f[i]
        for k in r.integers(0, 60, r.integers(0, 6)):
            f[45 + i, r.integers(0, 2)] ^= np.uint64(1) << np.uint64(k)
    f = f[np.argsort(np.bitwise_count(f).sum(1), kind="stable")]
    n = r.integers(8, 12, 90)
    near = lambda i, j: np.bitwise_count(f[i] ^ f[j]).sum() <= 4 and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])
    got = {(int(a), int(b)) for p, q in simhash.close_pairs(f, f, n, n, 4, 0.8, True) for a, b in zip(p, q)}
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if near(i, j)}
    got = {(int(a), int(b)) for p, q in simhash.close_pairs(f[:30], f[30:], n[:30], n[30:], 4, 0.8, False) for a, b in zip(p, q)}
    assert got == {(i, j - 30) for i in range(30) for j in range(30, 90) if near(i, j)}


def brute_groups(docs, radius=simhash.RADIUS, ratio=simhash.RATIO):
    f = simhash.document_fingerprints(docs).filter("doc_id IS NOT NULL AND size > 0").toPandas()
    x, n, ids = f[["f0", "f1"]].to_numpy(np.int64).view(np.uint64), f["size"].to_numpy(), f["doc_id"].to_numpy()
    up = {int(i): int(i) for i in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(f)):
        d = np.bitwise_count(x[i] ^ x[i + 1 :]).sum(1)
        for j in np.flatnonzero((d <= radius) & (np.minimum(n[i], n[i + 1 :]) >= ratio * np.maximum(n[i], n[i + 1 :]))):
            a, b = sorted((find(int(ids[i])), find(int(ids[i + 1 + j]))))
            up[b] = a
    root = {i: find(i) for i in up}
    size = collections.Counter(root.values())
    return {(i, r) for i, r in root.items() if size[r] > 1}


@pytest.mark.parametrize("tile", [50, simhash.TILE])
def test_groups_brute_force(spark, sf_dir, tile):
    docs = load(spark, sf_dir, "documents")
    got = simhash.near_duplicates(docs, tile=tile).collect()
    assert {(r.doc_id, r.group_id) for r in got} == brute_groups(docs)
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)


def test_planted_copies(spark):
    r = random.Random(4)
    vocab = ["".join(r.choice("bcdfglmnprstaeiou") for _ in range(r.randint(3, 9))) for _ in range(4000)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    rows, pairs = [], []
    for i in range(150):
        w = text(r.randint(60, 300))
        c = [r.choice(vocab) if r.random() < 0.03 else x for x in w]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(c))]
        pairs.append((2 * i, 2 * i + 1))
    passage = text(55)  # shared, but far from all of a document
    rows += [(1000 + i, " ".join(text(100) + passage + text(100))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    group = {x.doc_id: x.group_id for x in simhash.near_duplicates(d).collect()}
    found = sum(group.get(b) == a for a, b in pairs)
    assert found >= 0.9 * len(pairs)
    assert not [i for i in group if i >= 1000]
    left = {x.doc_id for x in simhash.drop_near_duplicates(d).collect()}
    assert left == {i for i, _ in rows} - {i for i, g in group.items() if i != g}


def test_components_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002), (1003, 1002), (5000, 5000)], "a long, b long")
    got = {r.id: r.root for r in simhash.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {i: 1000 for i in range(1000, 1004)}
    assert simhash.components(links.limit(0)).count() == 0


def test_shared_ids(spark):
    """Different texts of one doc_id are documents of their own; only copies go."""
    r = random.Random(3)
    text = lambda: " ".join(r.choice("abcdefghij") + r.choice("klmnopqrst") + str(r.randrange(99)) for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(7, a, 1), (7, b, 2), (7, b, 3), (8, a, 4), (9, c, 5), (None, c, 6), (None, c, 7), (10, b, 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = {(x.doc_id, x.group_id, x.n_links, x.kept) for x in simhash.near_duplicates(d).collect()}
    assert got == {(7, 7, 1, True), (8, 7, 1, False), (10, 7, 1, False)}
    left = sorted((x.doc_id or -1, x.text, x.size) for x in simhash.drop_near_duplicates(d).collect())
    assert left == sorted([(7, a, 1), (7, b, 2), (9, c, 5), (-1, c, 6), (-1, c, 7)])


def test_links_brute_force(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    f = simhash.document_fingerprints(docs).filter("size > 0").toPandas()
    x, n = f[["f0", "f1"]].to_numpy(np.int64).view(np.uint64), f["size"].to_numpy()
    want = {}
    for i in range(len(f)):
        near = (np.bitwise_count(x[i] ^ x).sum(1) <= simhash.RADIUS) & (np.minimum(n[i], n) >= simhash.RATIO * np.maximum(n[i], n))
        want[int(f["doc_id"][i])] = int(near.sum()) - 1
    got = {r.doc_id: r.n_links for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: k for i, k in want.items() if k}


def test_near_odd(odd, none):
    assert {(r.doc_id, r.group_id, r.n_links, r.kept) for r in simhash.near_duplicates(odd).collect()} == {(1, 1, 1, True), (7, 1, 1, False)}
    text = odd.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {(r.doc_id, r.group_id) for r in simhash.near_duplicates(text).collect()} == {("1", "1"), ("7", "1")}
    assert simhash.drop_near_duplicates(text).count() == 7
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 2, 3, 4, 5, 6]
    assert simhash.near_duplicates(none).count() == simhash.drop_near_duplicates(none).count() == 0


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    docs = load(spark, sf_dir, "documents")
    # quality, by its metrics
    keep = {r.doc_id for r in quality.quality_metrics(docs).filter("keep").collect()}
    a = corpus_pipeline.quality_stage(spark, docs, sf_dir).cache()
    assert {r.doc_id for r in a.collect()} == keep
    # toxicity, by the plain distance
    lex = toxicity.learn(a, load(spark, sf_dir, "labels"))
    b = corpus_pipeline.toxicity_stage(spark, a, sf_dir).cache()
    rows = a.collect()
    clean = {r.doc_id for r, x in zip(rows, plain_scores([r.text for r in rows], lex)) if x < toxicity.THRESHOLD}
    assert {r.doc_id for r in b.collect()} == clean
    # near copies, by brute force
    c = corpus_pipeline.near_duplicate_stage(spark, b, sf_dir).cache()
    assert {r.doc_id for r in c.collect()} == {r.doc_id for r in b.collect()} - {i for i, g in brute_groups(b) if i != g}
    # the mix, by its schedule
    d = corpus_pipeline.mixing_stage(spark, c, sf_dir).cache()
    draws = collections.Counter(r.doc_id for r in mixing.mix_sources(c).collect())
    assert collections.Counter(r.doc_id for r in d.collect()) == draws
    for s in (a, b, c, d):
        assert s.columns == docs.columns
    # packing: every token once
    w = corpus_pipeline.packing_stage(spark, d, sf_dir).collect()
    assert sum(x.n_tokens for x in w) == sum(len(r.text.split()) for r in d.collect())
    run = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda x: (x.shard, x.window, x.n_tokens, tuple(x.doc_ids), tuple(x.starts), tuple(x.ends))
    assert sorted(map(key, run)) == sorted(map(key, w))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_odd(spark, sf_dir, odd, none, stage):
    out = stage[1](spark, odd, sf_dir)
    assert out.count() > 0 and (stage[0] == "packing" or out.columns == odd.columns)
    assert stage[1](spark, none, sf_dir).count() == 0


def test_kept_rows_go_in_pieces():
    """The rows that stay are the marked ones in order, and no batch that is sent back is as long as the one that came."""
    b = pa.record_batch([pa.array(range(5000)), pa.array([None, "a"] * 2500)], names=["doc_id", "text"])
    keep = np.arange(5000) % 3 > 0
    parts = list(common.kept(b, keep))
    assert max(map(len, parts)) <= common.PIECE
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b.filter(pa.array(keep))]))
    assert list(common.kept(b.slice(0, 0), keep[:0])) == []
