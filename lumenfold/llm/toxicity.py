"""Toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon is a list of abusive English words, and words that the labelled documents show to
be abusive. All terms stand in one trie; the automaton that accepts every string within a term's
number of edits (an adjacent swap is one edit) is run over it. Its states, sets of (trie node,
edits), are made deterministic as texts need them, and kept: a table from state and letter
to state. All words of a batch step through that table together in numpy; nearly all reach the
dead state after a few letters.

A hit weighs what its term does: 1 for plain abuse, MILD for words with an innocent sense, the share of toxic documents
among those labelled that hold it where that is known. Edits make it lighter. Its context window counts: a quoted or
reported word weighs less, one said to someone's face ("you are a ...") more. Repeats of a form count half as much each
time. Last, the sum is set against the length: hits thinner than one in SPAN words count in proportion. A document is
toxic where its score reaches THRESHOLD: one mild word never suffices unless it addresses someone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_type, kept, tidy, written

ABUSE = tuple(
    "idiot idiots moron morons imbecile cretin dumbass asshole bitch retard dickhead shithead fuck fucker "
    "motherfucker cunt whore slut subhuman scum scumbag douchebag dipshit jackass".split()
)
INNOCENT = tuple("stupid loser losers pathetic worthless trash clown clowns disgusting vermin lowlife parasite bastard retarded fucking".split())
#: Weight of a word that has an innocent sense; the score from which a document is toxic.
MILD, THRESHOLD = 0.6, 0.95
#: Weight of a misspelt hit of a short term, of a term of LONG letters or more, and of one with two edits.
SHORT_EDIT, LONG_EDIT, TWO_EDITS, LONG = 0.6, 0.9, 0.6, 7
QUOTED, ADDRESSED, WINDOW, SPAN = 0.3, 2.0, 60, 2000
#: At most this many labelled documents teach the lexicon. A learned term has this precision at least, and the chance that any
#: word of the sample would seem as toxic is CHANCE at most. A listed word below FAIR isn't used; with less than KNOWN
#: labelled documents its precision counts as unknown.
SAMPLE_ROWS, MIN_PRECISION, CHANCE, FAIR, KNOWN = 20_000, 0.97, 0.05, 0.5, 5
#: Clean documents that a learned term is taken to have besides those seen: one of five toxic documents doesn't suffice alone.
DOUBT = 0.3

_CUES = re.compile(r"(?i)\b(said|says|quote[ds]?|quoting|called|wrote|writes|the (?:word|term|phrase|slur|insult)|so-called|reads?|reported)\b")
_LINK = (
    r"are|r|re|were|such|just|so|really|all|nothing|but|a|an|the|one|little|"
    r"es|êtes|bist|seid|sind|sois|ein|eine|une?|una|uno|le|la|el|der|die|das|espèce|de|sale|so|nur|muy|très|sehr"
)
_FACE = re.compile(rf"(?i)\b(?:you|u|your?(?=['’]?re\b)|tu|vous|du|ihr|tú|usted|eres|sois|t(?=['’]es\b))(?:['’]?(?:re|es)\b)?(?:(?:[^\w.!?\n]+(?:{_LINK})\b)+(?:[^\w.!?\n]+\w+)?)?[^\w.!?\n]+$")
_OPEN, _CLOSE = "\"“«„‘'", "\"”»“’'"


def max_edits(term: str) -> int:
    """Edits forgiven: none up to four letters, one up to nine, two beyond."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Automaton:
    """The union of the terms' Levenshtein automata over their trie, determinised on demand.

    Letters are classes: 0 ends a word, 1 is any letter that no term has, others are the terms' letters.
    """

    def __init__(self, terms: Sequence[str], edits: Mapping[str, int] | None = None):
        self.kids: list[dict[int, int]] = []
        self.ends: list[str | None] = []
        self.height: list[int] = []
        letters = sorted({c for t in terms for c in t})
        self.code = {c: i + 2 for i, c in enumerate(letters)}
        self.n = len(letters) + 2
        self.classes = np.zeros(0x110000, np.uint8 if self.n < 256 else np.uint16)
        # word characters: all that Python calls alphanumeric; capitals fold to one small letter
        plain = [i for i in range(0x30000) if chr(i).isalnum()]
        self.classes[plain] = 1
        for i in plain:
            low = chr(i).lower()
            if low in self.code:
                self.classes[i] = self.code[low]
        start = set()
        for budget in (0, 1, 2):  # a trie for each number of edits, so a node knows its own
            own = [t for t in terms if (max_edits(t) if edits is None else edits[t]) == budget]
            if own:
                root = self._node(budget)
                for t in own:
                    at = root
                    for c in t:
                        at = self.kids[at].setdefault(self.code[c], 0) or self._child(at, self.code[c], budget)
                    self.ends[at] = t
                start.add((root, 0, 0))
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.accept: list[tuple[int, str] | None] = [None]
        self.table = np.zeros((1024, self.n), np.int32)
        self.table[1:, 1:] = -1
        self.start = self._state(self._closed(start))

    def _node(self, budget: int) -> int:
        self.kids.append({})
        self.ends.append(None)
        self.height.append(budget)
        return len(self.kids) - 1

    def _child(self, at: int, c: int, budget: int) -> int:
        self.kids[at][c] = n = self._node(budget)
        return n

    def _closed(self, items: set) -> frozenset:
        """With the letters of a term that the text lacks; the least edits of each place only."""
        best: dict[tuple[int, int], int] = {}
        todo = list(items)
        while todo:
            node, e, wait = todo.pop()
            if best.get((node, wait), 9) <= e:
                continue
            best[node, wait] = e
            if not wait and e < self.height[node]:
                todo.extend((k, e + 1, 0) for k in self.kids[node].values())
        return frozenset((n, e, w) for (n, w), e in best.items())

    def _state(self, items: frozenset) -> int:
        if items in self.ids:
            return self.ids[items]
        self.ids[items] = n = len(self.sets)
        self.sets.append(items)
        hits = [(e, self.ends[node]) for node, e, wait in items if not wait and self.ends[node]]
        self.accept.append(min(hits) if hits else None)
        if n >= len(self.table):
            more = np.full((len(self.table), self.n), -1, np.int32)
            more[:, 0] = 0
            self.table = np.concatenate([self.table, more])
        return n

    def _step(self, state: int, c: int) -> int:
        out = set()
        for node, e, wait in self.sets[state]:
            if wait:  # half of a swap: only the other letter goes on
                if wait == c:
                    out.add((node, e, 0))
                continue
            kids = self.kids[node]
            if c in kids:
                out.add((kids[c], e, 0))
            if e < self.height[node]:
                out.add((node, e + 1, 0))
                for x, k in kids.items():
                    if x != c:
                        out.add((k, e + 1, 0))
                        if c in self.kids[k]:
                            out.add((self.kids[k][c], e + 1, x))
        return self._state(self._closed(out))

    def run(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and accepting states of the words that some term accepts, and the starts of all words."""
        solid = codes > 0
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        first = np.flatnonzero(begin)
        at, state, origin = first, np.full(len(first), self.start, np.int64), first
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = len(codes)
        while len(at):
            c = np.where(at < n, codes[np.minimum(at, n - 1)], 0)
            over = c == 0
            if over.any():
                found.append((origin[over], at[over], state[over]))
                at, state, origin, c = at[~over], state[~over], origin[~over], c[~over]
            new = self.table[state, c]
            lost = new < 0
            if lost.any():
                todo = np.unique(state[lost] * self.n + c[lost])
                for k in todo.tolist():
                    s, x = divmod(k, self.n)
                    to = self._step(s, x)
                    self.table[s, x] = to
                new = self.table[state, c]
            live = new > 0
            at, state, origin = at[live] + 1, new[live].astype(np.int64), origin[live]
        if not found:
            return (*(np.zeros(0, np.int64),) * 3, first)
        s, e, q = (np.concatenate(x) for x in zip(*found))
        ok = np.array([self.accept[i] is not None for i in q.tolist()], bool) if len(q) else np.zeros(0, bool)
        s, e, q = s[ok], e[ok], q[ok]
        order = np.argsort(s)
        return s[order], e[order], q[order], first


def context_weight(text: str, start: int, end: int) -> float:
    """QUOTED for a word in quotation marks of its line or after a reporting word, ADDRESSED after "you are a", "you" or their like, else 1."""
    left, right = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    left, right = left.rsplit("\n", 1)[-1], right.split("\n", 1)[0]
    for o, c in zip(_OPEN, _CLOSE):
        if o == c:
            marks = [i for i, x in enumerate(left) if x == o and not (o == "'" and i and left[i - 1].isalnum())]
            inside = len(marks) % 2 == 1 and c in right
        else:
            inside = left.rfind(o) > left.rfind(c) and c in right
        if inside:
            return QUOTED
    if _CUES.search(left):
        return QUOTED
    return ADDRESSED if _FACE.search(left) else 1.0


@dataclass(frozen=True)
class Lexicon:
    """terms with their weights, the edits that each forgives, and misspelt forms that are words of their own."""

    terms: tuple[tuple[str, float], ...]
    edits: tuple[int, ...]
    words: frozenset[str] = frozenset()
    weight: Mapping[str, float] = field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "weight", dict(self.terms))

    @staticmethod
    def of(weights: Mapping[str, float], learned: frozenset[str] = frozenset(), words: frozenset[str] = frozenset()) -> Lexicon:
        """Listed terms forgive what max_edits says, learned ones one edit at most: less is known of the words around them."""
        terms = tuple(sorted(weights.items()))
        return Lexicon(terms, tuple(min(max_edits(t), 1) if t in learned else max_edits(t) for t, _ in terms), words)

    @staticmethod
    def plain() -> Lexicon:
        return Lexicon.of({**dict.fromkeys(ABUSE, 1.0), **dict.fromkeys(INNOCENT, MILD)})

    def hit(self, term: str, edits: int) -> float:
        x = self.weight[term]
        return x if not edits else x * (TWO_EDITS if edits > 1 else LONG_EDIT if len(term) >= LONG else SHORT_EDIT)


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """toxic, doc_id, text of at most sample_rows labelled documents.

    Each class of each language (where docs has lang) gives its least by hash of doc_id in turn, so rare ones teach too.
    """
    own = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    own = own.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    there = docs.filter(docs["text"].isNotNull()).select(docs["doc_id"].alias("doc_id"), lang.alias("lang"))
    turn = F.row_number().over(Window.partitionBy("lang", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # a stratum sends sample_rows at most from each task
    own = own.join(there, "doc_id").withColumn("turn", turn).filter(F.col("turn") <= sample_rows)
    own = own.orderBy("turn", F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", "toxic").distinct()
    d = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).filter("text IS NOT NULL")
    return d.join(F.broadcast(own), "doc_id").select("toxic", "doc_id", "text")  # sample_rows bounds the side sent


def _words(column: str):
    return F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def significant(n: int, contexts: int, clean: int, share: float, tested: int) -> bool:
    """Whether a word of n toxic and some clean documents is toxic beyond chance, whatever the sample's size.

    Were it spread like all words, that n documents are toxic has chance share^n; tested words try their luck. Documents with
    the same word before it may be copies, so no more of them count than there are different words before it.
    """
    k = min(n, contexts)
    return n >= MIN_PRECISION * (n + clean) and 0 < share < 1 and k * math.log(1 / share) >= math.log(max(1, tested) / CHANCE)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """The listed words, each weighed by the labels that know it, and words that the labels show to be toxic.

    A learned term is significant() and of any length; all such terms are used. Then the sample's clean documents are
    searched for misspellings: a form found there is a word of its own. Empty labels give the plain list.
    """
    d = written(_sample(docs, labels, sample_rows), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in d.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad = d.filter("toxic > 0").select(_words("text").alias("w"))
    # a row for each word of a document, and one for each time that it stands after a word
    pairs = F.arrays_zip(F.col("w").alias("term"), F.concat(F.array(F.lit("")), "w").alias("before"))
    alone = F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("term"), F.lit(None).cast("string").alias("before")))
    bad = bad.select(F.explode(F.concat(alone, F.filter(pairs, lambda x: x["term"].isNotNull()))).alias("x"))
    bad = bad.groupBy(F.col("x.term").alias("term"), F.col("x.before").alias("before")).agg(F.count(F.lit(1)).alias("rows"))
    bad = bad.groupBy("term").agg(F.sum(F.when(F.col("before").isNull(), F.col("rows"))).alias("n"), F.count("before").alias("contexts"))
    bad = written(bad.filter("n >= 2 AND contexts >= 2"), "toxic-terms")
    known = [*ABUSE, *INNOCENT]
    sought = bad.select("term").unionByName(d.sparkSession.createDataFrame([(t,) for t in known], "term string")).distinct()
    good = d.filter("toxic = 0").select(F.explode(F.array_distinct(_words("text"))).alias("term"))
    good = good.join(F.broadcast(sought), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("m"))  # words of the sample
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    tested = bad.count()
    least = math.ceil(math.log(max(1, tested) / CHANCE) / math.log(1 / share)) if 0 < share < 1 else 1
    both = bad.join(good, "term", "full").select("term", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("contexts", F.lit(0)).alias("contexts"), F.coalesce("m", F.lit(0)).alias("m"))
    rows = both.filter(F.col("term").isin(*known) | ((F.least("n", "contexts") >= least) & (F.col("n") >= MIN_PRECISION * (F.col("n") + F.col("m"))))).collect()
    weights, learned = dict(Lexicon.plain().terms), set()
    for r in rows:
        precision = r["n"] / max(1, r["n"] + r["m"])
        if r["term"] not in weights:
            if significant(r["n"], r["contexts"], r["m"], share, tested):
                weights[r["term"]] = round(r["n"] / (r["n"] + r["m"] + DOUBT), 4)
                learned.add(r["term"])
        elif r["n"] + r["m"] >= KNOWN:
            weights[r["term"]] = min(weights[r["term"]], precision)
    weights = {t: x for t, x in weights.items() if x >= FAIR}
    lex = Lexicon.of(weights, frozenset(learned))
    sent = d.sparkSession.sparkContext.broadcast(lex)

    def forms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            seen = {form for _, _, found in text_hits(b.column(0).to_pylist(), sent.value) for _, form, edits in found if edits}
            yield pa.record_batch([pa.array(sorted(seen), pa.string())], names=["form"])

    clean = d.filter("toxic = 0").select("text").mapInArrow(tidy(forms), "form string").distinct()
    return Lexicon(lex.terms, lex.edits, frozenset(r["form"] for r in clean.collect()))


HITS = "score double, n_hits int, terms array<string>"
_ready: dict[tuple, Automaton] = {}


def _automaton(lex: Lexicon) -> Automaton:
    if (lex.terms, lex.edits) not in _ready:
        _ready.clear()
        names = [t for t, _ in lex.terms]
        _ready[lex.terms, lex.edits] = Automaton(names, dict(zip(names, lex.edits)))
    return _ready[lex.terms, lex.edits]


def total_score(forms: Sequence[Sequence[float]], words: int) -> float:
    """The score of a text of so many words whose forms have these weights at each of their places."""
    strong = sum(x / 2**i for own in forms for i, x in enumerate(sorted(own, reverse=True)[:50]))
    return round(strong * min(1.0, sum(map(sum, forms)) * SPAN / max(1, words)), 6)


def text_hits(texts: list[str | None], lex: Lexicon, limit: int = 1 << 21) -> Iterator[tuple[int, float, list[tuple[str, str, int]]]]:
    """Index, score and hits (term, form as written in small letters, edits) of each text with a hit; each form once."""
    auto = _automaton(lex)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= limit):
            size += len(texts[j] or "") + 1
            j += 1
        part = [t or "" for t in texts[i:j]]
        codes = auto.classes[np.frombuffer("\n".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)]
        s, e, q, starts = auto.run(codes)
        if len(s):
            begins = np.cumsum([0, *(len(t) + 1 for t in part)])
            which = np.searchsorted(begins, s, "right") - 1
            words = np.diff(np.searchsorted(starts, begins))
            found: dict[int, dict[str, tuple[list[float], str, int]]] = {}
            for d, a, b, state in zip(which.tolist(), s.tolist(), e.tolist(), q.tolist()):
                edits, term = auto.accept[state]
                base = int(begins[d])
                form = part[d][a - base : b - base].lower()
                if edits and form in lex.words:
                    continue
                x = lex.hit(term, edits) * context_weight(part[d], a - base, b - base)
                found.setdefault(d, {}).setdefault(form, ([], term, edits))[0].append(x)
            for d, own in found.items():
                yield i + d, total_score([x for x, _, _ in own.values()], int(words[d])), [(t, f, n) for f, (_, t, n) in sorted(own.items())]
        i = j


def score_toxicity(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """doc_id, score, n_hits (different forms), terms (each once, sorted) of every row with a hit.

    docs has doc_id (of any type) and text; other columns are ignored, whatever their names. Null, empty and clean
    texts give no row. Texts of any length are read whole. Repeated rows give repeated results, a null
    doc_id is carried, an empty table gives no rows. Of terms equally near to a form the first in order counts.
    One scan, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lex)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = list(text_hits(b.column(1).to_pylist(), sent.value))
            if found:
                at, score, hits = zip(*found)
                yield pa.record_batch(
                    [
                        b.column(0).take(pa.array(at)),
                        pa.array(score, pa.float64()),
                        pa.array([len(h) for h in hits], pa.int32()),
                        pa.array([sorted({t for t, _, _ in h}) for h in hits], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "score", "n_hits", "terms"],
                )

    return docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).mapInArrow(tidy(run), f"doc_id {id_type(docs)}, {HITS}")


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, n_hits, terms of the toxic rows, by the list and by what labels teach.

    labels has doc_id (of docs' type) and toxic (0 or 1); null entries teach nothing, of repeated doc_ids the greatest toxic
    counts, and without labels the list stands alone. Cases of docs as in score_toxicity.
    """
    return score_toxicity(docs, learn(docs, labels)).filter(F.col("score") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that aren't toxic by toxic_documents.

    Null and empty texts stay. Repeated rows stay or go together. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep = np.ones(len(b), bool)
            keep[[i for i, x, _ in text_hits(b.column(at).to_pylist(), sent.value) if x >= threshold]] = False
            yield from kept(b, keep)

    return docs.mapInArrow(tidy(run), docs.schema)
