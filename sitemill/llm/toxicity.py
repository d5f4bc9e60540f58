"""Toxicity by a learned lexicon: Levenshtein automata over its trie, and context windows.

Fitting, on a bounded sample of labelled rows: the lexicon holds the word beginnings that tell
toxic from other documents best (likelihood ratio over distinct preceding words, so that copies
count once; of beginnings that contain each other the best stays). Its entries form a trie. The
Levenshtein automaton of the trie reads a word once and gives the entries that it begins with, or
that it misspells, or begins with misspelled up to their last letter, by one edit (two from nine letters
on; two letters in each other's place are one); states are determinised as they occur.
A misspelled form that clean documents hold unquoted, as against toxic ones, begins ordinary words and is
no hit; other misspellings of the entry remain. Entries have 12 letters at most, which longer words begin with. Each hit has a window of words around it. Words that stand near hits in toxic documents rather
than in others, and quotation marks around a hit, tell abuse from quotation. A logistic model
over a document's hits gives the score.

Scoring reads each whole text once; the model is a closure bounded by the sample's near forms.

Defined results: a null or blank text has no hits and the score of such; very long texts are read
whole; repeated rows are scored alike, each by itself; an empty table gives an empty result; a null
doc_id has no fold and is not held out; where the sample has rows of one label only, every score is
its share. Other columns, whatever their names, play no part, and a filter returns them as they are.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.llm.labelled import labelled_sample, logistic
from sitemill.llm.slices import slices, prepare_workers

#: Labelled rows of each label that fitting reads at most.
FIT_ROWS = 12_000
THRESHOLD = 0.3
WINDOW = 5
#: Words a worker remembers the hits of, before it starts afresh.
MEMO = 200_000
WORD = re.compile(r"[^\W_]+")
QUOTES = "\"'`«»‘’‚“”„‹›"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class LexiconAutomaton:
    """The trie of the entries intersected with their Levenshtein automata, determinised lazily."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.entry: dict[int, int] = {}
        self.edits: list[int] = [0]  # most edits of any entry below the node
        for k, e in enumerate(entries):
            node = 0
            self.edits[0] = max(self.edits[0], self.allowed(e))
            for c in e:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.edits.append(0)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], self.allowed(e))
            self.entry[node] = k
        self.alphabet = {c for e in entries for c in e}
        self.numbers: dict = {}
        #: the active (node, edits, letter that must follow), and the (entry, edits) that the word begins with
        self.states: list[tuple[frozenset, frozenset]] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[dict[int, int]] = []
        self.start = self.number(self.closed({(0, 0, "")}), frozenset())

    @staticmethod
    def allowed(entry: str) -> int:
        return 0 if len(entry) < 5 else 1 if len(entry) < 9 else 2

    def closed(self, active: set) -> frozenset:
        """With the nodes reached by leaving out letters of the lexicon."""
        todo = list(active)
        while todo:
            node, e, want = todo.pop()
            for child in self.children[node].values() if not want else ():
                if e < self.edits[child] and (child, e + 1, "") not in active:
                    active.add((child, e + 1, ""))
                    todo.append((child, e + 1, ""))
        return frozenset(active)

    def number(self, active: frozenset, begun: frozenset) -> int:
        """The number of a state."""
        if (active, begun) not in self.numbers:
            self.numbers[active, begun] = len(self.states)
            self.states.append((active, begun))
            self.steps.append({})
            hits: dict[int, int] = {}
            for k, e in begun | {(self.entry[node], e) for node, e, want in active if not want and self.accepts(node, e)}:
                hits[k] = min(e, hits.get(k, e))
            self.ends.append(hits)
        return self.numbers[active, begun]

    def accepts(self, node: int, e: int) -> bool:
        k = self.entry.get(node)
        return k is not None and e <= self.allowed(self.entries[k])

    def step(self, state: int, c: str) -> int:
        active, begun = self.states[state]
        to, found = set(), set(begun)
        for node, e, want in active:
            if want:  # the second of two letters in each other's place
                if c == want:
                    to.add((node, e, ""))
                    found.update([(self.entry[node], e)] if self.accepts(node, e) else [])
                continue
            child = self.children[node].get(c)
            if child is not None:
                to.add((child, e, ""))
                found.update([(self.entry[child], e)] if self.accepts(child, e) else [])
            if e < self.edits[node]:
                to.add((node, e + 1, ""))  # a letter too many
            for letter, child in self.children[node].items():
                if e < self.edits[child]:
                    to.add((child, e + 1, ""))  # another letter
                    after = self.children[child].get(c)
                    if after is not None and letter != c and e < self.edits[after]:
                        to.add((after, e + 1, letter))
        self.steps[state][c] = got = self.number(self.closed(to), frozenset(found))
        return got

    def hits(self, word: str) -> dict[int, int]:
        """Entry -> least number of edits."""
        state, steps = self.start, self.steps
        for c in word:
            if c not in self.alphabet:
                c = ""
            to = steps[state].get(c)
            state = self.step(state, c) if to is None else to
            if not self.states[state][0]:  # only what the word begins with remains
                break
        return self.ends[state]

    def form(self, word: str, entry: int, edits: int) -> str:
        """What of ``word`` stands for the entry: its shortest beginning with it, else the whole word."""
        state = self.start
        for n, c in enumerate(word, 1):
            c = c if c in self.alphabet else ""
            to = self.steps[state].get(c)
            state = self.step(state, c) if to is None else to
            if (entry, edits) in self.states[state][1]:
                return word[:n]
        return word


def _beginnings(words: Iterable[str]) -> set[str]:
    return {w[:n] for w in words for n in range(3, min(len(w), 12) + 1)}


def _ratio(t: float, f: float, toxic: float, other: float) -> tuple[float, float]:
    """(log odds, likelihood ratio) of t of ``toxic`` and f of ``other``."""
    both, n = t + f, toxic + other
    g = sum(2 * a * math.log(a / e) for a, e in ((t, both * toxic / n), (f, both * other / n)) if a > 0)
    return math.log((t + 0.5) / (toxic + 1)) - math.log((f + 0.5) / (other + 1)), g


def learn_lexicon(sample: DataFrame, least: int = 4, least_odds: float = math.log(8), least_ratio: float = 15.0) -> dict[str, float]:
    """Entry -> log odds, from the bounded sample (doc_id, text, y)."""

    def documents_with(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, y in zip(b["text"], b["y"]):
                seen[y].update(_beginnings(set(WORD.findall(text.lower()))))
            yield pd.DataFrame([(p, c[p] if y else 0, 0 if y else c[p]) for y, c in seen.items() for p in c], columns=["entry", "t", "f"])

    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return {}
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("f") + 0.5) / (other + 1))
    found = (sample.select("text", "y").mapInPandas(documents_with, "entry string, t long, f long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
             .where((F.col("t") >= least) & (odds >= least_odds)).toPandas())  # bounded as the sample is
    wanted = frozenset(e for e, t, f in zip(found["entry"], found["t"], found["f"]) if _ratio(t, f, toxic, other)[1] >= least_ratio)

    def neighbours_of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for text, y in zip(b["text"], b["y"]):
                words = ["", *WORD.findall(text.lower())]
                rows.update((p, y, words[i]) for i, w in enumerate(words[1:]) for p in wanted.intersection(w[:n] for n in range(3, min(len(w), 12) + 1)))
            yield pd.DataFrame(list(rows), columns=["entry", "y", "neighbour"])

    counted = (sample.select("text", "y").mapInPandas(neighbours_of, "entry string, y int, neighbour string").distinct()
               .groupBy("entry").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("f")).where(F.col("t") >= least).toPandas())
    documents = {e: (t, f) for e, t, f in zip(found["entry"], found["t"], found["f"])}
    ranked = []
    for e, t, f in zip(counted["entry"], counted["t"], counted["f"]):
        # copies of a document add documents, but no neighbours
        t, f = min(t, documents[e][0]), min(f, documents[e][1])
        odds_, g = _ratio(t, f, toxic, other)
        if g >= least_ratio and odds_ >= least_odds:
            ranked.append((g, len(e), e, odds_))
    lexicon: dict[str, float] = {}
    for _, _, e, odds_ in sorted(ranked, reverse=True):
        if not any(e.startswith(x) or x.startswith(e) for x in lexicon):
            lexicon[e] = odds_
    return lexicon


class Scorer:
    """Finds hits and turns them into features; ``near`` holds the learned weights of window words."""

    def __init__(self, lexicon: dict[str, float]):
        self.automaton = LexiconAutomaton(sorted(lexicon))
        self.odds = [lexicon[e] for e in self.automaton.entries]
        self.near: dict[str, float] = {}
        self.misread: frozenset[str] | set[str] = frozenset()  # near forms that begin ordinary words
        self.memo: dict[str, tuple[int, int, str] | None] = {}

    def hit(self, word: str) -> tuple[int, int, str] | None:
        """(entry, edits, form) of the entry that fits best."""
        if word not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.automaton.hits(word)
            best = min(found.items(), key=lambda x: (x[1], -self.odds[x[0]], x[0]), default=None)
            self.memo[word] = best and (*best, self.automaton.form(word, *best))
        return self.memo[word]

    def hits(self, texts: list[str]) -> list[list[tuple[int, int, bool, list[str], str]]]:
        """Per text: (entry, edits, quoted, window words, form) of each hit."""
        lower = [t.lower() for t in texts]
        words = [WORD.findall(t) for t in lower]
        known = {w: h for w in set().union(*words) if (h := self.hit(w))}
        out = []
        for text, ws in zip(lower, words):
            found = []
            if not known.keys().isdisjoint(ws):
                spans = [m.span() for m in WORD.finditer(text)]
                for i, w in enumerate(ws):
                    if w in known:
                        entry, edits, form = known[w]
                        lo, hi = max(0, i - WINDOW), min(len(ws), i + WINDOW + 1)
                        before, after = text[spans[lo][0]:spans[i][0]], text[spans[i][1]:spans[hi - 1][1]]
                        # a mark that opens before the word and one that closes behind it
                        opened = sum(before.count(q) for q in QUOTES) - sum(before.count(f"{q} ") for q in QUOTES)
                        quoted = opened > 0 and any(q in after for q in QUOTES)
                        found.append((entry, edits, quoted, ws[lo:i] + ws[i + 1:hi], form))
            out.append(found)
        return out

    def features(self, found: list, n_words: int, misread: set[str] | None = None) -> list[float]:
        misread = self.misread if misread is None else misread
        found = [h for h in found if not h[1] or h[4] not in misread]
        exact = [h for h in found if not h[1] and not h[2]]
        fuzzy = [h for h in found if h[1] and not h[2]]
        plain = exact + fuzzy
        context = [sum(self.near.get(w, 0.0) for w in h[3]) / (2 * WINDOW) for h in found]
        return [1.0, math.log1p(len(exact) + sum(0.5 ** h[1] for h in fuzzy)), math.log1p(len(fuzzy)), math.log1p(len(found) - len(plain)), math.log1p(len({h[0] for h in exact})),
                max([self.odds[h[0]] for h in exact], default=0.0) / 5, sum(context) / max(len(context), 1), min(1.0, 20 * len(plain) / max(n_words, 1))]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[Scorer, np.ndarray]:
    """Scorer and coefficients, from labelled rows that are not held out."""
    prepare_workers(docs)
    where = ~held_out(F.col("doc_id"))
    sample = labelled_sample(docs, labels, "toxic", rows, where)
    scorer = Scorer(learn_lexicon(sample))

    def hits(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in slices(b):
                texts = part["text"].tolist()
                found = [[{"entry": h[0], "edits": h[1], "quoted": h[2], "near": h[3], "word": h[4]} for h in f] for f in scorer.hits(texts)]
                yield pd.DataFrame({"y": part["y"].tolist(), "hits": found, "n": [len(t.split()) for t in texts]})

    kind = "y int, hits array<struct<entry: int, edits: int, quoted: boolean, near: array<string>, word: string>>, n long"
    got = [(r["y"], [(h["entry"], h["edits"], h["quoted"], h["near"], h["word"]) for h in r["hits"]], r["n"])
           for r in sample.select("text", "y").mapInPandas(hits, kind).toLocalIterator()]  # bounded as the sample is
    size = Counter(r[0] for r in got)
    # a quoted word of a clean document doesn't show ordinary use
    forms = [{h[4] for h in r[1] if h[1] and (r[0] or not h[2])} for r in got]
    holding = {y: Counter(w for r, ws in zip(got, forms) if r[0] == y for w in ws) for y in (0, 1)}

    def ordinary(w: str, less: tuple[int, int] = (0, 0)) -> bool:
        """Whether a near form is held by clean documents, and by a third of the toxic ones' share at least; sizes cancel out."""
        clean, toxic = holding[0][w] - less[0], holding[1][w] - less[1]
        return clean > 0 and 3 * clean * size[1] >= toxic * size[0]

    scorer.misread = {w for w in holding[0] if ordinary(w)}
    near = {y: Counter(w for r in got if r[0] == y for h in r[1] for w in set(h[3])) for y in (0, 1)}
    n = {y: sum(len(r[1]) for r in got if r[0] == y) for y in (0, 1)}
    if n[0] >= 20 and n[1] >= 20:
        scorer.near = {w: max(-1.0, min(1.0, o)) for w in near[0].keys() | near[1].keys() if near[0][w] + near[1][w] >= 10
                       and abs(o := math.log((near[1][w] + 5) / (n[1] + 10)) - math.log((near[0][w] + 5) / (n[0] + 10))) > 0.7}
    y = np.array([r[0] for r in got], float)
    share = labels.where(F.col("toxic").isin(0, 1) & where).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not len(y) or y.min() == y.max():
        p = min(max(share if share is not None else 0.0, 1e-6), 1 - 1e-6)
        return scorer, np.r_[math.log(p / (1 - p)), np.zeros(7)]
    # a row's own words don't count for it, as those of a new document haven't been counted
    x = [scorer.features(r[1], r[2], {h[4] for h in r[1] if h[1] and ordinary(h[4], (int(not r[0] and h[4] in ws), int(r[0] and h[4] in ws)))}) for r, ws in zip(got, forms)]
    return scorer, logistic(np.array(x), y, share, ridge=1e-2)


def scoring(scorer: Scorer, beta: np.ndarray):
    """A column function text -> struct(score, hits, misspelled, quoted)."""

    @F.pandas_udf("score double, hits int, misspelled int, quoted int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            rows = []
            for part in slices(column):
                texts = part.fillna("").tolist()
                for found, t in zip(scorer.hits(texts), texts):
                    z = float(np.dot(scorer.features(found, len(t.split()) if found else 0), beta))
                    rows.append((1 / (1 + math.exp(-max(-35.0, min(35.0, z)))), len(found), sum(h[1] > 0 for h in found), sum(h[2] for h in found)))
            yield pd.DataFrame(rows, columns=["score", "hits", "misspelled", "quoted"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, hits, misspelled, quoted."""
    score = scoring(*fit(docs, labels, fit_rows))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("s"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "s.score", (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), "s.hits", "s.misspelled", "s.quoted")


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold."""
    score = scoring(*fit(docs, labels, fit_rows))
    return docs.where(score(docs["text"].cast("string"))["score"] < THRESHOLD)
