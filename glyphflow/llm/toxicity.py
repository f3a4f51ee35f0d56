"""Toxicity: a lexicon learned from labels, found misspelled as well, weighed by the words around each find.

Terms are whole words, or stems that many words begin with, which labelled toxic texts hold far more often than clean ones.
They lie in a trie. A word meets the trie exactly, or through the Levenshtein automaton of the word, walked together with the
trie. Finds inside quotation marks or next to words of reporting count for less than those aimed at someone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, discard, slices, table, tidy, written

#: Labelled rows that the model is fitted on at most: toxic and clean, those of least hash. Documented bounds.
MOST_TOXIC, MOST_CLEAN, MOST_TERMS = 2_000, 6_000, 1_000
SHORTEST, LONGEST, FUZZY_FROM, LEAST = 3, 20, 5, 4
WINDOW = 6
KEPT = 100_000
WORD = re.compile(r"\w+")
LEET = str.maketrans("013457", "oieast")
REPORTING = frozenset("said says saying called calls wrote writes quote quoted quotes word words term dit mot dijo palabra sagte wort".split())
AIMED = frozenset("you your youre u are du dein ihr tu te vous tú eres".split())
MARKS = re.compile(r'["“”«»„\n]')
CLOSED_BY = {'"': '"', "“": "”", "«": "»", "„": "“"}


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans from an opening mark to its closing one on the same line, of any length, in one pass."""
    out, start, close = [], 0, ""
    for m in MARKS.finditer(text):
        if close and m[0] == close:
            out.append((start, m.end()))
            close = ""
        elif m[0] == "\n":
            close = ""
        elif not close and m[0] in CLOSED_BY:
            start, close = m.start(), CLOSED_BY[m[0]]
    return out


class Automaton:
    """The Levenshtein automaton of a word: a state has, for each number of edits up to k, the places reached, as bits."""

    def __init__(self, word: str, k: int):
        self.k, self.end, self.at = k, 1 << len(word), {}
        for i, c in enumerate(word):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def start(self) -> tuple[int, ...]:
        return tuple((1 << e + 1) - 1 for e in range(self.k + 1))

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...]:
        """Along an equal letter; an edit more: another letter, one that the word hasn't, or one of the word's left out."""
        same, whole = self.at.get(char, 0), 2 * self.end - 1
        out, below, now = [], 0, 0
        for reached in state:
            now = (reached & same) << 1 | below << 1 | below | now << 1
            out.append(now := now & whole)
            below = reached
        return tuple(out)

    def alive(self, state: tuple[int, ...]) -> bool:
        return state[-1] > 0

    def accepts(self, state: tuple[int, ...]) -> bool:
        return state[-1] & self.end > 0


class Lexicon:
    """Terms as (text, is a stem, weight)."""

    def __init__(self, terms: list[tuple[str, bool, float]], k: int = 1):
        if k not in (0, 1):
            raise ValueError("the gate before the automata lets through what is one edit away, no more")
        self.terms, self.k, self.trie = terms, k, {}
        for n, (text, _, _) in enumerate(terms):
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            node[""] = n
        # An edit leaves one half of a term as it is, at the start or the end of a word of about its length: only such are walked.
        self.halves: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for t in (t for t, stem, _ in terms if k and not stem and len(t) >= FUZZY_FROM):
            for known, half in zip(self.halves, (t[: len(t) // 2], t[len(t) // 2 :]), strict=True):
                known[half] = known.get(half, 0) | 7 << len(t) - 1
        self.sizes = tuple(sorted({len(h) for h in known}) for known in self.halves)
        first, last = ("|".join(map(re.escape, sorted(known))) for known in self.halves)
        self.rough = re.compile(f"^(?:{first})|(?:{last})$" if first else "(?!)").search  # without lengths, but most words end here
        self.letters = {"".join(sorted(t)) for t, stem, _ in terms if k and not stem and len(t) >= FUZZY_FROM}
        self.known: dict[str, tuple[int, bool] | None] = {}

    def gate(self, word: str) -> bool:
        first, last = self.halves
        n = len(word)
        return self.rough(word) is not None and (any(first.get(word[:i], 0) >> n & 1 for i in self.sizes[0]) or any(last.get(word[n - i :], 0) >> n & 1 for i in self.sizes[1] if i <= n))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}  # what this process has met stays here

    def exact(self, word: str) -> int | None:
        """The term that is the word, or the shortest stem that it begins with."""
        node = self.trie
        for c in word:
            if (n := node.get("")) is not None and self.terms[n][1]:
                return n
            if (node := node.get(c)) is None:
                return None
        return node.get("")

    def near(self, word: str) -> int | None:
        """The heaviest term within k edits, among those long enough that aren't stems."""
        a, best = Automaton(word, self.k), None
        stack = [(self.trie, a.start(), 0)]
        while stack:
            node, state, depth = stack.pop()
            for c, below in node.items():
                if c == "":
                    if depth >= FUZZY_FROM and a.accepts(state) and not self.terms[below][1] and (best is None or (self.terms[below][2], -below) > (self.terms[best][2], -best)):
                        best = below
                elif a.alive(next_ := a.step(state, c)):
                    stack.append((below, next_, depth + 1))
        return best

    def swapped(self, word: str) -> int | None:
        """The heaviest of those terms that is the word with two neighbouring letters swapped: two edits to the automaton."""
        if "".join(sorted(word)) not in self.letters:
            return None
        found = {self.exact(word[:i] + word[i + 1] + word[i] + word[i + 2 :]) for i in range(len(word) - 1)} - {None}
        found = [n for n in found if not self.terms[n][1] and len(self.terms[n][0]) == len(word)]
        return max(found, key=lambda n: (self.terms[n][2], -n), default=None)

    def find(self, word: str) -> tuple[int, bool] | None:
        """(term, whether misspelled) of a lower-cased word."""
        if word in self.known:
            return self.known[word]
        if len(self.known) >= KEPT:
            self.known.clear()
        plain = word.translate(LEET) if not word.isalpha() and not word.isdigit() else word
        found = None
        if (n := self.exact(plain)) is not None:
            found = (n, plain != word)
        elif FUZZY_FROM - 1 <= len(plain) <= LONGEST + 1 and ((self.gate(plain) and (n := self.near(plain)) is not None) or (n := self.swapped(plain)) is not None):
            found = (n, True)
        self.known[word] = found
        return found


FEATURES = 8


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """What the finds of a whole text add up to; zeros without any."""
    lower = (text or "").lower()
    words = set(WORD.findall(lower))
    hits = {w: f for w in words if (f := lexicon.find(w)) is not None}
    if not hits:
        return [0.0] * FEATURES
    quoted = quotations(lower)
    spans = [m for m in WORD.finditer(lower)]
    at, weight, exact, fuzzy, inside = [], [], 0, 0, 0
    q = 0
    for i, m in enumerate(spans):
        if (f := hits.get(m[0])) is None:
            continue
        while q < len(quoted) and quoted[q][1] <= m.start():
            q += 1
        around = {s[0] for s in spans[max(0, i - WINDOW) : i + WINDOW + 1]}
        said = (q < len(quoted) and quoted[q][0] <= m.start()) or bool(around & REPORTING)
        exact, fuzzy, inside = exact + (not f[1]), fuzzy + f[1], inside + said
        at.append(i)
        weight.append(lexicon.terms[f[0]][2] * (0.3 if said else 1.0) * (1.2 if around & AIMED else 1.0) * (0.5 if f[1] else 1.0))
    at, sums = np.array(at), np.concatenate([[0.0], np.cumsum(weight)])
    window = (sums[np.searchsorted(at, at + 4 * WINDOW, side="right")] - sums[:-1]).max()
    distinct = len({f[0] for f in hits.values() if not f[1]})
    return [float(np.log1p(x)) for x in (sums[-1], window, exact, fuzzy, inside, distinct, 1000 * exact / len(spans))] + [float(exact > 1)]


def lexicon_of(counts: Counter, clean: Counter, toxic_rows: int, clean_rows: int, least: float = 6.0) -> list[tuple[str, bool, float]]:
    """Terms from the numbers of toxic and clean texts that hold each word ("word$") or each beginning of a word.

    A term's share of toxic texts less two deviations must be `least` times its share of clean texts plus as much. A beginning
    gives way to a longer one, or a word, that is purer and in nearly as many toxic texts.
    """

    def ratio(t: str) -> float:
        return (counts[t] - 2 * counts[t] ** 0.5) / max(1, toxic_rows) / ((clean[t] + 2 * clean[t] ** 0.5 + 4) / max(1, clean_rows))

    odds = lambda t: (counts[t] + 0.5) / (toxic_rows + 1) / ((clean[t] + 0.5) / (clean_rows + 1))
    by: dict[str, list[str]] = {}
    for t in counts:
        if counts[t] >= LEAST and ratio(t) >= least:
            by.setdefault(t[:SHORTEST], []).append(t)
    good = [t for group in by.values() for t in group if t.endswith("$") or not any(u.startswith(t) and u != t and counts[u] >= 0.9 * counts[t] and odds(u) >= odds(t) for u in group)]
    out: list[tuple[str, bool, float]] = []
    for t in sorted(good, key=lambda t: (-ratio(t), len(t), t)):
        text, stem = (t[:-1], False) if t.endswith("$") else (t, True)
        if len(out) < MOST_TERMS and not any(s and text.startswith(x) for x, s, _ in out):
            out.append((text, stem, float(np.log(odds(t)))))
    return out


def beginnings(text: str | None) -> set[str]:
    """The words of a text, each with a mark for its end, and their beginnings of up to 8 characters."""
    words = {w for w in WORD.findall((text or "").lower()) if SHORTEST <= len(w) <= LONGEST and not w.isdigit()}
    return {f"{w}$" for w in words} | {w[:i] for w in words for i in range(SHORTEST + 1, min(len(w), 8) + 1)}


class Model:
    """The lexicon and a logistic regression on its finds."""

    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray, share: float):
        """x, y: features and labels of the rows. share: of toxic rows among all labelled, which these rows needn't have."""
        self.lexicon = lexicon
        self.fit(x, y, share)

    def fit(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        """Newton's steps with a small ridge; the constant is moved to the share of toxic rows in all labelled."""
        self.beta = np.zeros(FEATURES + 1)
        if len(y) and 0 < y.sum() < len(y):
            a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            for _ in range(30):
                p = 1 / (1 + np.exp(-a @ self.beta))
                ridge = np.diag([1e-6] + [1.0] * FEATURES)
                self.beta += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ self.beta)
            mine = y.mean()
            self.beta[0] += np.log(share / (1 - share)) - np.log(mine / (1 - mine))
        else:
            self.beta[0] = -4.0 if not y.sum() else 4.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-(self.beta[0] + x @ self.beta[1:])))


def fitted(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of at most MOST_TOXIC and MOST_CLEAN labelled rows that held_out (a column of the labels) leaves in."""
    known = labels.select(F.col(id_col).alias("_id"), F.col("toxic"), F.coalesce(held_out, F.lit(True)).alias("_out")).where("NOT _out AND toxic IS NOT NULL AND _id IS NOT NULL")
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}

    def first(label: int, most: int) -> DataFrame:
        """The rows of least hash; all but about one and a half times as many are left out before they are sorted."""
        below = int(min(1.0, 1.5 * most / max(1, totals.get(label, 0))) * (1 << 30))
        mine = known.where(F.col("toxic") == label).withColumn("_hash", F.pmod(F.xxhash64("_id"), F.lit(1 << 30))).where(F.col("_hash") <= below)
        return mine.orderBy("_hash", "_id").limit(most).select("_id", "toxic")

    sample = F.broadcast(first(1, MOST_TOXIC).unionByName(first(0, MOST_CLEAN)))  # so many rows of two numbers at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(sample, "_id")
    rows = written(rows.groupBy("_text").agg(F.max("toxic").alias("toxic")), "toxic-sample")  # copies would make terms of all their words
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    lexicon = learned(rows)
    model = Model(lexicon, *described(rows, lexicon), share)
    discard(rows)
    return model


def learned(rows: DataFrame) -> Lexicon:
    """Of (_text, toxic): counted by the workers; to the driver come what LEAST toxic texts hold, and then the terms that are left."""

    def counting(known: set[str] | None):
        @tidy
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: Counter = Counter()
            for whole in batches:
                for batch in slices(whole, "_text"):
                    for text in batch.column("_text").to_pylist():
                        found = beginnings(text)
                        held.update(found if known is None else found & known)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])

        return count

    def counted(label: int, known: set[str] | None, least: int) -> Counter:
        found = rows.where(F.col("toxic") == label).select("_text").mapInArrow(counting(known), "term string, n long")
        return Counter({r["term"]: r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()})

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic = counted(1, None, LEAST)
    return Lexicon(lexicon_of(toxic, counted(0, set(toxic), 1), sizes.get(1, 0), sizes.get(0, 0)))


def described(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, in an order that no partitioning changes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                x = [features(t, lexicon) for t in batch.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], ["x", "y"])

    found = sorted((list(r["x"]), r["y"]) for r in rows.mapInArrow(run, "x array<double>, y int").collect())
    return np.array([x for x, _ in found]).reshape(-1, FEATURES), np.array([y for _, y in found], float)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with a score between 0 and 1 added: how likely label 1 is. Only the text counts.

    Null and empty texts have the score of a text without finds. Rows are kept one for one, and texts read whole. A column
    of the score's name is replaced.
    """
    kept = [c for c in docs.columns if c != score_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_TERMS bound it

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, text_col):
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(model.score(batch.column(text_col).to_pylist()))], [*kept, score_col])
        model.lexicon.known.clear()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + f", `{score_col}` double"
    return docs.select(*kept).mapInArrow(run, schema)


def rejected(score: Column) -> Column:
    return score >= 0.7


def training_out(id_col: str = "doc_id") -> Column:
    """True for the fold that nothing is learned from."""
    return crc_mod(F.col(id_col), 3) == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"), training_out())
    out = scored(docs, model).withColumn("held_out", F.coalesce(training_out(), F.lit(False)))
    return out.select("doc_id", "held_out", "score", rejected(F.col("score")).cast("int").alias("predicted"))
