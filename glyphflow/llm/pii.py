"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select what is redacted.

The base spans (e-mail, ip, card and phone by their patterns) always stay. Generators with wider patterns propose more,
overlapping ones too. A candidate's format and the words around it are its features. The trees learn from examples that are
written here from a fixed seed, so that every run and every worker has the same model.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, tidy

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("ssn", "iban")
Span = tuple[str, int, int]

# The looks behind leave no start inside a run, so that no run is read twice; a run has one outcome from wherever it is read.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]|\bat\b")

WIDE = (
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}")),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![\w.]*[0-9])")),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ .-][0-9]{4}){2}[ .-][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])")),
    ("phone", re.compile(r"(?<![\w.+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])(?:[0-9]{2,4}[ .-]?){1,3}[0-9]{2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![\w+])\+[0-9]{1,3} ?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The base: leftmost, non-overlapping in each kind; a match that fails its test is dropped and not tried shorter."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 80 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[Span]:
    """Every span that a wide pattern proposes; kinds overlap, and a run of groups is also proposed without its last ones."""
    out: dict[Span, None] = {}
    for kind, pattern in WIDE:
        for m in pattern.finditer(text):
            out[(kind, *m.span())] = None
            if kind == "phone":
                for cut in (m.start() + c.start() for c in re.finditer(r"(?<=[0-9])[ .-](?=[0-9(])", m[0])):
                    if 7 <= len(digits_of(text[m.start() : cut])) <= 15:
                        out[(kind, m.start(), cut)] = None
    return list(out)


AROUND = {
    "phone": ("tel", "phone", "call", "fax", "mobile", "whatsapp", "dial", "cell"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server", "client", "login"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "transfer"),
}
AGAINST = ("version", "order", "invoice", "isbn", "serial", "ticket", "page", "chapter", "build", "release", "tracking", "sku", "ref", "total", "section", "part")


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    s, before, after = text[start:end], text[max(0, start - 32) : start].lower(), text[end : end + 16].lower()
    d = digits_of(s)
    near = re.findall(r"[a-z]+", before)[-3:] + re.findall(r"[a-z]+", after)[:1]
    groups = re.findall(r"[0-9]+", s)
    numbers = [int(g) for g in groups if len(g) < 5]
    return [
        *(float(kind == k) for k in (*KINDS, *MORE_KINDS)),
        len(s), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(set(map(len, groups))),
        float(len(d) > 1 and luhn(d)), float(s.startswith("+")), float("(" in s), float("." in s), float("-" in s), float(" " in s), float("[" in s),
        float(bool(before) and before[-1].isalnum()), float(bool(after) and after[0].isalnum()), float(bool(re.match(r"[ .,-]?[0-9]", after))), float(bool(re.search(r"[0-9][ .,-]?$", before))),
        float(bool(before) and before[-1] in "$€£#=/:_"), float(any(w.startswith(AROUND[kind]) for w in near)), float(any(w.startswith(AGAINST) for w in near)),
        max(numbers, default=0), float(bool(groups) and groups[0].startswith("0")), float(s[:1] in "3456"), len(set(d)),
        float(kind == "iban" and iban(s)), float(kind == "ssn" and not s.startswith(("000", "666", "9")) and s[4:6] != "00"),
    ]


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Trees:
    """Gradient boosting of shallow trees on the logistic loss, with a calibrating sigmoid fitted to rows kept apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32):
        part = np.arange(len(y)) % 4 == 0
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x[~part].T]
        self.depth, self.rate, self.trees = depth, rate, []
        mean = y[~part].mean()
        self.start = float(np.log(mean / (1 - mean)))
        b, t = self.binned(x[~part]), y[~part].astype(float)
        margin = np.full(len(t), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self.grow(b, t - p, p * (1 - p))
            self.trees.append(tree)
            margin += rate * self.value(tree, b)
        self.a, self.c = 1.0, 0.0
        m, t = self.margin(x[part]), y[part].astype(float)
        for _ in range(200):  # one feature and a constant: plain gradient steps
            p = 1 / (1 + np.exp(-(self.a * m + self.c)))
            self.a -= 0.05 * float(np.mean((p - t) * m))
            self.c -= 0.05 * float(np.mean(p - t))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        """Nodes in heap order: feature (-1: leaf), last bin that goes left, value."""
        nodes: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
        rows = {0: np.arange(len(g))}
        for n in range(len(nodes)):
            if n not in rows:
                continue
            r = rows.pop(n)
            gs, hs, best = g[r].sum(), h[r].sum(), (1e-6, -1, 0)
            if n < 2**self.depth - 1:
                for f in range(b.shape[1]):
                    size = len(self.edges[f]) + 1
                    gl, hl = np.cumsum(np.bincount(b[r, f], g[r], size))[:-1], np.cumsum(np.bincount(b[r, f], h[r], size))[:-1]
                    if len(gl):
                        gain = np.where((hl > 1) & (hs - hl > 1), gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), 0)
                        if gain[k := int(gain.argmax())] > best[0]:
                            best = (float(gain[k]), f, k)
            nodes[n] = (best[1], best[2], float(gs / (hs + 1)))
            if best[1] >= 0:
                left = b[r, best[1]] <= best[2]
                rows[2 * n + 1], rows[2 * n + 2] = r[left], r[~left]
        return nodes

    def value(self, tree: list[tuple[int, int, float]], b: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(x) for x in zip(*tree, strict=True))
        at = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (b[np.arange(len(b)), np.maximum(f, 0)] > cut[at]), at)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.start + self.rate * sum(self.value(t, b) for t in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.margin(x) + self.c)))


def examples(n: int = 1500, seed: int = 7) -> list[tuple[str, Span, int]]:
    """Texts with a true or false span; what the wide patterns propose on the true one is true, all else false."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdehinorstl") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = r.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice((d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))))

    def account() -> str:
        body = num(18)
        return next(f"DE{c:02d}{body}" for c in range(2, 99) if iban(f"DE{c:02d}{body}"))

    good = {
        "phone": lambda: r.choice((f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+{r.randint(1, 99)} {num(3)} {num(3)} {num(4)}")),
        "card": card,
        "email": lambda: f"{word()}{r.choice((' at ', ' [at] ', '(at)'))}{word()}{r.choice((' dot ', ' [dot] ', '(dot)'))}{r.choice(('com', 'org', 'net', 'de'))}",
        "ip": lambda: r.choice(("[.]", "(.)", ".")).join(str(r.randint(1, 255)) for _ in range(4)),
        "ssn": lambda: f"{r.randint(100, 599)}-{r.randint(10, 99)}-{num(4)}",
        "iban": account,
    }
    bad = (
        lambda: f"{num(3)}.{num(3)}.{num(3)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: num(r.randint(13, 19)), lambda: f"{num(4)}-{num(4)}-{num(4)}",
        lambda: f"{num(2)}.{num(2)}.{num(2)}.{num(3)}.{num(2)}", lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}", lambda: f"{word()} at {word()}. {word()}", lambda: f"{r.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}",
        lambda: f"000-{num(2)}-{num(4)}", lambda: f"XX{num(2)} {num(4)} {num(4)} {num(4)}", lambda: f"{num(2)} {num(3)} {num(3)}", lambda: f"$ {num(3)}.{num(3)} {num(3)}",
    )
    out = []
    for _ in range(n):
        kind = r.choice(list(good))
        cue = r.choice(AROUND[kind]) + r.choice((" ", ": ")) if r.random() < 0.4 else ""
        inside = good[kind]()
        head = " ".join(word() for _ in range(4)) + " " + cue
        text = head + inside + r.choice((" ", ", ", ". ", " " + num(16) + " ", " " + num(4) + " ")) + word()
        true = (kind, len(head), len(head) + len(inside))
        out += [(text, c, int(c == true)) for c in candidates(text)]
        head = " ".join(word() for _ in range(3)) + " " + (r.choice(AGAINST) + " " if r.random() < 0.4 else "")
        text = head + r.choice(bad)() + " " + word()
        out += [(text, c, 0) for c in candidates(text)]
    return out


@cache
def model(precision: float = 0.98) -> tuple[Trees, float]:
    """The trees, and the least score that keeps the asked precision on examples of another seed."""
    seen = examples()
    trees = Trees(np.array([features(t, s) for t, s, _ in seen], float), np.array([y for *_, y in seen]))
    held = examples(600, 8)
    p, y = trees.probability(np.array([features(t, s) for t, s, _ in held], float)), np.array([y for *_, y in held])
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    return trees, float(max(0.5, p[order][good[-1]])) if len(good) else 1.0


def found(text: str | None, wanted: tuple[Trees, float] | None = None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by kind, then start. A span of the method never overlaps a base span or a better one."""
    if not text or not HINT.search(text):
        return [], []
    base = base_spans(text)
    trees, least = wanted or model()
    more: list[Span] = []
    if proposed := candidates(text):
        taken = np.zeros(len(text), bool)
        for _, s, e in base:
            taken[s:e] = True
        proposed = [c for c in proposed if not taken[c[1] : c[2]].any()]
        if proposed:
            p = trees.probability(np.array([features(text, c) for c in proposed], float))
            for i in np.lexsort((np.array([c[2] - c[1] for c in proposed]), -p)):
                kind, s, e = proposed[i]
                if p[i] >= least and not taken[s:e].any():
                    taken[s:e] = True
                    more.append((kind, s, e))
    rank = {k: i for i, k in enumerate((*KINDS, *MORE_KINDS))}
    return tuple(sorted(x, key=lambda s: (rank[s[0]], s[1], s[2])) for x in (base, base + more))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the one that starts first covers both."""
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scrubbed(docs: DataFrame, text_col: str = "text", spans_col: str = "pii", digests: bool = False) -> DataFrame:
    """The documents with personal data replaced in the text, and the spans of the text before that as an array.

    With digests: the counts and digests of the spans instead, and no text. Null text stays null and empty text empty,
    without spans. Rows are kept one for one; texts of any length are read whole, in code points. Columns of the added names
    are replaced.
    """
    spans_type = f"`{spans_col}` array<struct<kind:string,start:int,end:int>>"
    added = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" if digests else spans_type
    names = [*added.split()[::2], text_col] if digests else [spans_col]
    kept = [c for c in docs.columns if c not in names]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "".join(f"`{c}` {types[c]}, " for c in kept) + added
    wanted = model()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                texts = batch.column(text_col).to_pylist()
                both = [found(x, wanted) for x in texts]
                if digests:
                    counts = [pa.array([sum(s[0] == k for s in b) for b, _ in both], pa.int64()) for k in KINDS]
                    yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + counts + [pa.array([hashlib.sha256(shown(b).encode()).hexdigest() for b, _ in both]), pa.array([shown(a) for _, a in both])], [*kept, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
                else:
                    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                    spans = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in a] for _, a in both], kind)
                    clean = pa.array([redacted(x, a) for x, (_, a) in zip(texts, both, strict=True)], batch.schema.field(text_col).type)
                    yield pa.RecordBatch.from_arrays([clean if c == text_col else batch.column(c) for c in kept] + [spans], [*kept, spans_col])

    return docs.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrubbed(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
