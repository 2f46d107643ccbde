"""Personal data by rules and a semi-Markov conditional random field.

Base spans come from the rules of ``base_spans``. The model adds spans of the same kinds that the rules leave out, such
as a phone number without its plus or a card number grouped with dots; a span that overlaps a base span is not added.

The model divides the words of a text into segments, each of a kind or none, and scores a segment by features of the
whole span (its shape, digits, checksum, the word before it) and the kinds of neighbours. Dynamic programming over the
segments' ends picks boundaries and kinds together. An entity has at most ``MAX_WORDS`` words, each with a digit or
an "@"; every other word is a segment of no kind, so a text falls apart, exactly, into its runs of such words, and
each run is solved by itself between two segments of no kind.

It is fitted by maximum likelihood with the base spans as labels, on a sample from all runs of all documents: of the
runs with a base span and of those without, each for itself, the ``max_runs`` that hash lowest. A run of more than
``PIECE`` words counts as several, cut between entities. Each labelled run also teaches rewritten forms of its entity
(``rewritten``), which is where the added kinds of writing come from, and numbers that are none (``decoys``). Scoring
covers every document and whole texts.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; repeated rows are judged
alike; without any base span to learn from, nothing is added.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.plans.ranking import top_k_per_group

# Fixed values of the contract.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a run of digits can only match from its start
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MAX_RUNS = 500  # of each: runs with a base span, runs without
MAX_WORDS = 6
PIECE = 4 * MAX_WORDS  # words that are learned from at once
EPOCHS = 8
NONE = len(KINDS)  # the kind of a segment that is no entity
ANCHOR = re.compile(r"[0-9@]")
WORD_END = re.compile(r"[\x20\x09-\x0D]")
EDGE = ".,;:!?\"'<>[]{}"

Span = tuple[int, int, int]  # kind, start, end


# ---- rules ---------------------------------------------------------------------------------------------------

def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: the local part is the whole run before an "@", up to the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[Span]:
    if not text or not ANCHOR.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if small_parts(m.group())]
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


# ---- runs of words -------------------------------------------------------------------------------------------

@dataclass
class Run:
    """Consecutive words with a digit or "@", one space apart: their text, each word's start and end in it, where the
    run stands in its text, and the word before."""

    text: str
    words: list[tuple[int, int]]
    start: int = 0
    before: str = ""
    gold: list[Span] = field(default_factory=list)


def runs_of(text: str) -> Iterator[Run]:
    at, n = 0, len(text)
    found = ANCHOR.search(text)
    while found:
        first = found.start()
        while first > at and not WORD_END.match(text, first - 1):
            first -= 1
        words, start = [], first
        while True:
            end = WORD_END.search(text, start)
            end = end.start() if end else n
            words.append((start - first, end - first))
            if end + 1 >= n or text[end] != " " or WORD_END.match(text, end + 1):
                break
            behind = WORD_END.search(text, end + 1)
            if not ANCHOR.search(text, end + 1, behind.start() if behind else n):
                break
            start = end + 1
        prior = text[max(0, first - 40):first].split()
        yield Run(text[first:end], words, first, prior[-1].lower().strip(EDGE) if prior else "")
        at = end
        found = ANCHOR.search(text, end)


def trimmed(run: Run, i: int, j: int) -> tuple[int, int]:
    """Where the words i..j-1 begin and end without the punctuation around them."""
    a, b = run.words[i][0], run.words[j - 1][1]
    while a < b and run.text[a] in EDGE:
        a += 1
    while b > a and run.text[b - 1] in EDGE:
        b -= 1
    return a, b


def shape(text: str) -> str:
    """Runs of letters and digits written as one letter each: a.9@a.a"""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", text))[:24]


def features(run: Run, i: int, j: int) -> list[str]:
    """What a segment of the words i..j-1 looks like, whole."""
    a, b = trimmed(run, i, j)
    span = run.text[a:b]
    digits = digits_of(span)
    letters = sum(c.isalpha() for c in span)
    parts = span.split(".")
    out = ["bias", f"words{j - i}", f"shape {shape(span)}", f"digits{min(len(digits), 20)}",
           f"letters{min(letters, 3)}", f"at{min(span.count('@'), 2)}", f"dots{min(span.count('.'), 4)}",
           f"plus{span[:1] == '+'}", f"before {run.before}" if i == 0 else "inside",
           f"mix{letters > 0 and len(digits) > 0 and '@' not in span}", f"other{bool(re.search(r'[^A-Za-z0-9 .@+()%_-]', span))}"]
    if "@" not in span and letters == 0:
        out.append(f"plain{14 <= len(digits) <= 19 and luhn(digits)}")
        out.append(f"quad{len(parts) == 4 and all(p.isdigit() for p in parts) and small_parts(span)}")
        out.append("groups " + "-".join(str(min(len(g), 6)) for g in re.findall(r"[0-9]+", span)[:6]))
        out.append(f"tel{10 <= len(digits) <= 15 and len(re.findall('[0-9]+', span)) in (3, 4)}")
    if span.count("@") == 1:
        left, right = span.split("@")
        out.append(f"mail{bool(left) and '.' in right.strip('.') and ' ' not in span}")
    return out


# ---- the model -----------------------------------------------------------------------------------------------

@dataclass
class Model:
    """Weights by feature and kind, and by neighbouring kinds; the last kind is none."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    turns: np.ndarray = field(default_factory=lambda: np.zeros((NONE + 1, NONE + 1)))

    def scores(self, run: Run, known: dict | None = None) -> dict[tuple[int, int], np.ndarray]:
        """The score of each segment (i, j) as each kind; a segment of no kind has one word."""
        out = {}
        for i in range(len(run.words)):
            for j in range(i + 1, min(i + MAX_WORDS, len(run.words)) + 1):
                names = known[i, j] if known else features(run, i, j)
                s = np.zeros(NONE + 1)
                for f in names:
                    if f in self.weights:
                        s = s + self.weights[f]
                if j > i + 1:
                    s[NONE] = -math.inf
                out[i, j] = s
        return out

    def best(self, run: Run) -> list[Span]:
        """The segments with a kind on the best path: (kind, start, end) in the run."""
        n, scores = len(run.words), self.scores(run)
        value = np.full((n + 1, NONE + 1), -math.inf)
        value[0, NONE] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            for i in range(max(0, j - MAX_WORDS), j):
                through = value[i][:, None] + self.turns
                came = through.argmax(axis=0)
                total = through[came, np.arange(NONE + 1)] + scores[i, j]
                for k in np.flatnonzero(total > value[j]):
                    value[j, k], back[j, int(k)] = total[k], (i, int(came[k]))
        k = int((value[n] + self.turns[:, NONE]).argmax())
        out, j = [], n
        while j > 0:
            i, before = back[j, k]
            if k != NONE:
                out.append((k, *trimmed(run, i, j)))
            j, k = i, before
        return out[::-1]


def segments(run: Run) -> list[tuple[int, int, int]]:
    """The labelled run as (i, j, kind) over its words; an entity that its words don't bound is left unlabelled."""
    out, i = [], 0
    wanted = {}
    for kind, a, b in run.gold:
        inside = [w for w, (s, e) in enumerate(run.words) if s < b and e > a]
        if inside and len(inside) <= MAX_WORDS and trimmed(run, inside[0], inside[-1] + 1) == (a, b):
            wanted.setdefault(inside[0], (inside[-1] + 1, kind))
    while i < len(run.words):
        j, kind = wanted.get(i, (i + 1, NONE))
        out.append((i, j, kind))
        i = j
    return out


def log_sum(x: np.ndarray, axis: int = 0) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def learn(model: Model, run: Run, known: dict, squares: dict, rate: float = 0.5) -> None:
    """One step up the likelihood of a labelled run: what is seen less what the model expects, AdaGrad steps."""
    n, scores, turns = len(run.words), model.scores(run, known), model.turns
    ahead = np.full((n + 1, NONE + 1), -math.inf)
    ahead[0, NONE] = 0.0
    for j in range(1, n + 1):
        came = [log_sum(ahead[i][:, None] + turns) + scores[i, j] for i in range(max(0, j - MAX_WORDS), j)]
        ahead[j] = log_sum(np.array(came))
    behind = np.full((n + 1, NONE + 1), -math.inf)  # of what follows, given the kind of the segment before
    behind[n] = turns[:, NONE]
    for i in range(n - 1, -1, -1):
        goes = [log_sum(turns + (scores[i, j] + behind[j])[None, :], axis=1) for j in range(i + 1, min(i + MAX_WORDS, n) + 1)]
        behind[i] = log_sum(np.array(goes))
    whole = behind[0, NONE]
    slopes: dict[str, np.ndarray] = {}
    turned = np.zeros_like(turns)
    seen = {(i, j): kind for i, j, kind in segments(run)}
    for (i, j), s in scores.items():
        with np.errstate(invalid="ignore"):
            both = np.exp(np.nan_to_num(ahead[i][:, None] + turns + (s + behind[j])[None, :] - whole, nan=-np.inf, neginf=-np.inf))
        turned -= both
        slope = -both.sum(axis=0)
        if (i, j) in seen:
            slope[seen[i, j]] += 1
        for f in known[i, j]:
            slopes[f] = slopes.get(f, 0) + slope
    last = np.exp(ahead[n] + turns[:, NONE] - whole)
    turned[:, NONE] -= last
    before = NONE
    for _, _, kind in segments(run):
        turned[before, kind] += 1
        before = kind
    turned[before, NONE] += 1
    for f, slope in [*slopes.items(), (None, turned)]:
        squares[f] = squares.get(f, 1e-6) + slope**2
        step = rate * slope / np.sqrt(squares[f])
        if f is None:
            model.turns = model.turns + step
        else:
            model.weights[f] = model.weights.get(f, np.zeros(NONE + 1)) + step


def rewritten(run: Run) -> Iterator[Run]:
    """The labelled run with its one entity written in other ways."""
    if len(run.gold) != 1:
        return
    kind, a, b = run.gold[0]
    span, digits = run.text[a:b], digits_of(run.text[a:b])
    if kind == 3:
        local = digits[-10:]
        country = digits[:-10] or "1"
        forms = [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}",
                 f"{local[:3]}.{local[3:6]}.{local[6:]}", f"{country}-{local[:3]}-{local[3:6]}-{local[6:]}",
                 f"+{country} {local[:3]} {local[3:6]} {local[6:]}"]
    elif kind == 2:
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        forms = [mark.join(fours) for mark in (" ", "-", ".", "_")]
    elif kind == 1:
        forms = [span + ":8080", "[" + span + "]"]
    else:
        forms = [span.upper(), "<" + span + ">", span.replace("@", "(@)")]
    for form in forms:
        text = run.text[:a] + form + run.text[b:]
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        other = Run(text, words, run.start, run.before, [(kind, a, a + len(form))])
        inside = [w for w, (s, e) in enumerate(words) if s < a + len(form) and e > a]
        other.gold = [(kind, *trimmed(other, inside[0], inside[-1] + 1))]
        if all(ANCHOR.search(text[s:e]) for s, e in words):
            yield other


def decoys(run: Run) -> Iterator[Run]:
    """Numbers that are no personal data, in the place of the labelled run's one entity."""
    if len(run.gold) != 1:
        return
    _, a, b = run.gold[0]
    d = (digits_of(run.text[a:b]) * 8 or "1234567890123456")[:16]
    wrong = d[:15] + next(c for c in "0123456789" if not luhn(d[:15] + c))
    for form in (d[:4], f"{d[:4]}-{d[4:6]}-{d[6:8]}", f"{d[:2]}/{d[2:4]}/{d[4:8]}", f"{d[:2]}:{d[2:4]}", f"{d[0]}.{d[1:3]}", d[:7],
                 f"{d[:2]},{d[2:5]}", wrong, f"{d[0]}.{d[1]}.{d[2]}", "@" + d[:3], f"{d[:3]}%", f"999.{d[:2]}.{d[2:4]}.300"):
        yield Run(form, [(0, len(form))], run.start, run.before)


def fit_runs(runs: Sequence[Run], epochs: int = EPOCHS) -> Model:
    model, squares = Model(), {}
    taught = [r for run in runs for r in (run, *rewritten(run), *decoys(run))]
    known = [{(i, j): features(r, i, j) for i in range(len(r.words))
              for j in range(i + 1, min(i + MAX_WORDS, len(r.words)) + 1)} for r in taught]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for at in order.permutation(len(taught)):
            learn(model, taught[at], known[at], squares)
    return model


def pieces(run: Run) -> Iterator[Run]:
    """The run in pieces of at most PIECE words; an entity that its words bound stays in one piece."""
    if len(run.words) <= PIECE:
        yield run
        return
    cuts, first = [], 0  # a piece is filled up by whole segments
    for i, j, _ in segments(run):
        if j - first > PIECE:
            cuts.append((first, i))
            first = i
    for i, j in [*cuts, (first, len(run.words))]:
        a, b = run.words[i][0], run.words[j - 1][1]
        before = run.text[run.words[i - 1][0]:run.words[i - 1][1]].lower().strip(EDGE) if i else run.before
        yield Run(run.text[a:b], [(s - a, e - a) for s, e in run.words[i:j]], run.start + a, before,
                  [(k, s - a, e - a) for k, s, e in run.gold if s >= a and e <= b])


def labelled_runs(text: str) -> Iterator[Run]:
    """The runs of a training text with their base spans, long ones in pieces."""
    spans = base_spans(text)
    starts = [a for _, a, _ in spans]
    for run in runs_of(text):
        end = run.start + len(run.text)
        near = spans[bisect_left(starts, run.start):bisect_left(starts, end)]
        run.gold = [(k, a - run.start, b - run.start) for k, a, b in near if b <= end]
        yield from pieces(run)


class Lowest:
    """The ``n`` distinct runs that hash lowest."""

    def __init__(self, n: int):
        self.n, self.heap, self.rows = n, [], {}

    def add(self, key: int, row: Run) -> None:
        if key in self.rows or (len(self.heap) == self.n and key >= -self.heap[0]):
            return
        self.rows[key] = row
        heapq.heappush(self.heap, -key)
        if len(self.heap) > self.n:
            del self.rows[-heapq.heappop(self.heap)]


SAMPLE = "labelled boolean, hash long, run string"


def sampled_runs(docs: DataFrame, id_col: str, text_col: str, max_runs: int) -> list[Run]:
    """Up to ``max_runs`` runs with a base span and as many without, by the hash of id and run over all documents.
    A task hands on no more than these numbers of its own."""

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = {True: Lowest(max_runs), False: Lowest(max_runs)}
        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"]):
                for run in labelled_runs(text):
                    name = f"{doc} {run.before} {run.text} {run.gold}".encode()
                    kept[bool(run.gold)].add(int.from_bytes(hashlib.blake2b(name, digest_size=8).digest()) >> 1, run)
        yield pd.DataFrame([(labelled, key, json.dumps([r.text, r.words, r.before, r.gold]))
                            for labelled, low in kept.items() for key, r in low.rows.items()],
                           columns=["labelled", "hash", "run"])

    texts = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(id_col).cast("string").alias("id"),
                                                               F.col(text_col).alias("text"))
    found = texts.mapInPandas(lowest, SAMPLE).distinct()
    rows = top_k_per_group(found, ["labelled"], [F.col("hash"), F.col("run")], max_runs).collect()
    out = []
    for r in sorted(rows, key=lambda r: (r["hash"], r["run"])):
        text, words, before, gold = json.loads(r["run"])
        out.append(Run(text, [tuple(w) for w in words], 0, before, [tuple(g) for g in gold]))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_runs: int = MAX_RUNS) -> Model | None:
    """The model learned from a bounded sample of the runs of all documents; None if no run has a base span."""
    runs = sampled_runs(docs, id_col, text_col, max_runs)
    return fit_runs(runs) if any(r.gold for r in runs) else None


# ---- finding -------------------------------------------------------------------------------------------------

def merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what sorted spans cover together, in order and apart."""
    starts, ends = [], []
    for _, a, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def covered(starts: list[int], ends: list[int], a: int, b: int) -> int:
    """How much of a..b the merged spans cover."""
    total, at = 0, bisect_right(ends, a)
    while at < len(starts) and starts[at] < b:
        total += min(b, ends[at]) - max(a, starts[at])
        at += 1
    return total


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """What the model finds beside the base spans."""
    out = []
    starts, ends = merged(base)
    for run in runs_of(text):
        inner = run.text.strip(EDGE)
        first = run.start + len(run.text) - len(run.text.lstrip(EDGE))
        if inner and covered(starts, ends, first, first + len(inner)) == len(inner):
            continue  # the base spans fill the run
        for kind, a, b in model.best(run):
            a, b = a + run.start, b + run.start
            if a < b and not covered(starts, ends, a, b):
                out.append((kind, a, b))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


FOUND = "base string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_added long, base_sha256 string"


def found_in(text: Column, model: Model | None) -> Column:
    """struct(base, spans, n_<kind> of the base spans, n_added, base_sha256)."""

    @F.pandas_udf(FOUND)
    def of(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            rows = []
            for text in texts:
                base = base_spans(text)
                added = added_spans(text, base, model) if text and model and ANCHOR.search(text) else []
                line = written(base)
                kinds = [k for k, _, _ in base]
                rows.append((line, written(sorted(base + added, key=lambda s: (s[1], s[0], s[2]))),
                             *(kinds.count(k) for k in range(NONE)), len(added), hashlib.sha256(line.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["base", "spans", *(f"n_{k}" for k in KINDS), "n_added", "base_sha256"])

    return of(text)


def find(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "personal") -> DataFrame:
    """``docs`` with what was found in column ``out``."""
    return docs.withColumn(out, found_in(F.col(text_col), model))
