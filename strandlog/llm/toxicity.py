"""Toxicity by noisy-channel restoration and a linear scorer.

Restoration. A token's characters span a lattice: a letter stands for itself; a digit or sign may stand for letters
(LEET) or, if it is no digit, for nothing; runs of three or more of one letter stand for one or two, two for two or,
at a higher cost, one; other signs stand for nothing. A Viterbi search finds the cheapest path under a character trigram
model (interpolated) plus the costs of the channel. Three or more single characters in a row are also read as one
spaced-out token. A token without a letter or with over two thirds digits may also be a real number, code or sign: that
reading keeps its letters only and costs a price for each digit, for each change between digits and letters, and that
of its letters as a word; digits that no letter is written as make the other reading dearer. The cheaper one holds.

Signs that stand for no letter are taken off both ends of a token first. Where only one path is left and only one way
goes on, nothing is to be chosen, and no cost is looked up.

Score. A restored word gives its stems as features: the word and its first 4, 5 and 6 letters. Weights come from
logistic regression over presence, on all features that SEEN toxic texts hold and whose log odds are over ODDS, however
many; the score is the logistic function of the weights that a whole text holds, so that it is 0 to 1 for every text,
empty ones included.

Training uses a bounded sample of labelled rows: TOXIC and CLEAN of them on average, drawn by a hash of doc_id, the two
classes weighing alike. The character model counts all trigrams of all texts, labelled or not (a task sends its counts
when it has GRAMS of them). The bias is moved so that the threshold parts the sample best by scores that models of
the other FOLDS - 1 parts of the sample, features included, give each text. SEEN, ODDS and RIDGE were chosen by four-fold
cross-validation inside learnable rows.

Edge cases: a null text is empty; null labels are not learned from; of contradicting labels of a doc_id the toxic one
holds; without labels of both kinds every score is 0.5 or, with one kind, that kind's share smoothed. An empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import string
import uuid
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.langid import filtered
from strandlog.llm.tokens import LONG, TABLE, claim, give_back, slices
from strandlog.runtime import cut, ship

#: Sampled toxic and clean rows, trigrams that a task holds at once.
TOXIC, CLEAN, GRAMS = 4000, 8000, 50_000
#: The least toxic texts and log odds of a feature, the ridge of the regression, the parts of the sample.
SEEN, ODDS, RIDGE, FOLDS = 3, 1.0, 0.03, 3
#: Letters that a digit or sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e", "£": "l", "(": "c"}
#: Costs (in nats) of the channel: a substitution, a dropped sign, a run shortened to two and to one.
SUBSTITUTE, DROP, TWO, ONE = 1.0, 0.5, 0.5, 0.3
#: Costs of a doubled letter read as one, and of the reading as a number: at all, a digit, a change to or from letters.
DOUBLE, PLAIN, DIGIT, CHANGE = 6.0, 2.0, math.log(10), 2.0
EDGE = "\x02"
#: First letters of a word that are features.
STEMS = (4, 5, 6)
#: Signs that stand for no letter.
_SILENT = "".join(sorted(set(string.punctuation) - set(LEET)))
_RUN = re.compile(r"(.)\1+", re.S)
_SPACED = re.compile(r"(?<!\S)\S(?:\s{1,3}\S){2,}(?!\S)")
_LETTER = re.compile(r"[^\W\d_]")


class CharModel:
    """Trigram probabilities of letters, backed off to bigrams and a floor."""

    def __init__(self, grams: dict[str, int]):
        self.tri, self.pair, self.bi, self.one = dict(grams), Counter(), Counter(), Counter()
        for g, n in grams.items():
            self.pair[g[:2]] += n
            self.bi[g[1:]] += n
            self.one[g[1]] += n
        self.memo: dict[str, float] = {}
        self.runs: dict[tuple[str, str, str, bool], bool] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        """-log P(c | a b)."""
        got = self.memo.get(a + b + c)
        if got is None:
            low = (self.bi[b + c] + 5 * 0.01) / (self.one[b] + 5)
            got = -math.log((self.tri.get(a + b + c, 0) + 5 * low) / (self.pair[a + b] + 5))
            if len(self.memo) < 200_000:
                self.memo[a + b + c] = got
        return got


def grams(word: str) -> list[str]:
    w = EDGE + EDGE + word + EDGE
    return [w[i : i + 3] for i in range(len(w) - 2)]


def doubled(model: CharModel, before: str, c: str, after: str, long: bool) -> bool:
    """Whether two letters, not one, stay of a run inside a word of letters.

    Whatever is chosen, the letters before and after the run are the same, and after one more letter both paths have the
    same state; so the cheapest path takes the cheaper way through each run, by its neighbours alone.
    """
    key = before, c, after, long
    got = model.runs.get(key)
    if got is None:
        two = (TWO if long else 0.0) + model.cost(before, c, c) + model.cost(c, c, after)
        one = (ONE if long else DOUBLE) + model.cost(before, c, after)
        got = two < one or two == one and EDGE != after > c
        if len(model.runs) < 200_000:
            model.runs[key] = got
    return got


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each step, (letters, cost of the channel)."""
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i + 1
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        if _LETTER.match(c):
            out += [[(c + c, TWO), (c, ONE)]] if n > 2 else [[(c + c, 0.0), (c, DOUBLE)]] if n == 2 else [[(c, 0.0)]]
        elif c in LEET:
            ways = [(x, SUBSTITUTE) for x in LEET[c]] + ([("", DROP)] if not c.isdigit() else [])
            out += [ways] * n if n < 3 else [[(x, y + SUBSTITUTE) for x, y in ways] + ([] if c.isdigit() else [("", DROP)])]
        i = j
    return out


def plain(w: str, letters: str, digits: int, model: CharModel) -> float:
    """The cost of a token as a number, code or sign with its letters."""
    kinds = [c.isdigit() for c in w if c.isdigit() or _LETTER.match(c)]
    total = PLAIN + DIGIT * digits + CHANGE * sum(a != b for a, b in zip(kinds, kinds[1:]))
    return total + (sum(model.cost(*g) for g in grams(letters)) if letters else 0.0)


def restore(token: str, model: CharModel) -> str:
    """The cheapest word for a token."""
    w = token.lower().strip(_SILENT)
    if w.isalpha():
        if not _RUN.search(w):
            return w
        either = lambda m: m[1] * (1 + doubled(model, w[m.start() - 1] if m.start() else EDGE, m[1], w[m.end()] if m.end() < len(w) else EDGE, m.end() - m.start() > 2))
        return _RUN.sub(either, w)
    return decoded(w, model)


def decoded(w: str, model: CharModel) -> str:
    """The cheapest path through a token's lattice, by Viterbi's search."""
    own, digits = "".join(_LETTER.findall(w)), sum(map(str.isdigit, w))
    steps = lattice(w)
    number = not own or digits * 3 > 2 * len(w)
    if not steps or not number and all(len(s) == 1 for s in steps):
        return "".join(s[0][0] for s in steps)
    best: dict[str, tuple[float, str]] = {EDGE + EDGE: (0.0, "")}
    for ways in steps:
        if len(ways) == 1 and len(best) == 1 and not number:
            ((state, (_, made)),) = best.items()
            best = {(state + ways[0][0])[-2:]: (0.0, made + ways[0][0])}
            continue
        after: dict[str, tuple[float, str]] = {}
        for state, (cost, made) in best.items():
            for letters, price in ways:
                total, s = cost + price, state
                for x in letters:
                    total += model.cost(s[0], s[1], x)
                    s = s[1] + x
                if s not in after or (total, made + letters) < after[s]:
                    after[s] = total, made + letters
        best = after
    cost, word = min((cost + model.cost(s[0], s[1], EDGE), made) for s, (cost, made) in best.items())
    if number:
        odd = sum(c.isdigit() and c not in LEET for c in w)
        if plain(w, own, digits, model) <= cost + odd * (DROP + DIGIT):
            return own
    return word


def tokens(text: str | None) -> list[str]:
    """Tokens between white space, and spaced-out ones joined."""
    t = text or ""
    return t.split() + ["".join(x.split()) for x in _SPACED.findall(t)]


def stems(word: str) -> list[str]:
    return [f"w:{word}", *(f"p:{word[:k]}" for k in STEMS if len(word) >= k)] if word else []


@dataclass
class Scorer:
    key: str
    chars: CharModel
    weights: dict[str, float]
    bias: float
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)
    older: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.heads = {s[2 : 2 + min(STEMS)] for s in self.weights}  # all stems of a word begin alike

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "older": {}}

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def _of(self, token: str) -> tuple[str, ...]:
        word = restore(token, self.chars)
        return tuple(s for s in stems(word) if s in self.weights) if word[: min(STEMS)] in self.heads else ()

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        for t in texts:
            if len(self.known) > TABLE // 2:
                self.known, self.older = {}, self.known
            known, older, held = self.known, self.older, set()
            for w in set(tokens(t)):
                got = known.get(w)
                if got is None:
                    got = older.get(w)
                    if got is None:
                        got = self._of(w)
                    if len(w) <= LONG:
                        known[w] = got
                if got:
                    held.update(got)
            z = self.bias + math.fsum(self.weights[s] for s in held)
            out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
        return out


_HELD: dict[str, Scorer] = {}


def _held(model: Scorer) -> Scorer:
    if model.key not in _HELD:
        _HELD.clear()
        _HELD[model.key] = model
    return claim(_HELD[model.key])


def regress(rows: list[list[int]], label: np.ndarray, weight: np.ndarray, n: int, ridge: float = RIDGE, steps: int = 300, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression over sparse presence features, by Adam."""
    at, col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array(list(chain.from_iterable(rows)), np.int64)
    total = weight.sum()
    share = float((weight * label).sum() / total)
    x, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    x[n] = math.log((share + 1e-6) / (1 - share + 1e-6))
    for t in range(1, steps + 1):
        z = x[n] + np.bincount(at, x[col], len(rows))
        r = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label)
        g = np.append(np.bincount(col, r[at], n) + ridge * x[:n], r.sum()) / total * len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (1 - t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x[:n], float(x[n])


def calibrated(bias: float, z: np.ndarray, label: np.ndarray, threshold: float) -> float:
    """The bias with which `threshold` lies where the sample's classes part with the fewest errors.

    It lies a quarter of the way from the last text below that place to the first above; where one side is empty
    the bias stays.
    """
    order = np.argsort(z, kind="stable")
    z, y = z[order], label[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    ok = np.flatnonzero(np.diff(z) > 0) + 1  # cuts between different values
    if not len(ok):
        return bias
    at = ok[np.argmin(errors[ok])]
    return bias + math.log(threshold / (1 - threshold)) - (z[at - 1] + (z[at] - z[at - 1]) / 4)


def _distinct(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            words = [sorted(set(tokens(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(words, pa.list_(pa.string()))], ["toxic", "fold", "words"])

    return docs.select("toxic", "text", "fold").mapInArrow(run, "toxic int, fold int, words array<string>")


def spelled(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams (codes of 21 bits a character) and their numbers in words that come so many times."""
    low: Counter = Counter()
    for w, n in words.items():
        if w.isalpha():
            low[w.lower()] += n
    some = [w for w in low if w.isalpha()]
    if not some:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.frombuffer((EDGE * 2 + (EDGE * 2).join(some) + EDGE).encode("utf-32-le"), "<u4").astype(np.int64)
    edge = ord(EDGE)
    inside = (a[1:-1] != edge) | (a[2:] != edge)  # else the place where a word ended already
    code = (a[:-2] << 42 | a[1:-1] << 21 | a[2:])[inside]
    n = np.repeat([low[w] for w in some], [len(w) + 1 for w in some])
    found, at = np.unique(code, return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64)


def _trigrams(docs: DataFrame) -> DataFrame:
    """(gram, n) over the words of all texts, a word counting once a text; tasks add up before they send."""

    def batch(c: Counter) -> pa.RecordBatch:
        text = ["".join(chr(x >> k & 0x1FFFFF) for k in (42, 21, 0)) for x in c]
        return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(list(c.values()), pa.int64())], ["gram", "n"])

    def run(batches):
        words, c = Counter(), Counter()

        def spell() -> None:
            code, n = spelled(words)
            for x, y in zip(code.tolist(), n.tolist(), strict=True):
                c[x] += y
            words.clear()

        for b in batches:
            for _, part in slices(b.column(0)):
                for t in part.to_pylist():
                    words.update(set(tokens(t)))
                    if len(words) > TABLE:
                        spell()
                    if len(c) > GRAMS:
                        yield batch(c)
                        c.clear()
        spell()
        yield batch(c)
        c.clear()
        give_back()

    return docs.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _chosen(derived: DataFrame, have: dict, seen: int, odds: float) -> list[tuple[str, list[bool]]]:
    """(stem, whether it is a feature of the whole sample and of the sample without each part), by stem."""
    count = lambda y, k: F.sum(((F.col("toxic") == y) & (F.col("fold") == k)).cast("int"))
    by = derived.select("toxic", "fold", F.explode("stems").alias("stem")).groupBy("stem").agg(*[count(y, k).alias(f"n{y}{k}") for y in (0, 1) for k in range(FOLDS)])
    fits = []
    for left_out in (None, *range(FOLDS)):
        ks = [k for k in range(FOLDS) if k != left_out]
        good, bad = (sum(F.col(f"n{y}{k}") for k in ks) for y in (0, 1))
        clean, toxic = (sum(have.get((y, k), 0) for k in ks) for y in (0, 1))
        ratio = F.log((bad + 0.5) / (toxic + 1.0)) - F.log((good + 0.5) / (clean + 1.0))
        fits.append((bad >= seen) & (ratio > odds))
    rows = by.select("stem", F.array(*fits).alias("fits")).filter(F.exists("fits", lambda x: x)).collect()
    return sorted((r["stem"], r["fits"]) for r in rows)


def _weights(rows: list[list[int]], label: np.ndarray, use: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The regression over the features in use, the two classes weighing alike; other features weigh 0."""
    held = [[i for i in r if use[i]] for r in rows]
    each = np.where(label > 0, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(label)
    w, bias = regress(held, label, each, len(use), ridge)
    return np.where(use, w, 0.0), bias


def fit(docs: DataFrame, labels: DataFrame, train_on, toxic: int = TOXIC, clean: int = CLEAN, threshold: float = 0.7, seed: int = 11, seen: int = SEEN, odds: float = ODDS, ridge: float = RIDGE) -> Scorer:
    """Learn from the labelled rows for which the condition train_on (over doc_id) holds."""
    spark = docs.sparkSession
    ship(spark)
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train_on).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = cut(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(F.col("toxic").isin(0, 1)), "labels")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, most / max(1, n.get(y, 0))) for y, most in ((1, toxic), (0, clean))}
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30))
    sample = known.filter(draw < F.when(F.col("toxic") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30))))
    text = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    rows = text.join(F.broadcast(sample), text["doc"] == sample["doc_id"])  # the sample's bound: toxic + clean ids
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc")), F.lit(FOLDS)).cast("int")
    words = cut(_distinct(rows.select("toxic", "text", fold.alias("fold"))), "toxic-words")

    chars = CharModel({r["gram"]: r["n"] for r in _trigrams(docs).collect()})

    def derive(batches):
        for b in batches:
            made = [sorted(set(chain.from_iterable(stems(restore(w, chars)) for w in ws))) for ws in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.string()))], ["toxic", "fold", "stems"])

    derived = cut(words.mapInArrow(derive, "toxic int, fold int, stems array<string>"), "toxic-stems")
    have = {(r["toxic"], r["fold"]): r["n"] for r in derived.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    if len({y for y, _ in have}) < 2:
        a, b = n.get(1, 0), n.get(0, 0)
        return Scorer(uuid.uuid4().hex, chars, {}, math.log((a + 1) / (b + 1)))
    chosen = _chosen(derived, have, seen, odds)
    at = {s: i for i, (s, _) in enumerate(chosen)}
    use = np.array([x for _, x in chosen], bool).reshape(-1, FOLDS + 1)

    def pick(batches):
        for b in batches:
            held = [[at[s] for s in ss if s in at] for ss in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held, pa.list_(pa.int32()))], ["toxic", "fold", "at"])

    data = sorted((r["fold"], r["toxic"], r["at"]) for r in derived.mapInArrow(pick, "toxic int, fold int, at array<int>").collect())
    part, label, rows = np.array([k for k, _, _ in data]), np.array([y for _, y, _ in data], np.float64), [x for _, _, x in data]
    total = lambda w, bias, r: bias + sum(w[i] for i in r)
    w, bias = _weights(rows, label, use[:, 0], ridge)
    z = np.array([total(w, bias, r) for r in rows])
    for k in range(FOLDS):
        rest = np.flatnonzero(part != k)
        if len(set(label[rest])) == 2:
            v, b = _weights([rows[i] for i in rest], label[rest], use[:, k + 1], ridge)
            for i in np.flatnonzero(part == k):
                z[i] = total(v, b, rows[i])
    bias = calibrated(bias, z, label, threshold)
    return Scorer(uuid.uuid4().hex, chars, {s: float(x) for (s, _), x in zip(chosen, w, strict=True) if x}, bias)


def score(docs: DataFrame, model: Scorer, held_out, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    ship(docs.sparkSession)

    def run(batches):
        m = _held(model)
        for b in batches:
            for i, part in slices(b.column(2)):
                texts = part.to_pylist()
                got, n = m.scores(texts), len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), b.column(1).slice(i, n), pa.array(got, pa.float64()), pa.array([int(x >= threshold) for x in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Scorer, threshold: float = 0.7) -> DataFrame:
    """docs without those that score at least the threshold."""
    return filtered(docs, lambda texts: [x < threshold for x in _held(model).scores(texts)])
