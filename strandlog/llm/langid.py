"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads the UTF-8 bytes of a whole lower-cased text in both directions and labels every byte's place with a
probability for each language; a document's probabilities are the means over all its places. Texts of more than OWN
bytes are read in windows of OWN bytes that overlap: each direction starts LEAD bytes before the window's own places, so
that it comes to them with a state carried over from what lies before (and, backwards, after); only own places are
pooled. Windows of all texts of a batch that are about as long run side by side, so a text of any length takes the same
memory and its cost is in proportion to its bytes. The activation is x / (1 + |x|), which numpy runs much faster than
tanh; gates are half of one plus that.

Training is backpropagation through time with Adam, in float32, on the driver. Each step reads windows of SPAN bytes.
They come from a bounded sample of labelled rows: DOCS documents a language on average, drawn by a hash of doc_id, each
visited VISITS times in training, each time at a random place of the whole text. So the driver gets at most
VISITS * SPAN bytes of each sampled document. All languages are learned; the sample grows with their number.

Edge cases: a null text or one without letters is `und` with score 0; so is everything if no labelled document is
there; documents with null lang are not learned from; a word may be as long as a text. An empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.llm.tokens import drop_table, give_back, slices
from strandlog.runtime import cut, ship

#: Sampled documents a language, visits to each in training, bytes read at a visit.
DOCS, VISITS, SPAN = 800, 24, 64
#: Places that a window labels, and bytes read before and after them.
OWN, LEAD = 960, 64
#: Numbers (windows times languages) that are computed side by side.
WIDE = 2048
LETTER = re.compile(r"[^\W\d_]")


def init(langs: int, size: int = 8, embed: int = 8, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters: byte embeddings, a GRU for each direction (update, reset, new), and the output layer."""
    r = np.random.default_rng(seed)
    w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    z = lambda *s: np.zeros(s, np.float32)
    p = {"E": w(256, embed) * 4, "c": z(langs)}
    for d in "fb":
        p |= {f"W{d}": w(embed, 3 * size), f"U{d}": w(size, 3 * size), f"b{d}": z(3 * size), f"c{d}": z(size), f"V{d}": w(size, langs)}
    return p


def _soft(x: np.ndarray, spare: np.ndarray) -> None:
    """x / (1 + |x|), in place."""
    np.abs(x, out=spare)
    spare += 1
    x /= spare


def _walk(p, d: str, ids, mask, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, H, B) of one direction over ids (T, B); where mask (T, 1, B) is 0 the state is 0."""
    n, b = ids.shape
    table, U, c = np.ascontiguousarray((p["E"] @ p[f"W{d}"] + p[f"b{d}"]).T), np.ascontiguousarray(p[f"U{d}"].T), p[f"c{d}"][:, None]
    size, kind = len(c), table.dtype
    out, h = np.empty((n, size, b), kind), np.zeros((size, b), kind)
    x, g, gate, new, spare = (np.empty((k * size, b), kind) for k in (3, 3, 2, 1, 2))
    for t in range(n - 1, -1, -1) if d == "b" else range(n):
        np.take(table, ids[t], axis=1, out=x, mode="clip")
        np.matmul(U, h, out=g)
        np.add(x[: 2 * size], g[: 2 * size], out=gate)
        _soft(gate, spare)
        gate += 1
        gate *= 0.5
        inner = g[2 * size :]
        inner += c
        np.multiply(gate[size:], inner, out=new)
        new += x[2 * size :]
        _soft(new, spare[:size])
        if keep is not None:
            keep.append((t, h, gate.copy(), inner.copy(), new.copy()))
        np.subtract(h, new, out=out[t])
        out[t] *= gate[:size]
        out[t] += new
        if mask is not None:
            out[t] *= mask[t]
        h = out[t]
    return out


def forward(p, ids, mask=None, keep: dict | None = None) -> np.ndarray:
    """Probabilities (T, langs, B) at every place of ids (T, B)."""
    y = p["c"][:, None]
    for d in "fb":
        h = _walk(p, d, ids, mask, None if keep is None else keep.setdefault(d, []))
        if keep is not None:
            keep[f"h{d}"] = h
        y = y + p[f"V{d}"].T @ h
    y -= y.max(axis=1, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(axis=1, keepdims=True)
    return y


def gradients(p, ids, mask, label) -> tuple[float, dict[str, np.ndarray]]:
    """(loss, gradients) of the mean cross-entropy over all places, by backpropagation through time."""
    keep: dict = {}
    prob = forward(p, ids, mask, keep)
    n, b = ids.shape
    total, cols, hot = mask.sum(), np.arange(b), ids.reshape(-1)
    loss = -float((np.log(prob[:, label, cols] + 1e-9) * mask[:, 0]).sum() / total)
    dy = prob
    dy[:, label, cols] -= 1
    dy *= mask / total
    g = {"c": dy.sum(axis=(0, 2)), "E": np.zeros_like(p["E"])}
    for d in "fb":
        U, W, h = p[f"U{d}"], p[f"W{d}"], keep[f"h{d}"]
        size = h.shape[1]
        dh = p[f"V{d}"] @ dy
        dU, dc, dx, carry = np.zeros_like(U), np.zeros_like(p[f"c{d}"]), np.empty((n, 3 * size, b), h.dtype), np.zeros((size, b), h.dtype)
        for t, before, gate, inner, new in reversed(keep[d]):
            z, r = gate[:size], gate[size:]
            slope = 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
            dht = (dh[t] + carry) * mask[t]
            dnew = dht * (1 - z) * (1 - np.abs(new)) ** 2
            dx[t, :size] = dht * (before - new) * slope[:size]
            dx[t, size : 2 * size] = dnew * inner * slope[size:]
            dx[t, 2 * size :] = dnew
            dg = dx[t].copy()
            dg[2 * size :] *= r
            dU += before @ dg.T
            dc += dg[2 * size :].sum(axis=1)
            carry = dht * z + U @ dg
        table = np.zeros((256, 3 * size), h.dtype)
        np.add.at(table, hot, dx.transpose(0, 2, 1).reshape(n * b, -1))
        g |= {f"V{d}": np.tensordot(h, dy, axes=([0, 2], [0, 2])), f"U{d}": dU, f"c{d}": dc, f"W{d}": p["E"].T @ table, f"b{d}": table.sum(axis=0)}
        g["E"] += table @ W.T
    return loss, g


def side_by_side(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """ids (T, B), and lengths, of byte strings, the shorter ones filled up."""
    size = np.array([len(x) for x in parts])
    n = int(size.max())
    ids = np.frombuffer(b"".join([x.ljust(n, b"\0") for x in parts]), np.uint8).reshape(len(parts), n)
    return np.ascontiguousarray(ids.T).astype(np.intp), size


def _mask(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, B): 1 from begin to end, else 0."""
    at = np.arange(n)[:, None]
    return ((at >= begin) & (at < end)).astype(np.float32)


def train(samples: dict[str, list[bytes]], steps: int = 400, batch: int = 256, rate: float = 2e-2, seed: int = 7) -> tuple[list[str], dict[str, np.ndarray]]:
    """Learn from pieces of text by language; languages are drawn alike."""
    langs = sorted(k for k, v in samples.items() if v)
    p, r = init(len(langs), seed=seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(steps if len(langs) > 1 else 0):
        label = r.integers(0, len(langs), batch)
        ids, size = side_by_side([samples[langs[y]][int(r.integers(len(samples[langs[y]])))] for y in label])
        _, g = gradients(p, ids, _mask(len(ids), np.zeros(batch), size)[:, None], label)
        lr = rate * min(1, 2 * (1 - step / steps))
        scale = min(1, 1 / (1e-9 + float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))))
        for k in p:
            x = g[k] * scale
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            p[k] = (p[k] - lr * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(np.float32)
    return langs, p


def windows(n: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, first own place, end of own places) of the windows over n bytes."""
    return [(max(0, a - LEAD), min(n, a + OWN + LEAD), a, min(n, a + OWN)) for a in range(0, n, OWN)]


@dataclass
class Model:
    """What training gives."""

    langs: list[str]
    params: dict[str, np.ndarray]

    def pooled(self, bodies: list[bytes]) -> np.ndarray:
        """(texts, langs): mean probabilities over all places of each (not empty) byte string."""
        parts = sorted(((e - b, i, b, e, s - b, f - b) for i, x in enumerate(bodies) for b, e, s, f in windows(len(x))), reverse=True)
        sums, k = np.zeros((len(bodies), len(self.langs))), max(1, WIDE // len(self.langs))
        for a in range(0, len(parts), k):
            some = parts[a : a + k]
            ids, size = side_by_side([bodies[i][b:e] for _, i, b, e, _, _ in some])
            mask = None if size.min() == size.max() else _mask(len(ids), np.zeros(len(some)), size)[:, None]
            prob = forward(self.params, ids, mask)
            prob *= _mask(len(ids), *(np.array([x[c] for x in some]) for c in (4, 5)))[:, None]
            np.add.at(sums, [x[1] for x in some], prob.sum(axis=0, dtype=np.float64).T)
        return sums / np.array([len(x) for x in bodies])[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        at = [i for i, t in enumerate(texts) if self.langs and t and LETTER.search(t)]
        if at:
            pooled = self.pooled([texts[i].lower().encode() for i in at])
            for i, row in zip(at, pooled, strict=True):
                best = int(np.argmax(row))
                out[i] = self.langs[best], min(1.0, max(0.0, float(row[best])))
        return out


def visits(text: str, seed: int, n: int = VISITS, span: int = SPAN) -> list[bytes]:
    """What training reads of a text: n pieces of at most span bytes at random places of the whole."""
    body = text.lower().encode()
    r = np.random.default_rng([seed, xxhash.xxh64_intdigest(body)])
    return [body[a : a + span] for a in r.integers(0, max(0, len(body) - span) + 1, n).tolist()]


def fit(docs: DataFrame, train_on=None, docs_a_lang: int = DOCS, steps: int = 400, seed: int = 7) -> Model:
    """Train on the documents for which the condition train_on holds."""
    ship(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (train_on if train_on is not None else F.lit(True)))
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    if counts.isEmpty():
        return Model([], {})
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30))
    share = F.floor(F.least(F.lit(1.0), F.lit(docs_a_lang) / F.col("n")) * (1 << 30))
    shares = counts.select(F.col("lang").alias("name"), share.alias("share"))
    drawn = rows.select("lang", "text", draw.alias("draw")).join(shares, (F.col("lang") == F.col("name")) & (F.col("draw") < F.col("share")))

    def run(batches):
        for b in batches:
            found = [(lang, visits(text, seed)) for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if LETTER.search(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.binary()))], ["lang", "pieces"])

    got = drawn.select("lang", "text").mapInArrow(run, "lang string, pieces array<binary>").collect()  # the sample's bound
    samples: dict[str, list[bytes]] = {}
    for lang, pieces in sorted((r["lang"], [bytes(x) for x in r["pieces"]]) for r in got):
        samples.setdefault(lang, []).extend(pieces)
    return Model(*train(samples, steps=steps, seed=seed))


def predict(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            for i, part in slices(b.column(2)):
                texts = part.to_pylist()
                got, n = model.predict(texts), len(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), b.column(1).slice(i, n), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def above_chance(langs: int, part: float) -> float:
    """The score that lies a part of the way from chance, which the best of so many languages always has, to 1."""
    return 1 / langs + part * (1 - 1 / langs) if langs > 1 else 0.0


def keep_known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """docs without those of no known language: `und`, or a score below `least`."""

    def keep(texts):
        drop_table()
        return [lang != "und" and score >= least for lang, score in model.predict(texts)]

    return filtered(docs, keep)


def filtered(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs for which keep(texts) says so; all columns stay."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            said = [x for _, part in slices(b.column(at)) for x in keep(part.to_pylist())]
            yield b.filter(pa.array(said, pa.bool_()))
            give_back()

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
