"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text's words are runs of letters and digits, lower-cased; a run of more than LONGEST characters is cut into overlapping
pieces. A word's vector is a learnt one of its own, if the sample has it often, beside the two last states of a network
over its characters, so that unseen forms are read too. Windows of WINDOW words, half overlapping, cover the whole text; a
second network reads each in both directions, attention pools its states, and the window's log odds come of the pool. The
text's score is that of its highest window, made a probability by a line fitted to a part of the sample held back.

Only texts have labels, so training goes by turns: the window of a toxic text that looks worst now, the worst and a random
one of each clean text. The first windows are chosen by how much oftener toxic texts have a word or its beginning.

The sample has MOST_TOXIC and MOST_CLEAN labelled rows at most, by hash of the id, and MOST_WINDOWS windows of each,
evenly spread; it is trained on by the driver. Scoring takes every window of every text. A worker keeps the vectors of
CACHED words at most and makes others again. Equal texts have equal scores.

A null text is empty, and a text without words is scored by an empty window. Rows are scored one by one: repeated rows,
ties and null ids (never held out) do not matter. Labels that are null or name no document are left out; of rows that
share an id the least text is taken for the sample, and an id with several labels counts as toxic if one says so. Without
labels of both kinds all scores are the share of toxic ones (a half without any). Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, LONGEST = 32, 24
MOST_TOXIC, MOST_CLEAN, MOST_WINDOWS = 1500, 2500, 64
#: Sizes of the vectors of words and characters, and of the states over characters and over words (each direction).
WORD, CHAR, CHAR_STATE, STATE = 8, 8, 8, 8
MOST_WORDS, MOST_CHARS, OFTEN = 20_000, 400, 4
BATCH, STEPS, RATE = 64, 450, 0.012
CACHED, AT_ONCE = 250_000, 2048
RUN = re.compile(r"[^\W_]+")

Params = dict[str, np.ndarray]


def words(text: str) -> list[str]:
    found = RUN.findall(text.lower())
    if max(map(len, found), default=0) > LONGEST:
        half = LONGEST // 2
        found = [p for w in found for p in ([w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - half, half)])]
    return found


def starts(n: int) -> np.ndarray:
    """Of the windows of n words; the last one ends with the last word."""
    return np.unique(np.append(np.arange(0, max(n - WINDOW, 0), WINDOW // 2), max(n - WINDOW, 0)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def gru(x: np.ndarray, u: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, list]:
    """States [time, row, state] of inputs x [time, row, 3 state], already projected, and what going back needs. A masked step keeps the state."""
    n = u.shape[0]
    h, out, kept = np.zeros((x.shape[1], n), x.dtype), [], []
    for t in range(len(x)):
        hu = h @ u
        zr = _sigmoid(x[t, :, : 2 * n] + hu[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(x[t, :, 2 * n :] + r * hu[:, 2 * n :])
        new = c + z * (h - c)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        kept.append((h, z, r, c, hu[:, 2 * n :]))
        out.append(h := new)
    return np.stack(out), kept


class Cell:
    """A network's steps without what going back needs. Inputs for gates, whose sign is turned, and for states are tables of their own."""

    def __init__(self, u: np.ndarray, table: np.ndarray):
        n = u.shape[0]
        self.n, self.gates, self.states = n, np.ascontiguousarray(-table[:, : 2 * n]), np.ascontiguousarray(table[:, 2 * n :])
        self.u_gates, self.u_states = np.ascontiguousarray(-u[:, : 2 * n]), np.ascontiguousarray(u[:, 2 * n :])

    def step(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The next states after h, on inputs at rows of the tables."""
        zr, c = self.gates.take(at, axis=0), self.states.take(at, axis=0)
        zr += h @ self.u_gates
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        more = h @ self.u_states
        more *= zr[:, self.n :]
        c += more
        np.tanh(c, out=c)
        new = h - c
        new *= zr[:, : self.n]
        new += c
        return new


def gru_back(d_out: np.ndarray, u: np.ndarray, kept: list, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u, from those of the states."""
    n = u.shape[0]
    dx, du, dh = np.zeros((*d_out.shape[:2], 3 * n), d_out.dtype), np.zeros_like(u), np.zeros_like(d_out[0])
    for t in range(len(d_out) - 1, -1, -1):
        h, z, r, c, hc = kept[t]
        whole = dh + d_out[t]
        step = whole if mask is None else whole * mask[t][:, None]
        dc = step * (1 - z) * (1 - c * c)
        dx[t] = np.concatenate([step * (h - c) * z * (1 - z), dc * hc * r * (1 - r), dc], axis=1)
        back = np.concatenate([dx[t, :, : 2 * n], dc * r], axis=1)
        du += h.T @ back
        dh = whole - step + step * z + back @ u.T
    return dx, du


def new_params(n_words: int, n_chars: int, seed: int = 1) -> Params:
    rng = np.random.default_rng(seed)
    make = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
    p = {"words": np.zeros((n_words + 1, WORD), np.float32), "chars": make(n_chars + 1, CHAR) * math.sqrt(n_chars + 1) * 0.5}
    wide = WORD + 2 * CHAR_STATE
    for side in ("f", "b"):
        p |= {f"c{side}_w": make(CHAR, 3 * CHAR_STATE), f"c{side}_u": make(CHAR_STATE, 3 * CHAR_STATE), f"c{side}_b": np.zeros(3 * CHAR_STATE, np.float32)}
        p |= {f"w{side}_w": make(wide, 3 * STATE), f"w{side}_u": make(STATE, 3 * STATE), f"w{side}_b": np.zeros(3 * STATE, np.float32)}
    return p | {"attend": make(2 * STATE) * 0.5, "out": make(2 * STATE), "bias": np.full(1, -1.0, np.float32)}


class Model:
    """Parameters, the words and characters that have vectors, and the line from the highest window's log odds to the text's."""

    def __init__(self, params: Params, vocabulary: list[str], chars: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.params, self.vocabulary, self.chars, self.slope, self.shift = params, vocabulary, chars, slope, shift
        self.place = {w: k for k, w in enumerate(vocabulary, 1)}

    def letters(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of characters [time, word], 0 for unknown ones, and which of them there are."""
        lengths = np.array([len(w) for w in found])
        mask = np.arange(lengths.max(initial=1))[:, None] < lengths
        flat = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.chars, flat), len(self.chars) - 1)
        out = np.zeros(mask.shape, np.int64)
        out.T[mask.T] = np.where(self.chars[at] == flat, at + 1, 0)
        return out, mask

    def word_vectors(self, found: list[str]) -> tuple[np.ndarray, tuple]:
        p, (letters, mask) = self.params, self.letters(found)
        ids = np.array([self.place.get(w, 0) for w in found])
        ends, kept = [], []
        for side in ("f", "b"):
            turn = slice(None) if side == "f" else slice(None, None, -1)
            x = (p["chars"] @ p[f"c{side}_w"] + p[f"c{side}_b"])[letters[turn]]
            states, own = gru(x, p[f"c{side}_u"], mask[turn])
            ends.append(states[-1])
            kept.append(own)
        return np.concatenate([p["words"][ids], *ends], axis=1), (ids, letters, mask, kept)

    def inputs(self, found: list[str]) -> np.ndarray:
        """A row per word of what both directions of the second network take."""
        out, p = np.empty((len(found), 6 * STATE), np.float32), self.params
        sides = [Cell(p[f"c{s}_u"], p["chars"] @ p[f"c{s}_w"] + p[f"c{s}_b"]) for s in ("f", "b")]
        w, b = (np.concatenate([p[f"wf_{k}"], p[f"wb_{k}"]], axis=-1) for k in "wb")
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        for size in np.unique(lengths):
            same = np.flatnonzero(lengths == size)
            for s in range(0, len(same), AT_ONCE):
                some = same[s : s + AT_ONCE]
                mine = [found[k] for k in some]
                letters, ends = self.letters(mine)[0], [p["words"][[self.place.get(x, 0) for x in mine]]]
                for cell, turn in zip(sides, (letters, letters[::-1]), strict=True):
                    h = np.zeros((len(some), CHAR_STATE), np.float32)
                    for at in turn[:size]:
                        h = cell.step(h, at)
                    ends.append(h)
                out[some] = np.concatenate(ends, axis=1) @ w + b
        return out

    def cells(self, table: np.ndarray) -> list[Cell]:
        """Of both directions over words whose inputs are rows of the table."""
        return [Cell(self.params[f"w{s}_u"], table[:, k * 3 * STATE : (k + 1) * 3 * STATE]) for k, s in enumerate("fb")]

    def log_odds(self, cells: list[Cell], at: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Of windows at [window, time], rows of the cells' tables."""
        p, out, n = self.params, np.empty(len(at), np.float32), STATE
        heads = [np.stack([p["attend"][s], p["out"][s]], axis=1) for s in (slice(None, n), slice(n, None))]
        for s in range(0, len(at), AT_ONCE):
            some, m = np.ascontiguousarray(at[s : s + AT_ONCE].T), None if mask is None else mask[s : s + AT_ONCE].T
            said = np.zeros((*some.shape, 2), np.float32)
            for cell, head, times in zip(cells, heads, (range(len(some)), range(len(some) - 1, -1, -1)), strict=True):
                h = np.zeros((some.shape[1], n), np.float32)
                for t in times:
                    new = cell.step(h, some[t])
                    h = new if m is None else np.where(m[t, :, None], new, h)
                    said[t] += h @ head
            weight = np.exp(said[:, :, 0] - said[:, :, 0].max(axis=0))
            weight = weight if m is None else weight * m
            out[s : s + AT_ONCE] = (weight * said[:, :, 1]).sum(axis=0) / np.maximum(weight.sum(axis=0), 1e-9) + p["bias"]
        return out

    def gradients(self, windows: list[list[str]], labels: np.ndarray) -> tuple[float, Params]:
        """Mean cross entropy of windows and its gradients."""
        p, n = self.params, STATE
        found = sorted({w for x in windows for w in x})
        number = {w: k for k, w in enumerate(found)}
        mask = np.arange(WINDOW)[:, None] < np.array([len(x) for x in windows])
        at = np.zeros(mask.shape, np.int64)
        at.T[mask.T] = [number[w] for x in windows for w in x]
        vectors, (ids, letters, char_mask, char_kept) = self.word_vectors(found or [""])
        states, kept = [], []
        for side in ("f", "b"):
            turn = slice(None) if side == "f" else slice(None, None, -1)
            own, back = gru((vectors @ p[f"w{side}_w"] + p[f"w{side}_b"])[at[turn]], p[f"w{side}_u"], mask[turn])
            states.append(own[turn])
            kept.append(back)
        h = np.concatenate(states, axis=2)
        score = np.where(mask, h @ p["attend"], -1e9)
        a = np.exp(score - score.max(axis=0)) * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        value = h @ p["out"]
        logit = (a * value).sum(axis=0) + p["bias"]
        loss = float(np.mean(np.logaddexp(0, logit) - labels * logit))
        d = ((_sigmoid(logit) - labels) / len(labels)).astype(logit.dtype)
        d_value = a * d
        d_score = a * (value - (a * value).sum(axis=0)) * d
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["bias"][:] = d.sum()
        g["out"] = np.tensordot(d_value, h, ([0, 1], [0, 1]))
        g["attend"] = np.tensordot(d_score, h, ([0, 1], [0, 1]))
        dh = d_value[:, :, None] * p["out"] + d_score[:, :, None] * p["attend"]
        d_vectors = np.zeros_like(vectors)
        for k, side in enumerate(("f", "b")):
            turn = slice(None) if side == "f" else slice(None, None, -1)
            dx, g[f"w{side}_u"] = gru_back(dh[turn, :, k * n : (k + 1) * n], p[f"w{side}_u"], kept[k], mask[turn])
            by_word = np.zeros((len(vectors), 3 * n), dx.dtype)
            np.add.at(by_word, at[turn][mask[turn]], dx[mask[turn]])
            g[f"w{side}_w"], g[f"w{side}_b"] = vectors.T @ by_word, by_word.sum(axis=0)
            d_vectors += by_word @ p[f"w{side}_w"].T
        np.add.at(g["words"], ids, d_vectors[:, :WORD])
        g["words"][0] = 0
        for k, side in enumerate(("f", "b")):
            turn = slice(None) if side == "f" else slice(None, None, -1)
            d_out = np.zeros((*letters.shape, CHAR_STATE), vectors.dtype)
            d_out[-1] = d_vectors[:, WORD + k * CHAR_STATE : WORD + (k + 1) * CHAR_STATE]
            dx, g[f"c{side}_u"] = gru_back(d_out, p[f"c{side}_u"], char_kept[k], char_mask[turn])
            by_char = np.zeros((len(p["chars"]), 3 * CHAR_STATE), dx.dtype)
            np.add.at(by_char, letters[turn][char_mask[turn]], dx[char_mask[turn]])
            g[f"c{side}_w"], g[f"c{side}_b"] = p["chars"].T @ by_char, by_char.sum(axis=0)
            g["chars"] += by_char @ p[f"c{side}_w"].T
        return loss, g

    def best_windows(self, texts: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """The highest log odds of each text's windows, and which window has them."""
        found = sorted({w for t in texts for x in t for w in x})
        number = {w: k for k, w in enumerate(found)}
        flat = [x for t in texts for x in t]
        mask = np.arange(WINDOW) < np.array([len(x) for x in flat])[:, None]
        at = np.zeros(mask.shape, np.int64)
        at[mask] = [number[w] for x in flat for w in x]
        odds = self.log_odds(self.cells(self.inputs(found or [""])), at, mask)
        cut = np.cumsum([len(t) for t in texts])[:-1]
        parts = np.split(odds, cut)
        return np.array([x.max() for x in parts]), np.array([int(x.argmax()) for x in parts])


def _beginnings(window: list[str]) -> set[str]:
    return {w for w in window} | {f"{w[:4]}-" for w in window}


def _first_windows(texts: list[list[list[str]]], labels: np.ndarray) -> np.ndarray:
    """For each text the window with what toxic texts have so much oftener."""
    counts = (Counter(), Counter())
    for t, y in zip(texts, labels, strict=True):
        counts[int(y)].update(set().union(*map(_beginnings, t)))
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    odds = {w: math.log((k + 0.5) / n[1]) - math.log((counts[0][w] + 0.5) / n[0]) for w, k in counts[1].items() if k > 2}
    return np.array([int(np.argmax([max((odds.get(w, 0.0) for w in _beginnings(x)), default=0.0) for x in t])) for t in texts])


def fit(texts: list[list[list[str]]], labels: list[int], seed: int = 1) -> Model | float:
    """A model of texts, each a list of windows of words; the share of toxic ones where there are not both kinds."""
    y = np.array(labels, np.float32)
    if not 0 < y.sum() < len(y):
        return float(y.mean()) if len(y) else 0.5
    rng = np.random.default_rng(seed)
    often = Counter(w for t in texts for w in {w for x in t for w in x})
    chars = Counter(c for w in often for c in w)
    known = np.array(sorted(ord(c) for c, _ in chars.most_common(MOST_CHARS)) or [0], np.uint32)
    vocabulary = [w for w, k in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:MOST_WORDS] if k >= OFTEN]
    model = Model(new_params(len(vocabulary), len(known), seed), vocabulary, known)
    held = np.arange(len(y)) % 8 == 0 if len(y) >= 800 else np.zeros(len(y), bool)
    learnt = np.flatnonzero(~held)
    mean, square, step = ({k: np.zeros_like(v) for k, v in model.params.items()} for _ in range(2)), 0, 0
    mean, square = mean
    chosen = _first_windows([texts[i] for i in learnt], y[learnt])
    total = STEPS
    while step < total:
        rows = [(texts[i][k], y[i]) for i, k in zip(learnt, chosen, strict=True)]
        rows += [(texts[i][rng.integers(len(texts[i]))], 0.0) for i in learnt if not y[i]]
        for s in range(0, len(rows), BATCH) if len(rows) > BATCH else [0]:
            if s == 0:
                rows = [rows[i] for i in rng.permutation(len(rows))]
            # Half of the time a word's own vector is left out, so that the characters are learnt from.
            some, model.place = rows[s : s + BATCH], {} if step % 2 else {w: k for k, w in enumerate(vocabulary, 1)}
            _, g = model.gradients([w for w, _ in some], np.array([v for _, v in some], np.float32))
            size = math.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (total + 1)))
            for k, v in g.items():
                v = v * min(1.0, 1 / (size + 1e-9)) + 1e-5 * model.params[k]
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                model.params[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            if step >= total:
                break
        model.place = {w: k for k, w in enumerate(vocabulary, 1)}
        if step < total:
            chosen = model.best_windows([texts[i] for i in learnt])[1]
    shown = np.flatnonzero(held) if held.any() and 0 < y[held].sum() < held.sum() else learnt
    model.slope, model.shift = _line(model.best_windows([texts[i] for i in shown])[0].astype(float), y[shown].astype(float))
    return model


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (over 0) and shift of a logistic line, slope held near 1 by a weak prior; targets a little inside 0 and 1."""
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = _sigmoid(np.clip(w[0] * x + w[1], -30, 30))
        g = np.array([((q - y) * x).sum() + (w[0] - 1), (q - y).sum() + 0.01 * w[1]])
        s = q * (1 - q)
        h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.01]])
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
        w[0] = max(w[0], 0.05)
    return float(w[0]), float(w[1])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic and windows (of words) of the labelled rows to learn from, in order of a hash of their ids."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("place", F.xxhash64("doc_id", F.lit(11)))
    some = [known.where(F.col("toxic") == y).orderBy("place", "doc_id").limit(n) for y, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    few = F.broadcast(some[0].unionByName(some[1]))  # MOST_TOXIC + MOST_CLEAN rows of three numbers at most
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(few, "doc_id").groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(3).to_pylist():
                w = words(t)
                s = starts(len(w))
                s = s[np.unique(np.linspace(0, len(s) - 1, MOST_WINDOWS).astype(int))] if len(s) > MOST_WINDOWS else s
                out.append([" ".join(w[i : i + WINDOW]) for i in s])
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], names=["place", "doc_id", "toxic", "windows"])

    return texts.mapInArrow(cut, "place long, doc_id long, toxic int, windows array<string>")


def train(docs: DataFrame, labels: DataFrame, seed: int = 1) -> Model | float:
    rows = sorted(sample(docs, labels).toLocalIterator(), key=lambda r: (r["place"], r["doc_id"]))
    return fit([[w.split() for w in r["windows"]] for r in rows], [r["toxic"] for r in rows], seed)


class Scorer:
    """Scores texts, and keeps inputs of words between them."""

    def __init__(self, model: Model):
        self.model, self.place, self.rows = model, {}, 0
        self.cells = model.cells(np.zeros((CACHED, 6 * STATE), np.float32))

    def _numbers(self, found: list[list[str]]) -> list[np.ndarray]:
        fresh = set().union(*found) - self.place.keys()
        if self.rows + len(fresh) > len(self.cells[0].gates):
            self.place, self.rows, fresh = {}, 0, set().union(*found)
            if len(fresh) > len(self.cells[0].gates):
                self.cells = self.model.cells(np.zeros((len(fresh), 6 * STATE), np.float32))
        if fresh:
            new = sorted(fresh)
            at = slice(self.rows, self.rows + len(new))
            self.place.update(zip(new, range(at.start, at.stop), strict=True))
            for kept, made in zip(self.cells, self.model.cells(self.model.inputs(new)), strict=True):
                kept.gates[at], kept.states[at] = made.gates, made.states
            self.rows = at.stop
        get = self.place.__getitem__
        return [np.fromiter(map(get, f), np.int64, len(f)) for f in found]

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Probabilities of texts."""
        most, group, size = np.empty(len(texts)), [], 0
        found: list[list[str]] = []
        for i, t in enumerate(texts):
            group.append(i)
            found.append(words(t))
            size += len(found[-1])
            if size > CACHED // 2 or i == len(texts) - 1:
                most[group] = self._some(found)
                group, found, size = [], [], 0
        return _sigmoid(np.clip(self.model.slope * most + self.model.shift, -500, 500))

    def _some(self, found: list[list[str]]) -> np.ndarray:
        numbers = self._numbers(found)
        out = np.full(len(found), -np.inf)
        whole, owner, short = [], [], []
        for k, x in enumerate(numbers):
            if len(x) < WINDOW:
                short.append(k)
            else:
                s = starts(len(x))
                whole.append(x[s[:, None] + np.arange(WINDOW)])
                owner.append(np.full(len(s), k))
        if whole:
            np.maximum.at(out, np.concatenate(owner), self.model.log_odds(self.cells, np.concatenate(whole)))
        if short:
            mask = np.arange(WINDOW) < np.array([len(numbers[k]) for k in short])[:, None]
            at = np.zeros(mask.shape, np.int64)
            at[mask] = np.concatenate([numbers[k] for k in short])
            out[short] = self.model.log_odds(self.cells, at, mask)
        return out


def scored(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model) if isinstance(model, Model) else lambda texts: np.full(len(texts), model)
        for b in batches:
            s = score(b.column(2).to_pylist()) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
