"""Toxicity scores from a bidirectional GRU with attention pooling, trained in numpy.

A word enters as its own embedding (hashed) next to the mean embedding of its
beginnings (hashed), so a new form of a known stem is not unknown. An embedding is what the training rows say
about the word or beginning, for certain, plus what training adds; it is zero where they say nothing, so a word never
seen is neutral. While training, a text's words are judged by other texts only. A GRU reads a window of words in both directions, attention pools its states, and a logistic
unit scores the window. A text is covered by all its half-overlapping windows; its score is the highest,
shifted and scaled on rows that training did not see.

Only texts are inputs. Training takes a sample of labelled rows that is bounded in rows and bytes,
whole texts, and learns by multiple instances: a toxic document answers for its most toxic window, a
clean one for its own most toxic window and for others. Words drop out at random, weights decay, and of all epochs
the one that serves the rows held aside best is kept. It runs in one task over that sample; the driver sees the
weights only.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced

WORD = re.compile(r"\w+")
WINDOW, STRIDE = 64, 32
WORD_ROWS, CHAR_ROWS = 1 << 16, 1 << 17
EMBED, HIDDEN = 8, 8
SAMPLE = 4000  # labelled rows that training reads at most, half of them toxic
SAMPLE_BYTES = 32 << 20  # bytes of text that training reads at most; a row that would exceed them is left out
EPOCHS, BATCH, RATE = 6, 128, 0.01
STEPS = 160  # least number of weight updates, about
SURE = 1.5  # standard errors by which a word or n-gram must differ between the classes to start with a weight
DROP = 0.1  # share of a window's words that a step of training does not see
FALSE = 0.005  # most clean rows, as a share, that the threshold lets through where it is set
FOLDS = 4  # a text is trained on with what the texts of the other folds say about its words
DECAY = 0.002  # share of the weights that a step takes away
ASIDE = 5  # one in so many sampled rows only sets the threshold
MEMO = 100_000  # words a worker remembers at a time
CHUNK = 512  # windows scored at a time
GRID = 1024  # steps between 0 and 1 that states are rounded to in scoring

#: The direction in an embedding that stands for evidence.
ALONG = np.where(np.arange(EMBED) % 2, -0.5, 0.5).astype(np.float32)

Weights = dict[str, np.ndarray]


def word_row(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_ROWS


def char_rows(word: str) -> list[int]:
    """Hashed rows of the word's beginnings of four to seven bytes, which carry stems, or of all of a shorter word."""
    raw = word.encode()
    return [zlib.crc32(raw[:n], 2) % CHAR_ROWS for n in range(4, min(7, len(raw)) + 1)] or [zlib.crc32(raw, 3) % CHAR_ROWS]


def windows(n: int) -> list[tuple[int, int]]:
    """Start and stop of all windows over ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _project(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``x @ m`` for a short inner side, summed in a fixed order: a row's result does not depend on the rows beside it."""
    out = np.zeros((len(x), m.shape[1]), m.dtype)
    for k in range(m.shape[0]):
        out += x[:, k, None] * m[k]
    return out


def _weighed(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``h @ v`` for a vector ``v``, in the same fixed order."""
    out = h[:, :, 0] * v[0]
    for k in range(1, len(v)):
        out += h[:, :, k] * v[k]
    return out


def settled(w: Weights) -> Weights:
    """The weights with those of the recurrence rounded to a grid so coarse that its sums are exact in any order.

    States are rounded to ``GRID`` steps when texts are scored. Products with these weights are then
    multiples of one small power of two, and their sums fit the 24 bits of a float.
    """
    out = dict(w)
    for name in ("uf", "ub"):
        steps = 2.0 ** np.floor(np.log2(2**24 / GRID / max(1.0, float(np.abs(w[name]).sum(0).max()) + 1)))
        out[name] = (np.rint(w[name] * steps) / steps).astype(np.float32)
    return out


def _add_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each of ``values`` to its row of ``into``; rows may repeat."""
    order = np.argsort(rows, kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    into[ranked[first]] += np.add.reduceat(values[order], first, axis=0)


def initial(seed: int = 3) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    w = {"word": np.zeros((WORD_ROWS, EMBED), np.float32), "char": np.zeros((CHAR_ROWS, EMBED), np.float32)}
    for d in "fb":
        w[f"x{d}"] = draw(2 * EMBED, 3 * HIDDEN, scale=0.1)
        w[f"b{d}"] = np.zeros(3 * HIDDEN, np.float32)
        w[f"u{d}"] = draw(HIDDEN, 3 * HIDDEN, scale=0.1)
        # one state of each direction starts as the evidence of the words just read
        w[f"x{d}"][:, 2 * HIDDEN] = np.tile(ALONG, 2) / float(ALONG @ ALONG)
        w[f"u{d}"][:, 2 * HIDDEN] = 0
    w["attend"] = draw(2 * HIDDEN, scale=0.1)
    w["out"] = draw(2 * HIDDEN, scale=0.1)
    w["attend"][::HIDDEN] = w["out"][::HIDDEN] = 2
    w["bias"] = np.zeros(1, np.float32)
    return w


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log odds of being in a toxic row against a clean one, less ``SURE`` standard errors; zero within those."""
    a, b = toxic + 0.5, clean + 0.5
    odds = np.log(a / (n_toxic + 1)) - np.log(b / (n_clean + 1))
    return (np.sign(odds) * np.maximum(0, np.abs(odds) - SURE * np.sqrt(1 / a + 1 / b))).astype(np.float32)


def said(bags: list[np.ndarray], y: np.ndarray, rows: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Weights:
    """The evidence on each word row and beginning row of the texts ``bags`` (word ids) with labels ``y``, as embeddings."""
    counts = {"word": np.zeros((2, WORD_ROWS)), "char": np.zeros((2, CHAR_ROWS))}
    for words, label in zip(bags, y):
        used = np.unique(words)
        counts["word"][int(label), np.unique(rows[used])] += 1
        at = np.arange(sizes[used].sum()) + np.repeat(starts[used] - (np.cumsum(sizes[used]) - sizes[used]), sizes[used])
        counts["char"][int(label), np.unique(flat[at])] += 1
    n_toxic = int(y.sum())
    return {name: evidence(toxic, clean, n_toxic, len(y) - n_toxic)[:, None] * ALONG for name, (clean, toxic) in counts.items()}


def features(words: list[str], w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input vector of each word, its word row, its character rows in one array and their starts."""
    rows = np.fromiter(map(word_row, words), np.int64, len(words))
    runs, sizes = array("i"), np.zeros(len(words), np.int64)
    for i, x in enumerate(words):
        run = char_rows(x)
        runs.extend(run)
        sizes[i] = len(run)
    flat = np.array(runs, np.int64)
    starts = np.cumsum(sizes) - sizes
    return _inputs(rows, flat, starts, sizes, w), rows, flat, starts


def _inputs(rows: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, w: Weights) -> np.ndarray:
    if not len(rows):
        return np.zeros((0, 2 * EMBED), np.float32)
    means = np.add.reduceat(w["char"][flat], starts, axis=0) / sizes[:, None]
    return np.hstack([w["word"][rows], means]).astype(np.float32)


def gru(p: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: bool = False, grid: int = 0):
    """States of a GRU over ``p`` (steps, windows, 3 * hidden), the projected inputs; with ``grid`` rounded to so many steps."""
    h = np.zeros((p.shape[1], HIDDEN), np.float32)
    states = np.empty((p.shape[0], p.shape[1], HIDDEN), np.float32)
    trace = []
    for t in range(p.shape[0]):
        zr = _sigmoid(p[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        rh = r * h
        if grid:
            rh = np.rint(rh * grid) / grid
        c = np.tanh(p[t, :, 2 * HIDDEN :] + rh @ u[:, 2 * HIDDEN :])
        new = h + z * (c - h)
        if grid:
            new = np.rint(new * grid) / grid
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep:
            trace.append((h, z, r, rh, c))
        h = states[t] = new
    return states, trace


def score_windows(pf: np.ndarray, pb: np.ndarray, mask: np.ndarray | None, w: Weights, grid: int = 0) -> np.ndarray:
    """Logits of windows from their projected inputs (steps, windows, 3 * hidden)."""
    hf, _ = gru(pf, w["uf"], mask, grid=grid)
    hb, _ = gru(pb[::-1], w["ub"], None if mask is None else mask[::-1], grid=grid)
    hb = hb[::-1]
    e = _weighed(hf, w["attend"][:HIDDEN]) + _weighed(hb, w["attend"][HIDDEN:])
    o = _weighed(hf, w["out"][:HIDDEN]) + _weighed(hb, w["out"][HIDDEN:])
    if mask is not None:
        e = np.where(mask, e, -np.inf)
    a = np.exp(e - e.max(0))
    return (a * o).sum(0) / a.sum(0) + w["bias"][0]


def _padded(ids: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray | None]:
    """Word ids by (step, window), and which of them are words if some windows are short."""
    starts = np.array([s for s, _ in spans])
    sizes = np.array([e - s for s, e in spans])
    steps = int(sizes.max())
    at = starts[None] + np.minimum(np.arange(steps)[:, None], sizes[None] - 1)
    mask = np.arange(steps)[:, None] < sizes[None]
    return ids[at], None if mask.all() else mask


@dataclass
class Model:
    weights: Weights
    shift: float = 0.0
    scale: float = 1.0

    def logits(self, ids: np.ndarray, spans: list[tuple[int, int]], pf: np.ndarray, pb: np.ndarray) -> np.ndarray:
        """Logits of windows over word ids, from each word's projected inputs.

        Windows are scored ``CHUNK`` at a time, the last ones filled up with copies, so that a window's
        logit does not depend on its batch.
        """
        out = np.empty(len(spans), np.float32)
        order = sorted(range(len(spans)), key=lambda i: spans[i][1] - spans[i][0])
        for at in range(0, len(spans), CHUNK):
            some = order[at : at + CHUNK]
            words, mask = _padded(ids, [spans[i] for i in some + some[-1:] * (CHUNK - len(some))])
            out[some] = score_windows(pf[words], pb[words], mask, self.weights, GRID)[: len(some)]
        return out

    def probability(self, logit: float | None) -> float:
        return 0.0 if logit is None else float(_sigmoid(np.float64((logit - self.shift) * self.scale)))


class Scorer:
    """A worker's copy of the model, with the projected inputs of the words it has seen."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pf = np.zeros((1024, 3 * HIDDEN), np.float32)
        self.pb = np.zeros((1024, 3 * HIDDEN), np.float32)

    def learn(self, words: set[str]) -> None:
        w, fresh = self.model.weights, sorted(words)
        x = features(fresh, w)[0]
        first = len(self.known)
        for name, d in (("pf", "f"), ("pb", "b")):
            table = getattr(self, name)
            while len(table) < first + len(fresh):
                table = np.vstack([table, np.zeros_like(table)])
            table[first : first + len(fresh)] = _project(x, w[f"x{d}"]) + w[f"b{d}"]
            setattr(self, name, table)
        self.known.update(zip(fresh, range(first, first + len(fresh))))

    def score(self, texts: list[str | None]) -> list[float]:
        split = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = set().union(*split) - self.known.keys() if split else set()
        if len(self.known) + len(new) > MEMO:
            self.clear()
            new = set().union(*split)
        if new:
            self.learn(new)
        get, spans, ends, flat = self.known.__getitem__, [], [], []
        for words in split:
            spans += [(len(flat) + s, len(flat) + e) for s, e in windows(len(words))]
            flat += map(get, words)
            ends.append(len(spans))
        if not spans:
            return [0.0] * len(texts)
        logits = self.model.logits(np.array(flat, np.int64), spans, self.pf, self.pb)
        out, at = [], 0
        for end in ends:
            out.append(self.model.probability(logits[at:end].max() if end > at else None))
            at = end
        return out


def gradients(x: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, y: np.ndarray, weight: np.ndarray, w: Weights):
    """Loss gradient of every weight but the embeddings, and of the input vectors ``x``."""
    pf, pb = _project(x, w["xf"]) + w["bf"], _project(x, w["xb"]) + w["bb"]
    flip = None if mask is None else mask[::-1]
    hf, tf = gru(pf[ids], w["uf"], mask, keep=True)
    hb, tb = gru(pb[ids][::-1], w["ub"], flip, keep=True)
    h = np.concatenate([hf, hb[::-1]], axis=2)
    e, o = h @ w["attend"], h @ w["out"]
    if mask is not None:
        e = np.where(mask, e, -np.inf)
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = (a * o).sum(0)
    g = ((_sigmoid(pooled + w["bias"][0]) - y) * weight).astype(np.float32)
    do = a * g
    de = a * (o - pooled) * g
    dh = do[:, :, None] * w["out"] + de[:, :, None] * w["attend"]
    out = {
        "out": np.einsum("tb,tbh->h", do, h),
        "attend": np.einsum("tb,tbh->h", de, h),
        "bias": np.array([g.sum()], np.float32),
    }
    dx = np.zeros_like(x)
    for d, trace, part, marks, steps in (("f", tf, dh[:, :, :HIDDEN], mask, ids), ("b", tb, dh[::-1, :, HIDDEN:], flip, ids[::-1])):
        dp, out[f"u{d}"] = _gru_back(part, trace, w[f"u{d}"], marks)
        sums = np.zeros((len(x), 3 * HIDDEN), np.float32)
        _add_rows(sums, steps.ravel(), dp.reshape(-1, 3 * HIDDEN))
        out[f"x{d}"], out[f"b{d}"] = np.einsum("vi,vj->ij", x, sums), sums.sum(0)
        dx += _project(sums, w[f"x{d}"].T)
    return out, dx


def _gru_back(dh: np.ndarray, trace: list, u: np.ndarray, mask: np.ndarray | None):
    uz, uc = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
    dp = np.empty((*dh.shape[:2], 3 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    carry = np.zeros_like(dh[0])
    for t in range(len(trace) - 1, -1, -1):
        h, z, r, rh, c = trace[t]
        total = dh[t] + carry
        live = total if mask is None else total * mask[t][:, None]
        dc = live * z * (1 - c * c)
        drh = dc @ uc.T
        dz = live * (c - h) * z * (1 - z)
        dr = drh * h * r * (1 - r)
        dzr = np.hstack([dz, dr])
        carry = total - live * z + drh * r + dzr @ uz.T
        dp[t, :, : 2 * HIDDEN], dp[t, :, 2 * HIDDEN :] = dzr, dc
        du[:, : 2 * HIDDEN] += h.T @ dzr
        du[:, 2 * HIDDEN :] += rh.T @ dc
    return dp, du


class _Adam:
    """Steps for all weights; of the embeddings, only for the rows that a batch used."""

    def __init__(self, w: Weights) -> None:
        self.m = {k: np.zeros_like(x) for k, x in w.items()}
        self.v = {k: np.zeros_like(x) for k, x in w.items()}
        self.t = 0

    def step(self, w: Weights, g: Weights, rate: float, used: Weights) -> None:
        self.t += 1
        for k, x in g.items():
            at = used.get(k, slice(None))
            self.m[k][at] += 0.1 * (x - self.m[k][at])
            self.v[k][at] += 0.01 * (x * x - self.v[k][at])
            w[k][at] -= rate * (self.m[k][at] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k][at] / (1 - 0.99**self.t)) + 1e-6)
            if k not in used and k != "bias":
                w[k] *= 1 - DECAY


def _rows_used(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows``, and the sum of the ``values`` of each."""
    used, at = np.unique(rows, return_inverse=True)
    sums = np.zeros((len(used), values.shape[1]), np.float32)
    _add_rows(sums, at, values)
    return used, sums


def train(texts: list[str], labels: list[int], share: float, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Fit on whole texts. ``share`` is the toxic share that the final threshold is meant for."""
    w = initial(seed)
    y = np.array(labels, np.float32)
    place: dict[str, int] = {}
    spans: list[tuple[int, int]] = []
    parts, bags, base = [], [], 0
    for text in texts:
        words = WORD.findall(text.lower())
        parts.append(np.fromiter((place.setdefault(x, len(place)) for x in words), np.int32, len(words)))
        mine = windows(len(words))
        bags.append((len(spans), len(spans) + len(mine)))
        spans += [(base + s, base + e) for s, e in mine]
        base += len(words)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    _, rows, flat, starts = features(list(place), w)
    sizes = np.diff(np.append(starts, len(flat)))
    del place
    full = [i for i, (a, b) in enumerate(bags) if b > a]
    if not full or len(set(y[full])) < 2:
        return Model(w, shift=1e3)  # nothing to learn from: no text is toxic
    aside, seen = _sides(texts, y, full)
    folds = [[i for k, i in enumerate(seen) if k % FOLDS == f] for f in range(FOLDS)]
    tell = lambda some: said([parts[i] for i in some], y[some], rows, flat, starts, sizes)
    known, others = tell(seen), [tell([i for i in seen if i not in fold]) for fold in map(set, folds)]
    rng, adam = np.random.default_rng(seed), _Adam(w)

    def with_start(start: Weights) -> Weights:
        return {**w, "word": w["word"] + start["word"], "char": w["char"] + start["char"]}

    def best_logits(of: list[int], start: Weights) -> tuple[np.ndarray, list[int]]:
        """The highest logit of each text, and its window."""
        x = _inputs(rows, flat, starts, sizes, with_start(start))
        some = [s for i in of for s in range(*bags[i])]
        logits = Model(w).logits(ids, [spans[s] for s in some], _project(x, w["xf"]) + w["bf"], _project(x, w["xb"]) + w["bb"])
        top, where, at = [], [], 0
        for i in of:
            n = bags[i][1] - bags[i][0]
            k = int(logits[at : at + n].argmax())
            top.append(logits[at + k])
            where.append(bags[i][0] + k)
            at += n
        return np.array(top), where

    def telling(of: list[int], start: Weights) -> list[int]:
        """The window of each text with the most evidence."""
        x = _inputs(rows, flat, starts, sizes, start)
        sums = np.append(0, np.cumsum((x[:, 0] + x[:, EMBED]).astype(np.float64)[ids]))
        return [max(range(*bags[i]), key=lambda s: sums[spans[s][1]] - sums[spans[s][0]]) for i in of]

    # small samples are seen more often
    epochs = max(epochs, min(40, -(-STEPS * BATCH // (2 * len(seen)))))
    every = max(1, epochs // EPOCHS)
    weigh = np.where(y > 0, 1 / (2 * y[seen].mean()), 1 / (2 * (1 - y[seen].mean())))
    best, kept = None, None
    tops = [telling(fold, start) for fold, start in zip(folds, others)]
    for epoch in range(epochs):
        if epoch and epoch % every == 0:
            tops = [best_logits(fold, start)[1] if fold else [] for fold, start in zip(folds, others)]
        steps = []
        for fold, top, start in zip(folds, tops, others):
            picks = [(t, i) for t, i in zip(top, fold)] + [(int(rng.integers(*bags[i])), i) for i in fold if not y[i]]
            rng.shuffle(picks)
            steps += [(picks[at : at + BATCH], start) for at in range(0, len(picks), BATCH)]
        rate = RATE * (0.2 if epoch >= epochs * 3 // 4 else 1)
        for k in rng.permutation(len(steps)):
            some, start = steps[k]
            words, mask = _padded(ids, [spans[s] for s, _ in some])
            used, local = np.unique(words, return_inverse=True)
            own_starts = np.cumsum(sizes[used]) - sizes[used]
            own = np.arange(sizes[used].sum()) + np.repeat(starts[used] - own_starts, sizes[used])
            x = _inputs(rows[used], flat[own], own_starts, sizes[used], w) + _inputs(rows[used], flat[own], own_starts, sizes[used], start)
            heard = (rng.random(len(x)) >= DROP)[:, None].astype(np.float32)
            docs = [i for _, i in some]
            grads, dx = gradients(x * heard, local.reshape(words.shape), mask, y[docs], weigh[docs] / len(some), w)
            dx *= heard
            touched = {}
            touched["word"], grads["word"] = _rows_used(rows[used], dx[:, :EMBED])
            touched["char"], grads["char"] = _rows_used(flat[own], np.repeat(dx[:, EMBED:] / sizes[used][:, None], sizes[used], axis=0))
            adam.step(w, grads, rate, touched)
        if epoch % every == every - 1 or epoch == epochs - 1:
            loss = _loss(best_logits(aside, known)[0], y[aside])
            if best is None or loss < best:
                best, kept = loss, {k: x.copy() for k, x in w.items()}
    w = settled(kept)
    judged = [(aside, known)] if aside is not seen else []
    judged += [(fold, start) for fold, start in zip(folds, others) if fold]
    logits = np.concatenate([best_logits(of, start)[0] for of, start in judged])
    marks = np.concatenate([y[of] for of, _ in judged])
    return Model(with_start(known), *_threshold(logits, marks, share))


def _sides(texts: list[str], y: np.ndarray, full: list[int]) -> tuple[list[int], list[int]]:
    """Rows held aside, and rows to learn from: of each class one in ``ASIDE``, by a hash of the text. Without both classes on both sides, all are on both."""
    order = sorted(full, key=lambda i: zlib.crc32(texts[i].encode(), 2))
    of = [[i for i in order if y[i] == v] for v in (0, 1)]
    aside = [i for rows in of for i in rows[: len(rows) // ASIDE]]
    held = set(aside)
    seen = [i for i in order if i not in held]
    return (aside, seen) if len(set(y[aside])) == 2 and len(set(y[seen])) == 2 else (full, full)


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    """Share of pairs of a toxic and a clean row in the wrong order, with the log loss of the best shift as a tie-breaker."""
    toxic, clean = np.sort(logits[y > 0]), logits[y == 0]
    wrong = float(np.searchsorted(toxic, clean, side="right").mean()) / len(toxic)
    spread = float(toxic.mean() - clean.mean()) / (float(logits.std()) + 1e-6)
    return wrong - 1e-3 * spread


def _threshold(logits: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Middle of the widest best cut by F1 at the toxic share, of those that at most ``FALSE`` of the clean rows exceed; and a scale of 1."""
    order = np.argsort(logits)
    x, t = logits[order], y[order]
    pos, neg = share / max(1, t.sum()), (1 - share) / max(1, (1 - t).sum())
    caught = (t.sum() - np.cumsum(t)) * pos
    wrong = (1 - t).sum() - np.cumsum(1 - t)
    f1 = 2 * caught / np.maximum(1e-12, caught + wrong * neg + share)
    f1[wrong > FALSE * (1 - t).sum()] = -1
    if f1[:-1].max() <= 0:  # no cut catches a toxic row and spares the clean ones
        return float(x[-1]) + 1, 1.0
    gaps = np.where(f1[:-1] >= f1[:-1].max() - 1e-9, x[1:] - x[:-1], -1)
    i = int(gaps.argmax())
    return float((x[i] + x[i + 1]) / 2), 1.0


def sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, float]:
    """``place, id, text, y``: at most ``most`` labelled texts, half of them toxic; and the toxic share of all labelled rows.

    Rows are taken in the order of a hash of their id, ``place``. Rows that are held out, have a null id,
    label or text, or contradictory labels, are not taken. Of repeated ids the smallest text counts.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("top")).where("y = top")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [rows.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(most // 2).select("id", "y") for v in (0, 1)]
    wanted = F.broadcast(some[0].unionByName(some[1]))  # at most ``most`` rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id").where(F.col("text").isNotNull())
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text")).select(F.xxhash64("id").alias("place"), "id", "text", F.col("y").cast("int").alias("y"))
    return texts, counts.get(1, 0) / max(1, sum(counts.values()))


def held_out(id_col) -> F.Column:
    """Rows whose crc32 of the id as text is divisible by 5; they are never trained on."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    most: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_bytes: int = SAMPLE_BYTES,
) -> Model:
    """A model from at most ``most`` labelled rows and ``most_bytes`` bytes of their whole texts.

    For nulls, repeated ids and contradictory labels see :func:`sample`. Labels without texts, of one
    class only or from an empty table give a model that finds no text toxic. Other columns are not read.
    Training is one task: one that is lost runs again, to the same weights.
    """
    rows, share = sample(docs, labels, most, id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks, left = [], [], most_bytes
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = len(text.encode())
                if size <= left:
                    texts.append(text)
                    marks.append(y)
                    left -= size
        model = train(texts, marks, share)
        del texts
        gc.collect()  # the worker goes on to other tasks
        parts = {**model.weights, "cut": np.array([model.shift, model.scale])}
        yield pa.RecordBatch.from_arrays([pa.array(list(parts)), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["name", "weights"])

    ordered = rows.repartition(1).sortWithinPartitions("place", "id").select("text", "y")
    got = {r["name"]: r["weights"] for r in ordered.mapInArrow(run, "name string, weights binary").collect()}  # of fixed size
    if not got:
        return Model(initial(), shift=1e3)
    weights = {k: np.frombuffer(got[k], np.float32).reshape(x.shape).copy() for k, x in initial().items()}
    return Model(weights, *np.frombuffer(got["cut"], np.float64).tolist())


def score(docs: DataFrame, model: Model, text_col: str = "text", column: str = "toxicity") -> DataFrame:
    """All columns of ``docs``, and ``column``: a score of 0 to 1; 0.5 is the decision.

    Null texts and texts without a word score 0. Equal texts get equal scores, whatever is scored beside
    them. Texts may be of any length: all windows count. A column of the name ``column`` is replaced,
    others are kept. An empty table gives an empty table. No shuffle; the model is of fixed size.
    """
    kept = [c for c in docs.columns if c != column]
    shape = docs.select(*kept).withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches, 150):
            scores = scorer.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*kept, column])

    return docs.select(*kept).mapInArrow(run, shape.schema)
