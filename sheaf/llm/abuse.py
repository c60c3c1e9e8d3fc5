"""Abusive, hateful or sexual content (problem 8).

A bidirectional gated recurrent network with attention pooling reads each overlapping window of a
document's words; a word enters as the sum of what its spelling is known for (a word embedding) and
what its letters look like (embeddings of its character n-grams). It is written and trained in numpy
on rated documents. A document's score is that of its worst window, so it does not matter where the
language stands; spellings are brought together before (width, marks, look-alike letters, invisible
characters, spaced, stretched and masked words).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import ship

WINDOW, STRIDE = 24, 16
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 14

# Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    "абвгеёзикмнорстухѕіјԁһԛԝАВЕЅІЈКМНОРСТУХαβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "a6bree3ukmhopctyxsijdhqwABESIJKMHOPCTYXabeiknoptuxABEZHIKMNOPTYX",
)
LEET = str.maketrans("01345789@$", "oleastbgas")
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁩︀-️﻿]")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ .\-_*·|/])(?:[^\W\d_]\1){2,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"@?[\w$*\u0300-\u036f]+(?:[@$'’*][\w$*\u0300-\u036f]+)*|[\"“”„«»`?!]")
_RUN = re.compile(r"(.)\1{2,}")
# Names in program style: a word and capitalised words of two letters or more each. Other mixed case is a way to spell.
_CAMEL = re.compile(r"[A-Za-z]?[a-z]+(?:[A-Z][a-z]{2,}|[A-Z]{2,}(?![a-z])|\d+)+[a-z]?(?:\.\w+)*")
_LEET_WORD = re.compile(r"[a-z@$]+[0134578@$]+[a-z]*|[a-z]+(?:[0134578@$]+[a-z]+)+|[@$]+(?:[a-z]+[0134578@$]*)*")


def plain_word(raw: str) -> str:
    """One token in its plain spelling; numbers are ``#`` and names of program parts ``@id``."""
    if not raw.isascii():
        raw = unicodedata.normalize("NFKD", raw.translate(LOOK_ALIKES))
        raw = "".join(c for c in raw if not unicodedata.combining(c)) or "#"
    if len(raw) > 6 and _SPACED.fullmatch(raw):
        raw = raw.replace(raw[1], "")
    if raw[0] in "\"“”„«»`":
        return '"'
    if raw.isdigit():
        return "#"
    # "@$$" and the like are spellings, "@name" is a name.
    if "_" in raw or (raw[0] == "@" and raw[1:2].isalpha() and raw[1:].isalnum()) or (_CAMEL.fullmatch(raw) and not raw.islower() and any(c.isupper() for c in raw[1:])):
        return "@id"
    w = raw.lower()
    if not w.isalpha():
        if "*" in w:
            w = re.sub(r"\*+", "*", w)
            if not any(c.isalpha() for c in w):
                return "*"
        if any(c.isdigit() or c in "@$" for c in w):
            if w.startswith("0x") or not _LEET_WORD.fullmatch(w) or (sum(c.isalpha() for c in w) < 2 and (w.strip("@$") or len(w) < 3)):
                return "#" if any(c.isdigit() for c in w) else w
            w = w.translate(LEET)
    return _RUN.sub(r"\1", w)


def tokens_of(text: str) -> list[str]:
    """Words and quotes of a text, without invisible characters and with spaced-out words put together.

    Width forms, marks and look-alike letters are left to ``plain_word``, which sees each word once.
    """
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    found = _TOKEN.findall(text)
    # A spaced-out word leaves four letters or more standing alone.
    if sum(len(t) == 1 for t in found) > 3 and _SPACED.search(text):
        found = _TOKEN.findall(_SPACED.sub(lambda m: m[0].replace(m[1], ""), text))
    return found


def _grams(word: str) -> list[int]:
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode()) % GRAM_ROWS for n in (2, 3, 4) for i in range(max(1, len(w) - n + 1))]


class Vocabulary:
    """Words met so far, each with its embedding row and the rows of its character n-grams."""

    def __init__(self, limit: int = 150_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.raw: dict[str, int] = {}
        self.ids: dict[str, int] = {"": 0}
        self.rows: list[int] = [0]
        self.grams: list[list[int]] = [[0]]

    def ids_of(self, text: str | None) -> list[int]:
        if not text:
            return []
        tokens = tokens_of(text)
        out = list(map(self.raw.get, tokens))
        if None in out:
            out = [self._new(t) if i is None else i for i, t in zip(out, tokens)]
        return out

    def _new(self, token: str) -> int:
        i = self.raw.get(token)
        if i is None:
            w = plain_word(token)
            i = self.ids.get(w)
            if i is None:
                i = self.ids[w] = len(self.rows)
                self.rows.append(zlib.crc32(w.encode()) % WORD_ROWS)
                self.grams.append(_grams(w))
            self.raw[token] = i
        return i

    def full(self) -> bool:
        return len(self.raw) > self.limit


def all_windows(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, ends): all overlapping windows of documents with words, one row each, padded with 0.

    Windows start every ``STRIDE`` words and the last reaches the end, so any ``WINDOW - STRIDE`` words
    in a row stand in one window; ``ends[k]`` to ``ends[k + 1]`` are those of document ``k``.
    """
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    number = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    ends = np.concatenate([[0], np.cumsum(number)])
    base = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.zeros(base[-1] + WINDOW, np.int32)
    flat[: base[-1]] = np.fromiter((i for d in docs for i in d), np.int32, base[-1])
    owner = np.repeat(np.arange(len(docs)), number)
    starts = (np.arange(ends[-1]) - ends[owner]) * STRIDE
    left = np.minimum(sizes[owner] - starts, WINDOW)
    out = flat[(base[owner] + starts)[:, None] + np.arange(WINDOW)]
    out[np.arange(WINDOW) >= left[:, None]] = 0
    return out, ends


def windows(ids: list[int]) -> np.ndarray:
    """All overlapping windows of one document."""
    return all_windows([ids])[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _sum_by(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by their place ``at`` in 0..n-1."""
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    out[places] = np.add.reduceat(values[order], first, axis=0)
    return out


def flat_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All entries in a row, and how many each list has."""
    return np.fromiter((x for g in lists for x in g), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


@dataclass
class Network:
    """Parameters of the network: a plain dictionary of arrays, sent to the workers as they are."""

    p: dict[str, np.ndarray]
    hidden: int

    @classmethod
    def fresh(cls, size: int = 24, hidden: int = 24, seed: int = 7) -> Network:
        g = np.random.default_rng(seed)
        f = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"E": g.normal(0, 0.1, (WORD_ROWS, size)).astype(np.float32), "C": g.normal(0, 0.1, (GRAM_ROWS, size)).astype(np.float32)}
        for d in "fb":
            p |= {f"W{d}": f(2 * size, 3 * hidden), f"U{d}": f(hidden, 3 * hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}
        p |= {"A": f(2 * hidden, hidden), "a": np.zeros(hidden, np.float32), "v": f(hidden), "o": f(2 * hidden), "c": np.full(1, -1.0, np.float32)}
        return cls(p, hidden)

    def vectors(self, rows: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One vector a word: its embedding beside the mean of its n-grams' (``sizes`` of ``flat`` each); padding is all zero."""
        sums = np.add.reduceat(self.p["C"][flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        return np.concatenate([self.p["E"][rows], sums / sizes[:, None].astype(np.float32)], axis=1)

    def _run(self, P: list[np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (n, T, 2h) of both directions, run side by side; ``P``: projected inputs (words) of each.

        The second direction reads its windows from their end: its step t is place T - 1 - t.
        """
        (n, T), H = ids.shape, self.hidden
        U = np.stack([self.p["Uf"], self.p["Ub"]])
        h, dtype = np.zeros((2, n, H), P[0].dtype), P[0].dtype
        out, trace = np.empty((T, 2, n, H), dtype), []
        both = np.stack([mask, mask[:, ::-1]])
        for t in range(T):
            x, m = np.stack([P[0][ids[:, t]], P[1][ids[:, T - 1 - t]]]), both[:, :, t, None]
            hu = h @ U
            zr = _sigmoid(x[..., : 2 * H] + hu[..., : 2 * H])
            z, r = zr[..., :H], zr[..., H:]
            cand = np.tanh(x[..., 2 * H :] + r * hu[..., 2 * H :])
            new = h + m * (1 - z) * (cand - h)
            if keep:
                trace.append((h, z, r, cand, hu[..., 2 * H :], m))
            h = out[t] = new
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2).transpose(1, 0, 2), trace

    def forward(self, ids: np.ndarray, vec: np.ndarray, keep: bool = False):
        mask = (ids > 0).astype(np.float32)
        S, trace = self._run([vec @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"], ids, mask, keep)
        u = np.tanh(S @ self.p["A"] + self.p["a"])
        e = u @ self.p["v"] + (mask - 1) * 1e4
        e = np.exp(e - e.max(axis=1, keepdims=True)) * np.maximum(mask, 1e-9)
        alpha = e / e.sum(axis=1, keepdims=True)
        ctx = (alpha[:, None, :] @ S)[:, 0]
        logit = ctx @ self.p["o"] + self.p["c"]
        return logit, (mask, trace, S, u, alpha, ctx)

    def backward(self, ids, vec, state, dlogit) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of the word vectors."""
        mask, trace, S, u, alpha, ctx = state
        p, H, (n, T) = self.p, self.hidden, ids.shape
        g = {"o": ctx.T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
        dctx = dlogit[:, None] * p["o"]
        dS = alpha[:, :, None] * dctx[:, None, :]
        da = (S @ dctx[:, :, None])[:, :, 0]
        de = alpha * (da - (alpha * da).sum(axis=1, keepdims=True))
        g["v"] = (u * de[:, :, None]).sum(axis=(0, 1))
        du = de[:, :, None] * p["v"] * (1 - u * u)
        flat = du.reshape(-1, H)
        g["A"], g["a"] = S.reshape(-1, 2 * H).T @ flat, flat.sum(axis=0)
        dS = (dS + du @ p["A"].T).transpose(1, 0, 2)
        dS = np.stack([dS[..., :H], dS[::-1, :, H:]], axis=1)
        U = np.stack([p["Uf"], p["Ub"]])
        dU, dh = np.zeros_like(U), np.zeros((2, n, H), dS.dtype)
        each = np.empty((T, 2, n, 3 * H), dS.dtype)
        for t in range(T - 1, -1, -1):
            h, z, r, cand, hun, m = trace[t]
            dh = dh + dS[t]
            dn = dh * m
            dcand = dn * (1 - z) * (1 - cand * cand)
            dz = -dn * (cand - h) * z * (1 - z)
            dr = dcand * hun * r * (1 - r)
            each[t] = np.concatenate([dz, dr, dcand], axis=2)
            rec = np.concatenate([dz, dr, dcand * r], axis=2)
            dU += h.transpose(0, 2, 1) @ rec
            dh = dh - dn * (1 - z) + rec @ U.transpose(0, 2, 1)
        dvec = np.zeros_like(vec)
        for k, d in enumerate("fb"):
            places = each[:, k] if d == "f" else each[::-1, k]
            dP = _sum_by(ids.T.ravel(), places.reshape(-1, 3 * H), len(vec))
            dP[0] = 0
            g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = dU[k], vec.T @ dP, dP.sum(axis=0)
            dvec += dP @ p[f"W{d}"].T
        return g, dvec


class Scorer:
    """Scores texts with a trained network; keeps projected words between blocks.

    The same numbers as ``Network.forward``, laid out for speed: inputs are fetched a place at a time,
    windows of one length go together (no mask, no work on padding), and the halves of
    sigmoid(x) = (tanh(x / 2) + 1) / 2 are folded into the weights.
    """

    def __init__(self, net: Network):
        self.net, self.vocab = net, Vocabulary()
        self.forget()

    def forget(self) -> None:
        """Drops the projected words, as the network has changed or the vocabulary was cleared."""
        p, H = self.net.p, self.net.hidden
        self.gates = {d: np.zeros((0, 2 * H), np.float32) for d in "fb"}
        self.inputs = {d: np.zeros((0, H), np.float32) for d in "fb"}
        self.U = {d: (np.ascontiguousarray(p[f"U{d}"][:, : 2 * H]) * np.float32(0.5), np.ascontiguousarray(p[f"U{d}"][:, 2 * H :]) * np.float32(0.5)) for d in "fb"}

    def _project(self) -> None:
        have, v, H = len(self.gates["f"]), self.vocab, self.net.hidden
        if have < len(v.rows):
            vec = self.net.vectors(np.array(v.rows[have:]), *flat_lists(v.grams[have:]))
            if have == 0:
                vec[0] = 0
            for d in "fb":
                new = vec @ self.net.p[f"W{d}"] + self.net.p[f"b{d}"]
                self.gates[d] = np.concatenate([self.gates[d], new[:, : 2 * H] * np.float32(0.5)])
                self.inputs[d] = np.concatenate([self.inputs[d], new[:, 2 * H :]])

    def _block(self, ids: np.ndarray) -> np.ndarray:
        """Logits of windows without padding; ``ids`` by place, then window."""
        p, H, (T, n) = self.net.p, self.net.hidden, ids.shape
        S = np.empty((T, n, 2 * H), np.float32)
        for k, d in enumerate("fb"):
            gates, inputs, (U, V) = self.gates[d], self.inputs[d], self.U[d]
            h = np.zeros((n, H), np.float32)
            zr, c = np.empty((n, 2 * H), np.float32), np.empty((n, H), np.float32)
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                np.take(gates, ids[t], axis=0, out=zr, mode="clip")
                np.take(inputs, ids[t], axis=0, out=c, mode="clip")
                zr += h @ U
                np.tanh(zr, out=zr)
                zr[:, H:] += 1
                hc = h @ V
                hc *= zr[:, H:]
                c += hc
                np.tanh(c, out=c)
                c -= h
                zr[:, :H] -= 1
                c *= zr[:, :H]
                c *= np.float32(0.5)
                h = h - c
                S[t, :, k * H : (k + 1) * H] = h
        u = S.reshape(T * n, 2 * H) @ p["A"]
        u += p["a"]
        np.tanh(u, out=u)
        e = (u @ p["v"]).reshape(T, n)
        e = np.exp(e - e.max(axis=0))
        return ((S.reshape(T * n, 2 * H) @ p["o"]).reshape(T, n) * e).sum(axis=0) / e.sum(axis=0) + p["c"]

    def window_logits(self, ids: np.ndarray, block: int = 512) -> np.ndarray:
        self._project()
        out = np.empty(len(ids), np.float32)
        length = (ids > 0).sum(axis=1)
        order = np.argsort(length, kind="stable")
        bounds = np.flatnonzero(np.diff(length[order])) + 1
        for group in np.split(order, bounds) if len(ids) else ():
            for i in range(0, len(group), block):
                rows = group[i : i + block]
                out[rows] = self._block(np.ascontiguousarray(ids[rows, : length[rows[0]]].T))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the worst window of each text; 0 for null and wordless texts."""
        if self.vocab.full():
            self.vocab.clear()
            self.forget()
        ids = [self.vocab.ids_of(t) for t in texts]
        out = np.zeros(len(texts))
        held = [k for k, x in enumerate(ids) if x]
        if held:
            flat, ends = all_windows([ids[k] for k in held])
            worst = np.maximum.reduceat(self.window_logits(flat), ends[:-1])
            out[held] = _sigmoid(worst.astype(float))
        return out


def fit(texts: list[str], target: list[float], epochs: int = 24, seed: int = 7, batch: int = 128, rate: float = 2e-3) -> Network:
    """Train on rated documents, each standing for its one worst window (multiple-instance learning).

    The first windows of abusive documents are those with the highest log-odds of their words; later
    ones are chosen by the network. Documents not abusive give their worst window and a random one.
    Targets are softened by the network's own view from the middle on, as raters err. Deterministic
    for given rows in a given order.
    """
    rng = np.random.default_rng(seed)
    net = Network.fresh(seed=seed)
    scorer = Scorer(net)
    vocab = scorer.vocab
    vocab.limit = 1 << 60
    docs = [(x, float(y)) for x, y in ((vocab.ids_of(t), y) for t, y in zip(texts, target)) if x]
    if len({y > 0.5 for _, y in docs}) < 2:
        net.p["o"][:] = 0  # nothing to tell apart: every score is the same low one
        net.p["c"][:] = -6
        return net
    y = np.array([t for _, t in docs])
    flat, ends = all_windows([x for x, _ in docs])
    owner = np.repeat(np.arange(len(docs)), np.diff(ends))
    # First choice of windows: log-odds of words by documents.
    n_words = len(vocab.rows)
    seen = np.unique(np.repeat(owner, WINDOW) * n_words + flat.ravel())
    pos = np.bincount(seen % n_words, weights=y[seen // n_words], minlength=n_words)
    neg = np.bincount(seen % n_words, weights=1 - y[seen // n_words], minlength=n_words)
    odds = np.log((pos + 0.3) / (y.sum() + 1)) - np.log((neg + 0.3) / ((1 - y).sum() + 1))
    odds[0] = 0
    weight = np.clip(odds, 0, None)
    window_score = weight[flat].sum(axis=1)
    rows, (all_grams, n_grams) = np.array(vocab.rows), flat_lists(vocab.grams)
    first_gram = np.cumsum(n_grams) - n_grams
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items()}
    step = 0
    up = 1.5
    for epoch in range(epochs):
        if epoch in (2, 5, 9, 14, 19):
            scorer.forget()
            window_score = scorer.window_logits(flat)
        top = np.array([s + int(np.argmax(window_score[s:e])) for s, e in zip(ends, ends[1:])])
        believed = y.copy()
        if epoch >= 6:
            own = _sigmoid(window_score[top].astype(float))
            doubt = 0.2 if epoch < 9 else 0.5
            believed = np.where(y > 0.5, np.where(own < doubt, 0.0, y), np.where(own > 0.97, 0.5, y))
        # The worst windows of the documents not abusive that look worst, and as many windows at random.
        loud, quiet = np.flatnonzero(y > 0.5), np.flatnonzero(y <= 0.5)
        hard = quiet[np.argsort(-window_score[top[quiet]], kind="stable")[: max(len(loud), 64)]]
        other = rng.choice(quiet, min(len(quiet), max(len(loud), 64)), replace=False)
        some = np.array([ends[k] + int(rng.integers(ends[k + 1] - ends[k])) for k in other], int)
        chosen = np.concatenate([top[loud], top[hard], some])
        goal = np.concatenate([believed[loud], believed[hard], np.zeros(len(some))]).astype(np.float32)
        size = int(np.clip(len(chosen) // 24, 16, batch))
        rounds = max(1, -(-24 * size // len(chosen)))
        order = np.concatenate([rng.permutation(len(chosen)) for _ in range(rounds)])
        lr = rate * min(1.0, 2.0 * (1 - epoch / epochs) + 0.05)
        for i in range(0, len(order), size):
            pick = order[i : i + size]
            used, local = np.unique(flat[chosen[pick]], return_inverse=True)
            local = local.reshape(len(pick), WINDOW)
            if used[0] != 0:  # place 0 is padding
                used, local = np.concatenate([[0], used]), local + 1
            sizes = n_grams[used]
            flat_grams = all_grams[np.repeat(first_gram[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            vec = net.vectors(rows[used], flat_grams, sizes)
            vec[0] = 0
            drop = (rng.random(vec.shape) > 0.15).astype(np.float32) / 0.85
            # Now and then a word is known by its letters only.
            drop[:, : net.p["E"].shape[1]] *= (rng.random((len(vec), 1)) > 0.2)
            logit, state = net.forward(local, vec * drop, keep=True)
            t = goal[pick]
            g, dvec = net.backward(local, vec * drop, state, (_sigmoid(logit) - t) * np.where(t > 0.5, up, 1.0).astype(np.float32) / len(pick))
            dvec *= drop
            cols = net.p["E"].shape[1]
            g["E"] = _sum_by(rows[used[1:]], dvec[1:, :cols], WORD_ROWS)
            share = np.repeat(dvec[:, cols:] / sizes[:, None].astype(np.float32), sizes, axis=0)
            g["C"] = _sum_by(flat_grams[sizes[0] :], share[sizes[0] :], GRAM_ROWS)
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                m, v = moments[k]
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                m += 0.1 * (x - m)
                v += 0.001 * (x * x - v)
                net.p[k] -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def ratings(labels: DataFrame, key: str = "doc_id", verdict: str = "verdict") -> DataFrame:
    """(key, target): mean of the decided ratings of each document; undecided ones count for nothing."""
    return labels.where(F.col(verdict).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(F.col(verdict)).alias("target"))


def training_rows(docs: DataFrame, labels: DataFrame, most: int, key: str = "doc_id", text: str = "text", longest: int = 50_000) -> DataFrame:
    """At most ``most`` rated documents with clear ratings, drawn by a hash of the key; rated texts of more than ``longest`` characters serve no training."""
    clear = ratings(labels, key).where(F.col("target") != 0.5)
    held = clear.orderBy(F.xxhash64(key), key).limit(most)
    return docs.select(key, text).join(F.broadcast(held), key).where(F.length(text) <= longest).dropDuplicates([key])


#: Fewer rated documents called abusive than this teach the network little.
FEW_ABUSIVE = 500
_fitted: dict[str, Network] = {}


def train(docs: DataFrame, labels: DataFrame, most: int = 6000, key: str = "doc_id", text: str = "text", longest: int = 50_000) -> Network:
    """Fit on the driver, on at most ``most`` rated documents of at most ``longest`` characters (the documented bounds of the sample).

    The network fitted last is kept: queries over the same ratings share it. Warns where ratings are
    too few to learn from.
    """
    got = training_rows(docs, labels, most, key, text, longest).collect()
    got.sort(key=lambda r: r[key])
    loud = sum(r["target"] > 0.5 for r in got)
    if loud < FEW_ABUSIVE:
        warnings.warn(f"only {loud} rated documents are abusive: with fewer than {FEW_ABUSIVE}, recall is below 0.9", stacklevel=2)
    mark = hashlib.sha256(repr([(r[key], r["target"], r[text]) for r in got]).encode()).hexdigest()
    if mark not in _fitted:
        _fitted.clear()
        _fitted[mark] = fit([r[text] for r in got], [float(r["target"]) for r in got])
    return _fitted[mark]


def score(df: DataFrame, net: Network, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1) of every row; null, empty and wordless texts score 0."""
    ship(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(net)  # its size is fixed by the network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for b in batches:
            for part in blocks(b, len(keep)):
                s = scorer.scores(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(s, pa.float64())], names=[*keep, "score"])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", score double"
    return df.select(*keep, F.col(text).cast("string")).mapInArrow(run, schema)


def blocks(batch: pa.RecordBatch, text: int, most_rows: int = 4096, most_chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch: many rows for speed, bounded bytes so that long texts don't pile up."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
        size += n or 0
        if size >= most_chars or i + 1 - start >= most_rows:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def rates(scored: DataFrame, source: str = "source", threshold: float = 0.5) -> DataFrame:
    """Documents, flagged documents, their share and the mean score per source; null sources are one group."""
    hit = (F.col("score") >= threshold).cast("long")
    return scored.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(hit).alias("n_flagged"), F.avg(hit).alias("rate"), F.avg("score").alias("mean_score")
    )


__all__ = ["Network", "Scorer", "fit", "rates", "ratings", "score", "train", "windows"]
