"""A bidirectional gated recurrent network with attention pooling over windows of words, in numpy.

A word's input is its embedding, if the training sample knows it, and the mean embedding of its hashed byte trigrams.
Gates and states use x / (1 + |x|) for their squashing, which costs a division and has a simple derivative.
"""

from __future__ import annotations

import numpy as np

HIDDEN, WORD_DIM, CHAR_DIM, BUCKETS = 8, 7, 4, 4096
#: With a stride of half the window, every passage of up to WINDOW - STRIDE + 1 words is whole in a window
WINDOW, STRIDE = 32, 16
PAD, UNKNOWN = 0, 1
CACHE_WORDS, BATCH = 150_000, 1024


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the marked words, and where each word's begin. A word of n bytes has n."""
    raw = np.frombuffer(b"".join(b"\x01%b\x02" % w for w in words), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + 2 * np.repeat(np.arange(len(words)), sizes)
    h = (raw[at] * np.uint32(2654435761) + raw[at + 1]) * np.uint32(2246822519) + raw[at + 2]
    return ((h * np.uint32(3266489917)) >> np.uint32(20)).astype(np.int64) % BUCKETS, starts


def windows(n: int) -> list[int]:
    """First words of the overlapping windows that cover n words."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE)) if n else []


class Network:
    def __init__(self, vocabulary: dict[bytes, int], weights: dict[str, np.ndarray], scale: tuple[float, float] = (1.0, 0.0)):
        self.vocabulary, self.w, self.scale = vocabulary, weights, scale
        self.cache: dict[bytes, int] = {}
        self.rows = None

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "w": self.w, "scale": self.scale, "cache": {}, "rows": None}

    def features(self, words: list[bytes], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams, starts = trigrams(words)
        sums = np.add.reduceat(self.w["C"][grams], starts, axis=0)
        sizes = np.diff(np.concatenate([starts, [len(grams)]]))[:, None]
        return np.concatenate([self.w["E"][known], sums / sizes], axis=1).astype(np.float32), grams, starts

    def project(self, words: list[bytes]) -> np.ndarray:
        known = np.array([self.vocabulary.get(w, UNKNOWN) for w in words])
        return self.features(words, known)[0] @ self.w["W"] + self.w["b"]

    def pad_row(self) -> np.ndarray:
        return np.concatenate([self.w["E"][PAD], np.zeros(CHAR_DIM, np.float32)]) @ self.w["W"] + self.w["b"]

    def forward(self, x: np.ndarray, real: np.ndarray, keep: bool = False):
        """x: inputs [time, batch, both directions' gates]; real: [time, batch], False for padding. Returns logits."""
        steps, batch, h3 = x.shape[0], x.shape[1], 3 * HIDDEN
        states = np.zeros((steps, batch, 2 * HIDDEN), np.float32)
        kept: list[list] = [[None] * steps, [None] * steps]
        for d, name in enumerate(("Uf", "Ub")):
            u, h, part = self.w[name], np.zeros((batch, HIDDEN), np.float32), slice(d * HIDDEN, (d + 1) * HIDDEN)
            for t in range(steps) if d == 0 else reversed(range(steps)):
                g, gx = h @ u, x[t, :, d * h3 : (d + 1) * h3]
                s = squash(g[:, : 2 * HIDDEN] + gx[:, : 2 * HIDDEN])
                zr = 0.5 + 0.5 * s
                z, r, hn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
                n = squash(gx[:, 2 * HIDDEN :] + r * hn)
                new = h + z * (n - h)
                if keep:
                    kept[d][t] = (h, s, z, r, hn, n)
                h = new
                states[t, :, part] = h
        a = states @ self.w["v"]
        a[~real] = -1e9
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        logits = pooled @ self.w["o"] + self.w["c"][0]
        return (logits, states, a, pooled, kept) if keep else logits

    def gradients(self, words: list[bytes], known: np.ndarray, index: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the weighted log loss. index [time, batch]: numbers of `words`, -1 for padding."""
        feats, grams, starts = self.features(words, known)
        feats = np.concatenate([feats, np.concatenate([self.w["E"][PAD], np.zeros(CHAR_DIM, np.float32)])[None]])
        x = (feats @ self.w["W"] + self.w["b"])[index]
        logits, states, a, pooled, kept = self.forward(x, index >= 0, True)
        p = 1 / (1 + np.exp(-logits))
        dl = ((p - target) * weight / weight.sum()).astype(np.float32)
        dpool = dl[:, None] * self.w["o"]
        dstates = a[..., None] * dpool
        da = np.einsum("tbh,bh->tb", states, dpool)
        da = a * (da - (a * da).sum(axis=0))
        dstates += da[..., None] * self.w["v"]
        g = {"o": dl @ pooled, "c": np.array([dl.sum()]), "v": np.einsum("tb,tbh->h", da, states)}
        dx, h3 = np.zeros_like(x), 3 * HIDDEN
        for d, name in enumerate(("Uf", "Ub")):
            u, carry, du = self.w[name], 0, np.zeros_like(self.w[name])
            order = reversed(range(len(x))) if d == 0 else range(len(x))
            for t in order:
                h, s, z, r, hn, n = kept[d][t]
                dh = dstates[t, :, d * HIDDEN : (d + 1) * HIDDEN] + carry
                dn = dh * z * (1 - np.abs(n)) ** 2
                flat = 0.5 * (1 - np.abs(s)) ** 2
                dz, dr = dh * (n - h) * flat[:, :HIDDEN], dn * hn * flat[:, HIDDEN:]
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                du += h.T @ dg
                carry = dh * (1 - z) + dg @ u.T
                dx[t, :, d * h3 : (d + 1) * h3] = np.concatenate([dz, dr, dn], axis=1)
            g[name] = du
        flat_dx, flat_index = dx.reshape(-1, dx.shape[2]), index.ravel()
        dfeat_x = np.zeros((len(feats), dx.shape[2]), np.float32)
        np.add.at(dfeat_x, flat_index, flat_dx)
        g["W"], g["b"] = feats.T @ dfeat_x, dfeat_x.sum(axis=0)
        dfeat = dfeat_x @ self.w["W"].T
        g["E"] = np.zeros_like(self.w["E"])
        np.add.at(g["E"], np.append(known, PAD), dfeat[:, :WORD_DIM])
        g["C"] = np.zeros_like(self.w["C"])
        sizes = np.diff(np.concatenate([starts, [len(grams)]]))
        np.add.at(g["C"], grams, np.repeat(dfeat[:-1, WORD_DIM:] / sizes[:, None], sizes, axis=0))
        return g

    def logits(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Logits of all windows of each text; a text without words has none."""
        if self.rows is None or len(self.cache) > CACHE_WORDS:
            self.cache, self.rows = {}, self.pad_row()[None].astype(np.float32)
        flat = [w for words in texts for w in words]
        index = list(map(self.cache.get, flat))
        if None in index:
            new = list({w for w, k in zip(flat, index) if k is None})
            self.cache.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, self.project(new).astype(np.float32)])
            index = list(map(self.cache.__getitem__, flat))
        ids = np.array([*index, *([0] * WINDOW)], np.int64)
        first, counts, ends, at = [], [], [], 0
        for words in texts:
            own = windows(len(words))
            first += [at + k for k in own]
            counts.append(len(own))
            at += len(words)
            ends += [at] * len(own)
        out = np.empty(len(first), np.float32)
        place = np.arange(WINDOW)[:, None]
        for k in range(0, len(first), BATCH):
            grid = np.array(first[k : k + BATCH])[None] + place
            real = grid < np.array(ends[k : k + BATCH])[None]
            out[k : k + BATCH] = self.forward(self.rows[np.where(real, ids[grid], 0)], real)
        return np.split(out, np.cumsum(counts)[:-1]) if counts else []

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """The calibrated chance of label 1: that of the likeliest window, or of the network's bias without words."""
        a, b = self.scale
        top = np.array([x.max() if len(x) else self.w["c"][0] for x in self.logits(texts)], np.float64)
        return 1 / (1 + np.exp(-np.clip(a * top + b, -50, 50)))


def train(texts: list[list[bytes]], labels: np.ndarray, prior: float, seed: int = 5) -> Network:
    """Fits a network to texts with labels 0/1, both present. Every second epoch takes anew from a text of label 1 its likeliest
    windows and from one of label 0 its likeliest and a random one. prior: the share of label 1, for the calibration,
    which uses every fourth text of a label; the network learns from the others."""
    rng = np.random.Generator(np.random.PCG64(seed))
    turn = np.where(labels == 1, np.cumsum(labels), np.cumsum(1 - labels))
    apart = np.flatnonzero(turn % 4 == 0)
    all_texts, all_labels = texts, labels
    if len(set(labels[apart].tolist())) == 2:
        texts, labels = [texts[k] for k in np.flatnonzero(turn % 4)], labels[turn % 4 != 0]
    else:
        apart = np.arange(len(texts))
    count: dict[bytes, list[int]] = {}
    for words, y in zip(texts, labels.tolist()):
        for w in set(words):
            count.setdefault(w, [0, 0])[y] += 1
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    odds = {w: np.log((b + 1) / (n1 + 2)) - np.log((a + 1) / (n0 + 2)) for w, (a, b) in count.items() if a + b >= 3}
    vocabulary = {w: k + 2 for k, w in enumerate(sorted(odds))}
    init = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    w = {"E": init(len(vocabulary) + 2, WORD_DIM) * 0.2, "C": init(BUCKETS, CHAR_DIM) * 0.3, "W": init(WORD_DIM + CHAR_DIM, 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, np.float32), "Uf": init(HIDDEN, 3 * HIDDEN), "Ub": init(HIDDEN, 3 * HIDDEN), "v": init(2 * HIDDEN), "o": init(2 * HIDDEN), "c": np.full(1, -1, np.float32)}
    w["E"][:, 0] = 0
    for word, k in vocabulary.items():
        w["E"][k, 0] = np.clip(odds[word], -2, 4) / 2
    net = Network(vocabulary, w)
    hint = [np.array([max((odds.get(x, 0.0) for x in words[k : k + WINDOW]), default=0.0) for k in windows(len(words))]) for words in texts]
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in w.items()}
    step = 0
    examples = sum(min(2, len(r)) for r in hint)
    batch = min(256, max(32, examples // 40))
    epochs = min(16, max(4, 160 * batch // max(1, examples)))
    ranks = hint
    for epoch in range(epochs):
        if epoch % 2 == 1:
            ranks = net_logits(net, texts)
        chosen = []
        for t, (r, y) in enumerate(zip(ranks, labels.tolist())):
            if len(r):
                best = np.argsort(-r, kind="stable")[: 2 if y else 1].tolist()
                best += [] if y else rng.integers(0, len(r), 1).tolist()
                chosen += [(t, windows(len(texts[t]))[k], y) for k in best]
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), batch):
            part = [chosen[j] for j in order[k : k + batch]]
            rows = [texts[t][at : at + WINDOW] for t, at, _ in part]
            number: dict[bytes, int] = {}
            index = np.full((WINDOW, len(rows)), -1)
            for j, row in enumerate(rows):
                index[: len(row), j] = [number.setdefault(x, len(number)) for x in row]
            words = list(number)
            # some known words are hidden, so that spelling is learnt too
            known = np.array([vocabulary.get(x, UNKNOWN) for x in words])
            known[rng.random(len(known)) < 0.1] = UNKNOWN
            y = np.array([y for _, _, y in part], np.float32)
            g = net.gradients(words, known, index, y, np.ones(len(y), np.float32))
            step += 1
            rate = 0.02 * (0.5 if epoch >= epochs // 2 else 1)
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                w[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        net.rows = None
    top = np.array([x.max() if len(x) else w["c"][0] for x in net_logits(net, [all_texts[k] for k in apart])], np.float64)
    net.scale = calibrated(top, all_labels[apart], prior)
    net.rows, net.cache = None, {}
    return net


def net_logits(net: Network, texts: list[list[bytes]]) -> list[np.ndarray]:
    return [x for k in range(0, len(texts), 256) for x in net.logits(texts[k : k + 256])]


def calibrated(logits: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic regression of the label on the logit (slope over 0), weighted to the prior, by Newton steps with a ridge."""
    weight = np.where(labels == 1, prior / max(1, labels.sum()), (1 - prior) / max(1, (1 - labels).sum())) * len(labels)
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    theta, centre = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - labels)) + 1.0 * (theta - centre)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return max(float(theta[0]), 0.05), float(theta[1])
