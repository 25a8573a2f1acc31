"""A character-level bidirectional LSTM with a CRF on top, in numpy: decoding and training.

In training, sequences of one length are handled together. For decoding they are packed: a batch is in
the order of falling lengths, and a step works on those that are long enough, the first n of them, so
nothing is padded or masked and a text's tags don't depend on its neighbours. The products of the character vectors with the input weights are taken once per character of the
alphabet, and a step then costs one look-up and one product with the recurrent weights.
"""

from __future__ import annotations

from collections import defaultdict
from multiprocessing import get_context

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BATCH = 768
#: More than rounding makes of the scores of paths.
MARGIN = 1.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    def __init__(self, alphabet: str, weights: dict[str, np.ndarray]):
        self.alphabet, self.w = alphabet, weights
        self.table = np.zeros(0x20000, np.int32)
        for k, c in enumerate(alphabet):
            self.table[min(ord(c), 0x1FFFF)] = k + 1
        self.table[-1] = 0
        self.tables: dict[str, np.ndarray] | None = None

    @classmethod
    def new(cls, alphabet: str, width: int = 20, hidden: int = 24, seed: int = 7) -> Tagger:
        r = np.random.default_rng(seed)
        w = {"E": r.normal(0, 0.3, (len(alphabet) + 1, width))}
        for d in "fb":
            w[f"{d}W"] = r.normal(0, 1 / np.sqrt(width), (width, 4 * hidden))
            w[f"{d}U"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            w[f"{d}b"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
        w |= {"O": r.normal(0, 0.2, (2 * hidden, len(TAGS))), "Ob": np.zeros(len(TAGS)), "T": np.zeros((len(TAGS), len(TAGS))), "S": np.zeros(len(TAGS)), "F": np.zeros(len(TAGS))}
        return cls(alphabet, {k: v.astype(np.float32) for k, v in w.items()})

    def widened(self, characters: str, seed: int = 9) -> Tagger:
        """This tagger with further characters in its alphabet, each beginning near the unknown one."""
        new = "".join(c for c in dict.fromkeys(characters) if c not in self.alphabet)
        rows = self.w["E"][:1] + np.random.default_rng(seed).normal(0, 0.1, (len(new), self.w["E"].shape[1]))
        return Tagger(self.alphabet + new, self.w | {"E": np.vstack([self.w["E"], rows]).astype(np.float32)})

    @classmethod
    def load(cls, path: str) -> Tagger:
        with np.load(path) as z:
            return cls(bytes(z["alphabet"]).decode("utf-8"), {k: z[k].astype(np.float32) for k in z.files if k != "alphabet"})

    def save(self, path: str) -> None:
        np.savez_compressed(path, alphabet=np.frombuffer(self.alphabet.encode("utf-8"), np.uint8), **{k: v.astype(np.float16) for k, v in self.w.items()})

    def codes(self, texts: list[str]) -> np.ndarray:
        """The codes of texts of one length, unknown characters being 0."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), -1)
        return self.table[np.minimum(points, 0x1FFFF)]

    def _packed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes (time, batch) of texts in the order of falling lengths, and how many of them reach each time."""
        lengths = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.zeros((len(texts), lengths[0]), np.intp)
        x[np.arange(lengths[0]) < lengths[:, None]] = self.table[np.minimum(points, 0x1FFFF)]
        return x.T.copy(), (lengths[:, None] > np.arange(lengths[0])).sum(axis=0)

    def _scores(self, x: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Scores (time, tags, batch) of packed codes (time, batch); 0 behind a sequence's end.

        Gates lie one behind the other, so each operation goes over memory without gaps. Inputs are
        scaled so that one exp and one quotient do all gates: sigmoid(x) = 1 / (1 + exp(-x)) and
        tanh(x) = 2 / (1 + exp(-2x)) - 1; what exp takes beyond all numbers becomes 0 there. The cell is
        kept as -2 times its value, for the same reason.
        """
        n = self.w["fU"].shape[0]
        if self.tables is None:
            scale = np.r_[np.full(3 * n, -1), np.full(n, -2)].astype(np.float32)
            gates = lambda m: np.ascontiguousarray((m * scale).reshape(-1, 4, n).transpose(1, 0, 2))
            self.tables = {k: gates(self.w["E"] @ self.w[f"{k}W"] + self.w[f"{k}b"]) for k in "fb"}
            self.tables |= {f"{k}U": gates(self.w[f"{k}U"]) for k in "fb"}
        size = x.shape[1]
        out = np.zeros((len(x), len(TAGS), size), np.float32)
        over = np.array([1, 1, 1, -4], np.float32)[:, None, None]  # with 2 added, the last is -2 tanh
        bias = self.w["Ob"][:, None]
        z_all, e_all = (np.empty(4 * size * n, np.float32) for _ in "ze")
        h_all, c_all, s_all = (np.empty((size, n), np.float32) for _ in "hcs")
        part_all = np.empty(len(TAGS) * size, np.float32)
        with np.errstate(over="ignore"):
            for d, weights in (("f", self.w["O"][:n].T.copy()), ("b", self.w["O"][n:].T.copy())):
                table, u = self.tables[d], self.tables[f"{d}U"]
                h_all[:] = c_all[:] = 0
                k = -1
                for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
                    if k != active[t]:
                        k = active[t]
                        h, c, s, part = h_all[:k], c_all[:k], s_all[:k], part_all[: len(TAGS) * k].reshape(-1, k)
                        z, e = z_all[: 4 * k * n].reshape(4, k, n), e_all[: 4 * k * n].reshape(4, k, n)
                    np.matmul(h, u, out=z)
                    z += table.take(x[t, :k], 1, e, "clip")
                    np.exp(z, out=z)
                    z += 1
                    np.divide(over, z, out=z)
                    np.add(z[3], 2, out=s)
                    s *= z[0]
                    c *= z[1]
                    c += s
                    np.exp(c, out=s)
                    s += 1
                    np.divide(2, s, out=s)
                    s -= 1
                    np.multiply(s, z[2], out=h)
                    np.matmul(weights, h.T, out=part)
                    np.add(out[t, :, :k] if d == "b" else bias, part, out=out[t, :, :k])
        return out

    def _open(self, s: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Which sequences of packed scores (time, tags, batch) may hold a span; on the best path of the others every tag is O.

        A path leaves O in runs. What a run gains over O is at most `gain`: by each character the tag's
        score, less that of O, and the most that any step to the tag gives; by the first character the step from
        O, or the beginning of the text. Where no run, with the step back to O or the text's end, reaches
        -MARGIN, none gains anything.
        """
        w = self.w
        steps = w["T"] - w["T"][0, 0]
        begin, end = ((w[k] - w[k][0])[1:, None].astype(np.float32) for k in "SF")
        enter, stay = steps[0, 1:, None].astype(np.float32), steps[1:, 1:].max(0)[:, None].astype(np.float32)
        back = steps[1:, 0].max()
        last = max(back, end.max())
        gain, out = np.full(s.shape[2], -np.inf, np.float32), np.zeros(s.shape[2], bool)
        for t, k in enumerate(active):
            own, g = s[t, 1:, :k] - s[t, 0, :k], gain[:k]
            g += (own + stay).max(0)
            np.maximum(g, (own + (enter if t else begin)).max(0), out=g)
            out[:k] |= g > -MARGIN - back
            ends = active[t + 1] if t + 1 < len(active) else 0
            out[ends:k] |= g[ends:] > -MARGIN - last
        return out

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The spans (start, end, kind) of each text on the best path."""
        out: list = [[] for _ in texts]
        ids = sorted((k for k, t in enumerate(texts) if t), key=lambda k: -len(texts[k]))
        for start in range(0, len(ids), BATCH):
            own = ids[start : start + BATCH]
            x, active = self._packed([texts[k] for k in own])
            s = self._scores(x, active)
            some = np.flatnonzero(self._open(s, active))
            if len(some):
                best = self._best(s[: len(texts[own[some[0]]])].take(some, axis=2).transpose(0, 2, 1), np.searchsorted(some, active))
                for k in np.flatnonzero(best.any(axis=0)):
                    at = own[some[k]]
                    out[at] = _spans(best[: len(texts[at]), k])
        return out

    def _best(self, s: np.ndarray, active: np.ndarray | None = None) -> np.ndarray:
        """Tags (time, batch) of the best paths over packed scores (time, batch, tags); 0 behind a sequence's end."""
        active = np.full(len(s), s.shape[1]) if active is None else active
        s = np.ascontiguousarray(s.transpose(0, 2, 1))
        trans = self.w["T"]
        v = np.zeros_like(s)
        v[0] = s[0] + self.w["S"][:, None]
        for t in range(1, len(s)):
            k = active[t]
            np.add((v[t - 1][:, None, :k] + trans[:, :, None]).max(0), s[t][:, :k], out=v[t][:, :k])
        out, tag, k = np.zeros((len(s), s.shape[2]), np.int8), np.zeros(s.shape[2], np.int64), 0
        for t in range(len(s) - 1, -1, -1):
            # the best way to the tags behind is found again, so no pointers are kept; sequences that end here join
            tag[:k] = (v[t][:, :k] + trans[:, tag[:k]]).argmax(0)
            tag[k : active[t]] = (v[t][:, k : active[t]] + self.w["F"][:, None]).argmax(0)
            k = active[t]
            out[t, :k] = tag[:k]
        return out

    # Training

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags (time, batch), and its gradients."""
        w, (time, batch) = self.w, x.shape
        e = w["E"][x]
        kept, states = {}, []
        for d in "fb":
            u = w[f"{d}U"]
            n = u.shape[0]
            xin = e @ w[f"{d}W"] + w[f"{d}b"]
            h, c = (np.zeros((batch, n), np.float32) for _ in "hc")
            hs, cs, gates = (np.empty((time, batch, k), np.float32) for k in (n, n, 4 * n))
            for t in range(time) if d == "f" else range(time - 1, -1, -1):
                z = xin[t] + h @ u
                z[:, : 3 * n] = _sigmoid(z[:, : 3 * n])
                z[:, 3 * n :] = np.tanh(z[:, 3 * n :])
                c = z[:, n : 2 * n] * c + z[:, :n] * z[:, 3 * n :]
                h = z[:, 2 * n : 3 * n] * np.tanh(c)
                hs[t], cs[t], gates[t] = h, c, z
            kept[d] = hs, cs, gates
            states.append(hs)
        both = np.concatenate(states, 2)
        s = both @ w["O"] + w["Ob"]
        value, ds, grads = self._crf(s, y)
        grads["O"] = np.tensordot(both, ds, ((0, 1), (0, 1)))
        grads["Ob"] = ds.sum((0, 1))
        dh_all = ds @ w["O"].T
        de = np.zeros_like(e)
        for k, d in enumerate("fb"):
            hs, cs, gates = kept[d]
            u = w[f"{d}U"]
            n = u.shape[0]
            dh_next, dc_next = (np.zeros((batch, n), np.float32) for _ in "hc")
            dz_all = np.empty((time, batch, 4 * n), np.float32)
            before = np.zeros((time, batch, n), np.float32)
            order = range(time - 1, -1, -1) if d == "f" else range(time)
            for t in order:
                p = t - 1 if d == "f" else t + 1
                c_old = cs[p] if 0 <= p < time else np.zeros((batch, n), np.float32)
                if 0 <= p < time:
                    before[t] = hs[p]
                i, f, o, g = (gates[t][:, q * n : (q + 1) * n] for q in range(4))
                th = np.tanh(cs[t])
                dh = dh_all[t][:, k * n : (k + 1) * n] + dh_next
                dc = dc_next + dh * o * (1 - th * th)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c_old * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
                dz_all[t] = dz
                dh_next, dc_next = dz @ u.T, dc * f
            grads[f"{d}U"] = np.tensordot(before, dz_all, ((0, 1), (0, 1)))
            grads[f"{d}W"] = np.tensordot(e, dz_all, ((0, 1), (0, 1)))
            grads[f"{d}b"] = dz_all.sum((0, 1))
            de += dz_all @ w[f"{d}W"].T
        grads["E"] = np.zeros_like(w["E"])
        np.add.at(grads["E"], x.ravel(), de.reshape(-1, de.shape[2]))
        return value, grads

    def _crf(self, s: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        w, (time, batch, tags) = self.w, s.shape
        trans = w["T"]

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.empty_like(s), np.empty_like(s)
        alpha[0] = s[0] + w["S"]
        for t in range(1, time):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + s[t]
        beta[-1] = w["F"]
        for t in range(time - 2, -1, -1):
            beta[t] = lse(trans + (s[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1] + w["F"], 1)
        each = np.arange(batch)
        gold = sum(s[t, each, y[t]] for t in range(time)) + w["S"][y[0]] + w["F"][y[-1]]
        share = np.exp(alpha + beta - z[:, None])
        one = np.eye(tags, dtype=np.float32)[y]
        grads = {k: np.zeros_like(w[k]) for k in "TSF"}
        for t in range(1, time):
            gold = gold + trans[y[t - 1], y[t]]
            pair = np.exp(alpha[t - 1][:, :, None] + trans + (s[t] + beta[t] - z[:, None])[:, None, :])
            grads["T"] += pair.sum(0) - one[t - 1].T @ one[t]
        grads["S"] = (share[0] - one[0]).sum(0)
        grads["F"] = (share[-1] - one[-1]).sum(0)
        scale = 1 / batch
        return float((z - gold).mean()), ((share - one) * scale).astype(np.float32), {k: (v * scale).astype(np.float32) for k, v in grads.items()}


def _spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    out, start, kind = [], 0, 0
    for t, tag in enumerate([*tags.tolist(), 0]):
        now = (tag + 1) // 2
        if kind and (now != kind or tag % 2 == 1):
            out.append((start, t, KINDS[kind - 1]))
            kind = 0
        if now and not kind:
            start, kind = t, now
    return out


def tags_of(length: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for a, b, kind in spans:
        k = 2 * KINDS.index(kind) + 1
        out[a:b] = k + 1
        out[a] = k
    return out


def _share(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, dict[str, np.ndarray]]:
    value, grads = Tagger("", w).loss(x, y)
    return value * share, {k: g * share for k, g in grads.items()}


def fit(tagger: Tagger, examples: list[tuple[str, np.ndarray]], epochs: int, batch: int = 64, rate: float = 4e-3, seed: int = 1, say=None, workers: int = 1) -> None:
    """Adam over batches of equally long examples, each shared among the workers; the rate falls linearly to a tenth."""
    pool = get_context("fork").Pool(workers) if workers > 1 else None
    r = np.random.default_rng(seed)
    by: dict[int, list[int]] = defaultdict(list)
    for k, (text, _) in enumerate(examples):
        by[len(text)].append(k)
    m = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    batches_of = lambda: [b for ids in by.values() for p in [r.permutation(ids)] for b in np.split(p, range(batch, len(p), batch))]
    step, total = 0, epochs * len(batches_of())
    for epoch in range(epochs):
        losses, order = [], batches_of()
        for b in r.permutation(len(order)):
            own = [examples[k] for k in order[b]]
            x, y = tagger.codes([t for t, _ in own]).T.copy(), np.stack([y for _, y in own], 1)
            if pool and len(own) > workers:
                cut = np.array_split(np.arange(len(own)), workers)
                got = pool.starmap(_share, [(tagger.w, x[:, c], y[:, c], len(c) / len(own)) for c in cut], 1)
                value, grads = sum(v for v, _ in got), {k: sum(g[k] for _, g in got) for k in tagger.w}
            else:
                value, grads = tagger.loss(x, y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            now = rate * (1 - 0.9 * step / total)
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.005 * (g * g - v2[k])
                tagger.w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.995**step)) + 1e-8)
            losses.append(value * len(own))
        if say:
            say(f"epoch {epoch}: loss {sum(losses) / len(examples):.4f}")
    tagger.tables = None
    if pool:
        pool.terminate()
