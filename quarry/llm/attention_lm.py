"""A small causal self-attention language model in numpy, over subword slots.

A slot is one of the SLOTS - 1 most frequent subword ids; slot 0 stands for all others. The attention layer predicts the
class of the next subword from its window; within the class, and as a start for the classes, it has the corpus's counts
of adjacent subwords. All factors are proper distributions, so a score is the log of a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

SLOTS, CLASSES, WIDTH = 2048, 32, 16
#: A window has CONTEXT subwords before the STRIDE ones that it scores.
STRIDE, CONTEXT = 16, 8
SPAN = STRIDE + CONTEXT
#: What gradient steps change.
LEARNT = ("query", "key", "value", "rest", "lag", "out", "bias")
#: Windows of a step; subwords that a task lays out at a time, and that it learns from at least.
BATCH, HELD, TASK_SUBWORDS = 512, 1 << 18, 1_000_000
#: Shares of the texts that each round learns from; rows that a model is summed in.
ROUNDS, PARTS = (1, 2, 4, 8), 16


def smoothed(pairs: np.ndarray, strength: float = 20.0) -> np.ndarray:
    """P(next | slot) from counts of adjacent slots, each row leaning on the overall counts."""
    every = pairs.sum(axis=0) + 0.1
    every /= every.sum()
    return ((pairs + strength * every) / (pairs.sum(axis=1, keepdims=True) + strength)).astype(np.float32)


def token_classes(pairs: np.ndarray, n_classes: int = CLASSES, seed: int = 3) -> np.ndarray:
    """Class of each slot: frequent slots have their own, the others are grouped by what they follow (k-means)."""
    n, count = len(pairs), pairs.sum(axis=0)
    own = min(n_classes // 2, n)
    order = np.argsort(-count, kind="stable")
    out = np.zeros(n, np.int64)
    out[order[:own]] = np.arange(own)
    rest = order[own:]
    if not len(rest):
        return out
    k = min(n_classes - own, len(rest))
    rng = np.random.default_rng(seed)
    profile = np.sqrt(pairs[:, rest].T / np.maximum(count[rest], 1)[:, None]) @ rng.standard_normal((n, 48)) / 7
    centre = profile[:k].copy()
    weight = np.sqrt(count[rest] + 1)
    for _ in range(12):
        near = np.argmin((centre**2).sum(1) - 2 * profile @ centre.T, axis=1)
        for c in range(k):
            if (near == c).any():
                centre[c] = np.average(profile[near == c], axis=0, weights=weight[near == c])
    out[rest] = own + near
    return out


@dataclass
class AttentionLM:
    pair: np.ndarray  # (slots, slots) log10 P(next | slot)
    classes: np.ndarray  # class of each slot
    base: np.ndarray  # (slots, classes) ln P(class | slot)
    query: np.ndarray  # (slots, width), as are key, value, rest
    key: np.ndarray
    value: np.ndarray
    rest: np.ndarray
    lag: np.ndarray  # (span,) score added by distance
    out: np.ndarray  # (width, classes)
    bias: np.ndarray

    @classmethod
    def start(cls, pairs: np.ndarray, seed: int = 5, n_classes: int = CLASSES) -> AttentionLM:
        p = smoothed(pairs)
        classes = token_classes(pairs, n_classes)
        by_class = np.zeros((len(p), n_classes), np.float32)
        for c in range(n_classes):
            by_class[:, c] = p[:, classes == c].sum(axis=1)
        rng = np.random.default_rng(seed)
        table = lambda s: (s * rng.standard_normal((len(p), WIDTH))).astype(np.float32)
        return cls(np.log10(p), classes, np.log(np.maximum(by_class, 1e-12)), table(0.3), table(0.3), table(0.3), table(0.3), np.zeros(SPAN, np.float32), (0.05 * rng.standard_normal((WIDTH, n_classes))).astype(np.float32), np.zeros(n_classes, np.float32))

    def _bias(self) -> np.ndarray:
        """Score added by distance between the STRIDE scored places and the SPAN of the window; later places are out."""
        distance = np.arange(CONTEXT, SPAN)[:, None] - np.arange(SPAN)[None, :]
        return np.where(distance >= 0, self.lag[np.clip(distance, 0, SPAN - 1)], np.float32(-1e4)).astype(np.float32)

    def _forward(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, rest: np.ndarray, base: np.ndarray):
        """Masked attention over a batch of windows: q and rest (windows, STRIDE, width), k and v (windows, SPAN, width).
        base has the bias in it."""
        s = np.matmul(q, k.transpose(0, 2, 1))
        s *= np.float32(WIDTH**-0.5)
        s += self._bias()
        # scores stay small, so no maximum is taken off; sums over short axes are fastest as products
        if s.max() > 60:
            np.minimum(s, np.float32(60), out=s)
        np.exp(s, out=s)
        s *= 1 / np.matmul(s, np.ones((SPAN, 1), np.float32))
        h = np.matmul(s, v)
        h += rest
        h /= 1 + np.abs(h)
        flat = h.reshape(-1, WIDTH)
        z = flat @ self.out
        z += base
        if z.max() > 80:
            np.minimum(z, np.float32(80), out=z)
        return s, flat, z

    def _tables(self) -> tuple[np.ndarray, ...]:
        """What scoring looks up: key, value and a one; scaled query and the rest; ln P of the classes; and ln P of a slot
        within its class, given the one before. Made once in a process."""
        if "_made" not in self.__dict__:
            within = (self.pair * np.float32(np.log(10)) - self.base[:, self.classes]).ravel()
            self._made = (np.hstack([self.key, self.value, np.ones((len(self.key), 1), np.float32)]), np.hstack([self.query * np.float32(WIDTH**-0.5), self.rest]), self.base + self.bias, within)
        return self._made

    def score(self, slots: np.ndarray, lengths: np.ndarray, end: int, chunk: int = 128) -> np.ndarray:
        """log10 P of each slot of sequences (concatenated in slots, each closed by ``end``), each scored once.

        The sequences are laid out in one stream of inputs, each begun on a multiple of STRIDE and preceded by CONTEXT
        end marks, so that a window is SPAN places of the stream and the next one begins STRIDE later.
        """
        if not len(slots):
            return np.zeros(0)
        kv, qr, base, within = self._tables()
        n_classes, decay, ones = base.shape[1], np.exp(self._bias()), np.ones(base.shape[1], np.float32)
        room = -(-(lengths + CONTEXT) // STRIDE) * STRIDE
        first, at = np.cumsum(lengths) - lengths, np.cumsum(room) - room
        place = np.arange(len(slots)) + np.repeat(at - first, lengths)
        stream = np.full(int(room.sum()) + CONTEXT + 1, end, np.int64)
        stream[place + (CONTEXT + 1)] = slots  # a sequence's last slot is the end mark that stands before the next one
        wanted = np.zeros(int(room.sum()), np.int64)
        wanted[place] = self.classes[slots]
        gain = np.empty(len(wanted), np.float32)
        size = chunk * STRIDE
        both, mine = np.empty((size + CONTEXT, kv.shape[1]), np.float32), np.empty((size, qr.shape[1]), np.float32)
        z, more = np.empty((size, n_classes), np.float32), np.empty((size, n_classes), np.float32)
        s, h = np.empty((chunk, STRIDE, SPAN), np.float32), np.empty((chunk, STRIDE, WIDTH + 1), np.float32)
        windows = np.lib.stride_tricks.as_strided(both, (chunk, SPAN, kv.shape[1]), (STRIDE * both.strides[0], *both.strides))
        rows = np.arange(size) * n_classes
        for a in range(0, len(wanted), size):
            x = stream[a : min(a + size, len(wanted)) + CONTEXT]
            m = len(x) - CONTEXT
            n = m // STRIDE
            np.take(kv, x, axis=0, out=both[: len(x)], mode="clip")
            np.take(qr, x[CONTEXT:], axis=0, out=mine[:m], mode="clip")
            np.take(base, x[CONTEXT:], axis=0, out=more[:m], mode="clip")
            q, w = mine[:m].reshape(n, STRIDE, -1), windows[:n]
            np.matmul(q[..., :WIDTH], w[..., :WIDTH].transpose(0, 2, 1), out=s[:n])
            if s[:n].max() > 60:
                np.minimum(s[:n], np.float32(60), out=s[:n])
            np.exp(s[:n], out=s[:n])
            s[:n] *= decay
            # the ones beside the values sum the weights up
            np.matmul(s[:n], w[..., WIDTH:], out=h[:n])
            g = h[:n, :, :WIDTH] / h[:n, :, WIDTH:]
            g += q[..., WIDTH:]
            g /= 1 + np.abs(g)
            np.matmul(g.reshape(m, WIDTH), self.out, out=z[:m])
            z[:m] += more[:m]
            if z[:m].max() > 80:
                np.minimum(z[:m], np.float32(80), out=z[:m])
            found = z.ravel()[rows[:m] + wanted[a : a + m]]
            np.exp(z[:m], out=z[:m])
            gain[a : a + m] = found - np.log(z[:m] @ ones)
        before = np.empty(len(slots), np.int64)
        before[1:] = slots[:-1]
        before[first] = end
        return (within[before * SLOTS + slots].astype(np.float64) + gain[place]) / np.log(10)

    def vector(self) -> np.ndarray:
        """All that gradient steps change, as one vector."""
        return np.concatenate([getattr(self, n).ravel() for n in LEARNT])

    def take_over(self, vector: np.ndarray) -> None:
        """Set what gradient steps change."""
        at = 0
        for n in LEARNT:
            old = getattr(self, n)
            getattr(self, n)[...] = vector[at : at + old.size].reshape(old.shape)
            at += old.size
        self.__dict__.pop("_made", None)

    def _gradients(self, kv: np.ndarray, qr: np.ndarray, x: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Summed loss in nats over classes, and the mean gradients, of windows x (windows, SPAN) with their next slots
        (windows, STRIDE); those below 0 don't count. kv and qr: key and value, query and rest, side by side."""
        n, scale, scored = len(x), np.float32(WIDTH**-0.5), x[:, CONTEXT:]
        both, mine = np.take(kv, x, axis=0, mode="clip"), np.take(qr, scored, axis=0, mode="clip")
        q, k, v = mine[..., :WIDTH], both[..., :WIDTH], both[..., WIDTH:]
        a, h, z = self._forward(q, k, v, mine[..., WIDTH:], np.take(self.base + self.bias, scored.ravel(), axis=0, mode="clip"))
        np.exp(z, out=z)  # no more than 80
        z *= (1 / (z @ np.ones(z.shape[1], np.float32)))[:, None]
        want = target.ravel()
        counts = want >= 0
        cell = np.arange(len(z)) * z.shape[1] + self.classes[want]
        p = z.ravel()[cell]
        loss = float(-np.log(np.maximum(p, 1e-12))[counts].sum())
        z.ravel()[cell] = p - 1
        if not counts.all():
            z[~counts] = 0
        # the mean is taken of what comes of it
        mean = np.float32(1 / max(1, counts.sum()))
        grads = {"out": h.T @ z * mean, "bias": np.ones(len(z), np.float32) @ z * mean}
        slope = 1 - np.abs(h)
        slope *= slope
        slope *= z @ (self.out.T * mean)
        dh = slope.reshape(n, STRIDE, WIDTH)
        ds = np.matmul(dh, v.transpose(0, 2, 1))
        ds -= np.matmul(a * ds, np.ones((SPAN, 1), np.float32))
        ds *= a
        seen = np.arange(CONTEXT, SPAN)[:, None] - np.arange(SPAN)[None, :]
        grads["lag"] = np.bincount(np.clip(seen, 0, SPAN - 1).ravel(), (ds.sum(axis=0) * (seen >= 0)).ravel(), minlength=SPAN).astype(np.float32)
        ds *= scale
        # side by side as in the tables
        both, mine = np.empty_like(both), np.empty_like(mine)
        np.matmul(ds, k, out=mine[..., :WIDTH])
        mine[..., WIDTH:] = dh
        np.matmul(ds.transpose(0, 2, 1), q, out=both[..., :WIDTH])
        np.matmul(a.transpose(0, 2, 1), dh, out=both[..., WIDTH:])
        for name, index, each in (("qr", scored, mine), ("kv", x, both)):
            flat = index.astype(np.uint16).ravel()
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            starts = np.concatenate([[0], np.nonzero(flat[1:] != flat[:-1])[0] + 1])
            g = np.take(each.reshape(-1, 2 * WIDTH), order, axis=0, mode="clip")
            grads[name] = np.zeros_like(kv)
            # sums two numbers at a time
            grads[name][flat[starts]] = np.add.reduceat(g.view(np.complex64), starts, axis=0).view(np.float32)
        return loss, grads

    def learn(self, texts: Iterator[np.ndarray], rates: tuple[float, float], planned: int, times: int = 1, seed: int = 11) -> tuple[float, int]:
        """Adam over texts, each closed by the end mark: every subword of every text is predicted once, or
        ``times`` times. The rate goes from the first to the second in the planned number of steps. Returns the summed
        loss and how many subwords were predicted. HELD subwords are laid out at a time; for more times all are held."""
        rng, step, loss, total = np.random.default_rng(seed), 0, 0.0, 0
        now = {"kv": np.hstack([self.key, self.value]), "qr": np.hstack([self.query, self.rest]), "lag": self.lag, "out": self.out, "bias": self.bias}
        m1, m2 = ({n: np.zeros_like(p) for n, p in now.items()} for _ in range(2))
        all_, parts = [], held_parts(texts)
        for k in range(times):
            for part in parts if k == 0 else all_:
                if times > 1 and k == 0:
                    all_.append(part)
                n = -(-(len(part) - CONTEXT - 1) // STRIDE)
                stream = np.zeros(n * STRIDE + CONTEXT + 1, np.int64)
                stream[: len(part)] = part
                wanted = stream.copy()
                wanted[len(part) :] = -1
                view = np.lib.stride_tricks.sliding_window_view
                x, target = view(stream, SPAN)[::STRIDE][:n], view(wanted[CONTEXT + 1 :], STRIDE)[::STRIDE]
                for at in np.array_split(rng.permutation(n), -(-n // BATCH)):
                    step += 1
                    lost, grads = self._gradients(now["kv"], now["qr"], x[at], target[at])
                    loss += lost
                    rate = (rates[0] + (rates[1] - rates[0]) * min(1.0, step / planned)) * min(1.0, step / 50)
                    for name, p in now.items():
                        g, a, b = grads[name], m1[name], m2[name]
                        a += np.float32(0.1) * (g - a)
                        g *= g
                        b += np.float32(0.01) * (g - b)
                        root = np.sqrt(b * np.float32(1 / (1 - 0.99**step)))
                        root += np.float32(1e-8)
                        p -= np.float32(rate / (1 - 0.9**step)) * a / root
                total += len(part) - CONTEXT - 1
        self.key[...], self.value[...] = now["kv"][:, :WIDTH], now["kv"][:, WIDTH:]
        self.query[...], self.rest[...] = now["qr"][:, :WIDTH], now["qr"][:, WIDTH:]
        return loss, total

    def fit(self, texts: DataFrame, steps: int = 400, rate: float = 0.01) -> list[float]:
        """Learn from all texts: texts has (slots binary, share long from 0 to the sum of ROUNDS). Every subword of every
        text is predicted once and gives its gradient, in ROUNDS; after each the tasks' models are averaged, by how much
        they learnt from, and the next one begins with that. Texts too few for two tasks are learnt by one, as often as it
        takes for so many steps. Returns the mean loss of each round, in nats per subword over classes."""
        spark, losses = texts.sparkSession, []
        total = texts.agg(F.sum(F.length("slots"))).first()[0]
        if not total:
            return losses
        total //= 2
        alone = total < 2 * TASK_SUBWORDS
        times = max(1, -(-steps * BATCH * STRIDE // total)) if alone else 1
        rounds, done = (sum(ROUNDS),) if alone else ROUNDS, 0
        for k, share in enumerate(rounds):
            tasks = max(1, total * share // sum(rounds) // TASK_SUBWORDS) if not alone else 1
            planned = max(1, total * times * share // sum(rounds) // tasks // (BATCH * STRIDE))
            rates = tuple(rate * (1 - 0.9 * x / len(rounds)) for x in (k, k + 1))
            begun = spark.sparkContext.broadcast(replace(self, pair=np.zeros(0, np.float32)))  # SLOTS * (4 * WIDTH + CLASSES) floats

            def run(slices, begun=begun, planned=planned, rates=rates):
                model = replace(begun.value, **{n: getattr(begun.value, n).copy() for n in LEARNT})
                loss, n = model.learn((np.frombuffer(x, "<u2") for b in slices for x in b.column(0).to_pylist()), rates, planned, times)
                if n:
                    for part, piece in enumerate(np.array_split(model.vector().astype(np.float64) * n, PARTS)):
                        yield {"part": [part], "data": [piece.tobytes()], "loss": [loss], "n": [n]}

            def summed(slices):
                sums = {}
                for b in slices:
                    for part, data, loss, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        old = sums.get(part, (0, 0.0, 0))
                        sums[part] = (old[0] + np.frombuffer(data), old[1] + loss, old[2] + n)
                for part, (data, loss, n) in sums.items():
                    yield {"part": [part], "data": [data.tobytes()], "loss": [loss], "n": [n]}

            schema = "part int, data binary, loss double, n long"
            learnt = map_rows(texts.where((F.col("share") >= done) & (F.col("share") < done + share)).select("slots").coalesce(tasks), run, schema)
            # PARTS rows
            found = sorted(map_rows(learnt.repartition(PARTS, "part"), summed, schema).collect(), key=lambda r: r["part"])
            done += share
            begun.destroy()
            if found:
                self.take_over(np.concatenate([np.frombuffer(r["data"]) / r["n"] for r in found]))
                losses.append(found[0]["loss"] / found[0]["n"])
        return losses


def held_parts(texts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The texts one after the other, CONTEXT + 1 end marks before them, in parts of about HELD slots."""
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= HELD:
            yield np.concatenate([np.full(CONTEXT + 1, held[0][-1], np.uint16), *held])
            held, size = [], 0
    if size:
        yield np.concatenate([np.full(CONTEXT + 1, held[0][-1], np.uint16), *held])
