"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows, forwards and backwards, and gives every position a probability for each
language; a document's probabilities are the means over all its positions. States begin anew with each window. It is written and trained in numpy, by
backpropagation through time, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.common import map_in_arrow, text_or_empty

#: Bytes in a window, the units of each direction, and the windows that are read side by side.
WINDOW, HIDDEN, LANES = 64, 8, 2048
#: Windows of a document that are learned from.
WINDOWS_EACH = 24
#: The label of a text without letters.
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


@dataclass
class Network:
    """Weights: for each direction the input rows (3, 256, h) of the update gate, reset gate and candidate, and the recurrent (3, h, h)."""

    labels: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray

    @classmethod
    def new(cls, labels: list[str], rng: np.random.Generator, hidden: int = HIDDEN) -> Network:
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(labels, [draw(3, 256, hidden, scale=0.3) for _ in "fb"], [draw(3, hidden, hidden, scale=hidden**-0.5) for _ in "fb"], [draw(hidden, len(labels), scale=0.3) for _ in "fb"], np.zeros(len(labels), dtype=np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, *self.out, self.bias]

    def states(self, windows: np.ndarray, side: int, keep: list | None = None) -> np.ndarray:
        """States (steps, lanes, h) of one direction for windows (steps, lanes) of bytes; ``keep`` gets what training needs."""
        x, u = self.inputs[side], self.recurrent[side]
        steps, lanes = windows.shape
        out = np.empty((steps, lanes, x.shape[2]), dtype=np.float32)
        h = np.zeros((lanes, x.shape[2]), dtype=np.float32)
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            g = x.take(windows[t], axis=1)
            a = np.matmul(h, u)
            gates = g[:2]
            gates += a[:2]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates
            n = r * a[2]
            n += g[2]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, h, z, r, n, a[2]))
            h = h - n
            h *= z
            h += n
            out[t] = h
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(labels, steps * lanes), step by step."""
        h = self.bias.shape[0]
        logits = np.zeros((h, windows.size), dtype=np.float32)
        for side in (0, 1):
            logits += self.out[side].T @ self.states(windows, side).reshape(windows.size, -1).T
        logits += self.bias[:, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits

    def gradients(self, windows: np.ndarray, targets: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions of windows (steps, lanes), and its gradients in the order of weights()."""
        steps, lanes = windows.shape
        kept: list[list] = [[], []]
        states = [self.states(windows, side, kept[side]) for side in (0, 1)]
        logits = sum(s.reshape(steps * lanes, -1) @ v for s, v in zip(states, self.out, strict=True)) + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        goal, rows = np.tile(targets, steps), np.arange(steps * lanes)
        loss = float(-np.log(np.maximum(p[rows, goal], 1e-12)).mean())
        p[rows, goal] -= 1
        p /= steps * lanes
        d_inputs, d_recurrent, d_out = [], [], []
        flat = windows.ravel().astype(np.intp)
        for side in (0, 1):
            u = self.recurrent[side]
            d_out.append(states[side].reshape(steps * lanes, -1).T @ p)
            d_states = (p @ self.out[side].T).reshape(states[side].shape)
            d_u, d_g = np.zeros_like(u), np.empty((3, *d_states.shape), dtype=np.float32)
            d_next = np.zeros_like(d_states[0])
            for t, before, z, r, n, a in reversed(kept[side]):
                d = d_states[t] + d_next
                d_n = d * (1 - z) * (1 - n * n)
                pre = np.stack((d * (before - n) * z * (1 - z), d_n * a * r * (1 - r), d_n * r))
                d_u += np.matmul(before.T, pre)
                d_next = d * z + np.matmul(pre, u.transpose(0, 2, 1)).sum(axis=0)
                d_g[0, t], d_g[1, t], d_g[2, t] = pre[0], pre[1], d_n
            # sums by byte value, a unit of a gate at a time
            units = np.ascontiguousarray(d_g.reshape(3, steps * lanes, -1).transpose(0, 2, 1))
            d_inputs.append(np.array([[np.bincount(flat, unit, 256) for unit in gate] for gate in units], dtype=d_g.dtype).transpose(0, 2, 1))
            d_recurrent.append(d_u)
        return loss, [*d_inputs, *d_recurrent, *d_out, p.sum(axis=0)]


def windows_of(text: str, seed: int = 0, most: int = WINDOWS_EACH) -> np.ndarray:
    """(n, WINDOW) bytes at random places of a text, at most ``most`` and no more than it has room for; of an empty text none.

    The places depend on the text and the seed alone.
    """
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(raw):
        return np.empty((0, WINDOW), dtype=np.uint8)
    rng = np.random.default_rng([seed, zlib.crc32(raw)])
    raw = np.pad(raw, (0, max(0, WINDOW - len(raw))), constant_values=32)
    starts = rng.integers(0, len(raw) - WINDOW + 1, min(most, 1 + len(raw) // WINDOW))
    return raw[starts[:, None] + np.arange(WINDOW)]


def train(windows: list[np.ndarray], labels: list[str], seed: int = 0, epochs: int = 4, batch: int = 256, rate: float = 0.02) -> Network:
    """Fits a network to the windows of documents with labels by Adam with a falling rate; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    known = sorted(set(labels))
    net = Network.new(known, rng)
    x = np.concatenate([np.empty((0, WINDOW), dtype=np.uint8), *windows])
    y = np.repeat(np.array([known.index(label) for label in labels], dtype=np.int64), [len(w) for w in windows])
    if not len(x):
        return net
    # the same number of windows for each label
    share = np.bincount(y, minlength=len(known)).max()
    order = np.concatenate([rng.permutation(np.resize(np.flatnonzero(y == k), share)) for k in range(len(known)) if (y == k).any()])
    m, v = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    total = epochs * -(-len(order) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(order)
        for a in range(0, len(order), batch):
            at = order[a : a + batch]
            _, grads = net.gradients(np.ascontiguousarray(x[at].T), y[at])
            step += 1
            lr = rate * (1 - step / (total + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for w, g, mean, square in zip(net.weights(), grads, m, v, strict=True):
                mean += 0.1 * (g - mean)
                square += 0.001 * (g * g - square)
                w -= (lr * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)
    return net


def read_texts(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the mean probabilities over its positions (texts, labels), and how many positions have which label.

    Every byte of every text is read, in windows of WINDOW bytes; what fills up the last window of a text does not
    count. An empty text gets zeros.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    pooled, votes = np.zeros((len(texts), len(net.labels))), np.zeros((len(texts), len(net.labels)), dtype=np.int64)
    if not net.labels:
        return pooled, votes
    padded = b"".join(t + b" " * (-len(t) % WINDOW) for t in texts)
    rows = np.frombuffer(padded, dtype=np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), -(-sizes // WINDOW))
    first = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(-(-sizes[:-1] // WINDOW), out=first[1:])
    for a in range(0, len(rows), LANES):
        own = owner[a : a + LANES]
        valid = np.minimum(sizes[own] - (np.arange(a, a + len(own)) - first[own]) * WINDOW, WINDOW)
        p = net.probabilities(np.ascontiguousarray(rows[a : a + LANES].T)).reshape(len(net.labels), WINDOW, -1)
        best = p == p.max(axis=0)
        if valid.min() < WINDOW:
            mask = np.arange(WINDOW)[:, None] < valid
            p = p * mask
            best &= mask
        for k in range(len(net.labels)):
            pooled[:, k] += np.bincount(own, p[k].sum(axis=0), len(texts))
            votes[:, k] += np.bincount(own, best[k].sum(axis=0), len(texts)).astype(np.int64)
    return pooled / np.maximum(sizes, 1)[:, None], votes


def _reader(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).cast(pa.binary()).to_pylist()
            found, scores, shares = [], [], []
            start = total = 0
            for k in range(len(raw) + 1):
                if k == len(raw) or (k > start and total + len(raw[k]) > LANES * WINDOW * 4):
                    if k > start:
                        pooled, votes = read_texts(net, raw[start:k])
                        for text, p, v in zip(raw[start:k], pooled, votes, strict=True):
                            if len(net.labels) and has_letter(text.decode("utf-8", "replace")):
                                best = int(p.argmax())
                                found.append(net.labels[best])
                                scores.append(min(1.0, float(p[best])))
                                shares.append(float(v[best]) / len(text))
                            else:
                                found.append(UNDETERMINED)
                                scores.append(0.0)
                                shares.append(0.0)
                    start, total = k, 0
                if k < len(raw):
                    total += len(raw[k])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score", "position_share"])

    return run


def label_positions(net: Network, text: str) -> list[str]:
    """The label of every byte of a text."""
    out = []
    raw = text.encode()
    for a in range(0, len(raw), WINDOW):
        part = np.frombuffer(raw[a : a + WINDOW].ljust(WINDOW), dtype=np.uint8)
        best = net.probabilities(np.ascontiguousarray(part[:, None])).argmax(axis=0)
        out += [net.labels[k] for k in best[: len(raw) - a]]
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 when divided by 4; a null id is as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _drawing(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [windows_of(t, seed).tobytes() if has_letter(t) else None for t in batch.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(drawn, pa.binary())], names=["lang", "place", "tie", "windows"])
            yield out.filter(out.column(3).is_valid())

    return run


def sample(docs: DataFrame, per_label: int = 250, most_labels: int = 256, seed: int = 0) -> DataFrame:
    """(lang, windows): what is learned from, at most ``per_label`` rows for each of the ``most_labels`` most frequent labels.

    Rows with a text and a label that are not held out are ranked by a hash of their ids and texts, so rows without ids
    or with equal ones are spread too; repeated rows count once. A row is the bytes of at most
    WINDOWS_EACH windows, drawn where the text is, so no text travels, however long.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_labels).collect()
    # labels are counted first, so that few more rows than needed are looked at
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text"), 11) / F.lit(float(2**53))
    bound = F.lit(-1.0)
    for row in counts:
        bound = F.when(F.col("lang") == row["lang"], min(1.0, (1.2 * per_label + 20) / row["n"])).otherwise(bound)
    near = known.select("lang", "text", place.alias("place"), F.xxhash64(F.lit(seed), F.col("text")).alias("tie")).where(F.col("place") <= bound)
    drawn = map_in_arrow(near, _drawing(seed), "lang string, place double, tie bigint, windows binary").dropDuplicates(["lang", "place", "tie"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "tie"))
    return drawn.withColumn("_ll_n", first).where(F.col("_ll_n") <= per_label).select("lang", "windows")


def fit(docs: DataFrame, per_label: int = 250, most_labels: int = 256, seed: int = 0) -> Network:
    """Trains on a bounded :func:`sample`: ``per_label`` documents of each label, ``most_labels`` labels, WINDOWS_EACH windows of a document.

    Rows without letters or label teach nothing, and of longer texts only these windows do; rows without a doc_id
    are within the same bounds; repeated rows count once; a table without labels gives a network without labels.
    """
    rows = sorted((r["lang"], bytes(r["windows"])) for r in sample(docs, per_label, most_labels, seed).collect())
    return train([np.frombuffer(w, dtype=np.uint8).reshape(-1, WINDOW) for _, w in rows], [lang for lang, _ in rows], seed)


def predict(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all) with lang_pred, score and position_share (positions with the label of the whole).

    A text that is null or has no letter is ``und`` with score 0, and so is every text where nothing could be
    learned (no labelled rows). Of equally probable labels the first in order is taken. Texts of any length are read
    whole; repeated rows get a row each, with equal results; clashing columns are replaced, others stay; an empty
    table gives an empty one. No shuffle.
    """
    rest = docs.drop("lang_pred", "score", "position_share") if keep is None else docs.select(*keep)
    rows = docs.select(text_or_empty().alias("_ll_text"), *[F.col(c) for c in rest.columns])
    fields = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("position_share", T.DoubleType())])
    return map_in_arrow(rows, _reader(net), fields)
