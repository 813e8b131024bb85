"""Language identification with a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of bytes that never cross a text. Two recurrent
layers read each window, one from either end; a linear layer labels every
position with language probabilities, and a document's probabilities are
their mean over all its bytes. Windows are independent, so a batch of
documents is one matrix with a row for each window, and memory is bounded
however long a text is.

The gates use the piecewise linear sigmoid clip(x / 5 + 1 / 2, 0, 1).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.llm.common import add_columns, received, send, text_buffer, thinned

WINDOW = 64
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Direction:
    """One recurrent layer: input tables and recurrent weights of update gate, reset gate and candidate."""

    inputs: np.ndarray  # 256 x 3 units, biases included
    recurrent: np.ndarray  # units x 3 units


@dataclass
class Network:
    languages: list[str] = field(default_factory=list)
    forward: Direction | None = None
    backward: Direction | None = None
    output: np.ndarray | None = None  # 2 units x languages
    bias: np.ndarray | None = None

    def parameters(self) -> list[np.ndarray]:
        layers = (self.forward, self.backward)
        return [*(x for d in layers for x in (d.inputs, d.recurrent)), self.output, self.bias]


def gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.2 * x + 0.5, 0, 1)


def fresh_network(languages: list[str], units: int, rng: np.random.Generator) -> Network:
    def layer():
        inputs = rng.normal(0, 0.3, (256, 3 * units))
        inputs[:, :units] += 1.0  # update gates start half closed: states are kept for a while
        return Direction(inputs, rng.normal(0, 0.6 / np.sqrt(units), (units, 3 * units)))

    output = rng.normal(0, 1 / np.sqrt(2 * units), (2 * units, len(languages)))
    return Network(languages, layer(), layer(), output, np.zeros(len(languages)))


def run_layer(layer: Direction, steps: list[np.ndarray], live: np.ndarray) -> list[dict]:
    """States of one layer in its reading order; where a window has ended (``live`` 0) the state is 0."""
    units = layer.recurrent.shape[0]
    h, trace = np.zeros((len(steps[0]), units)), []
    for x, alive in zip(steps, live):
        fed, back = layer.inputs[x], h @ layer.recurrent
        a = fed[:, : 2 * units] + back[:, : 2 * units]
        g = gate(a)
        z, r = g[:, :units], g[:, units:]
        own = back[:, 2 * units :]
        n = np.tanh(fed[:, 2 * units :] + r * own)
        trace.append({"x": x, "h": h, "open": (a > -2.5) & (a < 2.5), "z": z, "r": r, "own": own, "n": n, "live": alive})
        h = ((1 - z) * n + z * h) * alive
        trace[-1]["out"] = h
    return trace


def back_layer(layer: Direction, trace: list[dict], slopes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a layer's weights by backpropagation through time."""
    units = layer.recurrent.shape[0]
    inputs, recurrent = np.zeros_like(layer.inputs), np.zeros_like(layer.recurrent)
    carry = np.zeros_like(trace[0]["h"])
    for t, slope in zip(reversed(trace), reversed(slopes)):
        d = (carry + slope) * t["live"]
        dn = d * (1 - t["z"]) * (1 - t["n"] ** 2)
        gates = np.concatenate((d * (t["h"] - t["n"]), dn * t["own"]), axis=1) * 0.2 * t["open"]
        fed = np.concatenate((gates, dn), axis=1)
        back = np.concatenate((gates, dn * t["r"]), axis=1)
        np.add.at(inputs, t["x"], fed)
        recurrent += t["h"].T @ back
        carry = d * t["z"] + back @ layer.recurrent.T
    return inputs, recurrent


def train_network(
    windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: list[str],
    units: int = 8, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 5,
) -> Network:
    """Adam on the mean cross-entropy of all positions."""
    rng = np.random.default_rng(seed)
    net = fresh_network(languages, units, rng)
    weights = net.parameters()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    count = 0
    for epoch in range(epochs):
        for at in range(0, len(windows), batch):
            if at == 0:
                order = rng.permutation(len(windows))
            rows = order[at : at + batch]
            gradients = _gradients(net, windows[rows], lengths[rows], labels[rows])
            count += 1
            now = rate * (1 - count / (epochs * (len(windows) / batch + 1))) + 1e-4
            for w, g, m, v in zip(weights, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= now * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.999**count)) + 1e-8)
    return net


def _gradients(net: Network, windows, lengths, labels) -> list[np.ndarray]:
    steps = list(windows.T)
    live = [(lengths > t)[:, None].astype(np.float64) for t in range(windows.shape[1])]
    ahead = run_layer(net.forward, steps, live)
    behind = run_layer(net.backward, steps[::-1], live[::-1])[::-1]
    units, total = net.forward.recurrent.shape[0], float(lengths.sum())
    output, bias = np.zeros_like(net.output), np.zeros_like(net.bias)
    down_a, down_b = [], []
    for a, b, alive in zip(ahead, behind, live):
        both = np.concatenate((a["out"], b["out"]), axis=1)
        p = softmax(both @ net.output + net.bias)
        p[np.arange(len(p)), labels] -= 1
        p *= alive / total
        output += both.T @ p
        bias += p.sum(0)
        down = p @ net.output.T
        down_a.append(down[:, :units])
        down_b.append(down[:, units:])
    return [*back_layer(net.forward, ahead, down_a), *back_layer(net.backward, behind[::-1], down_b[::-1]), output, bias]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


class Labeller:
    """Position probabilities of many windows at once, in single precision and with few temporary arrays."""

    def __init__(self, net: Network):
        self.units = u = net.forward.recurrent.shape[0]
        self.layers = []
        for d in (net.forward, net.backward):
            scale = np.concatenate((np.full(2 * u, 0.2), np.ones(u)))
            shift = np.concatenate((np.full(2 * u, 0.5), np.zeros(u)))
            inputs, recurrent = d.inputs * scale + shift, d.recurrent * scale
            parts = (inputs[:, : 2 * u], inputs[:, 2 * u :], recurrent[:, : 2 * u], recurrent[:, 2 * u :])
            self.layers.append([np.ascontiguousarray(p, np.float32) for p in parts])
        self.output = [np.ascontiguousarray(net.output[:u], np.float32), np.ascontiguousarray(net.output[u:], np.float32)]
        self.bias = net.bias.astype(np.float32)

    def states(self, layer: int, steps: np.ndarray, whole: int, lengths: np.ndarray) -> np.ndarray:
        """Logit shares of one layer for every position; windows from row ``whole`` on end early."""
        fed_g, fed_n, rec_g, rec_n = self.layers[layer]
        width, rows, u = steps.shape[0], steps.shape[1], self.units
        h = np.zeros((rows, u), np.float32)
        g, n = np.empty((rows, 2 * u), np.float32), np.empty((rows, u), np.float32)
        out = np.empty((width, rows, len(self.bias)), np.float32)
        for t in range(width) if layer == 0 else range(width - 1, -1, -1):
            np.matmul(h, rec_g, out=g)
            g += fed_g[steps[t]]
            np.clip(g, 0, 1, out=g)
            np.matmul(h, rec_n, out=n)
            n *= g[:, u:]
            n += fed_n[steps[t]]
            np.tanh(n, out=n)
            h -= n
            h *= g[:, :u]
            h += n
            if layer:
                h[whole:][lengths[whole:] <= t] = 0
            np.matmul(h, self.output[layer], out=out[t])
        return out

    def __call__(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum of the position probabilities of each window."""
        order = np.argsort(-lengths, kind="stable")
        sums = np.empty((len(windows), len(self.bias)))
        for at in range(0, len(windows), 4096):
            rows = order[at : at + 4096]
            size = lengths[rows]
            steps = np.ascontiguousarray(windows[rows].T)
            whole = int((size == windows.shape[1]).sum())
            logits = self.states(0, steps, whole, size)
            logits += self.states(1, steps, whole, size)
            logits += self.bias
            logits -= logits.max(axis=2, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(axis=2, keepdims=True)
            logits[:, whole:] *= (np.arange(len(steps))[:, None] < size[whole:])[:, :, None]
            sums[rows] = logits.sum(axis=0)
        return sums


def cut_windows(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (rows of bytes, zeros behind the last), their lengths and their texts."""
    sizes = np.diff(offsets)
    counts = -(-sizes // width)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[text] + nth * width
    lengths = np.minimum(width, offsets[text + 1] - start)
    padded = np.concatenate((data, np.zeros(width, np.uint8)))
    windows = padded[start[:, None] + np.arange(width)]
    short = lengths < width
    windows[short] *= np.arange(width) < lengths[short][:, None]
    return windows, lengths, text


def sample_texts(
    docs: DataFrame, text: str, language: str, doc_id: str, allowed: Column, max_rows: int, max_chars: int
) -> list[tuple[str, str]]:
    """At most ``max_rows`` texts of at most ``max_chars`` characters, as many of each language as possible.

    Texts without an id are left out. There are few languages, and their
    counts come to the driver.
    """
    rows = docs.select(
        F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"), F.col(language).alias("language")
    ).filter(
        allowed & F.col("_id").isNotNull() & F.col("language").isNotNull() & F.col("text").isNotNull()
    )
    rows = rows.filter((F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    counts = {r["language"]: r["count"] for r in rows.groupBy("language").count().collect()}
    if not counts:
        return []
    each = max(1, max_rows // len(counts))
    # About twice as many of each language as needed go on, however many there are.
    shares = F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, 2.0 * each / n)])
    rows = rows.filter(thinned(F.col("_id"), F.element_at(shares, F.col("language"))))
    order = Window.partitionBy("language").orderBy(F.xxhash64("_id"), "_id", F.xxhash64("text"))
    found = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= each).orderBy("language", "_n")
    return [(r["text"], r["language"]) for r in found.select("text", "language").limit(max_rows).collect()]


def train(
    docs: DataFrame,
    text: str = "text",
    language: str = "lang",
    doc_id: str = "doc_id",
    allowed: Column | None = None,
    max_rows: int = 1600,
    max_chars: int = 20_000,
    windows_per_text: int = 6,
    **options,
) -> Network:
    """Learn from a bounded sample of texts whose language is known.

    ``allowed`` is a condition on ``_id``, the document's id. From each text
    at most ``windows_per_text`` windows are drawn. Without any known language
    the network knows none.
    """
    condition = allowed if allowed is not None else F.lit(True)
    sample = sample_texts(docs, text, language, doc_id, condition, max_rows, max_chars)
    languages = sorted({language for _, language in sample})
    if not languages:
        return Network()
    rng = np.random.default_rng(11)
    data, offsets = text_buffer(pa.array([t for t, _ in sample], pa.large_string()))
    windows, lengths, owner = cut_windows(data, offsets)
    rank = rng.random(len(owner))
    order = np.lexsort((rank, owner))
    nth = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    chosen = order[nth < windows_per_text]
    known = np.array([languages.index(language) for _, language in sample])
    return train_network(windows[chosen], lengths[chosen], known[owner[chosen]], languages, **options)


def identify(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``lang_pred`` and ``score``, the document's probability of that language.

    A text that is null or has no letter is ``und`` with score 0, and so is
    every text if the network knows no language. Columns of ``docs`` with one
    of these names are replaced.
    """
    sent = send(docs.sparkSession, net)

    def build():
        known = received(sent)
        label = Labeller(known) if known.languages else None

        def compute(texts: pa.Array) -> list[pa.Array]:
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            letters = [t is not None and bool(_LETTER.search(t)) for t in texts.to_pylist()]
            if label is not None and any(letters):
                data, offsets = text_buffer(texts)
                windows, lengths, owner = cut_windows(data, offsets)
                pooled = np.zeros((len(texts), len(known.languages)))
                np.add.at(pooled, owner, label(windows, lengths))
                best, sizes = pooled.argmax(axis=1), np.maximum(1, np.diff(offsets))
                for i in np.flatnonzero(letters):
                    names[i], scores[i] = known.languages[best[i]], min(1.0, float(pooled[i, best[i]] / sizes[i]))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return compute

    return add_columns(docs, text, "lang_pred string, score double", build)
