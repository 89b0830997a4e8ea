"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of ``WINDOW`` bytes; every byte lies in one window. In each direction a minimally gated unit
runs over the window; from both states every position gets a probability for each language, and a document has the mean
over all its positions. The network is trained in numpy by backpropagation through time on windows of a bounded sample:
at most about ``SAMPLE`` documents of each language and ``PLACES`` windows of each.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and for all texts if nothing could be
learned; rows with a null language or id are not learned from; ids may repeat; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoveil.llm import base, learning

WINDOW = 128
HIDDEN = 8
SAMPLE = 400
PLACES = 4
#: Windows that the network reads side by side.
TOGETHER = 2_048


@dataclass
class Network:
    """``inputs`` (direction, 2 hidden, byte): gate and candidate; ``recur`` (direction, 2 hidden, hidden); ``out`` (language, 2 hidden)."""
    languages: list[str]
    inputs: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        return cls(languages, draw(2, 2 * hidden, 256), draw(2, 2 * hidden, hidden), draw(len(languages), 2 * hidden),
                   np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.recur, self.out, self.bias]


def run_direction(inputs: np.ndarray, recur: np.ndarray, steps: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States (step, hidden, window) over ``steps`` (step, window) of bytes.

    gate f = sigmoid(x_f + R_f h), candidate c = tanh(x_c + f * R_c h), new state h + f (c - h).
    """
    n, width = steps.shape
    hidden = recur.shape[1]
    half = np.float32(0.5)
    scaled_in, scaled = inputs.copy(), recur.copy()
    scaled_in[:hidden] *= half  # the sigmoid of z is (1 + tanh(z / 2)) / 2
    scaled[:hidden] *= half
    states = np.empty((n, hidden, width), dtype=np.float32)
    state = np.zeros((hidden, width), dtype=np.float32)
    x = np.empty((2 * hidden, width), dtype=np.float32)
    back = np.empty_like(x)
    if keep is not None:
        keep["gate"], keep["cand"], keep["back"] = np.empty_like(states), np.empty_like(states), np.empty_like(states)
    gate, cand = x[:hidden], x[hidden:]
    for t in range(n):
        np.take(scaled_in, steps[t], axis=1, out=x, mode="clip")
        np.matmul(scaled, state, out=back)
        gate += back[:hidden]
        np.tanh(gate, out=gate)
        gate *= half
        gate += half
        if keep is not None:
            keep["back"][t], keep["gate"][t] = back[hidden:], gate
        back[hidden:] *= gate
        cand += back[hidden:]
        np.tanh(cand, out=cand)
        if keep is not None:
            keep["cand"][t] = cand
        cand -= state
        cand *= gate
        state = np.add(state, cand, out=states[t])
    return states


def _backward(recur: np.ndarray, steps: np.ndarray, states: np.ndarray, keep: dict, grads: np.ndarray):
    """Gradients of ``inputs`` and ``recur`` through time, from those of the states."""
    n, width = steps.shape
    hidden = recur.shape[1]
    d_x = np.empty((n, 2 * hidden, width), dtype=np.float32)
    d_recur = np.zeros_like(recur)
    later = np.zeros((hidden, width), dtype=np.float32)
    zero = np.zeros_like(later)
    through = np.empty((2 * hidden, width), dtype=np.float32)
    for t in range(n - 1, -1, -1):
        before = states[t - 1] if t else zero
        gate, cand, back = keep["gate"][t], keep["cand"][t], keep["back"][t]
        d = grads[t] + later
        d_cand = d * gate * (1 - cand * cand)
        d_gate = (d * (cand - before) + d_cand * back) * gate * (1 - gate)
        d_x[t, :hidden], d_x[t, hidden:] = d_gate, d_cand
        through[:hidden], through[hidden:] = d_gate, d_cand * gate
        d_recur += through @ before.T
        later = d * (1 - gate) + recur.T @ through
    flat = steps.reshape(-1)
    d_inputs = np.stack([np.bincount(flat, weights=d_x[:, i].reshape(-1), minlength=256) for i in range(2 * hidden)])
    return d_inputs.astype(np.float32), d_recur


def _position_probabilities(net: Network, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """(step, language, window)."""
    hidden = ahead.shape[1]
    scores = np.matmul(net.out[:, :hidden], ahead)
    scores += np.matmul(net.out[:, hidden:], behind)
    scores += net.bias[:, None]
    np.clip(scores, -30, 30, out=scores)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 8, batch: int = 128,
          rate: float = 0.02, seed: int = 7) -> Network:
    """``windows`` (window, byte), padded with zeros behind the text; ``labels`` number ``languages``. Adam."""
    net = Network.fresh(languages, seed=seed)
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    hidden, count = net.recur.shape[2], 0
    total = epochs * max(1, -(-len(windows) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for begin in range(0, len(order), batch):
            rows = order[begin:begin + batch]
            steps = np.ascontiguousarray(windows[rows].T)
            kept: tuple[dict, dict] = ({}, {})
            ahead = run_direction(net.inputs[0], net.recur[0], steps, kept[0])
            behind = run_direction(net.inputs[1], net.recur[1], steps[::-1], kept[1])
            error = _position_probabilities(net, ahead, behind[::-1])
            real = (steps > 0).astype(np.float32)
            error[:, labels[rows], np.arange(len(rows))] -= 1
            error *= (real / max(1.0, real.sum()))[:, None, :]
            d_out = np.concatenate((np.einsum("tkb,thb->kh", error, ahead), np.einsum("tkb,thb->kh", error, behind[::-1])), axis=1)
            parts = [_backward(net.recur[0], steps, ahead, kept[0], np.matmul(net.out[:, :hidden].T, error)),
                     _backward(net.recur[1], steps[::-1], behind, kept[1], np.matmul(net.out[:, hidden:].T, error)[::-1])]
            grads = [np.stack([p[0] for p in parts]), np.stack([p[1] for p in parts]), d_out, error.sum(axis=(0, 2))]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            count += 1
            step = rate * (1 - 0.9 * count / total)
            for p, g, m, v in zip(net.parameters(), grads, first, second):
                g = g * min(1.0, 1.0 / (norm + 1e-12))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (step * (m / (1 - 0.9 ** count)) / (np.sqrt(v / (1 - 0.99 ** count)) + 1e-8)).astype(np.float32)
    return net


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mean probability of each language over all bytes of each text; zeros for an empty one."""
    sizes = np.diff(offsets)
    per_text = -(-sizes // window)
    whose = np.repeat(np.arange(len(sizes)), per_text)
    first = np.concatenate(([0], np.cumsum(per_text)[:-1])) if len(sizes) else np.zeros(0, np.int64)
    begins = offsets[:-1][whose] + (np.arange(len(whose)) - first[whose]) * window
    ends = np.minimum(begins + window, offsets[1:][whose])
    sums = np.zeros((len(sizes), len(net.languages)))
    padded = np.concatenate((data, np.zeros(window, np.uint8)))
    place = np.arange(window)
    for a in range(0, len(whose), TOGETHER):
        rows = slice(a, a + TOGETHER)
        steps = padded[begins[rows][None, :] + place[:, None]]
        real = place[:, None] < (ends[rows] - begins[rows])[None, :]
        steps = np.where(real, steps, np.uint8(0))
        ahead = run_direction(net.inputs[0], net.recur[0], steps)
        behind = run_direction(net.inputs[1], net.recur[1], steps[::-1])
        probs = _position_probabilities(net, ahead, behind[::-1])
        short = ~real.all(axis=0)
        if short.any():
            probs[:, :, short] *= real[:, None, short]
        np.add.at(sums, whose[rows], probs.sum(axis=0).T)
    return sums / np.maximum(sizes, 1)[:, None]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE,
        places: int = PLACES) -> Network | None:
    """Learn from the rows that are not held out. The driver holds ``sample * places`` windows of each language."""
    rows = base.pick(docs, doc_id=(doc_id, "bigint"), text=(text, "string"), lang=(lang, "string"))
    rows = rows.filter(~learning.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    drawn, counts = learning.sample_per_class(rows, "lang", ["doc_id", "text"], sample)
    spare = F.greatest(F.length("text") - WINDOW // 2, F.lit(1))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(places)), lambda i: F.substring(
        F.col("text"), F.pmod(F.xxhash64("doc_id", i), spare).cast("int") + 1, F.lit(WINDOW)))
    found = sorted((r.lang, r.doc_id, tuple(r.cuts)) for r in drawn.select("doc_id", "lang", cuts.alias("cuts")).collect())
    languages = sorted(counts)
    windows, labels = [], []
    for name, _, texts in found:
        for cut in dict.fromkeys(texts):
            raw = cut.encode()[:WINDOW]
            windows.append(np.frombuffer(raw.ljust(WINDOW, b"\0"), dtype=np.uint8))
            labels.append(languages.index(name))
    return train(np.stack(windows), np.array(labels), languages) if windows else None


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(net: Network | None):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            names, best = np.full(n, "und", dtype=object), np.zeros(n)
            if net is not None and n:
                probs = document_probabilities(net, *base.utf8(batch.column("text")))
                known = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                names[known] = np.array(net.languages, dtype=object)[probs.argmax(axis=1)][known]
                best[known] = np.clip(probs.max(axis=1), 0, 1)[known]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(best)], schema=_SCHEMA)
    return run


def identify(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (mean probability of that language) of every whole text."""
    base.set_up(docs.sparkSession)
    rows = base.documents(docs, doc_id, text).withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(_predict(net), "doc_id bigint, lang_pred string, score double")
