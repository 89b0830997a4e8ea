"""Toxicity by a convolutional text classifier.

A word is the sum of hashed embeddings: of itself and of its beginnings, so that compounds of a known stem are known too.
Filters of several widths run over the words of a text, each gives its maximum over the whole text, and a logistic
layer makes a score of the maxima. Every labelled text that is not held out takes part, whole: the rows are dealt to
shards, tasks learn from the shards in numpy, and after each round the parameters are averaged. Scores are calibrated on
a fifth of the ids that training did not see; thresholds are chosen on the same fifth for each language and fall back to
``THRESHOLD`` where a language has too few texts.

Defined results: a null or empty text has the score of no words; without any label the score is 0 everywhere; rows with
a null id or label are not learned from, of several labels of an id the largest counts, and rows equal in id and text count
as one; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.llm import base, learning

BUCKETS = 1 << 15
WIDTH = 8
FILTERS = 8
SPANS = (1, 2, 3)
BEGINNINGS = (4, 5, 6)
#: Rounds of learning and averaging, and how often each row is read in all of them together.
ROUNDS = 3
PASSES = 12
#: Rows of a shard; texts and words that a task holds at a time.
SHARD_ROWS = 8_192
CHUNK_TEXTS = 8_192
CHUNK_WORDS = 4_000_000
#: Sums of the shards that reach the driver in a round.
MERGED = 4
THRESHOLD = 0.3
#: Texts of each class that a language needs for a threshold of its own.
LEAST_PER_LANGUAGE = 20
_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def features(dictionary: pa.Array) -> np.ndarray:
    """Bucket of each word and of its beginnings (of the word itself where it is shorter): (word, 1 + len(BEGINNINGS))."""
    plain = pc.utf8_trim(pc.utf8_lower(dictionary), characters=_TRIM)
    parts = [plain] + [pc.utf8_slice_codeunits(plain, 0, n) for n in BEGINNINGS]
    with np.errstate(over="ignore"):
        hashes = [base.hash_words(p) + np.uint64(i) * np.uint64(0x9E3779B97F4A7C15) for i, p in enumerate(parts)]
    return np.stack([(base.mix(h) % np.uint64(BUCKETS)).astype(np.int64) for h in hashes], axis=1)


@dataclass
class Classifier:
    embed: np.ndarray
    taps: dict[int, np.ndarray]  # width -> (tap, WIDTH, FILTERS)
    shift: dict[int, np.ndarray]  # width -> (FILTERS,)
    out: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 11) -> "Classifier":
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        # Words never seen are near zero, and without a word that says otherwise a text is not toxic.
        return cls(draw(0.01, BUCKETS, WIDTH), {s: draw(0.4, s, WIDTH, FILTERS) for s in SPANS},
                   {s: np.zeros(FILTERS, np.float32) for s in SPANS}, draw(0.3, len(SPANS) * FILTERS), -2.0)


def pooled(model: Classifier, buckets: np.ndarray, codes: np.ndarray, offsets: np.ndarray,
           places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Maxima (text, filter) of all filters, never below 0; the place of each maximum if asked; the word vectors.

    A filter of width s meets words i to i + s - 1 of one text. What a word adds at each tap is computed once per distinct word.
    """
    texts = len(offsets) - 1
    vectors = model.embed[buckets].sum(axis=1)
    out = np.zeros((texts, len(SPANS) * FILTERS), dtype=np.float32)
    where = np.full(out.shape, -1, dtype=np.int64) if places else None
    sizes = np.diff(offsets)
    for k, span in enumerate(SPANS):
        full = np.flatnonzero(sizes >= span)
        n = len(codes) - span + 1
        if not len(full) or n <= 0:
            continue
        at = np.take(vectors @ model.taps[span][0], codes[:n], axis=0)
        for tap in range(1, span):
            at += np.take(vectors @ model.taps[span][tap], codes[tap:n + tap], axis=0)
        # Places whose filter would reach into the next text are cut off; the slices in between are not read.
        bounds = np.stack((offsets[:-1][full], offsets[1:][full] - span + 1), axis=1).reshape(-1)
        padded = np.concatenate((at, np.full((1, FILTERS), -np.inf, np.float32)))
        best = np.maximum.reduceat(padded, np.minimum(bounds, n), axis=0)[::2]
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        out[full, cols] = np.maximum(best + model.shift[span], 0)
        if places:
            for row, (a, b) in zip(full, bounds.reshape(-1, 2)):
                where[row, cols] = a + at[a:b].argmax(axis=0)
            where[:, cols][out[:, cols] <= 0] = -1
    return out, where, vectors


def raw_scores(model: Classifier, buckets: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    top, _, _ = pooled(model, buckets, codes, offsets)
    return top.astype(np.float64) @ model.out.astype(np.float64) + model.bias


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def parameters(model: Classifier) -> np.ndarray:
    """All that is learned, as one vector: the dense layers, then the embedding row by row."""
    dense = [model.out, np.array([model.bias])] + [layer[s] for s in SPANS for layer in (model.taps, model.shift)]
    return np.concatenate([x.reshape(-1) for x in (*dense, model.embed)]).astype(np.float32)


def of_parameters(vector: np.ndarray) -> Classifier:
    model, at = Classifier.fresh(), 0

    def cut(like: np.ndarray) -> np.ndarray:
        nonlocal at
        at += like.size
        return vector[at - like.size:at].reshape(like.shape).copy()
    model.out = cut(model.out)
    model.bias = float(cut(np.zeros(1))[0])
    for s in SPANS:
        model.taps[s], model.shift[s] = cut(model.taps[s]), cut(model.shift[s])
    model.embed = cut(model.embed)
    return model


class Learner:
    """Adagrad on the logistic loss, from given parameters and sums of squares. Only the word places that gave a maximum get a gradient."""

    def __init__(self, vector: np.ndarray, sums: np.ndarray, rate: float = 0.06, seed: int = 11):
        self.model, self.sums = of_parameters(vector), of_parameters(sums)
        self.bias, self.bias_sums = np.array([self.model.bias], np.float32), np.array([self.sums.bias], np.float32)
        self.rate, self.rng = rate, np.random.default_rng(seed)
        self.steps, self.touched = 0, np.zeros(BUCKETS, np.float32)

    def _step(self, value: np.ndarray, sums: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        sums[rows] += grad * grad
        value[rows] -= self.rate * grad / np.sqrt(sums[rows])

    def learn(self, buckets: np.ndarray, codes: np.ndarray, offsets: np.ndarray, labels: np.ndarray, epochs: int, batch: int = 50) -> None:
        model, sums = self.model, self.sums
        for _ in range(epochs):
            order = self.rng.permutation(len(labels))
            for begin in range(0, len(order), batch):
                rows = order[begin:begin + batch]
                parts = [codes[offsets[r]:offsets[r + 1]] for r in rows]
                used, local = np.unique(np.concatenate(parts), return_inverse=True)
                edges = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                model.bias = float(self.bias[0])
                top, where, vectors = pooled(model, buckets[used], local, edges, places=True)
                error = (probability(top @ model.out + model.bias) - labels[rows]).astype(np.float32) / len(rows)
                d_vectors = np.zeros_like(vectors)
                d_top = error[:, None] * model.out
                self._step(model.out, sums.out, top.T @ error + np.float32(1e-5) * model.out)
                self._step(self.bias, self.bias_sums, np.array([error.sum()]))
                for k, span in enumerate(SPANS):
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    text, number = np.nonzero(where[:, cols] >= 0)
                    place, g = where[:, cols][text, number], d_top[:, cols][text, number]
                    d_taps, d_shift = np.zeros_like(model.taps[span]), np.bincount(number, weights=g, minlength=FILTERS).astype(np.float32)
                    for tap in range(span):
                        word = local[place + tap]
                        for f in range(FILTERS):
                            mine = number == f
                            d_taps[tap, :, f] = vectors[word[mine]].T @ g[mine]
                        np.add.at(d_vectors, word, g[:, None] * model.taps[span][tap][:, number].T)
                    self._step(model.taps[span], sums.taps[span], d_taps)
                    self._step(model.shift[span], sums.shift[span], d_shift)
                hit = np.flatnonzero(np.abs(d_vectors).sum(axis=1))
                touched, inverse = np.unique(buckets[used[hit]].reshape(-1), return_inverse=True)
                d_embed = np.zeros((len(touched), WIDTH), dtype=np.float32)
                np.add.at(d_embed, inverse, np.repeat(d_vectors[hit], buckets.shape[1], axis=0))
                self._step(model.embed, sums.embed, d_embed, touched)
                self.steps += 1
                self.touched[touched] += 1

    def state(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parameters, sums of squares and weights: how many steps moved each parameter."""
        self.model.bias, self.sums.bias = float(self.bias[0]), float(self.bias_sums[0])
        vector = parameters(self.model)
        weights = np.full(len(vector), self.steps, np.float32)
        weights[-BUCKETS * WIDTH:] = np.repeat(self.touched, WIDTH)
        return vector, parameters(self.sums), weights


_STATE = "moved binary, squares binary, steps binary"


def _state_row(moved: np.ndarray, squares: np.ndarray, steps: np.ndarray) -> pa.RecordBatch:
    """Weighted sums, and the weights: of the dense layers once, then of each row of the embedding."""
    each = np.concatenate((steps[:1], steps[-BUCKETS * WIDTH::WIDTH]))
    return pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (moved, squares, each)], ["moved", "squares", "steps"])


def _state_sum(batches) -> list[np.ndarray] | None:
    total = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("moved", "squares", "steps"))):
            moved, squares, each = (np.frombuffer(x, "<f4").astype(np.float64) for x in row)
            steps = np.concatenate((np.full(len(moved) - BUCKETS * WIDTH, each[0]), np.repeat(each[1:], WIDTH)))
            total = [moved, squares, steps] if total is None else [a + b for a, b in zip(total, (moved, squares, steps))]
    return total


def _merge_states(batches):
    total = _state_sum(batches)
    if total is not None:
        yield _state_row(*total)


def _learn_shards(vector: np.ndarray, sums: np.ndarray, epochs: int, seed: int):
    """Learns from the rows of each shard, in order, beginning with the same state; a task returns one weighted sum."""
    def run(batches):
        total, learner, now = [np.zeros(len(vector)) for _ in range(3)], None, None
        held, texts, size = [], 0, 0

        def learn():
            nonlocal held, texts, size
            if held:
                learner.learn(*_joined([h[:3] for h in held]), np.concatenate([h[3] for h in held]), epochs)
            held, texts, size = [], 0, 0

        def close():
            learn()
            if learner is not None:
                own, squares, steps = learner.state()
                for sum_, value in zip(total, ((own - vector) * steps, (squares - sums) * steps, steps)):
                    sum_ += value
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            for a, b in _stretches(shards):
                if learner is None or shards[a] != now:
                    close()
                    learner, now = Learner(vector, sums, seed=seed), shards[a]
                part = batch.slice(a, b - a)
                dictionary, codes, offsets = base.words(part.column("text"))
                held.append((features(dictionary).astype(np.int32), codes, offsets, part.column("label").to_numpy()))
                texts, size = texts + b - a, size + len(codes)
                if texts >= CHUNK_TEXTS or size >= CHUNK_WORDS:
                    learn()
        close()
        if learner is not None:
            yield _state_row(*total)
    return run


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, codes and offsets of several batches as those of one."""
    words = np.cumsum([0, *(len(p[0]) for p in parts)])
    places = np.cumsum([0, *(len(p[1]) for p in parts)])
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + n for p, n in zip(parts, words.tolist())]),
            np.concatenate([[0], *(p[2][1:] + n for p, n in zip(parts, places.tolist()))]).astype(np.int64))


def train(rows: DataFrame, rounds: int = ROUNDS, passes: int = PASSES, seed: int = 11) -> Classifier:
    """Learn from all ``rows`` (shard, text, label), each as often as ``passes`` says.

    In a round every shard is learned from on its own, from the same state; then a parameter moves by the mean over the shards,
    weighted with the steps in which they moved it. So a word that few shards have counts as much as in these. The driver holds
    the parameters (1 MB) and as much for each of ``MERGED`` sums.
    """
    vector = parameters(Classifier.fresh(seed))
    sums = np.full(len(vector), 1e-6, dtype=np.float32)
    for number in range(rounds):
        found = rows.select("shard", "text", "label").mapInArrow(
            base.released(_learn_shards(vector, sums, passes // rounds, seed + number)), _STATE)
        total = _state_sum(found.repartition(MERGED).mapInArrow(_merge_states, _STATE).toArrow().to_batches())
        if total is None:
            break
        moved, squares, steps = total
        vector = (vector + moved / np.maximum(steps, 1)).astype(np.float32)
        sums = (sums + squares / np.maximum(steps, 1)).astype(np.float32)
    return of_parameters(vector)


def calibrate(model: Classifier, checked: DataFrame) -> None:
    """Fit slope and offset of the score by logistic regression on all rows of ``checked`` (raw, label, lang), then a threshold for
    each language. A Newton step is one sum over the rows, a threshold a count of them between the cuts."""
    shape = checked.agg(F.max(F.abs("raw")).alias("most"), F.countDistinct("label").alias("classes")).first()
    scale = max(1e-6, shape.most or 0.0)
    a, b = 1.0, 0.0
    x = F.col("raw") / F.lit(scale)
    off = F.when(F.col("label") == 1, 0.995).otherwise(0.005)
    for _ in range(60 if shape.classes == 2 else 0):
        p = _logistic(x * F.lit(a) + F.lit(b))
        terms = checked.select(x.alias("x"), (p - off).alias("e"), F.greatest(p * (1 - p), F.lit(1e-6)).alias("w"))
        r = terms.agg(*[F.sum(v).alias(k) for k, v in {"gx": F.col("e") * F.col("x"), "g": F.col("e"), "hxx": F.col("w") * F.col("x") * F.col("x"),
                                                       "hx": F.col("w") * F.col("x"), "h": F.col("w")}.items()]).first()
        move = np.linalg.solve(np.array([[r.hxx, r.hx], [r.hx, r.h]]) + 1e-4 * np.eye(2), np.array([r.gx, r.g]))
        step = 1.0 if np.abs(move).max() < 0.5 else 0.5  # damped while far
        a, b = a - step * move[0], b - step * move[1]
        if np.abs(move).max() < 1e-9:
            break
    if shape.classes == 2 and a > 0:
        model.slope, model.offset = float(a / scale), float(b)
    cuts = np.linspace(0.1, 0.9, 33)
    score = _logistic(F.col("raw") * F.lit(model.slope) + F.lit(model.offset))
    level = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: score >= c))
    levels = checked.groupBy("lang", level.alias("level")).agg(F.sum("label").alias("ones"), F.count("*").alias("n"))
    found = levels.groupBy("lang").agg(F.collect_list(F.struct("level", "ones", "n")).alias("levels"), F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    for row in found.filter(F.least(F.col("ones"), F.col("n") - F.col("ones")) >= LEAST_PER_LANGUAGE).collect():
        best = (-1.0, 0.0, THRESHOLD)
        for number, cut in enumerate(cuts, 1):
            right = sum(v.ones for v in row.levels if v.level >= number)
            f1 = 2 * right / max(1e-12, sum(v.n for v in row.levels if v.level >= number) + row.ones)
            best = max(best, (f1, -abs(cut - THRESHOLD), float(cut)))
        model.thresholds[row.lang] = best[2]


def _logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, label: str, label_id: str) -> DataFrame:
    """All labelled rows that are not held out as a written table: shard, doc_id, label, lang, text. Equal rows count as one."""
    marks = base.pick(labels, doc_id=(label_id, "bigint"), label=(label, "int"))
    marks = marks.filter(~learning.held_out(F.col("doc_id")) & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = base.written(marks, "toxicity-labels")
    mark = F.broadcast(marks) if marks.count() <= learning.BROADCAST_KEYS else marks
    rows = base.pick(docs, doc_id=(doc_id, "bigint"), text=(text, "string"), lang=(lang, "string")).filter(~learning.held_out(F.col("doc_id")))
    shards = max(1, -(-rows.select("doc_id").join(mark, "doc_id").count() // SHARD_ROWS))
    found = rows.join(mark, "doc_id").select("doc_id", "label", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found = found.withColumn("same", F.xxhash64("text")).repartition(shards, "doc_id", "same")
    found = found.groupBy("doc_id", "same").agg(F.max("label").alias("label"), F.max("lang").alias("lang"), F.max("text").alias("text"))
    found = found.withColumn("shard", F.spark_partition_id()).sortWithinPartitions("shard", "doc_id", "text")
    table = base.written(found.select("shard", "doc_id", "label", "lang", "text"), "toxicity-rows")
    base.discard(marks)
    return table


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic",
        label_id: str = "doc_id") -> Classifier | None:
    """Learn from every labelled row that is not held out; a fifth of the ids is kept apart for score and thresholds."""
    base.set_up(docs.sparkSession)
    rows = labelled(docs, labels, doc_id, text, lang, label, label_id)
    apart = F.col("doc_id") % 5 == 0
    groups = rows.groupBy(apart.alias("apart"), "label").agg(
        F.count("*").alias("n"), F.max("shard").alias("shard"), F.sum(F.length("text")).alias("chars")).collect()
    counts = {(r.apart, r.label): r.n for r in groups}
    total = sum(counts.values())
    one = len({r.shard for r in groups} | {0}) == 1 and sum(r.chars for r in groups) <= 2 * CHUNK_WORDS  # a task holds all of it
    if not total:
        base.discard(rows)
        return None
    if total < 50:
        counts = {(False, y): sum(n for (_, z), n in counts.items() if z == y) for y in {y for _, y in counts}}
        apart = F.lit(False)
    if sum((False, y) in counts for y in (0, 1)) < 2:
        model = Classifier.fresh()
        model.out[:] = 0
        model.bias = 3.0 if any(y for _, y in counts) else -3.0
        base.discard(rows)
        return model
    model = train(rows.filter(~apart), 1 if one else ROUNDS)
    check = rows.filter(apart) if all((True, y) in counts for y in (0, 1)) else rows
    checked = base.written(check.select(_raw_column(model).alias("raw"), "label", "lang"), "toxicity-checked")
    calibrate(model, checked)
    base.discard(rows, checked)
    return model


def _raw_column(model: Classifier) -> Column:
    @F.arrow_udf("double")
    def raw(column: pa.Array) -> pa.Array:
        dictionary, codes, offsets = base.words(column)
        if not len(dictionary):
            return pa.array(np.full(len(column), float(model.bias)), pa.float64())
        return pa.array(raw_scores(model, features(dictionary), codes, offsets), pa.float64())
    return raw(F.col("text"))


def scores(model: Classifier | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    dictionary, codes, offsets = base.words(column)
    if not len(dictionary):
        return probability(np.full(len(column), model.slope * model.bias + model.offset))
    return probability(model.slope * raw_scores(model, features(dictionary), codes, offsets) + model.offset)


def score_column(model: Classifier | None, text: str):
    """Score of a text column, as a column of the same rows."""
    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(scores(model, column), pa.float64())
    return score(F.col(text).cast("string"))


def with_scores(docs: DataFrame, model: Classifier | None, text: str = "text", name: str = "score") -> DataFrame:
    base.set_up(docs.sparkSession)
    return docs.withColumn(name, score_column(model, text))


def accepted(docs: DataFrame, model: Classifier | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold of their language, in the columns of ``docs``."""
    name = base.fresh(docs, "score")
    bar = F.lit(THRESHOLD)
    if model is not None and model.thresholds:
        bar = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair])[F.coalesce(F.col(lang).cast("string"), F.lit(""))], bar)
    return with_scores(docs, model, text, name).filter(F.col(name) < bar).select(*docs.columns)
