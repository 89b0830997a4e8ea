"""Structured Streaming forms of the operators that work row by row or window by window."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronoveil.functions.rng import laplace, uniform
from chronoveil.operators.mechanisms import StreamPublisher, randomised_response
from chronoveil.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(spark: SparkSession, path: str, schema: T.StructType, files: str | None = None,
           bytes_per_batch: int = 1 << 30) -> DataFrame:
    """Read a folder of parquet files as a stream.

    The size of a micro-batch is limited, because the stateful operators sort the rows of one key within a batch.
    """
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch)
    if files:
        reader = reader.option("pathGlobFilter", files)
    return reader.parquet(path)


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process everything that is available into parquet in the shared folder and return the written table.

    Checkpoint and output live in the shared folder, so a restarted query continues where it stopped."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    query = (stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/cp")
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def resample(stream: DataFrame, keys: Sequence[str], ts: str, value: str, width: str, watermark: str) -> DataFrame:
    """Tumbling mean; rows later than the watermark are dropped."""
    w = F.window(ts, width)
    return (stream.withWatermark(ts, watermark).groupBy(*keys, w.alias("w"))
            .agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
            .select(*keys, F.unix_micros(F.col("w.start")).alias("start_us"), "mean", "n"))


def randomised_labels(stream: DataFrame, ids: Sequence[str], label: str, epsilon: Column | float, classes: int,
                      seed: int) -> DataFrame:
    """Row-wise randomised response: the batch operator is stateless and works on a stream unchanged."""
    return randomised_response(stream, ids, label, epsilon, classes, seed)


class InOrder(StatefulProcessor):
    """Rows of a series in the order of ``order``.

    Without ``ts`` a micro-batch is sorted and taken at once: right if files arrive in order. With ``ts`` rows wait in the
    state until the watermark has passed them, so the order does not depend on the micro-batches; a row that arrives behind
    the watermark is dropped by the engine, and what the watermark has not passed at the end stays in the state.

    Waiting is an aggregation by series and millisecond (``_in_order``), so what gets here are rows the watermark has just passed: a series
    has one call and one read and write of its state for a micro-batch, however many rows and hours that holds.
    """

    fields: dict[str, str]  # the columns a subclass reads, with their SQL types
    timed = False  # whether a subclass also acts on the watermark itself

    def __init__(self, order: str, ts: str | None):
        self.order, self.ts = order, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in rows if not pdf.empty]
        if not parts:  # a call for timers only
            return
        yield from self.take(key, pd.concat(parts).sort_values(self.order))
        if self.timed:
            yield from self.passed(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.passed(key, timerValues.getCurrentWatermarkInMs())

    def passed(self, key, ms: int) -> Iterator[pd.DataFrame]:
        """Called when the watermark has moved to ``ms`` and all rows up to there are taken."""
        yield from ()

    def close(self) -> None:
        pass


def _in_order(stream: DataFrame, key: str, processor: InOrder, schema: str, delay: str | None) -> DataFrame:
    if not processor.ts:
        return stream.select(key, *processor.fields).groupBy(key).transformWithStateInPandas(processor, schema, "append", "none")
    at = F.date_trunc("millisecond", F.col(processor.ts).cast("timestamp")).alias("row_at")
    waiting = (stream.select(key, *processor.fields, at).withWatermark("row_at", delay).groupBy(key, "row_at")
               .agg(F.collect_list(F.struct(*processor.fields)).alias("rows")))
    passed = waiting.select(key, "row_at", F.inline("rows"))
    return passed.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventtime" if processor.timed else "none")


class CountWindows(InOrder):
    """Every ``length`` rows of a series become one window; the state holds less than one besides waiting rows."""

    def __init__(self, length: int, order: str, value: str, ts: str | None = None):
        super().__init__(order, ts)
        self.length, self.value = length, value
        self.fields = {order: "BIGINT", value: "DOUBLE"}

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pending", "win BIGINT, xs ARRAY<DOUBLE>")

    def take(self, key, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        win, pending = self.state.get() if self.state.exists() else (0, [])
        values = np.concatenate([np.asarray(pending, dtype=float), pdf[self.value].to_numpy(float)])
        whole = len(values) // self.length
        if whole:
            blocks = values[: whole * self.length].reshape(whole, self.length)
            yield pd.DataFrame({"series_id": key[0], "win_id": win + np.arange(whole), "x": list(blocks)})
        self.state.update((int(win + whole), [float(v) for v in values[whole * self.length:]]))


def count_windows(stream: DataFrame, key: str, order: str, value: str, length: int, ts: str | None = None,
                  delay: str | None = None) -> DataFrame:
    """Windows of ``length`` rows. With ``ts`` and ``delay`` rows are put in order up to that lateness (see ``InOrder``)."""
    return _in_order(stream, key, CountWindows(length, order, value, ts), "series_id BIGINT, win_id BIGINT, x ARRAY<DOUBLE>", delay)


class ChangeRuns(InOrder):
    """Closed runs of equal labels; the open run is the state."""

    def __init__(self, order: str, label: str, ts: str | None = None):
        super().__init__(order, ts)
        self.label = label
        self.fields = {order: "BIGINT", label: "INT"}

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "label INT, start BIGINT, pos BIGINT")

    def take(self, key, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        labels = pdf[self.label].to_numpy(int)
        current, start, pos = self.state.get() if self.state.exists() else (int(labels[0]), 0, 0)
        seen = np.concatenate([[current], labels])
        # Index i of the change is the row count of the batch before the new run starts.
        changes = np.flatnonzero(seen[1:] != seen[:-1])
        starts = np.concatenate([[start], pos + changes])
        if len(changes):
            yield pd.DataFrame({"series_id": key[0], "label": np.concatenate([[current], labels[changes[:-1]]]).astype("int32"),
                                "run_start": starts[:-1], "run_stop": starts[1:]})
        self.state.update((int(labels[-1]), int(starts[-1]), int(pos + len(labels))))


def change_runs(stream: DataFrame, key: str, order: str, label: str, ts: str | None = None, delay: str | None = None) -> DataFrame:
    """Closed runs of equal labels. With ``ts`` and ``delay`` rows are put in order up to that lateness (see ``InOrder``)."""
    return _in_order(stream, key, ChangeRuns(order, label, ts), "series_id BIGINT, label INT, run_start BIGINT, run_stop BIGINT", delay)


class FilledBins(InOrder):
    """Mean of every bin of ``width_ms``; a bin without rows repeats the one before it.

    A bin is closed by the watermark, or by the next row of its series. The bins between two rows are emitted when the second is taken:
    whether a series goes on is not known before.
    """

    timed = True

    def __init__(self, value: str, width_ms: int, order: str, ts: str):
        super().__init__(order, ts)
        self.value, self.width_ms = value, width_ms
        self.fields = {order: "BIGINT", value: "DOUBLE", "at_ms": "BIGINT"}

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bin", "bin BIGINT, total DOUBLE, n BIGINT, mean DOUBLE")

    def _closed(self, key, bins: list[tuple[int, float | None, bool]]) -> pd.DataFrame:
        return pd.DataFrame({"series_id": [key[0]] * len(bins), "bin": [b for b, _, _ in bins], "mean": [m for _, m, _ in bins],
                             "filled": [f for _, _, f in bins]})

    def take(self, key, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else None
        out = []
        values = pd.to_numeric(pdf[self.value]).to_numpy(float)
        known = ~np.isnan(values)
        bins, of = np.unique(pdf["at_ms"].to_numpy("int64") // self.width_ms, return_inverse=True)
        totals, counts = np.bincount(of, np.where(known, values, 0.0), len(bins)), np.bincount(of, known, len(bins))
        for at, total, n in zip(bins.tolist(), totals.tolist(), counts.astype(int).tolist()):
            if state is not None and state[0] == at:  # the bin is open: rows of it were taken before
                state = (int(at), state[1] + total, state[2] + n, state[3])
                continue
            if state is not None:
                mean = state[1] / state[2] if state[2] > 0 else state[3]
                if state[2] >= 0:  # else the watermark has closed it
                    out.append((state[0], mean, False))
                out += [(b, mean, True) for b in range(state[0] + 1, int(at))]
                state = (int(at), total, n, mean)
            else:
                state = (int(at), total, n, None)
        self.state.update(state)
        if state[2] >= 0:
            self.handle.registerTimer((state[0] + 1) * self.width_ms)
        if out:
            yield self._closed(key, out)

    def passed(self, key, ms: int) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        at, total, n, mean = self.state.get()
        if n >= 0 and (at + 1) * self.width_ms <= ms:
            mean = total / n if n else mean
            self.state.update((at, 0.0, -1, mean))
            yield self._closed(key, [(at, mean, False)])


def resample_filled(stream: DataFrame, key: str, order: str, ts: str, value: str, width_ms: int, delay: str) -> DataFrame:
    """Streaming twin of ``clean.resample_mean`` for the bins the watermark has closed: series_id, bin, mean and whether it was filled.

    ``order`` is a unique BIGINT that puts rows of one time in order.
    """
    timed = stream.withColumn("at_ms", F.unix_millis(F.col(ts).cast("timestamp")))
    return _in_order(timed, key, FilledBins(value, width_ms, order, ts), "series_id BIGINT, bin BIGINT, mean DOUBLE, filled BOOLEAN", delay)


#: Rows of a private stream whose history is one entry of the state.
_HISTORY_ROWS = 64


class PrivateRelease(InOrder):
    """Private stream publication with the state of one stream kept between micro-batches.

    The rows still in sight of the window are a map by ``_HISTORY_ROWS`` rows: a micro-batch writes the entries of its own rows, removes those
    out of sight, and writes a few scalars, whatever the window is.
    """

    def __init__(self, order: str, cols: Sequence[str], epsilon: float, s_p: float, s_s: float, window: int, windows_back: int,
                 ts: str | None = None):
        super().__init__(order, ts)
        self.cols = list(cols)
        self.args = (epsilon, s_p, s_s, window, windows_back, len(cols))
        self.noises = [f"noise_{c}" for c in self.cols]
        self.fields = {order: "BIGINT", **{c: "DOUBLE" for c in [*self.cols, *self.noises, "u_query", "u_threshold"]}}

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("publisher", "doc STRING")
        self.history = handle.getMapState("history", "part BIGINT", "row ARRAY<BIGINT>, eps ARRAY<DOUBLE>, svt ARRAY<DOUBLE>, sq ARRAY<DOUBLE>, ab ARRAY<DOUBLE>")

    def take(self, key, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        publisher = StreamPublisher(*self.args)
        parts: dict[int, list[tuple]] = {}
        if self.state.exists():
            parts = {p: list(zip(*self.history.getValue((p,)))) for (p,) in self.history.keys()}
            publisher.restore_rows(json.loads(self.state.get()[0]), [r for p in sorted(parts) for r in parts[p]])
        x, z = pdf[self.cols].to_numpy(float), pdf[self.noises].to_numpy(float)
        out, used = np.empty_like(x), np.empty((len(pdf), 2))
        first = publisher.i
        touched = set()
        for i, (uq, ut) in enumerate(zip(pdf["u_query"].astype(float), pdf["u_threshold"].astype(float))):
            used[i] = publisher.publish(x[i], z[i], uq, ut)
            out[i] = publisher.out
            touched.add((first + i) // _HISTORY_ROWS)
            parts.setdefault((first + i) // _HISTORY_ROWS, []).append(publisher.last_row())
        in_sight = publisher.i - max(publisher.window, publisher.history)
        for p, rows in parts.items():
            if (p + 1) * _HISTORY_ROWS <= in_sight:
                self.history.removeKey((p,))
            elif p in touched:
                self.history.updateValue((p,), tuple([float(v) if j else int(v) for v in column] for j, column in enumerate(zip(*rows))))
        self.state.update((json.dumps(publisher.scalars()),))
        res = pd.DataFrame({"series_id": [key[0]] * len(pdf), "pos": first + np.arange(len(pdf))})
        for j, c in enumerate(self.cols):
            res[c] = out[:, j]
        res["eps_used"], res["svt_used"] = used[:, 0], used[:, 1]
        yield res


def private_release(stream: DataFrame, key: str, order: str, row_id: str, cols: Sequence[str], epsilon: float,
                    s_p: float, s_s: float, window: int, windows_back: int = 2, seed: int = 42, ts: str | None = None,
                    delay: str | None = None) -> DataFrame:
    """Streaming twin of ``publish_streams`` for one budget; ``row_id`` identifies a row for its noise. With ``ts`` and ``delay`` rows
    are put in order up to that lateness (see ``InOrder``)."""
    def unit(role: str) -> Column:
        return laplace(uniform("spas", role, F.lit(seed), F.col(row_id)), 1.0)

    noised = stream.select(*dict.fromkeys([key, order, row_id, *cols, *([ts] if ts else [])])).withColumns(
        {**{f"noise_{c}": unit(c) for c in cols}, "u_query": unit("query"), "u_threshold": unit("threshold")})
    schema = ", ".join(["series_id BIGINT", "pos BIGINT", *[f"{c} DOUBLE" for c in cols], "eps_used DOUBLE", "svt_used DOUBLE"])
    return _in_order(noised, key, PrivateRelease(order, cols, epsilon, s_p, s_s, window, windows_back, ts), schema, delay)
