"""The running statistics over streams: windows with watermarks, and states a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream's watermark; it needs a time with a zone. A table has none."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed_stats(events: DataFrame, keys: list[str], time: str, value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """``window``, keys, ``nnz``, ``tot``, ``mu``, ``sig`` for a streaming or batch table; events later than `late` are left out."""
    at = F.window(time, width, slide) if slide else F.window(time, width)
    rows = _watermarked(events, time, late)
    x = F.col(value).cast("double")
    got = rows.groupBy(at.alias("window"), *keys).agg(F.sum((x > 0).cast("long")).alias("nnz"), F.sum(x).alias("tot"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sig"))
    return got.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "nnz", "tot", "mu", "sig")


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str, value: str) -> DataFrame:
    """Events of a key that lie less than `gap` apart: ``start``, ``end``, keys, ``n``, ``tot``."""
    rows = _watermarked(events, time, late)
    got = rows.groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("tot"))
    return got.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "n", "tot")


class P2:
    """The P² estimate of one quantile: five markers, moved by each observation."""

    def __init__(self, p: float, state: list[float] | None = None):
        self.p = p
        self.n, self.q, self.at, self.want = (int(state[0]), state[1:6], state[6:11], state[11:16]) if state else (0, [], [], [])

    def state(self) -> list[float]:
        fill = [0.0] * 5
        return [float(self.n), *(self.q + fill)[:5], *(self.at + fill)[:5], *(self.want + fill)[:5]]

    def add(self, x: float) -> None:
        p = self.p
        if self.n < 5:
            self.q = sorted([*self.q[: self.n], x])
            self.n += 1
            if self.n == 5:
                self.at, self.want = [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 1 + 2 * p, 1 + 4 * p, 3 + 2 * p, 5.0]
            return
        q, at = self.q, self.at
        self.n += 1
        if x < q[0]:
            q[0], k = x, 0
        elif x >= q[4]:
            q[4], k = max(q[4], x), 3
        else:
            k = max(i for i in range(4) if q[i] <= x)
        for i in range(k + 1, 5):
            at[i] += 1
        for i, step in enumerate((0, p / 2, p, (1 + p) / 2, 1)):
            self.want[i] += step
        for i in (1, 2, 3):
            d = self.want[i] - at[i]
            if (d >= 1 and at[i + 1] - at[i] > 1) or (d <= -1 and at[i - 1] - at[i] < -1):
                s = 1 if d > 0 else -1
                up, down = at[i + 1] - at[i], at[i] - at[i - 1]
                new = q[i] + s / (at[i + 1] - at[i - 1]) * ((down + s) * (q[i + 1] - q[i]) / up + (up - s) * (q[i] - q[i - 1]) / down)
                if not q[i - 1] < new < q[i + 1]:
                    new = q[i] + s * (q[i + s] - q[i]) / (at[i + s] - at[i])
                q[i] = new
                at[i] += s

    def value(self) -> float:
        if not self.n:
            return float("nan")
        if self.n < 5:
            return self.q[min(self.n - 1, int(self.p * (self.n - 1) + 0.5))]
        return self.q[2]


def running_quantile(events: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """A stream's ``key``, ``n``, ``quantile``: each key's P² estimate, kept as state and updated by each batch."""

    def update(name: tuple, pages: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        p2 = P2(p, list(state.get[0]) if state.exists else None)
        for page in pages:
            for x in page[value]:
                p2.add(float(x))
        state.update((p2.state(),))
        yield pd.DataFrame({key: [name[0]], "n": [p2.n], "quantile": [p2.value()]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, value).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, quantile double", "markers array<double>", "update", "NoTimeout")


def running_quantile_batch(rows: DataFrame, key: str, order: list[str | Column], value: str, p: float) -> DataFrame:
    """The same over a table, each key's rows in the given order, streamed through one pass a partition."""
    names = [f"_o{k}" for k in range(len(order))]
    slim = rows.select(key, F.col(value).cast("double").alias("_v"), *((F.col(o) if isinstance(o, str) else o).alias(n) for o, n in zip(order, names, strict=True)))
    ordered = slim.repartition(key).sortWithinPartitions(key, *names).select(key, "_v")
    kind = rows.schema[key].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, p2 = None, None
        for page in batches:
            out = []
            for k, x in zip(page[key], page["_v"], strict=True):
                if p2 is None or k != now:
                    if p2 is not None:
                        out.append((now, p2.n, p2.value()))
                    now, p2 = k, P2(p)
                p2.add(float(x))
            if out:
                yield pd.DataFrame(out, columns=[key, "n", "quantile"])
        if p2 is not None:
            yield pd.DataFrame([(now, p2.n, p2.value())], columns=[key, "n", "quantile"])

    return ordered.mapInPandas(read, f"{key} {kind}, n long, quantile double")
