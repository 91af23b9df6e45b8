"""State machines on streams: rows in any order inside the watermark, walked in the order of their time.

A ticker's rows wait in its state until the watermark has passed them; a timer for the first of them then walks all that it has
passed, and what the machine holds goes on in the state. So late rows inside the delay change nothing; later ones are
left out. Rows with one time are walked in order of their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.shipping import ship


class Walker(StatefulProcessor):
    """Keeps rows (time and numbers) until their time has passed, then steps through them."""

    #: Names of the numbers, and the type of what is held between rows.
    numbers: tuple[str, ...] = ()
    held = ""
    start: tuple = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, " + ", ".join(f"{c} double" for c in self.numbers))
        self.now = handle.getValueState("now", self.held)

    def step(self, now: tuple, row: tuple) -> tuple[tuple, tuple]:
        """What is held, and the row's own results."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new, passed = [], timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64").tolist()
            numbers = part[list(self.numbers)].astype(float)
            new += [(t, *(None if pd.isna(v) else v for v in row)) for t, row in zip(at, numbers.itertuples(index=False)) if t >= passed]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], *((v is None, v or 0.0) for v in r[1:])))
        ready = [r for r in rows if r[0] < limit]
        if not ready:
            return
        self.waiting.clear()
        if rest := rows[len(ready) :]:
            self.waiting.appendList(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        now = tuple(self.now.get()) if self.now.exists() else self.start
        out = []
        for row in ready:
            now, result = self.step(now, row[1:])
            out.append((key[0], row[0], *result))
        self.now.update(now)
        table = pd.DataFrame(out, columns=["ticker", "ts", *self.results])
        yield table.assign(ts=pd.to_datetime(table["ts"], unit="us"))


class Basket(Walker):
    """signals.basket_positions() of rows (dev, stop, take)."""

    numbers, held, start, results = ("dev", "stop", "take"), "position int", (0,), ("position",)

    def step(self, now: tuple, row: tuple) -> tuple[tuple, tuple]:
        (position,), (dev, stop, take) = now, row
        if dev is not None:
            if position == 0:
                position = 1 if dev < stop else -1 if dev > take else 0
            elif position == 1 and dev >= 0 or position == -1 and dev <= 0:
                position = 0
        return (position,), (position,)


class Signal(Walker):
    """signals.walked() of rows (z, decay, high, low), left below reset times a limit."""

    numbers, held, start, results = ("z", "decay", "high", "low"), "state int, age long, begun boolean", (0, 0, False), ("state", "adj")
    reset = 0.5

    def step(self, now: tuple, row: tuple) -> tuple[tuple, tuple]:
        (state, age, begun), (z, decay, high, low) = now, row
        if not begun or z is None:
            return (0, 0, True), (0, 1.0)
        if state == 0:
            state, age = (-1 if z > high else 1 if z < -low else 0), 0
        else:
            age += 1
            if state == -1 and z < high * self.reset or state == 1 and z > -low * self.reset:
                state = age = 0
        adj = 1.0
        if state and abs(z) >= (high if state < 0 else low):
            adj = max(0.0, 1 + state * abs(z) * decay**age)
        return (state, age, True), (state, adj)


def walked(stream: DataFrame, walker: Walker, results: str, late: str = "1 day") -> DataFrame:
    """ticker, ts and results of a stream of (ticker, ts, numbers) whose rows are late at most; the session needs the RocksDB state store."""
    ship(stream.sparkSession)
    rows = stream.withWatermark("ts", late).select("ticker", "ts", *walker.numbers)
    return rows.groupBy("ticker").transformWithStateInPandas(walker, f"ticker string, ts timestamp, {results}", "append", "eventTime")


def positions(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """ticker, ts, position of rows (ticker, ts, dev, stop, take)."""
    return walked(stream, Basket(), "position int", late)


def states(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """ticker, ts, state, adj of rows (ticker, ts, z, decay, high, low)."""
    return walked(stream, Signal(), "state int, adj double", late)
