"""A ranked list that grows while its answers come in, as a stream.

Events (run, batch, event, id, steps, date) of many runs come in batches: a run's `begin`, its answers, and `settled`. What a reader
sees may not jump: nothing is shown before `FIRST_ROWS` rows are there, or any once `FIRST_DELAY_MS` have passed; then a row
comes at once only if it ranks below all that is shown; the others are held, and merged in one go when the run settles. A run that settles before anything is shown paints all its rows.

State, per run: its rows so far and what was shown of them, so at most a judge window; a timer of processing time; all of it
goes when the run settles. Runs are spread over tasks by their key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FIRST_ROWS, FIRST_DELAY_MS = 8, 350
EVENTS = "run long, batch int, event string, id long, steps long, date long"
CHANGES = "run long, batch int, change string, id long, place long, inserted boolean"


class GrowingList(StatefulProcessor):
    """Emits what changes on screen: `paint` (the first rows), `append`, `merge` (all rows, in their order)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "id long, steps long, date long, shown boolean")
        self.flags = handle.getValueState("flags", "painted boolean, due boolean, batch int, shown long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        if not self.flags.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + FIRST_DELAY_MS)
        painted, due, _, shown = self.flags.get() or (False, False, 0, 0)
        batch, held = int(new.batch.max()), self._held()
        known = {r[0]: r for r in held}
        for r in new[new.event == "answer"].itertuples():
            known.setdefault(int(r.id), (int(r.id), int(r.steps), int(r.date), False))
        fresh = list(known.values())[len(held) :]
        if (new.event == "settled").any():
            self._forget()
            every = self._ordered(known.values())
            yield self._change(key, batch, "merge" if painted else "paint", every, 0, [not r[3] for r in every])
        elif painted:
            low = max(self._rank(r) for r in held if r[3])
            below = self._ordered(r for r in fresh if self._rank(r) > low)
            ids = {r[0] for r in below}
            if fresh:
                self.rows.put([*held, *((*r[:3], r[0] in ids) for r in fresh)])
            self.flags.update((True, due, batch, shown + len(below)))
            yield self._change(key, batch, "append", below, shown, [True] * len(below))
        else:
            if fresh:
                self.rows.put(list(known.values()))
            self.flags.update((False, due, batch, 0))
            if len(known) >= FIRST_ROWS or (due and known):
                yield from self._paint(key, batch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.flags.exists():
            painted, _, batch, shown = self.flags.get()
            self.flags.update((painted, True, batch, shown))
            if not painted and self.rows.exists():
                yield from self._paint(key, batch)

    def close(self) -> None:
        pass

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.rows.get()] if self.rows.exists() else []

    def _forget(self) -> None:
        self.rows.clear()
        self.flags.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    @staticmethod
    def _rank(r: tuple) -> tuple:
        """Likelier rows first, then later, then of larger id."""
        return -r[1], -r[2], -r[0]

    def _ordered(self, rows) -> list[tuple]:
        return sorted(rows, key=self._rank)

    def _paint(self, key, batch) -> Iterator[pd.DataFrame]:
        rows = self._ordered(self._held())
        self.rows.put([(*r[:3], True) for r in rows])
        self.flags.update((True, True, batch, len(rows)))
        yield self._change(key, batch, "paint", rows, 0, [True] * len(rows))

    @staticmethod
    def _change(key, batch, change, rows, before, inserted) -> pd.DataFrame:
        n = len(rows)
        out = pd.DataFrame({"run": [key[0]] * n, "batch": [batch] * n, "change": [change] * n, "id": [r[0] for r in rows], "place": range(before + 1, before + n + 1), "inserted": inserted})
        return out.astype({"run": "int64", "batch": "int32", "id": "int64", "place": "int64", "inserted": "bool", "change": "object"})


def growing_lists(answers: DataFrame) -> DataFrame:
    """answers, a stream of EVENTS, as a stream of CHANGES. Needs the RocksDB state store (STATE_STORE)."""
    return answers.groupBy("run").transformWithStateInPandas(GrowingList(), CHANGES, "Append", "ProcessingTime")


#: Settings that the stream's session needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
