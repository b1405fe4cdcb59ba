"""Leases of queued rows in a stream: keyed state with timers.

Every artifact is a key. `QUEUED` puts it in the queue, `CLAIM` (a worker's request that the router has sent to this key)
hands it out if nobody holds it, `DONE` by the holder ends it, `RELEASE` by the holder gives it back untried. A row that is
held goes back to the queue when its lease runs out, by the timer, without anyone asking. What comes out is a row for each
change: (id, worker, change, attempts, until). A row is handed out to one worker at a time because its key's state is in
one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LEASE_MS = 60_000
REQUEST = "id string, action string, worker string, at timestamp"
CHANGE = "id string, worker string, change string, attempts int, until timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lease(StatefulProcessor):
    def __init__(self, lease_ms: int = LEASE_MS):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # worker "" where nobody holds the row; until: epoch milliseconds, 0 likewise.
        self.state = handle.getValueState("row", "worker string, attempts int, until long, done boolean")

    def told(self, id_: str, worker: str, change: str, attempts: int, until: int) -> dict[str, Any]:
        return {"id": id_, "worker": worker, "change": change, "attempts": attempts, "until": pd.Timestamp(until, unit="ms") if until else pd.NaT}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (id_,) = key
        out = []
        worker, attempts, until, done = self.state.get() or ("", 0, 0, False)
        queued = self.state.exists()
        asked = pd.concat(list(rows), ignore_index=True).sort_values(["at", "action", "worker"], kind="stable")
        for r in asked.itertuples():
            at = int(r.at.timestamp() * 1000)
            if r.action == "QUEUED" and not queued:
                queued = True
            elif r.action == "CLAIM" and queued and not done and (not worker or until <= at):
                if worker:
                    out.append(self.told(id_, worker, "EXPIRED", attempts, 0))
                worker, attempts, until = r.worker, attempts + 1, at + self.lease_ms
                out.append(self.told(id_, worker, "HELD", attempts, until))
            elif r.action == "DONE" and worker and worker == r.worker and at < until:
                out.append(self.told(id_, worker, "DONE", attempts, 0))
                worker, until, done = "", 0, True
            elif r.action == "RELEASE" and worker and worker == r.worker and at < until:  # not tried: the attempt does not count
                attempts -= 1
                out.append(self.told(id_, worker, "RELEASED", attempts, 0))
                worker, until = "", 0
        if queued:
            self.state.update((worker, attempts, until, done))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if worker:
            self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=["id", "worker", "change", "attempts", "until"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (id_,) = key
        worker, attempts, until, done = self.state.get()
        out = []
        if worker and until <= expiredTimerInfo.getExpiryTimeInMs():
            out.append(self.told(id_, worker, "EXPIRED", attempts, 0))
            self.state.update(("", attempts, 0, done))
        yield pd.DataFrame(out, columns=["id", "worker", "change", "attempts", "until"])

    def close(self) -> None:
        pass


def leased(requests: DataFrame, lease_ms: int = LEASE_MS, late: str = "0 seconds") -> DataFrame:
    """The changes that a stream of REQUEST rows brings about, in event time. Needs STORE as the state store provider."""
    return requests.withWatermark("at", late).groupBy("id").transformWithStateInPandas(Lease(lease_ms), CHANGE, "Append", "EventTime")
