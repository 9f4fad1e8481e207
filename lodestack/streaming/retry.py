"""Uploads that fail wait in a queue of bounded size per endpoint, as keyed state of a stream, and are tried again by later runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Outcomes of payloads: sent at once, sent later from the queue, put into the queue, dropped because the queue is full, too old to wait on.
OUTCOMES = ("sent", "resent", "queued", "dropped", "expired")
OUTPUT = "endpoint long, payload long, outcome string, at timestamp"
_STATED = "endpoint long, payload long, outcome string, micros long"


@dataclass(frozen=True)
class Limits:
    """Bounds of an endpoint's queue: payloads and bytes that may wait, payloads tried again in one run, and seconds they may wait."""

    payloads: int = 10_000
    bytes: int = 1 << 30
    retries: int = 100
    seconds: int = 7 * 24 * 3600


def run_once(waiting: list[tuple], run: Row, limits: Limits) -> tuple[list[tuple], list[tuple[int, str]]]:
    """(waiting, outcomes) after a run of a collector. waiting: (payload, bytes, time), the oldest first; run: payload, bytes, code, micros (its time).

    code is the server's answer during the run. The queue is tried first, the oldest payloads first and a bounded number; a
    429 stops that, as it asks for fewer uploads, other refusals leave a payload where it is. Then the run's own payload is
    uploaded; if that fails it waits, unless the queue holds as many payloads or bytes as it may.
    """
    good, outcomes = 200 <= run["code"] < 300, []
    if good:
        sent, waiting = waiting[: limits.retries], waiting[limits.retries :]
        outcomes += [(p, "resent") for p, _, _ in sent]
        outcomes.append((run["payload"], "sent"))
    elif len(waiting) >= limits.payloads or sum(b for _, b, _ in waiting) + run["bytes"] > limits.bytes:
        outcomes.append((run["payload"], "dropped"))
    else:
        waiting = [*waiting, (run["payload"], run["bytes"], run["micros"])]
        outcomes.append((run["payload"], "queued"))
    return waiting, outcomes


class RetryQueue(StatefulProcessor):
    """The queue of each endpoint as list state; a timer of event time evicts what waited too long."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "payload long, bytes long, micros long")

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def _hold(self, waiting: list[tuple]) -> None:
        """Store the queue, and have the timer go off when its oldest payload is too old."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if waiting:
            self.waiting.put(waiting)
            self.handle.registerTimer(min(at for _, _, at in waiting) // 1000 + self.limits.seconds * 1000)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waiting, out = self._held(), []
        for run in sorted(rows, key=lambda r: (r["micros"], r["payload"])):
            waiting, outcomes = run_once(waiting, run, self.limits)
            out += [Row(endpoint=key[0], payload=p, outcome=o, micros=run["micros"]) for p, o in outcomes]
        self._hold(waiting)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end, waiting = expiredTimerInfo.getExpiryTimeInMs(), self._held()
        too_old = lambda w: w[2] // 1000 + self.limits.seconds * 1000 <= end
        old = [w for w in waiting if too_old(w)]
        self._hold([w for w in waiting if not too_old(w)])
        return iter([Row(endpoint=key[0], payload=w[0], outcome="expired", micros=end * 1000) for w in old])


def retried(runs: DataFrame, limits: Limits | None = None, late: str = "1 hour") -> DataFrame:
    """runs: a stream of (endpoint, payload, bytes, code, at). What became of every payload: endpoint, payload, outcome, at.

    Runs of an endpoint that come in one micro-batch are taken by time, then payload. State and timers are in the state store, which
    must be the RocksDB provider (`spark.sql.streaming.stateStore.providerClass`); a restart from the checkpoint goes on from there.
    """
    timed = runs.withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    done = timed.groupBy("endpoint").transformWithState(RetryQueue(limits or Limits()), _STATED, "append", "eventTime")
    return done.select("endpoint", "payload", "outcome", F.timestamp_micros("micros").alias("at"))
