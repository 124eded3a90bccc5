"""Batches of requests in flight: at most so many of a job are open at a time, and each ends once.

Events say that a batch is queued, is running or has come to one of the final states. Keyed state holds the job's waiting batches and its open ones; what comes out are the
transitions, in order: a batch is submitted when there is room, ends when its final state is told, and expires when nothing was heard of it for too long, which an event-time timer
sees to if the job falls silent. Submitting and asking for states are boundaries: transitions are what a client acts on, events what it reports.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values.
QUEUED, RUNNING, SUBMITTED, EXPIRED = "queued", "running", "submitted", "expired"
FINAL = ("completed", "failed", EXPIRED, "cancelled")
MOST = 4

TRANSITIONS = "job string, step long, batch string, state string, at timestamp, open int"


class Flight:
    """The batches of a job. ``waiting`` are queued, ``open`` are submitted, with the time (ms) they were last heard of."""

    def __init__(self, most: int, patience: int, saved: str | None = None):
        self.most, self.patience = most, patience
        self.waiting, self.open, self.step = json.loads(saved) if saved else ([], {}, 0)
        self.out: list[tuple[int, str, str, int, int]] = []

    def saved(self) -> str:
        return json.dumps([self.waiting, self.open, self.step])

    def tell(self, batch: str, state: str, now: int) -> None:
        self.step += 1
        self.out.append((self.step, batch, state, now, len(self.open)))

    def end(self, batch: str, state: str, now: int) -> None:
        del self.open[batch]
        self.tell(batch, state, now)

    def pass_time(self, now: int) -> None:
        for batch in sorted((b for b, since in self.open.items() if since + self.patience <= now), key=lambda b: (self.open[b], b)):
            self.end(batch, EXPIRED, now)
        self.admit(now)

    def admit(self, now: int) -> None:
        while self.waiting and len(self.open) < self.most:
            batch = self.waiting.pop(0)
            self.open[batch] = now
            self.tell(batch, SUBMITTED, now)

    def hear(self, batch: str, event: str, now: int) -> None:
        """What isn't about a batch that waits or is open (a late or repeated report) changes nothing."""
        self.pass_time(now)
        if event == QUEUED and batch not in self.open and batch not in self.waiting:
            self.waiting.append(batch)
        elif event == RUNNING and batch in self.open:
            self.open[batch] = now
        elif event in FINAL and batch in self.open:
            self.end(batch, event, now)
        self.admit(now)

    def deadline(self) -> int | None:
        return min(self.open.values()) + self.patience if self.open else None


def transitions(events: DataFrame, most: int = MOST, patience_ms: int = 24 * 3_600_000, lateness: str = "0 seconds") -> DataFrame:
    """Transitions of a stream of job, batch, event and at (timestamp): step counts a job's transitions, open its batches open after each.

    Events of a job are taken by their time within a micro-batch, ties by batch. A job's state grows with its waiting batches alone. A batch is to be queued once in a job. Rows that lack a value are left out.
    """

    def fly(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flight = Flight(most, patience_ms, state.get[0] if state.exists else None)
        if state.hasTimedOut:
            flight.pass_time(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "batch"], kind="stable")
            for batch, event, at in zip(rows["batch"], rows["event"], rows["at"], strict=True):
                flight.hear(batch, event, int(at.value // 1_000_000))
        state.update((flight.saved(),))
        if (due := flight.deadline()) is not None:
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if flight.out:
            out = pd.DataFrame(flight.out, columns=["step", "batch", "state", "at", "open"])
            yield out.assign(job=key[0], at=pd.to_datetime(out["at"], unit="ms"))[["job", "step", "batch", "state", "at", "open"]]

    kept = events.select("job", "batch", "event", "at").na.drop().withWatermark("at", lateness)
    return kept.groupBy("job").applyInPandasWithState(fly, TRANSITIONS, "flight string", "append", GroupStateTimeout.EventTimeTimeout)
