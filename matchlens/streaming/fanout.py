"""Batches of a stream to several sinks, each with its own ledger of what it has.

A batch is written once to a spool; the stream is done with it then. Every sink takes the spooled batches in order, in a thread of its own, and notes the last one it has.
A sink that fails or is slow falls behind alone and catches up later, from the spool and in order; neither the stream nor the other sinks wait for it. A batch that a sink refuses
again and again becomes a dead letter of that sink, so that later ones get through; `replay` offers dead letters again. A batch leaves the spool when all sinks have it.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.streaming.store import Record, Store

log = logging.getLogger(__name__)

Sink = Callable[[DataFrame, int], None]


@dataclass
class State:
    """What the ledger holds of a sink."""
    upto: int = -1                                       # it has all batches up to this one, but for the dead letters
    dead: list[int] = field(default_factory=list)
    failures: int = 0                                    # attempts at the next batch
    closed_until: int = -1                               # the circuit: not tried again before the stream's batch of this number


class FanOut:
    """A foreachBatch writer. Sinks must take a repeated batch without harm, as `folder_sink` does: one that failed half-way is offered again.

    One driver writes to a path. most_attempts: refusals after which a batch is a dead letter (a sink that is down for a
    while is tried after 1, 2, 4, ... more batches, longest apart `longest`); patience: seconds that a batch waits for the sinks at most.
    """

    def __init__(self, spark: SparkSession, sinks: dict[str, Sink], path: str, most_attempts: int = 20, longest: int = 64, patience: float = 600.0):
        self._spark, self._sinks, self._path = spark, sinks, path.rstrip("/")
        self._most, self._longest, self._patience = most_attempts, longest, patience
        self._store = Store(spark, self._path)
        self._ledger = {name: Record(self._store, f"ledger/{name}") for name in sinks}
        self._threads: dict[str, threading.Thread] = {}
        self._locks = {name: threading.Lock() for name in sinks}

    # --- state

    def state(self, name: str) -> State:
        return State(**self._ledger[name].get({}))

    def _spooled(self) -> list[int]:
        return sorted(int(n.removeprefix("batch=")) for n in self._store.names("spool") if n.startswith("batch="))

    def _batch(self, epoch: int) -> DataFrame:
        return self._spark.read.parquet(f"{self._path}/spool/batch={epoch}")

    def pending(self, name: str) -> DataFrame | None:
        """What the sink doesn't have yet, with its batch: dead letters and what it is behind. None if it has everything."""
        state = self.state(name)
        waiting = [e for e in self._spooled() if e > state.upto or e in state.dead]
        frames = [self._batch(e).withColumn("batch", F.lit(e)) for e in waiting]
        return reduce(DataFrame.unionByName, frames) if frames else None

    # --- the stream's side

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if not self._store.has(f"spool/batch={epoch}/_SUCCESS"):
            batch.write.mode("overwrite").parquet(f"{self._path}/spool/batch={epoch}")
        for name in self._sinks:
            running = self._threads.get(name)
            if running is None or not running.is_alive():
                self._threads[name] = InheritableThread(target=self._drain, args=(name, epoch), daemon=True)
                self._threads[name].start()
        self.wait(self._patience)
        self._purge()

    def wait(self, seconds: float | None = None) -> bool:
        """Waits until no sink is at work, for so many seconds at most; whether that is so."""
        end = None if seconds is None else time.monotonic() + seconds
        for thread in list(self._threads.values()):
            thread.join(None if end is None else max(0.0, end - time.monotonic()))
        return not any(t.is_alive() for t in self._threads.values())

    # --- the sinks' side

    def _drain(self, name: str, now: int, forced: bool = False) -> None:
        with self._locks[name]:
            state = self.state(name)
            if state.closed_until > now and not forced:
                return
            while True:
                waiting = [e for e in self._spooled() if e > state.upto and self._store.has(f"spool/batch={e}/_SUCCESS")]
                if not waiting:
                    return
                epoch = waiting[0]
                try:
                    self._sinks[name](self._batch(epoch), epoch)
                    state.upto, state.failures, state.closed_until = epoch, 0, -1
                except Exception:                        # noqa: BLE001 - whatever a sink does is its own trouble
                    state.failures += 1
                    log.exception("sink %s refused batch %s for the %s. time", name, epoch, state.failures)
                    if state.failures >= self._most:
                        state.upto, state.failures, state.closed_until = epoch, 0, -1
                        state.dead.append(epoch)
                    else:
                        state.closed_until = now + min(self._longest, 1 << (state.failures - 1))
                        self._ledger[name].put(asdict(state))
                        return
                self._ledger[name].put(asdict(state))

    def replay(self, name: str) -> int:
        """Offers the sink what it doesn't have, dead letters first, whatever its circuit says; how many batches are still missing."""
        with self._locks[name]:
            state = self.state(name)
            for epoch in list(state.dead):
                try:
                    self._sinks[name](self._batch(epoch), epoch)
                    state.dead.remove(epoch)
                except Exception:                        # noqa: BLE001
                    log.exception("sink %s refused dead letter %s", name, epoch)
            self._ledger[name].put(asdict(state))
        self._drain(name, state.closed_until, forced=True)
        self._purge()
        state = self.state(name)
        return len(state.dead) + sum(e > state.upto for e in self._spooled())

    def _purge(self) -> None:
        """Batches that all sinks have leave the spool; the last one stays, as the stream may offer it again after a restart."""
        states = [self.state(name) for name in self._sinks]
        kept = {e for s in states for e in s.dead}
        done = min((s.upto for s in states), default=-1)
        for epoch in self._spooled()[:-1]:
            if epoch <= done and epoch not in kept:
                self._store.delete(f"spool/batch={epoch}")
