"""A project's workflow as state of many variables: target, payloads, evidence, iteration, a queue of tasks and their deadlines.

Events of a project are folded in order: within a batch by (ts, seq), and batches are expected in order of time. The state
lies in Spark's state store under the project's key, so a query that is stopped goes on from its checkpoint.
"""

from __future__ import annotations

import calendar
import heapq
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

from helixlake.session import shared_dir
from helixlake.sources import constants as k

#: Names of the states: without a target, then by how many tools of the golden path, from the first on, have a payload.
STATES = ("idle", "targetSet", "pathdReady", "fbasimReady", "catdesReady", "dynconReady", "cellfreeReady", "dbtlCommitted")
#: Milliseconds after which a running task has failed.
DEADLINE = 60_000
EVENT = "project long, seq long, ts timestamp, kind string, tool string, task long, after long, ok boolean"
OUT = "project long, seq long, kind string, state string, iteration long, n_payloads long, n_evidence long, task long, status string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ROW = Row(*[c.split()[0] for c in OUT.split(", ")])


def state_name(target: bool, payloads) -> str:
    done = next((i for i, tool in enumerate(k.GOLDEN_PATH) if tool not in payloads), len(k.GOLDEN_PATH))
    return STATES[done + 1] if target else STATES[0]


class Workbench(StatefulProcessor):
    """Folds the events of a project; every event gives a row, and so does every task that misses its deadline.

    ``target`` sets the target, ``payload`` stores a tool's payload, ``evidence`` counts; ``loop`` begins the next iteration and
    clears the golden path's payloads, from the last state only. ``enqueue`` adds a task, to wait for ``after`` where that is given;
    ``run`` starts the first one that need not wait, which fails at once where its tool has no adapter; ``finish`` ends
    a running one, and stores its tool's payload if it went well. A finish after the deadline comes too late.
    """

    def __init__(self, adapters: tuple[str, ...], deadline: int = DEADLINE) -> None:
        self.adapters, self.deadline = adapters, deadline

    def init(self, handle) -> None:
        self.handle = handle
        self.project = handle.getValueState("project", "target boolean, iteration long, evidence long, place long")
        self.payloads = handle.getMapState("payloads", "tool string", "seq long")
        self.queue = handle.getMapState("queue", "place long", "task long, tool string, after long, ready boolean")
        self.running = handle.getMapState("running", "task long", "tool string, seq long, due long")
        self.ended = handle.getMapState("ended", "task long", "ok boolean")

    def _load(self, key) -> None:
        """A project's state, once a batch; of the ended tasks only those that are asked for."""
        self.key = key[0]
        self.target, self.iteration, self.n_evidence, self.place = self.project.get() if self.project.exists() else (False, 0, 0, 0)
        self.stored = {"payloads": {t: (seq,) for (t,), (seq,) in self.payloads.iterator()}, "queue": {n: tuple(q) for (n,), q in self.queue.iterator()}, "running": {t: tuple(r) for (t,), r in self.running.iterator()}}
        self.held, self.waiting, self.runs = (dict(self.stored[name]) for name in ("payloads", "queue", "running"))
        self.over, self.told = {}, {}  # ended tasks: as found or changed, changed ones
        self.ready, self.blocked = [], {}
        for n, (_, _, after, ready) in self.waiting.items():
            self.ready.append(n) if ready else self.blocked.setdefault(after, []).append(n)
        self.due = [(due, task, seq) for task, (_, seq, due) in self.runs.items()]
        heapq.heapify(self.ready)
        heapq.heapify(self.due)

    def _save(self) -> None:
        self.project.update((self.target, self.iteration, self.n_evidence, self.place))
        for state, old, new in ((self.payloads, self.stored["payloads"], self.held), (self.queue, self.stored["queue"], self.waiting), (self.running, self.stored["running"], self.runs)):
            for gone in old.keys() - new.keys():
                state.removeKey((gone,))
            for k_, value in new.items():
                if old.get(k_) != value:
                    state.updateValue((k_,), value)
        for task, ok in self.told.items():
            self.ended.updateValue((task,), (ok,))
        for task, (_, _, due) in self.runs.items():
            if task not in self.stored["running"] or self.stored["running"][task] != self.runs[task]:
                self.handle.registerTimer(due + 1)  # what is due has failed when the next millisecond begins

    def _ended(self, task) -> bool | None:
        """Whether a task went well, None if it has not ended."""
        if task not in self.over:
            self.over[task] = bool(self.ended.getValue((task,))[0]) if self.ended.containsKey((task,)) else None
        return self.over[task]

    def _end(self, task, ok: bool) -> None:
        self.over[task] = self.told[task] = ok
        if ok:
            for n in self.blocked.pop(task, []):
                self.waiting[n] = (*self.waiting[n][:3], True)
                heapq.heappush(self.ready, n)

    def _row(self, seq, kind, task, status) -> Row:
        return _ROW(self.key, seq, kind, state_name(self.target, self.held), self.iteration, len(self.held), self.n_evidence, task, status)

    def _overdue(self, now: int) -> Iterator[Row]:
        """Tasks whose deadline has passed at ``now``, in order of their deadlines."""
        while self.due and self.due[0][0] < now:
            due, task, seq = heapq.heappop(self.due)
            if task in self.runs and self.runs[task][1:] == (seq, due):
                del self.runs[task]
                self._end(task, False)
                yield self._row(seq, "timeout", task, "error")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load(key)
        for e in sorted(rows, key=lambda r: (r.ts, r.seq)):
            now = _millis(e.ts)
            yield from self._overdue(now)
            yield self._row(e.seq, e.kind, *getattr(self, f"_{e.kind}")(e, now))
        self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        late = sorted((due, task, seq) for (task,), (_, seq, due) in self.running.iterator() if due < now)
        if not late:
            return
        self.key, (self.target, self.iteration, self.n_evidence, _) = key[0], self.project.get()
        self.held = {t: None for (t,) in self.payloads.keys()}
        for _, task, seq in late:
            self.running.removeKey((task,))
            self.ended.updateValue((task,), (False,))
            yield self._row(seq, "timeout", task, "error")

    def _target(self, e, now):
        self.target = True
        return None, "ok"

    def _evidence(self, e, now):
        self.n_evidence += 1
        return None, "ok"

    def _payload(self, e, now):
        self.held[e.tool] = (e.seq,)
        return None, "ok"

    def _loop(self, e, now):
        if state_name(self.target, self.held) != STATES[-1]:
            return None, "refused"
        for tool in k.GOLDEN_PATH:
            self.held.pop(tool, None)
        self.iteration += 1
        return None, "ok"

    def _enqueue(self, e, now):
        n, self.place = self.place, self.place + 1
        ready = e.after is None or bool(self._ended(e.after))
        self.waiting[n] = (e.task, e.tool, e.after, ready)
        heapq.heappush(self.ready, n) if ready else self.blocked.setdefault(e.after, []).append(n)
        return e.task, "pending"

    def _run(self, e, now):
        while self.ready:
            n = heapq.heappop(self.ready)
            task, tool, after, _ = self.waiting[n]
            if after is None or self._ended(after):
                break
            self.waiting[n] = (task, tool, after, False)  # what it waits for was run again and failed
            self.blocked.setdefault(after, []).append(n)
        else:
            return None, "idle"
        del self.waiting[n]
        if tool not in self.adapters:
            self._end(task, False)
            return task, "unsupported"
        self.runs[task] = (tool, e.seq, now + self.deadline)
        heapq.heappush(self.due, (now + self.deadline, task, e.seq))
        return task, "running"

    def _finish(self, e, now):
        if e.task not in self.runs:
            return e.task, "late" if self._ended(e.task) is not None else "unknown"
        tool = self.runs.pop(e.task)[0]
        self._end(e.task, bool(e.ok))
        if e.ok:
            self.held[tool] = (e.seq,)
        return e.task, "done" if e.ok else "error"

    def close(self) -> None:
        pass


def _millis(ts) -> int:
    return calendar.timegm(ts.timetuple()) * 1000 + ts.microsecond // 1000


def fold(events: DataFrame, adapters: tuple[str, ...], deadline: int = DEADLINE, late: str = "1 second") -> DataFrame:
    """The rows of :class:`Workbench` for a stream of ``EVENT``; the session's time zone must be UTC and its state store ``STORE``."""
    own = events.withWatermark("ts", late)
    return own.groupBy("project").transformWithState(statefulProcessor=Workbench(adapters, deadline), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def in_slices(slices: list[DataFrame], schema: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Feed tables one after the other to a stream that is stopped after each and started again from its checkpoint; all it has written.

    Every slice is written whole before the query sees it, and is one batch.
    """
    spark = slices[0].sparkSession
    to = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    store, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(store, STORE)
    try:
        for part in slices:
            part.write.mode("append").parquet(f"{to}/in")
            out = make(spark.readStream.schema(schema).parquet(f"{to}/in"))
            query = out.writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(out.schema).parquet(f"{to}/out")
