import os
from datetime import timedelta

import pytest

from helixlake.plans import loops
from helixlake.sources import constants as k
from helixlake.streaming import workbench as op

SF = os.environ.get("HELIXLAKE_SF", "/root/testdata/sf0.001")


def brute(events, adapters, deadline, late=timedelta(seconds=1)):
    """All events of all projects in order, by plain dictionaries; at the end what the watermark has passed is overdue."""
    out, at = [], {}

    def row(e_seq, project, kind, task, status):
        p = at[project]
        prefix = next((i for i, t in enumerate(k.GOLDEN_PATH) if t not in p["held"]), 6)
        out.append((project, e_seq, kind, op.STATES[prefix + 1] if p["target"] else "idle", p["iteration"], len(p["held"]), p["evidence"], task, status))

    def overdue(project, now):
        p = at[project]
        for due, task, seq in sorted((due, task, seq) for task, (_, seq, due) in p["running"].items() if due < now):
            del p["running"][task]
            p["ended"][task] = False
            row(seq, project, "timeout", task, "error")

    for e in sorted(events, key=lambda e: (e.ts, e.seq)):
        p = at.setdefault(e.project, {"target": False, "held": set(), "iteration": 0, "evidence": 0, "queue": [], "running": {}, "ended": {}})
        overdue(e.project, e.ts)
        task, status = None, "ok"
        if e.kind == "target":
            p["target"] = True
        elif e.kind == "payload":
            p["held"].add(e.tool)
        elif e.kind == "evidence":
            p["evidence"] += 1
        elif e.kind == "loop":
            if p["target"] and set(k.GOLDEN_PATH) <= p["held"]:
                p["held"] -= set(k.GOLDEN_PATH)
                p["iteration"] += 1
            else:
                status = "refused"
        elif e.kind == "enqueue":
            p["queue"].append((e.task, e.tool, e.after))
            task, status = e.task, "pending"
        elif e.kind == "run":
            ready = [q for q in p["queue"] if q[2] is None or p["ended"].get(q[2])]
            if not ready:
                status = "idle"
            else:
                p["queue"].remove(ready[0])
                task = ready[0][0]
                if ready[0][1] in adapters:
                    p["running"][task], status = (ready[0][1], e.seq, e.ts + deadline), "running"
                else:
                    p["ended"][task], status = False, "unsupported"
        else:
            task = e.task
            if task in p["running"]:
                p["ended"][task], status = bool(e.ok), "done" if e.ok else "error"
                tool = p["running"].pop(task)[0]
                if e.ok:
                    p["held"].add(tool)
            else:
                status = "late" if task in p["ended"] else "unknown"
        row(e.seq, e.project, e.kind, task, status)
    last = max(e.ts for e in events) - late
    for project in at:
        overdue(project, last)
    return sorted(out, key=repr)




@pytest.mark.parametrize("n", [1, 4])
def test_tasks_are_those_of_a_plain_fold_however_often_the_stream_stops(spark, n):
    from pyspark.sql import functions as F

    events = loops.task_events(spark, SF).withColumn("ts", F.date_trunc("millisecond", "ts"))
    parts = loops.slices(events, n)
    assert len(parts) == n and sum(p.count() for p in parts) == events.count()
    got = op.in_slices(parts, op.EVENT, lambda s: op.fold(s, loops._ADAPTERS, 3_600_000)).collect()
    want = brute(events.collect(), loops._ADAPTERS, timedelta(hours=1))
    kinds = {(r[2], r[8]) for r in want}
    assert {("timeout", "error"), ("finish", "done"), ("finish", "error"), ("finish", "late"), ("run", "unsupported"), ("run", "running"), ("run", "idle")} <= kinds
    assert sorted(map(tuple, got), key=repr) == want


class _Store:
    """A state variable in memory that counts how often it is read or written."""

    calls = 0

    def __init__(self):
        self.at, self.list = {}, []

    def __getattribute__(self, name):
        if name not in ("at", "list", "__class__"):
            _Store.calls += 1
        return super().__getattribute__(name)

    def exists(self):
        return bool(self.at or self.list)

    def get(self):
        return self.at.get(()) if () in self.at else list(self.list)

    def update(self, value):
        self.at[()] = value

    def put(self, values):
        self.list = list(values)

    def clear(self):
        self.list = []

    def appendValue(self, value):
        self.list.append(value)

    def containsKey(self, key):
        return key in self.at

    def getValue(self, key):
        return self.at.get(key)

    def updateValue(self, key, value):
        self.at[key] = value

    def removeKey(self, key):
        self.at.pop(key, None)

    def keys(self):
        return list(self.at)

    def iterator(self):
        return list(self.at.items())


class _Handle:
    def getValueState(self, *_):
        return _Store()

    getMapState = getListState = getValueState

    def registerTimer(self, *_):
        pass


def test_a_batch_asks_the_state_store_a_bounded_number_of_times_an_event():
    from datetime import datetime

    from pyspark.sql import Row

    fold = op.Workbench(loops._ADAPTERS, 1000)
    fold.init(_Handle())
    row = lambda i, kind, after=None: Row(project=1, seq=i, ts=datetime(2024, 1, 1) + timedelta(seconds=i), kind=kind, tool="pathd", task=i, after=after, ok=True)
    n = 600
    events = [row(i, "enqueue", -1) for i in range(n)] + [row(n + i, "run") for i in range(n)] + [row(2 * n + i, "payload") for i in range(n)]
    _Store.calls = 0
    got = list(fold.handleInputRows((1,), iter(events), None))
    assert [r.status for r in got] == ["pending"] * n + ["idle"] * n + ["ok"] * n
    assert _Store.calls < n + 50  # an entry for each task that waits
