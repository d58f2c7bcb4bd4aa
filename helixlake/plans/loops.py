"""Stream queries over a project's whole workflow state, in batches and restarts."""

from pyspark.sql import functions as F

from helixlake.plans.registry import query
from helixlake.sources import constants as k
from helixlake.sources import views as v
from helixlake.streaming import workbench as op

#: Parts of the time span that a stream gets one after the other.
SLICES = 3
_ADAPTERS = ("pathd", "fbasim", "catdes", "dyncon", "cellfree", "dbtlflow", "cethx")


def slices(events, n: int = SLICES):
    """``events`` in n parts of about as many rows, by time; equal times stay together."""
    cuts = events.select(F.percentile_approx(F.unix_micros("ts"), F.array(*[F.lit(i / n) for i in range(1, n)])).alias("c")).first().c or []
    edges = [None, *cuts, None]
    at = F.unix_micros("ts")
    return [events.where((at > a if a is not None else F.lit(True)) & (at <= b if b is not None else F.lit(True))) for a, b in zip(edges, edges[1:])]


def _pick(words, i):
    return F.get(F.array(*map(F.lit, words)), i.cast("int"))


def loop_events(spark, sf_dir):
    """Targets, payloads, evidence and loops of projects, out of events; most payloads are those of the golden path."""
    n, u = F.col("event_id"), F.col("user_id") % 20
    e = v.table(spark, sf_dir, "events").select(u.alias("project"), n.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), _pick(["payload", "payload", "evidence", "payload", "loop", "payload", "target", "payload"], n % 8).alias("kind"), _pick([*k.GOLDEN_PATH, "cethx"], n % 7).alias("tool"))
    none = lambda t: F.lit(None).cast(t)
    return e.withColumns({"task": none("long"), "after": none("long"), "ok": none("boolean")})


def task_events(spark, sf_dir):
    """Tasks of projects that are enqueued, run and finished, out of events; some wait for others, miss their deadline or lack an adapter."""
    n = F.col("event_id")
    kind = _pick(["enqueue", "run", "finish"], n % 3)
    task = F.when(kind == "enqueue", n).when(kind == "finish", n - 2 - 3 * (n % 2))
    return v.table(spark, sf_dir, "events").select((n / 3 % 10).cast("long").alias("project"), n.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), _pick([*k.GOLDEN_PATH, "cethx", "odd"], n % 8).alias("tool"), task.alias("task"), F.when((kind == "enqueue") & (n % 5 == 0), n - 30).alias("after"), (n % 7 != 0).alias("ok"))


_GOLD = "[" + ", ".join(f"'{t}'" for t in k.GOLDEN_PATH) + "]"


@query(f"""WITH RECURSIVE ev AS (SELECT user_id % 20 AS project, event_id AS seq, ['payload', 'payload', 'evidence', 'payload', 'loop', 'payload', 'target', 'payload'][event_id % 8 + 1] AS kind, event_id % 7 AS tool, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM events),
f(project, n, seq, kind, target, held, iteration, evidence, status) AS (SELECT DISTINCT project, 0::BIGINT, 0::BIGINT, '', false, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM ev
 UNION ALL SELECT f.project, ev.n, ev.seq, ev.kind, f.target OR ev.kind = 'target', CASE WHEN ev.kind = 'payload' THEN f.held | (1 << ev.tool) WHEN ev.kind = 'loop' AND f.target AND f.held & 63 = 63 THEN f.held & 64 ELSE f.held END,
  f.iteration + CASE WHEN ev.kind = 'loop' AND f.target AND f.held & 63 = 63 THEN 1 ELSE 0 END, f.evidence + CASE WHEN ev.kind = 'evidence' THEN 1 ELSE 0 END, CASE WHEN ev.kind = 'loop' AND NOT (f.target AND f.held & 63 = 63) THEN 'refused' ELSE 'ok' END FROM f JOIN ev ON ev.project = f.project AND ev.n = f.n + 1)
SELECT project, seq, kind, CASE WHEN NOT target THEN 'idle' ELSE [{', '.join(f"'{s}'" for s in op.STATES[1:])}][CASE {' '.join(f'WHEN held & {1 << i} = 0 THEN {i}' for i in range(6))} ELSE 6 END + 1] END AS state, iteration, bit_count(held)::BIGINT AS n_payloads, evidence AS n_evidence, status FROM f WHERE n > 0""")
def stream_loop_back(spark, sf_dir):
    parts = slices(loop_events(spark, sf_dir))
    return op.in_slices(parts, op.EVENT, lambda s: op.fold(s, _ADAPTERS)).drop("task")


@query()
def stream_tasks(spark, sf_dir):
    """Compared with a plain fold in tests/test_workbench_stream.py."""
    parts = slices(task_events(spark, sf_dir))
    return op.in_slices(parts, op.EVENT, lambda s: op.fold(s, _ADAPTERS, 3_600_000))
