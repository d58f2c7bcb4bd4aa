"""Session views: what a planner, a task queue and a log say about a session, as ordered cards with status, outcome and current card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.operators import agent, asof

#: The card status of a task's status and of a planned step's.
TASK_STATUS = {"pending": "waiting", "running": "running", "done": "done", "error": "failed", "cancelled": "cancelled"}
STEP_STATUS = {"planned": "planned", "enqueued": "waiting", "running": "running", "done": "done", "error": "failed", "cancelled": "cancelled", "unsupported": "unsupported"}
#: Log lines of a card, and signs of a request that a card shows.
LOGS, SHOWN = 8, 96
CARD = ["session", "section", "rank", "id", "kind", "title", "status", "detail", "task", "tool", "started", "finished", "n_logs"]


def _of(known: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), c)


def shortened(text: Column, most: int = SHOWN) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def latest_tasks(events: DataFrame) -> DataFrame:
    """The state of each task as of its last event (session, task, at, event, label, tool, status, created, started, finished); of equal times the larger event counts."""
    keep = [c for c in events.columns if c not in ("session", "task")]
    return events.groupBy("session", "task").agg(F.max_by(F.struct(*keep), F.struct("at", "event")).alias("e")).select("session", "task", "e.*")


def cards(sessions: DataFrame, steps: DataFrame, tasks: DataFrame, logs: DataFrame, adapters: tuple[str, ...] = ("Workbench evidence ledger",)) -> DataFrame:
    """The cards of all sessions, with ``section`` and ``rank`` to order them and ``place`` from 1.

    ``sessions`` (session, category, reason, plan, plan_at, interrupted, context, saved): category is null where a request isn't
    classified, plan where there is none. ``steps`` (session, place, step, tool, title, objective, status, task) are those of
    the plan, ``tasks`` (session, task, label, tool, status, created, started, finished) the queue as it stands, ``logs`` (session, log, at,
    phase, message, task, tool, plan, ok) its entries, newest first; entries at one time come by log.
    A session is classified, warned of where it is off-domain, then interrupted where it was; a plan that isn't off-domain has
    its planning, context and evidence and a card a step; then come tasks of no step, blocked ones and writebacks. ``adapters``
    names the evidence adapters that are wired.
    """
    c = F.col
    none = lambda kind="string": F.lit(None).cast(kind)
    planned = c("plan").isNotNull() & (F.coalesce(c("category"), F.lit("")) != "off-domain")
    phases = lambda *p: F.count_if(c("phase").isin(*p))
    own = logs.groupBy("session").agg(F.max_by(F.struct("log", "message", "at"), F.when(c("phase") == "interrupted", F.struct("at", F.negate("log")))).alias("cut"))
    of_plan = logs.where("plan IS NOT NULL").groupBy("session", "plan").agg(phases("plan-created", "plan-warning").alias("n_plan"), F.max_by("at", F.when(c("phase") == "context-attached", F.struct("at", F.negate("log")))).alias("context_at"), F.count_if(c("task").isNull()).alias("n_free"))
    chain = steps.groupBy("session").agg(F.count("*").alias("n_steps"), F.transform(F.array_sort(F.collect_list(F.struct("place", "tool"))), lambda x: x["tool"]).alias("tools"))  # the steps of one plan
    s = sessions.join(own, "session", "left").join(of_plan, ["session", "plan"], "left").join(chain, "session", "left").fillna(0, ["n_plan", "n_free", "n_steps"])
    card = lambda when, section, id_, kind, title, status, detail, started=None, n=None: F.when(when, F.struct(F.lit(section).alias("section"), F.lit(0).cast("long").alias("rank"), id_.alias("id"), F.lit(kind).alias("kind"), F.lit(title).alias("title"), status.alias("status"), detail.alias("detail"), none().alias("task"), none().alias("tool"), (none("long") if started is None else started).cast("long").alias("started"), none("long").alias("finished"), (F.lit(0) if n is None else n).cast("long").alias("n_logs")))
    text = lambda x: F.lit(x)
    many = F.concat(F.lit("Planner proposed "), c("n_steps").cast("string"), F.lit(" step(s): "), F.array_join("tools", " → "))
    heads = F.array(
        card(c("category").isNotNull(), 0, text("step-classification"), "classification", "Classified request domain", text("done"), c("reason")),
        card(c("category") == "off-domain", 1, text("step-off-domain"), "off-domain-advisory", "Query routed outside scope", text("info"), text("no scientific tool")),
        card(c("interrupted") & c("cut").isNotNull(), 2, F.concat(F.lit("step-interrupted-"), c("cut.log").cast("string")), "interrupted", "Session interrupted", text("interrupted"), c("cut.message"), c("cut.at"), F.lit(1)),
        card(planned, 3, F.concat(F.lit("step-planning-"), c("plan").cast("string")), "planning", "Built deterministic plan", text("done"), F.when(c("n_steps") == 0, "Planner returned no actionable steps — warning recorded.").otherwise(many), c("plan_at"), c("n_plan")),
        card(planned, 4, F.concat(F.lit("step-context-"), c("plan").cast("string")), "context-attached", "Attached workbench context", F.when(c("context_at").isNotNull(), "done").otherwise("planned"), F.coalesce("context", F.lit("No active workbench context")), c("context_at"), c("context_at").isNotNull().cast("int")),
        card(planned, 5, text("step-evidence-check"), "evidence-check", "Checked evidence adapters", text("done"), F.concat(F.lit("Workbench evidence ledger holds "), c("saved").cast("string"), F.lit(f" saved item(s); {len(adapters)} adapter(s) wired."))),
    )
    head = s.select("session", F.explode(F.filter(heads, lambda x: x.isNotNull())).alias("h")).select("session", "h.*")

    task_logs = logs.where("task IS NOT NULL").groupBy("session", "task").agg(F.count("*").alias("n"))
    queue = tasks.join(task_logs, ["session", "task"], "left").fillna(0, ["n"])
    open_ = s.where(planned).select("session", "n_free")
    theirs = queue.select("session", "task", c("status").alias("task_status"), "started", "finished", "n", c("label"))
    p = steps.join(open_, "session").join(theirs, ["session", "task"], "left")
    there = c("task_status").isNotNull()
    unsupported = c("status") == "unsupported"
    status = F.when(unsupported, "unsupported").when(there, _of(TASK_STATUS, c("task_status"))).otherwise(_of(STEP_STATUS, c("status")))
    few = lambda n: F.least(n, F.lit(LOGS)).cast("long")
    plan_cards = p.select("session", F.lit(6).alias("section"), c("place").cast("long").alias("rank"), F.concat(F.lit("step-plan-"), c("step").cast("string")).alias("id"), F.when(unsupported, "unsupported-step").otherwise("plan-step").alias("kind"), "title", status.alias("status"), c("objective").alias("detail"), F.when(there, c("task")).cast("string").alias("task"), "tool", "started", "finished", few(F.when(there, c("n")).otherwise(c("n_free"))).alias("n_logs"))
    linked = steps.where("task IS NOT NULL").join(sessions.where("plan IS NOT NULL").select("session"), "session", "left_semi").select("session", "task").distinct()
    loose = queue.where(c("status").isin(*TASK_STATUS)).join(linked, ["session", "task"], "left_anti")
    loose = loose.select("session", F.lit(7).alias("section"), c("created").cast("long").alias("rank"), F.concat(F.lit("step-task-"), c("task").cast("string")).alias("id"), F.lit("plan-step").alias("kind"), c("label").alias("title"), _of(TASK_STATUS, c("status")).alias("status"), F.concat(F.lit("Ad-hoc "), F.upper("tool"), F.lit(" task")).alias("detail"), c("task").cast("string").alias("task"), "tool", "started", "finished", few(c("n")).alias("n_logs"))
    noted = logs.where(c("phase").isin("blocked-dependency", "writeback-emitted"))
    blocked = c("phase") == "blocked-dependency"
    notes = noted.select("session", F.when(blocked, 8).otherwise(9).alias("section"), F.negate("at").cast("long").alias("rank"), F.concat(F.when(blocked, "step-blocked-").otherwise("step-writeback-"), c("log").cast("string")).alias("id"), F.when(blocked, "blocked-dependency").otherwise("writeback").alias("kind"), F.when(blocked, "Downstream step blocked").otherwise(F.concat(F.lit("Writeback · "), F.coalesce(F.upper("tool"), F.lit("AXON")))).alias("title"), F.when(blocked, "blocked").when(F.coalesce("ok", F.lit(True)), "done").otherwise("failed").alias("status"), c("message").alias("detail"), c("task").cast("string").alias("task"), "tool", c("at").cast("long").alias("started"), none("long").alias("finished"), F.lit(1).cast("long").alias("n_logs"))
    every = head.select(CARD).unionByName(plan_cards.select(CARD)).unionByName(loose.select(CARD)).unionByName(notes.select(CARD))
    return asof.numbered(every, ["session"], ["section", "rank", "id"])


def overview(sessions: DataFrame, steps: DataFrame, tasks: DataFrame, logs: DataFrame, made: DataFrame) -> DataFrame:
    """One row a session: title, status, request, start, last activity, the current card and the outcome, out of its cards ``made``."""
    c = F.col
    first = lambda s: F.min_by("id", F.when(c("status") == s, c("place")))
    current = made.groupBy("session").agg(F.coalesce(first("running"), first("waiting"), first("blocked"), F.max_by("id", "place")).alias("current"), F.count("*").alias("n_cards"))
    done = steps.join(tasks.select("session", "task", c("status").alias("task_status")), ["session", "task"], "left")
    status = agent.session_status(sessions.select("session", "interrupted", F.coalesce("category", F.lit("")).alias("category"), c("plan").isNotNull().alias("has_plan")), done.select("session", (c("status") != "unsupported").alias("supported"), "task_status"))
    outcome = agent.session_outcome(made).select("session", "completed", "failed", "cancelled", "unsupported", "blocked", c("interrupted").alias("interruptions"), "writeback", "needs_user", "headline")
    chain = steps.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "tool"))), lambda x: F.upper(x["tool"])), " → ").alias("chain"))
    times = logs.groupBy("session").agg(F.max("at").alias("logged"))
    begun = tasks.groupBy("session").agg(F.min_by("created", F.struct("created", "task")).alias("created"))
    j = sessions
    for other in (current, status, outcome, chain, times, begun):
        j = j.join(other, "session", "left")
    title = F.when(c("category") == "off-domain", "Off-domain request · no plan").when(c("plan").isNotNull() & c("chain").isNotNull(), F.concat(F.lit("Session · "), c("chain"))).when(c("plan").isNotNull(), "Session · planner returned no steps").when(c("context").isNotNull(), "Session · awaiting plan").otherwise("Session · idle")
    started = F.coalesce("plan_at", "created")
    counts = ["completed", "failed", "cancelled", "unsupported", "blocked", "interruptions", "writeback", "n_cards"]
    return j.select("session", title.alias("title"), "status", shortened(c("request")).alias("request"), started.alias("started"), F.coalesce("logged", started).alias("last_activity"), "current", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts], F.coalesce("needs_user", F.lit(False)).alias("needs_user"), F.coalesce("headline", F.lit("No steps executed yet.")).alias("headline"))
