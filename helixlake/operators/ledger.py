"""Ledger operators: latest rows, pages of logs, upserts, staleness, checkpoints and counts over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key by a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def page(rows: DataFrame, order: list[Column], limit: int, most: int, least: int = 1) -> DataFrame:
    """The first ``limit`` rows, the limit held within ``least`` and ``most``; a top-k."""
    return rows.orderBy(*order).limit(max(least, min(limit, most)))


def numbered_page(rows: DataFrame, order: list[Column], page_number: int, size: int) -> DataFrame:
    """Page ``page_number`` from 1; numbers beyond the ends give the first or the last page."""
    pages = max(1, -(-rows.count() // size))
    own = min(max(1, page_number), pages)
    return rows.orderBy(*order).offset((own - 1) * size).limit(size)


def page_buttons(current: Column, pages: Column) -> Column:
    """Up to seven page numbers, 0 standing for an ellipsis."""
    last = pages.cast("int")
    mid = F.array(F.lit(1), F.lit(0), current - 1, current, current + 1, F.lit(0), last)
    left = F.array(*[F.lit(i) for i in range(1, 6)], F.lit(0), last)
    right = F.array(F.lit(1), F.lit(0), *[last - i for i in range(4, -1, -1)])
    return F.when(last <= 7, F.sequence(F.lit(1), last)).when(current <= 4, left).when(current >= last - 3, right).otherwise(mid)


def upsert(existing: DataFrame, incoming: DataFrame, key: Column, order: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Both tables, of one key the incoming row with the highest ``order``; ``keep`` columns stay as first saved."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1))).withColumn("_key", key)
    own = both.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("_new"), order)))
    first = Window.partitionBy("_key").orderBy(F.asc("_new"), order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in keep:
        own = own.withColumn(c, F.first(c).over(first))
    return own.where("_n = 1").drop("_n", "_new", "_key")


def replace_partition(existing: DataFrame, incoming: DataFrame, by: str) -> DataFrame:
    """All rows of the keys in ``incoming`` replaced by its rows."""
    return existing.join(incoming.select(by).distinct(), by, "left_anti").select(existing.columns).unionByName(incoming)


def member_activity(members: DataFrame, actors: DataFrame, on: str, limit: int = 24) -> DataFrame:
    """Members with their actors, the last seen first."""
    return members.join(actors, on).orderBy(F.desc("last_seen"), on).limit(limit)


def conflicts(writes: DataFrame, state: DataFrame) -> DataFrame:
    """Writes (project, revision) and whether a newer revision is stored already."""
    return writes.join(state.groupBy("project").agg(F.max("revision").alias("stored")), "project", "left").withColumn("conflict", F.col("revision") < F.coalesce("stored", F.lit(0)))


def upstreams(runs: DataFrame, projects: DataFrame, edges: DataFrame, tools: DataFrame) -> DataFrame:
    """(project, tool, project_ref, up, ids, signature) of every project and tool: the execution snapshot as things stand.

    ``projects`` is (project, project_ref), ``tools`` the few tools, ``edges`` (a, b, place) names the upstream tools of b in
    order. ``ids`` are the latest runs of those that have run, ``signature`` puts all in one text.
    """
    last = latest(runs, ["project", "tool"], [F.desc("created"), F.desc("revision")]).select("project", F.col("tool").alias("up"), F.col("revision").cast("string").alias("id"))
    each = projects.crossJoin(F.broadcast(tools.select("tool")))  # a few tools a project
    need = each.join(F.broadcast(edges.select(F.col("a").alias("up"), F.col("b").alias("tool"), "place")), "tool", "left").join(last, ["project", "up"], "left")
    return snapshots(need, "tool")


def snapshots(need: DataFrame, *by: str) -> DataFrame:
    """Execution snapshots of rows (project, project_ref, place, up, id and ``by``), one row per upstream tool; up is null where there is none."""
    part = F.struct("place", "up", "id")
    own = need.groupBy("project", *by).agg(F.first("project_ref").alias("project_ref"), F.array_sort(F.collect_list(F.when(F.col("up").isNotNull(), part))).alias("parts"))
    text = F.transform("parts", lambda p: F.concat_ws(":", F.lit("upstream"), p["up"], F.coalesce(p["id"], F.lit("none"))))
    head = F.array(F.col("tool"), F.coalesce("project_ref", F.lit("project:none")))
    return own.select("project", *by, "project_ref", F.col("parts.up").alias("up"), F.array_compact(F.col("parts.id")).alias("ids"), F.array_join(F.concat(head, text), "|").alias("signature"))


def freshness(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(project, tool, status, project_changed, blocking) of current snapshots against those kept with the latest runs.

    A tool that hasn't run awaits its upstream if it has one or the project is known, else it is not-run. A run
    whose signature differs is stale; blocking are the upstream tools whose place or latest run is another.
    """
    was = stored.select("project", "tool", F.col("project_ref").alias("old_ref"), F.col("up").alias("old_up"), F.col("ids").alias("old_ids"), F.col("signature").alias("old_signature"))
    x = current.join(was, ["project", "tool"], "left")
    moved = F.filter("up", lambda t, i: ~F.get("old_up", i).eqNullSafe(t) | ~F.get("old_ids", i).eqNullSafe(F.get("ids", i)))
    ran, changed = F.col("old_signature").isNotNull(), F.col("old_signature") != F.col("signature")
    waits = F.col("project_ref").isNotNull() | (F.size("up") > 0)
    status = F.when(~ran & waits, "awaiting-upstream").when(~ran, "not-run").when(changed, "stale").otherwise("fresh")
    blocking = F.when(~ran, F.col("up")).when(changed, moved).otherwise(F.slice("up", 1, 0))
    return x.select("project", "tool", status.alias("status"), (ran & ~F.col("old_ref").eqNullSafe(F.col("project_ref"))).alias("project_changed"), blocking.alias("blocking"))


def kept_with(runs: DataFrame, projects: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, tool, project_ref, up, ids, signature) as the latest run of each tool saw it: its upstream runs up to its own time."""
    last = latest(runs, ["project", "tool"], [F.desc("created"), F.desc("revision")]).select("project", "tool", F.col("created").alias("at")).join(projects, "project")
    need = last.join(F.broadcast(edges.select(F.col("a").alias("up"), F.col("b").alias("tool"), "place")), "tool", "left")
    seen = need.alias("n").join(runs.select("project", F.col("tool").alias("up"), "created", "revision").alias("r"), ["project", "up"]).where("created <= at")
    ids = seen.groupBy("project", "tool", "up").agg(F.max_by(F.col("revision").cast("string"), F.struct("created", "revision")).alias("id"))
    return snapshots(need.join(ids, ["project", "tool", "up"], "left"), "tool")


def meta_counts(rows: DataFrame, kind: str = "status") -> DataFrame:
    """(project, revision, n, and a count per status): scope counts in one pass."""
    return rows.groupBy("project").agg(F.max("revision").alias("revision"), F.count("*").alias("n"), *[F.count_if(F.col(kind) == s).alias(f"n_{s.lower()}") for s in ("O", "F", "P")])


def checkpoints(rows: DataFrame) -> DataFrame:
    """(project, tool, state): done if the latest run is final, running if open, else review."""
    last = latest(rows, ["project", "tool"], [F.desc("created"), F.desc("revision")])
    return last.select("project", "tool", F.when(F.col("status") == "F", "done").when(F.col("status") == "O", "running").otherwise("review").alias("state"))


def restore_queue(tasks: DataFrame) -> DataFrame:
    """Tasks found running after a restart become errors."""
    return tasks.withColumn("status", F.when(F.col("status") == "running", "error").otherwise(F.col("status"))).withColumn("note", F.when(F.col("status") == "error", "interrupted"))
