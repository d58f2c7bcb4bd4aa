"""Prompt context: ordered lines a project under a budget of signs, evidence as text, and the one-line summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.functions import text as x
from helixlake.operators import asof

#: How many titles and next steps a context names, and how long a title and a note may be.
TITLES, STEPS, TITLE_CHARS, NOTE_CHARS = 3, 3, 80, 120


def evidence_text(title: Column, authors: Column, source: Column, journal: Column, year: Column, doi: Column, abstract: Column) -> Column:
    """An item of evidence as lines of title, authors, source and abstract; what is absent or empty is left out."""
    filled = lambda c: F.nullif(c, F.lit(""))
    join = lambda parts, by: F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), by)
    meta = filled(join([filled(F.coalesce(source, journal)), filled(year), F.concat(F.lit("DOI: "), filled(doi))], " · "))
    people = F.when(F.size(authors) > 0, F.concat(F.lit("Authors: "), F.array_join(authors, ", ")))
    return join([F.concat(F.lit("Title: "), title), people, F.concat(F.lit("Source: "), meta), F.concat(F.lit("Abstract: "), filled(abstract))], "\n")


def context_lines(projects: DataFrame, evidence: DataFrame, steps: DataFrame) -> DataFrame:
    """(project, place, line), the lines of each project's context in order.

    ``projects`` (project, target, tool, status, machine, bottleneck, concern, selected), ``evidence`` (project, place, title, year) and
    ``steps`` (project, place, tool) of what is recommended next. A project of which nothing is known has no lines.
    """
    c = F.col
    items = evidence.groupBy("project").agg(F.count("*").alias("saved"))
    named = _first(evidence, TITLES, F.concat(F.lit("  • "), x.truncated(c("title"), TITLE_CHARS), F.coalesce(F.concat(F.lit(" ("), F.nullif(c("year"), F.lit("")), F.lit(")")), F.lit(""))))
    queued = _first(steps, STEPS, c("tool")).groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), ", ").alias("queued"))  # STEPS rows a project
    p = projects.join(items, "project", "left").join(queued, "project", "left").fillna(0, ["saved"])
    known = F.coalesce(c("target"), c("tool"), c("status"), c("queued")).isNotNull() | (c("saved") > 0)
    line = lambda n, when, text: F.when(known & when, F.struct(F.lit(n).alias("place"), text.alias("line")))
    has = lambda name: c(name).isNotNull()
    own = [
        line(0, F.lit(True), F.lit("Workbench context (read-only):")), line(10, has("target"), F.concat(F.lit("- Target product: "), c("target"))), line(20, has("tool"), F.concat(F.lit("- Active tool: "), c("tool"))),
        line(30, c("saved") > 0, F.concat(F.lit("- Evidence bundle: "), c("selected").cast("string"), F.lit(" selected of "), c("saved").cast("string"), F.lit(" saved"))), line(50, has("bottleneck"), F.concat(F.lit("- Top bottleneck: "), x.truncated(c("bottleneck"), NOTE_CHARS))),
        line(60, has("concern"), F.concat(F.lit("- Thermodynamic concern: "), x.truncated(c("concern"), NOTE_CHARS))), line(70, has("queued"), F.concat(F.lit("- Queued next steps: "), c("queued"))), line(80, has("status"), F.concat(F.lit("- Workflow state: "), c("status"), F.lit(" ("), c("machine"), F.lit(")"))),
    ]
    fixed = p.select("project", F.explode(F.filter(F.array(*own), lambda s: s.isNotNull())).alias("s")).select("project", "s.place", "s.line")
    return fixed.union(named.select("project", (F.lit(30) + c("n")).cast("int"), "line"))


def _first(rows: DataFrame, n: int, line: Column) -> DataFrame:
    """(project, n, line) of each project's first ``n`` rows by place."""
    from pyspark.sql import Window

    return rows.select("project", "place", line.alias("line")).withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy("place", "line"))).where(F.col("n") <= n).drop("place")


def within_budget(lines: DataFrame, by: str, order: list[str], budget: int, mark: str = "…") -> DataFrame:
    """(by, text, n, cut): each key's lines joined, up to ``budget`` signs with the breaks between; the line that crosses it is shortened and ends in ``mark``.

    Signs before a line are a running sum that no key gathers in one task; only lines that fit are put together.
    """
    own = asof.summed(lines.withColumn("signs", (F.length("line") + 1).cast("long")), [by], order, "signs", "before")
    left = budget - F.col("before")
    fits = F.length("line") <= left
    shown = own.where(left > 0).withColumn("shown", F.when(fits, F.col("line")).otherwise(F.concat(F.rtrim(F.col("line").substr(F.lit(1), (left - len(mark)).cast("int"))), F.lit(mark))))
    g = shown.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, "shown"))).alias("s"), F.count("*").alias("n"), F.max(~fits).alias("cut"))  # of at most ``budget`` signs
    return g.select(by, F.array_join(F.transform("s", lambda r: r["shown"]), "\n").alias("text"), "n", "cut")
