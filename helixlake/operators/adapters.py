"""Tool adapters: which tools can be run over a table of tasks, a controlled error for the others, and provenance around a run."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.functions import shapes

#: An adapter takes (task, input), the tasks of its tool, and returns (task, result): JSON, null where it failed.
Adapter = Callable[[DataFrame], DataFrame]


class Registration(NamedTuple):
    tool: str
    adapter: Adapter
    label: str
    needs: str = ""


class Adapters:
    """Adapters by tool; of two for one tool the later counts."""

    def __init__(self, registrations: list[Registration]) -> None:
        self.by_tool = {r.tool: r for r in registrations}

    def get(self, tool: str) -> Adapter | None:
        return self.by_tool[tool].adapter if tool in self.by_tool else None

    def list(self) -> list[Registration]:
        return list(self.by_tool.values())

    def supported(self, tool: str) -> bool:
        return tool in self.by_tool

    def run(self, tasks: DataFrame) -> DataFrame:
        """(task, tool, status, result, error) of tasks (task, tool, input): every tool's tasks by its adapter, as one table each.

        Tasks of other tools end as errors that say so; an adapter's tasks without a result are errors too.
        """
        other = tasks.where(~F.coalesce(F.col("tool").isin(*self.by_tool), F.lit(False))) if self.by_tool else tasks
        told = F.concat(F.lit('Tool "'), F.coalesce("tool", F.lit("")), F.lit('" has no adapter.'))
        out = other.select("task", "tool", F.lit("error").alias("status"), F.lit(None).cast("string").alias("result"), told.alias("error"))
        for tool, own in self.by_tool.items():
            mine = tasks.where(F.col("tool") == tool)
            found = own.adapter(mine.select("task", "input")).select("task", "result")
            ok = F.col("result").isNotNull()
            out = out.unionByName(mine.select("task", "tool").join(found, "task", "left").select("task", "tool", F.when(ok, "done").otherwise("error").alias("status"), "result", F.when(~ok, "no result").alias("error")))
        return out


def with_provenance(adapter: Adapter, tool: str, version: str = "1") -> Adapter:
    """The adapter, with an entry ``provenance`` in every result: the tool, its version and the digests of input and payload."""

    def run(tasks: DataFrame) -> DataFrame:
        digest = lambda c: F.sha2(F.coalesce(shapes.canonical_json(F.col(c)), F.col(c)).cast("binary"), 256)
        done = adapter(tasks).select("task", "result").join(tasks.select("task", digest("input").alias("read")), "task")
        entry = F.to_json(F.struct(F.lit(tool).alias("tool"), F.lit(version).alias("version"), F.col("read").alias("input"), digest("result").alias("payload")))
        return done.select("task", F.when(F.col("result").isNotNull(), F.concat(F.lit('{"payload":'), "result", F.lit(',"provenance":'), entry, F.lit("}"))).alias("result"))

    return run
