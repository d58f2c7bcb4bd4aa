"""The trust layer: tiers, claim-surface policy, downstream gates, contracts and corpus rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.session import small
from helixlake.sources import constants as k


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "demo", 0).when(tier == "partial", 1).when(tier == "real", 2)


def meets_floor(tier: Column, floor: Column) -> Column:
    return F.coalesce(tier_rank(tier) >= tier_rank(floor), F.lit(False))


def tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(k.TOOL_TIERS, "tool string, tier string").coalesce(1)


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(k.EDGES, "a string, b string, kind string, mode string").coalesce(1)


def policies(spark: SparkSession) -> DataFrame:
    """(tool, surface, allowed, needs_provenance, needs_gate, denies_drafts): every tool on every surface."""
    s = spark.createDataFrame(k.SURFACES, "surface string, allowed array<string>, needs_provenance boolean, needs_gate boolean, denies_drafts boolean").coalesce(1)
    return tools(spark).select("tool").crossJoin(F.broadcast(s))  # 14 by 5 constants


def tier_block_code(tier: Column, surface: Column) -> Column:
    return F.when((tier == "demo") & (surface == "protocol"), "DEMO_OUTPUT_PROTOCOL_BLOCKED").when((tier == "demo") & (surface == "external-handoff"), "EXTERNAL_HANDOFF_BLOCKED").otherwise("TIER_NOT_ALLOWED_FOR_SURFACE")


def decide(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds (status, code, override) to requests (tool, surface, tier, draft, provenance, human): the first rule that holds decides.

    ``provenance`` counts ids, ``human`` is null, approved, pending or rejected. No policy, no tier, a draft
    where none may be, a tier that isn't allowed and missing provenance block; an open human gate gates.
    """
    j = requests.join(small(policy), ["tool", "surface"], "left")
    tier, human = F.col("tier"), F.coalesce("human", F.lit("pending"))
    gate = F.col("needs_gate") & (human != "approved")
    rules = [
        (F.col("allowed").isNull(), "blocked", F.lit("MISSING_POLICY"), "not-allowed"),
        (tier.isNull(), "blocked", F.lit("TIER_NOT_ALLOWED_FOR_SURFACE"), "not-allowed"),
        (F.col("draft") & F.col("denies_drafts"), "blocked", F.lit("DRAFT_OUTPUT_NOT_EXPORTABLE"), "human-review"),
        (~F.array_contains("allowed", tier), "blocked", tier_block_code(tier, F.col("surface")), "not-allowed"),
        (F.col("needs_provenance") & (F.coalesce("provenance", F.lit(0)) == 0), "blocked", F.lit("PROVENANCE_REQUIRED"), "human-review"),
        (gate & (human == "rejected"), "blocked", F.lit("HUMAN_GATE_REQUIRED"), "not-allowed"),
        (gate, "gated", F.lit("HUMAN_GATE_REQUIRED"), "human-review"),
        (tier == "demo", "demoOnly", F.lit(None).cast("string"), None),
    ]
    out = F.struct(F.lit("ok").alias("status"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("override"))
    for when, status, code, override in reversed(rules):
        out = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(status).alias("status"), code.alias("code"), F.lit(override).cast("string").alias("override"))).otherwise(out)
    return j.select(*requests.columns, out.alias("d")).select(*requests.columns, "d.*")


def downstream_gate(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, allowed, severity, rule) for payloads (source, tier, has_provenance, blocking, warnings) and targets (target, target_tier).

    ``blocking`` and ``warnings`` count assumptions. Rules: 1 no provenance, 2 demo into demo, 3 demo into
    more, 4 and 5 blocking assumptions into real and partial, 6 caution, 7 allowed.
    """
    tier, to = F.coalesce("tier", F.lit("unknown")), F.coalesce("target_tier", F.lit("unknown"))
    rules = [
        (~F.coalesce("has_provenance", F.lit(False)), False, "block"), ((tier == "demo") & (to == "demo"), True, "warn"), ((tier == "demo") & to.isin("partial", "real"), False, "block"),
        ((to == "real") & (F.col("blocking") > 0), False, "block"), ((to == "partial") & (F.col("blocking") > 0), False, "block"),
        ((F.col("warnings") > 0) | (tier == "partial") | (to == "partial"), True, "warn"),
    ]
    out = F.struct(F.lit(True).alias("allowed"), F.lit("allow").alias("severity"), F.lit(7).alias("rule"))
    for number, (when, allowed, severity) in reversed(list(enumerate(rules, 1))):
        out = F.when(when, F.struct(F.lit(allowed).alias("allowed"), F.lit(severity).alias("severity"), F.lit(number).alias("rule"))).otherwise(out)
    return sources.join(small(targets), sources.source != targets.target).select("source", "target", out.alias("d")).select("source", "target", "d.*")


def contract_status(payloads: DataFrame) -> DataFrame:
    """Adds ``reasons`` and ``ok`` to (tier, floor, confidence, min_confidence, uncertainty, bounded, evidence, min_evidence, missing_outputs, simulated).

    A null minimum asks for nothing, ``bounded`` asks for an uncertainty. Simulated output is a reason of its own.
    """
    c = F.col
    reasons = F.array(
        F.when(c("missing_outputs") > 0, "REQUIRED_OUTPUTS_MISSING"),
        F.when(~meets_floor(c("tier"), c("floor")), "VALIDITY_BELOW_FLOOR"),
        F.when(c("min_confidence").isNotNull() & ~F.coalesce(c("confidence") >= c("min_confidence"), F.lit(False)), "CONFIDENCE_BELOW_FLOOR"),
        F.when(c("bounded") & c("uncertainty").isNull(), "UNCERTAINTY_UNBOUNDED"),
        F.when(c("evidence") < c("min_evidence"), "EVIDENCE_MISSING"),
        F.when(c("simulated"), "SIMULATED_OUTPUT"),
    )
    return payloads.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull())).withColumn("ok", F.size("reasons") == 0)


def golden_prefix(status: DataFrame) -> DataFrame:
    """(project, reached, next_place): how far (project, place, ok) is satisfied without a gap from place 1; a missing place is a gap."""
    own = Window.partitionBy("project").orderBy("place")
    good = F.col("ok") & (F.row_number().over(own) == F.col("place"))
    s = status.withColumn("good", good).withColumn("run", F.min(F.col("good").cast("int")).over(own))
    return s.groupBy("project").agg(F.coalesce(F.max(F.when(F.col("run") == 1, F.col("place"))), F.lit(0)).alias("reached")).withColumn("next_place", F.col("reached") + 1)


def coverage(labels: DataFrame, *keys: str) -> DataFrame:
    """(key, value, n): counts by each key alone, in one pass over a row per key."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in keys]))
    return labels.select(each.alias("e")).groupBy("e.key", "e.value").agg(F.count("*").alias("n"))


def reconcile(labels: DataFrame, cases: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem): labels without a case, cases without a label, and fields that differ."""
    j = labels.alias("l").join(cases.alias("c"), F.col(f"l.{key}") == F.col(f"c.{key}"), "full_outer")
    problems = F.array(
        F.when(F.col(f"c.{key}").isNull(), "no case"), F.when(F.col(f"l.{key}").isNull(), "no label"),
        *[F.when(F.col(f"l.{key}").isNotNull() & F.col(f"c.{key}").isNotNull() & ~F.col(f"l.{f}").eqNullSafe(F.col(f"c.{f}")), f"{f} differs") for f in fields],
    )
    return j.select(F.coalesce(f"l.{key}", f"c.{key}").alias(key), F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))
