"""Workflow control: contract evaluation, gates with upstream tools, supervisor decisions, provenance, trust and admission.

Statuses are rows (project, tool, has_outputs, missing, validity, confidence, uncertainty, simulated, run_status),
one per project and tool; contracts, required inputs and assumptions are constant tables of a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions import hashing
from helixlake.operators import trust
from helixlake.sources import constants as k

KINDS = ["literature", "analysis", "tool", "system"]


def contracts(spark: SparkSession) -> DataFrame:
    """The contract table, with the least confidence as text too."""
    rows = [(*c, None if c[4] is None else f"{c[4]:g}") for c in k.CONTRACTS]
    return spark.createDataFrame(rows, "tool string, scope string, intent string, floor string, min_confidence double, bounded boolean, min_evidence int, kinds array<string>, gate_on_missing boolean, human array<string>, min_text string").coalesce(1)


def _list(parts: list[Column]) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def evidence_coverage(evidence: DataFrame) -> DataFrame:
    """(project, have, have_kinds) of evidence rows (project, kind); kinds that aren't known count as items only."""
    return evidence.groupBy("project").agg(F.count("*").cast("int").alias("have"), F.collect_set(F.when(F.col("kind").isin(*KINDS), F.col("kind"))).alias("have_kinds"))


def evaluate(statuses: DataFrame, table: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Statuses with what their contract makes of them: one flag per rule, missing kinds, reason codes and the reason as a text.

    Without ``coverage`` there is no evidence. Confidence and uncertainty are numbers or null, null being unknown.
    """
    j = statuses.join(F.broadcast(table), "tool")  # one row a tool
    if coverage is not None:
        j = j.join(coverage, "project", "left")
    else:
        j = j.withColumns({"have": F.lit(None).cast("int"), "have_kinds": F.lit(None).cast("array<string>")})
    c, no = F.col, F.array().cast("array<string>")
    have, kinds = F.coalesce("have", F.lit(0)), F.array_except("kinds", F.coalesce("have_kinds", no))
    validity = trust.meets_floor(c("validity"), c("floor"))
    confident = c("min_confidence").isNull() | F.coalesce(c("confidence") >= c("min_confidence"), F.lit(False))
    certain, enough = ~c("bounded") | c("uncertainty").isNotNull(), (have >= c("min_evidence")) & (F.size(kinds) == 0)
    rules = [
        (~c("has_outputs"), "REQUIRED_OUTPUTS_MISSING", F.concat(F.lit("required outputs missing: "), F.array_join("missing", ", "))),
        (~validity, "VALIDITY_BELOW_FLOOR", F.when(c("validity").isNull(), F.concat(F.lit("validity missing; floor "), "floor")).otherwise(F.concat(F.lit("validity "), "validity", F.lit(" below floor "), "floor"))),
        (~confident, "CONFIDENCE_BELOW_FLOOR", F.concat(F.lit("confidence below "), "min_text")),
        (~certain, "UNCERTAINTY_UNBOUNDED", F.lit("uncertainty gate unresolved")),
        (~enough, "EVIDENCE_MISSING", F.concat(F.lit("evidence "), have.cast("string"), F.lit("/"), c("min_evidence").cast("string"), F.when(F.size(kinds) > 0, F.concat(F.lit("; missing "), F.array_join(kinds, ", "))).otherwise(""))),
        (c("simulated"), "SIMULATED_OUTPUT", F.lit("payload is demo/simulated")),
    ]
    return j.select(
        *statuses.columns, "scope", "intent", "min_evidence", "gate_on_missing", "human", have.alias("have"), kinds.alias("missing_kinds"),
        validity.alias("validity_ok"), confident.alias("confidence_ok"), certain.alias("uncertainty_ok"), enough.alias("evidence_ok"),
        _list([F.when(when, code) for when, code, _ in rules]).alias("codes"), F.array_join(_list([F.when(when, text) for when, _, text in rules]), "; ").alias("reason"),
    )


def advances() -> Column:
    """An evaluated status satisfies its contract so far that the workflow may go on."""
    return F.col("has_outputs") & ~F.col("simulated") & F.col("validity_ok") & F.col("confidence_ok") & F.col("uncertainty_ok")


def gate(evaluated: DataFrame, inputs: DataFrame) -> DataFrame:
    """(project, tool, status, blocking, reason, human_gate): blocked, demoOnly, gated or ok, with regard to the upstream tools (tool, up) required.

    An upstream tool blocks where it has no payload, doesn't advance by its own contract, or its run is itself
    blocked, gated, demoOnly or simulated.
    """
    up = evaluated.select("project", F.col("tool").alias("up"), advances().alias("up_ok"), F.col("reason").alias("up_reason"), F.col("run_status").alias("up_run"))
    need = evaluated.select("project", "tool").join(F.broadcast(inputs), "tool").join(up, ["project", "up"], "left")  # a few inputs a tool
    name, gone = F.upper("up"), F.col("up_ok").isNull()
    why = _list([
        F.when(gone, F.concat(name, F.lit(" payload missing"))), F.when(~gone & ~F.col("up_ok"), F.concat(name, F.lit(" contract unsatisfied: "), "up_reason")),
        F.when(F.col("up_run").isin("blocked", "gated", "demoOnly"), F.concat(name, F.lit(" is itself "), "up_run")), F.when(F.col("up_run") == "simulated", F.concat(name, F.lit(" is simulated"))),
    ])
    found = need.select("project", "tool", "up", why.alias("why")).where(F.size("why") > 0)
    found = found.groupBy("project", "tool").agg(F.sort_array(F.collect_list(F.struct("up", "why"))).alias("w")).select("project", "tool", F.col("w.up").alias("blocking"), F.array_join(F.flatten("w.why"), "; ").alias("why"))
    j = evaluated.join(found, ["project", "tool"], "left")
    blocked = F.col("blocking").isNotNull()
    status = F.when(blocked | ~F.col("has_outputs"), "blocked").when(F.col("simulated"), "demoOnly").when(advances(), "ok").otherwise("gated")
    reason = F.when(blocked, F.col("why")).when(status == "ok", "").otherwise(F.col("reason"))
    return j.select("project", "tool", status.alias("status"), F.coalesce("blocking", F.array().cast("array<string>")).alias("blocking"), reason.alias("reason"), ((F.size("human") > 0) | status.isin("demoOnly", "gated")).alias("human_gate"))


def decide(projects: DataFrame, evaluated: DataFrame, coverage: DataFrame) -> DataFrame:
    """(project, status, tool, next, code, have, missing_kinds, confidence, uncertainty, validity, human_gate) of (project, state): what to do next.

    The state names the tool of the golden path that is due. It is blocked while its predecessor doesn't advance,
    gated by evidence where its contract says so, demoOnly if simulated; else it is run until it advances, and then its successor.
    """
    golden = F.array(*map(F.lit, k.GOLDEN_PATH))
    place = F.array_position(F.array(*map(F.lit, k.STATES)), F.col("state")) - 1  # 0 idle, 1 to 6 the tool that is due, 7 done
    own = projects.withColumn("place", place.cast("int")).withColumn("tool", F.get(golden, F.least(F.col("place"), F.lit(6)) - 1)).withColumn("before", F.get(golden, F.col("place") - 2))
    spark = projects.sparkSession
    table = F.broadcast(contracts(spark).select("tool", "min_evidence", "kinds", "gate_on_missing", "human"))
    now = evaluated.select("project", "tool", advances().alias("ok"), "simulated", "confidence", "uncertainty", "validity")
    was = evaluated.select("project", F.col("tool").alias("before"), advances().alias("before_ok"))
    j = own.join(table, "tool", "left").join(now, ["project", "tool"], "left").join(was, ["project", "before"], "left").join(coverage, "project", "left")
    have = F.coalesce("have", F.lit(0))
    kinds = F.array_except(F.coalesce("kinds", F.array().cast("array<string>")), F.coalesce("have_kinds", F.array().cast("array<string>")))
    due, yes = (F.col("place") > 0) & (F.col("place") < 7), F.lit(True)
    human, after, null = F.size("human") > 0, F.get(golden, F.col("place")), F.lit(None).cast("string")
    after_human = F.coalesce(after.isin(*[c[0] for c in k.CONTRACTS if c[9]]), F.lit(False))
    result = lambda status, nxt, code, gate, uncertain=F.lit(None).cast("double"): F.struct(F.lit(status).alias("status"), nxt.alias("next"), F.lit(code).alias("code"), gate.alias("human_gate"), uncertain.alias("uncertainty"))
    rules = [
        (F.col("place") == 7, result("complete", null, "DBTL_COMMITTED", human)), (F.col("place") == 0, result("idle", F.lit("pathd"), "NO_TARGET", ~yes)),
        (F.col("before").isNotNull() & ~F.coalesce("before_ok", F.lit(False)), result("blocked", F.col("before"), "UPSTREAM_BLOCKED", human)),
        (F.col("gate_on_missing") & ((have < F.col("min_evidence")) | (F.size(kinds) > 0)), result("gated", F.col("tool"), "EVIDENCE_GATE", yes)),
        (F.coalesce("simulated", F.lit(False)), result("demoOnly", F.col("tool"), "DEMO_ONLY", yes, F.col("uncertainty"))),
        (~F.coalesce("ok", F.lit(False)), result("ready", F.col("tool"), "CURRENT_TOOL_NOT_READY", human)),
    ]
    out = result("ready", after, "CURRENT_TOOL_SATISFIED", after_human)
    for when, what in reversed(rules):
        out = F.when(when, what).otherwise(out)
    x = j.withColumn("d", out)
    shown = F.col("place") > 0
    return x.select(
        "project", "d.status", F.when(shown, F.col("tool")).alias("tool"), "d.next", "d.code", have.alias("have"), F.when(due, kinds).otherwise(F.array().cast("array<string>")).alias("missing_kinds"),
        F.when(shown, F.col("confidence")).alias("confidence"), "d.uncertainty", F.when(shown, F.col("validity")).alias("validity"), "d.human_gate",
    )


def snapshot(decisions: DataFrame, last: DataFrame) -> DataFrame:
    """Decisions with the latest run (project, run_tool, run_status, run_blocking) of each project: a workflow tool's run that didn't advance overrules."""
    workflow = [c[0] for c in k.CONTRACTS if c[1] == "workflow"]
    gated = F.when(F.col("run_tool").isin(*workflow) & F.col("run_status").isin("blocked", "gated", "demoOnly"), F.col("run_status"))
    j = decisions.join(last, "project", "left")
    status = F.coalesce(gated, "status")
    codes = _list([F.col("code"), F.concat(F.lit("LATEST_RUN_"), F.upper(gated))])
    nxt = F.when(gated == "blocked", F.coalesce(F.get("run_blocking", F.lit(0)), "next")).otherwise(F.col("next"))
    return j.select("project", status.alias("status"), "tool", nxt.alias("next"), codes.alias("codes"), (F.col("human_gate") | status.isin("gated", "demoOnly")).alias("human_gate"), (status == "demoOnly").alias("demo_only"), "run_tool", "run_status")


def attach_provenance(payloads: DataFrame, entries: DataFrame) -> DataFrame:
    """Payloads (payload, entries) with new entries (payload, entry) appended in order of ``place``; payloads without any keep what they have."""
    new = entries.groupBy("payload").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]).alias("new"))  # a payload's own runs
    none = F.slice(F.col("new"), 1, 0)
    return payloads.join(new, "payload", "left").withColumn("entries", F.when(F.col("new").isNull(), F.col("entries")).otherwise(F.concat(F.coalesce("entries", none), "new"))).drop("new")


def chain_diagnostics(payloads: DataFrame) -> DataFrame:
    """(payload, ids, length, missing, has_missing) of (payload, entries): ids in order, each once, and upstream ids that no entry of the payload has.

    An entry is (provenance_id, tool, timestamp, upstream); without an id of its own it is tool:timestamp, without those it doesn't count.
    """
    own = lambda e: F.coalesce(e["provenance_id"], F.concat_ws(":", e["tool"], e["timestamp"].cast("string")))
    kept = F.filter(F.coalesce("entries", F.array().cast(payloads.schema["entries"].dataType)), lambda e: e["provenance_id"].isNotNull() | (e["tool"].isNotNull() & e["timestamp"].isNotNull()))
    x = payloads.select("payload", kept.alias("e")).select("payload", F.array_distinct(F.transform("e", own)).alias("ids"), F.flatten(F.transform("e", lambda e: F.coalesce(e["upstream"], F.array().cast("array<string>")))).alias("up"))
    return x.select("payload", "ids", F.size("ids").alias("length"), F.array_except(F.array_distinct("up"), "ids").alias("missing")).withColumn("has_missing", F.size("missing") > 0)


def trust_state(payloads: DataFrame) -> DataFrame:
    """(payload, trusted, source_tool, source_validity, blocking, warnings) of (payload, tool, validity, has_provenance, run_tool, run_tier, assumptions).

    A payload is trusted if it carries provenance. Its validity is the provenance's tier, else its own, else its tool's;
    its output assumptions are told by severity, those that aren't registered being neither.
    """
    spark = payloads.sparkSession
    tiers = spark.createDataFrame([*k.TOOL_TIERS, *k.SUB_TOOL_TIERS], "tool string, tool_tier string").coalesce(1)
    known = lambda severity: F.array(*[F.lit(a) for a, s in k.ASSUMPTIONS if s == severity])
    there = F.when(F.col("has_provenance"), F.coalesce("assumptions", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    pick = lambda severity: F.filter(there, lambda a: F.array_contains(known(severity), a))
    j = payloads.join(F.broadcast(tiers), "tool", "left")
    validity = F.coalesce(F.when(F.col("has_provenance"), F.col("run_tier")), "validity", "tool_tier", F.lit("unknown"))
    source = F.coalesce(F.when(F.col("has_provenance"), F.col("run_tool")), "tool")
    return j.select("payload", F.coalesce("has_provenance", F.lit(False)).alias("trusted"), source.alias("source_tool"), validity.alias("source_validity"), pick("blocking").alias("blocking"), pick("warning").alias("warnings"))


def admission_input(payloads: DataFrame, raw: str = "json") -> DataFrame:
    """What admission needs out of JSON payloads (tool, json, fallback): tier, draft, provenance ids, evidence ids, assumptions, human gate.

    The payload's validity comes before its provenance's and the fallback; values that are no tier don't count. A draft says so
    itself or by its feedback source; a gate is a known status, or a flag that is approved or pending.
    """
    v = F.try_parse_json(F.col(raw))
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    tier = lambda c: F.when(c.isin(*k.TIERS), c)
    is_text = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    is_flag = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN"
    stated = F.when(is_text("$.humanGateStatus") & get("$.humanGateStatus").isin("pending", "approved", "rejected"), get("$.humanGateStatus"))
    gate = F.coalesce(stated, F.when(is_flag("$.humanGateApproved"), F.when(get("$.humanGateApproved", "boolean"), "approved").otherwise("pending")))
    texts = lambda path: F.coalesce(get(path, "array<string>"), F.array().cast("array<string>"))
    stamp, tool = get("$.runProvenance.timestamp", "bigint"), get("$.runProvenance.toolId")
    ids = F.when(stamp.isNotNull() & tool.isNotNull(), F.array(F.concat_ws(":", tool, stamp.cast("string")))).otherwise(F.array().cast("array<string>"))
    evidence = F.filter(F.transform(F.coalesce(get("$.runProvenance.evidence", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.try_variant_get(e, "$.id", "string")), lambda x: x.isNotNull())
    return payloads.withColumns({
        "tier": F.coalesce(tier(get("$.validity")), tier(get("$.runProvenance.validityTier")), "fallback"), "draft": F.coalesce(F.when(is_flag("$.isDraft"), get("$.isDraft", "boolean")), get("$.feedbackSource") == "draft", F.lit(False)),
        "provenance_ids": ids, "evidence_ids": evidence, "assumptions": F.concat(texts("$.runProvenance.inputAssumptions"), texts("$.runProvenance.outputAssumptions")), "human": gate,
    })


def admit(requests: DataFrame, policy: DataFrame, mode: str = "enforce") -> DataFrame:
    """Claim-surface decisions of :func:`helixlake.operators.trust.decide`, and whether the payload is written: always when observing, else if ok or demoOnly."""
    out = trust.decide(requests, policy)
    return out.withColumn("write", F.lit(True) if mode == "observe" else F.col("status").isin("ok", "demoOnly"))


def experiment_records(runs: DataFrame) -> DataFrame:
    """(run, category, title, authority, status) of runs (run, tool, simulated, source, analyze_ref, feedback_source)."""
    experiment = F.col("tool").isin(*k.EXPERIMENT_TOOLS)
    linked = (F.coalesce("source", F.lit("")) != "") | (F.coalesce("analyze_ref", F.lit("")) != "")
    authority = F.when(F.col("simulated"), "simulated").when(experiment, "experiment-backed").when(linked, "evidence-linked").otherwise("contextual")
    status = F.when((F.col("tool") == "dbtlflow") & (F.col("feedback_source") == "committed"), "committed").when(F.col("simulated"), "simulated").otherwise("recorded")
    return runs.select("run", F.when(experiment, "experiment").otherwise("analysis").alias("category"), F.concat(F.upper("tool"), F.lit(" run")).alias("title"), authority.alias("authority"), status.alias("status"))


def provenance_entries(contexts: DataFrame) -> DataFrame:
    """Contexts (tool, activity, surface, actor, inputs, outputs, evidence, upstream, started, completed) with their ``provenance_id``, id lists without blanks and repeats.

    The id ends in the FNV-1a of the context as JSON text, in base 36, so equal contexts have equal ids; missing lists are empty in it, other missing values null.
    """
    lists = {"inputAssumptionIds": "inputs", "outputAssumptionIds": "outputs", "evidenceIds": "evidence", "upstreamProvenanceIds": "upstream"}
    none = F.array().cast("array<string>")
    fields = [F.col("tool").alias("toolId"), F.col("activity").alias("activityType"), "surface", "actor", *[F.coalesce(c, none).alias(name) for name, c in lists.items()], F.col("started").alias("startedAt"), F.col("completed").alias("completedAt")]
    material = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    code = F.lower(F.conv(hashing.fnv1a(material).cast("string"), 10, 36))
    clean = {c: F.array_distinct(F.filter(F.coalesce(c, none), lambda x: F.trim(x) != "")) for c in lists.values()}
    return contexts.withColumn("provenance_id", F.concat_ws(":", F.lit("provenance"), "tool", "activity", code)).withColumns(clean)
