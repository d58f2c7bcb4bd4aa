"""Project state: versioned writes over several tables with a commit record, reads, scopes, records of tools and of the trust corpus."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions import mathx as m
from helixlake.functions import shapes
from helixlake.operators import commits, ledger
from helixlake.session import cut
from helixlake.sources import constants as k
from helixlake.sources import state_shapes

#: Runs of an earlier store that can be indexed.
_RUNS = shapes.List(shapes.Record({"id": shapes.Text(), "toolId": shapes.Text(), "createdAt": shapes.Number()}, needs=("id", "toolId")))
TABLES = ("state", "run_index", "experiments", "history", "audit")
#: Names that a symbol column of a dataset may have.
SYMBOL_ALIASES = ["geneSymbol", "gene_symbol", "symbol", "gene_name", "feature_name"]


def project_scope(rows: DataFrame, default: str = "workbench-default") -> Column:
    """The project that a request means: the one it names, else its state's, else the default; blanks don't count."""
    named = [F.nullif(F.trim(c), F.lit("")) for c in ("requested", "own") if c in rows.columns]
    return F.coalesce(*named, F.lit(default))


def _newest(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each key the rows of its last version."""
    last = rows.groupBy(*by).agg(F.max("version").alias("last"))
    return rows.join(last, by).where("version = last").drop("last", "version")


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """A table as of the last commit, None before the first.

    Of a project's states, runs and experiments those of its last write count, of a revision's history the last
    row; all audit rows do. A project whose last write had no run has no rows of an earlier one.
    """
    rows = commits.rows_since(spark, root, table)
    if rows is None or table == "audit":
        return rows.drop("version") if rows is not None else None
    if table == "history":
        return _newest(rows, ["project", "revision"])
    if table == "state":
        return _newest(rows, ["project"])
    last = commits.rows_since(spark, root, "state").groupBy("project").agg(F.max("version").alias("version"))
    return rows.join(last, ["project", "version"], "left_semi").drop("version")


def refused(states: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The states (project, revision, ...) of which a newer revision is stored."""
    if stored is None:
        return states.limit(0)
    return ledger.conflicts(states, stored.select("project", "revision")).where("conflict").select(states.columns)


def _tables(states: DataFrame, runs: DataFrame, bad: DataFrame | None, action: str, detail: str) -> dict[str, DataFrame]:
    audit = lambda s, status, text: s.select("project", "actor", "revision", F.lit(action).alias("action"), F.lit(status).alias("status"), F.lit(text).alias("detail"), "at")
    good = states if bad is None else states.join(bad.select("project"), "project", "left_anti")
    own = runs.join(good.select("project", "revision", "actor"), "project")
    counts = runs.groupBy("project").agg(F.count("*").alias("n_runs"))
    history = good.join(counts, "project", "left").select("project", "revision", "actor", F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"), "at", "body")
    category = F.when(F.col("tool").isin(*k.EXPERIMENT_TOOLS), "experiment").otherwise("analysis")
    log = audit(good, "ok", detail)
    return {
        "state": good, "history": history, "run_index": own.select("project", "revision", "run", "tool", "at"),
        "experiments": own.select("project", "revision", "actor", "run", "tool", category.alias("category"), "at"),
        "audit": log if bad is None else log.union(audit(bad, "refused", "a newer revision is stored")),
    }


def write_states(root: str, states: DataFrame, runs: DataFrame, action: str, detail: str, *, seen: int | None = None) -> int:
    """Write projects' states (project, revision, actor, at, body), a row each, and their runs (project, run, tool, at, ...); return the version.

    A state replaces its project's, and the project's rows of the run index and of the experiment records; history
    keeps a row a project and revision, the audit log one a write. A project whose stored revision is newer is refused: its
    rows are left out, and the audit log says so. All becomes visible at once. ``seen`` is the version that the writer has
    read; where others have committed since, revisions are compared again if they wrote one of these projects.
    """
    spark = states.sparkSession

    def make(version: int) -> dict[str, DataFrame]:
        stored = read_until(spark, root, version)
        return _tables(states, runs, None if stored is None else cut(refused(states, stored)), action, detail)

    def stale(since: int) -> bool:
        between = commits.rows_since(spark, root, "state", since)
        return between is not None and not between.join(states.select("project"), "project", "left_semi").isEmpty()

    return commits.commit(spark, root, make, seen=seen, stale=stale)


def read_until(spark: SparkSession, root: str, version: int) -> DataFrame | None:
    """(project, revision) as of a version, None before the first."""
    rows = commits.rows_since(spark, root, "state") if version else None
    return None if rows is None else _newest(rows.where(F.col("version") <= version), ["project"]).select("project", "revision")


def compact(spark: SparkSession, root: str) -> int:
    """One version with all rows as they are, so that readers need none before it."""

    def make(version: int) -> dict[str, DataFrame] | None:
        return {t: read_table(spark, root, t) for t in TABLES} if version else None

    return commits.commit(spark, root, make, whole=True)


def migrate(root: str, sources: list[tuple[str, DataFrame]], default: str = "workbench-default", at: int = 0) -> int:
    """Take over states of earlier stores, once: into an empty log only. ``sources`` are (action, table (project, body)), tried in order.

    The first source with a body that is a JSON object is taken; its other rows get an audit row that says the
    migration failed, and so do all rows of the sources before it. Blank projects are the default one; of several bodies of a project the
    one with the highest revision counts. Returns the version, 0 where a version was there already or nothing was to be written.
    """
    spark = sources[0][1].sparkSession

    def make(version: int) -> dict[str, DataFrame] | None:
        logs = []
        for action, rows in sources:
            body = F.try_parse_json("body")
            own = rows.select(F.coalesce(F.nullif(F.trim("project"), F.lit("")), F.lit(default)).alias("project"), "body", F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False)).alias("fit"), F.greatest(F.lit(0), F.coalesce(F.try_variant_get(body, "$.revision", "long"), F.lit(0))).alias("revision"))
            own = cut(own)
            bad = own.where("NOT fit")
            logs.append(bad.select("project", F.lit("system").alias("actor"), F.lit(0).cast("long").alias("revision"), F.lit(action).alias("action"), F.lit("failed").alias("status"), F.lit("no valid state").alias("detail"), F.lit(at).alias("at")))
            if own.where("fit").isEmpty():
                continue
            states = ledger.latest(own.where("fit"), ["project"], [F.desc("revision"), F.asc("body")]).select("project", "revision", F.lit("system").alias("actor"), F.lit(at).alias("at"), "body")
            runs = states.select("project", F.explode(shapes.sanitised(shapes.child(F.try_parse_json("body"), "runArtifacts"), _RUNS)["value"]).alias("r"))
            out = _tables(states, runs.select("project", F.col("r.id").alias("run"), F.col("r.toolId").alias("tool"), F.coalesce("r.createdAt", F.lit(at)).cast("int").alias("at")), None, action, "migrated an earlier state")
            break
        else:
            out = {}
        audit = ([out["audit"]] if out else []) + logs
        if not out and all(x.isEmpty() for x in logs):
            return None
        for other in audit[1:]:
            audit[0] = audit[0].union(other)
        return out | {"audit": audit[0]}

    return commits.commit(spark, root, make, only_first=True)


def state_fields(states: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, there, value, dropped) of stored states as JSON texts: whether the text is an object, its fields in a struct that is never null, and (path, reason) of all that isn't kept."""
    s = shapes.staged(states, F.try_parse_json(body), state_shapes.STATE, key)
    control = F.col("value.workflowControl")
    shown = control.withField("isDemoOnly", control["isDemoOnly"] | (control["status"] == "demoOnly"))
    return s.select(key, F.col("ok").alias("there"), F.col("value").withField("schemaVersion", F.lit(1.0)).withField("workflowControl", shown).alias("value"), "dropped")


def clean_states(states: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, value, dropped) of stored states as JSON texts: the state with all its fields, null where the text is no object, and (path, reason) of all that isn't kept."""
    return state_fields(states, key, body).select(key, F.when(F.col("there"), F.col("value")).alias("value"), "dropped")


def experiment_list(records: DataFrame, limit: int = 24) -> DataFrame:
    """The newest records of each project (project, run, created, updated, metrics as JSON), 1 to 64, metrics as strings; others than strings are dropped."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("created"), F.desc("updated"), "run"))
    parsed = F.transform(F.coalesce(F.try_variant_get(F.try_parse_json("metrics"), "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")))
    return records.withColumn("n", n).where(F.col("n") <= max(1, min(limit, 64))).drop("n").withColumn("metrics", F.filter(parsed, lambda x: x.isNotNull()))


def var_records(var: DataFrame, key: str) -> DataFrame:
    """(gene, symbol) of a dataset's genes: the first symbol column there is, the id where it is empty."""
    from helixlake.sources.records import alias_column

    found = alias_column(var.columns, SYMBOL_ALIASES)
    symbol = F.nullif(F.col(f"`{found}`").cast("string"), F.lit("")) if found else F.lit(None).cast("string")
    return var.select(F.col(key).cast("string").alias("gene"), F.coalesce(symbol, F.col(key).cast("string")).alias("symbol"))


def clean_number(c: Column) -> Column:
    """NaN is null."""
    return F.when(~F.isnan(c), c)


def cells_with_obs(cells: DataFrame, obs: DataFrame) -> DataFrame:
    """Cells with their observation by id, cells without one kept."""
    return cells.join(obs, "cell", "left")


def fill_strategies(bottlenecks: DataFrame, strategies: DataFrame) -> DataFrame:
    """(doc, node, impact, filled) of bottlenecks (doc, node, loss): the existing strategy (doc, node, impact), else one predicted from the loss."""
    made = F.concat(F.lit("+"), F.greatest(F.lit(8), m.js_round(F.col("loss") * 0.35, 0).cast("int")).cast("string"), F.lit("%"))
    j = bottlenecks.join(strategies, ["doc", "node"], "left")
    return j.select("doc", "node", F.coalesce("impact", made).alias("impact"), F.col("impact").isNull().alias("filled"))


def coerce_request(raw: Column) -> Column:
    """(glucose, oxygen, objective, species, knockouts) of a JSON request, defaults for what isn't of its kind."""
    v = F.try_parse_json(raw)
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    number = lambda p, d: F.when(kind(p).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.coalesce(F.try_variant_get(v, p, "double"), F.lit(d))).otherwise(d)
    text = lambda p, known, d: F.when(F.try_variant_get(v, p, "string").isin(*known), F.try_variant_get(v, p, "string")).otherwise(d)
    items = F.coalesce(F.try_variant_get(v, "$.knockouts", "array<variant>"), F.array().cast("array<variant>"))
    names = F.filter(F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))), lambda s: s.isNotNull() & (F.trim(s) != ""))
    return F.struct(number("$.glucose", 10.0).alias("glucose"), number("$.oxygen", 12.0).alias("oxygen"), text("$.objective", ["product", "atp"], "biomass").alias("objective"), text("$.species", ["yeast"], "ecoli").alias("species"), names.alias("knockouts"))


def simulated(validity: Column, mode: Column, demo: Column) -> Column:
    """A payload counts as simulated in a demo project, by its own validity, or by a mock or idle mode."""
    return F.coalesce(demo, F.lit(False)) | (F.coalesce(validity, F.lit("")) == "demo") | F.coalesce(mode, F.lit("")).isin("mock", "idle")


def enzyme_scores(contexts: DataFrame, enzymes: DataFrame, bonuses: list[tuple[str, str, str, int]]) -> DataFrame:
    """(context, enzyme, score), the best enzyme of each context (context, target, text): one point a shared token of three letters or more, plus bonuses.

    ``enzymes`` (enzyme, words) are few; a bonus is (field, pattern, enzyme, points). Ties go to the smaller id.
    """
    from pyspark.sql import Window

    tokens = F.array_distinct(F.filter(F.split("text", " "), lambda t: F.length(t) > 2))
    j = contexts.withColumn("tokens", tokens).crossJoin(F.broadcast(enzymes))  # a handful of enzymes a context
    score = F.size(F.filter("tokens", lambda t: F.contains(F.col("words"), t)))
    for field, pattern, enzyme, points in bonuses:
        score = score + F.when(F.regexp_like(field, F.lit(pattern)) & (F.col("enzyme") == enzyme), points).otherwise(0)
    best = Window.partitionBy("context").orderBy(F.desc("score"), "enzyme")
    return j.select("context", "enzyme", score.alias("score")).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def preferred_gene(candidates: Column, genes: list[str]) -> Column:
    """The first candidate's gene: the same token, else one that holds or is held by it; the first gene where no candidate has any."""
    token = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    names = F.array(*map(F.lit, genes))
    same = lambda t: F.get(F.filter(names, lambda g: token(g) == t), F.lit(0))
    part = lambda t: F.get(F.filter(names, lambda g: F.contains(t, token(g)) | F.contains(token(g), t)), F.lit(0))
    found = F.filter(F.transform(F.filter(F.transform(candidates, token), lambda t: t != ""), lambda t: F.coalesce(same(t), part(t))), lambda g: g.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(genes[0] if genes else ""))


def recommended_gate(rows: DataFrame) -> DataFrame:
    """Adds (gate, input_a, input_b) to upstream results (drain, viable, stable, rmse, setpoint)."""
    drain = F.coalesce("drain", F.lit(0.0))
    gate = F.when(drain > 0.45, "NAND").when(F.coalesce("stable", F.lit(False)) & F.coalesce("viable", F.lit(False)), "AND").when(F.coalesce("rmse", F.lit(0.0)) > 0.08, "OR").otherwise("NOT")
    return rows.withColumns({"gate": gate, "input_a": m.clamp(F.coalesce("setpoint", F.lit(0.6)), 0.0, 1.0), "input_b": m.clamp(F.coalesce("drain", F.lit(0.3)) + 0.15, 0.0, 1.0)})


def recommended_knockdown(rows: DataFrame) -> DataFrame:
    """Adds (efficiency, targets, protect) to upstream results (feasible, stable, bottlenecks, carbon, rmse)."""
    value = 0.72 + F.when(F.coalesce("feasible", F.lit(False)), 0.08).otherwise(0.0) + F.when(F.coalesce("stable", F.lit(False)), 0.04).otherwise(-0.03)
    count = 3 + F.coalesce("bottlenecks", F.lit(0)) + F.when(F.coalesce("carbon", F.lit(0.0)) > 60, 1).otherwise(0)
    return rows.withColumns({"efficiency": m.clamp(m.js_round(value, 2), 0.5, 1.0), "targets": F.least(F.lit(15), F.greatest(F.lit(1), count)).cast("int"), "protect": F.coalesce("rmse", F.lit(0.05)) <= 0.08})


def metric_texts(runs: DataFrame) -> DataFrame:
    """(run, metrics): a run's figures as short texts by tool, absent ones left out; other tools show the first three parts of their summary.

    ``runs`` has (run, tool, summary, a, b, c, flag, phase): the figures in the order in which each tool shows them.
    """

    def show(form: str, c: str, scale: int = 1) -> Column:
        before, digits, after = re.fullmatch(r"(.*)%\.(\d)f(.*)", form).groups()
        text = F.replace(F.format_number(F.col(c) * scale, int(digits)), F.lit(","), F.lit(""))  # rounds the exact binary value
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(before), text, F.lit(after.replace("%%", "%"))))

    state = lambda yes, no: F.when(F.col("flag"), yes).when(~F.col("flag"), no)
    lists = {
        "cellfree": [show("%.2f total protein", "a"), show("%.1f min depletion", "b"), show("%.0f%% confidence", "c", 100)],
        "dbtlflow": [show("%.0f%% pass rate", "a"), show("%.2f improvement", "b"), F.when(F.col("phase").isNotNull(), F.concat("phase", F.lit(" phase")))],
        "fbasim": [show("growth %.3f", "a"), show("%.1f%% carbon efficiency", "b"), state("feasible", "infeasible")],
        "dyncon": [show("%.2f g/L titer", "a"), show("DO RMSE %.3f", "b"), state("stable controller", "unstable controller")],
    }
    out = F.slice(F.transform(F.split("summary", "·"), lambda x: F.trim(x)), 1, 3)
    for tool, parts in lists.items():
        out = F.when(F.col("tool") == tool, F.filter(F.array(*parts), lambda x: x.isNotNull())).otherwise(out)
    return runs.select("run", out.alias("metrics"))


def tube_rows(fragments: DataFrame, primers: DataFrame, targets: DataFrame) -> DataFrame:
    """(design, kind, label, well, slot, volume, concentration) of fragments (design, id, n, length), primers (design, id, fragment, direction, tm) and targets (design, name, length)."""
    f = fragments.select("design", F.lit("fragment").alias("kind"), F.concat("id", F.lit(" ("), F.col("length").cast("string"), F.lit(" bp)")).alias("label"), F.concat(F.chr(65 + F.col("n")), F.lit("1")).alias("well"), F.lit(4).alias("slot"), F.lit(50).alias("volume"), F.lit(100).alias("concentration"))
    p = primers.select("design", F.lit("primer").alias("kind"), F.concat("id", F.lit(" (Tm "), F.col("tm").cast("string"), F.lit("°C)")).alias("label"), F.concat(F.chr(65 + F.col("fragment")), F.when(F.col("direction") == "forward", "2").otherwise("3")).alias("well"), F.lit(5).alias("slot"), F.lit(100).alias("volume"), F.lit(10).alias("concentration"))
    a = targets.select("design", F.lit("assembly").alias("kind"), F.concat("name", F.lit(" assembled ("), F.col("length").cast("string"), F.lit(" bp)")).alias("label"), F.lit("A1").alias("well"), F.lit(2).alias("slot"), F.lit(25).alias("volume"), F.lit(None).cast("int").alias("concentration"))
    return f.union(p).union(a)


def landscape_edges(variants: DataFrame, leads: DataFrame) -> DataFrame:
    """(campaign, from, to, active, intensity) of variants (campaign, variant, parent, status) with a parent; the lead (campaign, lead) is active too."""
    j = variants.where("parent IS NOT NULL").join(leads, "campaign", "left")
    chosen = F.col("status") == "selected"
    return j.select("campaign", F.col("parent").alias("from"), F.col("variant").alias("to"), (chosen | F.coalesce(F.col("variant") == F.col("lead"), F.lit(False))).alias("active"), F.when(chosen, 0.85).otherwise(0.35).alias("intensity"))


def target_node(nodes: DataFrame) -> DataFrame:
    """(doc, target): the label of a document's last node (doc, place, label, type) that is neither enzyme nor gene, the last one where all are."""
    own = ~F.col("type").isin("enzyme", "gene")
    g = nodes.groupBy("doc").agg(F.max_by(F.when(own, F.col("label")), F.when(own, F.col("place"))).alias("a"), F.max_by("label", "place").alias("b"))
    return g.select("doc", F.coalesce("a", "b").alias("target"))


def writebacks(tasks: DataFrame) -> DataFrame:
    """(task, title, summary) of finished tasks (task, tool, status, nodes, bottlenecks, provider, error); open ones are left out."""
    many = lambda c, w: F.when(F.col(c).isNotNull(), F.concat(F.col(c).cast("string"), F.lit(f" {w}"), F.when(F.col(c) == 1, "").otherwise("s")))
    parts = F.array_join(F.filter(F.array(many("nodes", "node"), many("bottlenecks", "bottleneck"), F.col("provider")), lambda x: x.isNotNull()), " · ")
    done = F.when(F.col("tool") == "pathd", F.coalesce(F.nullif(parts, F.lit("")), F.lit("PATHD run complete"))).otherwise("Axon task complete")
    failed = F.coalesce("error", F.when(F.col("tool") == "pathd", "PATHD task failed").otherwise("Axon task failed"))
    bad = F.col("status") == "error"
    summary = F.when(bad, F.concat(F.lit("error: "), failed)).otherwise(F.concat(F.lit("automation · "), done))
    return tasks.where(F.col("status").isin("done", "error")).select("task", F.upper("tool").alias("title"), summary.alias("summary"))


def changed_payloads(writes: DataFrame, last: DataFrame) -> DataFrame:
    """Writes (project, tool, payload, signature, status) that differ from the latest (project, tool, payload, signature), and whether they are published: blocked ones are not."""
    was = last.select("project", "tool", F.col("payload").alias("old"), F.col("signature").alias("old_signature"))
    j = writes.join(was, ["project", "tool"], "left").where(~(F.col("payload").eqNullSafe(F.col("old")) & F.col("signature").eqNullSafe(F.col("old_signature"))))
    return j.select(*writes.columns, (F.col("status") != "blocked").alias("published"))


def corpus_errors(cases: DataFrame, categories: list[str], statuses: list[str]) -> DataFrame:
    """(case, error) of benchmark cases (case, title, category, tool, surface, claim, tags, tier, status, rationale): every rule that a case breaks, and repeated ids."""
    surfaces = [s[0] for s in k.SURFACES]
    bad = lambda c, known: ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    short = lambda c, n: F.coalesce(F.length(c), F.lit(0)) < n
    rules = [
        (~F.coalesce(F.regexp_like("case", F.lit("^TRB-[0-9]{3}$")), F.lit(False)), "id"), (short("title", 8), "title"), (bad("category", categories), "category"), (bad("tool", k.TOOLS), "tool"), (bad("surface", surfaces), "surface"),
        (short("claim", 12), "claim"), (F.coalesce(F.size("tags"), F.lit(0)) <= 0, "no tags"), (F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: ~F.regexp_like(t, F.lit("^[a-z0-9-]+$"))), "tag form"),
        (F.size("tags") > F.size(F.array_distinct("tags")), "repeated tag"), (bad("tier", k.TIERS), "tier"), (bad("status", statuses), "status"), (short("rationale", 12), "rationale"),
    ]
    own = cases.select("case", F.explode(F.filter(F.array(*[F.when(when, name) for when, name in rules]), lambda x: x.isNotNull())).alias("error"))
    twice = cases.where("case IS NOT NULL").groupBy("case").count().where("count > 1").select("case", F.lit("repeated id").alias("error"))
    return own.union(twice)
