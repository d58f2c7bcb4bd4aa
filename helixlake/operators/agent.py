"""The research agent and the laboratory's documents: routing, plans, sessions, answers, artifacts, labware and genetic parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import text as x
from helixlake.sources import constants as k


def _hits(low: Column, words: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def product_name(text: Column) -> Column:
    """The product that a request names, null without one.

    It stands behind a cue word and a preposition, up to the next stop or the end; or else between "for" and the last word that ends
    such a name. Names are of letters, digits, blanks, hyphens and apostrophes, and begin with one of the first two.
    """
    least, most = k.PRODUCT_SIGNS
    words = F.split(F.trim(text), r"\s+")
    low = F.transform(words, lambda w: F.lower(w))
    among = lambda w, known, test: F.exists(F.array(*map(F.lit, known)), lambda x: test(w, x))
    part = lambda start, n: F.array_join(F.slice(words, start + 1, n), " ")
    fits = lambda name: F.regexp_like(name, F.lit("^[A-Za-z0-9][A-Za-z0-9 '-]*$")) & F.length(name).between(least, most)
    places = lambda a, b: F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i >= a) & (i < b))
    cue = lambda i: among(F.get(low, i), k.PRODUCT_CUES, lambda w, x: w.endswith(x)) & among(F.get(low, i + 1), k.PRODUCT_PREPOSITIONS, lambda w, x: w == x)
    behind = F.transform(F.filter(places(F.lit(0), F.size(words) - 2), cue), lambda i: F.get(F.split(part(i + 2, F.size(words)), "[.?!,]", 2), F.lit(0)))
    last = lambda i: F.filter(F.reverse(places(i + 2, F.size(words))), lambda j: among(F.get(low, j), k.PRODUCT_ENDS, lambda w, x: F.regexp_like(w, F.concat(F.lit("^"), x, F.lit(r"\b")))))
    between = F.flatten(F.transform(F.filter(places(F.lit(0), F.size(words) - 2), lambda i: F.get(low, i) == "for"), lambda i: F.transform(last(i), lambda j: part(i + 1, j - i - 1))))
    named = F.get(F.filter(F.transform(F.concat(behind, between), lambda name: F.trim(name)), fits), F.lit(0))
    return named


def route(requests: DataFrame) -> DataFrame:
    """Adds (kind, product, species, objective, signals, reason) to (request, target): which tool a request is for, none where it isn't plain.

    Reasons are empty, both, no-product, pathd, fbasim and none.
    """
    raw = F.trim(F.coalesce("request", F.lit("")))
    low = F.trim(F.regexp_replace(F.lower(raw), r"\s+", " "))
    a, b = _hits(low, k.ROUTE_PATHWAY_WORDS), _hits(low, k.ROUTE_FLUX_WORDS)
    product = F.coalesce(product_name(raw), F.nullif("target", F.lit("")))
    reason = F.when(raw == "", "empty").when((F.size(a) > 0) & (F.size(b) > 0), "both").when((F.size(a) > 0) & product.isNull(), "no-product").when(F.size(a) > 0, "pathd").when(F.size(b) > 0, "fbasim").otherwise("none")
    y = requests.withColumn("reason", reason)
    flux = F.col("reason") == "fbasim"
    objective = F.when(F.contains(low, F.lit("atp")), "atp").when(F.contains(low, F.lit("product")) | F.contains(low, F.lit("yield")), "product").otherwise("biomass")
    return y.withColumns({
        "kind": F.when(F.col("reason").isin("pathd", "fbasim"), F.col("reason")).otherwise("none"), "product": F.when(F.col("reason") == "pathd", product), "species": F.when(flux, F.when(F.contains(low, F.lit("yeast")), "yeast").otherwise("ecoli")),
        "objective": F.when(flux, objective), "signals": F.when(F.col("reason") == "pathd", a).when(flux, b).otherwise(F.array().cast("array<string>")),
    })


def plan(requests: DataFrame, supported: list[str], most: int = 5) -> DataFrame:
    """(id, steps, warnings) of (id, request, target): tools in order with what they depend on, ``most`` at most.

    Pathway and flux steps come first, the flux step after the pathway's; then every tool one of whose words the request has.
    Tools without an adapter stay in the plan as unsupported. Warnings name unsupported tools, successors on the golden
    path without an adapter, and a plan without steps.
    """
    low = F.lower(F.trim("request"))
    any_of = lambda words: F.size(_hits(low, words)) > 0
    flux = any_of(k.PLAN_WORDS["fbasim"])
    pathway = any_of(k.PLAN_WORDS["pathd"]) | F.col("target").isNotNull()
    tools = F.array(F.when(pathway, "pathd"), F.when(flux, "fbasim"), *[F.when(any_of(words), tool) for tool, words in k.PLAN_WORDS.items() if tool not in ("pathd", "fbasim")])
    own = requests.withColumn("tools", F.slice(F.filter(tools, lambda t: t.isNotNull()), 1, most))
    known, golden = F.array(*map(F.lit, supported)), F.array(*map(F.lit, k.GOLDEN_PATH))
    missing = lambda t: ~F.array_contains(known, t)
    needs = lambda t: F.when((t == "fbasim") & F.array_contains("tools", "pathd"), F.array(F.lit("pathd"))).otherwise(F.array().cast("array<string>"))
    step = lambda t: F.struct(t.alias("tool"), F.when(missing(t), "unsupported").otherwise("planned").alias("status"), needs(t).alias("depends_on"))
    after = F.filter(F.transform(F.filter("tools", lambda t: F.array_contains(golden, t)), lambda t: F.get(golden, F.array_position(golden, t).cast("int"))), lambda t: t.isNotNull())
    open_ = F.filter(after, lambda t: ~F.array_contains("tools", t) & missing(t))
    warnings = F.concat(F.transform(F.filter("tools", missing), lambda t: F.concat(F.lit("unsupported:"), t)), F.transform(open_, lambda t: F.concat(F.lit("successor:"), t)), F.when(F.size("tools") == 0, F.array(F.lit("no-steps"))).otherwise(F.array().cast("array<string>")))
    return own.select("id", F.transform("tools", step).alias("steps"), warnings.alias("warnings"))


def session_status(sessions: DataFrame, steps: DataFrame) -> DataFrame:
    """(session, status) of (session, interrupted, category, has_plan) and its plan's steps (session, supported, task_status).

    ``task_status`` is null for steps without a task.
    """
    real = F.col("supported") & F.col("task_status").isNotNull()
    n = lambda *s: F.count_if(real & F.col("task_status").isin(*s))
    g = steps.groupBy("session").agg(F.count("*").alias("n"), F.count_if("supported").alias("able"), F.count_if(real).alias("tasks"), *[n(s).alias(s) for s in ("running", "pending", "error", "cancelled", "done")])
    j = sessions.join(g, "session", "left").fillna(0, ["n", "able", "tasks", "running", "pending", "error", "cancelled", "done"])
    c = F.col
    status = (
        F.when(c("interrupted"), "interrupted").when(c("category") == "off-domain", "off-domain").when(~c("has_plan"), "idle").when((c("n") == 0) | (c("able") == 0), "unsupported")
        .when(c("running") > 0, "running").when(c("pending") > 0, "waiting").when(c("tasks") == 0, "planning").when(c("done") == c("tasks"), "completed")
        .when((c("error") > 0) & (c("done") > 0), "partial").when(c("error") > 0, "failed").when(c("cancelled") > 0, "cancelled").otherwise("waiting")
    )
    return j.select("session", status.alias("status"))


def session_outcome(steps: DataFrame) -> DataFrame:
    """(session, counts, needs_user, headline) of the session's cards (session, kind, status)."""
    planned = F.col("kind").isin("plan-step", "unsupported-step")
    own = lambda s: F.count_if(planned & (F.col("status") == s))
    of = lambda kind: F.count_if(F.col("kind") == kind)
    names = ["completed", "failed", "cancelled", "unsupported", "blocked", "interrupted", "writeback"]
    g = steps.groupBy("session").agg(own("done").alias("completed"), own("failed").alias("failed"), own("cancelled").alias("cancelled"), own("unsupported").alias("unsupported"), (own("blocked") + of("blocked-dependency")).alias("blocked"), of("interrupted").alias("interrupted"), of("writeback").alias("writeback"))
    parts = F.filter(F.array(*[F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {n}"))) for n in names]), lambda p: p.isNotNull())
    headline = F.when(F.size(parts) == 0, "No steps executed yet.").otherwise(F.array_join(parts, " · "))
    return g.select("session", *names, ((F.col("failed") > 0) | (F.col("cancelled") > 0) | (F.col("blocked") > 0) | (F.col("interrupted") > 0)).alias("needs_user"), headline.alias("headline"))


def sections(answers: DataFrame) -> DataFrame:
    """(id, section, place, kind, entry) of headed answers (id, text): summary, observations, interpretation and next-steps, as paragraphs and bullets.

    Lines before the first heading are left out; lines of a paragraph join, empty lines part them.
    """
    known = F.create_map(*[F.lit(w) for pair in k.HEADINGS.items() for w in pair])
    bare = lambda line: F.btrim(F.rtrim(F.ltrim(F.ltrim(F.lower(line), F.lit("#"))), F.lit(":")), F.lit("*"))
    heading = lambda line: F.try_element_at(known, bare(line))
    # one fold over the lines of a text: the open section, the open paragraph, and what is done
    entry = lambda s, kind, t: F.struct(s.alias("section"), F.lit(kind).alias("kind"), t.alias("entry"))
    done = "array<struct<section:string,kind:string,entry:string>>"
    start = F.struct(F.lit(None).cast("string").alias("section"), F.lit("").alias("open"), F.array().cast(done).alias("done"))
    close = lambda acc: F.when((acc["open"] != "") & acc["section"].isNotNull(), F.array_append(acc["done"], entry(acc["section"], "paragraph", acc["open"]))).otherwise(acc["done"])

    def step(acc, raw):
        line = F.trim(raw)
        head, bullet = heading(line), F.regexp_like(line, F.lit(r"^[-*•]\s+"))
        text = F.trim(F.regexp_replace(line, r"^[-*•]\s+", ""))
        shut = F.struct(acc["section"].alias("section"), F.lit("").alias("open"), close(acc).alias("done"))
        grown = F.when(acc["open"] == "", line).otherwise(F.concat(acc["open"], F.lit(" "), line))
        return (
            F.when(line == "", shut).when(head.isNotNull(), F.struct(head.alias("section"), F.lit("").alias("open"), close(acc).alias("done"))).when(acc["section"].isNull(), acc)
            .when(bullet, F.struct(acc["section"].alias("section"), acc["open"].alias("open"), F.array_append(acc["done"], entry(acc["section"], "bullet", text)).alias("done")))
            .otherwise(F.struct(acc["section"].alias("section"), grown.alias("open"), acc["done"].alias("done")))
        )

    folded = F.aggregate(F.split("text", "\n"), start, step, close)
    return answers.select("id", F.posexplode(folded).alias("place", "e")).select("id", "e.section", "place", "e.kind", "e.entry")


def sentences(texts: DataFrame) -> DataFrame:
    """(id, paragraph, place, sentence) of (id, text): paragraphs part at empty lines, sentences before capitals and digits."""
    paragraphs = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.trim(x)), lambda p: p != "")
    each = texts.select("id", F.posexplode(paragraphs).alias("paragraph", "p"))
    own = F.filter(F.transform(F.split("p", r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda x: F.trim(x)), lambda s: s != "")
    return each.select("id", "paragraph", F.posexplode(own).alias("place", "sentence"))


def stable_nodes(nodes: DataFrame, previous: DataFrame) -> DataFrame:
    """(doc, place, id, role) of nodes (doc, place, id, label, type): ids of the previous version (doc, signature, id) are kept by signature.

    A repeated id takes _2, _3 and so on in order of place. Roles follow the type, what is no known type is a hypothesis.
    """
    role = F.when(F.col("type").isin("enzyme", "gene", "cofactor", "intermediate", "impurity", "metabolite"), F.col("type")).otherwise("hypothesis")
    signature = F.concat(role, F.lit(":"), F.regexp_replace(F.lower(F.trim(F.coalesce("label", "id"))), "[^a-z0-9]+", "_"))
    own = nodes.withColumn("role", role).withColumn("signature", signature)
    j = own.join(previous.select("doc", "signature", F.col("id").alias("old")), ["doc", "signature"], "left")
    base = x.node_id(F.coalesce("old", "id", "signature"))
    base = F.when(base == "", "workflow_node").otherwise(base)
    n = F.row_number().over(Window.partitionBy("doc", "base").orderBy("place"))
    return j.withColumn("base", base).withColumn("n", n).select("doc", "place", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string"))).alias("id"), "role")


def edge_role(kind: Column, evidence: Column) -> Column:
    found = F.coalesce(evidence, F.lit("")) != ""
    return F.when(kind == "catalyzes", "catalysis").when(kind.isin("activates", "inhibits", "regulates"), "regulation").when(kind == "unknown", "abstraction").when(found, "evidence-backed-transition").otherwise("inferred-transition")


def labware_roles(slots: DataFrame) -> DataFrame:
    """Adds (role, problem) to (protocol, slot, labware): bases numbered in order of slots; tip racks have one role and may not repeat."""
    base = F.create_map(*[F.lit(v) for name, (_, _, b) in k.LABWARE.items() for v in (name, b)])
    y = slots.withColumn("base", F.try_element_at(base, F.col("labware")))
    n = F.row_number().over(Window.partitionBy("protocol", "base").orderBy("slot"))
    y = y.withColumn("n", n)
    tips = F.col("base").startswith("tiprack")
    problem = F.when(F.col("base").isNull(), "unknown labware").when(tips & (F.col("n") > 1), "duplicate tip rack")
    role = F.when(tips, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string")))
    return y.withColumn("problem", problem).withColumn("role", F.when(F.col("problem").isNull(), role)).drop("base", "n")


def parse_references(references: DataFrame, roles: DataFrame) -> DataFrame:
    """Adds (role, well, problem) to (protocol, ref) by the loaded roles (protocol, role, labware): ``role:well`` within the labware's rows and columns."""
    parts = F.split("ref", ":")
    formed = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    y = references.withColumn("role", F.when(formed, F.get(parts, F.lit(0)))).withColumn("well", F.when(formed, F.get(parts, F.lit(1))))
    j = y.join(roles.select("protocol", "role", "labware"), ["protocol", "role"], "left")
    size = lambda i: F.try_element_at(F.create_map(*[v for name, g in k.LABWARE.items() for v in (F.lit(name), F.lit(g[i]))]), F.col("labware"))
    shape = F.regexp_like("well", F.lit("^[A-Z][1-9][0-9]?$"))
    row, column = F.ascii("well") - 65, F.regexp_extract("well", "^[A-Z]([1-9][0-9]?)$", 1)
    outside = (row >= size(0)) | (F.try_to_number(column, F.lit("99")).cast("int") > size(1))
    problem = F.when(F.col("role").isNull(), "malformed").when(F.col("labware").isNull(), "role not loaded").when(~shape, "malformed well").when(outside, "outside")
    return j.withColumn("problem", problem).select("protocol", "ref", "role", "well", "problem")


def sbol_components(parts: DataFrame) -> DataFrame:
    """(doc, place, id, name, role, description) of genetic parts (doc, place, id, label, type, strength)."""
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for t, (r, _) in k.SBOL_ROLES.items() for v in (t, r)]), F.col("type")), F.lit("SO:0000110"))
    label = F.try_element_at(F.create_map(*[F.lit(v) for t, (_, n) in k.SBOL_ROLES.items() for v in (t, n)]), F.col("type"))
    strength = F.when(F.col("strength").isNotNull(), F.concat(F.lit("strength "), F.format_string("%.2f", F.col("strength")))).otherwise("default strength")
    return parts.select("doc", "place", "id", F.coalesce("label", "id").alias("name"), role.alias("role"), F.concat(F.coalesce(label, F.lit("Sequence Feature")), F.lit(" with "), strength).alias("description"))


def sbol_interactions(parts: DataFrame) -> DataFrame:
    """(doc, node, promoter, cds): genetic production within a node (doc, node, id, type), whose parts are few."""
    own = lambda kind, name: parts.where(F.col("type") == kind).select("doc", "node", F.col("id").alias(name))
    return own("promoter", "promoter").join(own("cds", "cds"), ["doc", "node"])


def sbol_issues(components: DataFrame) -> DataFrame:
    """(doc, place, issue) of components (doc, place, id, role): missing ids, unknown roles, parts before the one they should follow; VALID where there is none."""
    order = F.array_position(F.array(*[F.lit(r) for r, _ in k.SBOL_ROLES.values()]), F.col("role"))
    placed = components.withColumn("o", F.when(order > 0, order))
    before = F.last("o", ignorenulls=True).over(Window.partitionBy("doc").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    y = placed.withColumn("before", before)
    issues = F.filter(F.array(
        F.when(F.trim(F.coalesce("id", F.lit(""))) == "", "ERROR missing id"), F.when(~F.col("role").isin(*k.SBOL_VALID), "WARNING non-standard role"), F.when(F.col("o") < F.col("before"), "WARNING out of order"),
    ), lambda i: i.isNotNull())
    found = y.select("doc", "place", F.explode(issues).alias("issue"))
    fine = components.select("doc").distinct().join(found.select("doc").distinct(), "doc", "left_anti")
    return found.union(fine.select("doc", F.lit(None).cast(components.schema["place"].dataType).alias("place"), F.lit("VALID").alias("issue")))


def sbol_turtle(components: DataFrame, prefix: str) -> DataFrame:
    """(doc, turtle): a document's components as Turtle text; a document's parts are few."""
    q = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r'(["\\])', r"\\$1")
    one = F.concat(F.lit("<"), F.lit(prefix), "id", F.lit("> a sbol:Component ;\n  sbol:displayId \""), q(F.col("id")), F.lit("\" ;\n  dcterms:title \""), q(F.col("name")), F.lit("\" ;\n  sbol:role <"), "role", F.lit("> ."))
    lines = components.select("doc", F.struct("place", one.alias("t")).alias("s")).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]).alias("t"))
    return lines.select("doc", F.array_join("t", "\n").alias("turtle"))


def view_mode(requested: Column, available: Column) -> Column:
    """The requested view if it is there, else the first that is, else the table; ``available`` is a map from view to boolean."""
    there = lambda v: F.coalesce(F.try_element_at(available, v), F.lit(False))
    first = F.coalesce(*[F.when(there(F.lit(v)), v) for v in k.VIEW_ORDER], F.lit("table"))
    return F.when(there(requested), requested).otherwise(first)


def dataset_meta(artifacts: DataFrame, obs: DataFrame) -> DataFrame:
    """(artifact, name, samples, validity) of (artifact, file_name, sample_count, spatial) and its cells (artifact, sample): distinct samples that have a name."""
    n = obs.where("sample <> ''").groupBy("artifact").agg(F.count_distinct("sample").alias("n"))
    validity = F.when(F.col("file_name") == "bundled-demo.h5ad", "demo").when(~F.col("spatial"), "partial").otherwise("real")
    samples = F.coalesce("n", F.nullif("sample_count", F.lit(0)), F.lit(1))
    return artifacts.join(n, "artifact", "left").select("artifact", F.regexp_replace("file_name", r"(?i)\.h5ad$", "").alias("name"), samples.cast("long").alias("samples"), validity.alias("validity"))
