"""Small inputs with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from helixlake.functions import text
from helixlake.operators import agent, cells, commits, control, formulas, kinetics, lab, ledger, omics, state, trust


def test_gates_combine_repressed_levels(spark):
    r = kinetics.gate_response(spark.createDataFrame([(0.0, 0.0), (0.5, 1.0)], "a double, b double")).orderBy("a").collect()
    assert (r[0].and_gate, r[0].or_gate, r[0].nand_gate, r[0].not_gate) == (1.0, 1.0, 0.0, 0.2)
    assert r[0].and_noise == pytest.approx(1 - 0.25 / 0.2525) and r[0].or_noise == 0.0
    assert r[1].and_gate == pytest.approx(0.5 * 0.2) and r[1].not_gate == pytest.approx(0.25 / 0.5)


def test_mean_pair_distance_is_of_plain_distances(spark, monkeypatch):
    rows = [(1, "g", 0.0, 0.0), (2, "g", 3.0, 4.0), (3, "g", 0.0, 8.0), (4, "h", 1.0, 1.0)]
    points = spark.createDataFrame(rows, "cell int, cluster string, x double, y double")
    whole = cells.block_pairs
    for size in (2048, 1):
        monkeypatch.setattr(cells, "block_pairs", lambda r, by, key, size=size: whole(r, by, key, size))
        got = {r.cluster: (r.n_pairs, r.distance) for r in cells.mean_pair_distance(points, "cluster", "cell", ["x", "y"]).collect()}
        assert got == {"g": (3, pytest.approx(6.0)), "h": (0, 0.0)}


def test_silhouette_of_three_cells(spark):
    own = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [1.0]), (3, 1, [4.0])], "cell int, cluster int, v array<double>")
    r = lab.sampled_silhouette(own).first()
    assert r.n == 3 and r.silhouette == pytest.approx((0.75 + 2 / 3 + 1) / 3)
    assert lab.sampled_silhouette(own, 1).first().n == 1 and lab.sampled_silhouette(own.where("cluster = 1")).first().silhouette == 0.0


def test_perturbation_scales_by_discordance_and_impact(spark):
    rows = spark.createDataFrame([("A", 2.0, 4.0, 1.0, 0.0, 0.5), ("B", 2.0, 2.5, 1.0, 0.0, 0.5)], "gene string, transcript double, protein double, metabolite double, fold_change double, p_value double")
    changes = spark.createDataFrame([("A", 3.0), ("B", 0.0), ("C", 1.0)], "gene string, perturbed double")
    effects = spark.createDataFrame([("A", 0.9, ["X", "Y"])], "gene string, impact double, metabolites array<string>")
    got = {r.gene: r for r in omics.perturb(rows, changes, effects).collect()}
    assert (got["A"].scaling, got["A"].yield_change, got["A"].confidence) == (0.5, 3.6, 0.9)
    assert [tuple(s) for s in got["A"].shifts] == [("X", 0.34, "up"), ("Y", 0.34, "up")]
    assert (got["B"].scaling, got["B"].yield_change, got["B"].confidence, got["B"].shifts[0].direction) == (0.85, -5.1, 0.8, "down")
    assert (got["C"].yield_change, got["C"].confidence, got["C"].shifts) == (0.0, 0.0, [])


def test_fits_and_their_intervals_without_noise(spark):
    x = spark.createDataFrame([(i, "s", float(c), 90.0 * c / (12 + c)) for i, c in enumerate([1, 2, 5, 10, 20, 40, 80] * 6)], "i int, sample string, s double, rate double")
    fit, low = kinetics.fit_michaelis_menten(x.drop("i")).first(), kinetics.bootstrap_fit(x).first()
    assert (fit.vmax, fit.km, fit.r2) == pytest.approx((90.0, 12.0, 1.0), rel=1e-5)
    assert [low.vmax_low, low.vmax_high, low.km_low, low.km_high] == pytest.approx([90.0, 90.0, 12.0, 12.0], rel=1e-4)


@pytest.mark.parametrize("raw, strategy, json, reason", [
    ('{"a": 1}', "direct", '{"a": 1}', None), ('```json\n{"a": 1}\n```', "fenced", '{"a": 1}', None), ('so {"a": 1} then', "sliced", '{"a": 1}', None), ("{'a': 1,}", "repaired", '{"a": 1}', None),
    ("} {", None, None, "no-object"), ("{a: }", None, None, "invalid-syntax"), (" ", None, None, "empty"), ("none", None, None, "no-object"),
])
def test_json_salvage(spark, raw, strategy, json, reason):
    r = spark.createDataFrame([(raw,)], "raw string").select(text.salvage_json(F.col("raw")).alias("s")).first().s
    assert (r.strategy, r.json, r.reason) == (strategy, json, reason)


def test_freshness_compares_signatures(spark):
    tools = spark.createDataFrame([("a",), ("b",), ("c",)], "tool string")
    edges = spark.createDataFrame([("a", "b", 0)], "a string, b string, place int")
    projects = spark.createDataFrame([(1, "p"), (2, None)], "project int, project_ref string")
    runs = spark.createDataFrame([(1, "a", 1, 10, "F"), (1, "b", 2, 11, "F"), (1, "a", 3, 12, "F"), (2, "a", 1, 13, "F")], "project int, tool string, created int, revision int, status string")
    got = {(r.project, r.tool): (r.status, r.blocking) for r in ledger.freshness(ledger.upstreams(runs, projects, edges, tools), ledger.kept_with(runs, projects, edges)).collect()}
    assert got == {(1, "a"): ("fresh", []), (1, "b"): ("stale", ["a"]), (1, "c"): ("awaiting-upstream", []), (2, "a"): ("fresh", []), (2, "b"): ("awaiting-upstream", ["a"]), (2, "c"): ("not-run", [])}


STATUS = "project int, tool string, has_outputs boolean, missing array<string>, validity string, confidence double, uncertainty double, simulated boolean, run_status string"


def test_gates_and_decisions(spark):
    rows = [(1, "pathd", True, [], "partial", None, None, False, "ok"), (1, "fbasim", True, [], "demo", 1.0, None, False, "ok"), (2, "pathd", True, [], "real", None, None, True, "simulated"), (3, "pathd", False, ["x"], None, None, None, False, "ok")]
    evaluated = control.evaluate(spark.createDataFrame(rows, STATUS), control.contracts(spark))
    by = {(r.project, r.tool): r for r in evaluated.collect()}
    assert by[1, "fbasim"].codes == ["VALIDITY_BELOW_FLOOR"] and by[1, "fbasim"].reason == "validity demo below floor partial"
    assert by[3, "pathd"].codes == ["REQUIRED_OUTPUTS_MISSING", "VALIDITY_BELOW_FLOOR", "EVIDENCE_MISSING"]
    gates = {(r.project, r.tool): (r.status, r.blocking) for r in control.gate(evaluated, spark.createDataFrame([("fbasim", "pathd")], "tool string, up string")).collect()}
    assert gates == {(1, "pathd"): ("ok", []), (1, "fbasim"): ("gated", []), (2, "pathd"): ("demoOnly", []), (3, "pathd"): ("blocked", [])}
    projects = spark.createDataFrame([(1, "pathdReady"), (2, "targetSet"), (3, "pathdReady"), (4, "idle"), (5, "dbtlCommitted")], "project int, state string")
    none = spark.createDataFrame([], "project int, have int, have_kinds array<string>")
    got = {r.project: (r.status, r.tool, r.next, r.code) for r in control.decide(projects, evaluated, none).collect()}
    assert got == {
        1: ("ready", "fbasim", "fbasim", "CURRENT_TOOL_NOT_READY"), 2: ("demoOnly", "pathd", "pathd", "DEMO_ONLY"), 3: ("blocked", "fbasim", "pathd", "UPSTREAM_BLOCKED"), 4: ("idle", None, "pathd", "NO_TARGET"),
        5: ("complete", "dbtlflow", None, "DBTL_COMMITTED"),
    }


def test_evidence_gate_of_a_contract_that_asks_for_it(spark):
    table = control.contracts(spark).withColumn("gate_on_missing", F.lit(True))
    rows = control.evaluate(spark.createDataFrame([(1, "pathd", True, [], "real", None, None, False, "ok")], STATUS), table, control.evidence_coverage(spark.createDataFrame([(1, "literature"), (1, "rumour")], "project int, kind string")))
    r = rows.first()
    assert (r.have, r.missing_kinds, r.evidence_ok) == (2, ["analysis"], False)


def test_golden_prefix_stops_at_a_gap(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 3, True), (2, 1, True), (2, 2, True), (2, 3, False), (3, 2, True)], "project int, place int, ok boolean")
    assert {r.project: r.reached for r in trust.golden_prefix(rows).collect()} == {1: 1, 2: 2, 3: 0}


def test_state_versions_hold_together(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    states = lambda *rows: spark.createDataFrame(list(rows), "project int, revision long, actor string, at int, body string")
    runs = lambda *rows: spark.createDataFrame(list(rows), "project int, run string, tool string, at int")
    assert commits.last_version(spark, root) == 0 and state.read_table(spark, root, "state") is None
    assert state.write_states(root, states((1, 1, "a", 1, "x"), (2, 1, "a", 1, "y")), runs((1, "r1", "cellfree", 1), (2, "r2", "pathd", 1)), "sync", "first") == 1
    assert state.write_states(root, states((2, 2, "b", 2, "z")), runs((2, "r3", "dbtlflow", 2)), "sync", "second") == 2
    read = lambda t, *c: sorted(tuple(r) for r in state.read_table(spark, root, t).select(*c).collect())
    assert read("state", "project", "body") == [(1, "x"), (2, "z")]
    assert read("run_index", "project", "run") == [(1, "r1"), (2, "r3")]
    assert read("history", "project", "revision") == [(1, 1), (2, 1), (2, 2)]
    assert read("audit", "project", "detail") == [(1, "first"), (2, "first"), (2, "second")]


def test_drain_thermodynamics_and_routes(spark):
    e = spark.createDataFrame([("e", "MCAA", 10.0, 1.0)], "id string, seq string, kcat double, flux double")
    r = formulas.metabolic_drain(e).first()
    assert (r.atp_cost, r.nadph_cost, r.level, r.viable, r.advice) == (20, 8, float(-(-(15e-15 * 6.022e23 / 3600) // 10)), True, "low")
    d = spark.range(1).select(formulas.delta_g(F.lit(-10.0), F.lit(300.0), F.array(F.lit(2.0)), F.array(F.lit(1.0))).alias("d"), formulas.delta_g(F.lit(1.0), F.lit(300.0), F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z")).first()
    assert d.d == pytest.approx(-10 + 8.314e-3 * 300 * 0.693147, rel=1e-5) and d.z == pytest.approx(1 + 8.314e-3 * 300 * -23.02585, rel=1e-5)
    q = spark.createDataFrame([("Design a pathway for artemisinic acid.", None), ("pathway design please", None), ("run fba for yeast yield", None), ("pathway design and fba", "x")], "request string, target string")
    assert [(r.reason, r.product, r.species, r.objective) for r in agent.route(q).collect()] == [("pathd", "artemisinic acid", None, None), ("no-product", None, None, None), ("fbasim", None, "yeast", "product"), ("both", None, None, None)]


def test_answers_split_into_sections_and_sentences(spark):
    a = spark.createDataFrame([(1, "skip\n# Summary\nOne\ntwo\n\nthree\n- dot\nNext steps:\n* go")], "id int, text string")
    assert [(r.section, r.kind, r.entry) for r in agent.sections(a).orderBy("place").collect()] == [("summary", "paragraph", "One two"), ("summary", "bullet", "dot"), ("summary", "paragraph", "three"), ("next-steps", "bullet", "go")]
    s = agent.sentences(spark.createDataFrame([(1, "One here. Two 3.5 there! 4 more.\n\nNew one")], "id int, text string")).collect()
    assert [(r.paragraph, r.sentence) for r in s] == [(0, "One here."), (0, "Two 3.5 there!"), (0, "4 more."), (1, "New one")]


def test_products_that_requests_name(spark):
    want = {
        "make of (x), a design for beta-carotene? yes": "beta-carotene", "I need it for amorphadiene  biosynthesis today": "amorphadiene", "Redesign to be": None, "production of 5'-methyl x": "5'-methyl x", "for a pathway": None, "route to ab": None,
        "PRODUCE TO Vanillin": "Vanillin", "pathway for " + "a" * 60: None, "for taxol pathway and its pathway": "taxol pathway and its", "": None, "for": None,
    }
    rows = spark.createDataFrame([(q,) for q in want], "q string").select("q", agent.product_name(F.col("q")).alias("p"))
    assert {r.q: r.p for r in rows.collect()} == want


def test_energy_of_products_without_reactants_is_infinite(spark):
    rows = spark.createDataFrame([(1.0, [2.0], [0.0]), (1.0, [0.0], [0.0]), (1.0, [0.0], [2.0]), (1.0, [2.0], []), (1.0, [2.0, 3.0], [6.0])], "g double, p array<double>, r array<double>")
    got = [x.e for x in rows.select(formulas.delta_g(F.col("g"), F.lit(300.0), F.col("p"), F.col("r")).alias("e")).collect()]
    low = 1 + 8.314e-3 * 300 * -23.025850929940457
    assert got == [float("inf"), pytest.approx(low), pytest.approx(low), pytest.approx(1 + 8.314e-3 * 300 * 0.6931471805599453), pytest.approx(1.0)]


def test_evidence_is_that_of_all_words(spark):
    import random

    from helixlake.operators import literature

    r = random.Random(5)
    often, words = [f"the{i}" for i in range(6)], [f"w{i}" for i in range(80)]
    texts = [(i, " ".join(r.sample(often, r.randint(2, 6)) + r.sample(words, r.randint(0, 6)))) for i in range(150)]
    queries = [(q, r.sample(often, r.randint(0, 6)) + r.sample(words, r.randint(0, 4))) for q in range(30)] + [(90, ["none"]), (91, [])]
    want = set()
    for q, own in queries:
        scored = sorted((-len(set(own) & set(t.split())), i) for i, t in texts if set(own) & set(t.split()))
        want |= {(q, i, -s, n) for n, (s, i) in enumerate(scored[:5], 1)}
    got = literature.evidence_for(spark.createDataFrame(queries, "query int, words array<string>"), spark.createDataFrame(texts, "id int, text string"))
    assert {(x.query, x.id, x.score, x["rank"]) for x in got.collect()} == want


def test_expression_neighbours_of_asked_blocks(spark):
    import numpy as np

    from helixlake.operators import spatial

    x = np.random.default_rng(3).normal(size=(300, 4))
    x[:150] = x[0] + np.random.default_rng(4).normal(size=(150, 4)) * 1e-3
    cells_ = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell long, v array<double>")
    want = set()
    for i in range(300):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        want |= {(i, int(j)) for j in np.lexsort((np.arange(300), d))[:5]}
    assert {(r.i, r.j) for r in spatial.expression_knn(cells_, 5, block=2).collect()} == want


def test_neighbours_in_gene_space_send_a_cell_a_bounded_number_of_times(spark):
    import numpy as np

    from helixlake.operators import spatial

    x = np.random.default_rng(5).normal(size=(2000, 64))
    x[7] = x[9]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell long, v array<double>")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = {(r.i, r["rank"]): r.j for r in spatial.expression_knn(table, 15, block=64).collect()}
    assert (written() - before) / len(x) < 20 * 64 * 8  # 8 blocks on each side
    for i in range(0, 2000, 97):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [got[i, r + 1] for r in range(15)] == np.lexsort((np.arange(2000), d))[:15].tolist()
