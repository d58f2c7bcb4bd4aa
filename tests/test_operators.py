"""Operators without a registered query or without SQL, on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.functions import mathx as m
from helixlake.functions import sequence as s
from helixlake.functions import text as x
from helixlake.operators import assay, cells, evolution, flux, kinetics, ledger, spatial
from helixlake.session import cut
from helixlake.sources import records


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_rounding_is_half_up(spark):
    assert [one(spark, m.js_round(F.lit(v))) for v in (-2.5, 2.5, 0.49)] == [-2.0, 3.0, 0.0]
    assert one(spark, m.ratio(F.lit(1.0), F.lit(0.0), 7.0)) == 7.0
    assert math.isclose(one(spark, m.normal_cdf(F.lit(1.96))), 0.975, abs_tol=1e-4)


def test_assay_file(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿Sample ID,Yield_mg_L,OD600,Note\r\ns1,12%,0.5,"a ""b"", c"\r\ns2,NA,1,\r\ns3,7.5,nan,x\r\n', encoding="utf-8")
    rows = {r.sample_id: r for r in assay.read_assay(spark, str(path)).collect()}
    assert set(rows) == {"s1", "s3"} and rows["s1"]["yield"] == 12 and rows["s3"].biomass is None and rows["s1"].substrate is None
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        assay.read_assay(spark, str(tmp_path / "b.csv"))


def test_neighbours_in_one_place_and_far_away(spark):
    rows = [(i, 0.0, 0.0) for i in range(30)] + [(100 + i, float(i), 0.5 * i) for i in range(40)] + [(500, 1e5, 1e5)]
    got = {}
    for r in spatial.knn(spark.createDataFrame(rows, "cell long, x double, y double"), 3).collect():
        got.setdefault(r.i, []).append((r["rank"], r.j))
    for i, px, py in rows:
        want = sorted((math.hypot(px - qx, py - qy), j) for j, qx, qy in rows if j != i)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]
    assert spatial.knn(spark.createDataFrame([], "cell long, x double, y double")).count() == 0


def test_linear_program_against_its_closed_form():
    from helixlake.sources import constants as k

    names = [n for n, _, _ in k.ECOLI_REACTIONS]
    balances = np.array([[b.get(n, 0.0) for n in names] for b in k.ECOLI_BALANCES], float)
    for objective, weights in k.ECOLI_OBJECTIVES.items():
        for glucose, oxygen in ((0, 5), (3, 20), (10, 4.5), (25, 25)):
            upper = np.array([{"GLCpts": glucose, "O2tx": oxygen}.get(n, u) for n, _, u in k.ECOLI_REACTIONS], float)
            flow = flux.maximize(np.array([weights.get(n, 0.0) for n in names]), balances, upper)
            assert abs(balances @ flow).max() < 1e-9 and (flow <= upper + 1e-9).all() and (flow >= -1e-9).all()
            assert math.isclose(flow[names.index("PDH")], min(2 * glucose, oxygen), abs_tol=1e-9)


def test_fit_finds_the_constants(spark):
    rows = [(1, float(c), 9.0 * c / (c + 4.0)) for c in (1, 2, 4, 8, 16, 32)]
    r = kinetics.fit_michaelis_menten(spark.createDataFrame(rows, "sample long, s double, rate double")).first()
    assert math.isclose(r.vmax, 9, rel_tol=1e-6) and math.isclose(r.km, 4, rel_tol=1e-6) and r.r2 > 0.999999


def test_bioreactor_stays_within_bounds(spark):
    runs = spark.createDataFrame([(i, 0.1 * i, 2.0, 0.5, 0.1) for i in range(1, 6)], "run long, setpoint double, kp double, ki double, kd double")
    c = kinetics.bioreactor(runs).toPandas()
    assert len(c) == 500 and (c[["biomass", "substrate", "product", "oxygen", "fpp"]] >= 0).all().all() and (c.enzyme <= 2).all()


def test_communities_and_hulls(spark):
    cliques = [(1, a, b) for g in (0, 10) for a in range(g, g + 5) for b in range(g, g + 5) if a != b] + [(2, 0, 1)]
    out = cells.communities(spark.createDataFrame(cliques, "dataset long, i long, j long")).collect()
    got = {(r.dataset, r.node): r.community for r in out}
    assert len(got) == len(out) == 12 and not {got[1, i] for i in range(5)} & {got[1, i] for i in range(10, 15)}
    assert max(got[1, i] for i in range(5)) < 4 and got[2, 0] == got[2, 1]
    points = [(1, float(a), float(b)) for a in range(5) for b in range(5)]
    assert [(r.x, r.y) for r in cells.hulls(spark.createDataFrame(points, "g long, x double, y double"), "g").orderBy("place").collect()] == [(0, 0), (4, 0), (4, 4), (0, 4)]


def test_pseudotime_walks_from_the_largest_cluster(spark):
    sizes = spark.createDataFrame([(0, 5), (1, 9), (2, 1), (3, 1)], "cluster int, size long")
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.05), (0, 2, 0.3)], "a int, b int, weight double")
    t = {r.cluster: r.pseudotime for r in spatial.pseudotime(sizes, edges).collect()}
    assert t[1] == 0 and math.isclose(t[0], 0.5 / 4) and math.isclose(t[2], 1.2 / 4) and t[3] == 1


def test_empty_campaign_and_single_replicate(spark):
    none = spark.createDataFrame([], "variant string, family string, round int, replicate int, reads long")
    assert evolution.diversity_curve(none).count() == 0
    single = spark.createDataFrame([("a", "a", 0, 0, 3), ("b", "b", 0, 0, 1)], none.schema)
    r = {x.variant: x for x in evolution.variant_frequency(single).collect()}
    assert r["a"].freq_sem == 0 and math.isclose(r["a"].freq_mean, 4 / 6) and r["a"].replicates == 1


def test_text_helpers(spark):
    assert one(spark, x.clean_prompt(F.lit("a\x00b\r\nc"), 3)) == ("ab\n", True)
    assert one(spark, x.year_of(F.lit("J. Biol. (2019) 4"))) == 2019
    assert one(spark, x.first_rule(F.lit("request timed out"), x.ERROR_RULES, "other")) == "timeout"
    assert one(spark, x.unique_strings(F.array(F.lit(" a"), F.lit(""), F.lit("a")))) == ["a"]
    assert one(spark, s.identity(F.lit("ACGT"), F.lit("ACGA"))) == 0.75
    assert one(spark, s.mispriming(F.lit("ACGTA"), F.lit("ACGTATTTTTTTTTTTTTTTTTTTACGTA"), F.lit(0), F.lit(5))) is True


def test_records(spark, tmp_path):
    assert records.alias_column(["A", "Leiden", "leiden"], ["louvain", "LEIDEN"]) == "Leiden"
    t = spark.createDataFrame([("a1", 1)], "artifact_id string, n int")
    records.save_artifact({"obs": t}, str(tmp_path / "art"))
    records.save_artifact({"obs": t.withColumn("artifact_id", F.lit("a2"))}, str(tmp_path / "art"))
    assert spark.read.parquet(str(tmp_path / "art" / "obs")).count() == 2
    assert records.add_missing(t, {"n": 5, "k": 7}).first().k == 7


def test_ledger_restore_and_conflicts(spark):
    tasks = spark.createDataFrame([("a", "running"), ("b", "done")], "task string, status string")
    assert {r.task: r.status for r in ledger.restore_queue(tasks).collect()} == {"a": "error", "b": "done"}
    assert cut(tasks).count() == 2


def test_fluxes_are_the_same_without_shadow_prices_and_spread_over_tasks(spark):
    rows = spark.createDataFrame([(i, 2.0 + i, 9.0 - i) for i in range(6)], "scenario long, glucose double, oxygen double").coalesce(1)
    own = ["scenario", "growth", "biomass", "product", "atp_yield", "carbon_efficiency", "feasible"]
    plain = flux.solve(rows, "product", prices=False)
    assert sorted(plain.select(own).collect()) == sorted(flux.solve(rows, "product").select(own).collect())
    assert plain.where("shadow_glucose IS NOT NULL OR shadow_oxygen IS NOT NULL").isEmpty()
    assert plain.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_motifs_count_designs_without_holding_their_ids(spark):
    rows = [(1, "AAAAAC"), (2, "AAAAAD"), (2, "CAAAAA"), (2, "AAAAAD")]
    n = spark.createDataFrame(rows[:2], "id long, seq string")
    assert [tuple(r) for r in s.consensus_motifs(n).collect()] == [(1, "AAAAA")]
    assert s.consensus_motifs(spark.createDataFrame(rows, "id long, seq string")).isEmpty()  # rows are counted, designs are two
    assert "count(distinct" not in s.consensus_motifs(n)._jdf.queryExecution().analyzed().toString().lower()
