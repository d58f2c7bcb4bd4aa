"""Flux, kinetics, design and streaming queries."""

from pyspark.sql import functions as F

from helixlake.operators import design, flux, kinetics
from helixlake.plans.registry import query
from helixlake.plans.tools import r, rounded, values
from helixlake.sources import constants as k
from helixlake.sources import views as v
from helixlake.streaming import streams

_PDH = "least(least(greatest(glucose, 0.0), 25.0) * 2, least(greatest(oxygen, 0.0), 25.0))"
_CARBON = "CASE WHEN pdh > 1e-9 THEN least(greatest({c} * pdh * 100 / (pdh / 2 * 6), 0.0), 100.0) ELSE 0.0 END"


def _fba(carbon: float, biomass: str, product: str) -> str:
    return f"""WITH {v.UPTAKE}, p AS (SELECT scenario, {_PDH} AS pdh FROM uptake) SELECT scenario, {r(f'{biomass} * 0.061', 'growth', 4)}, {r(biomass, 'biomass', 4)}, {r(product, 'product', 4)}, {r(_CARBON.format(c=carbon), 'carbon_efficiency', 1)}, pdh > 1e-6 AS feasible FROM p"""


@query(_fba(4.6, "pdh", "0.0"))
def fba_ecoli_lp(spark, sf_dir):
    return flux.solve(v.uptake(spark, sf_dir), prices=False).select("scenario", "growth", "biomass", "product", "carbon_efficiency", "feasible")


@query(_fba(6.0, "0.0", "pdh"))
def fba_product_lp(spark, sf_dir):
    return flux.solve(v.uptake(spark, sf_dir), "product", prices=False).select("scenario", "growth", "biomass", "product", "carbon_efficiency", "feasible")


@query(_fba(4.6, "pdh", "0.0"))
def fba_closed_form(spark, sf_dir):
    return flux.closed_form(v.uptake(spark, sf_dir))


@query(f"WITH {v.UPTAKE} SELECT scenario, 0.0::DOUBLE AS growth, false AS feasible FROM uptake")
def fba_knockout(spark, sf_dir):
    return flux.solve(v.uptake(spark, sf_dir), knockouts=("PFK",), prices=False).select("scenario", "growth", "feasible")


def _growth(g: str, o: str) -> str:
    return f"(floor(least(least(greatest({g}, 0.0), 25.0) * 2, least(greatest({o}, 0.0), 25.0)) * 0.061 * 10000 + 0.5) / 10000)"


@query(f"""WITH {v.UPTAKE}, e AS (SELECT *, greatest(0.05, glucose * 0.01) AS e FROM uptake) SELECT scenario, {r(f"({_growth('glucose + e', 'oxygen')} - {_growth('glucose - e', 'oxygen')}) / (2 * e)", 'shadow_glucose', 2)},
{r(f"({_growth('glucose', 'oxygen + e')} - {_growth('glucose', 'oxygen - e')}) / (2 * e)", 'shadow_oxygen', 2)} FROM e""")
def fba_shadow_prices(spark, sf_dir):
    return rounded(flux.solve(v.uptake(spark, sf_dir)).select("scenario", "shadow_glucose", "shadow_oxygen"), digits=2)


@query("SELECT l_shipmode_ AS subsystem, floor(sum(abs(f)) * 100 + 0.5) / 100 AS total, arg_max(reaction, (abs(f), -reaction)) AS largest FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_, l_orderkey * 10 + l_linenumber AS reaction, l_quantity - 25 AS f FROM lineitem) GROUP BY 1")
def subsystem_fluxes(spark, sf_dir):
    x = v.table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("subsystem"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("reaction"), (F.col("l_quantity") - 25).alias("flux"))
    return flux.subsystem_sums(x)


_STEPS = values("steps", "pathway, place, step, dg, atp", k.THERMO_STEPS)


@query(f"WITH {_STEPS} SELECT pathway, place, step, {r('dg', digits=2)}, atp, {r('sum(dg) OVER (PARTITION BY pathway ORDER BY place)', 'cumulative', 2)} FROM steps")
def thermo_waterfall(spark, sf_dir):
    return rounded(flux.waterfall(flux.thermo_steps(spark)), digits=2)


@query(f"WITH {_STEPS} SELECT pathway, {r('sum(dg)', 'dg', 2)}, sum(atp)::BIGINT AS atp, {r('least(greatest(-sum(dg) / 2870, 0.0), 1.0)', 'efficiency')}, {r('-sum(dg) / 298.15', 'entropy')}, arg_max(step, (dg, -place)) AS limiting FROM steps GROUP BY pathway")
def thermo_totals(spark, sf_dir):
    return rounded(rounded(flux.thermo_totals(flux.thermo_steps(spark)), "efficiency", "entropy"), "dg", digits=2)


@query(f"WITH {_STEPS} SELECT pathway, place, step, dg::DOUBLE AS dg, atp FROM (SELECT *, row_number() OVER (PARTITION BY pathway ORDER BY place) AS n FROM steps WHERE dg > 0) WHERE n <= 4")
def thermo_concerns(spark, sf_dir):
    return flux.concerns(flux.thermo_steps(spark))


@query(f"""SELECT l_orderkey, l_linenumber, {r('(l_extendedprice * l_quantity) / (CASE WHEN l_discount <> 0 AND l_tax <> 0 THEN 10 * (1 + l_tax / l_discount) ELSE 10 END + l_quantity)', 'velocity', 4)} FROM lineitem""")
def mm_velocity(spark, sf_dir):
    x = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("s"), F.col("l_extendedprice").alias("vmax"), F.lit(10.0).alias("km"), F.col("l_discount").alias("ki"), F.col("l_tax").alias("i"))
    return rounded(kinetics.velocities(x).select("l_orderkey", "l_linenumber", "velocity"), digits=4)


_V = "(vmax * greatest({s}, 0.0) / (km + greatest({s}, 0.0)))"


def _v(s: str) -> str:
    return _V.format(s=f"({s})")


_RUN = "run AS (SELECT n_nationkey AS run, 5.0 + n_nationkey AS s0, 0.0 AS p0, 1.0 + n_nationkey / 10.0 AS vmax, 2.0 AS km, 0.05 AS d, 0.02 AS g, 0.5 AS dt FROM nation)"


@query(f"""WITH RECURSIVE {_RUN}, c(run, step, s, p, vmax, km, d, g, dt) AS (SELECT run, 0, s0::DOUBLE, p0::DOUBLE, vmax::DOUBLE, km::DOUBLE, d::DOUBLE, g::DOUBLE, dt::DOUBLE FROM run UNION ALL
SELECT run, step + 1, greatest(0.0, s + dt / 6 * (k1 + 2 * k2 + 2 * k3 + d - {_v('s + dt * k3')})), greatest(0.0, p + dt / 6 * (q1 + 2 * q2 + 2 * q3 + made - g * (p + dt * q3))), vmax, km, d, g, dt FROM (SELECT *, d - {_v('s + dt * k2 / 2')} AS k3, made - g * (p + dt * q2 / 2) AS q3 FROM
 (SELECT *, d - {_v('s + dt * k1 / 2')} AS k2, made - g * (p + dt * q1 / 2) AS q2 FROM (SELECT *, d - {_v('s')} AS k1, {_v('s')} AS made, {_v('s')} - g * p AS q1 FROM c WHERE step < 20))))
SELECT run, step, {r('s', 'substrate')}, {r('p', 'product')} FROM c""")
def rk4_enzyme(spark, sf_dir):
    n = F.col("n_nationkey")
    x = v.table(spark, sf_dir, "nation").select(n.alias("run"), (5.0 + n).alias("s0"), F.lit(0.0).alias("p0"), (1.0 + n / 10.0).alias("vmax"), F.lit(2.0).alias("km"), F.lit(0.05).alias("formation"), F.lit(0.02).alias("degradation"), F.lit(10.0).alias("duration"))
    return rounded(kinetics.enzyme_course(x, 20))


def _courses(spark, sf_dir):
    n = F.col("n_nationkey")
    return kinetics.bioreactor(v.table(spark, sf_dir, "nation").select(n.alias("run"), (0.2 + n / 50.0).alias("setpoint"), F.lit(2.0).alias("kp"), F.lit(0.5).alias("ki"), F.lit(0.1).alias("kd")))


@query()
def bioreactor_course(spark, sf_dir):
    return _courses(spark, sf_dir)


@query()
def bioreactor_burden(spark, sf_dir):
    return kinetics.burden(_courses(spark, sf_dir))


@query(f"""WITH {v.SIGNALS}, x AS (SELECT run, step, value, value - 10 AS e, lag(value - 10) OVER (PARTITION BY run ORDER BY step) AS before, count(*) OVER (PARTITION BY run) AS n FROM signals),
g AS (SELECT run, max(n) AS n, max(step) FILTER (abs(e) > 0.5) AS last_off, max(value) AS top, abs(avg(e) FILTER (step > n - greatest(5, floor(n * 0.1)))) AS steady, count(*) FILTER (e * before < 0) AS crossings, sqrt(avg(e * e)) AS rmse FROM x GROUP BY run),
o AS (SELECT run, ln(abs(e) + 1e-10) AS y, row_number() OVER (PARTITION BY run ORDER BY step) AS k, count(*) OVER (PARTITION BY run) AS many FROM x WHERE abs(e) > 0.001), d AS (SELECT run, -regr_slope(y, k::DOUBLE) AS rate FROM o WHERE many > 10 AND k <= floor(many * 0.5) GROUP BY run)
SELECT run, CASE WHEN n < 5 THEN NULL WHEN last_off IS NULL THEN n ELSE least(last_off + 1, n) END AS settling, {r('CASE WHEN n >= 5 AND top > 10 THEN (top - 10) / 10 * 100 ELSE 0.0 END', 'overshoot', 1)}, {r('CASE WHEN n < 5 THEN 0.0 ELSE steady END', 'steady_error', 3)},
 {r('CASE WHEN n < 5 THEN 0.0 ELSE coalesce(rate, 0.0) END', 'convergence_rate', 3)}, CASE WHEN n < 5 THEN 0 ELSE crossings END AS crossings, {r('rmse', digits=4)}, n >= 5 AND steady < 0.08 AND crossings < n * 0.2 AS stable FROM g LEFT JOIN d USING (run)""")
def do_convergence(spark, sf_dir):
    return kinetics.convergence(v.signals(spark, sf_dir), 10.0)


@query(f"""WITH {v.SIGNALS}, x AS (SELECT run, step, coalesce(abs(value - lag(value) OVER w) / greatest(abs(lag(value) OVER w), 1e-9) < 0.6, false) AS calm FROM signals WINDOW w AS (PARTITION BY run ORDER BY step)),
y AS (SELECT *, sum((NOT calm)::INTEGER) OVER (PARTITION BY run ORDER BY step) AS island FROM x) SELECT run, min(step) AS start, count(*) AS length FROM y WHERE calm GROUP BY run, island HAVING count(*) >= 2""")
def equilibrium_runs(spark, sf_dir):
    return kinetics.equilibrium_runs(v.signals(spark, sf_dir), 0.6, 2)


_GATES = {"and": "{x} * {y}", "or": "{x} + {y} - {x} * {y}", "nand": "1 - {x} * {y}", "not": "0.25 / (0.25 + ({x}) * ({x}))"}


def _noise(f: str) -> str:
    at = lambda x, y: f"({f.format(x=x, y=y)})"
    return f"greatest(abs({at('x2', 'y')} - {at('x', 'y')}), abs({at('x', 'y2')} - {at('x', 'y')}))"


@query(f"""WITH g AS (SELECT a / 10.0 AS a, b / 10.0 AS b FROM range(0, 11) x(a), range(0, 11) y(b)), h AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b, 0.25 / (0.25 + a * a) AS x, 0.25 / (0.25 + b * b) AS y, 0.25 / (0.25 + power(least(1.0, a + 0.05), 2)) AS x2, 0.25 / (0.25 + power(least(1.0, b + 0.05), 2)) AS y2 FROM g)
SELECT a, b, {', '.join(r(f.format(x='x', y='y'), f'{n}_gate') for n, f in _GATES.items())}, {', '.join(r(_noise(f), f'{n}_noise') for n, f in _GATES.items())} FROM h""")
def gate_response(spark, sf_dir):
    g = spark.range(11).select((F.col("id") / 10.0).alias("a"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda b: b / 10.0)).alias("b"))
    return rounded(kinetics.gate_response(g), *(f"{n}_{kind}" for n in _GATES for kind in ("gate", "noise")))


def _readings(spark, sf_dir):
    return v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 20).alias("sample"), F.col("l_quantity").alias("s"), (F.col("l_quantity") * 90 / (F.col("l_quantity") + 12) + F.col("l_discount")).alias("rate"))


@query()
def enzyme_fit(spark, sf_dir):
    return rounded(kinetics.fit_michaelis_menten(_readings(spark, sf_dir).select("sample", "s", "rate")), digits=4)


@query()
def bootstrap_fit(spark, sf_dir):
    return rounded(kinetics.bootstrap_fit(_readings(spark, sf_dir)), digits=4)


_TARGETS = values("targets", "gene, essential, efficiency, growth_impact", design.KNOCKDOWN_TARGETS)
_SCHEDULE = f"WITH {_TARGETS}, s AS (SELECT *, efficiency + (1 + growth_impact) * 0.3 AS score FROM targets WHERE efficiency >= 0.8 AND NOT essential ORDER BY score DESC, gene LIMIT 8)"


@query(f"{_SCHEDULE} SELECT gene, essential, efficiency::DOUBLE AS efficiency, growth_impact::DOUBLE AS growth_impact, {r('score')} FROM s")
def knockdown_schedule(spark, sf_dir):
    return rounded(design.knockdown_schedule(design.knockdown_targets(spark), 8, 0.8), "score")


@query(f"{_SCHEDULE} SELECT count(*) AS n, {r('sum(growth_impact)', 'growth')}, {r('avg(efficiency)', 'efficiency')}, {r('avg((efficiency < 0.8)::INTEGER)', 'low_share')} FROM s")
def knockdown_metrics(spark, sf_dir):
    return rounded(design.schedule_metrics(design.knockdown_schedule(design.knockdown_targets(spark), 8, 0.8)))


_DOMINATED = "EXISTS (SELECT 1 FROM {t} q WHERE q.family = p.family AND q.activity >= p.activity AND q.stability >= p.stability AND q.burden <= p.burden AND (q.activity > p.activity OR q.stability > p.stability OR q.burden < p.burden))"


def _goals(spark, sf_dir):
    return v.variants(spark, sf_dir).withColumn("lightness", -F.col("burden").cast("double"))


@query(f"WITH {v.VARIANTS} SELECT variant, family, activity::DOUBLE AS activity, {r('stability')}, -burden::DOUBLE AS lightness FROM variants p WHERE NOT {_DOMINATED.format(t='variants')}")
def pareto_front(spark, sf_dir):
    return rounded(design.pareto_front(_goals(spark, sf_dir), ["activity", "stability", "lightness"], "family", "variant"), "stability")


@query(f"""WITH {v.VARIANTS}, f0 AS (SELECT * FROM variants p WHERE NOT {_DOMINATED.format(t='variants')}), r1 AS (SELECT * FROM variants WHERE variant NOT IN (SELECT variant FROM f0)), f1 AS (SELECT * FROM r1 p WHERE NOT {_DOMINATED.format(t='r1')})
SELECT variant, 0 AS rank FROM f0 UNION ALL SELECT variant, 1 FROM f1""")
def pareto_ranks(spark, sf_dir):
    return design.pareto_ranks(_goals(spark, sf_dir), ["activity", "stability", "lightness"], "family", "variant", 2).select("variant", "rank")


_SCORED = f"""{v.VARIANTS}, m AS (SELECT variant, family, activity, stability, (variant * 37 % 100)::DOUBLE AS expression, (variant * 53 % 100)::DOUBLE AS specificity, burden, variant % 3 AS risk FROM variants),
scored AS (SELECT *, least(greatest(floor((activity * 0.38 + stability * 0.24 + expression * 0.14 + specificity * 0.12 - burden * 3.7 - risk * 4.4) * 100 + 0.5) / 100, 0.0), 100.0) AS composite FROM m)"""


def _scored(spark, sf_dir):
    n = F.col("variant")
    x = v.variants(spark, sf_dir).withColumns({"expression": (n * 37 % 100).cast("double"), "specificity": (n * 53 % 100).cast("double"), "risk": n % 3})
    return design.variant_scores(x, design.WEIGHTS)


@query(f"""WITH {_SCORED} SELECT variant, {r('composite', digits=1)}, list_filter([CASE WHEN stability < 46 THEN 'stability floor' END, CASE WHEN expression < 48 THEN 'expression drag' END, CASE WHEN burden >= 4 THEN 'mutation burden' END, CASE WHEN stability < 42 AND burden >= 3 THEN 'aggregation risk' END], lambda x: x IS NOT NULL) AS flags FROM scored""")
def variant_score(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("variant", "composite", "flags"), "composite", digits=1)


@query(f"""WITH {_SCORED}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY composite DESC, stability DESC, variant) AS k FROM scored WHERE stability >= 49) WHERE k = 1), f AS (SELECT * FROM b ORDER BY composite DESC, stability DESC, variant LIMIT 3),
e AS (SELECT min(composite) AS edge FROM (SELECT composite FROM scored ORDER BY composite DESC, stability DESC, variant LIMIT 8)), q AS (SELECT s.* FROM scored s, e WHERE s.variant NOT IN (SELECT variant FROM f) AND (stability >= 52 OR composite >= edge + 2) ORDER BY composite DESC, stability DESC, variant LIMIT 8)
SELECT variant, pass FROM (SELECT variant, 1 AS pass, composite, stability FROM f UNION ALL SELECT variant, 2, composite, stability FROM q) ORDER BY pass, composite DESC, stability DESC, variant LIMIT 8""")
def survivor_selection(spark, sf_dir):
    return design.survivors(_scored(spark, sf_dir), 8, 0.5).select("variant", "pass")


_RBS = values("rbs", "gain, part, strength", design.RBS)
_GAIN = "least(greatest(glucose / 5 / 10 * 0.5 + oxygen / 10 / 5 * 0.3 + glucose / 20 / 2 * 0.2, 0.0), 1.0)"


@query(f"WITH {v.UPTAKE}, {_RBS}, g AS (SELECT scenario, {_GAIN} AS own FROM uptake), d AS (SELECT scenario, own, part, strength, row_number() OVER (PARTITION BY scenario ORDER BY abs(gain::DOUBLE - own), gain) AS n FROM g, rbs) SELECT scenario, {r('own', 'gain', 3)}, part, strength::DOUBLE AS strength FROM d WHERE n = 1")
def rbs_nearest(spark, sf_dir):
    g, o = F.col("glucose"), F.col("oxygen")
    return design.rbs_nearest(v.uptake(spark, sf_dir), design.combined_gain(g / 5, o / 10, g / 20)).select("scenario", "gain", "part", "strength")


_BUMP = "{h} * exp(-(power(i / 19.0 - {x}, 2) + power(j / 19.0 - {y}, 2)) / (2 * {s} * {s}))"


@query(f"SELECT i::INTEGER AS i, j::INTEGER AS j, {r(' + '.join(_BUMP.format(h=h, x=x, y=y, s=s) for x, y, s, h in ((0.3, 0.3, 0.15, 0.6), (0.7, 0.6, 0.2, 1.0), (0.2, 0.8, 0.1, 0.4))) + ' + 0.05 * sin(i / 19.0 * 12) * cos(j / 19.0 * 12)', 'fitness')} FROM range(0, 20) a(i), range(0, 20) b(j)")
def fitness_landscape(spark, sf_dir):
    return rounded(design.landscape(spark), "fitness")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return rounded(streams.drain(streams.tumbling(streams.table_stream(spark, f"{sf_dir}/events.parquet"), "1 day"), "complete"), digits=2).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH x AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL '6 hours', true)::INTEGER AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM y GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    out = streams.drain(streams.sessions(streams.table_stream(spark, f"{sf_dir}/events.parquet"), "6 hours"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT event_id, event_type, ts FROM events")
def stream_merged(spark, sf_dir):
    a, b = (streams.table_stream(spark, f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts") for _ in range(2))
    return streams.drain(streams.merged(a, b, key="event_id")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT user_id AS run, event_id AS step, 100 + value / 40 AS value FROM events), x AS (SELECT run, step, coalesce(abs(value - lag(value) OVER w) / greatest(abs(lag(value) OVER w), 1e-9) < 0.005, false) AS calm FROM s WINDOW w AS (PARTITION BY run ORDER BY step)),
y AS (SELECT *, sum((NOT calm)::INTEGER) OVER (PARTITION BY run ORDER BY step) AS island FROM x), z AS (SELECT run, step, row_number() OVER (PARTITION BY run, island ORDER BY step) AS length FROM y WHERE calm) SELECT run, step, length FROM z WHERE length = 3""")
def stream_equilibria(spark, sf_dir):
    t = streams.table_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), (100 + F.col("value") / 40).alias("value"))
    return streams.drain(streams.equilibria(t, 0.005, 3))


_MOVES = values("moves", "state, event, next_state", streams.MOVES)


@query(f"""WITH RECURSIVE {_MOVES}, ev AS (SELECT user_id AS project, event_id AS seq, ['start', 'pass', 'fail', 'loop', 'finish'][event_id % 5 + 1] AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f(project, n, seq, event, state, iteration, moved) AS (SELECT DISTINCT project, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 'idle', 1::BIGINT, false FROM ev
 UNION ALL SELECT f.project, ev.n, ev.seq, ev.event, coalesce(m.next_state, f.state), f.iteration + CASE WHEN ev.event = 'loop' AND m.next_state IS NOT NULL THEN 1 ELSE 0 END, m.next_state IS NOT NULL FROM f JOIN ev ON ev.project = f.project AND ev.n = f.n + 1 LEFT JOIN moves m ON m.state = f.state AND m.event = ev.event)
SELECT project, seq, event, state, iteration, moved FROM f WHERE n > 0""")
def stream_workflow(spark, sf_dir):
    names = F.array(*map(F.lit, ["start", "pass", "fail", "loop", "finish"]))
    e = streams.table_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("event"))
    return streams.drain(streams.workflow(e))
