"""Laboratory, hashing and provenance queries."""

from pyspark.sql import functions as F

from helixlake.functions import hashing
from helixlake.operators import lab as op
from helixlake.plans.registry import query
from helixlake.plans.tools import r, rounded, values
from helixlake.sources import views as v


def _fnv(s: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({s}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


@query(f"SELECT c_custkey, {_fnv('c_name')} AS fnv, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_mktsegment, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h31 FROM customer")
def string_hashes(spark, sf_dir):
    h = hashing.times31(F.col("c_mktsegment"))
    return v.table(spark, sf_dir, "customer").select("c_custkey", hashing.fnv1a(F.col("c_name")).alias("fnv"), F.pmod(h, F.lit(4294967296)).alias("h31"))


@query("""WITH RECURSIVE g(k, n, h) AS (SELECT n_nationkey::BIGINT, 0, n_nationkey::BIGINT FROM nation UNION ALL SELECT k, n + 1, (h * 1664525 + 1013904223) % 4294967296 FROM g WHERE n < 6)
SELECT k AS seed, list(floor(h / 4294967296.0 * 1000000 + 0.5) / 1000000 ORDER BY n) AS draws FROM g WHERE n > 0 GROUP BY k""")
def seeded_draws(spark, sf_dir):
    d = F.transform(hashing.lcg(F.col("n_nationkey").cast("long"), F.lit(6)), lambda u: F.floor(u * 1000000 + 0.5) / 1000000)
    return v.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seed"), d.alias("draws"))


@query("SELECT p_partkey, p_name AS base, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || n END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def unique_ids(spark, sf_dir):
    return op.unique_ids(v.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("base")), "base", "p_partkey")


_STEPS = "steps AS (SELECT n_nationkey AS step, 'r' || n_regionkey AS source, 1.5 * (n_nationkey % 7) AS volume FROM nation)"


def _steps(spark, sf_dir):
    n = F.col("n_nationkey")
    return v.table(spark, sf_dir, "nation").select(n.alias("step"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source"), (F.lit(1.5) * (n % 7)).alias("volume"))


@query(f"WITH {_STEPS} SELECT step, source, volume::DOUBLE AS volume, w::INTEGER AS well_index, chr((65 + w % 8)::INTEGER) || (w // 8 + 1)::VARCHAR AS well FROM steps, range(0, 24) t(w)")
def scaled_steps(spark, sf_dir):
    return op.scaled_steps(_steps(spark, sf_dir), 24)


@query(f"WITH {_STEPS} SELECT source, (sum(volume * 24) + 10)::DOUBLE AS volume FROM steps GROUP BY source")
def source_volumes(spark, sf_dir):
    return op.source_volumes(op.scaled_steps(_steps(spark, sf_dir), 24), 10.0)


@query(f"WITH {_STEPS} SELECT step, CASE WHEN volume < 1 THEN 'below range' ELSE 'above range' END AS problem FROM steps WHERE volume < 1 OR volume > 8")
def step_violations(spark, sf_dir):
    return op.step_violations(_steps(spark, sf_dir), 1.0, 8.0)


BENCHMARKS = [(1, "red", "first"), (2, "small ring", "second"), (3, "widget", "third")]


@query(f"""WITH {values('b', 'ord, alias, name', BENCHMARKS)}, t AS (SELECT DISTINCT p_name || ' ' || p_brand AS target FROM part), h AS (SELECT target, name, ord FROM t, b WHERE contains(' ' || trim(regexp_replace(lower(target), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || alias || ' '))
SELECT target, arg_min(name, ord) AS benchmark FROM h GROUP BY target""")
def benchmark_lookup(spark, sf_dir):
    t = v.table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_brand").alias("target")).distinct()
    return op.benchmark_lookup(t, spark.createDataFrame(BENCHMARKS, "ord int, alias string, name string").coalesce(1))


@query(f"""WITH s AS (SELECT p_partkey AS variant, p_size % 4 AS round, p_partkey % 3 AS replicate, p_retailprice / 100 AS score FROM part), u AS (SELECT *, {_fnv("variant || ':' || round || ':' || replicate")} / 4294967296.0 AS u FROM s)
SELECT variant, round, replicate, floor(score * score / sum(score * score) OVER (PARTITION BY round, replicate) * 1000000 * (1 + (u - 0.5) * 0.16) + 0.5)::BIGINT AS reads FROM u""")
def campaign_reads(spark, sf_dir):
    s = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant"), (F.col("p_size") % 4).alias("round"), (F.col("p_partkey") % 3).alias("replicate"), (F.col("p_retailprice") / 100).alias("score"))
    return op.campaign_reads(s, 1_000_000.0)


@query("""WITH f AS (SELECT p_brand AS family, p_size AS round, p_partkey::DOUBLE AS x, p_retailprice AS y, p_size * 1.0 AS score FROM part), l AS (SELECT max(round) AS round FROM f)
SELECT family, count(*) AS n, floor(avg(x) * 1000 + 0.5) / 1000 AS x, floor(avg(y) * 1000 + 0.5) / 1000 AS y, floor(avg(score) * 1000 + 0.5) / 1000 AS score FROM f JOIN l USING (round) GROUP BY family""")
def family_hotspots(spark, sf_dir):
    p = v.table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_size").alias("round"), F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_size") * 1.0).alias("score"))
    return rounded(op.family_hotspots(p), digits=3)


@query(f"""WITH RECURSIVE ev AS (SELECT user_id AS task, event_id AS seq, ['run', 'done', 'fail', 'retry', 'cancel'][event_id % 5 + 1] AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f(task, n, status, attempts) AS (SELECT DISTINCT task, 0::BIGINT, 'pending', 0 FROM ev UNION ALL SELECT f.task, ev.n, CASE WHEN status = 'pending' AND event = 'run' THEN 'running' WHEN status = 'running' AND event = 'done' THEN 'done' WHEN status = 'running' AND event = 'fail' THEN 'error' WHEN status IN ('pending', 'running') AND event = 'cancel' THEN 'cancelled' WHEN status = 'error' AND event = 'retry' THEN 'pending' ELSE status END,
 attempts + CASE WHEN status = 'pending' AND event = 'run' THEN 1 ELSE 0 END FROM f JOIN ev ON ev.task = f.task AND ev.n = f.n + 1)
SELECT task, arg_max(status, n) AS status, arg_max(attempts, n) AS attempts FROM f GROUP BY task""")
def queue_state(spark, sf_dir):
    names = F.array(*map(F.lit, ["run", "done", "fail", "retry", "cancel"]))
    e = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("event"))
    return op.queue_state(e)


@query(f"""WITH {v.CELLS}, s AS (SELECT cell AS c0, cluster AS own, v AS w FROM cells ORDER BY md5(cell::VARCHAR), cell LIMIT 200), d AS (SELECT c0, own, cluster, avg(list_distance(v, w)) AS d FROM cells, s WHERE c0 <> cell GROUP BY ALL),
g AS (SELECT c0, coalesce(max(d) FILTER (own = cluster), 0.0) AS a, coalesce(min(d) FILTER (own <> cluster), 0.0) AS b FROM d GROUP BY c0) SELECT count(*) AS n, {r('avg((b - a) / CASE WHEN greatest(a, b) = 0 THEN 1.0 ELSE greatest(a, b) END)', 'silhouette')} FROM g""")
def sampled_silhouette(spark, sf_dir):
    return rounded(op.sampled_silhouette(v.cells(spark, sf_dir), 200))


_B36 = "".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // {36**i}) % 36 + 1)::INTEGER, 1)" + (" || " if i else "") for i in range(6, -1, -1))


@query(f"WITH {v.RUNS}, k AS (SELECT project, tool, revision, tool || '|' || project || '|' || revision AS s FROM runs), f AS (SELECT project, tool, revision, {_fnv('s')} AS h FROM k) SELECT project, tool, revision, 'prov_' || CASE WHEN h = 0 THEN '0' ELSE ltrim({_B36}, '0') END AS provenance_id FROM f")
def provenance_entries(spark, sf_dir):
    o = v.runs(spark, sf_dir)
    return o.select("project", "tool", "revision", hashing.entry_id(F.col("tool"), F.col("project").cast("string"), F.col("revision").cast("string")).alias("provenance_id"))
