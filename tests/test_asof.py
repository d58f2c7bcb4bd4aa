import random

from helixlake.operators import asof


def test_a_hot_key_is_numbered_and_carried_over_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.randint(0, 60), i, r.choice([None, None, i])) for i in range(900)]
    table = spark.createDataFrame(rows, "key string, at int, tie int, part int").repartition(7)
    order = sorted(rows, key=lambda x: (x[1], x[2]))
    places, known, count, last = {}, {}, {}, {}
    for key, at, tie, value in order:
        count[key] = count.get(key, 0) + 1
        last[key] = value if value is not None else last.get(key)
        places[tie], known[tie] = count[key], last[key]
    parts = asof.dealt(table.drop("part"), ["key"], ["at", "tie"])
    assert len({x.part for x in parts.where("key = 'hot'").select("part").distinct().collect()}) > 1
    assert {x.tie: x.place for x in asof.numbered(table, ["key"], ["at", "tie"]).collect()} == places
    assert {x.tie: x.part for x in asof.carried(table, ["key"], ["at", "tie"], ["part"]).collect()} == known
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sources_at_one_time_come_in_order(spark):
    one = spark.createDataFrame([("s", 5, 1, "p1"), ("s", 9, 2, "p2")], "key string, at int, tie int, plan string")
    two = spark.createDataFrame([("s", 5, 1, "t1"), ("s", 5, 2, "t2"), ("s", 1, 3, "t0")], "key string, at int, tie int, task string")
    late = spark.createDataFrame([("s", 5, 9, "l1"), ("s", 20, 1, "l2"), ("other", 7, 1, "l3")], "key string, at int, tie int, log string")
    got = {(x.key, x.source, x.tie): (x.plan, x.task, x.log) for x in asof.as_of({"plan": one, "task": two, "log": late}, ["key"], "at", "tie").collect()}
    assert got == {
        ("s", "task", 3): (None, "t0", None), ("s", "plan", 1): ("p1", "t0", None), ("s", "task", 1): ("p1", "t1", None), ("s", "task", 2): ("p1", "t2", None), ("s", "log", 9): ("p1", "t2", "l1"),
        ("s", "plan", 2): ("p2", "t2", "l1"), ("s", "log", 1): ("p2", "t2", "l2"), ("other", "log", 1): (None, None, "l3"),
    }
    assert asof.as_of({"plan": one.limit(0), "task": two.limit(0)}, ["key"], "at", "tie").count() == 0
