from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from helixlake.operators import commits
from helixlake.operators import state as op

STATES, RUNS = "project string, revision long, actor string, at int, body string", "project string, run string, tool string, at int"


def states(spark, rows):
    return spark.createDataFrame([(p, r, a, 1, "{}") for p, r, a in rows], STATES)


def write(spark, root, rows, seen=None, runs=()):
    return op.write_states(root, states(spark, rows), spark.createDataFrame(list(runs), RUNS), "sync", "d", seen=seen)


def stored(spark, root):
    return {r.project: (r.revision, r.actor) for r in op.read_table(spark, root, "state").collect()}


def test_writers_from_one_version_both_end_up_in_the_state(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert commits.last_version(spark, root) == 0 and op.read_table(spark, root, "state") is None
    assert write(spark, root, [("a", 1, "x"), ("b", 1, "x")]) == 1
    assert write(spark, root, [("a", 2, "y")], seen=1) == 2
    assert write(spark, root, [("b", 2, "z"), ("c", 1, "z")], seen=1) == 3
    assert stored(spark, root) == {"a": (2, "y"), "b": (2, "z"), "c": (1, "z")}


def test_an_older_revision_is_refused(spark, tmp_path):
    root = f"file://{tmp_path}"
    write(spark, root, [("a", 3, "x"), ("b", 3, "x")], runs=[("a", "r1", "pathd", 1)])
    write(spark, root, [("a", 5, "y")], runs=[("a", "r2", "cellfree", 1)])
    write(spark, root, [("a", 4, "late"), ("b", 3, "late")], seen=1, runs=[("a", "r3", "pathd", 1)])
    assert stored(spark, root) == {"a": (5, "y"), "b": (3, "late")}
    assert {(r.project, r.actor, r.status) for r in op.read_table(spark, root, "audit").collect()} == {("a", "x", "ok"), ("b", "x", "ok"), ("a", "y", "ok"), ("a", "late", "refused"), ("b", "late", "ok")}
    assert [r.run for r in op.read_table(spark, root, "run_index").collect()] == ["r2"]
    before = {t: sorted(map(tuple, op.read_table(spark, root, t).collect())) for t in op.TABLES}
    assert op.compact(spark, root) == 4
    assert before == {t: sorted(map(tuple, op.read_table(spark, root, t).collect())) for t in op.TABLES}
    assert len(commits.entries(spark, root)) == 4
    write(spark, root, [("a", 6, "z")])
    assert op.read_table(spark, root, "run_index").count() == 0 and stored(spark, root)["a"] == (6, "z")


def test_one_of_many_gets_a_name(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: commits.put_if_absent(spark, f"file://{tmp_path}/log/1.json", str(i) * 50), range(16)))
    assert sum(got) == 1 and [p.read_text() for p in (tmp_path / "log").glob("1.json")] == [str(got.index(True)) * 50]
    assert not [p for p in (tmp_path / "log").iterdir() if p.name.endswith(".tmp")]


def test_writers_at_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    with ThreadPoolExecutor(4) as pool:
        got = sorted(pool.map(lambda i: write(spark, root, [(f"p{i}", 1, "x"), ("shared", i, f"w{i}")]), range(4)))
    assert got == [1, 2, 3, 4]
    state = stored(spark, root)
    assert set(state) == {"p0", "p1", "p2", "p3", "shared"} and state["shared"] == (3, "w3")


def test_migration_runs_once(spark, tmp_path):
    root, old = f"file://{tmp_path}", lambda *rows: spark.createDataFrame(rows, "project string, body string")
    assert op.migrate(root, [("canonical", old()), ("json", old())]) == 0
    assert op.migrate(root, [("canonical", old((None, "broken"))), ("json", old(("q", '{"revision": 2}'), ("q", '{"revision": 7}'), ("z", "[]")))]) == 1
    assert op.migrate(root, [("canonical", old(("n", "{}")))]) == 0
    assert stored(spark, root) == {"q": (7, "system")}
    assert sorted((r.project, r.action, r.status) for r in op.read_table(spark, root, "audit").collect()) == [("q", "json", "ok"), ("workbench-default", "canonical", "failed"), ("z", "json", "failed")]
    assert op.migrate(f"{root}/other", [("json", old(("z", "[]")))]) == 1
    assert op.read_table(spark, f"{root}/other", "state") is None and op.read_table(spark, f"{root}/other", "audit").select(F.max("status")).first()[0] == "failed"
