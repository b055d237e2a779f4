"""Population by several sessions, failing keys set apart, deletion with all that hangs on it."""

import threading

import pytest
from pyspark.sql import functions as F

from epochal.plans.nodes import Node, Schema


@pytest.fixture
def db(spark, tmp_path):
    def squares(todo, p):
        return todo.join(p["number"], "a").select("a", (F.col("v") * F.col("v")).alias("sq"))

    def sums(todo, p):
        return todo.join(p["square"], "a").join(p["factor"], "f").select("a", "f", (F.col("sq") * F.col("f")).alias("x"))

    def total(todo, p):
        return todo.select("f").distinct().crossJoin(p["square"].agg(F.sum("sq").alias("all")))

    s = Schema(spark, str(tmp_path / "db"))
    s.add(Node("number", ["a"]))
    s.add(Node("factor", ["f"]))
    s.add(Node("square", ["a"], ["number"], squares))
    s.add(Node("scaled", ["a", "f"], ["square", "factor"], sums))
    s.add(Node("total", ["f"], ["factor", "square"], total))
    s.insert("number", spark.createDataFrame([(i, i) for i in range(12)], "a int, v int"))
    s.insert("factor", spark.createDataFrame([(1,), (2,)], "f int"))
    return s


def test_restrictions_and_limits(db):
    assert db.populate("square", where="a < 4") == 4 and db.populate("square", limit=3) == 3
    assert db.populate("square", where=db.spark.createDataFrame([(11, "x")], "a int, other string")) == 1
    assert sorted(r["a"] for r in db.table("square").collect()) == [0, 1, 2, 3, 4, 5, 6, 11]
    assert db.populate("square") == 4 and db.populate("square") == 0


def test_two_sessions_make_no_row_twice(db):
    made, wrong, gate = [], [], threading.Barrier(2)

    def work():
        try:
            other = Schema(db.spark.newSession(), db.root)
            other.nodes = db.nodes
            gate.wait()
            for _ in range(3):
                made.append(other.populate("square", reserve=True, buckets=4))
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    threads = [threading.Thread(target=work) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong and sum(made) == 12
    assert sorted(r["a"] for r in db.table("square").collect()) == list(range(12))
    assert not [f for f in db._listed("_claims/square")]


def test_claims_hold_until_they_expire(db):
    assert db._claim("_claims/square/0", 100) and not db._claim("_claims/square/0", 100)
    for b in range(8):
        db._claim(f"_claims/square/{b}", 100)
    assert db.populate("square", reserve=True, buckets=8) == 0  # all are another's
    assert db.populate("square", reserve=True, buckets=8, expires=0) == 12


def test_failing_keys_stand_alone(db, spark):
    @F.udf("int")
    def touchy(a):
        if a in (3, 8):
            raise ValueError(f"no {a}")
        return a

    db.add(Node("touchy", ["a"], ["number"], lambda todo, p: todo.select("a", touchy("a").alias("v"))))
    with pytest.raises(Exception, match="no [38]"):
        db.populate("touchy")
    assert not db.has("touchy") and not db.has(db.errors("touchy"))
    assert db.populate("touchy", suppress_errors=True) == 10
    assert {r["a"]: "no " in r["error"] for r in db.table(db.errors("touchy")).collect()} == {3: True, 8: True}
    assert db.populate("touchy") == 0  # failed keys wait
    db.retry("touchy")
    assert db.missing("touchy").count() == 2
    with pytest.raises(RuntimeError, match="over 1 keys"):
        db.populate("touchy", suppress_errors=True, most_errors=1)


def test_deletion_cascades(db):
    db.populate_all()
    assert db.delete("number", "a IN (1, 2)", dry=True) == {"number": 2, "square": 2, "scaled": 4, "total": 2}
    assert db.table("scaled").count() == 24
    db.delete("number", "a IN (1, 2)")
    assert {n: db.table(n).count() for n in ("number", "square", "scaled", "total")} == {"number": 10, "square": 10, "scaled": 20, "total": 0}
    assert db.missing("square").isEmpty() and db.populate_all() == {"square": 0, "scaled": 0, "total": 20}
    assert {r["all"] for r in db.table("total").collect()} == {sum(i * i for i in range(12)) - 5}
    # In the middle of the graph: parents stay, so the keys are missing again.
    db.delete("scaled", db.spark.createDataFrame([(5, 2)], "a int, f int"))
    assert db.table("square").count() == 10 and [tuple(r) for r in db.missing("scaled").select("a", "f").collect()] == [(5, 2)]
    assert db.populate_all()["scaled"] == 1


def test_half_done_exchanges_are_finished(db):
    db.populate_all()
    fs, run = db._fs(), next(f.getPath().getName() for f in db._listed("square"))
    x = run.removeprefix("run-")
    fs.rename(db._at(f"square/{run}"), db._at(f"square/_gone-{x}"))  # the session was lost before the new run came in
    db.recover()
    assert db.table("square").count() == 12
    db.table("square").where("a > 5").write.parquet(db.path(f"_staging/{x}"))
    fs.rename(db._at(f"square/{run}"), db._at(f"square/_gone-{x}"))
    db.recover()
    assert db.table("square").count() == 6 and not [f for f in db._listed("square") if f.getPath().getName().startswith("_")]
