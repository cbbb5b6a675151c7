"""Work inside hot groups gives what a plain window gives."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskframe.operators.groups import carry_previous, collect_parts, first_rows, number_rows
from riskframe.operators.changes import member_change_text, previous_stable_version


def hot(spark, n=600):
    """A third of the rows in one group."""
    data = [("hot" if i % 3 == 0 else f"k{i % 40}", i, None if i % 4 else f"v{i}") for i in range(n)]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, "k STRING, i INT, v STRING")


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_numbering_and_carrying_in_slices(spark):
    df = hot(spark).unionByName(hot(spark, 9).withColumn("k", F.lit(None).cast("string")))
    window = Window.partitionBy("k").orderBy("i")
    before = F.last("v", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    assert table(number_rows(df, ["k"], ["i"], "p")) == table(df.withColumn("p", F.row_number().over(window)))
    assert table(carry_previous(df, ["k"], ["i"], "v", "b")) == table(df.withColumn("b", before))
    assert number_rows(df.limit(0), ["k"], ["i"], "p").count() == carry_previous(df.limit(0), ["k"], ["i"], "v", "b").count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30), st.one_of(st.none(), st.text("xy", max_size=2))),
                unique_by=lambda r: r[:2], min_size=1, max_size=40))
def test_carrying_any_groups(spark, data):
    df = spark.createDataFrame(data, "k STRING, i INT, v STRING")
    got = {(r.k, r.i): r.before for r in carry_previous(df, ["k"], ["i"], "v", "before").collect()}
    for k, i, _ in data:
        earlier = [v for kk, ii, v in sorted(data, key=lambda r: r[:2]) if kk == k and ii < i and v is not None]
        assert got[k, i] == (earlier[-1] if earlier else None)


def test_parts_hold_everything_once(spark):
    df = hot(spark).unionByName(hot(spark).filter("k = 'hot' AND i < 30"))
    want = {}
    for r in df.collect():
        want[r.k, r.i] = want.get((r.k, r.i), 0) + 1
    parts = collect_parts(df, ["k"], "i", "items", max_items=20).collect()
    got = {(p.k, e["item"]): e["copies"] for p in parts for e in p["items"]}
    assert got == want and len(got) == sum(len(p["items"]) for p in parts)
    hot_parts = [p for p in parts if p.k == "hot"]
    assert hot_parts[0]["parts"] == 10 and len(hot_parts) > 5
    assert all(p["parts"] == 1 for p in parts if p.k != "hot")
    assert all(p["items"] == sorted(p["items"]) for p in parts)


def test_first_rows_are_cut_before_the_shuffle(spark):
    plan = first_rows(hot(spark), ["k"], [F.col("i").asc()], 2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text
    assert plan.count() == 2 * plan.select("k").distinct().count()


def brute_previous(versions):
    def core(v):
        return tuple(int(x) for x in v.split("+")[0].split("-")[0].split("."))
    out = {}
    for v in versions:
        lower = [u for u in versions if "-" not in u and core(u) < core(v)]
        out[v] = max(lower, key=core) if lower else None
    return out


def test_previous_stable_version_in_a_hot_package(spark):
    rng = random.Random(3)
    versions = list({f"{rng.randrange(3)}.{rng.randrange(12)}.{rng.randrange(9)}" + rng.choice(["", "", "-rc.1"]) for _ in range(150)})
    df = spark.createDataFrame([("p", v) for v in versions] + [("q", "x")], "package STRING, version STRING")
    want = brute_previous(versions)
    got = {r.version: r.previous_version for r in previous_stable_version(df).collect() if r.package == "p"}
    assert got == want


def test_previous_stable_version_cases(spark):
    listed = ["1.9.0", "1.10.0", "2.0.0-rc.1", "2.0.0", "bad", "3.0.0"]
    df = spark.createDataFrame([("p", v) for v in listed], "package STRING, version STRING")
    got = {r.version: r.previous_version for r in previous_stable_version(df).collect()}
    assert got == {"1.9.0": None, "1.10.0": "1.9.0", "2.0.0-rc.1": "1.10.0", "2.0.0": "1.10.0", "bad": None, "3.0.0": "2.0.0"}


def test_long_change_lists_come_in_parts(spark):
    changes = spark.createDataFrame(
        [("p", "1", "2", f"f{i:03}", "removed") for i in range(50)], "package STRING, from_version STRING, to_version STRING, member STRING, change STRING"
    )
    one = member_change_text(changes).collect()
    many = member_change_text(changes, max_items=10).collect()
    assert len(one) == 1 and one[0].members.split(", ") == [f"f{i:03}" for i in range(50)]
    assert len(many) > 1 and sorted(sum((r.members.split(", ") for r in many), [])) == [f"f{i:03}" for i in range(50)]


def test_numbered_rows_are_not_shuffled_for_a_window(spark):
    plan = spark._jvm.PythonSQLUtils.explainString(number_rows(hot(spark), ["k"], ["i"], "p")._jdf.queryExecution(), "simple")
    assert "row_number" not in plan and "_at" in plan
