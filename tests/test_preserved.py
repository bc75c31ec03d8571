import random

from inkstream.operators.proof import preserved
from inkstream.plans import pickups


def test_new_early_pickup_shifts_no_decision(spark):
    schema = "chapter long, id string, expected string, t double"
    old = spark.createDataFrame([(1, "a", "x", 10.0, "done"), (1, "b", "x", 100.0, "open"), (1, "c", "y", 50.0, "kept"), (2, "a", "x", 7.0, "other")], schema + ", status string")
    fresh = spark.createDataFrame([(1, "n1", "x", 99.0), (1, "c", "z", 900.0), (2, "m", "y", 7.0), (1, "n3", "y", 51.0)], schema)
    found = {(r.chapter, r.id): (r.status, r.moved_by) for r in preserved(fresh, old, ["chapter"], ["expected"], "t", ["status"], "id").collect()}
    assert found == {(1, "n1"): ("open", 1.0), (1, "c"): ("kept", 850.0), (2, "m"): (None, None), (1, "n3"): (None, None)}
    early = spark.createDataFrame([(1, "p", "x", 98.0), (1, "q", "x", 101.0), (1, "r", "x", 300.0)], schema)
    found = {r.id: r.status for r in preserved(early, old, ["chapter"], ["expected"], "t", ["status"], "id").collect()}
    assert found == {"p": "open", "q": "done", "r": None}


def plain(fresh, old):
    free, out = sorted(old), {}
    for t, i in sorted(fresh):
        best = min(free, key=lambda o: (abs(o[0] - t), o[0], o[1]), default=None)
        if best:
            free.remove(best)
        out[i] = best and best[1]
    return out


def test_each_takes_the_nearest_that_is_left(spark):
    r = random.Random(3)
    groups = {g: ([(float(r.randint(0, 12)), f"n{i:02}") for i in range(r.randint(0, 15))], [(float(r.randint(0, 12)), f"o{i:02}") for i in range(r.randint(0, 12))]) for g in range(60)}
    schema = "g int, s string, id string, t double"
    fresh = spark.createDataFrame([(g, "x", i, t) for g, (new, _) in groups.items() for t, i in new], schema)
    old = spark.createDataFrame([(g, "x", i, t, i) for g, (_, were) in groups.items() for t, i in were], schema + ", was string")
    found = {(x.g, x.id): x.was for x in preserved(fresh, old, ["g"], ["s"], "t", ["was"], "id").collect()}
    assert found == {(g, i): was for g, (new, were) in groups.items() for i, was in plain(new, were).items()}


def test_a_hot_signature_of_many_rows(spark):
    rows = spark.range(200_000).selectExpr("1 AS g", "'x' AS s", "id", "CAST(id AS DOUBLE) AS t")
    fresh, old = rows.selectExpr("g", "s", "id + 1000000 AS id", "t + 0.25 AS t"), rows.selectExpr("g", "s", "id", "t", "id AS was")
    assert preserved(fresh, old, ["g"], ["s"], "t", ["was"], "id").where("was = id - 1000000 and moved_by = 0.25").count() == 200_000


def test_f18_ids_then_the_nearest_whatever_each_side_has(spark):
    r = random.Random(5)
    new, were, expected = [], [], {}
    for g in range(150):
        a = [(float(r.randint(0, 9)), i) for i in r.sample(range(40), r.choice([0, 1, 1, 2, 3, 6]))]
        b = [(float(r.randint(0, 9)), i) for i in r.sample(range(40), r.choice([0, 1, 1, 2, 3, 6]))]
        kind = {i: r.choice("xy") for _, i in a}, {i: r.choice("xy") for _, i in b}
        same = {i for _, i in a} & {i for _, i in b}
        expected |= {(g, i): i for i in same}
        for s in "xy":
            left = [[(t, i) for t, i in side if i not in same and kind[n][i] == s] for n, side in enumerate((a, b))]
            expected |= {(g, i): was for i, was in plain(*left).items()}
        new += [(g, kind[0][i], i, t) for t, i in a]
        were += [(g, kind[1][i], i, t, i) for t, i in b]
    schema = "g int, s string, id int, t double"
    times = {(g, i): t for g, _, i, t, _ in were}
    found = preserved(spark.createDataFrame(new, schema), spark.createDataFrame(were, schema + ", was int"), ["g"], ["s"], "t", ["was"], "id").collect()
    assert {(x.g, x.id): x.was for x in found} == expected and len(found) == len(expected)
    assert all(x.moved_by == (None if x.was is None else abs(x.t - times[x.g, x.was])) for x in found)


def test_f18_rows_without_an_id_are_met_by_time_alone(spark):
    schema = "g int, s string, id string, t double"
    old = spark.createDataFrame([(1, "x", None, 5.0, "a"), (1, "y", None, 6.0, "b")], schema + ", was string")
    fresh = spark.createDataFrame([(1, "x", None, 7.0), (1, "z", None, 8.0)], schema)
    assert {(x.s, x.was, x.moved_by) for x in preserved(fresh, old, ["g"], ["s"], "t", ["was"], "id").collect()} == {("x", "a", 2.0), ("z", None, None)}


def test_f18_each_side_of_carry_over_is_dealt_once_and_none_is_joined(spark, small):
    plan = pickups.carry_over(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == plan.count("FileScan") == 2
