"""What the work of a query grows with: matchers run once and after the chapters are dealt over the cores, workers hold a chapter at a time."""

import random
import re

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from inkstream.functions import units, wordclass
from inkstream.operators import proof
from inkstream.plans import live, texts
from inkstream.streaming import follow, recheck


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def below_dealing(plan):
    """The part of a plan that runs before rows are dealt over the cores."""
    parts = re.split(r"Repartition|RebalancePartitions", plan, maxsplit=1)
    return parts[1] if len(parts) > 1 else ""


def test_tokens_leave_the_workers_some_chapters_at_a_time(spark):
    n = proof.TOKENS_AT_ONCE + 10
    rows = [(1, ["a"] * n, ["a"] * (n - 1)), (2, [], ["x"]), (3, ["see", "me"], None), (4, ["twenty", "one", "colour"], ["21", "color"]), (5, ["b"], ["b"])]
    said = F.transform("h", lambda t: F.struct(t.alias("text"), F.lit(1.0).alias("start"), F.lit(2.0).alias("end")))
    chapters = spark.createDataFrame(rows, "doc_id long, tokens array<string>, h array<string>").coalesce(1).select("doc_id", "tokens", said.alias("heard"))
    found = proof.token_alignment(chapters)
    assert "MapInArrow" in plan_of(found)
    assert {(r.doc_id, r.state): r["count"] for r in found.groupBy("doc_id", "state").count().collect()} == {(1, "matched"): n - 1, (1, "missing"): 1, (3, "missing"): 2, (4, "different"): 3, (5, "matched"): 1}
    few = found.where("doc_id > 2").orderBy("doc_id", "token_index").select("doc_id", "token_index", "written", "heard", "start", "end").collect()
    assert [tuple(r) for r in few] == [(3, 0, "see", "", None, None), (3, 1, "me", "", None, None), (4, 0, "twenty", "21", 1.0, 2.0), (4, 1, "one", "21", 1.0, 2.0), (4, 2, "colour", "color", 1.0, 2.0), (5, 0, "b", "b", 1.0, 2.0)]


def test_runs_are_worked_out_once_and_after_the_dealing(spark, small):
    for query, matcher in ((texts.align_pickups, "word_runs"), (texts.folded_pickups, "each"), (texts.proof_summary, "word_runs"), (texts.eval_scores, "word_runs")):
        plan = plan_of(query(spark, small))
        assert len(re.findall(rf"\b{matcher}\(", plan)) == 1
        assert f"{matcher}(" not in below_dealing(plan)


def test_readings_are_made_after_the_dealing(spark, small):
    for query in (live.live_follow, live.live_flags):
        assert "slipped" not in below_dealing(plan_of(query(spark, small)))


def test_a_window_read_word_for_word_is_as_a_closer_look_gives_it():
    r, taken = random.Random(3), 0
    for _ in range(3000):
        page = r.choices(["the", "cat", "thanks", "pointblank", "audiotape", "sat", "here", ""], k=12)
        at = r.randint(0, 9)
        said = [page[at + k] if r.random() < 0.9 else "dog" for k in range(3)]
        starts = [5 + 0.4 * k + r.choice([0, 0, 0, -0.9]) for k in range(3)]
        ends = [s + 0.3 for s in starts]
        reading = follow.Reading(page)
        before = follow.State(at, r.choice([0.0, 5.1]), tuple(zip(r.choices(page, k=2), (4.5, 4.9))), r.choice([None, ("cat", 3)]), None, False, r.choice([-1, 4]))
        found = reading.straight(before, said, starts, ends)
        if found:
            window = recheck.usable([recheck.Heard(w, w, a, z, 0.9) for w, a, z in zip(said, starts, ends)])
            after, places = reading.read(before, window)
            assert found == after and [p.event for p in places] == ["match"] * 3
            taken += 1
    assert taken > 100
    words = ["colour", "color", "letter", "ladder", "seven", "7", "abcdefgh", "hgfedcba", "abcdefxy", "s", ""]
    assert all(follow._fits(a)[b] == wordclass.alike(a, b) for a in words[:-1] for b in words)


def test_units_travel_in_columns(spark):
    rows = spark.createDataFrame([(1, ["See", "—", "twenty-one"]), (2, None), (3, [])], "i int, w array<string>").coalesce(1)
    plan = rows.select(units.match_units(F.col("w")).alias("u"))._jdf.queryExecution().executedPlan().toString()
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in plan
    assert [[tuple(u) for u in r.u] for r in rows.select("i", units.match_units(F.col("w")).alias("u")).orderBy("i").collect()] == [[("see", 0, 0), ("21", 2, 2)], [], []]
