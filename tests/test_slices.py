"""Sessions dealt to slices and pieces give what a scan of the whole session gives."""

import random

import pytest

from sessionloom.operators import graph

UNITS = "sid string, keyframe_id long, category string, description string, objects array<string>, faces array<string>, start_ms long, end_ms long"


def _units(n, sids=("a", "b", None)):
    r = random.Random(5)
    words = ["red", "green", "blue", "old", "tall"]
    rows = []
    for k in range(n):
        said = [r.choice(words) for _ in range(2)]
        start = r.choice([None, *range(0, 90, 3)]) if k % 11 == 0 else r.randrange(90)
        rows.append((r.choice(sids), k, r.choice("xxxy"), " ".join(said), said, [r.choice("fg")], start, (start or 0) + 5))
    return rows


def test_sliced_is_whole_and_spread(spark):
    df = spark.createDataFrame(_units(300), UNITS)
    dealt = graph.sliced(df, 10)
    own = dealt.where("NOT __ghost")
    assert sorted(own.select("keyframe_id").collect()) == sorted(df.select("keyframe_id").collect())
    sizes = own.where("sid IS NOT NULL").groupBy("sid", "__p").count().collect()
    assert len(sizes) >= 14 and max(x["count"] for x in sizes) <= 40
    assert dealt.where("__ghost").count() == len(sizes) - 2  # one before each slice but the first of a session


@pytest.mark.parametrize("slice_rows", [1, 7, 1000])
def test_merge_adjacent_in_slices(spark, slice_rows):
    df = spark.createDataFrame(_units(300), UNITS)
    got = {r.keyframe_id: (r.group, round(r.similarity, 9)) for r in graph.merge_adjacent(df, 0.5, slice_rows=slice_rows).collect()}
    want, units = {}, {r.keyframe_id: r for r in graph.units(df).collect()}

    def jaccard(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a | b else 0.0

    for sid in ("a", "b", None):
        group, before = 0, None
        for u in sorted((x for x in units.values() if x.sid == sid), key=lambda x: (x.start_ms is not None, x.start_ms or 0, x.keyframe_id)):
            same = before is not None and before.category == u.category
            s = 0.55 * jaccard(before.grams, u.grams) + 0.3 * jaccard(before.keys, u.keys) + 0.15 * jaccard(before.faces, u.faces) if same else 0.0
            group += 0 if same and s >= 0.5 else 1
            want[u.keyframe_id], before = (group, round(s, 9)), u
    assert got == want


def test_bridge_views_in_pieces(spark):
    r, rows = random.Random(9), []
    for sid in "abc":
        k = 0
        for group in range(1, 120):
            category, long = r.choice(["x", "x", "x", None]), r.random() < 0.4
            for _ in range(r.randint(3, 4) if long else r.randint(1, 2)):
                rows.append((sid, k, group, category, r.choice("uvw"), k * 10, k * 10 + r.choice([5, 40])))
                k += 1
    df = spark.createDataFrame(rows, "sid string, keyframe_id long, group long, category string, view string, start_ms long, end_ms long")
    got = {(x.sid, x.keyframe_id): x.group for x in graph.bridge_views(df, 60).collect()}
    want = {}
    for sid in "abc":
        held = [[x for x in rows if x[0] == sid and x[2] == g] for g in range(1, 120)]
        i = 0
        while i + 2 < len(held):
            left, mid, right = held[i : i + 3]
            if left[0][3] == mid[0][3] == right[0][3] and len(mid) <= 2 and sum(x[6] - x[5] for x in mid) <= 60 and {x[4] for x in left} & {x[4] for x in right}:
                held[i : i + 3] = [left + mid + right]
                i = max(0, i - 2)
            else:
                i += 1
        want |= {(sid, x[1]): n + 1 for n, g in enumerate(held) for x in g}
    assert len(set(want.values())) < 119
    assert got == want


def test_object_labels_are_those_of_scene_objects(spark):
    """Rows and arrays give the same labels; no step asks for the size of an array that it would have to compute."""
    from pyspark.sql import functions as F

    from sessionloom.functions import text as X
    from sessionloom.operators import semantics

    labels = [" Mic", "subtitle", "Potted-Plant　", "LOGO", "two\t words", "text ", "", " ", " -x-\x85", "a_b", "Σ-ΑΣ", None]
    rows = [(k, "x", "seen", c, [(n, 0.5) for n in labels[: len(labels) - k]]) for k, c in enumerate([0.1, 0.5, 0.2])] + [(9, "x", "none", 0.5, []), (10, "x", None, 0.5, None)]
    df = spark.createDataFrame(rows, "doc_id long, category string, description string, confidence double, objects array<struct<label:string,confidence:double>>")
    repaired = semantics.repair_environment(df)
    whole = semantics.scene_objects(repaired).select("doc_id", F.explode("objects").alias("o")).select("doc_id", "o.label")
    found = semantics.object_labels(repaired, ["doc_id"])
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, whole.collect()))
    assert (0, "logo") in got and (1, "logo") not in got and (1, "two_words") in got and (1, "plant") in got
    assert "size(objects" not in found._jdf.queryExecution().optimizedPlan().toString()
    spaces = spark.createDataFrame([(f"{c}a{c}{c}b{c}",) for c in [*X.SPACE_CHARS, "​", "-"]], "s string")
    old = F.regexp_replace("s", rf"\A{X.SPACES}|{X.SPACES}\z", "")
    assert spaces.where(~X.strip(F.col("s")).eqNullSafe(old)).count() == 0


def test_uniqueness_and_parents_keep_tasks_small(spark):
    """No combining before the shuffle, no broadcast of an uncounted parent; the rows are the same."""
    from sessionloom.operators import evaluation

    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (None, 1), (None, 1), (3, 5)], "k long, n long")
    twice = evaluation.not_unique(rows, ["k", "n"], "twice")
    lost = evaluation.dangling(rows, spark.createDataFrame([(1,), (1,), (3,)], "k long"), ["k"], "n", "lost")
    assert sorted(r.entity for r in twice.collect()) == ["1", "1/2"]
    assert sorted(r.entity for r in lost.collect()) == ["1", "1", "1"]
    plan = twice._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan[plan.rindex("Exchange") :]
    assert "Broadcast" not in lost._jdf.queryExecution().executedPlan().toString()
