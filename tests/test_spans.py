import random

import pytest

from recscan.operators import spans as P

SPANS = "source_key string, start_s double, end_s double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_hand_intervals_scores_the_second_higher(spark):
    samples = spark.createDataFrame([("k", 0.0, 1, 0.02), ("k", 0.2, 1, 0.03), ("k", 0.4, 0, 0.0), ("k", 1.0, 1, 0.05), ("k", 1.2, 2, 0.06)], "source_key string, t double, n int, a double")
    proposals = spark.createDataFrame([("k", 0.0, 0.5, 0.4), ("k", 0.9, 1.5, 0.8)], "source_key string, start_s double, end_s double, active_fraction double")
    rec = spark.createDataFrame([("k", 2.0)], "source_key string, duration_s double")
    got = sorted(P.hand_intervals(rec, proposals, samples, 5.0, 0.2, 0.2, 0.0, 20.0).collect(), key=lambda r: r["start_s"])
    assert len(got) == 2 and got[0]["start_s"] == 0.0 and got[1]["proposal_score"] > got[0]["proposal_score"]


def test_merge_spans_strict_and_inclusive(spark):
    s = spark.createDataFrame([("k", 0.0, 1.0), ("k", 1.5, 2.0), ("k", 1.6, 1.7), ("k", 4.0, 5.0)], "source_key string, start_s double, end_s double")
    assert rows(P.merge_spans(s, 0.5)) == [("k", 0.0, 2.0), ("k", 4.0, 5.0)]
    assert rows(P.merge_spans(s, 0.5, inclusive=False)) == [("k", 0.0, 1.0), ("k", 1.5, 2.0), ("k", 4.0, 5.0)]


def test_split_at_the_hole(spark):
    t = [(float(i), 1, 0.02) for i in (*range(10), *range(15, 25))]
    samples = spark.createDataFrame([("k", *x) for x in t], "source_key string, t double, n int, a double")
    span = spark.createDataFrame([("k", 0.0, 25.0)], "source_key string, start_s double, end_s double")
    assert rows(P.split_long_spans(span, samples, 1.0, 20.0)) == [("k", 0.0, 12.5), ("k", 12.5, 25.0)]


def test_frame_ranges(spark):
    frames = spark.createDataFrame([("k", i, i / 10) for i in range(5)], "source_key string, idx long, t double")
    want = spark.createDataFrame([("k", "a", 0.05, 0.25), ("k", "b", 9.0, 10.0), ("k", "c", 2.0, 1.0), ("k", "d", -1.0, 1.0)], "source_key string, id string, start_s double, end_s double")
    got = {r["id"]: (r["start_idx"], r["end_idx"], r["error"]) for r in P.frame_ranges(frames, want).collect()}
    assert got["a"] == (1, 3, None)
    assert got["b"][2] == "no frames in range" and got["c"][2] == "end must be after start" and "not negative" in got["d"][2]


def plain_cut(blocks, s, e, most):
    """Spans of at most ``most``, by the rule for one cut, again and again."""
    if e - s <= most:
        return [(s, e)]
    cursor, best = s, None
    for b, x in [*sorted((b, x) for b, x in blocks if min(x, e) - max(b, s) > 0), (e, e)]:
        gap = round(b - cursor, 9)
        if gap > 0 and (best is None or (gap, -cursor) > best):
            best = (gap, -cursor)
        cursor = max(cursor, x)
    at = -best[1] + best[0] / 2 if best else None
    at = at if best and s + 0.25 < at < e - 0.25 else s + (e - s) / 2
    return plain_cut(blocks, s, at, most) + plain_cut(blocks, at, e, most)


def test_long_spans_are_cut_as_by_hand(spark):
    rng = random.Random(3)
    for most in (0.5, 3.0, 20.0):
        samples, spans, want = [], [], []
        for k in range(12):
            blocks = [(t / 5, t / 5 + 0.2) for t in range(500) if rng.random() < rng.choice([0.1, 0.6, 0.97])] if k else []
            samples += [(f"k{k}", b, 1, 0.5) for b, _ in blocks]
            for _ in range(3):
                s, e = sorted(round(rng.uniform(-3, 110), 3) for _ in range(2))
                spans += [(f"k{k}", s, e)]
                want += [(f"k{k}", round(x, 6), round(y, 6)) for x, y in plain_cut(blocks, s, e, most)]
        got = P.split_long_spans(spark.createDataFrame(spans, SPANS), spark.createDataFrame(samples, "source_key string, t double, n int, a double"), 0.2, most)
        assert sorted((r[0], round(r[1], 6), round(r[2], 6)) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("slice_s", [0.7, 60.0])
def test_overlapping_gives_each_pair_once(spark, slice_s):
    rng = random.Random(4)
    some = lambda n, k: [(f"r{rng.randint(0, 2)}", i, a := rng.choice([rng.uniform(-5, 30), float(rng.randint(0, 9))]), a + rng.choice([0.0, 1.0, rng.uniform(0, 20)])) for i in range(n)]
    left, right = some(60, 0), some(80, 1)
    a = spark.createDataFrame([*left, ("r0", 99, None, 1.0)], "source_key string, i int, s double, e double")
    b = spark.createDataFrame([*right, (None, 98, 0.0, 9.0)], "source_key string, j int, b double, d double")
    got = sorted((r["source_key"], r["i"], r["j"]) for r in P.overlapping(a, b, ("s", "e"), ("b", "d"), slice_s).collect())
    assert got == sorted((k, i, j) for k, i, s, e in left for q, j, x, y in right if k == q and min(e, y) - max(s, x) > 0)
    plan = P.overlapping(a, b, ("s", "e"), ("b", "d"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan and "Cartesian" not in plan


def test_merging_by_slices_first_changes_nothing(spark):
    rng = random.Random(5)
    rows = [(f"r{rng.randint(0, 1)}", a := round(rng.uniform(0, 300), 2), round(a + rng.uniform(0, 4), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, SPANS)
    for gap in (0.0, 0.5):
        plain, sliced = P.merge_spans(df, gap), P.merge_spans(df, gap, slice_s=7.0)
        assert sorted(map(tuple, plain.select(*df.columns).collect())) == sorted(map(tuple, sliced.select(*df.columns).collect()))


def test_a_day_of_samples_makes_no_more_rows_than_overlap(spark):
    day = 86_400
    spans = spark.range(day // 60).selectExpr("'r' AS source_key", "id * 60.0D AS start_s", "id * 60.0D + 30 AS end_s")
    samples = spark.range(day).selectExpr("'r' AS source_key", "CAST(id AS DOUBLE) AS t", "1 AS n", "0.5D AS a")
    proposals = spark.range(day // 120).selectExpr("'r' AS source_key", "id * 120.0D AS start_s", "id * 120.0D + 100 AS end_s", "0.5D AS active_fraction")
    rec = spark.createDataFrame([("r", float(day))], "source_key string, duration_s double")
    scored = P.score_intervals(spans, samples, proposals, 1.0)
    assert scored.filter("hand_presence_fraction = 1").count() == day // 60
    joins = [x for x in scored._jdf.queryExecution().executedPlan().toString().split("\n") if "Join [source_key" in x and "_slice" not in x and "start_s" not in x]
    assert not joins
    assert P.hand_intervals(rec, proposals, samples, sample_fps=1.0).count() == day // 120  # pauses of 20 s stay
