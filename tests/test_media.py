"""Intervals, chunks and vector search against plain loops."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from fileloom.operators import media, visual


def plain_speakers(segments, speakers):
    out = {}
    for f, seg, a, b in segments:
        hits = [(o, w) for g, s, e, w, o in speakers if g == f and None not in (a, b, s, e) and s <= (a + b) / 2 <= e]
        out[f, seg] = min(hits)[1] if hits else None
    return out


SEGMENTS, TURNS = "file_id int, seg int, start_time double, end_time double", "file_id int, start_time double, end_time double, speaker string, ord int"


def test_speakers_equal_all_pairs(spark):
    rng = random.Random(7)
    time_of = lambda: rng.choice([rng.uniform(-50, 3000), float(rng.randrange(-20, 300)), rng.randrange(600) / 2])
    segments = [(f, i, t := time_of(), t + rng.choice([0.0, 1.0, 7.3])) for f in (1, 2) for i in range(300)] + [(1, 900, None, 1.0), (3, 1, 1.0, 2.0)]
    turns = [(f, t := time_of(), t + rng.choice([-1.0, 0.0, 0.5, 3.0, 64.0, 900.0, 5000.0]), f"s{o % 7}", o) for f in (1, 2) for o in range(120)] + [(1, None, 5.0, "x", -1), (None, 1.0, 2.0, "x", -2)]
    rng.shuffle(turns)
    for bin_seconds in (1.0, 0.25, 100.0):
        got = media.with_speakers(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(turns, TURNS), bin_seconds).collect()
        assert {(r.file_id, r.seg): r.speaker for r in got} == plain_speakers(segments, turns) and len(got) == len(segments)


def test_a_long_file_with_many_turns(spark):
    n = 100_000
    segments = spark.range(n).select(F.lit(1).alias("file_id"), F.col("id").alias("seg"), (F.col("id") * 1.0).alias("start_time"), (F.col("id") + 0.6).alias("end_time"))
    turns = spark.range(n).select(F.lit(1).alias("file_id"), (F.col("id") * 1.0).alias("start_time"), (F.col("id") + F.when(F.col("id") % 1000 == 0, 50_000.0).otherwise(1.5)).alias("end_time"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("speaker"), (-F.col("id")).alias("ord"))
    media.with_speakers(segments.limit(10), turns.limit(10)).count()  # starts the session's code
    began = time.time()
    found = media.with_speakers(segments, turns).filter("speaker = concat('s', seg % 5)").count()
    assert time.time() - began < 10 and found == n


def test_chunks_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(f, rng.choice([rng.uniform(0, 900), float(rng.randrange(900)), 0.1 * rng.randrange(9000)]), None, "t") for f in ("a", "b", None) for _ in range(rng.choice([1, 400]))] + [("c", None, 1.0, "n"), ("c", 5.0, 6.0, "t")]
    got = sorted((str(r.file_id), r.chunk, r.n_segments) for r in media.chunks(spark.createDataFrame(rows, "file_id string, start_time double, end_time double, text string")).collect())
    want: dict = {}
    for f in ("a", "b", None):
        began, chunk = None, 0
        for t in sorted(r[1] for r in rows if r[0] == f):
            if began is None or t - began > 60.0:
                began, chunk = t, chunk + 1
            want[str(f), chunk] = want.get((str(f), chunk), 0) + 1
    assert got == sorted([*((*k, n) for k, n in want.items()), ("c", 1, 1), ("c", 2, 1)])


def test_one_plan_for_any_number_of_queries(spark, monkeypatch, capsys):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(900, [1.0] * 7), (901, None), (902, [0.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, v array<double>").repartition(3)
    queries = df.select(F.col("vec_id").alias("query_id"), "v")

    def plan(limit):
        visual.similar(df, queries.limit(limit), 5, 0.3).explain()
        return capsys.readouterr().out.count("Scan"), 0

    monkeypatch.setattr(visual, "QUERY_ROWS", 50)
    assert plan(10) == plan(300)
    got = {(r.query_id, r["rank"]): r.vec_id for r in visual.similar(df, queries, 5, 0.3).collect()}
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in vectors if x and any(x)}
    want = {}
    for i, q in v.items():
        near = sorted((-round(float(q @ u), 6), j) for j, u in v.items() if len(u) == len(q) and round(float(q @ u), 6) >= 0.3)[:5]
        want |= {(i, n + 1): j for n, (_, j) in enumerate(near)}
    assert got == want
