"""CSV by ranges against a reader of whole files."""

import csv
import io
import random

import pytest

from fileloom.sources import csvranges, listings


def whole(data, columns):
    rows = [r for r in csv.reader(io.StringIO(data, newline=""), quoting=csv.QUOTE_NOTNULL) if r]
    names = rows[0]
    return [tuple(r[names.index(c)] if c in names and names.index(c) < len(r) else None for c in columns) for r in rows[1:]]


def made(rng, n, odd):
    texts = ["", "plain", 'say "hi"', "two\nlines", "a,b", '"', "\n\n", 'x"\n"y', "é", "long " * 30, ",\n,", "\r\n"]
    lines = ["id,name,note"]
    for i in range(n):
        fields = [str(i)]
        for _ in range(rng.choice([1, 2, 2, 2, 3])):
            t = rng.choice(texts)
            fields.append('"' + t.replace('"', '""') + '"' if rng.random() < 0.3 or any(c in t for c in '",\n\r') else t)
        if odd and rng.random() < 0.2:
            fields[1] = rng.choice(['5" pipe', 'a"b"c', '"quoted"tail', '"', 'x"'][: 3 if odd == 1 else 5])
        lines.append(",".join(fields))
    return rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("odd", [0, 1, 2])
def test_how_ranges_end(odd):
    rng = random.Random(odd)
    for _ in range(300):
        data = made(rng, 8, odd).encode()
        at = sorted(rng.randrange(len(data)) for _ in range(2))
        piece = data[at[0] : at[1]]
        ends = []
        for inside in (False, True):  # the automaton, a byte at a time
            state = "in" if inside else "start"
            for c in piece:
                if state == "start":
                    state = "in" if c == 34 else "start" if c in b",\n" else "field"
                elif state == "field":
                    state = "start" if c in b",\n" else "field"
                elif state == "in":
                    state = "quote" if c == 34 else "in"
                else:
                    state = "in" if c == 34 else "start" if c in b",\n" else "field"
            ends.append(state == "in")
        assert csvranges.how_it_ends(piece) == tuple(ends), piece


@pytest.mark.parametrize("odd", [0, 1])
def test_ranges_equal_a_whole_read(spark, tmp_path, odd):
    rng = random.Random(10 + odd)
    columns = ["id", "note", "lacking", "name"]
    want = []
    for k in range(3):
        data = made(rng, 300, odd)
        (tmp_path / f"{k}.csv").write_bytes(("﻿" if k == 1 else "").encode() + data.encode())
        want += whole(data, columns)
    (tmp_path / "empty.csv").write_bytes(b"")
    for size in (64, 1000, 1 << 20):
        got = csvranges.read_ranges(spark, str(tmp_path), columns, range_bytes=size)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), size


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    with open(tmp_path / "l.csv", "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["id", "text"])
        out.writerows((i, f'line {i}\nand "more", too\n' * (i % 5)) for i in range(60_000))
    got = csvranges.read_ranges(spark, str(tmp_path / "l.csv"), ["id", "text"], range_bytes=200_000)
    assert got.select(F.spark_partition_id()).distinct().count() > 8
    plain = spark.read.csv(str(tmp_path / "l.csv"), header=True, multiLine=True, escape='"')
    sums = lambda df: df.agg(F.count("*"), F.sum(F.col("id").cast("long")), F.sum(F.length("text")), F.sum(F.xxhash64("id", "text") % 1_000_003)).first()
    assert tuple(sums(got)) == tuple(sums(plain))


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id,text\n" + "".join(f'{i},"line\n{i}"\n' for i in range(5000)))
    got = csvranges.read_ranges(spark, str(tmp_path / "l.csv"), ["id", "text"], range_bytes=100)
    assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted((int(r.id), r.text) for r in got.collect()) == [(i, f"line\n{i}") for i in range(5000)]


def test_a_listing_is_asked_for_again(spark, tmp_path):
    path, asked = tmp_path / "l.csv", []

    def again():
        asked.append(1)
        path.write_text("id,name\n" + ("1,a\n" if len(asked) == 2 else ""))

    read = lambda **how: listings.csv_listing(spark, str(path), ["id", "name"], wait=0.0, **how)
    assert read().count() == 0 and not asked  # nothing is expected
    assert read(expect_rows=True, retries=1, again=again).count() == 0 and len(asked) == 1
    assert [tuple(r) for r in read(expect_rows=True, retries=3, again=again).collect()] == [("1", "a")] and len(asked) == 2
