import random
from datetime import date

from pyspark.sql import functions as F

from roadloom.operators.intervals import minute_of_day, p1_found, periods_and_gaps


def brute(rows):
    out = []
    for e in {r[0] for r in rows if r[0] is not None}:
        covered = sorted((a, z) for k, a, z in rows if k == e and a is not None and z is not None and a < z)
        merged = []
        for a, z in covered:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        out += [("period", e, a, z) for a, z in merged] + [("gap", e, p[1], q[0]) for p, q in zip(merged, merged[1:])]
    return sorted(out)


def test_against_brute_force(spark):
    rng, rows = random.Random(4), []
    for _ in range(400):
        a, n = rng.randrange(6000), rng.choice([None, -3, 0, 1, 5, 60, 2000])
        rows.append((rng.choice(["a", "b", "c", None]), a if rng.random() > 0.05 else None, None if n is None else a + n))
    df = spark.createDataFrame(rows, "k string, a bigint, z bigint")
    got = sorted(map(tuple, periods_and_gaps(df, F.col("k"), F.col("a"), F.col("z"), 1000).collect()))
    assert got == brute(rows)


def test_spellings_and_days(spark):
    d = date(1970, 1, 2)
    rows = [("s1", d, "00:10", "00:20"), (" S1 ", d, "0.20", "0h30"), ("S1", d, "2350", "24:00"), ("S1", d, "23:59:10", "0:05"), ("S1", d, "10:00", "10:00"), ("S1", d, "25:10", "11:00"), ("S1", None, "10:00", "11:00"), ("S1", d, None, "11:00"), ("S1", d, "24:00", "01:00"), ("", d, "1:00", "2:00"), (None, d, "1:00", "2:00")]
    df = spark.createDataFrame(rows, "id_link_set string, event_day date, start_hm string, end_hm string").withColumn("kind", F.lit("extra")).withColumn("entity", F.lit(1))
    assert sorted(map(tuple, p1_found(df).collect())) == [("gap", "S1", 1470, 2870), ("period", "S1", 1450, 1470), ("period", "S1", 2870, 2885)]
    assert p1_found(df.limit(0)).count() == 0


def test_minutes(spark):
    df = spark.createDataFrame([(t,) for t in ["07:05", "7h05", " 7.05 ", "0705", "07:05:59", "24:00", "12:75", "--:--", "n/a", "", None]], "t string")
    assert [r[0] for r in df.select(minute_of_day(F.col("t"))).collect()] == [425, 425, 425, 425, 425, None, None, None, None, None, None]
    assert [r[0] for r in df.select(minute_of_day(F.col("t"), True)).collect()][5] == 1440
