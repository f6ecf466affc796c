"""Functions, checks and sinks that no query shows, on known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays as A
from quillon.functions import dsp
from quillon.operators import metrics, partition
from quillon.sources import audio, sinks


def value(spark, column, **columns):
    df = spark.range(1)
    for n, v in columns.items():
        df = df.withColumn(n, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(float(x)) for x in v]))
    return df.select(column.alias("v")).first().v


def test_levels_and_bands(spark):
    assert value(spark, A.to_db(F.col("x")), x=0.1) == pytest.approx(-20, abs=1e-6) and value(spark, A.to_db(F.col("x")), x=0.0) == pytest.approx(-200)
    # ten bins of 100 Hz at 2,000 samples a second: the largest within 60 to 600 Hz, though others are larger
    mags = [9, 1, 2, 5, 1, 1, 1, 8, 0, 0]
    assert value(spark, A.fundamental(F.col("m"), 2000.0), m=mags) == pytest.approx(300)
    assert value(spark, A.band_ratio(F.col("m"), 2000.0), m=[5, 0, 0, 0, 0, 0, 0, 0, 0, 0]) == 0
    assert value(spark, A.band_ratio(F.col("m"), 2000.0), m=mags) == pytest.approx((1 + 4 + 25 + 1 + 1 + 1) / (1 + 4 + 25 + 1 + 1 + 1 + 64))
    hann = value(spark, A.hann(8))
    assert hann == pytest.approx([0.5 - 0.5 * math.cos(2 * math.pi * i / 8) for i in range(8)]) and hann[0] == 0


def test_series_functions(spark):
    x = [1, -2, 3, 0.5]
    assert value(spark, A.tilt(F.col("x"), 0.25), x=x) == pytest.approx([0.25, 0.75 * 0.25 - 0.5, 0.75 * (0.75 * 0.25 - 0.5) + 0.75, 0.75 * (0.75 * (0.75 * 0.25 - 0.5) + 0.75) + 0.125])
    got = value(spark, A.add_noise(F.col("x"), 0.1, 7, F.lit("k")), x=[float(i % 9) for i in range(400)])
    noise = np.array(got) - np.array([float(i % 9) for i in range(400)])
    sd = np.std([i % 9 for i in range(400)])
    assert abs(noise.mean()) < 0.05 * sd and 0.08 * sd < noise.std() < 0.12 * sd
    assert got == value(spark, A.add_noise(F.col("x"), 0.1, 7, F.lit("k")), x=[float(i % 9) for i in range(400)])


def test_times_sides_and_levels(spark):
    assert [value(spark, A.to_ticks(F.col("s"), 500), s=s) for s in (0.0, 0.74, 0.76, 1.25, 10.0)] == [0, 1, 2, 2, 20]  # halves to even
    assert value(spark, A.tick_end(F.col("t")), t=7) == 4.5
    assert [value(spark, A.intensity(F.col("v")), v=v) for v in (-1, 1, 2, 3, 9)] == [0.2, 0.2, 0.4, 0.7, 0.7]
    assert (A.max_lag(0.06, 16000), A.max_lag(0.1, 16000), A.max_lag(0.0, 16000)) == (4, 6, 1)
    assert [value(spark, A.saturated_sigmoid(F.col("x")), x=x) for x in (10.5, -10.5)] == [1.0, 0.0]
    assert value(spark, A.saturated_sigmoid(F.col("x")), x=-10.0) == pytest.approx(1 / (1 + math.exp(10)))


def test_upper_bound_of_a_rate():
    assert metrics.clopper_pearson_upper(0, 100) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9) and metrics.clopper_pearson_upper(5, 5) == 1.0
    x = metrics.clopper_pearson_upper(3, 50)
    assert sum(math.comb(50, i) * x**i * (1 - x) ** (50 - i) for i in range(4)) == pytest.approx(0.05, abs=1e-9)


def test_specs_are_told_apart():
    specs = [dsp.SPEC_1, dsp.MAGNITUDE, dsp.POWER, dsp.TOP_DB, dsp.WHOLE_BINS]
    dicts = [dsp.spec_dict(s) for s in specs]
    assert len({d["version"] for d in dicts}) == 5 and all(dsp.FeatureSpec(**d) == s for d, s in zip(dicts, specs))


def test_the_test_split_needs_leave(spark):
    df = spark.createDataFrame([(1, "test"), (2, "train"), (3, "test")], "id int, split string")
    with pytest.raises(partition.TestSplitAccess):
        partition.select_split(df, "test")
    assert partition.select_split(df, "train").count() == 1 and partition.select_split(df, "test", allow_test=True).count() == 2


def test_manifests_and_spans(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "x"), (1, "a,\"q\"", None)], "id int, path string, more string")
    sinks.write_manifest(df, str(tmp_path / "m"), ["path", "id"])
    assert sorted(map(tuple, spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "m")).collect())) == [("a,\"q\"", "1"), ("b", "2")]
    head = "chunk,start_s,end_s,label,side,posture,distance_m,pillow\n"
    good = head + "a.wav,0,2,yes,left,supine,0.8,thin\na.wav,2,3,no,,,,\nb.wav,1,2,yes,right,,0.5,\n"
    for name, text in (("good", good), ("label", good + "b.wav,5,6,maybe,,,,\n"), ("empty", good + "b.wav,5,5,yes,,,,\n"), ("overlap", good + "a.wav,1,1.5,no,,,,\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    rows = audio.read_spans(spark, str(tmp_path / "good.csv"), ["yes", "no"]).collect()
    assert [(r.chunk, r.start_s, r.end_s, r.label, r.side, r.distance_m) for r in rows][0] == ("a.wav", 0.0, 2.0, "yes", "left", 0.8) and len(rows) == 3
    for name in ("label", "empty", "overlap"):
        with pytest.raises(ValueError):
            audio.read_spans(spark, str(tmp_path / f"{name}.csv"), ["yes", "no"])
