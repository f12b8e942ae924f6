import os

import numpy as np
import pytest

from gridloom.sources import raw


def values(df, shape, column="v"):
    rows = df.toPandas()
    assert len(rows) == np.prod(shape)
    out = np.full(shape, np.nan)
    out[rows["i0"], rows["i1"], rows["i2"]] = rows[column]
    return out


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    shape = (20, 30, 40)
    want = np.random.default_rng(0).normal(size=shape)
    want.ravel("F").astype("<f8").tofile(tmp_path / "a.raw")
    df = raw.read(spark, str(tmp_path / "a.raw"), shape, split_bytes=10_000)
    assert df.rdd.getNumPartitions() == 20  # 24 000 values of 8 bytes in ranges of 1 250
    assert np.array_equal(values(df, shape), want)
    want.ravel("F").astype(">f4").tofile(tmp_path / "b.raw")
    assert np.allclose(values(raw.read(spark, f"file://{tmp_path}/b.raw", shape, ">f4"), shape), want.astype("f4"))
    with pytest.raises(Exception, match="not"):
        raw.read(spark, str(tmp_path / "a.raw"), (20, 30, 41)).count()


@pytest.mark.parametrize("single", [False, True])
def test_round_trip_in_parts(spark, tmp_path, single):
    shape = (6, 5, 11)
    want = np.random.default_rng(1).normal(size=shape)
    want[2, 3, 4] = 0
    rows = [(int(i), int(j), int(k), float(v)) for (i, j, k), v in np.ndenumerate(want) if v]
    df = spark.createDataFrame(rows, "i0 int, i1 int, i2 int, v double").repartition(4)
    path = str(tmp_path / "field")
    raw.write(df, path, shape, single, part_bytes=6 * 5 * 8 * 3)
    planes = 6 if single else 3
    assert sorted(os.listdir(path)) == ["field.json", *(f"part-{k:06d}" for k in range(-(-11 // planes)))]
    assert os.path.getsize(f"{path}/part-000000") == 6 * 5 * planes * (4 if single else 8)
    got = values(raw.read(spark, path, split_bytes=100), shape)
    assert np.array_equal(got, want.astype("f4") if single else want)
    with pytest.raises(Exception, match="holds a field"):
        raw.write(df, path, shape)


def test_spectrum_has_files_of_both_parts(spark, tmp_path):
    shape = (3, 2, 4)
    df = spark.createDataFrame([(1, 1, 3, 2.5, -1.5)], "i0 int, i1 int, i2 int, re double, im double")
    path = str(tmp_path / "spectrum")
    raw.write(df, path, shape, part_bytes=1)
    assert sorted(os.listdir(path))[1:] == [f"part-{k:06d}_{p}" for k in range(4) for p in ("imag", "real")]
    back = raw.read(spark, path)
    assert back.columns[-2:] == ["re", "im"] and back.count() == 24
    assert [(r["i0"], r["i1"], r["i2"], r["re"], r["im"]) for r in back.where("re <> 0 or im <> 0").collect()] == [(1, 1, 3, 2.5, -1.5)]


def test_planes_without_points_and_no_points_at_all(spark, tmp_path):
    df = spark.createDataFrame([], "i0 int, i1 int, i2 int, v double")
    raw.write(df, str(tmp_path / "none"), (2, 2, 3), part_bytes=1)
    assert not values(raw.read(spark, str(tmp_path / "none")), (2, 2, 3)).any()


def test_attempts_leave_nothing(spark, tmp_path):
    """A task that fails after it has stored a part, and an aborted write, leave neither parts nor a header."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "broken")
    df = spark.range(8).select(F.lit(0).alias("i0"), F.lit(0).alias("i1"), F.col("id").cast("int").alias("i2"), F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("double")).otherwise(1.0).alias("v"))
    with pytest.raises(Exception, match="lost"):
        raw.write(df, path, (1, 1, 8), part_bytes=1)
    assert not os.path.exists(path) or os.listdir(path) == []
