from datetime import datetime

import numpy as np
import pytest

from tidemark.streaming import stream

SCHEMA = "ts timestamp, user string, v double"


def write(spark, path, name, rows):
    spark.createDataFrame([(datetime.fromisoformat(t) if t else None, u, v) for t, u, v in rows], SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")


def source(spark, path):
    return stream.read_folder(spark, f"{path}/*", "*.parquet", SCHEMA, 1)


def test_windows_sessions_state_and_redelivery(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, "a", [("2024-01-01T10:00:00", "u", 1.0), ("2024-01-01T10:20:00", "u", 3.0), (None, "u", 9.0)])
    write(spark, folder, "b", [("2024-01-01T10:20:00", "u", 3.0), ("2024-01-01T13:00:00", "u", 5.0)])
    got = stream.run_available(stream.windowed_activity(source(spark, folder), "ts", "user", "v", "1 hour"), str(tmp_path / "w"), "complete").collect()
    assert sorted((r.start.hour, r.n, r.total) for r in got) == [(10, 3, 7.0), (13, 1, 5.0)]
    got = stream.run_available(stream.sessions(source(spark, folder), "ts", "user", "30 minutes"), str(tmp_path / "s"), "complete").collect()
    assert sorted((r.start.hour, r.end.hour, r.end.minute, r.n) for r in got) == [(10, 10, 50, 3), (13, 13, 30, 1)]
    got = stream.run_available(stream.first_delivery(source(spark, folder).where("ts is not null"), "ts", ["ts", "user"]), str(tmp_path / "d"))
    assert got.count() == 3
    got = stream.run_available(stream.running_surprise(source(spark, folder), "user", "v"), str(tmp_path / "r")).orderBy("n").collect()
    assert [r.n for r in got] == [0, 1, 2, 3, 4] and got[0]["mean"] is None


def test_late_rows_are_dropped_and_final_windows_come_once(spark, tmp_path):
    """The third delivery brings rows behind the watermark of the first (it holds from the second on) and rows within it."""
    folder = str(tmp_path / "in")
    write(spark, folder, "a", [("2024-01-01T10:00:00", "u", 1.0), ("2024-01-03T12:00:00", "u", 2.0)])
    write(spark, folder, "b", [("2024-01-03T12:10:00", "u", 3.0)])
    write(spark, folder, "c", [("2024-01-01T10:30:00", "u", 8.0), ("2024-01-03T11:00:00", "u", 4.0), ("2024-01-06T00:00:00", "u", 1.0)])
    got = stream.run_available(stream.windowed_activity(source(spark, folder), "ts", "user", "v", "1 hour"), str(tmp_path / "w")).collect()
    assert sorted((r.start.day, r.start.hour, r.n, r.total) for r in got) == [(1, 10, 1, 1.0), (3, 11, 1, 4.0), (3, 12, 2, 5.0)]
    got = stream.run_available(stream.sessions(source(spark, folder), "ts", "user", "30 minutes"), str(tmp_path / "s")).collect()
    assert sorted((r.start.day, r.start.hour, r.n) for r in got) == [(1, 10, 1), (3, 11, 1), (3, 12, 2)]
    assert not (tmp_path / "w" / "state").exists()


def test_state_in_order_of_stamps(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = 1e6 + rng.normal(size=60)
    stamps = [f"2024-01-01T10:{m:02}:00" for m in range(60)]
    rows = [(t, "u", float(v)) for t, v in zip(stamps, x)]
    folder = str(tmp_path / "in")
    write(spark, folder, "a", [rows[i] for i in rng.permutation(30)] + [(stamps[0], "w", None)])
    write(spark, folder, "b", [rows[i] for i in 30 + rng.permutation(30)])
    got = stream.run_available(stream.running_surprise(source(spark, folder), "user", "v", ["ts"]), str(tmp_path / "r")).toPandas().sort_values("n")
    assert got.v.tolist() == x.tolist() and got["mean"].to_numpy()[1:] == pytest.approx([x[:i].mean() for i in range(1, 60)], rel=1e-12)
    assert got.deviation.to_numpy()[2:] == pytest.approx([x[:i].std(ddof=1) for i in range(2, 60)], rel=1e-6) and got.head(2).deviation.isna().all()
