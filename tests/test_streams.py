"""Alerts by timers, frames as files with a restart, counts that merge, and the audit in windows."""

from __future__ import annotations

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from gridledger.operators import quality
from gridledger.streaming import alert_stream, frames, windows

START = dt.datetime(2024, 5, 1)
ROWS = "device_id bigint, at timestamp, keys array<string>"


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


def replay(spark, folder, batches: list[list[tuple]], **kept) -> list[tuple]:
    """Each batch is written, and the stream goes on from its checkpoint."""
    source, out, point = (str(folder / x) for x in ("in", "out", "point"))
    for batch in batches:
        spark.createDataFrame(batch, ROWS).coalesce(1).write.mode("append").parquet(source)
        stream = alert_stream.alert_stream(spark.readStream.schema(ROWS).parquet(source), **kept)
        stream.writeStream.format("parquet").option("checkpointLocation", point).trigger(availableNow=True).start(out).awaitTermination()
    return sorted((r["device_id"], r["at"], r["key"], r["event"]) for r in spark.read.parquet(out).collect())


def test_silence_is_told_although_the_device_sends_nothing(spark, tmp_path):
    """Device 1 falls silent and comes back; that is told while only device 2 sends, and each change once."""
    first = [(1, at(0), None), (2, at(0), None), (2, at(200), None)]
    second = [(2, at(210), None), (1, at(190), None)]
    third = [(1, at(300), None), (1, at(290), None), (2, at(301), None), (2, at(600), None)]
    got = replay(spark, tmp_path, [first, second, third], gap_minutes=60, lateness="1 minute")
    due = lambda m: at(m + 60.5)
    assert (1, due(0), "camera", "new") in got and len(set(got)) == len(got)
    per = {d: [(m, e) for x, m, _, e in got if x == d] for d in (1, 2)}
    assert [e for _, e in per[1]] == ["new", "recovered"] * (len(per[1]) // 2) + ["new"] * (len(per[1]) % 2)
    assert per[2][:2] == [(due(0), "new"), (at(200), "recovered")] and per[1][-1] == (due(300), "new")


def test_statuses_give_changes_only(spark, tmp_path):
    batches = [[(1, at(0), ["disk", "camera"]), (1, at(5), ["disk"])], [(1, at(10), ["disk"]), (1, at(15), []), (2, at(15), [])], [(1, at(20), ["ocr_ip_cu_fd"])]]
    want = [(1, at(0), "camera", "new"), (1, at(0), "disk", "new"), (1, at(5), "camera", "recovered"), (1, at(15), "disk", "recovered"), (1, at(20), "ocr_ip_cu_fd", "new")]
    assert replay(spark, tmp_path, batches) == want


def test_medians_of_counts_are_exact(spark):
    rng = random.Random(3)
    groups = {g: [rng.choice((rng.randrange(1, 100_000_000), rng.randrange(50_000, 60_000), 10_000, 9_999)) for _ in range(n)] for g, n in enumerate((1, 2, 3, 50, 51, 400))}
    rows = [(g, v) for g, values in groups.items() for v in values] + [(None, 7), (None, 8), (9, None)]
    claims = spark.createDataFrame(rows, "g bigint, cents bigint")
    counts = quality.value_counts(claims, ["g"])
    want = {g: statistics.median(v) for g, v in groups.items()} | {None: 7.5}
    assert {r["g"]: r["median"] for r in quality.medians(counts, ["g"]).collect()} == want
    listed = counts.groupBy("g").agg(F.collect_list(F.struct("value", "n")).alias("c")).select("g", quality.figures(F.col("c")).alias("f")).select("g", "f.*")
    both = [sorted(map(str, map(tuple, df.collect()))) for df in (listed, quality.consensus(claims, ["g"]))]
    assert both[0] == both[1] and len(both[0]) == 7


def test_windows_audit_takes_late_rows(spark, tmp_path):
    rng, schema = random.Random(4), "device_id bigint, captured_at timestamp_ntz, metric string, cents bigint"
    rows = [(1, START + dt.timedelta(minutes=7 * i), "ip_cu_fd", 50_000 + i + rng.choice((0, 0, 10_000))) for i in range(150)]
    order = sorted(range(150), key=lambda i: i + rng.randrange(8))  # up to 49 minutes late
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (order[:70], order[70:]):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(source)
        stream = windows.trailing_audit(spark.readStream.schema(schema).parquet(source), "2 hours")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start(out).awaitTermination()
    got = {r["window_end"]: tuple(r)[3:] for r in spark.read.parquet(out).collect()}
    whole = {r["window_end"]: tuple(r)[3:] for r in windows.trailing_audit(spark.createDataFrame(rows, schema)).collect()}
    newest = max(r[1] for r in rows) - dt.timedelta(hours=2)
    assert got == {end: f for end, f in whole.items() if end <= newest} and len(got) > 10


def test_frames_keep_their_names_and_digits(spark, tmp_path):
    cells = [(0.3, [0.6 if b == "1" else 0.05 for b in s]) for s in ("0110000", "1101101", "1111001", "1111110")]
    rows = [(3, "2024-03-01_000137_00002a.jpg", "ip_cu_fd", None, cells), (4, "2024-03-01_000138_ff.jpg", "voltage", "R", None)]
    frames.write_frames(spark.createDataFrame(rows, "device_id bigint, name string, metric string, phase string, cells array<struct<ink:double,seg:array<double>>>"), str(tmp_path / "frames"))
    stream = frames.readings(frames.frame_stream(spark, str(tmp_path / "frames")))
    query = stream.writeStream.format("memory").queryName("read_frames").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("read_frames").collect()] == [(3, 42, dt.datetime(2024, 3, 1, 0, 1, 37), "ip_cu_fd", None, 1230)]


FRAMES = "device_id bigint, name string, metric string, phase string, cells array<struct<ink:double,seg:array<double>>>"


def test_frames_are_files_of_their_devices_folder_and_few_tasks_read_them(spark, tmp_path):
    """No folder and no task for each frame; frames that Spark wrote, in a folder each, are read beside them."""
    folder, cells = tmp_path / "frames", [(0.3, [0.05] * 7)]
    rows = [(i % 3, f"2024-03-01_{i:06d}_{i:06x}.jpg", "ip_cu_fd", None, cells) for i in range(240)]
    frames.write_frames(spark.createDataFrame(rows, FRAMES), str(folder))
    found = [p for p in folder.rglob("*")]
    assert sorted(p.name for p in found if p.is_dir()) == [f"device_id={d}" for d in range(3)]
    assert sum(p.is_file() for p in found) == 240 and not [p for p in found if p.name.startswith(".")]
    frames.write_frames(spark.createDataFrame([(7, "2024-03-01_000241_0000ff.jpg", "a+b c/%3A", "R", cells), (8, "x+:%41/ y_0000fe.jpg", "m", None, None)], FRAMES), f"file://{folder}")
    frames._by_spark(spark.createDataFrame([("{\"metric\":\"m\"}", 9, "2024-03-01_000242_000100.jpg")], "value string, device_id bigint, name string"), str(folder))
    names = ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")
    before = [spark.conf.get(n) for n in names]
    with frames.small_files(spark):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder))
        assert listed.rdd.getNumPartitions() <= 8
        query = frames.frame_stream(spark, str(folder)).writeStream.format("memory").queryName("many_frames").trigger(availableNow=True).start()
        query.awaitTermination()
    assert [spark.conf.get(n) for n in names] == before
    got = {(r["device_id"], r["id"], r["metric"], r["phase"]) for r in spark.table("many_frames").collect()}
    assert got == {(i % 3, i, "ip_cu_fd", None) for i in range(240)} | {(7, 255, "a+b c/%3A", "R"), (8, 254, "m", None), (9, 256, "m", None)}
    assert spark.table("many_frames").count() == 243


def test_registers_and_ids_of_more_than_six_digits(spark, tmp_path):
    """1,000,000 and more come from 107,815 pages on."""
    from gridledger.queries import streams

    ids = [0, 1, 13, 107_814, 107_815, 107_816, 20_000_001]
    spark.createDataFrame([(i,) for i in ids], "page_id bigint").write.parquet(str(tmp_path / "pages.parquet"))
    made = streams._frames(spark, str(tmp_path))
    assert [r["n"] for r in made.orderBy("id").selectExpr("size(cells) AS n").collect()] == [6, 6, 6, 6, 7, 6, 9]
    frames.write_frames(made, str(tmp_path / "frames"))
    query = frames.readings(frames.frame_stream(spark, str(tmp_path / "frames"))).writeStream.format("memory").queryName("wide_frames").trigger(availableNow=True).start()
    query.awaitTermination()
    more = lambda i: 10_000 if i % 11 == 4 else -2_000 if i % 13 == 7 else 0
    want = [(i, (60_000 + 7 * i if i % 3 == 0 else 20_000 + 9 * i) + more(i)) for i in ids if i % 17 != 5]
    assert sorted((r["id"], r["cents"]) for r in spark.table("wide_frames").collect()) == want


def test_each_frame_comes_in_one_part(spark, monkeypatch):
    """The place where the frames are halved is approximate, so both parts go by one and the same."""
    from gridledger.queries import streams
    from tests.conftest import SF

    parts, write = [], frames.write_frames
    monkeypatch.setattr(frames, "write_frames", lambda rows, folder: (parts.append(rows), write(rows, folder)))
    streams.frame_ingest(spark, SF)
    assert len(parts) == 2 and not any("percentile" in p._jdf.queryExecution().analyzed().toString() for p in parts)
    ids = [[r["id"] for r in p.select("id").collect()] for p in parts]
    assert all(ids) and sorted(ids[0] + ids[1]) == sorted(r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id").collect())


def test_database_filters_and_ranges_reach_the_source(spark):
    import uuid

    from gridledger.queries.streams import DERBY
    from gridledger.sources import tables

    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = spark.range(1, 101).selectExpr("id", "id % 7 as device_id", "id * 10 as cents", "'x' as metric")
    rows.write.option("createTableColumnTypes", "metric varchar(8)").jdbc(url, "readings", properties={"driver": DERBY})
    got = tables.newer(spark, url, "readings", 40, 4, driver=DERBY).filter("device_id = 3").select("id", "cents")
    assert sorted(r["id"] for r in got.collect()) == [i for i in range(41, 101) if i % 7 == 3]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() == 4 and "EqualTo(device_id,3)" in plan and "GreaterThan(id,40)" in plan
    assert "metric" not in plan.split("ReadSchema")[1]
    assert tables.newer(spark, url, "readings", 500, 4, driver=DERBY).count() == 0


def test_observed_figures_of_a_stream(spark, tmp_path):
    import time

    from gridledger.jobs import observed
    from gridledger.operators import guard
    from gridledger.streaming import guard_stream
    from tests.test_guard import SCHEMA, _rows

    claims = spark.createDataFrame(_rows(120), SCHEMA)
    claims.write.parquet(str(tmp_path / "in"))
    seen = observed.Figures()
    spark.streams.addListener(seen)
    try:
        stream = observed.watched(guard_stream.guard_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))))
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start().awaitTermination()
        until = time.time() + 20
        while seen.total["rows"] < 120 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    want = observed.written(guard.guard(claims), str(tmp_path / "out"))
    assert dict(seen.total) == want and want["rows"] == 120 == spark.read.parquet(str(tmp_path / "out")).count()
