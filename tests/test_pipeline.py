"""Files to curated tables: every stored table against a full rebuild."""

import os
from datetime import UTC, date, datetime

import pytest

from fleetloom.plans import pipeline
from fleetloom.plans.service import Service
from fleetloom.sources import inbox
from fleetloom.sources.store import Conflict, Table

AT = datetime(2026, 8, 10, 13, tzinfo=UTC)


def message(**more):
    row = {
        "DATA_SERVIDOR": "2026-08-10 10:00:00", "TM_STAMP": "2026-08-10 10:00:00", "MESS_TYPE": "T2", "S/N ou IMEI": "M123456789", "BAT_VOLT": "12.5", "LAT": "-3.7319",
        "LONT": "-38.5267", "SPEED": "42", "DIR": "180", "INT_BATT": "4.1", "ODO_TRIP": "10", "ODO_TOTAL": "1000", "HORIMETER": "20", "HDOP": "1.2", "SER_COUNT": "10",
    }
    return row | more


IDENTITY = message(MESS_TYPE="T1", BAT_VOLT="89550500000000000001", LOC_STATUS="IDENTITY", LAT="724001234567890", LONT="359881234567890")
NO_TIME = message(DATA_SERVIDOR="", TM_STAMP="invalid")


@pytest.fixture
def lake(spark, tmp_path):
    return pipeline.Lake(spark, str(tmp_path / "lake")), inbox.Folders.under(tmp_path / "raw")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sequence_of_files_equals_full_rebuild(lake, spark):
    lake, folders = lake
    assert pipeline.run(lake, folders).status == "NOOP"
    inbox.write_csv(folders.inbox / "a.csv", [message(), message(TM_STAMP="2026-08-11 10:00:00", SER_COUNT="11", ODO_TOTAL="900"), IDENTITY, NO_TIME])
    first = pipeline.run(lake, folders, AT)
    assert first.status == "SUCCESS" and first.silver.mode == "FULL" and first.gold.mode == "FULL"
    assert first.bronze.inserted_row_count == 4 and first.silver.rejection_dates == ("unknown",)
    # a late row of a known day, another device, and a header with one more column in another order
    inbox.write_csv(folders.inbox / "b.CSV", [message(TM_STAMP="2026-08-10 11:00:00", SER_COUNT="12"), message(**{"S/N ou IMEI": "77", "TM_STAMP": "2026-08-10 11:30:00"})], [*inbox.REQUIRED[::-1], "EXTRA"])
    second = pipeline.run(lake, folders, AT)
    assert second.silver.mode == "INCREMENTAL" and second.silver.event_dates == ("2026-08-10",) and second.gold.mode == "INCREMENTAL"
    assert "EXTRA" in lake.bronze.read().columns and lake.bronze.read().count() == 6
    # the same bytes again
    inbox.write_csv(folders.inbox / "c.csv", [message(), message(TM_STAMP="2026-08-11 10:00:00", SER_COUNT="11", ODO_TOTAL="900"), IDENTITY, NO_TIME])
    assert pipeline.run(lake, folders, AT).status == "NOOP"
    assert not list(folders.inbox.iterdir()) and len(list(folders.archive.iterdir())) == 3
    status = [r[0] for r in lake.control.read().orderBy("recorded_at").select("status").collect()]
    assert sorted(status) == ["PROCESSING", "PROCESSING", "SKIPPED", "SUCCESS", "SUCCESS"]
    stored = {n: rows(t.read()) for n, t in (lake.silver | lake.gold).items()}
    pipeline.refresh_silver(lake)
    pipeline.refresh_gold(lake)
    assert {n: rows(t.read()) for n, t in (lake.silver | lake.gold).items()} == stored
    assert sum(len(stored[n]) for n in pipeline.SILVER) == 6


def test_empty_silver_tables_keep_their_types(lake):
    lake, folders = lake
    inbox.write_csv(folders.inbox / "a.csv", [message()])
    pipeline.run(lake, folders, AT)
    assert lake.silver["rejected_logs"].read().count() == 0
    assert dict(lake.silver["rejected_logs"].read().dtypes)["server_timestamp"] == "timestamp_ntz"
    assert pipeline.refresh_silver(lake, []).mode == "NOOP"
    assert pipeline.refresh_gold(lake, [], []).mode == "NOOP"


@pytest.mark.parametrize(
    ("text", "reason"),
    [("", "empty"), ("\n\n", "no header"), ("a,b\n1,2,3\n", "fields"), ('a,b\n"x,2\n', "inconsistent"), ("a,b\n1,2\n", "missing"), ("a,a\n1,2\n", "twice")],
)
def test_unsound_files_are_quarantined(lake, text, reason):
    lake, folders = lake
    (folders.inbox / "x.csv").write_text(text)
    assert pipeline.run(lake, folders).status == "NOOP"
    report = (folders.quarantine / "x.csv.error.txt").read_text().split("\n")
    assert len(report) == 7 and reason in report[2] and (folders.quarantine / "x.csv").exists()
    assert [r[0] for r in lake.control.read().orderBy("recorded_at").select("status").collect()] == ["PROCESSING", "FAILED"]


def test_reserved_column_latin_and_quotes(lake):
    lake, folders = lake
    inbox.write_csv(folders.inbox / "r.csv", [message()], [*inbox.REQUIRED, "source_file"])
    text = ",".join(inbox.REQUIRED) + "\n" + ",".join(['"x ""y"", z"' if c == "DRIVER_ID" else "café" if c == "PASS_ID" else "NA" if c == "MCC" else "" for c in inbox.REQUIRED]) + "\n\n\n1,2\n"
    (folders.inbox / "l.csv").write_bytes(text.encode("latin-1"))
    pipeline.run(lake, folders, AT)
    assert (folders.quarantine / "r.csv").exists()
    got = lake.bronze.read().orderBy("source_row_number").collect()
    assert [r["source_row_number"] for r in got] == [1, 2]
    assert (got[0]["DRIVER_ID"], got[0]["PASS_ID"], got[0]["MCC"], got[1]["TM_STAMP"], got[1]["MCC"]) == ('x "y", z', "café", "NA", "2", "")


def test_header_only_file_is_sound(lake):
    lake, folders = lake
    inbox.write_csv(folders.inbox / "h.csv", [])
    assert pipeline.run(lake, folders).status == "NOOP" and (folders.archive / "h.csv").exists()


def test_hash_and_control_checks(tmp_path):
    f = tmp_path / "f"
    f.write_bytes(b"abc")
    assert inbox.file_hash(f, 1) == inbox.file_hash(f)
    with pytest.raises(ValueError):
        inbox.file_hash(f, 0)
    for bad in ({"status": "X"}, {"row_count": -1}, {"batch_id": " "}, {"finished_at": datetime(2020, 1, 1)}):
        with pytest.raises(ValueError):
            inbox.control_event(**{"batch_id": "b", "source_file": "f", "digest": None, "status": "SUCCESS", "started_at": AT} | bad)


def test_store_partitions(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.read()
    make = lambda *r: spark.createDataFrame(list(r), "event_date string, value bigint")
    t.overwrite(make(("08-10", 1), ("08-11", 2), ("a/b =c", 3)), "event_date")
    assert t.partitions() == ["08-10", "08-11", "a/b =c"]
    t.replace_where(make(("08-10", 99), ("08-12", 5)), ["08-10"])
    assert rows(t.read()) == [("08-10", 99), ("08-11", 2), ("a/b =c", 3)]
    t.replace_where(make(), ["08-11"])
    assert rows(t.read(partitions=["a/b =c", "08-11"])) == [("a/b =c", 3)]
    t.delete_where(["08-10", "a/b =c"])
    assert t.read().count() == 0 and t.read().dtypes == [("event_date", "string"), ("value", "bigint")]
    assert rows(t.read(version=0)) == [("08-10", 1), ("08-11", 2), ("a/b =c", 3)]
    assert t.vacuum() > 0


def test_store_merges(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    make = lambda *r: spark.createDataFrame(list(r), "k string, v bigint")
    assert t.merge_insert(make(("a", 1), ("b", 2), ("b", 2)), "k")["duplicate_row_count"] == 1
    assert t.merge_insert(make(("b", 9), ("c", 3)), "k") == {"operation": "MERGE", "row_count": 2, "inserted_row_count": 1, "duplicate_row_count": 1}
    assert t.merge_upsert(make(("a", 7), ("d", 4)), "k") == 2
    assert t.merge_upsert(make(), "k") == 0
    assert rows(t.read()) == [("a", 7), ("b", 2), ("c", 3), ("d", 4)]
    t.append(spark.createDataFrame([("e", "x")], "k string, extra string"))
    assert rows(t.read().where("k >= 'd'")) == [("d", 4, None), ("e", None, "x")]
    # a lock that a lost writer left behind is broken once it is old
    lock = tmp_path / "t" / "_log" / f"{t.manifest().version + 1:020d}.json.lock"
    lock.touch()
    os.utime(lock, (0, 0))
    t.append(make(("z", 0)))
    assert not lock.exists()
    # a writer that lost the race tries again on the winner's version
    stale = t.manifest()
    assert not t.files.create(t._log(stale.version), "{}")
    real = t.manifest
    t.manifest = lambda version=None: stale if version is None else real(version)
    t.append(make(("f", 6)))
    other = Table(spark, t.path)
    t.manifest = real
    base = t.manifest
    t.manifest = lambda version=None: base(version) if version is not None else (other.append(make(("g", 1))), base())[1]
    with pytest.raises(Conflict):
        t.merge_upsert(make(("a", 0)), "k")


def test_service(lake):
    lake, folders = lake
    service = Service(lake)
    assert service.ready()[0] == 503 and service.health() == (200, {"status": "ok"})
    inbox.write_csv(folders.inbox / "a.csv", [message(), message(TM_STAMP="2026-08-10 10:05:00", LAT="-3.74", SER_COUNT="11", SPEED="50"), NO_TIME])
    pipeline.run(lake, folders, AT)
    day = date(2026, 8, 10)
    assert service.ready()[0] == 200 and len(service.index()[1]["routes"]) == 7
    assert service.quality()[1]["count"] == 2 and service.quality()[1]["items"][-1]["metric_date"] == "unknown"
    assert service.quality(date_from=day)[1]["count"] == 1 and service.quality(day, date(2026, 1, 1))[0] == 422
    assert service.quality_of(" UNKNOWN ")[1]["rejection_percentage"] == 100.0
    assert service.quality_of("x")[0] == 422 and service.quality_of("2020-01-01")[0] == 404
    assert service.daily(device_serial=" ")[1]["items"][0]["message_count"] == 2
    assert service.daily_of(day)[0] == 200 and service.daily_of(date(2020, 1, 1))[0] == 404
    status, body = service.route(day)
    assert status == 200 and body["features"][0]["geometry"]["coordinates"] == [[-38.5267, -3.7319], [-38.5267, -3.74]] and body["features"][0]["properties"]["maximum_speed"] == 50.0
    assert service.route(day, "nobody")[0] == 404
    inbox.write_csv(folders.inbox / "b.csv", [message(**{"S/N ou IMEI": "9"})])
    pipeline.run(lake, folders, AT)
    page = service.daily(page_size=1)[1]
    rest = service.daily(page_size=5, after=tuple(page["next"]))[1]
    assert [*page["items"], *rest["items"]] == service.daily()[1]["items"] and page["count"] == 1 and rest["next"] is None and service.daily(page_size=0)[0] == 422
    assert service.cross_origin("http://localhost:5173")["Access-Control-Allow-Origin"] == "http://localhost:5173" and service.cross_origin("http://elsewhere") == service.cross_origin(None) == {}
    assert service.route(day)[0] == 409 and service.daily_of(day)[0] == 409 and service.route(day, "9")[0] == 422
    with pytest.raises(ValueError, match="dim_device"):
        service.table("x")


def test_plain_lane(spark, tmp_path):
    inbox.write_csv(tmp_path / "a.csv", [message(), IDENTITY, NO_TIME])
    paths = pipeline.full_refresh(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"))
    assert spark.read.parquet(paths["device_daily_summary"]).count() == 1 and spark.read.parquet(paths["dim_device"]).count() == 1
    days = spark.read.schema("event_date date").parquet(paths["telemetry_events"])
    assert [r[0] for r in days.collect()] == [date(2026, 8, 10)] and dict(spark.read.parquet(paths["device_last_position"]).dtypes)["last_position_date"] == "date"
    assert spark.read.parquet(pipeline.full_refresh(spark, str(tmp_path / "a.csv"), str(tmp_path / "typed"), infer=True)["device_daily_summary"]).count() == 1
