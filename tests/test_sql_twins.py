"""Every core query against its SQL twin, on the smallest tables and on odd hand-made logs."""

import random
from datetime import UTC, date, datetime, timedelta

import pytest
from twins import SF, compare

from fleetloom.operators.classify import PROTOCOL
from fleetloom.plans import problems, products, service
from fleetloom.sources.inbox import with_lineage

PAIRS = {k: (f, m.SQL[k]) for m in (products, problems) for k, f in m.QUERIES.items() if k in m.SQL}
ODD = {
    "DATA_SERVIDOR": ["2025-03-06 00:00:02", "", None, "2025-03-06T10:00:00Z", "junk", "2025-03-07"], "TM_STAMP": ["2025-03-06 00:00:02", "2025-03-06 00:00:02", "2025/03/06 01:00:00", None, "invalid", "2025-03-08T00:00:00.5"],
    "MESS_TYPE": ["T2", "T2", "T1", "T1", "T01", " T3 ", "X", "", None, "T"], "S/N ou IMEI": ["M1", "1", "M", " ", None, "MM1", "M2"], "REPT_TYPE": ["1.5", "2.5", "-2.5", "x", "99999999999"],
    "LAT": ["-7.5", "0", "91", "724001234567890", None, "nan", "-0.0", "0.0"], "LONT": ["1", "0", "181", "359881234567890", "", "inf"], "BAT_VOLT": ["12.5", "89550500000000000001", "1d", "1_2"],
    "SPEED": ["0", "5", "4.999", "", "-0.0", "0.0"], "HDOP": ["5", "5.1", "", "1"], "ODO_TOTAL": ["10", "5", "", "7"], "SER_COUNT": ["1", "2.5", "n/a", ""], "LOC_STATUS": ["A", ""], "PRT_VER": ["1", "", "2"], "INT_BATT": ["4.1", "8.0125", ""],
}


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    rng, folder = random.Random(11), tmp_path_factory.mktemp("odd")
    columns = [c for c, _, _ in PROTOCOL]
    parts = None
    for b in range(3):
        rows = [(*[rng.choice(ODD.get(c, [""])) for c in columns], rng.choice(["f1.csv", "f2.csv"]), f"h{rng.randrange(3)}", i) for i in range(150)]
        df = with_lineage(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns) + ", source_file string, source_file_hash string, source_row_number bigint"), f"b{b}", datetime(2025, 3, 6, tzinfo=UTC) + timedelta(days=b))
        parts = df if parts is None else parts.unionByName(df)
    parts.dropDuplicates(["batch_id", "row_id"]).coalesce(1).write.parquet(str(folder / "tracker_logs.parquet"))
    spark.createDataFrame([("h0", "SUCCESS"), ("h9", "SUCCESS"), ("h1", "FAILED")], "source_file_hash string, status string").write.parquet(str(folder / "ingestion_files.parquet"))
    return folder


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(PAIRS))
def test_twin(spark, name):
    compare(spark, *PAIRS[name], SF)


@pytest.mark.parametrize("name", sorted(k for k in PAIRS if k in products.QUERIES and k not in ("daily_summary_of_silver", "api_quality", "api_daily", "api_route")))
def test_twin_on_odd_logs(spark, odd_tables, name):
    compare(spark, *PAIRS[name], odd_tables)


# the twins of api_daily and api_route carry a period; without it they are those of all days
@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize(("name", "period"), [("api_daily", "event_date BETWEEN '2025-02-01' AND '2025-02-14'"), ("api_route", "event_date = '2025-02-01'")])
def test_all_days(spark, name, period):
    assert period in products.SQL[name]
    compare(spark, products.QUERIES[f"{name}_all"], products.SQL[name].replace(period, "true"), SF)


def test_date_filters(spark):
    days = [f"2024-11-{d:02}" for d in (1, 2, 3, 4)]
    table = spark.createDataFrame([(d, s, 1.0, 2.0) for d in days for s in ("1", "2")] + [(days[0], "3", 0.0, 0.0), (days[0], "4", None, 1.0)], "event_date string, device_serial string, latitude double, longitude double")
    of = lambda df: sorted({r["event_date"] for r in df.collect()})
    first, last = date(2024, 11, 2), date(2024, 11, 3)
    assert of(service.daily_rows(table)) == days and of(service.daily_rows(table, first)) == days[1:] and of(service.daily_rows(table, None, last)) == days[:3]
    assert of(service.daily_rows(table, first, last)) == days[1:3] and service.daily_rows(table, first, first, "1").count() == 1
    assert of(service.route_rows(table, None)) == days and service.route_rows(table, None).count() == 8
    assert of(service.route_rows(table, first)) == days[1:2] and service.route_rows(table, date(2024, 11, 1)).count() == 2
