"""The pipeline as a stream of loads, watermarked totals, and the engine without its subpackage."""

import subprocess
import sys
from datetime import UTC, datetime
from pathlib import Path

from fleetloom.operators.classify import PROTOCOL
from fleetloom.plans import pipeline
from fleetloom.sources.inbox import with_lineage
from fleetloom.streaming import loads

ROOT = Path(__file__).resolve().parent.parent
COLUMNS = [c for c, _, _ in PROTOCOL]


def batch(spark, name, day, hours):
    rows = []
    for i, h in enumerate(hours):
        r = dict.fromkeys(COLUMNS, "") | {"TM_STAMP": f"2026-08-{day:02d} {h:02d}:00:00", "MESS_TYPE": "T2", "S/N ou IMEI": "M1", "LAT": "-3.7", "LONT": "-38.5", "SPEED": str(h)}
        rows.append((*[r[c] for c in COLUMNS], name, f"hash-{name}", i + 1))
    schema = ", ".join(f"`{c}` string" for c in COLUMNS) + ", source_file string, source_file_hash string, source_row_number bigint"
    return with_lineage(spark.createDataFrame(rows, schema), f"batch-{name}", datetime(2026, 8, day, 23, tzinfo=UTC))


def test_stream_of_loads_equals_full_rebuild(spark, tmp_path):
    lake = pipeline.Lake(spark, str(tmp_path / "lake"))
    inbox, seen = str(tmp_path / "in"), str(tmp_path / "seen")
    batch(spark, "a", 10, [1, 2]).write.mode("append").parquet(inbox)
    schema = spark.read.parquet(inbox).schema
    loads.load_stream(lake, loads.log_stream(spark, inbox, schema), seen).awaitTermination()
    assert lake.bronze.read().count() == 2
    batch(spark, "b", 11, [3]).write.mode("append").parquet(inbox)
    batch(spark, "a", 10, [1, 2]).write.mode("append").parquet(inbox)  # delivered again
    loads.load_stream(lake, loads.log_stream(spark, inbox, schema), seen).awaitTermination()
    assert lake.bronze.read().count() == 3
    stored = {n: sorted(map(tuple, t.read().collect()), key=repr) for n, t in (lake.silver | lake.gold).items()}
    pipeline.refresh_silver(lake)
    pipeline.refresh_gold(lake)
    assert {n: sorted(map(tuple, t.read().collect()), key=repr) for n, t in (lake.silver | lake.gold).items()} == stored


def test_watermarked_totals(spark, tmp_path):
    path = str(tmp_path / "in")
    batch(spark, "a", 10, [1, 2]).coalesce(1).write.mode("append").parquet(path)
    batch(spark, "b", 11, [3]).coalesce(1).write.mode("append").parquet(path)
    stream = loads.log_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    query = loads.daily_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("totals").collect())) == [("2026-08-10", "1", 2), ("2026-08-11", "1", 1)]


def test_engine_does_not_need_the_subpackage():
    """Nothing but its own modules and the entry's guarded import names it."""
    for f in (ROOT / "fleetloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "fleetloom.llm" not in f.read_text(), f
    code = (
        "import sys\nclass Gone:\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('fleetloom.llm'):\n            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nprint(sorted(k for k in e.queries() if k.startswith('p')))"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert "p2_found" in out and "p8_ids" not in out
