"""Store-backed queries against their SQL twins, and writers that race."""

import pytest
from twins import SF, compare

from fleetloom.plans import stored
from fleetloom.sources.store import Table


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(stored.QUERIES))
def test_twin(spark, name):
    compare(spark, stored.QUERIES[name], stored.SQL[name], SF)


def test_a_key_comes_in_once_under_a_race(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    table, other = Table(spark, str(tmp_path)), Table(spark, str(tmp_path))
    table.append(rows(("a", 1)))
    real, raced = Table.publish, []

    def publish(self, staged, *args, **kwargs):
        if not raced:
            raced.append(True)
            other.merge_insert(rows(("b", 2), ("d", 4)), "k")
        return real(self, staged, *args, **kwargs)

    monkeypatch.setattr(Table, "publish", publish)
    got = table.merge_insert(rows(("a", 7), ("b", 9), ("c", 3)), "k")
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert (got["row_count"], got["inserted_row_count"], got["duplicate_row_count"]) == (3, 1, 2)
    # the same where the other writer rewrote the table meanwhile
    raced.clear()
    monkeypatch.setattr(other, "merge_insert", lambda df, key: other.overwrite(rows(("z", 0), ("e", 5))))
    table.merge_insert(rows(("e", 6), ("f", 1)), "k")
    assert sorted(map(tuple, table.read().collect())) == [("e", 5), ("f", 1), ("z", 0)]


def test_a_token_publishes_once(spark, tmp_path):
    table = Table(spark, str(tmp_path))
    staged = table.stage(spark.createDataFrame([("a", 1)], "k string, v int"))
    assert table.publish(staged, "t").version == table.publish(staged, "t").version == 0 and table.read().count() == 1
