import pytest

from nearfield.errors import NotFound
from nearfield.operators import keymap


def table(spark, pairs):
    return spark.createDataFrame(pairs, keymap.SCHEMA)


def pairs(df):
    return [tuple(r) for r in df.select("key", "value").collect()]


def test_upsert_replaces(spark):
    got = keymap.upsert(keymap.upsert(keymap.empty(spark), table(spark, [(10, 100)])), table(spark, [(10, 200), (11, 1)]))
    assert keymap.value_of(got, 10) == 200 and keymap.count(got) == 2


def test_ranges(spark):
    rows = table(spark, [(i, 100 * i) for i in range(20)])
    assert [k for k, _ in pairs(keymap.range_query(rows, 5, 10))] == [5, 6, 7, 8, 9, 10]
    assert pairs(keymap.range_query(rows, 10, 5)) == []
    assert pairs(keymap.range_query(table(spark, [(1, 1), (5, 5), (10, 10)]), 6, 9)) == []
    assert len(pairs(keymap.range_query(rows, -100, 100))) == 20


def test_find_and_remove(spark):
    rows = table(spark, [(1, 10), (2, 20), (3, 30)])
    left = keymap.remove(rows, table(spark, [(2, 0)]))
    assert not keymap.contains(left, 2) and keymap.contains(left, 3) and keymap.count(left) == 2
    with pytest.raises(NotFound):
        keymap.value_of(left, 2)
    with pytest.raises(NotFound):
        keymap.remove(left, table(spark, [(2, 0)]), strict=True)


def test_many_keys_and_storage(spark, tmp_path):
    path = str(tmp_path / "map")
    keymap.save(keymap.remove(table(spark, [(i, 7 * i) for i in range(1000)]), table(spark, [(20, 0)])), path)
    again = keymap.load(spark, path)
    assert keymap.value_of(again, 999) == 6993 and not keymap.contains(again, 1000) and not keymap.contains(again, 20)
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,5)]" in keymap.find(again, 5)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(NotFound):
        keymap.load(spark, str(tmp_path / "none"))
