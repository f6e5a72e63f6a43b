import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import errors as E
from nearfield.cli import main
from nearfield.config import Config, Index, Metric, OpenMode
from nearfield.sources.collection import Collection
from nearfield.streaming.ingest import apply_changes, ingest

NEW = OpenMode.READWRITE | OpenMode.CREATE


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/c"


def rows(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in v], m) for i, v, m in data], "id long, vector array<float>, metadata string")


def made(spark, path, index=Index.FLAT, **options):
    c = Collection.open(spark, path, NEW, Config(2, index=index, **options))
    c.insert(rows(spark, [(i, (i, 0), json.dumps({"n": i, "odd": i % 2 == 1})) for i in range(1, 21)]))
    return c


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("index", [Index.FLAT, Index.HNSW])
def test_life(spark, path, index):
    with made(spark, path, index) as c:
        if index is Index.HNSW:
            c.build_index()
        assert c.count() == 20 and c.exists(7) and not c.exists(77)
        assert ids(c.search((0, 0), 3)) == [1, 2, 3]
        assert ids(c.search((0, 0), 3, "odd AND n > 4")) == [5, 7, 9]
        assert ids(c.search((0, 0), 50)) == list(range(1, 21))
        c.delete([1, 3, 999])
        assert ids(c.search((0, 0), 3)) == [2, 4, 5] and c.get(1) is None and c.count() == 18
        c.insert_one(1, (0.5, 0))
        assert ids(c.search((0, 0), 3)) == [1, 2, 4] and c.get(1).metadata is None
        c.compact()
        assert c.count() == 19 and ids(c.search((0, 0), 3)) == [1, 2, 4]
        assert [r.id for r in c.range(2, 5).collect()] == [2, 4, 5]
        c.sync()
    again = Collection.open(spark, path, OpenMode.READONLY)
    assert again.count() == 19 and ids(again.search((0, 0), 2)) == [1, 2]
    row = again.info().first()
    assert (row.version_major, row.version_minor, row.dimension, row["count"], row.index_type) == (0, 1, 2, 19, index.value) and row.bytes > 0
    with pytest.raises(E.InvalidArgument):
        again.delete(1)
    again.close()
    with pytest.raises(E.InvalidArgument):
        again.count()


def test_batch_search_with_a_delta(spark, path):
    c = made(spark, path, Index.HNSW)
    c.build_index()
    c.insert(rows(spark, [(100, (0.25, 0), None)]))
    got = c.search_batch(spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, vector array<float>"), 2)
    assert [r.id for r in got.orderBy("rank").collect()] == [100, 1]


@pytest.mark.parametrize(
    "bad,error",
    [
        ([(0, (1, 1), None)], E.InvalidArgument),
        ([(None, (1, 1), None)], E.InvalidArgument),
        ([(50, (1,), None)], E.InvalidArgument),
        ([(50, (1, float("nan")), None)], E.InvalidArgument),
        ([(50, (1, float("inf")), None)], E.InvalidArgument),
        ([(50, (1, 1), "{bad")], E.InvalidArgument),
        ([(50, (1, 1), None), (50, (2, 2), None)], E.AlreadyExists),
        ([(50, (1, 1), None), (7, (2, 2), None)], E.AlreadyExists),
    ],
)
def test_a_bad_insert_changes_nothing(spark, path, bad, error):
    c = made(spark, path)
    with pytest.raises(error):
        c.insert(rows(spark, bad))
    assert c.count() == 20 and not c.exists(50)


def test_one_row_is_checked_like_many(spark, path):
    c = made(spark, path)
    for id_, vector, metadata, error in [(0, (1, 1), None, E.InvalidArgument), (2**63, (1, 1), None, E.InvalidArgument), (50, (1,), None, E.InvalidArgument), (50, (1, float("nan")), None, E.InvalidArgument), (50, (1, 1e39), None, E.InvalidArgument), (7, (1, 1), None, E.AlreadyExists)]:
        with pytest.raises(error), np.errstate(over="ignore"):
            c.insert_one(id_, vector, metadata)
    texts = ['{"a": 1}', "5", '"x"', "null", "[1, 2.5e3]", "{bad", '{"a": 1, "a": 2}', "NaN", "", " ", '{"a": NaN}', "tru"]
    taken = spark.createDataFrame([(t,) for t in texts], "t string").select(F.try_parse_json("t").isNotNull()).collect()
    for i, (text, (ok,)) in enumerate(zip(texts, taken, strict=True)):
        try:
            c.insert_one(100 + i, (1, 2), text)
            assert ok or not text, text
        except E.InvalidArgument:
            assert not ok, text
    c.insert_one(60, (3, 4), '{"n": 9}')
    assert c.search((3, 4), 1).first().id == 60 and c.get(60).metadata == '{"n": 9}'


def test_errors_of_open_search_delete(spark, path):
    with pytest.raises(E.NotFound):
        Collection.open(spark, path, OpenMode.READONLY)
    with pytest.raises(E.InvalidArgument):
        Collection.open(spark, path, NEW)
    c = made(spark, path)
    for config in (Config(3), Config(2, metric=Metric.COSINE)):
        with pytest.raises(E.InvalidArgument):
            Collection.open(spark, path, NEW, config)
    with pytest.raises(E.InvalidArgument):
        c.search((1, 2, 3), 1)
    with pytest.raises(E.FilterParseError):
        c.search((1, 2), 1, "n >")
    with pytest.raises(E.NotFound):
        c.delete([5, 999], missing_ok=False)
    assert c.exists(5)
    with pytest.raises(E.NotFound):
        c.get_strict(999)
    other = Collection.open(spark, path)
    c.delete(5)
    with pytest.raises(E.Locked):
        other.delete(6)
    assert Collection.open(spark, path, NEW | OpenMode.TRUNCATE, Config(2)).count() == 0


def test_damaged_manifests(spark, path, tmp_path):
    made(spark, path)
    target = tmp_path / "c" / "manifest-00000009.json"
    target.write_text("{broken")
    with pytest.raises(E.Corrupt):
        Collection.open(spark, path)
    (tmp_path / "c" / ".manifest-00000009.json.crc").unlink(missing_ok=True)
    target.write_text('{"format": 99, "config": {}}')
    with pytest.raises(E.WrongVersion):
        Collection.open(spark, path)


def test_config():
    for bad in ({"dimension": 0}, {"dimension": 3, "metric": 7}, {"dimension": 3, "m": 10_001}, {"dimension": 3, "m": 1}, {"dimension": 3, "index": "tree"}):
        with pytest.raises(E.InvalidArgument):
            Config(**bad)
    c = Config(3, metric=2, index=1, m=0, ef_construction=4)
    assert (c.metric, c.index, c.m, c.ef_construction) == (Metric.IP, Index.FLAT, 16, 16)
    assert c.ef(10) == 100 and c.ef(300) == 300 and c.ef(10, 150) == 150
    assert Config(3).with_(dimension=4).dimension == 4
    assert E.error_string(0).endswith("OK") and E.error_string(12).endswith("UNKNOWN") and E.NotFound("x").code == -4


def test_cli(spark, path, capsys, monkeypatch):
    made(spark, path).delete([1])
    assert main(["version"]) == 0 and capsys.readouterr().out == "0.1.0\n"
    assert main(["info", path]) == 0 and "dim=2" in capsys.readouterr().out
    assert main(["compact", path]) == 0 and "vectors=19" in capsys.readouterr().out
    assert main(["dump", path]) == 0 and len(capsys.readouterr().out.splitlines()) == 19
    assert main(["info", path + "-none"]) == 1


def test_streams(spark, path, tmp_path):
    c = Collection.open(spark, path, NEW, Config(2))
    rows(spark, [(i, (i, 0), None) for i in range(1, 6)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, vector array<float>, metadata string").parquet(str(tmp_path / "in"))
    ingest(stream, c, str(tmp_path / "check")).awaitTermination()
    assert c.count() == 5
    changes = spark.createDataFrame([("delete", 1, None, None), ("put", 2, [9.0, 9.0], None), ("put", 8, [8.0, 8.0], None)], "op string, id long, vector array<float>, metadata string")
    changes.write.parquet(str(tmp_path / "changes"))
    stream = spark.readStream.schema("op string, id long, vector array<float>, metadata string").parquet(str(tmp_path / "changes"))
    apply_changes(stream, c, str(tmp_path / "check2")).awaitTermination()
    assert sorted(r.id for r in c.rows().collect()) == [2, 3, 4, 5, 8] and c.get(2).vector == [9.0, 9.0]


def test_ordered_changes(spark, path, tmp_path):
    c = Collection.open(spark, path, NEW, Config(2))
    kind = "op string, id long, vector array<float>, metadata string, order long"
    given = [("put", 1, [1.0, 0.0], None, 1), ("put", 1, [2.0, 0.0], None, 3), ("put", 1, [3.0, 0.0], None, 2), ("put", 2, [1.0, 1.0], None, 5), ("delete", 2, None, None, 6), ("delete", 3, None, None, 1), ("put", 3, [9.0, 9.0], None, 2)]
    spark.createDataFrame(given, kind).write.parquet(str(tmp_path / "changes"))
    apply_changes(spark.readStream.schema(kind).parquet(str(tmp_path / "changes")), c, str(tmp_path / "check")).awaitTermination()
    assert {r.id: r.vector for r in c.rows().collect()} == {1: [2.0, 0.0], 3: [9.0, 9.0]}
    bare = kind.removesuffix(", order long")
    spark.createDataFrame([x[:4] for x in given], bare).write.parquet(str(tmp_path / "bare"))
    with pytest.raises(Exception, match="changes twice"):
        apply_changes(spark.readStream.schema(bare).parquet(str(tmp_path / "bare")), c, str(tmp_path / "check2")).awaitTermination()


def test_promoted_fields_answer_as_the_text_does(spark, path):
    c = Collection.open(spark, path, NEW, Config(2), promote=[("n", "double"), ("t", "string"), ("b", "boolean")])
    c.insert(rows(spark, [(1, (1, 0), '{"n": 5, "t": "x", "b": true}'), (2, (2, 0), '{"n": "5", "t": "7", "b": "true"}'), (3, (3, 0), '{"n": "z", "t": 7.5, "b": 1}'), (4, (4, 0), None)]))
    plain = Collection.open(spark, path + "2", NEW, Config(2))
    plain.insert(c.rows())
    for text in ("t > 7", "t = 3", "NOT t = 3", "n = '5'", "n = 5", "n >= 4 AND NOT t < 7.2", "b", "b = true", "NOT b", "b = 1", "n = true", "t = '7'"):
        assert ids(c.search((0, 0), 9, text)) == ids(plain.search((0, 0), 9, text)), text


def test_batch_search_with_a_filter(spark, path):
    c = made(spark, path, Index.HNSW)
    c.build_index()
    asked = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, vector array<float>")
    assert [r.id for r in c.search_batch(asked, 2, filter="NOT odd AND n > 4").orderBy("rank").collect()] == [6, 8]


def test_old_manifests_go(spark, path, tmp_path):
    c = made(spark, path)
    c.delete([1])
    c.compact()
    assert len([x for x in (tmp_path / "c").iterdir() if x.name.startswith("manifest")]) == 1 and Collection.open(spark, path).count() == 19


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from nearfield.sources.store import work_folder

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://h:7077"):
        with pytest.raises(E.InvalidArgument):
            work_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    assert work_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file://")


def test_the_index_takes_later_rows_in(spark, path):
    c = made(spark, path, Index.HNSW)
    c.update_index()  # there is none yet
    c.insert(rows(spark, [(100, (0.25, 0), None), (101, (7.5, 0), None)]))
    c.delete([1])
    c.update_index()
    assert c.source().delta is None and ids(c.search((0, 0), 3)) == [100, 2, 3] and ids(c.search((7.4, 0), 1)) == [101]
    again = Collection.open(spark, path, OpenMode.READONLY)
    assert ids(again.search((0, 0), 30)) == [100, *range(2, 8), 101, *range(8, 21)]
