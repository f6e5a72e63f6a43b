import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.errors import InvalidArgument
from nearfield.functions.distance import exact_distances
from nearfield.operators.knn import nearest, nearest_batch, nearest_rows


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, vector array<float>")


def found(df):
    return [(r.id, r.distance) for r in df.orderBy("rank").collect()]


def test_axes(spark):
    got = found(nearest(table(spark, [(0, (1, 0, 0)), (1, (0, 1, 0)), (2, (0, 0, 1))]), (0.9, 0.1, 0), 3))
    assert [i for i, _ in got] == [0, 1, 2] and got[0][1] < got[1][1] <= got[2][1]


def test_line(spark):
    assert found(nearest(table(spark, [(i, (i, 0, 0)) for i in range(10)]), (0, 0, 0), 3)) == [(0, 0.0), (1, 1.0), (2, 4.0)]


def test_cosine_order(spark):
    got = found(nearest(table(spark, [(0, (1, 0, 0)), (1, (0, 1, 0)), (2, (-1, 0, 0))]), (1, 0, 0), 3, "cosine"))
    assert got == [(0, 0.0), (1, 1.0), (2, 2.0)]


def test_k_edges_and_empty(spark):
    one = table(spark, [(0, (1, 1))])
    assert found(nearest(one, (0, 0), 10)) == [(0, 2.0)]
    assert found(nearest(one, (0, 0), 0)) == []
    assert found(nearest(one.limit(0), (0, 0), 5)) == []
    with pytest.raises(InvalidArgument):
        nearest(one, (0, 0), -1)


def test_ties_go_to_the_smaller_id(spark):
    rows = table(spark, [(9, (1, 0)), (3, (0, 1)), (5, (-1, 0)), (2**40, (0, -1))])
    assert [i for i, _ in found(nearest(rows, (0, 0), 2))] == [3, 5]
    queries = rows.limit(1).select(F.lit(1).alias("query_id"), F.array(F.lit(0.0), F.lit(0.0)).alias("vector"))
    assert [r.id for r in nearest_batch(rows, queries, 3).orderBy("rank").collect()] == [3, 5, 9]


def test_malformed_vectors_are_never_near(spark):
    rows = table(spark, [(1, (5, 5)), (2, None), (3, (0, 0, 0)), (4, (float("nan"), 0))])
    assert [i for i, _ in found(nearest(rows, (0, 0), 10))] == [1]
    queries = rows.where("id = 1").select(F.lit(7).alias("query_id"), "vector")
    assert [r.id for r in nearest_batch(rows, queries, 10).collect()] == [1]
    # so are malformed queries, and each query meets the rows of its own length
    odd = spark.createDataFrame([(1, None), (2, []), (3, [float("inf"), 0.0]), (4, [1.0, 1.0, 1.0]), (5, [None, 1.0])], "query_id long, vector array<float>")
    assert [(r.query_id, r.id) for r in nearest_batch(rows, odd, 10).collect()] == [(4, 3)]


def test_filter_comes_before_the_cut(spark):
    rows = table(spark, [(i, (i, 0)) for i in range(20)])
    assert [i for i, _ in found(nearest(rows, (0, 0), 3, where=F.col("id") > 10))] == [11, 12, 13]


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_batches_equal_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    base = rng.integers(-3, 4, (300, 6)).astype(np.float32)  # many ties
    rows = table(spark, list(enumerate(base.tolist()))).repartition(3)
    queries = rows.where("id % 40 = 0").select(F.col("id").alias("query_id"), "vector")
    expected = set()
    for q in range(0, 300, 40):
        d = exact_distances(base[q], base, metric)
        for rank, i in enumerate(np.lexsort((np.arange(300), np.round(d, 12)))[:7], 1):
            expected.add((q, rank, round(float(d[i]), 9)))
    for df in (nearest_batch(rows, queries, 7, metric), nearest_batch(rows, queries, 7, metric, block_bytes=50)):
        assert {(r.query_id, r["rank"], round(r.distance, 9)) for r in df.collect()} == expected


def test_blocks_without_queries(spark):
    rows = table(spark, [(1, (5, 5))])
    assert nearest_batch(rows, rows.limit(0).select(F.col("id").alias("query_id"), "vector"), 3).count() == 0


def test_top_k_plan_has_no_full_sort(spark):
    df = nearest(table(spark, [(i, (i, 0)) for i in range(20)]), (0, 0), 3)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_doubles_stay_doubles(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.0]), (2, [0.1 + 1e-12, 0.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(9, [0.0, 0.0])], "query_id long, vector array<double>")
    got = nearest_batch(rows, queries, 2).orderBy("rank").collect()
    assert [(r.id, r.distance) for r in got] == [(1, 0.1 * 0.1), (2, (0.1 + 1e-12) ** 2)]


def test_ids_of_any_type_and_null_ids(spark):
    rows = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), (None, [1.0]), ("é", [0.5])], "id string, vector array<float>")
    queries = spark.createDataFrame([("x", [0.0]), (None, [1.0])], "query_id string, vector array<float>")
    got = nearest_batch(rows, queries, 3).collect()
    assert {(r.query_id, r["rank"], r.id) for r in got} == {("x", 1, "é"), ("x", 2, None), ("x", 3, "a"), (None, 1, None), (None, 2, "a"), (None, 3, "b")}


def test_vectors_of_extreme_size(spark):
    tiny = [(i, [1e-30 * i, 1e-30]) for i in range(1, 9)]
    huge = [(i + 10, [1e25 * i, 1e25]) for i in range(1, 9)]
    rows = spark.createDataFrame(tiny + huge + [(99, [0.0, 0.0])], "id long, vector array<float>").coalesce(1)
    queries = spark.createDataFrame([(1, [0.0, 1e-30]), (2, [1e25, 1e25])], "query_id long, vector array<float>")
    for metric in ("l2", "cosine", "ip"):
        got = {}
        for r in nearest_batch(rows, queries, 4, metric).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id))
        for q, vector in ((1, (0.0, np.float32(1e-30))), (2, (np.float32(1e25),) * 2)):
            assert sorted(got[q]) == [(r["rank"], r.id) for r in nearest(rows, [float(x) for x in vector], 4, metric).orderBy("rank").collect()], metric


def test_a_filter_on_batches_comes_first(spark):
    rows = table(spark, [(i, (i, 0)) for i in range(20)])
    queries = rows.where("id = 0").select(F.col("id").alias("query_id"), "vector")
    assert [r.id for r in nearest_batch(rows, queries, 3, where=F.col("id") > 10).orderBy("rank").collect()] == [11, 12, 13]


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_one_query_either_way(spark, metric):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-2, 3, (200, 5)))], "id long, vector array<float>").repartition(3)
    for query in ([0.9, 0.1, -0.3, 0.2, 1.7], [0.0] * 5, [1.0] * 4, [float("nan")] * 5, []):
        a, b = (found(f(rows, query, 9, metric, where=F.col("id") > 20)) for f in (nearest, nearest_rows))
        assert [i for i, _ in a] == [i for i, _ in b] and [d for _, d in a] == pytest.approx([d for _, d in b], abs=1e-12)


def test_many_queries_come_partition_by_partition(spark, monkeypatch):
    from nearfield.operators import knn

    rows = table(spark, [(i, (i, 0)) for i in range(50)])
    queries = rows.select(F.col("id").alias("query_id"), "vector").repartition(3)
    one = sorted(map(tuple, nearest_batch(rows, queries, 2).collect()))
    monkeypatch.setattr(knn, "FEW_QUERIES", 4)
    assert sorted(map(tuple, nearest_batch(rows, queries, 2).collect())) == one and len(one) == 100


def test_small_blocks_cost_no_jobs_and_passes_no_plan(spark, monkeypatch):
    from nearfield.operators import knn

    rng = np.random.default_rng(8)
    base = rng.integers(-3, 4, (300, 6)).astype(np.float32)
    rows = table(spark, list(enumerate(base.tolist()))).repartition(3)
    queries = rows.select(F.col("id").alias("query_id"), "vector")
    one = sorted(map(tuple, nearest_batch(rows, queries, 3).collect()))
    made = []
    monkeypatch.setattr(knn, "added", lambda df, path, f=knn.added: (made.append(path), f(df, path)))
    # a block for each query, all in one pass
    assert sorted(map(tuple, nearest_batch(rows, queries, 3, block_bytes=24).collect())) == one and len(one) == 900 and not made
    # several passes are one table, and so one scan
    monkeypatch.setattr(knn, "QUERY_BLOCK_BYTES", 24 * 100)
    df = nearest_batch(rows, queries, 3, block_bytes=24)
    assert sorted(map(tuple, df.collect())) == one and len(made) == 3 and len(set(made)) == 1
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
