import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import DATA, TABLES, same_as_sql
from nearfield.config import Config
from nearfield.errors import InvalidArgument
from nearfield.functions.distance import exact_distances
from nearfield.operators import hnsw
from nearfield.operators.knn import nearest_batch
from nearfield.queries import ORACLE_SQL, QUERIES


def graph(vectors, ids=None, **options):
    v = np.array(vectors, np.float32)
    return hnsw.Graph(np.array(ids if ids is not None else range(len(v)), np.int64), v, Config(v.shape[1], **options)).build()


def test_small_graph():
    g = graph([*np.eye(4), [0.5] * 4])
    ids, near = g.search(np.eye(4)[0], 3, 100)
    assert len(ids) == 3 and ids[0] == 0 and (np.diff(near) >= 0).all()


def test_equal_vectors_are_both_found():
    ids, _ = graph([[1, 2, 3], [1, 2, 3]]).search(np.zeros(3), 10, 100)
    assert ids.tolist() == [0, 1]


def test_sparse_ids_are_distinct():
    rng = np.random.default_rng(1)
    ids = rng.choice(2**50, 200, replace=False)
    found, _ = graph(rng.normal(size=(200, 8)), ids).search(rng.normal(size=8), 50, 100)
    assert len(set(found.tolist())) == 50


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_recall_of_many_queries(metric):
    rng = np.random.default_rng(42)
    v = rng.uniform(-1, 1, (1000, 16)).astype(np.float32)
    g = graph(v, metric=metric)
    hits = 0
    for q in rng.uniform(-1, 1, (50, 16)).astype(np.float32):
        exact = np.argsort(exact_distances(q, v, metric), kind="stable")[:10]
        hits += len(set(exact.tolist()) & set(g.search(q, 10, 100)[0].tolist()))
    assert hits / 500 >= 0.95


def test_deleted_nodes_lead_on():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    g = graph(v)
    g.deleted[np.arange(400) % 10 != 0] = True  # nine of ten
    ids, _ = g.search(v[0], 20, 100)
    assert len(ids) == 20 and all(i % 10 == 0 for i in ids)


def test_packed_round_trip_and_empty():
    g = graph(np.random.default_rng(4).normal(size=(60, 4)), m=4)
    again = hnsw.Graph.unpacked(g.packed(0, 1), g.config)
    q = np.ones(4, np.float32)
    assert again.search(q, 5, 100)[0].tolist() == g.search(q, 5, 100)[0].tolist()
    empty = graph(np.zeros((0, 3)))
    assert len(empty.search(np.zeros(3), 5, 100)[0]) == 0
    assert len(hnsw.Graph.unpacked(empty.packed(0, 1), empty.config).search(np.zeros(3), 5, 100)[0]) == 0


def test_degrees_are_bounded():
    g = graph(np.random.default_rng(5).normal(size=(300, 3)), m=4)
    assert len(g.links) > 2 and g.links[0].shape == (300, 8) and all(x.shape[1] == 4 for x in g.links[1:])


def slow_links(vectors, levels, m, metric):
    """Inserting node by node: the nearest m before it, links back, the nearest of each node's links kept."""
    out = []
    for level in range(max(levels) + 1):
        own = [i for i, x in enumerate(levels) if x >= level]
        links = {i: set() for i in own}
        cap = m * (1 if level else 2)
        near = lambda i, some: sorted(some, key=lambda j: (float(exact_distances(vectors[i], vectors[j : j + 1], metric)[0]), j))
        for n, i in enumerate(own):
            links[i] = set(near(i, own[:n])[:m])
            for j in links[i]:
                links[j] = set(near(j, links[j] | {i})[:cap])
        out.append(links)
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_links_are_those_of_one_by_one_insertion(metric):
    v = np.random.default_rng(8).normal(size=(130, 5)).astype(np.float32)
    g = graph(v, m=3, metric=metric)
    for level, want in enumerate(slow_links(v, g.levels.tolist(), 3, metric)):
        got = {int(i): {int(x) for x in row if x >= 0} for i, row in zip(g.members[level], g.links[level], strict=True)}
        assert got == want


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_growing_is_building(metric):
    v = np.random.default_rng(10).normal(size=(300, 5)).astype(np.float32)
    whole = graph(v, m=4, metric=metric)
    part = graph(v[:0], m=4, metric=metric)
    for a, b in ((0, 1), (1, 170), (170, 170), (170, 300)):
        part = part.grown(np.arange(a, b), v[a:b])
    assert len(part.links) == len(whole.links) and all((a == b).all() for a, b in zip(part.links, whole.links, strict=True))


def test_tiles_do_not_show(monkeypatch):
    v = np.random.default_rng(9).normal(size=(500, 5)).astype(np.float32)
    one = graph(v).links
    monkeypatch.setattr(hnsw, "_TILE", 16)
    assert all((a == b).all() for a, b in zip(one, graph(v).links, strict=True))


def test_shards_and_storage(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 8)))], "id long, vector array<float>")
    config = Config(8, shard_rows=200)
    queries = rows.where("id % 60 = 0").select(F.col("id").alias("query_id"), "vector")
    hnsw.build(rows, config).write.partitionBy("shard").parquet(str(tmp_path / "nodes"))
    nodes = spark.read.schema(hnsw.SHARDS).parquet(str(tmp_path / "nodes")).select("shard", "shards", "ids", "levels", "vectors", "links", "deleted")
    assert nodes.count() == 3 and hnsw.count(nodes) == 600
    each = hnsw.nodes(nodes, config)
    assert each.count() == 600 and each.where("size(neighbors) <> level + 1 or exists(neighbors[0], x -> x < 0)").count() == 0
    found = hnsw.search(nodes, queries, 10, config)
    assert "Exchange" not in hnsw.search(nodes, queries, 10, config)._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[-1]
    assert hnsw.recall(found, nearest_batch(rows, queries, 10)).first().recall >= 0.95
    fewer = hnsw.remove(nodes, rows.where("id % 2 = 0").select("id"))
    assert hnsw.count(fewer) == 300
    assert hnsw.search(fewer, queries, 10, config).where("id % 2 = 0").count() == 0


def test_query_blocks_and_text_query_ids(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))], "id long, vector array<float>")
    config = Config(8, shard_rows=100)
    shards = hnsw.build(rows, config).persist()
    queries = rows.where("id % 10 = 0").select(F.concat(F.lit("q"), "id").alias("query_id"), "vector")
    one = sorted(map(tuple, hnsw.search(shards, queries, 3, config).collect()))
    monkeypatch.setattr(hnsw, "QUERY_BLOCK_BYTES", 200)
    assert sorted(map(tuple, hnsw.search(shards, queries, 3, config).collect())) == one and len(one) == 90
    with pytest.raises(InvalidArgument):
        hnsw.search(shards, queries.withColumn("vector", F.slice("vector", 1, 7)), 3, config)
    assert hnsw.search(shards, queries.limit(0), 3, config).count() == 0


def test_inserting_into_stored_shards(spark):
    rng = np.random.default_rng(11)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)))], "id long, vector array<float>").persist()
    config = Config(8, shard_rows=100)
    shards = hnsw.build(rows.where("id < 250"), config, shards=4)
    shards = hnsw.insert(hnsw.remove(shards, rows.where("id = 7").select("id")), rows.where("id >= 250"), config)
    assert hnsw.count(shards) == 399
    queries = rows.where("id % 40 = 0").select(F.col("id").alias("query_id"), "vector")
    assert hnsw.recall(hnsw.search(shards, queries, 10, config), nearest_batch(rows.where("id <> 7"), queries, 10)).first().recall >= 0.95


def islands(n, size, dim=64, seed=12):
    """Tight groups of consecutive ids far from each other, which a graph's links hardly leave."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(-(-n // size), dim)) * 10
    return (np.repeat(centres, size, 0)[:n] + rng.normal(size=(n, dim)) * 0.01).astype(np.float32)


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_a_check_adds_what_the_walk_missed(metric):
    v = islands(2000, 34, 8)
    g = graph(v, ids=np.random.default_rng(13).permutation(2000), metric=metric)
    g.deleted[::7] = True
    live = np.flatnonzero(~g.deleted)
    walked = 0
    for k in (1, 10, 3000):
        q, node, far = g.search_many(v[::50], k, 20, exact=True)
        w = g.search_many(v[::50], k, 20)
        for i in range(40):
            d = exact_distances(v[i * 50], v[live], metric)
            want = np.lexsort((g.ids[live], d))[:k]
            assert node[q == i].tolist() == live[want].tolist() and far[q == i] == pytest.approx(d[want])
            walked += w[1][w[0] == i].tolist() != live[want].tolist()
    assert walked  # by the walk alone some differ


def with_islands(folder, size):
    """The tables with 4000 vectors in groups of ``size``."""
    for name in TABLES:
        if name != "embeddings":
            (folder / f"{name}.parquet").symlink_to(DATA / f"{name}.parquet")
    kinds = pq.read_schema(DATA / "embeddings.parquet")
    v = islands(4000, size)
    pq.write_table(pa.table({"vec_id": np.arange(4000), "embedding": list(v), "label": np.zeros(4000, int)}).select(kinds.names).cast(kinds), folder / "embeddings.parquet")
    return folder


def test_stored_graphs_equal_sql_on_islands(spark, tmp_path):
    name = "hnsw_checkpoint_roundtrip"
    same_as_sql(spark, QUERIES[name], ORACLE_SQL[name], with_islands(tmp_path, 40))


def test_compacted_graphs_equal_sql_on_islands(spark, tmp_path):
    name = "hnsw_compacted"
    same_as_sql(spark, QUERIES[name], ORACLE_SQL[name], with_islands(tmp_path, 40))


def test_searched_graphs_equal_sql_on_islands(spark, tmp_path):
    name = "knn_hnsw"
    same_as_sql(spark, QUERIES[name], ORACLE_SQL[name], with_islands(tmp_path, 100))
