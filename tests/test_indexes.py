"""Indexes: exact modes equal linear search, budgets keep precision, changes and storage lose nothing."""

import numpy as np
import pytest

from nearfield.functions.vectors import metric
from nearfield.operators import index, knn, ranking, trees
from nearfield.operators.trees import Params

EXACT = [Params("kdtree_single"), Params("kdtree", trees=2), Params("kmeans", branching=6), Params("hierarchical", branching=6, leaf_size=12, trees=2), Params("composite", branching=6, trees=2)]


def cloud(spark, n=400, dim=3, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.random((n, dim)) * scale)], "id bigint, vec array<double>")


def asked(points, n=15):
    return points.where(f"id < {n}").withColumnRenamed("id", "qid")


def plain(df):
    return sorted((r.qid, r["rank"], r.id, round(r.dist, 9)) for r in df.collect())


@pytest.mark.parametrize("params", EXACT, ids=lambda p: p.algorithm)
def test_exact_modes(params, spark):
    points = cloud(spark)
    want = plain(knn.knn_join(asked(points), points, 4))
    assert plain(index.build_index(points, params, shard_rows=150).search(asked(points), 4, checks=-1)) == want


@pytest.mark.parametrize("params", EXACT, ids=lambda p: p.algorithm)
def test_exact_search_merges_the_hits_of_a_tasks_shards(params, spark):
    points = cloud(spark, 2000)
    built = index.build_index(points, params, shard_rows=20)
    want = plain(knn.knn_join(asked(points), points, 4))
    hits = built.hits(asked(points), 4, checks=-1)
    assert plain(knn.ranked(hits.select("qid", "id", "dist"), 4)) == want
    assert built.shards == 100 and hits.count() <= 15 * 4 * -(-built.shards // 2)
    gone = points.where("id % 3 = 0")
    rest = points.where("id % 3 <> 0")
    assert plain(built.remove_points(gone).search(asked(points), 4, checks=-1)) == plain(knn.knn_join(asked(points), rest, 4))


@pytest.mark.parametrize("kind", ["l1", "max", "hellinger", "chi_square"])
def test_other_distances(kind, spark):
    points = cloud(spark, 200)
    algorithm = "hierarchical" if kind == "max" else "kdtree_single"
    found = index.build_index(points, Params(algorithm, metric=kind, trees=1)).search(asked(points), 3, checks=-1)
    assert plain(found) == plain(knn.knn_join(asked(points), points, 3, kind))


def test_incompatible_distance():
    with pytest.raises(ValueError):
        trees.build(np.zeros((3, 2)), Params("kdtree", metric="max"), metric("max"))


@pytest.mark.parametrize("params", [Params("kdtree"), Params("kmeans", branching=7, iterations=3), Params("hierarchical")], ids=lambda p: p.algorithm)
def test_budget_precision(params, spark):
    points = cloud(spark, 3000, 16)
    truth = knn.knn_join(asked(points, 40), points, 5)
    found = index.build_index(points, params).search(asked(points, 40), 5, checks=600)
    precision = [r.precision for r in ranking.neighbor_precision(found, truth, 5).collect()]
    assert np.mean(precision) >= 0.75


def test_add_remove_save_load(spark, tmp_path):
    points = cloud(spark)
    half = index.build_index(points.where("id % 2 = 0"), Params("kmeans", branching=6))
    grown = half.add_points(points.where("id % 2 = 1")).remove_points(points.where("id % 5 = 0"))
    want = plain(knn.knn_join(asked(points), points.where("id % 5 <> 0"), 4))
    assert plain(grown.search(asked(points), 4, checks=-1)) == want
    assert grown.size() == 320 and grown.veclen() == 3 and grown.used_memory() > 0
    assert grown.get_point(5).count() == 0 and grown.get_point(6).count() == 1
    grown.save(str(tmp_path / "index"))
    loaded = index.load_index(spark, str(tmp_path / "index"))
    assert plain(loaded.search(asked(points), 4, checks=-1)) == want
    assert loaded.params == grown.params
    rebuilt = grown.add_points(cloud(spark, 500, seed=9).selectExpr("id + 1000 AS id", "vec"))
    assert rebuilt.delta is None and rebuilt.search(asked(points), 4, checks=-1).where("id % 5 = 0 AND id < 1000").count() == 0


def test_same_seed_same_tree(spark):
    points = cloud(spark)
    a, b = (sorted(map(str, index.build_index(points, Params("kdtree", seed=4)).nodes.collect())) for _ in range(2))
    assert a == b


def test_duplicates_and_small_sets(spark):
    points = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)] + [(50, None)], "id bigint, vec array<double>")
    for params in EXACT:
        found = index.build_index(points, params).search(asked(points, 2), 3, checks=-1)
        assert [(r.qid, r.dist) for r in found.orderBy("qid", "rank").collect()] == [(0, 0.0)] * 3 + [(1, 0.0)] * 3


def test_radius(spark):
    points = cloud(spark, scale=10.0)
    assert knn.radius_join(asked(points), points, 1e-12).count() == 15
    assert {r.n for r in knn.radius_join(asked(points), points, 0.0, max_neighbors=0).collect()} == {0}
    some = knn.radius_join(asked(points), points, 4.0, max_neighbors=2)
    assert max(r["rank"] for r in some.collect()) == 2


def test_lsh_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (300, 63))
    flip = [np.where(rng.random(63) < 0.05, 1 - b, b) for b in base]
    pack = lambda b: [int(sum(int(x) << i for i, x in enumerate(b)))]
    points = spark.createDataFrame([(i, pack(b)) for i, b in enumerate(base)], "id bigint, vec array<bigint>")
    queries = spark.createDataFrame([(i, pack(b)) for i, b in enumerate(flip[:60])], "qid bigint, vec array<bigint>")
    found = index.build_index(points, Params("lsh", metric="hamming")).search(queries, 1)
    truth = knn.knn_join(queries, points, 1, "hamming")
    hit = ranking.neighbor_precision(found, truth, 1).agg({"precision": "avg"}).first()[0]
    assert hit >= 0.9


def test_cluster_cut():
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.normal(c, 0.01, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    m = metric("l2")
    tree = trees.kmeans_tree(data, Params(branching=3, centers="kmeanspp"), m, np.random.default_rng(1))
    assert sorted(np.round(trees.cut(tree, 3)).tolist()) == [[0, 0], [0, 5], [5, 5]]
    assert len(trees.cut(tree, 1)) == 1


@pytest.mark.parametrize("how", ["random", "gonzales", "kmeanspp", "groupwise"])
def test_center_choosers(how):
    data = np.repeat(np.arange(6.0)[:, None], 10, axis=0)
    chosen = trees.pick_centers(data, 4, how, metric("l2").block, np.random.default_rng(0))
    assert len({float(data[i, 0]) for i in chosen}) == 4


def test_autotune(spark):
    points = cloud(spark, 1500, 8)
    built, checks = index.autotune(points, Params("autotuned", sample_fraction=0.4, target_precision=0.8))
    truth = knn.knn_join(asked(points, 30), points, 5)
    precision = ranking.neighbor_precision(built.search(asked(points, 30), 5, checks=checks), truth, 5).agg({"precision": "avg"}).first()[0]
    assert precision >= 0.7
    assert index.autotune(points.limit(20), Params("autotuned"))[0].params.algorithm == "linear"


FORESTS = [Params("kmeans", branching=5), Params("hierarchical", branching=5, leaf_size=8, trees=3), Params("kdtree", trees=2), Params("hierarchical", metric="max", branching=5, trees=1), Params("hierarchical", metric="dot", branching=5, trees=1)]


@pytest.mark.parametrize("params", FORESTS, ids=lambda p: f"{p.algorithm}-{p.metric}")
def test_searching_together_equals_one_by_one(params):
    rng = np.random.default_rng(2)
    data, ids, m = rng.random((700, 6)), rng.permutation(700) + 5, metric(params.metric)
    data[300:340] = data[0]
    forest, queries = trees.build(data, params, m), np.concatenate([data[:30], rng.random((10, 6))])
    for checks, radius in ((-1, np.inf), (-1, 0.3), (60, np.inf), (1, np.inf), (5000, np.inf), (60, 0.3)):
        place, dist, at, _ = trees.search_many(forest, data, ids, queries, 4, params, m, checks, radius=radius)
        for i, q in enumerate(queries):
            want = trees.search(forest, data, ids, q, 4, params, m, checks, radius=radius)[0]
            if checks < 0 or radius < np.inf:
                assert list(zip(dist[place == i].round(12).tolist(), at[place == i].tolist())) == [(round(d, 12), x) for d, x in want]
            else:  # the budget goes only to branches that may hold a better point
                assert len(want) == 4 and (dist[place == i] <= np.array(want)[:, 0] + 1e-12).all()


@pytest.mark.parametrize("params", [Params("kmeans", branching=8), Params("hierarchical", branching=8, leaf_size=20)], ids=lambda p: p.algorithm)
def test_too_few_checks_are_raised_until_the_precision_is_reached(params, spark):
    points = cloud(spark, 4000, 40)
    asked_ = points.where("id % 20 = 0").withColumnRenamed("id", "qid")
    truth, built = knn.knn_join(asked_, points, 5).persist(), index.build_index(points, params)
    mean = lambda hits: ranking.neighbor_precision(hits, truth, 5).agg({"precision": "avg"}).first()[0]
    assert mean(built.search(asked_, 5, checks=64)) < 0.9
    found, checks = index.search_reaching(built, asked_, truth, 0.9, 5, 64)
    assert mean(found) >= 0.9 and (checks > 64 or checks == -1)
    assert mean(index.search_reaching(built, asked_, truth, 1.0, 5, 1024)[0]) == 1.0
