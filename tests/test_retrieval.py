"""Average precision against a loop, pooling against NumPy, hierarchy search, sources and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import hierarchy, knn, pooling, prep, quantize, ranking, search
from nearfield.operators.index import Params, build_index
from nearfield.sources import readers
from nearfield.streaming import ingest


def loop_ap(hits, positives):
    old_p, old_r, area, met = 1.0, 0.0, 0.0, 0
    for j, hit in enumerate(hits, 1):
        met += hit
        r, p = met / positives, met / j
        area += (r - old_r) * (p + old_p) / 2
        old_r, old_p = r, p
    return area


def test_average_precision_equals_loop(spark):
    rng = np.random.default_rng(0)
    ranked, truth, want = [], [], {}
    for q in range(40):
        n = int(rng.integers(1, 12))
        hits = rng.random(n) < 0.4
        extra = int(rng.integers(0, 3)) + (not hits.any())
        ranked += [(q, f"p{i}", i + 1) for i in range(n)]
        truth += [(q, f"p{i}") for i in range(n) if hits[i]] + [(q, f"x{i}") for i in range(extra)]
        want[q] = loop_ap(hits, int(hits.sum()) + extra)
    r, t = spark.createDataFrame(ranked, "qid int, pano string, rank int"), spark.createDataFrame(truth, "qid int, pano string")
    got = {x.qid: x.ap for x in ranking.average_precision(r, t).collect()}
    assert got.keys() == want.keys() and all(abs(got[q] - want[q]) < 1e-12 for q in want)
    assert {x.p_at_k for x in ranking.precision_at(r.where("rank < 3"), t, 4).collect()} <= {0.0, 0.25, 0.5}


def test_gmp_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 6))
    df = spark.createDataFrame([(f"g{i % 2}", v.tolist()) for i, v in enumerate(x)], "g string, vec array<double>").repartition(3)
    for r in pooling.gmp_pool(df, "g").collect():
        own = x[int(r.g[1]) :: 2]
        v = np.linalg.solve(own @ own.T + np.eye(len(own)), own).mean(axis=0)
        assert np.allclose(r.vec, v / np.linalg.norm(v))


def tree(spark):
    nodes = spark.createDataFrame([("a", 0, False, [1.0, 0.0]), ("b", 0, False, [0.0, 1.0]), ("a1", 1, True, [0.9, 0.1]), ("a2", 1, True, [0.5, 0.5]), ("b1", 1, True, [0.1, 0.9])], "node string, level int, is_leaf boolean, vec array<double>")
    edges = spark.createDataFrame([("a", "a1"), ("a", "a2"), ("b", "b1")], "parent string, child string")
    panos = spark.createDataFrame([("a", "p1", 1), ("a", "p2", 2), ("b", "p3", 1), ("a1", "p1", 1), ("a2", "p2", 1), ("b1", "p3", 1)], "node string, pano string, pos int")
    return nodes, edges, panos


def test_best_first_counts_and_completes(spark):
    nodes, edges, panos = tree(spark)
    q = spark.createDataFrame([(1, [1.0, 0.05])], "qid bigint, vec array<double>")
    found = search.best_first(q, nodes, edges, panos, [1, 9]).orderBy("budget", "rank").collect()
    assert [r.pano for r in found if r.budget == 1] == ["p1", "p2", "p3"]
    assert [r.pano for r in found if r.budget == 9] == ["p1", "p2", "p3"]
    # Two roots and two children of a; the single child of b costs nothing.
    assert {r.budget: r.n_distances for r in found} == {1: 4, 9: 4}


def plain_search(nodes, children, listed, q, budget, every_step, all_leaves):
    """The search by its definition, on sorted lists: the panoramas in order and the distances counted."""
    score = lambda n: -float(np.dot(nodes[n][2], q))
    queue, explored, leaves, counted = [(0.0, "")], 0, [], 0
    while queue and explored < budget:
        queue.sort()
        dist, node = queue.pop(0)
        while True:
            below = children.get(node, [])
            if all_leaves and node and nodes[node][1] and below:
                counted += len(below) * (len(below) > 1)
                explored += len(below)
                leaves += [(score(c), c) for c in below]
                break
            if not below:
                explored += 1
                leaves.append((dist, node))
                break
            counted += len(below) * (len(below) > 1)
            met = sorted((score(c), c) for c in below)
            queue += met if every_step else met[1:]
            if every_step:
                break
            dist, node = met[0]
    order = []
    for _, n in sorted(leaves) + sorted(queue):
        order += [p for p in listed.get(n, []) if p not in order]
    return order, counted


def test_best_first_equals_plain_search(spark):
    rng = np.random.default_rng(5)
    rows, edges, panos = [], [], []
    for a in range(4):
        rows.append((f"n{a}", 0, False, rng.normal(size=5).tolist()))
        for b in range(int(rng.integers(1, 5))):
            rows.append((f"n{a}.{b}", 1, True, rng.normal(size=5).tolist()))
            edges.append((f"n{a}", f"n{a}.{b}"))
            for c in range(int(rng.integers(0, 4))):
                rows.append((f"n{a}.{b}.{c}", 2, False, rng.normal(size=5).tolist()))
                edges.append((f"n{a}.{b}", f"n{a}.{b}.{c}"))
    for n, *_ in rows:
        panos += [(n, f"p{x}", k) for k, x in enumerate(rng.permutation(9)[:3])]
    nodes = spark.createDataFrame(rows, "node string, level int, is_leaf boolean, vec array<double>")
    tables = spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame(panos, "node string, pano string, pos int")
    by = {n: (level, leaf, v) for n, level, leaf, v in rows}
    children = {"": sorted(n for n in by if by[n][0] == 0)}
    for a, b in sorted(edges):
        children.setdefault(a, []).append(b)
    listed = {}
    for n, p, _ in panos:
        listed.setdefault(n, []).append(p)
    vecs = {i: rng.normal(size=5).tolist() for i in range(6)}
    queries = spark.createDataFrame(list(vecs.items()), "qid bigint, vec array<double>")
    for every_step in (False, True):
        for all_leaves in (False, True):
            found = search.best_first(queries, nodes, *tables, [1, 2, 5], every_step=every_step, all_leaves=all_leaves).collect()
            for i, v in vecs.items():
                for budget in (1, 2, 5):
                    own = sorted((r for r in found if (r.qid, r.budget) == (i, budget)), key=lambda r: r.rank)
                    want, counted = plain_search(by, children, listed, v, budget, every_step, all_leaves)
                    assert [r.pano for r in own] == want and {r.n_distances for r in own} == {counted}


def test_beams_and_simplify(spark):
    nodes, edges, _ = tree(spark)
    q = spark.createDataFrame([(1, [1.0, 0.05])], "qid bigint, vec array<double>")
    order = lambda df: [r.node for r in df.orderBy("place").collect()]
    assert order(search.beam(q, nodes, edges, 1, 1)) == ["a1", "a2", "b"]
    assert order(search.beam(q, nodes, edges, 2, 1)) == ["a1", "a2", "b1"]
    assert order(search.beam_by_score(q, nodes, edges, 0.5, 1)) == ["a1", "a2", "b"]
    assert order(search.beam_by_score(q, nodes.where("node <> 'b'"), edges, 0.5, 1)) == ["a"]  # no spread
    fewer, links = search.simplify(nodes, edges, 1)
    assert {r.node: r.level for r in fewer.collect()} == {"a": 0, "b1": 0, "a1": 1, "a2": 1}
    assert {(r.parent, r.child) for r in links.collect()} == {("a", "a1"), ("a", "a2")}


def test_group_yaw_bins_and_offset(spark):
    df = spark.createDataFrame([("r", "p", 1, -3.2, "x_yaw_350.0_pitch_-15.0.png"), ("r", "p", 2, 0.1, "x_yaw_10.0_pitch_0.0.png"), ("r", "q", 3, 3.0, "bad")], "room string, pano string, image_id long, yaw double, filename string")
    assert {r.image_id for r in hierarchy.group_yaw(df, 2).collect()} == {2, 3}
    assert hierarchy.group_pano(df, 4, 1, offset_seed=1).count() == 3
    assert [r.y for r in df.select(hierarchy.rel_yaw(F.col("filename")).alias("y")).collect()][2] == 0.0


def test_quantization_round(spark):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))], "id bigint, vec array<double>")
    books = quantize.train_codebooks(points, 4, 16)
    found = quantize.adc_search(points.where("id < 10").withColumnRenamed("id", "qid"), quantize.encode(points, books), books, 20)
    assert found.where("qid = id").count() >= 7
    assert [list(r.vec) for r in quantize.kmeans(points, 1, 2).collect()] == [r.vec for r in pooling.column_mean(points).collect()]


def test_prep(spark):
    assert prep.yaw_union([4, 2]) == [0.0, 90.0, 180.0, 270.0]
    regions = prep.region_grid(1024, 768, 3)
    assert all(x >= 0 and y >= 0 and x + w <= 1024 and y + h <= 768 for x, y, w, h in regions)
    assert prep.corners([(1, 2, 3, 4)]) == [(1, 2, 3, 5)]
    df = spark.range(1).select(prep.rotation(F.lit(0.3), F.lit(0.2), F.lit(0.1)).alias("r"))
    q = df.select(prep.rotation_quaternion(F.col("r")).alias("q"), prep.orthonormal_error(F.col("r")).alias("e"), prep.matrix_product(F.col("r"), F.col("r")).alias("rr")).first()
    assert abs(sum(x * x for x in q.q) - 1) < 1e-9 and q.e < 1e-9 and len(q.rr) == 9
    taken, rest = prep.sample_rows(spark.range(20), 5)
    assert taken.count() == 5 and rest.count() == 15
    assert [r.begin for r in prep.running_offsets(spark.createDataFrame([(0, 4), (1, 2), (2, 9)], "part int, n int")).orderBy("part").collect()] == [0, 4, 6]


def test_sources(spark, tmp_path):
    doc = {"image_width": 8, "image_height": 4, "calibration_matrix": [1.0] * 9, "images": [{"id": 1, "filename": "b.png", "room": "r"}, {"id": 0, "filename": "a.png", "room": "r"}]}
    (tmp_path / "views.json").write_text(json.dumps(doc))
    images = readers.read_images(spark, str(tmp_path / "views.json"))
    assert [r.id for r in images.collect()] == [0, 1]
    (tmp_path / "split.json").write_text(json.dumps({"query_views": [{"id": 0, "filename": "a.png", "room_labels": ["x"]}], "db_views": []}))
    assert readers.read_views(spark, str(tmp_path / "split.json"), "query").first().room_labels == ["x"]
    assert readers.read_views(spark, None, "query").count() == 0 and readers.read_views(spark, None, "db", images).count() == 2
    (tmp_path / "labels.csv").write_text("a,one\na,two\n")
    assert prep.label_rooms(images, readers.read_labels(spark, str(tmp_path / "labels.csv")), "line").orderBy("id").first().label == "two"
    (tmp_path / "clusters.json").write_text(json.dumps({"r": [{"ids": [1, 2]}, {"ids": [3]}], "note": "text"}))
    assert sorted(r.ids for r in readers.read_clusters(spark, str(tmp_path / "clusters.json")).collect()) == [[1, 2], [3]]
    np.save(tmp_path / "d.npy", np.array([[1, 2], [np.nan, np.nan]], np.float32))
    assert [r.vec for r in readers.read_npy(spark, str(tmp_path / "d.npy")).orderBy("id").collect()] == [[1.0, 2.0], None]
    (tmp_path / "rooms.txt").write_text("1 p1 7 hall\n2 p1 8 attic\n")
    assert readers.read_pano_rooms(spark, str(tmp_path / "rooms.txt")).first().room == "hall_7"
    (tmp_path / "p_pose_1_0.txt").write_text("1 0 0 1\n0 1 0 2\n0 0 1 3\n0 0 0 1\n")
    assert readers.read_matrices(spark, str(tmp_path / "p_pose_1_0.txt")).first().matrix[7] == 2.0
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"xx")
    assert readers.list_images(spark, str(tmp_path / "img")).first().length == 2
    readers.write_vectors(spark.range(10).selectExpr("id", "array(1.0F) AS vec"), str(tmp_path / "vec"), 3)
    assert sum(readers.read_shard(spark, str(tmp_path / "vec"), r, 3).count() for r in range(3)) == 10


def test_stream_ingest_and_search(spark, tmp_path):
    base = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id bigint, vec array<double>")
    spark.createDataFrame([(100, [3.4, 0.0]), (3, [3.0, 0.0])], base.schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    seen = []
    run = ingest.ingest(stream, build_index(base, Params("kmeans", branching=4)), str(tmp_path / "c1"), seen.append)
    run.processAllAvailable()
    run.stop()
    q = spark.createDataFrame([(1, [3.3, 0.0])], "qid bigint, vec array<double>")
    assert [r.id for r in seen[-1].search(q, 2, checks=-1).orderBy("rank").collect()] == [100, 3]
    asks = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in")).withColumnRenamed("id", "qid")
    run = ingest.search_stream(asks, base, 1, str(tmp_path / "out"), str(tmp_path / "c2"))
    run.processAllAvailable()
    run.stop()
    assert {(r.qid, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(100, 3), (3, 3)}


def test_cluster_count(spark):
    places = spark.createDataFrame([(i, [float(i % 3) * 10, 0.0]) for i in range(12)], "id bigint, vec array<double>")
    best = quantize.choose_count(places, 0.0, most=4).first()
    assert best.clusters == 3 and best.mean_dist < 1e-9


@pytest.mark.parametrize("name", ["l2", "l1", "max"])
def test_expressions_pair_all_but_rank_few(name, spark):
    rng = np.random.default_rng(7)
    data = rng.random((900, 9))
    data[100:140] = data[5]  # ties at the k-th place
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(5000, None)], "id bigint, vec array<double>")
    asked = points.where("id % 20 = 0 AND vec IS NOT NULL").withColumnRenamed("id", "qid")
    plain = lambda df: sorted((r.qid, r["rank"], r.id, round(r.dist, 9)) for r in df.collect())
    assert plain(knn.knn_expressions(asked, points, 7, name)) == plain(knn.knn_join(asked, points, 7, name))
    few = points.where("id < 4")
    assert plain(knn.knn_expressions(asked, few, 7, name)) == plain(knn.knn_join(asked, few, 7, name))
    limited = knn.knn_expressions(asked, points, 7, name)._jdf.queryExecution().optimizedPlan().toString()
    assert "most" in limited  # pairs beyond a query's bound aren't ranked


def test_a_budget_for_all_leaves_ranks_them_all(spark):
    rng = np.random.default_rng(9)
    vecs, of = rng.normal(size=(70, 5)), rng.integers(0, 12, 60)
    vecs[20] = vecs[30]  # a tie between leaves
    nodes = spark.createDataFrame([(f"{i:02}", 0 if i >= 60 else 1, i < 60, v.tolist()) for i, v in enumerate(vecs)], "node string, level int, is_leaf boolean, vec array<double>")
    edges = spark.createDataFrame([(f"{60 + i % 10:02}", f"{i:02}") for i in range(60)], "parent string, child string")
    panos = spark.createDataFrame([(f"{i:02}", f"p{x:02}", k) for i, p in enumerate(of) for k, x in ((1, p), (2, (p + 1) % 12))], "node string, pano string, pos int")
    asked = rng.normal(size=(6, 5))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "qid bigint, vec array<double>")
    got = {}
    for r in search.best_first(queries, nodes, edges, panos, [60, 1 << 40]).orderBy("rank").collect():
        assert r.n_distances == 70
        got.setdefault((r.qid, r.budget), []).append(r.pano)
    for i, q in enumerate(asked):
        order = sorted(range(60), key=lambda n: (-(vecs[n] @ q), n))
        want = list(dict.fromkeys(f"p{x:02}" for n in order for x in (of[n], (of[n] + 1) % 12)))
        assert got[i, 60] == got[i, 1 << 40] == want
