import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import logweir.operators.dbscan as DB
import logweir.operators.neighbors as NB
from logweir.operators.components import connected_components
from logweir.operators.elliptic import EllipticEnvelope, chi2_quantile
from logweir.operators.evaluate import evaluate
from logweir.operators.iforest import IForest, draw_samples, grow_trees, mean_path, path_lengths
from logweir.operators.lof import Lof
from logweir.operators.svm import OneClassSvm
from logweir.operators.sweep import sweep
from logweir.operators.threshold import contamination_offset, exact_quantile


def frame(spark, x):
    rows = [(f"b{i:04d}", list(range(len(r))), [float(v) for v in r], [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "block_id string, idx array<int>, val array<double>, features array<double>")


def cloud(n=300, d=3, far=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:far] = rng.normal(size=(far, d)) * 0.3 + 9
    return x


# -- thresholds -------------------------------------------------------------------

def test_quantile_is_exact_at_any_size(spark):
    x = np.random.default_rng(1).normal(size=2000).round(3)
    df = spark.createDataFrame([(float(v),) for v in x], "score double").repartition(4)
    for q in (0.01, 0.029, 0.5):
        want = np.percentile(x, 100 * q)
        assert exact_quantile(df, "score", q) == pytest.approx(want, abs=1e-12)
        assert exact_quantile(df, "score", q, exact_rows=50) == pytest.approx(want, abs=1e-12)


def test_quantile_of_few_distinct_values(spark):
    x = [0.0] * 900 + [1.0] * 100
    df = spark.createDataFrame([(v,) for v in x], "score double")
    for q in (0.1, 0.899, 0.9, 0.95):
        assert exact_quantile(df, "score", q, exact_rows=10) == pytest.approx(np.percentile(x, 100 * q))


@pytest.mark.parametrize("c", [0.0, 0.6, -0.1])
def test_contamination_range(spark, c):
    with pytest.raises(ValueError):
        contamination_offset(spark.createDataFrame([(1.0,)], "score double"), c)


# -- forest -----------------------------------------------------------------------

def test_trees_isolate_every_row():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 64, 2))
    f, s, p = grow_trees(x, 6, rng)
    for t in range(3):
        lengths = path_lengths(x[t], f[t : t + 1], s[t : t + 1], p[t : t + 1])
        assert lengths.min() > 0 and lengths.max() <= 6 + mean_path([64])[0]
    # a leaf's path is only stored where the feature is -1
    assert (p[f >= 0] == 0).all()


def test_constant_rows_give_one_leaf():
    f, _, p = grow_trees(np.ones((1, 10, 2)), 4, np.random.default_rng(0))
    assert f[0, 0] == -1 and p[0, 0] == pytest.approx(mean_path([10])[0])


def test_forest_scores_and_share(spark):
    df = frame(spark, cloud())
    _, out = IForest(50, 0.03).fit_decide(df)
    rows = {r.block_id: r for r in out.collect()}
    assert all(-1 < r.score < 0 for r in rows.values())
    assert sum(r.is_anomaly for r in rows.values()) == 9
    assert all(rows[f"b{i:04d}"].is_anomaly for i in range(6))


def test_forest_does_not_depend_on_partitioning(spark):
    df = frame(spark, cloud(600))
    a = {r.block_id: r.score for r in IForest(16).fit(df.repartition(1)).score(df).collect()}
    b = {r.block_id: r.score for r in IForest(16).fit(df.repartition(6)).score(df.repartition(3)).collect()}
    assert a == b


@pytest.mark.parametrize("n", [300, 1200, 5000])
def test_samples_fill_every_tree(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("block_id"), F.array(F.lit(0)).alias("idx"), F.array(F.col("id").cast("double")).alias("val"))
    got = draw_samples(df, n, 8, 256, 42).groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("block_id").alias("d")).collect()
    assert len(got) == 8 and all(r.n == r.d and r.n > 200 and r.n <= 256 for r in got)


# -- neighbourhoods and density ------------------------------------------------------

def brute_dbscan(x, eps, ms):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    ok = d <= eps
    core = ok.sum(1) >= ms
    root = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and root[i] < 0:
            todo, root[i] = [i], i
            while todo:
                for b in np.flatnonzero(ok[todo.pop()] & core & (root < 0)):
                    root[b] = i
                    todo.append(b)
    for i in np.flatnonzero(~core):
        near = root[ok[i] & core]
        if len(near):
            root[i] = near.min()
    return root


@pytest.mark.parametrize("chunk, ms", [(2000, 2), (7, 1), (7, 2), (7, 4)])
def test_dbscan_equals_brute_force(spark, monkeypatch, chunk, ms):
    monkeypatch.setattr(NB, "CHUNK", chunk)
    monkeypatch.setattr(DB, "CHUNK", chunk)
    x = np.random.default_rng(ms).normal(size=(60, 2)).round(1) * 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "block_id long, features array<double>")
    got = {r.block_id: r.cluster for r in DB.dbscan(df, 0.45, ms).collect()}
    want = brute_dbscan(x, 0.45, ms)
    assert [-1 if got[i] is None else got[i] for i in range(60)] == want.tolist()


def test_hot_point_and_dense_blob(spark, monkeypatch):
    """A third of all rows are one vector, another third sits within eps."""
    monkeypatch.setattr(NB, "CHUNK", 10)
    monkeypatch.setattr(DB, "CHUNK", 10)
    rng = np.random.default_rng(2)
    x = np.vstack([np.zeros((40, 2)), rng.normal(size=(40, 2)) * 0.01 + 3, rng.uniform(-9, 9, (40, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "block_id long, features array<double>")
    got = {r.block_id: r.cluster for r in DB.dbscan(df, 0.5, 2).collect()}
    assert [-1 if got[i] is None else got[i] for i in range(120)] == brute_dbscan(x, 0.5, 2).tolist()
    n = {r.block_id: r.n_neighbors for r in NB.epsilon_neighbors(df, 0.5).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert [n[i] for i in range(120)] == (d <= 0.5).sum(1).tolist()


@pytest.mark.parametrize("ms", [2, 4])
def test_neighbourhoods_without_copies_of_the_points(spark, monkeypatch, ms):
    """Where every point has to look into most cells, no point is sent to them: nothing is exploded or shuffled by cell."""
    monkeypatch.setattr(NB, "CHUNK", 10)
    monkeypatch.setattr(DB, "CHUNK", 10)
    monkeypatch.setattr(NB, "MERGE_ROWS", 40)
    rng = np.random.default_rng(ms)
    x = np.vstack([rng.normal(size=(90, 8)).round(1), np.zeros((20, 8)), rng.normal(size=(30, 8)) * 0.05 + 2])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "block_id long, features array<double>")
    cells = NB.build_cells(NB.distinct_points(df))
    plan = NB.epsilon_counts(cells, 1.5)._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "FlatMapGroupsInPandas" not in plan
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    n = {r.block_id: r.n_neighbors for r in NB.epsilon_neighbors(df, 1.5).collect()}
    assert [n[i] for i in range(140)] == (d <= 1.5).sum(1).tolist()
    got = {r.block_id: r.cluster for r in DB.dbscan(df, 1.5, ms).collect()}
    assert [-1 if got[i] is None else got[i] for i in range(140)] == brute_dbscan(x, 1.5, ms).tolist()


@pytest.mark.parametrize("copies", [0, 1000])
def test_nearest_neighbours_by_chunks_and_by_product(spark, monkeypatch, copies):
    monkeypatch.setattr(NB, "CHUNK", 20)
    monkeypatch.setattr(NB, "COPIES", copies)
    monkeypatch.setattr(NB, "MERGE_ROWS", 100)
    x = np.random.default_rng(6).normal(size=(150, 6))
    rows = [(f"b{i:03d}", v.tolist()) for i, v in enumerate(x)]
    cells = NB.build_cells(NB.distinct_points(spark.createDataFrame(rows, "block_id string, features array<double>")))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = {(int(r.pid[1:]), int(r.other[1:])): r.d for r in NB.nearest_neighbors(cells, 5).collect()}
    assert set(got) == {(i, int(j)) for i in range(150) for j in np.argsort(d[i])[:5]}
    assert all(v == pytest.approx(d[i, j], rel=1e-9) for (i, j), v in got.items())


def test_links_of_a_dense_chunk_are_one_star():
    pairs = pd.DataFrame([(u, v) for u in range(3, 30) for v in range(30, 60)] + [(1, 2), (70, 71), (71, 2)], columns=["u", "v"])
    got = DB.star_links(pairs)
    assert sorted(zip(got.u, got.v)) == [(2, 1), *[(i, 3) for i in range(4, 60)], (70, 1), (71, 1)]
    assert not len(DB.star_links(pairs[:0]))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40) if i != 20]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: (0 if i <= 20 else 21) for i in range(41)}


def brute_lof(x, k):
    n = len(x)
    k = min(k, n - 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    fit = d + np.where(np.eye(n, dtype=bool), np.inf, 0)
    kd = np.sort(fit, 1)[:, k - 1]

    def lrd(dist):
        order = np.argsort(dist, 1, kind="stable")[:, :k]
        reach = np.maximum(np.take_along_axis(dist, order, 1), kd[order])
        return order, 1 / (reach.mean(1) + 1e-10)

    _, trained = lrd(fit)
    order, own = lrd(d)
    return -(trained[order] / own[:, None]).mean(1)


@pytest.mark.parametrize("chunk", [2000, 16])
def test_lof_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(NB, "CHUNK", chunk)
    x = cloud(60, 2, 3, 5)
    got = {r.block_id: r.score for r in Lof(5).score(frame(spark, x)).collect()}
    assert np.allclose([got[f"b{i:04d}"] for i in range(60)], brute_lof(x, 5))


def test_lof_with_copies(spark):
    x = np.repeat(cloud(20, 2, 2, 6), 3, axis=0)
    got = {r.block_id: r.score for r in Lof(4).score(frame(spark, x)).collect()}
    want = brute_lof(x, 4)
    # which of several equally distant points is the last neighbour is open
    assert np.corrcoef([got[f"b{i:04d}"] for i in range(60)], want)[0, 1] > 0.9


# -- envelopes ---------------------------------------------------------------------

@pytest.mark.parametrize("model", [EllipticEnvelope(), OneClassSvm(0.05, 40)])
def test_far_points_score_lowest(spark, model):
    out = model.score(frame(spark, cloud())).orderBy("score").limit(6).collect()
    assert {r.block_id for r in out} <= {f"b{i:04d}" for i in range(300)}
    if isinstance(model, EllipticEnvelope):
        assert {r.block_id for r in out} == {f"b{i:04d}" for i in range(6)}


def test_svm_flags_isolated_points(spark):
    x = np.vstack([np.random.default_rng(0).normal(size=(200, 2)) * 0.5, [[8, 8], [-8, 8], [8, -8]]])
    out = OneClassSvm(0.05, 60).score(frame(spark, x)).orderBy("score").limit(3).collect()
    assert {r.block_id for r in out} == {"b0200", "b0201", "b0202"}


def test_robust_location_survives_a_dense_minority(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(200, 2)), rng.normal(size=(40, 2)) * 0.1 + [8, 0]])
    out = EllipticEnvelope().score(frame(spark, x)).orderBy("score").limit(40).collect()
    assert len({r.block_id for r in out} & {f"b{i:04d}" for i in range(200, 240)}) == 40


def test_a_large_cluster_does_not_mask_itself(spark):
    """40 % of the rows in one cluster, towards which the fit of all rows leans; found from several starts."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(120, 2)), rng.normal(size=(80, 2)) * 0.8 + [7, 7]])
    out = EllipticEnvelope().score(frame(spark, x)).orderBy("score").limit(80).collect()
    assert {r.block_id for r in out} == {f"b{i:04d}" for i in range(120, 200)}


def test_concentration_ends_where_the_plain_algorithm_does(spark):
    """The robust half has a determinant as small as the best of many plain searches."""
    x = np.vstack([cloud(150, 3, 0, 4), np.random.default_rng(5).normal(size=(60, 3)) * 0.3 + 5])
    space, best = EllipticEnvelope().fit(frame(spark, x))
    z, half = (x - space.mean) @ space.root, int(np.ceil((len(x) + 4) / 2))
    rng, least = np.random.default_rng(0), np.inf
    for _ in range(300):
        near = rng.choice(len(x), 5, replace=False)
        for _ in range(30):
            c = np.cov(z[near].T, bias=True) + 1e-12 * np.eye(3)
            d = ((z - z[near].mean(0)) @ np.linalg.inv(c) * (z - z[near].mean(0))).sum(1)
            near = np.argsort(d)[:half]
        least = min(least, np.linalg.slogdet(np.cov(z[near].T, bias=True))[1])
    assert best.logdet <= least + 0.05


def test_one_class_gap_and_optimum(spark):
    """The gap that is reported holds against a long plain search on the same features."""
    from logweir.operators import svm
    from logweir.operators.vectors import weighted_rows

    x = np.vstack([cloud(120, 2, 0, 7), np.repeat(cloud(5, 2, 0, 9), 20, axis=0)])
    phi = svm.rbf_map(np.unique(x[::7], axis=0), 0.5)
    w, gap = svm.solve_one_class(weighted_rows(frame(spark, x)), phi, 0.1)
    assert gap <= 1e-3
    f, k = phi(x), int(0.1 * len(x))
    v = f.mean(0)
    for t in range(20_000):
        low = f[np.argpartition(f @ v, k)[:k]].mean(0)
        step = low - v
        a = min(1.0, max(0.0, -float(v @ step) / max(float(step @ step), 1e-300)))
        v = v + a * step
    assert w @ w <= (v @ v) * 1.005
    assert svm.least_norm(np.array([[1.0, 1.0], [1.0, -1.0], [3.0, 0.0]]), np.array([0.0, 0.0, 1.0]), 1e-9) == pytest.approx([0.5, 0.5, 0.0])


def test_constant_columns_do_not_break_the_envelope(spark):
    x = np.hstack([cloud(100, 2), np.full((100, 1), 4.0)])
    assert EllipticEnvelope().score(frame(spark, x)).where("isnan(score)").count() == 0
    with pytest.raises(ValueError):
        EllipticEnvelope().score(frame(spark, np.ones((10, 2))))


def test_chi2():
    assert chi2_quantile(0.975, 10) == pytest.approx(20.483, abs=0.05)


# -- evaluation and sweep -------------------------------------------------------------

def score(spark, pairs):
    blk = spark.createDataFrame([(str(i), p) for i, (p, _) in enumerate(pairs)], "block_id string, is_anomaly boolean")
    lab = spark.createDataFrame([(str(i), a) for i, (_, a) in enumerate(pairs) if a is not None], "block_id string, is_anomaly boolean")
    return evaluate(blk, lab).first()


def test_evaluation_goldens(spark):
    r = score(spark, [(True, True), (False, False), (True, True)])
    assert (r.precision, r.recall, r.f1, r.true_positives, r.true_negatives) == (1.0, 1.0, 1.0, 2, 1)
    r = score(spark, [(False, True), (True, False)])
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)
    assert score(spark, [(True, True), (True, None)]).total_blocks == 1


def test_sweep_ranks_and_skips(spark, make_events):
    rows = [(i, f"b{i % 60}", i % 4) for i in range(600)]
    rows += [(600 + i, "b7", 9, "ERROR") for i in range(40)]
    ev = make_events(rows)
    lab = spark.createDataFrame([(f"b{i}", i == 7) for i in range(60)], "block_id string, is_anomaly boolean")
    out = sweep(ev, lab, ("isolation_forest", "elliptic"), grids={
        "isolation_forest": {"contamination": [0.02, 0.05], "n_estimators": [20]}, "elliptic": {"contamination": [0.05]},
    }).collect()
    assert len(out) == 3 and out[0].f1 == max(r.f1 for r in out) and sum(r.is_best for r in out) == 1
    assert out[0].model_key == "isolation_forest" and out[0].f1 > 0.5
    flat = make_events([(i, f"b{i}", 1) for i in range(30)])
    skipped = sweep(flat, lab, ("elliptic",), "freq_only", {"elliptic": {"contamination": [0.05]}}).first()
    assert skipped.skipped and skipped.f1 == -1.0


@pytest.mark.parametrize("width", [3, 300])
def test_nearest_neighbours_are_exact_far_from_the_origin(spark, width):
    x = 1e6 + np.random.default_rng(4).normal(size=(60, width)) * 1e-3
    rows = [(f"b{i:02d}", v.tolist()) for i, v in enumerate(x)]
    cells = NB.build_cells(NB.distinct_points(spark.createDataFrame(rows, "block_id string, features array<double>")), 60)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = {(int(r.pid[1:]), int(r.other[1:])): r.d for r in NB.nearest_neighbors(cells, 5).collect()}
    assert set(got) == {(i, int(j)) for i in range(60) for j in np.argsort(d[i])[:5]}
    assert all(v == pytest.approx(d[i, j], rel=1e-6) for (i, j), v in got.items())


def test_shares_of_one_class_svm_are_fitted_together(spark, monkeypatch):
    """A sweep reads the rows as often for three shares as for the one that takes longest, with the same scores."""
    import logweir.operators.svm as SV

    df = frame(spark, cloud(120)).cache()
    nus, passes, real = [0.02, 0.1, 0.3], [], SV.sum_rows
    monkeypatch.setattr(SV, "sum_rows", lambda *a, **k: passes.append(1) or real(*a, **k))
    alone, one = [], []
    for nu in nus:
        passes.clear()
        one.append({r.block_id: r.score for r in OneClassSvm(nu, 40).score(df).collect()})
        alone.append(len(passes))
    passes.clear()
    together = [{r.block_id: r.score for r in out.collect()} for out in OneClassSvm(n_components=40).score_all(df, nus)]
    assert len(passes) == max(alone) < sum(alone)
    for a, b in zip(one, together):
        assert all(b[k] == pytest.approx(v, abs=1e-6) for k, v in a.items())
