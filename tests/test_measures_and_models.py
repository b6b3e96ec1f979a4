"""Measures by hand, model invariants, persistence."""

from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from profilekit.operators import boosting, isotonic, kmeans, master, measures, model_runs, propensity, segments, views
from profilekit.session import scratch_path


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(round(rng.random(), 2)), int(rng.random() < 0.3)) for i in range(2000)]
    return spark.createDataFrame(rows, "id bigint, s double, y int")


def test_auc_equals_evaluator(scored):
    want = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(
        scored.withColumn("y", F.col("y").cast("double"))
    )
    got = measures.roc_auc(scored, "s", "y", slices=7).first()
    assert got.auc == pytest.approx(want, abs=1e-12)
    assert measures.roc_auc(scored, "s", "y").first().auc == pytest.approx(want, abs=1e-12)


def test_auc_edges(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (None, 1)], "s double, y int")
    assert measures.roc_auc(df, "s", "y").first().auc == 0.5
    assert measures.roc_auc(df.where("y = 1"), "s", "y").first().auc is None


@pytest.mark.parametrize("slices", [1, 64])
def test_folds_and_split_are_exact(scored, slices):
    folds = measures.stratified_folds(scored, "id", "y", 5, slices=slices)
    counts = folds.groupBy("y").pivot("fold", list(range(5))).count().collect()
    for r in counts:
        sizes = [r[str(i)] for i in range(5)]
        assert max(sizes) - min(sizes) <= 1
    split = measures.stratified_split(scored, "id", "y", 0.2, slices=slices)
    for r in split.groupBy("y").agg(F.count_if("es_test").alias("t"), F.count(F.lit(1)).alias("n")).collect():
        assert r.t == -(-r.n * 2 // 10)
    again = measures.stratified_folds(scored.repartition(13), "id", "y", 5, slices=1)
    assert {(r.id, r.fold) for r in folds.collect()} == {(r.id, r.fold) for r in again.collect()}


def test_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "t int, p int")
    got = {r.clase: r for r in measures.classification_report(df, "t", "p").collect()}
    assert tuple(got["noise"])[1:] == (0.0, 0.0, 0.0, 0)
    assert got["on_topic"].f1 == 1.0 and got["accuracy"].f1 == 1.0 and got["macro avg"].f1 == 0.5


def test_cluster_measures_by_hand(spark):
    pts = [(0, [0.0, 0.0], 0), (1, [0.0, 2.0], 0), (2, [10.0, 0.0], 1), (3, [10.0, 2.0], 1), (4, [5.0, 50.0], 2)]
    df = spark.createDataFrame(pts, "id int, v array<double>, l int")
    p, y = np.array([v for _, v, _ in pts]), np.array([label for *_, label in pts])

    def silhouette(power):
        d = np.linalg.norm(p[:, None] - p[None], axis=2) ** power
        out = []
        for i in range(len(p)):
            own = (y == y[i]) & (np.arange(len(p)) != i)
            if not own.any():
                out.append(0.0)
                continue
            a = d[i, own].mean()
            b = min(d[i, y == c].mean() for c in set(y) - {y[i]})
            out.append((b - a) / max(a, b))
        return np.mean(out)

    assert measures.silhouette_sample(df, "id", "v", "l") == pytest.approx(silhouette(1))
    assert measures.silhouette_squared(df, "v", "l") == pytest.approx(silhouette(2))
    cent = np.array([p[y == c].mean(axis=0) for c in range(3)])
    s = np.array([np.linalg.norm(p[y == c] - cent[c], axis=1).mean() for c in range(3)])
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(cent[i] - cent[j]) for j in range(3) if j != i) for i in range(3)])
    assert measures.davies_bouldin(df, "v", "l") == pytest.approx(db)


# --- segmentation ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        g = i % 3
        a, b = rng.normal([0, 6, 0][g], 0.5), rng.normal([0, 0, 6][g], 0.5)
        y = int(a + rng.normal(0, 0.6) > 3)
        rows.append((i, float(a), float(b), 1.0, ["x", "y", "z"][g], y, 0, int(i == 0)))
    return spark.createDataFrame(rows, "user_id bigint, a double, b double, k double, t string, tiene_p int, tiene_q int, tiene_r int")


RULES = [segments.NameRule("alto a", "a"), segments.NameRule("alto b", "b")]


def test_standardizer(spark, people):
    scaler = segments.Standardizer.fit(people, ["a", "k", "absent"])
    z = scaler.transform(people).agg(F.avg("z_a"), F.stddev_pop("z_a"), F.max("z_k"), F.min("z_k")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1) and z[2] == z[3] == 0
    path = scratch_path(spark, "scaler")
    scaler.save(spark, path)
    assert segments.Standardizer.load(spark, path) == scaler


def test_segmentation_finds_groups_and_reloads(spark, people):
    fitted = segments.Segmentation.fit(people, RULES, ["a", "b"], k=3, restarts=3)
    out = fitted.transform(people)
    pairs = {(r.t, r.segmento_nombre) for r in out.select("t", "segmento_nombre").distinct().collect()}
    assert len(pairs) == 3 and ("y", "alto a") in pairs and ("z", "alto b") in pairs
    path = scratch_path(spark, "segments")
    fitted.save(spark, path)
    again = segments.Segmentation.load(spark, path).transform(people)
    assert again.exceptAll(out).count() == 0
    other = segments.Segmentation.fit(people, RULES, ["a", "b"], k=3, restarts=3).transform(people)
    assert other.exceptAll(out).count() == 0  # same seed, same result


def test_sweep_cost_falls(people):
    vectors = segments.Standardizer.fit(people, ["a", "b"]).vectors(people)
    rows = segments.kmeans_sweep(vectors, ks=(2, 3, 4), restarts=3).orderBy("k").collect()
    assert rows[0].cost > rows[1].cost > rows[2].cost
    assert max(rows, key=lambda r: r.silhouette).k == 3


def test_pca_signs_and_spread(people):
    vectors = segments.Standardizer.fit(people, ["a", "b"]).vectors(people)
    row = segments.pca2(vectors).agg(F.var_pop("pca_x").alias("x"), F.var_pop("pca_y").alias("y")).first()
    assert row.x >= row.y and row.x + row.y == pytest.approx(2.0)


# --- propensity -----------------------------------------------------------------------------------------

QUICK = propensity.TreeParams(rounds=5, folds=2)


def test_eligibility_limits(spark):
    df = spark.range(100).select(
        (F.col("id") < 3).cast("int").alias("low"), (F.col("id") < 97).cast("int").alias("high"),
        (F.col("id") < 2).cast("int").alias("lower"), (F.col("id") < 98).cast("int").alias("higher"),
    )
    got = {r.col_target: r.elegible for r in propensity.target_eligibility(df, ["low", "high", "lower", "higher", "absent"]).collect()}
    assert got == {"low": True, "high": True, "lower": False, "higher": False, "absent": False}


def test_training_scores_and_reload(spark, people):
    targets = {"tiene_p": "P", "tiene_q": "Q", "tiene_r": "R"}
    trained = propensity.train_propensity(people, targets, ["a", "b", "t", "a"], QUICK)
    assert list(trained.ensembles) == ["tiene_p"]  # the others have no usable rate
    row = trained.metrics.first()
    assert row.test_auc > 0.9 and row.cv_auc_mean > 0.9 and row.top_features[0] in ("a", "t")
    scores = propensity.score_propensity(people, trained)
    got = scores.agg(F.min("prop_p"), F.max("prop_p"), F.count("prop_p")).first()
    assert 0 <= got[0] < got[1] <= 1 and got[2] == 300
    root = scratch_path(spark, "model")
    first = model_runs.save_run(trained, root, rounds=5)
    with pytest.raises(ValueError):
        model_runs.save_run(trained, root, first)
    again = model_runs.load_run(spark.newSession(), root)
    assert again.features == trained.features and again.products == {"tiene_p": "P"}
    moved = people.withColumn("t", F.when(F.col("user_id") == 5, "new").otherwise(F.col("t")))
    want = {tuple(r) for r in propensity.score_propensity(moved, trained).collect()}
    assert {tuple(r) for r in propensity.score_propensity(moved, again).collect()} == want
    # runs are appended, and the view reads what the job wrote
    second = model_runs.save_run(trained, root, at=datetime(2100, 1, 1))
    assert model_runs.runs(spark, root).count() == 2
    newest = views.latest_metrics(model_runs.runs(spark, root)).collect()
    assert [(r.run_id, r.producto, r.test_auc) for r in newest] == [(second, "P", row.test_auc)]
    with pytest.raises(LookupError):
        model_runs.load_run(spark, root, "absent")
    with pytest.raises(LookupError):
        model_runs.load_run(spark, scratch_path(spark, "none"))


def forests_of(models):
    return [
        (f.start, f.feature.tolist(), f.threshold.tolist(), f.value.tolist(), i.boundaries.tolist(), i.predictions.tolist())
        for e in models.ensembles.values() for f, i in e.members
    ]


def test_trees_do_not_depend_on_partitions(spark, people, monkeypatch):
    more = people.select("*", (F.col("user_id") % 3 == 0).cast("int").alias("tiene_s"))
    want = propensity.train_propensity(more, {"tiene_p": "P", "tiene_s": "S"}, ["a", "b", "t"], QUICK)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        got = propensity.train_propensity(more.repartition(7), {"tiene_p": "P", "tiene_s": "S"}, ["a", "b", "t"], QUICK)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert forests_of(got) == forests_of(want)
    # targets that are trained together are those trained alone
    monkeypatch.setattr(boosting, "DRIVER_BYTES", 0)  # and sums that executors add up are those the driver adds up
    alone = propensity.train_propensity(more, {"tiene_s": "S"}, ["a", "b", "t"], QUICK)
    assert forests_of(alone) == forests_of(want)[QUICK.folds :]


def plain_forest(x, y, chosen, params):
    """Boosted trees by trying every cut of every column."""
    p0 = y.mean()
    margin = np.full(len(y), np.log(p0 / (1 - p0)))
    for number in range(params.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((y - p) * 2**20), np.rint(p * (1 - p) * 2**20)
        use = chosen(number)

        def grow(rows, depth):
            own = rows & use
            best = None
            if depth:
                for f in range(x.shape[1]):
                    values = np.unique(x[:, f])
                    for cut in (values[:-1] + values[1:]) / 2:
                        left, right = own & (x[:, f] <= cut), own & (x[:, f] > cut)
                        if left.any() and right.any():
                            gain = left.sum() * right.sum() / own.sum() * (g[left].mean() - g[right].mean()) ** 2
                            if best is None or gain > best[0] * (1 + 1e-12):
                                best = gain, f, cut
            if best is None or best[0] <= 1e-9:
                return np.where(rows, params.rate * g[own].sum() / h[own].sum() if own.any() and h[own].sum() else 0.0, 0.0)
            _, f, cut = best
            return grow(rows & (x[:, f] <= cut), depth - 1) + grow(rows & (x[:, f] > cut), depth - 1)

        margin = margin + grow(np.ones(len(y), bool), params.depth)
    return margin


def test_forest_equals_trying_every_cut(spark):
    rng = np.random.default_rng(8)
    params = propensity.TreeParams(rounds=13, depth=3, rate=0.3, bins=64, rewrite=4)
    x = np.round(rng.normal(size=(160, 3)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.5, 160) > 0.3).astype(int)
    keys = [int(k) for k in rng.integers(-(2**62), 2**62, 160)]
    cuts = boosting.cut_points(x, params.bins)
    bins = boosting.to_bins(x, cuts)
    rows = [(k, bytes(b), bytes([int(v)]), bytes([int(i % 4 == 0)]), None) for i, (k, b, v) in enumerate(zip(keys, bins, y))]
    table = spark.createDataFrame(rows, "k long, bins binary, labels binary, folds binary, margins binary").repartition(3)
    (forest,) = boosting.fit_forests(table, [boosting.Model(0, 0, 1)], [len(c) + 1 for c in cuts], 1, 1, params)
    train = np.arange(160) % 4 != 0
    chosen = lambda number: boosting.picked(np.array(keys)[train], params.seed, number, params.subsample)
    want = plain_forest(x[train], y[train], chosen, params)
    assert forest.start + forest.margins(bins[train]) == pytest.approx(want, abs=1e-9)
    assert forest.importances(3).sum() == pytest.approx(1) and forest.importances(3).argmin() == 2


def test_a_level_counts_one_of_two_sisters_and_features_jointly(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n_bins = [5, 40, 2, 30]
    bins = np.stack([rng.integers(0, n, 500) for n in n_bins], axis=1).astype(np.uint8)
    node, weight, rows = rng.integers(0, 2, 300), rng.integers(-9, 9, 300).astype(float), np.sort(rng.permutation(500)[:300])
    joint = boosting.Joint(n_bins, 200)
    assert len(joint.groups) == 2  # the bins of both groups' features combine to 200 and 60 cells
    counted = np.zeros((2, int(joint.starts[-1])))
    joint.count(counted, joint.codes(np.ascontiguousarray(bins.T)), rows, node, weight)
    plain = [[weight[(node == k) & (bins[rows, f] == b)].sum() for f, n in enumerate(n_bins) for b in range(n)] for k in (0, 1)]
    assert joint.cells(counted).tolist() == plain

    sent, real = [], boosting.total
    monkeypatch.setattr(boosting, "total", lambda sums, parts, size: sent.append(size) or real(sums, parts, size))
    table = spark.createDataFrame(
        [(int(k), b.tobytes(), bytes([int(b[1] > 20)]), bytes([i % 3]), None) for i, (k, b) in enumerate(zip(rng.integers(0, 2**62, 500), bins))],
        "k long, bins binary, labels binary, folds binary, margins binary",
    )
    boosting.fit_forests(table, [boosting.Model(0, 0, 1)], n_bins, 1, 1, propensity.TreeParams(rounds=1))
    assert sent == [8 * sum(n_bins) * k for k in (2, 2, 8)]  # G and n of 1, 1 and 2 nodes, H of 4
    assert boosting.parts_of(900_000) <= 24  # every task sends one sum per model


@pytest.mark.parametrize("residual", [1 << 20, -(1 << 20)])
def test_sums_come_apart_after_features_were_told_apart(residual):
    """A whole block of the largest residuals in one bin of one feature: G and n are exact though the cells were added up packed."""
    joint, n = boosting.Joint([8, 3, 4], 1024), boosting.PACKED_ROWS
    bins = np.stack([np.arange(n) % 8, np.zeros(n, int), np.arange(n) % 4]).astype(np.uint8)
    counted = np.zeros((1, int(joint.starts[-1])))
    joint.count(counted, joint.codes(bins), np.arange(n), np.zeros(n, np.int64), np.full(n, residual + boosting.PACKED))
    g, number = boosting.unpacked(joint.cells(counted))
    want = [n // 8] * 8 + [n, 0, 0] + [n // 4] * 4
    assert number.tolist() == [want] and g.tolist() == [[residual * w for w in want]]


@pytest.mark.parametrize("distinct", [40, 20_000])
def test_isotonic_blocks_equal_the_sequential_fit(spark, distinct):
    rng = np.random.default_rng(distinct)
    scores = rng.integers(0, distinct, 20_000) / distinct
    labels = (rng.random(20_000) < 0.2 + 0.6 * scores).astype(int)
    groups = rng.integers(0, 3, 20_000)
    df = spark.createDataFrame([(int(g), float(s), int(y)) for g, s, y in zip(groups, scores, labels)], "m long, p double, y int")
    got = isotonic.fit_isotonic(df.repartition(11), "m", "p", "y")
    assert sorted(got) == [0, 1, 2]
    for k in got:
        p, y = scores[groups == k], labels[groups == k]
        blocks = []
        for s in np.unique(p):
            blocks.append([s, s, int(y[p == s].sum()), int((p == s).sum())])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
                low, _, a, b = blocks.pop(-2)
                blocks[-1] = [low, blocks[-1][1], blocks[-1][2] + a, blocks[-1][3] + b]
        edges = [e for low, high, _, _ in blocks for e in ([low, high] if high > low else [low])]
        assert got[k].boundaries.tolist() == edges
        assert got[k].predictions.tolist() == [a / n for low, high, a, n in blocks for _ in range(1 + (high > low))]
    assert isotonic.IsotonicMap(np.zeros(0), np.zeros(0))(np.array([0.3])) == [0.3]


def test_grouped_auc_equals_one_by_one(spark, scored):
    many = scored.withColumn("g", F.col("id") % 4)
    got = {r.g: (r.n_pos, r.n_neg, r.auc) for r in measures.grouped_auc(many, "g", "s", "y", slices=5).collect()}
    for g in range(4):
        one = measures.roc_auc(many.where(F.col("g") == g), "s", "y").first()
        assert got[g] == (one.n_pos, one.n_neg, pytest.approx(one.auc, abs=1e-12))


def test_folds_of_all_targets_are_even(spark, people):
    params = propensity.TreeParams(folds=5)
    holed = people.withColumn("tiene_h", F.when(F.col("user_id") % 7 > 0, F.col("tiene_p")))
    table = propensity.fold_table(holed, ["tiene_p", "tiene_h"], params).join(holed, "user_id")
    for i, t in enumerate(["tiene_p", "tiene_h"]):
        cross, inner = F.col("folds")[2 * i], F.col("folds")[2 * i + 1]
        counts = {}
        for r in table.groupBy(t, cross.alias("c"), inner.alias("k")).count().collect():
            if r[t] is None:
                assert (r.c, r.k) == (-1, -1)
                continue
            for system, fold in (("c", r.c), ("k", r.k)):
                counts[(system, r[t], fold)] = counts.get((system, r[t], fold), 0) + r["count"]
        for y in (0, 1):
            sizes = [counts[("c", y, f)] for f in range(5)]
            inner_sizes = [counts[("k", y, f)] for f in range(5)]
            assert max(sizes) - min(sizes) <= 1 and max(inner_sizes) - min(inner_sizes) <= 1
            assert counts[("k", y, -2)] == -(-sum(sizes) * 2 // 10)


def test_category_codes_are_ranked_in_ranges(spark):
    rows = [(i, f"l{(i * 7919) % 5000:05d}", ["b", "a", None][i % 3]) for i in range(12_000)]
    df = spark.createDataFrame(rows, "user_id long, u string, v string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        encoder = master.CategoryEncoder(["u", "v", "absent"]).fit(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert encoder.codes.rdd.getNumPartitions() >= 1 and encoder.sizes == [5000, 2]
    for r in encoder.transform(df).collect():
        assert r.u_code == int(r.u[1:]) and r.v_code == {"a": 0, "b": 1, None: 2}[r.v]
    unseen = spark.createDataFrame([(1, "zz", "a")], df.schema)
    assert [tuple(r)[3:] for r in encoder.transform(unseen).collect()] == [(5000, 0)]


def test_nearest_centres_take_the_first_of_equals():
    points, centres = np.array([[0.0, 1.0], [4.0, 1.0], [2.0, 0.0]]), np.array([[1.0, 1.0], [3.0, 1.0], [1.0, 1.0]])
    far = kmeans.squared_distances(points.T, centres)
    assert far.shape == (3, 3)  # a row per centre, of which a fit looks at its own only
    own, least = kmeans.nearest_of(far)
    assert own.tolist() == [0, 1, 0] and least.tolist() == [1.0, 1.0, 2.0]


def test_all_restarts_share_their_scans(spark, people, monkeypatch):
    vectors = people.select("user_id", F.array("a", "b").alias("features"))
    scans, real = [], kmeans._pass
    monkeypatch.setattr(kmeans, "_pass", lambda rows, fits, width: scans.append(len(fits)) or real(rows, fits, width))
    best = kmeans.fit_all(vectors, [(2, 4), (3, 4)])
    assert scans[0] == 8 and scans[-1] == 8 and len(scans) < 40 and min(scans) < 8  # those at rest drop out
    points = np.array([r.features for r in vectors.orderBy("user_id").collect()])
    for k, fit in best.items():
        far = ((points[:, None] - fit.centres[None]) ** 2).sum(axis=2)
        assert fit.cost == pytest.approx(far.min(axis=1).sum(), rel=1e-4)
        own = far.argmin(axis=1)
        means = np.array([points[own == c].mean(axis=0) for c in range(k)])
        assert ((means - fit.centres) ** 2).sum() < 1e-3
    again = kmeans.fit_all(vectors.repartition(6), [(3, 4)])
    assert (again[3].centres == best[3].centres).all() and again[3].cost == best[3].cost
    assert kmeans.fit_all(vectors.limit(0), [(2, 1)]) == {}
    same = kmeans.fit_all(vectors.limit(1), [(3, 2)])[3]  # fewer rows than clusters
    assert same.cost == pytest.approx(0, abs=1e-9)


def test_missing_features_count_as_zero(people):
    trained = propensity.train_propensity(people, {"tiene_p": "P"}, ["a", "b"], QUICK)
    assert propensity.score_propensity(people.drop("b"), trained).count() == 300


def test_shuffled_labels_give_no_signal(people):
    noise = people.withColumn("tiene_p", (F.pmod(F.xxhash64("user_id", F.lit(9)), F.lit(2))).cast("int"))
    frame, _ = propensity.training_frame(noise, ["tiene_p"], ["a", "b"])
    aucs = [r.auc for r in propensity.cv_auc(frame, "tiene_p", QUICK).collect()]
    assert abs(np.mean(aucs) - 0.5) < 0.12


def test_calibration_is_monotone_per_member(people):
    frame, _ = propensity.training_frame(people, ["tiene_p"], ["a", "b"])
    ensemble = propensity.CalibratedEnsemble.fit(frame, "tiene_p", QUICK)
    assert len(ensemble.members) == QUICK.folds
    for _, iso in ensemble.members:
        values = list(iso.predictions)
        assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1


def test_registered_learners_do_the_whole_job(monkeypatch):
    """The queries pass no fewer rounds, folds, restarts or targets than the library's defaults."""
    from profilekit.operators import segments
    from profilekit.plans import queries_models as qm

    seen = {}

    class Stop(Exception):
        pass

    def caught(name):
        def run(*args, **options):
            seen[name] = (args, options)
            raise Stop

        return run

    monkeypatch.setattr(qm, "written_master", lambda *_: None)
    monkeypatch.setattr(propensity, "train_propensity", caught("train"))
    monkeypatch.setattr(segments, "kmeans_sweep", caught("sweep"))
    monkeypatch.setattr(segments.Segmentation, "fit", caught("segments"))
    monkeypatch.setattr(segments.Standardizer, "fit", lambda df: type("S", (), {"vectors": lambda self, df: None})())
    monkeypatch.setattr(qm, "scratch_path", lambda *_: "")
    learners = (qm.propensity_train, qm.propensity_metrics, qm.propensity_scores, qm.cv_auc, qm.calibrated_scores)
    for run, name in (*((q, "train") for q in learners), (qm.kmeans_sweep, "sweep"), (qm.kmeans_segments, "segments")):
        seen.clear()
        with pytest.raises(Stop):
            run(SimpleNamespace(), None)
        assert seen[name][1] == {}
    seen.clear()
    with pytest.raises(Stop):
        qm.cv_auc(SimpleNamespace(), None)
    assert list(seen["train"][0][1]) == [f"tiene_{t}" for t in qm.TYPES] and len(seen["train"][0]) == 2
