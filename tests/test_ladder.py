import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions.geometry import inverse, mapped, product
from gaugeflow.operators import ladder, robust, stability

COARSE = np.array([[0.9, -0.1, 30], [0.1, 0.9, -12], [0, 0, 1.0]])
FINE = np.array([[1.02, 0.01, 3], [-0.02, 0.99, 5], [1e-5, -2e-5, 1.0]])


def move(h, p):
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    return q[:, :2] / q[:, 2:]


def bend(p):
    return p + 6 * np.sin(p[:, ::-1] / 120)


def scene(pair, seed, coarse=True, methods=(1, 2, 4), n=120, points=8):
    """Rows of landmarks, matches and control points of a pair whose target is bent a little."""
    draw = np.random.default_rng(seed)
    def truth(p):
        return bend(move(FINE @ COARSE, p))

    marks = draw.random((30, 2)) * 500
    onto = move(COARSE, marks)
    onto[:8] += 300
    land = [(pair, *map(float, r)) for r in np.hstack([marks, onto])] if coarse else []
    matches = []
    for m in methods:
        raw = draw.random((n, 2)) * 500
        seen = move(COARSE, raw) if m < 4 and coarse else raw
        to = truth(raw) + draw.normal(0, {1: 0.1, 2: 1.5, 3: 0.5, 4: 0.7}[m], raw.shape)
        to[: n // 4] = draw.random((n // 4, 2)) * 500
        matches += [(pair, m, k, *map(float, r)) for k, r in enumerate(np.hstack([seen, to]))]
    at = draw.random((points, 2)) * 400 + 50
    return land, matches, [(pair, k, *map(float, r)) for k, r in enumerate(np.hstack([at, truth(at)]))]


@pytest.fixture(scope="module")
def results(spark):
    scenes = [scene("full", 1), scene("no coarse", 2, coarse=False), scene("few points", 3, points=2), scene("only noise", 4, methods=()), scene("large", 5, methods=(3,), n=3000)]
    land, matches, control = (sum((s[k] for s in scenes), []) for k in range(3))
    pairs = spark.createDataFrame([(p, 5.0, 500, 400) for p in ("full", "no coarse", "few points", "only noise", "large", "nothing")], "pair string, px_per_mm double, w int, h int")
    made = ladder.run(
        pairs,
        spark.createDataFrame(land, "pair string, x double, y double, u double, v double"),
        spark.createDataFrame(matches, "pair string, method int, id long, x double, y double, u double, v double"),
        spark.createDataFrame(control, "pair string, id int, x double, y double, u double, v double"),
    )
    return made, {(r.pair, r.method): r for r in made.results.collect()}


def test_every_pair_has_every_method(results):
    _, rows = results
    assert sorted(rows) == sorted((p, m) for p in ("full", "no coarse", "few points", "only noise", "large", "nothing") for m in range(6))
    assert all(r.ok == (r.note is None) == (r.median_mm is not None) for r in rows.values())


def test_the_spline_beats_its_base(results):
    _, rows = results
    for pair in ("full", "no coarse", "large"):
        spline = rows[pair, 5]
        base = rows[pair, spline.base]
        assert spline.ok and spline.median_mm < base.median_mm < rows[pair, 2 if (pair != "large") else 3].median_mm + 1e-9
        assert base.median_mm == min(rows[pair, m].median_mm for m in range(1, 5) if rows[pair, m].ok) and base.median_mm < 1.2
    assert rows["full", 0].n_inliers == 22 and rows["full", 0].ok and not rows["no coarse", 0].ok
    assert rows["large", 5].n_matches == 3000 and 300 < rows["large", 5].n_inliers <= 500


def test_reasons(results):
    _, rows = results
    assert rows["few points", 1].note == "2 shared control points" and rows["few points", 5].note == "no method to build on"
    assert rows["nothing", 0].note == "no matches" and rows["only noise", 3].note == "no matches" and rows["nothing", 5].note == "no method to build on"


def test_statistics_equal_numpy(results):
    _, rows = results
    control = np.array([r[2:] for r in scene("full", 1)[2]])
    r = rows["full", 0]
    # A pair's method 0 maps by the coarse similarity, whose rounding is beyond what is compared.
    mm = np.hypot(*(move(COARSE, control[:, :2]) - control[:, 2:]).T) / 5
    assert np.allclose([r.median_mm, r.p90_mm, r.p95_mm, r.max_mm], [np.median(mm), *np.percentile(mm, [90, 95]), mm.max()], rtol=1e-6)
    radius = np.hypot(*(control[:, 2:] - [250, 200]).T)
    assert np.isclose(r.radial_r, np.corrcoef(radius, mm)[0, 1], rtol=1e-6) and 0 < r.radial_p < 1


def test_twins_lead_back(spark, results):
    made, _ = results
    points = spark.createDataFrame([("full", k, float(x), float(y)) for k, (x, y) in enumerate([(100, 100), (250, 200), (300, 150)])], "pair string, id int, x double, y double")
    from gaugeflow.operators.registration import map_points

    there = map_points(points, made.splines, "pair").select("pair", "id", F.col("u").alias("x"), F.col("v").alias("y"))
    back = {r.id: (r.u, r.v) for r in map_points(there, made.inverse_splines, "pair").collect()}
    assert all(np.hypot(back[r.id][0] - r.x, back[r.id][1] - r.y) < 0.5 for r in points.collect())


def test_medians_that_differ_by_rounding_are_ties(spark):
    """Two methods lie as far beside the truth, the second one nearer by no more than rounding: the first one counts."""
    at = np.random.default_rng(3).random((40, 2)) * 400
    matches = [("a", m, k, *map(float, p), float(p[0] + d), float(p[1])) for m, d in ((1, 2.0), (2, 2.0 - 1e-10), (4, 3.0)) for k, p in enumerate(at)]
    control = [("a", k, *map(float, p), *map(float, p)) for k, p in enumerate(at[:9] + 3)]
    pairs = spark.createDataFrame([("a", 5.0, 600, 500)], "pair string, px_per_mm double, w int, h int")
    kinds = ("pair string, x double, y double, u double, v double", "pair string, method int, id int, x double, y double, u double, v double", "pair string, id int, x double, y double, u double, v double")
    made = ladder.run(pairs, *(spark.createDataFrame(rows, kind) for rows, kind in zip(([], matches, control), kinds)))
    assert {r.base for r in made.results.collect() if r.method == 5} == {1}


def test_homography_of_many_matches():
    """Memory grows with the matches, not with their square (as it did: 115 GB here), and all of them count."""
    src = np.random.default_rng(5).random((60_000, 2)) * 500
    dst = move(FINE, src) + np.repeat([[0.4, 0.0], [-0.4, 0.0]], 30_000, axis=0)
    h = robust.homography_of(src, dst)
    assert np.abs(move(h, src) - move(FINE, src)).max() < 0.02
    few = robust.homography_of(src[::15_000], dst[::15_000])
    assert np.allclose(move(few, src[::15_000]), dst[::15_000])


def test_verdict_counts_coverage(results):
    made, rows = results
    v = {r.method: r for r in ladder.verdict(made.results).collect()}
    assert v[5].rank == 1 and v[5].n_ok == 3 and v[5].coverage == 0.5 and v[5].verdict == "GO" and v[1].verdict is None
    assert np.isclose(v[5].median, np.median([rows[p, 5].median_mm for p in ("full", "no coarse", "large")]))


def test_matrices(spark):
    a, b = ([float(x) for x in m.ravel()] for m in (COARSE, FINE))
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    r = df.select(product(F.col("b"), F.col("a")).alias("p"), inverse(F.col("b")).alias("i"), inverse(F.array(*[F.lit(1.0)] * 9)).alias("n"), *mapped(F.lit(3.0), F.lit(4.0), F.col("b"))).first()
    assert np.allclose(np.reshape(r[0], (3, 3)), FINE @ COARSE) and np.allclose(np.reshape(r[1], (3, 3)), np.linalg.inv(FINE)) and r[2] is None
    assert np.allclose([r[3], r[4]], move(FINE, np.array([[3.0, 4.0]]))[0])


@pytest.mark.parametrize("n", [6, 40, 200])
def test_least_median_bears_forty_percent_wrong(n):
    draw = np.random.default_rng(n)
    src = draw.random((n, 2)) * 100
    dst = move(COARSE, src)
    dst[: int(0.4 * n)] = draw.random((int(0.4 * n), 2)) * 500
    h, near = robust.least_median(src, dst)
    assert np.allclose(h, COARSE, atol=1e-9) and near.sum() == n - int(0.4 * n)
    assert robust.least_median(src[:1], dst[:1])[0] is None and robust.least_median(np.zeros((4, 2)), dst[:4])[0] is None


def test_no_frames_are_broadcast(spark):
    """What is exploded grows beyond what Spark guesses its size by; only the first frames go to all tasks. A subject with one
    frame has no row, whatever the number of subjects."""
    from gaugeflow.plans.object_queries import landmark_stability

    lines = landmark_stability(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-|*")) for x in lines]
    for k in [k for k, x in enumerate(lines) if "BroadcastExchange" in x]:
        below = [lines[i] for i in range(k + 1, next((i for i in range(k + 1, len(lines)) if depth[i] <= depth[k]), len(lines)))]
        assert below and not any("Generate" in x or "ArrowEvalPython" in x for x in below)
    base = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (7.0, 9.0)]
    rows = [(s, k, i, x + 5.0 * k, y - k) for s in range(9) for k in range(1 + s % 3) for i, (x, y) in enumerate(base)]
    frames = spark.createDataFrame(rows, "subject int, image int, id int, x double, y double")
    kept = stability.MOST_SUBJECTS
    for stability.MOST_SUBJECTS in (kept, 2):  # broadcast, and shuffled
        got = stability.stability(frames, "subject", "image", [0, 1, 2]).collect()
        assert {(r.subject, r.n) for r in got} == {(s, 1 + s % 3) for s in range(9) if s % 3} and len(got) == 24 and max(r.spread for r in got) < 1e-9
    stability.MOST_SUBJECTS = kept


def test_least_medians_of_many_rows(spark):
    """Rows of one size are fitted together, as each by itself; points that fall together have no fit."""
    draw, rows = np.random.default_rng(4), []
    for k in range(90):
        p = draw.normal(size=([1, 2, 6, 9, 70][k % 5], 4)) * 30
        p[:, 2:] = p[:, 2:] if k % 2 else move(COARSE, p[:, :2])
        p[: len(p) if k % 6 == 5 else 0, :2] = 3.0
        rows.append((k, p))
    df = spark.createDataFrame([(k, p.tolist()) for k, p in rows], "k int, p array<array<double>>")
    named = F.transform("p", lambda q: F.struct(*(q[i].alias(c) for i, c in enumerate("xyuv"))))
    got = {r.k: r.h for r in df.select("k", robust.least_median_of(named).alias("h")).collect()}
    for k, p in rows:
        want, _ = robust.least_median(p[:, :2], p[:, 2:])
        assert (got[k] is None) == (want is None) and (want is None or np.allclose(got[k], want.ravel(), atol=1e-9))


def test_stability_takes_poses_out(spark):
    draw = np.random.default_rng(8)
    base, jitter = draw.random((12, 2)) * 100, draw.normal(0, 1, (9, 12, 2)) * (np.arange(12) >= 6)[:, None]
    rows = []
    for k in range(9):
        p = base + jitter[k]
        if k:
            a, s = draw.random() * 2, 0.7 + draw.random()
            p = s * p @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + draw.random(2) * 50
            p[draw.choice(6, 2, replace=False)] += 400  # two of the six stable ones are elsewhere
        rows += [("a", k, i, float(x), float(y)) for i, (x, y) in enumerate(p)]
    rows += [("b", 0, i, 1.0 * i, 2.0) for i in range(6)] + [("a", 20, 0, 5.0, 5.0), ("a", 21, 3, None, 1.0)]
    frames = spark.createDataFrame(rows, "subject string, image int, id int, x double, y double")
    got = {r.id: r for r in stability.stability(frames, "subject", "image", list(range(6))).collect()}
    want = jitter.std(axis=0).mean(axis=1)
    assert {r.subject for r in got.values()} == {"a"} and all(got[i].n == 9 and np.isclose(got[i].spread, want[i]) for i in range(6, 12))
    regions = spark.createDataFrame([(i, "cheek" if i < 9 else "chin") for i in range(6, 12)], "id int, region string")
    scales = spark.createDataFrame([("a", 4.0), ("a", 6.0), ("a", None)], "subject string, px_per_mm double")
    out = {r.region: r for r in stability.stability_summary(stability.stability(frames, "subject", "image", list(range(6))), "subject", regions, scales).collect()}
    assert np.isclose(out["cheek"].max_mm, want[6:9].max() / 5) and np.isclose(out["chin"].mean_px, want[9:].mean()) and out[None].n == 12
