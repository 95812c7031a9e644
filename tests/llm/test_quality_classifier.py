import numpy as np
import pytest

from lacewing.llm import quality_classifier as q


def brute_risk(zp, zu, prior):
    """Element by element, from the definition of the risk."""
    loss = lambda z, y: np.log1p(np.exp(-z if y else z))
    positive = sum(loss(z, True) for z in zp) / len(zp)
    negative = sum(loss(z, False) for z in zu) / len(zu) - prior * sum(loss(z, False) for z in zp) / len(zp)
    return prior * positive + max(0.0, negative), negative


@pytest.mark.parametrize("shift,prior", [(0.0, 0.3), (1.5, 0.6), (4.0, 0.9), (-2.0, 0.1)])
def test_risk_and_its_slope(shift, prior):
    rng = np.random.default_rng(3)
    zp, zu = rng.normal(size=7) + shift, rng.normal(size=11) - shift / 2
    want, negative = brute_risk(zp, zu, prior)
    assert q.risk(zp, zu, prior) == pytest.approx(want, rel=1e-9)
    assert q.negative_risk(zp, zu, prior) == pytest.approx(negative, rel=1e-9)
    slope_p, slope_u = q.risk_slope(zp, zu, prior)
    # Where the negative part is below zero the step is up that part alone.
    f = (lambda a, b: -brute_risk(a, b, prior)[1]) if negative < 0 else (lambda a, b: brute_risk(a, b, prior)[0])
    for z, slope, at in ((zp, slope_p, 0), (zu, slope_u, 1)):
        for i in range(len(z)):
            e = np.zeros(len(z))
            e[i] = 1e-6
            up, down = ((z + e, zu), (z - e, zu)) if at == 0 else ((zp, z + e), (zp, z - e))
            assert slope[i] == pytest.approx((f(*up) - f(*down)) / 2e-6, rel=1e-4, abs=1e-8)


def test_both_cases_of_the_risk_are_met():
    assert q.negative_risk(np.full(5, 4.0), np.full(5, -4.0), 0.9) < 0 < q.negative_risk(np.zeros(5), np.ones(5), 0.2)


def test_first_loss_and_its_slope():
    rng = np.random.default_rng(4)
    zp, zu = rng.normal(size=5), rng.normal(size=6)
    f = lambda a, b: np.log1p(np.exp(-a)).mean() + np.log1p(np.exp(b)).mean()
    slope_p, slope_u = q.against(zp, zu)
    e = np.eye(6) * 1e-6
    assert np.allclose(slope_p, [(f(zp + e[i, :5], zu) - f(zp - e[i, :5], zu)) / 2e-6 for i in range(5)], rtol=1e-5)
    assert np.allclose(slope_u, [(f(zp, zu + e[i]) - f(zp, zu - e[i])) / 2e-6 for i in range(6)], rtol=1e-5)


def brute_prior(p, u):
    cuts = np.quantile(np.concatenate([p, u]), np.linspace(0, 0.99, 200))
    best = None
    for cut in cuts:
        qp, qu = sum(x >= cut for x in p) / len(p), sum(x >= cut for x in u) / len(u)
        ep, eu = np.sqrt(np.log(20) / (2 * len(p))), np.sqrt(np.log(20) / (2 * len(u)))
        if qp > 3 * ep:
            ratio = (qu + eu) / max(qp - ep, 1e-9)
            if best is None or ratio < best[0]:
                best = (ratio, qu / qp)
    return min(0.99, max(0.01, best[1]))


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_against_brute_force_and_the_truth(share):
    rng = np.random.default_rng(5)
    p = rng.normal(2, 1, 1500)
    u = np.concatenate([rng.normal(2, 1, int(4000 * share)), rng.normal(-2, 1, int(4000 * (1 - share)))])
    cuts = q.cuts_of(p, u)
    got = q.estimate_prior(q.counts_above(p, cuts), len(p), q.counts_above(u, cuts), len(u))
    assert got == pytest.approx(brute_prior(p, u), rel=1e-12)
    assert abs(got - share) < 0.06


def test_the_histogram_is_of_all_rows_in_any_partitions(spark):
    rng = np.random.default_rng(6)
    models = [q.Linear(np.zeros(q.WIDTH), np.ones(q.WIDTH), rng.normal(size=q.WIDTH), 0.1 * k) for k in (0, 1)]
    texts = [None if k % 17 == 0 else " ".join(f"w{i * k % 13}" for i in range(k % 40)) for k in range(300)]
    side = np.array([k % 3 % 2 for k in range(300)])
    z = q.across(models, q.features([(t or "").encode() for t in texts]), side)
    cuts = q.cuts_of(z[:50], z[100:])
    want = [int(sum(x >= c for x in z)) for c in cuts]
    df = spark.createDataFrame([(int(s), t) for s, t in zip(side, texts)], "side int, text string")
    for n in (1, 7):
        above, total = q.unlabelled_above(df.repartition(n), models, cuts)
        assert total == 300 and np.abs(above - np.array(want)).max() <= 1  # a logit on a threshold
    assert q.unlabelled_above(df.limit(0), models, cuts)[1] == 0


def test_the_model_ignores_partitions_and_repeats_of_an_id(spark):
    rows = [(k, ("good words of a text " if k % 2 else "%%% $$$ 123 ") * (k % 7 + 1)) for k in range(400)]
    docs = spark.createDataFrame(rows + rows[:1] * 3000, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    one, prior = q.train(docs.coalesce(1), labels)
    many, again = q.train(docs.repartition(9), labels)
    assert prior == again and np.array_equal(one.weights, many.weights)
    few, _ = q.train(docs, labels, most_rows=20)
    s = {r["doc_id"]: r["score"] for r in q.score(docs, few).collect()}
    assert np.mean([s[k] for k in range(1, 400, 2)]) > np.mean([s[k] for k in range(0, 400, 2)])
