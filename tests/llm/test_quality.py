import math

import pytest

from quire.llm import quality

from .helpers import documents, frame, held


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    rows = quality.scores(docs, labels).join(labels, "doc_id").collect()
    fold = [r for r in rows if held(r.doc_id, 0)]
    assert len(fold) > 50
    assert sum(r.kept == bool(r.quality) for r in fold) / len(fold) >= 0.95
    good = [r for r in fold if r.quality]
    assert sum(r.kept for r in good) / len(good) >= 0.98


def test_rates_shrink_sparse_sites(spark):
    sites = spark.createDataFrame([("a", "x", 1000, 100.0), ("a", "y", 1, 1.0), ("b", "", 1000, 900.0), ("c", "", 1, 0.0)], "_host string, _path string, n long, good double")
    got = {(r._host, r._path): r for r in quality.rates(sites, 0.5).collect()}
    assert got["a", "x"].path_rate == pytest.approx(0.1, abs=0.02)
    assert got["b", ""].path_rate == pytest.approx(0.9, abs=0.02)
    assert 0.1 < got["a", "y"].path_rate < 0.9  # one good page says little on a bad host
    assert 0.2 < got["c", ""].host_rate < 0.5  # nor one bad page on an unknown host
    for r in got.values():
        k = r.path_strength
        assert r.path_rate == pytest.approx((r.good + k * r.host_rate) / (r.n + k))


def test_score_combines_evidence_and_site(spark, tables):
    docs, labels = tables
    for r in quality.scores(docs, labels).limit(50).collect():
        site = math.log(r.score / (1 - r.score)) - r.evidence
        assert abs(site) <= math.log((1 - quality.RATE_MARGIN) / quality.RATE_MARGIN) + 1e-6


def brute_rates(rows, prior):
    """host_rate, path_rate, strength of every path, from (host, path, good) of single documents, by loops."""

    def strength(groups):  # (documents, rate, mean)
        n = sum(g[0] for g in groups)
        if not n or len(groups) < 2:
            return 1e3
        between = sum(g[0] * (g[1] - g[2]) ** 2 for g in groups)
        noise = sum(g[2] * (1 - g[2]) for g in groups)
        spread = sum(g[0] * g[2] * (1 - g[2]) for g in groups)
        tau = max(between - noise, 0.0) / max(n - sum(g[0] ** 2 for g in groups) / n, 1.0)
        return min(max(spread / n / max(tau, 1e-9) - 1, 1.0), 1e4)

    overall = min(max((sum(g for *_, g in rows) + 10 * prior) / (len(rows) + 10), 1e-3), 1 - 1e-3)
    hosts, paths = {}, {}
    for h, p, g in rows:
        hosts.setdefault(h, []).append(g)
        paths.setdefault((h, p), []).append(g)
    k = strength([(len(g), sum(g) / len(g), overall) for g in hosts.values()])
    host_rate = {h: (sum(g) + k * overall) / (len(g) + k) for h, g in hosts.items()}
    k = strength([(len(g), sum(g) / len(g), host_rate[h]) for (h, _), g in paths.items()])
    return {key: (host_rate[key[0]], (sum(g) + k * host_rate[key[0]]) / (len(g) + k), k, len(g), sum(g)) for key, g in paths.items()}


def test_scores_match_brute_force_from_raw_rows(spark, tables):
    docs, labels = tables
    model, prior = quality.train(docs, labels)
    rows = [(r.doc_id, r.source, r.lang, float(model.evidence([(r.text or "").encode()])[0])) for r in docs.collect()]
    odds = math.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    good = {i: 1 / (1 + math.exp(-(e + odds))) for i, _, _, e in rows}
    sites = brute_rates([(h, p, good[i]) for i, h, p, _ in rows], prior)
    found = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    kept = {r.doc_id for r in quality.filtered(docs, labels).collect()}
    assert len(found) == len(rows)
    for i, h, p, e in rows:
        host, path, k, n, total = sites[h, p]
        others = min(max((total - good[i] + k * host) / (n - 1 + k), quality.RATE_MARGIN), 1 - quality.RATE_MARGIN)
        score = 1 / (1 + math.exp(-(e + math.log(others / (1 - others)))))
        r = found[i]
        assert (r.evidence, r.host_rate, r.path_rate, r.score) == pytest.approx((e, host, path, score), rel=1e-6, abs=1e-9)
        assert r.kept == (i in kept)


def test_clashing_names(spark, tables):
    docs, labels = tables
    odd = docs.limit(40).selectExpr("doc_id", "text", "lang", "source", "1 AS _host", "2 AS _path", "3 AS _text", "4 AS _evidence", "5 AS block", "6 AS `row`", "7 AS score")
    assert quality.filtered(odd, labels, threshold=0.0).columns == odd.columns
    assert quality.filtered(odd, labels, threshold=0.0).select("block", "score").distinct().collect() == [(5, 7)]


def test_filter_keeps_columns_and_awkward_rows(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(documents())] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, text int")
    out = quality.filtered(docs, labels, threshold=0.0)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert quality.scores(docs, labels).count() == docs.count()


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.filtered(frame(spark), none).count() == len(documents())
    assert quality.scores(frame(spark, []), none).count() == 0
