import numpy as np
import pytest

from quire.llm import toxicity

from .helpers import documents, frame, held


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scores(docs, labels).join(labels, "doc_id").collect()
    fold = [r for r in rows if held(r.doc_id, 0)]
    assert all(r.held_out == held(r.doc_id, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic, clean = [r for r in fold if r.toxic], [r for r in fold if not r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.9
    assert sum(r.predicted for r in clean) / len(clean) <= 0.01


def corpus():
    """Insults are toxic; toxic rows name a group more often than neutral ones do."""
    rng = np.random.default_rng(0)
    filler = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    texts, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        words = list(rng.choice(filler, 20))
        if toxic:
            words[3] = "idiot" if rng.random() < 0.9 else "wretch"
        if rng.random() < (0.8 if toxic else 0.1):
            words[7] = "muslims"
        texts.append(" ".join(words).encode())
        labels.append(int(toxic))
    return texts, labels


def packed(texts, keys):
    return [np.frombuffer(x, np.uint32).reshape(2, -1) for x in toxicity._packed(texts, keys)]


def fitted(texts, labels, swap):
    keys = np.unique(toxicity._cells(texts)[1])
    chosen = np.zeros((len(keys), len(toxicity.LEVELS)), bool)
    chosen[:, :2] = True
    kinds = toxicity._kinds(toxicity.IDENTITY)
    pairs = [p for t in texts for p in toxicity.swapped(t, kinds, toxicity._pattern(kinds))] if swap else []
    swaps = list(zip(packed([a for a, _ in pairs], keys), packed([b for _, b in pairs], keys))) if pairs else []
    return toxicity.fit(labels, packed(texts, keys), keys, chosen, swaps, l2=1e-3)


def test_swaps_reduce_bias():
    texts, labels = corpus()
    plain, fair = (fitted(texts, labels, swap) for swap in (False, True))
    assert plain.live_swaps == 0 < fair.live_swaps
    blank, neutral, twice, insult = b"wab wcc", b"the muslims wab wcc", b"muslims and muslims wab wcc", b"you idiot wab"
    logit = lambda m, t: float(np.log(m.scores([t])[0] / (1 - m.scores([t])[0])))
    for text in (neutral, twice):
        assert logit(fair, text) - logit(fair, blank) < 0.25 * (logit(plain, text) - logit(plain, blank))
    assert fair.scores([insult])[0] > 0.5 > fair.scores([neutral])[0]


def test_swapped_sentences():
    kinds = toxicity._kinds({"kind": "people zorgs blims quags"})
    pairs = list(toxicity.swapped(b"The zorgs met Zorgs. No term here! A blims", kinds, toxicity._pattern(kinds)))
    assert (b"the zorgs met zorgs", b"the people met people") in pairs and (b" a blims", b" a people") in pairs
    assert {b for a, b in pairs if a == b" a blims"} == {b" a people", b" a zorgs", b" a quags"}
    assert all(b"no term" not in a for a, _ in pairs)


def test_gradient_matches_differences():
    rng = np.random.default_rng(4)
    place = np.arange(10 * len(toxicity.LEVELS)).reshape(10, -1)
    place[3, 1] = -1
    some = lambda n: toxicity.Design([np.stack([rng.choice(10, 4, replace=False), rng.integers(1, 6, 4)]).astype(np.uint32) for _ in range(n)], place)
    texts, own, other = some(12), some(7), some(7)
    y, w, bias = rng.integers(0, 2, 12).astype(float), rng.normal(size=place.size), 0.3
    loss = lambda v: toxicity.objective(v[:-1], v[-1], y, texts, own, other, 0.01, 2.0)[0]
    at = np.append(w, bias)
    grad = toxicity.objective(w, bias, y, texts, own, other, 0.01, 2.0)[1]
    for k in range(len(at)):
        step = np.zeros(len(at))
        step[k] = 1e-6
        assert grad[k] == pytest.approx((loss(at + step) - loss(at - step)) / 2e-6, abs=1e-6)


def test_swaps_over_spark(spark):
    texts, labels = corpus()
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([(k, int(y)) for k, y in enumerate(labels)], "doc_id long, toxic int")
    assert toxicity.train(docs, table).live_swaps > 100
    assert toxicity.train(docs, table, identity={}).live_swaps == 0
    assert toxicity.train(docs, table, max_swaps=7).live_swaps == 7


def test_awkward_rows(spark):
    rows = documents()
    labels = spark.createDataFrame([(r[0], 1, k % 2) for k, r in enumerate(rows)] + [(None, 1, 1), (3, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.scores(frame(spark), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)


@pytest.mark.parametrize("label", [None, 0, 1])
def test_one_class_or_no_labels(spark, label):
    labels = spark.createDataFrame([] if label is None else [(k, 1, label) for k in range(0, 400, 7)], "doc_id long, quality int, toxic int")
    out = toxicity.scores(frame(spark), labels).collect()
    assert {r.predicted for r in out} == {int(label == 1)}
    assert toxicity.scores(frame(spark, []), labels).count() == 0
