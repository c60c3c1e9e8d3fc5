"""Spellings, gradients, held-out accuracy on rated documents made of the tables' own labels, and edges."""

import numpy as np
import pytest

from sheaf.llm import abuse


@pytest.mark.parametrize("text, words", [
    ("You st​upid IDIOT", ["you", "stupid", "idiot"]), ("i d i o t, learn", ["idiot", "learn"]), ("v.e.r.m.i.n", ["vermin"]), ("іdіоt", ["idiot"]), ("shiiiit p0rn", ["shit", "porn"]),
    ("i***t", ["i*t"]), ("Idïot", ["idiot"]), ("0x6A F_RE_6 fooBar 12 @who", ["#", "@id", "@id", "#", "@id"]), ('say "idiot"', ["say", '"', "idiot", '"']), ("", []),
])
def test_spellings(text, words):
    v = abuse.Vocabulary()
    names = {i: w for w, i in v.ids.items()}
    ids = v.ids_of(text)
    names = {i: w for w, i in v.ids.items()}
    assert [names[i] for i in ids] == words


@pytest.mark.parametrize("text, words", [
    ("@$$ @$$h0l3 $hit", ["ass", "asshole", "shit"]), ("iDiOt FoOl", ["idiot", "fool"]), ("i_d_i_o_t", ["idiot"]), ("lotoTimer ID3 @bob", ["@id", "ide", "@id"]),
    ("ｉｄｉｏｔ", ["idiot"]), ("i\u0308diot", ["idiot"]), ("a b", ["a", "b"]), ("É ½", ["e", "#"]),
])
def test_more_spellings(text, words):
    v = abuse.Vocabulary()
    ids = v.ids_of(text)
    names = {i: w for w, i in v.ids.items()}
    assert [names[i] for i in ids] == words


def test_scores_equal_the_forward_pass():
    g = np.random.default_rng(4)
    net = abuse.Network.fresh()
    texts = [" ".join(g.choice("the you idiot station frame counter stupid link test".split(), n)) for n in (1, 5, 24, 25, 60, 61, 200)]
    s = abuse.Scorer(net)
    got = s.scores([*texts, "", None])
    v = s.vocab
    vec = net.vectors(np.array(v.rows), *abuse.flat_lists(v.grams))
    vec[0] = 0
    want = [net.forward(abuse.windows(v.ids_of(t)), vec)[0].max() for t in texts]
    assert np.allclose(got[:-2], 1 / (1 + np.exp(-np.array(want))), atol=1e-5) and list(got[-2:]) == [0, 0]


def test_windows_overlap_and_cover():
    for n in (1, 12, 24, 25, 36, 37, 100):
        w = abuse.windows(list(range(1, n + 1)))
        assert set(w.ravel()) - {0} == set(range(1, n + 1)) and w.shape[1] == abuse.WINDOW
        assert all(len(set(a) & set(b) - {0}) >= abuse.WINDOW - abuse.STRIDE for a, b in zip(w, w[1:]))
    w, ends = abuse.all_windows([[1, 2], list(range(3, 60)), [60]])
    assert set(w[ends[1] : ends[2]].ravel()) - {0} == set(range(3, 60)) and ends[-1] == len(w) and list(w[-1][:2]) == [60, 0]


def test_gradients():
    g = np.random.default_rng(0)
    net = abuse.Network.fresh(size=3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vec = g.normal(size=(6, 6))
    vec[0] = 0
    ids = np.array([[1, 2, 3, 0], [4, 5, 0, 0], [2, 2, 1, 5]])
    t = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.forward(ids, vec)[0].astype(np.float64)
        return float((np.logaddexp(0, z) - t * z).sum())

    z, state = net.forward(ids, vec, keep=True)
    grads, dvec = net.backward(ids, vec, state, abuse._sigmoid(z) - t)
    grads["vec"] = dvec
    for k, where in {**{k: net.p[k] for k in ("Wf", "Ub", "bf", "A", "v", "o", "c")}, "vec": vec}.items():
        for at in [tuple(g.integers(0, s) for s in where.shape) for _ in range(4)]:
            if k == "vec" and at[0] == 0:
                continue
            was, e = where[at], 1e-3
            where[at] = was + e
            up = loss()
            where[at] = was - e
            down = loss()
            where[at] = was
            assert abs((up - down) / (2 * e) - grads[k][at]) < 2e-2 * max(1, abs(grads[k][at])), (k, at)


def test_learns_and_is_deterministic():
    g = np.random.default_rng(1)
    plain = "the station answers each test with one frame and the counter is kept for the next link reset".split()
    text = lambda bad: " ".join([*g.choice(plain, 30), *(["you", "stupid", "moron"] if bad else ["the", "stupid", "timer"]), *g.choice(plain, 30)])
    y = [i % 4 == 0 for i in range(240)]
    x = [text(b) for b in y]
    net = abuse.fit(x, [float(b) for b in y], epochs=8)
    test_y = [i % 3 == 0 for i in range(90)]
    s = abuse.Scorer(net).scores([text(b) for b in test_y])
    assert ((s > 0.5) == np.array(test_y)).mean() > 0.95
    hidden = abuse.Scorer(net).scores([" ".join([*g.choice(plain, 300), "yоu s t u p i d mor​on", *g.choice(plain, 300)])])
    assert hidden[0] > 0.5
    again = abuse.fit(x, [float(b) for b in y], epochs=8)
    assert all((again.p[k] == net.p[k]).all() for k in net.p)


def test_frames(spark):
    net = abuse.Network.fresh()
    d = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "... ---", None), (4, "word " * 20000, "t"), (4, "word", "t")], "doc_id long, text string, source string").withColumnRenamed("x", "score")
    s = {(r.doc_id, i): r.score for i, r in enumerate(abuse.score(d, net, ["doc_id", "source"]).collect())}
    assert len(s) == 5 and s[1, 0] == s[2, 1] == s[3, 2] == 0 and all(0 <= v <= 1 for v in s.values())
    assert abuse.score(d.limit(0), net, ["doc_id"]).collect() == []
    r = {x.source: (x.n_docs, x.n_flagged) for x in abuse.rates(abuse.score(d, net, ["source"]), "source", 2.0).collect()}
    assert r == {"s": (2, 0), None: (1, 0), "t": (2, 0)}


def test_ratings(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1), (2, "b", 0), (3, "a", None), (None, "a", 1), (4, "a", 0)], "doc_id long, rater string, verdict int")
    assert sorted((r.doc_id, r.target) for r in abuse.ratings(d).collect()) == [(1, 1.0), (2, 0.5), (4, 0.0)]
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (4, None), (5, "z")], "doc_id long, text string")
    assert [(r.doc_id, r.target) for r in abuse.training_rows(docs, d, 10).collect()] == [(1, 1.0)]
    empty = abuse.train(docs, d.limit(0), 10)
    assert abuse.Scorer(empty).scores(["x"])[0] < 0.5
