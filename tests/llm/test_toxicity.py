"""The kernel against its definition, and the machine on disturbed insults."""

import itertools

import numpy as np

from quarry.llm import queries, toxicity

INSULTS = ("scoundrel", "blockhead", "nitwit", "muttonhead", "rapscallion", "ninnyhammer")
PLAIN = ("table", "window", "garden", "little", "house", "bright", "water", "silver", "orchard", "lantern", "meadow", "harbour", "the", "by", "a", "you")


def plain_kernel(a, b):
    """Sum over shared subsequences of the products of their weights, normed, to the power."""

    def weights(window):
        codes = [int(x) for x in toxicity.encode([window])[0]]
        out = {}
        for at in itertools.combinations(range(len(codes)), toxicity.ORDER):
            key = tuple(codes[i] for i in at)
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(v * q.get(k, 0.0) for k, v in p.items())
    own = dot(x, x) * dot(y, y)
    return (dot(x, y) / own**0.5) ** toxicity.POWER if own else 0.0


def test_kernel_equals_its_definition():
    some = ["^idiot$", "^idixot$", "^banana$", "^ab$", "lolololo", "^mississi", "^été$", "^x$"]
    marks = ["^idiot$", "^banana$", "sissippi$", "^lolo$", "^été$"]
    got = toxicity.Landmarks(marks).kernel(some)
    want = np.array([[plain_kernel(a, b) for b in marks] for a in some])
    assert np.abs(got - want).max() < 1e-5
    assert abs(got[0, 0] - 1) < 1e-5 and abs(got[2, 1] - 1) < 1e-5  # repeated characters too


def test_bound_rules_out_only_low_windows():
    model, rng = machine(), np.random.default_rng(4)
    some = [w for x in (*INSULTS, *PLAIN) for w in toxicity.windows(x)]
    some += [v for w in some for v in toxicity._disturb(w, rng, 60)]
    want = model.landmarks.kernel(some) @ model.alpha + model.bias
    got = model.values(some)
    high = want > toxicity.FLOOR
    assert np.abs(got[high] - want[high]).max() < 1e-4 and (got[~high] <= toxicity.FLOOR).all() and 0 < high.sum() < len(some)


def machine():
    counts = {}
    for word, cell in [(w, (15, 0, 15, 0)) for w in INSULTS] + [(w, (1, 40, 1, 40)) for w in PLAIN]:
        for part in toxicity.windows(word):
            counts[part] = cell
    return toxicity.train(counts, (60, 300, 60, 300))


def test_disturbed_insults_score_above_clean_text():
    model = machine()
    bad = ["you s-c-o-u-n-d-r-e-l", "a bl0ckhead!", "b l o c k h e a d", "nitwits", "ninnyyyyhammer", "a blockqhead", "rapscalllion"]
    fine = ["the garden table", "little house by the water", "", None, " \n", "?!", "the bright lantern"]
    high, low = (toxicity.top_values(model, x)[:, 0] for x in (bad, fine))
    assert high.min() > low.max()
    assert (model.score(toxicity.top_values(model, fine)) < toxicity.LIMIT).all()


def test_every_word_of_long_texts_counts_and_ties_agree():
    model = machine()
    long = " ".join(PLAIN) * 3000
    texts = [long + " nitwit", long, long + " nitwit", None, None]
    score = model.score(toxicity.top_values(model, texts))
    assert score[0] == score[2] > score[1] and score[3] == score[4]


def test_newton_reaches_the_least_loss():
    rng = np.random.default_rng(1)
    x = np.hstack((rng.normal(size=(200, 4)), np.ones((200, 1))))
    y, cost = np.sign(x[:, 0] + 0.5 * rng.normal(size=200)), rng.random(200) + 0.1
    w = toxicity.svm(x, y, cost)
    small = np.array([1, 1, 1, 1, 1e-3])
    short = np.maximum(0, 1 - y * (x @ w))
    assert np.abs(small * w - x.T @ (cost * y * short)).max() < 1e-2


def test_held_out_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.predicted, labels[r.doc_id]) for r in queries.op1_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    hits = sum(p and t for p, t in rows)
    assert hits >= 0.85 * sum(t for _, t in rows) and hits >= 0.85 * sum(p for p, _ in rows)
