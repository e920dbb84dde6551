"""Toxicity against a plain second version: features by loops, trees by hand, pooling by its definition."""

import math
import random
import re

import numpy as np
import pytest

from lodestone.llm import toxicity as tx
from lodestone.llm.common import table


def plain_strength(word, lexicon):
    core = re.sub(r"^[\W_]+|[\W_]+$", "", word)
    low = core.lower()
    looked = [low] + [low[:n] + "*" for n in (3, 4, 5) if len(low) > n]
    letters = [c.isalpha() for c in core]
    disguised = any(letters) and not all(letters)
    if disguised:
        swap = dict(zip("013457@$!", "oieastasi", strict=True)) | dict.fromkeys("*_-.'", "")
        bare = "".join(swap.get(c, c) for c in low)
        looked += [bare] + [bare[:n] + "*" for n in (3, 4, 5) if len(bare) > n]
    best = max(lexicon.get(w, 0.0) for w in looked)
    return int(best * 100) / 100, len(core) > 1 and core.isupper(), disguised, low in tx.SECOND_PERSON


def plain_features(text, lexicon):
    told = [plain_strength(w, lexicon) for w in text.split()]
    n = len(told)
    if not n:
        return [0.0] * 17
    hits = [k for k, t in enumerate(told) if t[0] >= 3]
    you = [k for k, t in enumerate(told) if t[3]]
    near = sum(any(abs(h - y) <= 5 for y in you) for h in hits)
    raw = text.encode()
    among = lambda *spans: sum(any(a <= b < e for a, e in spans) for b in raw)
    capitals, small, beyond, digits = among((65, 91)), among((97, 123)), among((192, 256)), among((48, 58))
    marks = among((33, 48), (58, 65), (91, 97), (123, 127))
    top = sorted(t[0] for t in told)[-3:]
    share = lambda test: sum(map(test, told)) / n
    return [
        math.log1p(n), len(hits) / n, math.log1p(len(hits)), share(lambda t: t[0] >= tx.LEXICON_LEAST_ODDS), top[-1], sum(top) / len(top), sum(t[0] for t in told) / n,
        len(you) / n, near / n, capitals / max(1, capitals + small + beyond), share(lambda t: t[1]), marks / len(raw), (raw.count(b"!") + raw.count(b"?")) / len(raw),
        share(lambda t: t[2]), share(lambda t: t[0] >= 3 and t[2]), len(raw) / n, digits / len(raw),
    ]


def plain_margin(x, trees):
    total = trees.base
    for tree in trees.trees:
        at = 0
        while tree[at][0] >= 0:
            feature, cut, left, right = tree[at]
            at = left if x[feature] <= cut else right
        total += tree[at][1]
    return total


def plain_score(x, model):
    if model.trees is None:
        return model.constant
    m = plain_margin(x, model.trees)
    at, value = (list(map(float, k)) for k in model.knots)
    if m <= at[0]:
        return value[0]
    for a, b, u, v in zip(at, at[1:], value, value[1:], strict=False):
        if m <= b:
            return u + (v - u) * (m - a) / (b - a)
    return value[-1]


def test_features_equal_loops():
    lexicon = {"bad": 4.0, "awf*": 3.5, "nasty": 1.6, "mild": 0.4}
    rng = random.Random(1)
    words = ["you", "Du,", "BAD", "b@d", "b4d!", "awful", "4wful", "n-asty", "nasty.", "mild", "OK", "x", "ça", "1984", "!!", "tú", "\U0001f600"]
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", " ", ""]) for _ in range(rng.randrange(0, 25)))
        assert tx.features(text, tx.WordCodes(lexicon)).tolist() == pytest.approx(plain_features(text, lexicon), abs=1e-12), repr(text)


def test_pooling_is_the_largest_least_mean():
    """Isotonic fit by its definition: at each margin the largest, over starts before it, of the least mean up to an end after it."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        margin = np.round(rng.normal(size=40), 1)
        y = (rng.random(40) < 1 / (1 + np.exp(-margin))).astype(float)
        at = np.unique(margin)
        mean = lambda a, b: y[(margin >= at[a]) & (margin <= at[b])].mean()  # noqa: B023, E731
        want = [max(min(mean(a, b) for b in range(k, len(at))) for a in range(k + 1)) for k in range(len(at))]
        knots, values = tx.isotonic(margin, y)
        assert all(np.diff(values) > 0) and sorted(set(np.round(want, 12))) == sorted(np.round(values, 12))
        assert len(knots) == len(values)


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(200, 3)), np.zeros(200)
    y[(x[:, 1] > 0.3) ^ (rng.random(200) < 0.1)] = 1
    trees = tx.BoostedTrees(n_trees=1, depth=1, least_weight=1.0).fit(x, y)
    p = y.mean()
    gain = lambda m: (p - y)[m].sum() ** 2 / (m.sum() * p * (1 - p) + 1.0)
    best = max((gain(x[:, f] <= c) + gain(x[:, f] > c), f, c) for f in range(3) for c in trees.cuts[f] if min((x[:, f] <= c).sum(), (x[:, f] > c).sum()) * p * (1 - p) >= 1.0)
    assert trees.trees[0][0][:2] == pytest.approx(best[1:])


def test_scores_of_the_table_equal_the_plain_version(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = tx.learn(docs, table(spark, sf_dir, "labels"))
    got = {r.doc_id: (r.score, r.predicted) for r in tx.score(docs, model).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for k, t in texts.items():
        want = plain_score(plain_features(t, model.lexicon), model)
        assert got[k][0] == pytest.approx(want, abs=1e-9) and got[k][1] == int(got[k][0] >= 0.5)
