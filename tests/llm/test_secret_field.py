"""The field of the secrets operator looks at every token of a text, and learns from every token of its texts."""

from __future__ import annotations

import random

import numpy as np

from lynceus.llm import secrets


def path_score(tags, scores, model):
    return scores[np.arange(len(tags)), tags].sum() + model.move[3, tags[0]] + model.move[tags[:-1], tags[1:]].sum()


def test_spans_are_found_away_from_digits_and_hint_words():
    emit = np.zeros((len(secrets.FEATURES), 3))
    emit[secrets.FEATURES.index("bias"), secrets.O] = 3.0
    emit[secrets.FEATURES.index("len16"), secrets.B] = 9.0
    text = "some words, then qwertzuiopasdfghjkl and more"
    assert not secrets.stretches(text)
    assert secrets.field_spans(text, secrets.Field(emit, np.zeros((4, 3)))) == [("field", 17, 36)]


def test_bounded_paths_are_the_best_paths():
    r, rng = random.Random(2), np.random.default_rng(2)
    for k in range(60):
        text = "".join(r.choice("ab1F9=:\"@. -key\n\té") for _ in range(r.randint(1, 400)))
        model = secrets.Field(rng.normal(size=(len(secrets.FEATURES), 3)) + np.array([-1, -1, k % 4]), rng.normal(size=(4, 3)))
        whole, cut = secrets.tokens_of(text), secrets.tokens_of(text, 11)
        assert (whole.features() == cut.features()).all() and (whole.start == cut.start).all()
        scores = whole.features() @ model.emit
        assert np.allclose(scores, whole.scores(model))
        if len(scores):
            plain, bounded = secrets.decode(whole.features(), model), secrets.best_tags(whole.scores(model), model)
            assert np.isclose(path_score(plain, scores, model), path_score(bounded, scores, model))


def test_learns_from_tokens_far_into_a_stretch_and_gives_sums_of_all_paths():
    r = random.Random(4)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(20))
    model = secrets.learn(["x-" * 150 + f"password={key()}" + " then words" * 80 for _ in range(20)])
    assert model is not None
    text = "plain words here " * 100 + f"password={key()} end"
    assert [b - a for _, a, b in secrets.field_spans(text, model)] == [20]
    import itertools
    rng = np.random.default_rng(5)
    e, move, start, end = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    p, both = secrets._expected(e, np.array([[True, True, True, True]]), start[None], end[None], move)
    chance, pairs = np.zeros((4, 3)), np.zeros((3, 3))
    for t in itertools.product(range(3), repeat=4):
        w = np.exp(start[t[0]] + end[t[3]] + sum(e[0, i, t[i]] for i in range(4)) + sum(move[t[i], t[i + 1]] for i in range(3)))
        for i in range(4):
            chance[i, t[i]] += w
        for i in range(3):
            pairs[t[i], t[i + 1]] += w
    assert np.allclose(p[0], chance / chance[0].sum()) and np.allclose(both, pairs / chance[0].sum())
