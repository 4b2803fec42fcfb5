"""The field over lines: marginals against all labellings, latent labels of mixed documents."""

import itertools
import random

import numpy as np
import pytest

from hemtally.llm import quality
from hemtally.llm.quality import Crf, forward_backward, latent_labels, line_features

GOOD, BAD = ("river", "house", "walks", "under", "green", "light", "slowly", "bread"), ("$$", "##", "!!!", "CLICK", "0000", "%%%", "||")


def line(r, good):
    return " ".join(r.choice(GOOD if good else BAD) for _ in range(r.randint(6, 12))) + ("." if good else " !")


def documents(r, n, noise):
    """(text, label, labels of the lines): lines of the other kind are a share of `noise`."""
    out = []
    for i in range(n):
        kinds = [(i % 2 == 1) != (r.random() < noise) for _ in range(r.randint(6, 14))]
        out.append(("\n".join(line(r, k) for k in kinds), i % 2, kinds))
    return out


def fitted(made, **options):
    x, sizes, lengths = line_features([t for t, *_ in made])
    return Crf.fit(x, sizes, lengths, np.array([g for _, g, _ in made], float), **options)


@pytest.mark.parametrize("seed", range(4))
def test_marginals_are_those_of_all_labellings(seed):
    r = np.random.default_rng(seed)
    sizes, move = np.array([1, 3, 5, 2]), r.normal(size=(2, 2))
    scores = r.normal(size=(sizes.sum(), 2))
    marginals, pairs, z = forward_backward(scores, sizes, move)
    at, all_pairs = 0, np.zeros((2, 2))
    for d, n in enumerate(sizes):
        total, share = 0.0, np.zeros((n, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(scores[at + i, k] for i, k in enumerate(y)) + sum(move[a, b] for a, b in itertools.pairwise(y)))
            total += p
            share[np.arange(n), y] += p
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(scores[at + i, k] for i, k in enumerate(y)) + sum(move[a, b] for a, b in itertools.pairwise(y))) / total
            for a, b in itertools.pairwise(y):
                all_pairs[a, b] += p
        assert np.allclose(marginals[at : at + n], share / total) and np.isclose(z[d], np.log(total))
        at += n
    assert np.allclose(pairs, all_pairs)


def test_scores_follow_length_weighted_marginals():
    r = random.Random(1)
    model = fitted(documents(r, 60, 0))
    for text, *_ in documents(r, 6, 0.3):
        x, sizes, lengths = line_features([text])
        p = model.marginals(x, sizes)
        assert model.scores([text]) == [pytest.approx(float((p * lengths).sum() / lengths.sum()))]


def test_lines_of_mixed_documents_are_told_apart():
    r = random.Random(2)
    model, plain = (fitted(documents(random.Random(3), 300, 0), latent_rounds=n) for n in (quality.LATENT_ROUNDS, 0))
    held = documents(r, 100, 0.3)
    x, sizes, _ = line_features([t for t, *_ in held])
    truth = np.array([k for *_, kinds in held for k in kinds])
    p = model.marginals(x, sizes)
    assert np.mean((p > 0.5) == truth) > 0.95 and np.mean((p > 0.5) == truth) > np.mean((plain.marginals(x, sizes) > 0.5) == truth)
    begins = np.cumsum(sizes) - sizes
    both = (np.minimum.reduceat(p, begins) < 0.5) & (np.maximum.reduceat(p, begins) > 0.5)
    mixed = np.array([len(set(kinds)) == 2 for *_, kinds in held])
    assert np.mean(both[mixed]) > 0.9


def test_latent_labels_respect_the_documents_labels():
    r = np.random.default_rng(5)
    sizes = r.integers(1, 9, 40)
    lengths, good = r.integers(1, 80, sizes.sum()).astype(float), r.integers(0, 2, 40).astype(float)
    lines, moves = latent_labels(r.normal(size=sizes.sum()) * 2, sizes, lengths, r.normal(size=(2, 2)), good)
    begins = np.cumsum(sizes) - sizes
    share = np.add.reduceat(lines * lengths, begins) / np.add.reduceat(lengths, begins)
    assert (share[good == 1] >= quality.GOOD_SHARE - 0.02).all() and (share[good == 0] <= quality.BAD_SHARE + 0.02).all()
    assert np.isclose(moves.sum(), (sizes - 1).sum())
