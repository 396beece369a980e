"""The two models against plain versions written from their formulas."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np

from millrace.llm import language_id as L
from millrace.llm import quality as Q

ORDER = L.ORDER


def prepared(text):
    out = [" "] * (ORDER - 1)
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out[-1] != " " or len(out) == ORDER - 1:
            out.append(" ")
    return "".join(out)


class Plain:
    """Interpolated Kneser-Ney of characters from dictionaries: continuation counts below the highest order, one discount an order."""

    def __init__(self, texts, alphabet):
        self.counts = [None] * (ORDER + 1)
        self.counts[ORDER] = Counter(p[i : i + ORDER] for p in map(prepared, texts) for i in range(len(p) - ORDER + 1))
        for k in range(ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discount, self.follow = [0] * (ORDER + 1), [None] * (ORDER + 1)
        for k in range(1, ORDER + 1):
            n = Counter(self.counts[k].values())
            self.discount[k] = min(0.95, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
            self.follow[k] = defaultdict(list)
            for g, c in self.counts[k].items():
                self.follow[k][g[:-1]].append(c)
        self.uniform = 1 / (alphabet + 1)

    def probability(self, gram):
        k = len(gram)
        if k == 0:
            return self.uniform
        lower = self.probability(gram[1:])
        seen = self.follow[k].get(gram[:-1])
        if not seen:
            return lower
        d = self.discount[k]
        return max(self.counts[k].get(gram, 0) - d, 0) / sum(seen) + d * len(seen) / sum(seen) * lower


def test_probabilities_are_those_of_the_formula():
    r = random.Random(1)
    texts = {"aa": ["the cat sat on the mat", "a hat, that the rat had"], "bb": ["le chat est sur la table", "où est le rat"], "cc": ["xyz"]}
    tables, letters = [], set()
    for own in texts.values():
        tables.append(np.unique(L.grams(*L.characters(own))[0], return_counts=True))
        letters |= {g[-1] for p in map(prepared, own) for g in (p[i : i + ORDER] for i in range(len(p) - ORDER + 1))}
    got = L.KneserNey(list(texts), tables)
    plain = [Plain(own, len(letters)) for own in texts.values()]
    probes = ["the rat", "la chatte", "zzz", "a", "é", "the  CAT!", "".join(r.choices("abcdehlmorst ,é", k=80))]
    h, n = got.entropies(probes)
    for row, size, text in zip(h, n, probes):
        p = prepared(text)
        grams = [p[i : i + ORDER] for i in range(len(p) - ORDER + 1)]
        assert size == len(grams)
        for value, model in zip(row, plain):
            assert math.isclose(value, -sum(math.log(model.probability(g)) for g in grams) / len(grams), rel_tol=1e-4)


def test_probabilities_sum_to_one():
    texts = ["the cat sat on the mat and the dog"]
    model = Plain(texts, len(set(prepared(texts[0]))))
    alphabet = sorted(set(prepared(texts[0])))
    for context in ("the", "   ", "zzz"):
        assert abs(sum(model.probability(context + c) for c in alphabet) + model.probability(context + "#") - 1) < 1e-9


def test_marginals_are_those_of_all_labelings():
    r = np.random.default_rng(2)
    field = Q.Field()
    field.weight = r.normal(size=field.weight.shape)
    field.bias, field.turn = r.normal(size=1), r.normal(size=(2, 2))
    sizes = [3, 1, 0, 6, 2]
    first = np.concatenate([[0], np.cumsum(sizes)])
    bins = r.integers(0, Q.BINS, (first[-1], Q.FEATURES)).astype(np.uint8)
    evidence = field.evidence(bins, first)
    # the evidence is the sum of a line's own weights and of those for its neighbours
    for t, n in enumerate(sizes):
        for i in range(n):
            at = first[t] + i
            want = field.bias[0] + sum(field.weight[1, f, bins[at, f]] for f in range(Q.FEATURES))
            want += sum(field.weight[0, f, bins[at - 1, f]] for f in range(Q.FEATURES)) if i else 0
            want += sum(field.weight[2, f, bins[at + 1, f]] for f in range(Q.FEATURES)) if i + 1 < n else 0
            assert math.isclose(evidence[at], want, rel_tol=1e-9, abs_tol=1e-9)
    p, pairs, logs = field.marginals(evidence, first)
    total = np.zeros((2, 2))
    for t, n in enumerate(sizes):
        e = evidence[first[t] : first[t + 1]]
        z, good, joint = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(e[i] for i in range(n) if labels[i]) + sum(field.turn[a, b] for a, b in zip(labels, labels[1:])))
            z += w
            good += w * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                joint[a, b] += w
        if n:
            assert np.allclose(p[first[t] : first[t + 1]], good / z) and math.isclose(logs[t], math.log(z), rel_tol=1e-9)
            total += joint / z
    assert np.allclose(pairs, total)
    size = r.integers(1, 50, first[-1])
    quality = field.quality(bins, size, first)
    for t in range(len(sizes)):
        own = slice(first[t], first[t + 1])
        assert math.isclose(quality[t], (p[own] * size[own]).sum() / size[own].sum() if sizes[t] else 0.0, rel_tol=1e-9)


def test_fitting_follows_the_likelihood():
    r = np.random.default_rng(3)
    sizes = r.integers(1, 6, 200)
    first = np.concatenate([[0], np.cumsum(sizes)])
    bins = r.integers(0, Q.BINS, (first[-1], Q.FEATURES)).astype(np.uint8)
    label = (bins[:, 3] >= 5).astype(np.int64)
    field = Q.Field()
    field.fit(bins, first, label, np.ones(len(bins)))
    p, _, _ = field.marginals(field.evidence(bins, first), first)
    assert ((p > 0.5) == label).mean() > 0.99
