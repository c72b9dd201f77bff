"""The trained models of operators 2 and 10 against plain loops over single words, grams, documents and positions."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from kiloqueue.llm import language_id, quality_model
from kiloqueue.llm.common import hash_words
from tests.llm.tables import prose

TEXTS = ["", "one", "a a a b", " lead and  trail \n", "Ünï çödé wörds", "x" * 50, "tab\tand\x0bfeed\x0c end", *(prose(40, k, 60) for k in range(43))]


def plain_features(text):
    """Hashed rows of one text, word by word and gram by gram."""
    out = Counter()
    words = text.encode().split()
    for w in words:
        out[int(hash_words([w.decode()], lower=False)[0][0]) & ((1 << quality_model.BITS) - 1)] += 1
    out[quality_model.REPEAT] += sum(a == b for a, b in zip(words, words[1:]))
    data = [32 if b == 32 or 9 <= b <= 13 else b for b in b"\n" + text.encode() + b"\n"]
    for n in quality_model.NGRAMS:
        for i in range(len(data) - n + 1):
            gram = data[i: i + n]
            if 32 in gram[1:-1] or n == 2 and gram == [32, 32]:
                continue
            code = gram[0]
            for b in gram[1:]:
                code = (code * 0x01000193 + b) % 2**32
            h = (code * 0x9E3779B1 + n) % 2**32
            out[((h ^ (h >> 15)) * 0x85EBCA77 % 2**32) >> (32 - quality_model.BITS)] += 1
    return +out


def test_features_equal_a_loop():
    rows, owner = quality_model.features(TEXTS)
    for i, t in enumerate(TEXTS):
        assert Counter(rows[owner == i].tolist()) == plain_features(t), t


def test_training_equals_a_loop():
    """An epoch of minibatches on 50 rows, one document and one class at a time."""
    labels = np.array([k % 2 for k in range(len(TEXTS))])
    bags = [quality_model._weighted(*(x.tobytes() for x in quality_model._bag(np.array(sorted(plain_features(t).elements()), np.int32)))) for t in TEXTS]
    start = quality_model.start_model()
    got = quality_model.train_epoch(start, bags, labels, 0.3, 4)
    n = quality_model.DIM << quality_model.BITS
    table = start[:n].reshape(-1, quality_model.DIM).astype(float)
    out, bias = start[n: n + 2 * quality_model.DIM].reshape(2, -1).astype(float), start[-2:].astype(float)
    order = np.random.default_rng(4).permutation(len(bags))
    for lo in range(0, len(order), quality_model.BATCH):
        batch = order[lo: lo + quality_model.BATCH]
        step = 0.3 * (1 - 0.9 * lo / len(order))
        moves, d_out, d_bias = [], np.zeros_like(out), np.zeros_like(bias)
        for i in batch:
            total = plain_features(TEXTS[i])
            hidden = sum((c * table[r] for r, c in total.items()), np.zeros(quality_model.DIM)) / max(sum(total.values()), 1)
            z = [float(hidden @ out[k] + bias[k]) for k in (0, 1)]
            p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
            grad = np.array([p[k] - (k == labels[i]) for k in (0, 1)])
            moves.append((total, grad @ out))
            for k in (0, 1):
                d_out[k] += grad[k] * hidden / len(batch)
                d_bias[k] += grad[k] / len(batch)
        out -= step * d_out
        bias -= step * d_bias
        for total, back in moves:
            for r, c in total.items():
                table[r] -= step * quality_model.GAIN * c / sum(total.values()) * back
    assert np.allclose(got[:n].reshape(table.shape), table, atol=2e-3) and np.allclose(got[-2:], bias, atol=1e-4)
    assert np.allclose(got[n: n + 2 * quality_model.DIM].reshape(2, -1), out, atol=1e-3)
    assert np.abs(got - start).max() > 0.05


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_layer(data, w, u, b):
    """The states of one gated layer over the bytes of a word, unit by unit."""
    size = language_id.HIDDEN
    h, states = [0.0] * size, []
    for byte in data:
        x = [float(w[byte, k] + b[k]) for k in range(3 * size)]
        z = [sigmoid(x[k] + sum(h[j] * u[j, k] for j in range(size))) for k in range(size)]
        r = [sigmoid(x[size + k] + sum(h[j] * u[j, size + k] for j in range(size))) for k in range(size)]
        new = [math.tanh(x[2 * size + k] + sum(r[j] * h[j] * u[j, 2 * size + k] for j in range(size))) for k in range(size)]
        h = [h[k] + z[k] * (new[k] - h[k]) for k in range(size)]
        states.append(h)
    return states


def plain_positions(word, parts, langs):
    wf, uf, bf, wb, ub, bb, out, bias = parts
    data = b" " + word + b" "
    forward, backward = plain_layer(data, wf, uf, bf), plain_layer(data[::-1], wb, ub, bb)[::-1]
    probabilities = []
    for f, b in zip(forward, backward):
        z = [float(sum(s * out[j, k] for j, s in enumerate([*f, *b])) + bias[k]) for k in range(langs)]
        e = [math.exp(x - max(z)) for x in z]
        probabilities.append([x / sum(e) for x in e])
    return probabilities


def test_network_equals_a_loop():
    langs, r = 3, random.Random(2)
    parts = language_id.unpack(language_id.start_model(langs), langs)
    words = [b"a", b"word", "größe".encode(), bytes(r.randrange(33, 256) for _ in range(32)), b"42", b"x1"]
    data, size = language_id.pack(words)
    p, live, *_ = language_id.forward(parts, data, size)
    assert live.sum() == sum(len(w) + 2 for w in words)
    labels = language_id.WordLabels(language_id.start_model(langs), langs)
    labels.learn(words)
    for i, w in enumerate(words):
        want = np.array(plain_positions(w, parts, langs))
        assert np.allclose(p[: len(w) + 2, i], want, atol=1e-4)
        letters = [k + 1 for k, b in enumerate(w) if b >= 128 or chr(b).isalpha()]
        assert np.allclose(labels.letters[labels.known[w]], want[letters].sum(0) if letters else 0, atol=1e-3)
    # numbers and marks don't vote
    alone, more = labels.of([[b"word"], [b"word", b"42", b"42"]])
    assert np.allclose(alone, more) and alone.sum() == pytest.approx(1)
