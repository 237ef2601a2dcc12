"""The quality chain's features, fit and document score against plain loops and enumeration."""

import itertools
import math
import random

import numpy as np
import pytest

from strandline.llm import quality

STOPS = b".,;:?'\"-()"


def kind(b):
    if 97 <= b <= 122 or b >= 128:
        return "lower"
    if 65 <= b <= 90:
        return "upper"
    if 48 <= b <= 57:
        return "digit"
    if b in (9, 11, 12, 13, 32):
        return "blank"
    if b in STOPS:
        return "stop"
    return {33: "shout", 124: "bar"}.get(b, "mark")


def plain_features(text):
    out, seen = [], set()
    for line in text.encode().split(b"\n"):
        kinds = [kind(b) for b in line]
        n = len(line)
        words = sum(k != "blank" and (i == 0 or kinds[i - 1] == "blank") for i, k in enumerate(kinds))
        noise = [k in ("mark", "shout") for k in kinds]
        runs = sum(noise[i] and noise[i - 1] for i in range(1, n))
        found = line.split()
        several = len(found) > 1
        share = lambda k, kinds=kinds, n=n: kinds.count(k) / max(n, 1)
        out.append(
            [
                math.log(1 + n), math.log(1 + words), n / max(words, 1) / 10, share("upper"), share("digit"), share("stop"), share("shout"), share("bar"), share("mark"), runs / max(n, 1),
                float(bool(kinds) and kinds[-1] == "stop"), float(n == 0), float(line in seen), sum(a == b for a, b in zip(found, found[1:], strict=False)) / len(found) if several else 0.0,
                len(set(found)) / len(found) if several else 0.0,
            ]
        )
        seen.add(line)
    return out


def odd_texts():
    rng = random.Random(3)
    letters = "abcXYZ019 \t.,;!|#é漢\n\n"
    return ["", "\n", "one line.", "same same same\nsame same same\nother", "A|B|C!!\n##", "\r\nx", *("".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(60))]


def test_features_by_loops():
    texts = odd_texts()
    own, size, counts = quality.line_features(texts)
    want = [row for t in texts for row in plain_features(t)]
    assert counts.tolist() == [t.count("\n") + 1 for t in texts]
    assert size.tolist() == [len(x) for t in texts for x in t.encode().split(b"\n")]
    np.testing.assert_allclose(own, np.array(want), rtol=1e-5, atol=1e-6)
    wide = quality.with_neighbours(own, counts)
    at = 0
    for n in counts:
        for i in range(n):
            before = own[at + i - 1] if i else np.zeros(quality.OWN)
            after = own[at + i + 1] if i + 1 < n else np.zeros(quality.OWN)
            np.testing.assert_array_equal(wide[at + i], np.concatenate([own[at + i], before, after, [i == 0, i + 1 == n, 1]]).astype(np.float32))
        at += n


def enumerated(good, turn):
    """P(good) of each line and expected changes of state, over all sequences of states."""
    n, total, p, pairs = len(good), 0.0, np.zeros(len(good)), np.zeros((2, 2))
    for states in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(g for g, s in zip(good, states, strict=True) if s) + sum(turn[a][b] for a, b in itertools.pairwise(states)))
        total += w
        p += w * np.array(states)
        for a, b in itertools.pairwise(states):
            pairs[a, b] += w
    return p / total, pairs / total


def plain_odds(p, sizes):
    share = sum(x * (n + 1) for x, n in zip(p, sizes, strict=True)) / sum(n + 1 for n in sizes)
    share = min(max(share, 3e-4), 1 - 3e-4)
    return math.log(share / (1 - share))


def test_document_score_by_enumeration():
    rng = np.random.default_rng(4)
    texts = [t for t in odd_texts() if t.count("\n") < 9]
    wide = 3 * quality.OWN + 3
    chain = quality.Chain(rng.normal(size=wide), rng.random(wide) + 0.5, rng.normal(size=wide) / 4, rng.normal(size=(2, 2)), 1.3, -0.2)
    own, size, counts = quality.line_features(texts)
    got = chain.score(quality.good_share(chain.lines(own, counts), size, counts))
    for text, score in zip(texts, got, strict=True):
        rows = plain_features(text)
        zero = [0.0] * quality.OWN
        x = [[*r, *(rows[i - 1] if i else zero), *(rows[i + 1] if i + 1 < len(rows) else zero), float(i == 0), float(i + 1 == len(rows)), 1.0] for i, r in enumerate(rows)]
        good = [sum((v - m) / s * w for v, m, s, w in zip(r, chain.mean, chain.scale, chain.weights, strict=True)) for r in x]
        p, _ = enumerated(good, chain.turn)
        odds = plain_odds(p, [len(b) for b in text.encode().split(b"\n")])
        assert score == pytest.approx(1 / (1 + math.exp(-(1.3 * odds - 0.2))), abs=1e-4), text


def test_fit_by_enumeration(monkeypatch):
    """Both rounds of the fit once more, with expectations over all sequences of states."""
    monkeypatch.setattr(quality, "STEPS", 12)
    texts = ["good line here.\nand one more.\nlast", "#### !!!\n$$ %% ^^\nok then", "fine.\nfine too.", "!!!\n###"]
    labels = np.array([1, 0, 1, 0])
    own, size, counts = quality.line_features(texts)
    found = quality.fitted(own, size, counts, labels)

    x = quality.with_neighbours(own, counts).astype(float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    z, n = (x - mean) / scale, len(x)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    docs = [slice(a, b) for a, b in itertools.pairwise(cuts)]
    w, turn, ws, ts = np.zeros(x.shape[1]), np.zeros((2, 2)), np.full(x.shape[1], 1e-8), np.full((2, 2), 1e-8)

    def expected():
        ps, pairs = [], np.zeros((2, 2))
        for d in docs:
            p, more = enumerated((z[d] @ w).tolist(), turn)
            ps, pairs = ps + p.tolist(), pairs + more
        return np.array(ps), pairs

    of_doc = np.repeat(labels, counts)
    state = of_doc.astype(float)
    for again in range(quality.ROUNDS):
        seen = np.zeros((2, 2))
        for d in docs:
            for a, b in itertools.pairwise(state[d].astype(int)):
                seen[a, b] += 1
        for _ in range(quality.STEPS):
            p, pairs = expected()
            up, change = z.T @ (state - p) / n - quality.RIDGE * w, (seen - pairs) / n - quality.RIDGE * turn
            ws, ts = ws + up * up, ts + change * change
            w, turn = w + quality.RATE * up / np.sqrt(ws), turn + quality.RATE * change / np.sqrt(ts)
        if again + 1 < quality.ROUNDS:
            state = np.array([0.0 if d == 0 and p < 0.5 else 1.0 for d, p in zip(of_doc, expected()[0], strict=True)])
    np.testing.assert_allclose(found.weights, w, rtol=1e-5, atol=1e-6)
    np.testing.assert_allclose(found.turn, turn, rtol=1e-5, atol=1e-6)
    odds = np.array([plain_odds(expected()[0][d], size[d]) for d in docs])
    # the curve: where the slightly ridged likelihood has no slope
    p = 1 / (1 + np.exp(-(found.slope * odds + found.shift)))
    assert abs(((labels - p) * odds).sum() - 0.5 * (found.slope - 1)) < 1e-3 and abs((labels - p).sum() - 0.5 * found.shift) < 1e-3
