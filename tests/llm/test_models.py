"""The small models trained in numpy."""

import numpy as np
import pyarrow as pa

from gleaner.llm import language_id, quality


def test_network_gradient():
    rng = np.random.default_rng(0)
    network = language_id.Network(["a", "b", "c"])
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    x, y = rng.integers(97, 110, (5, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        pooled, _ = network._forward(x)
        p = language_id._softmax(np.maximum(pooled, 0) @ network.weights["out"] + network.weights["out_bias"])
        return -np.log(p[np.arange(5), y]).mean()

    grads = network.gradients(x, y)
    for name in ("out", "bias", "filter2", "filter4", "embedding"):
        flat, grad = network.weights[name].reshape(-1), grads[name].reshape(-1)
        for k in np.argsort(-np.abs(grad))[:3]:
            was = flat[k]
            flat[k] = was + 1e-6
            up = loss()
            flat[k] = was - 1e-6
            down = loss()
            flat[k] = was
            assert abs((up - down) / 2e-6 - grad[k]) < 1e-4 * max(1, abs(grad[k])), name


def texts_of(rng, alphabet, n):
    word = lambda: "".join(rng.choice(list(alphabet), rng.integers(2, 8)))
    return [" ".join(word() for _ in range(rng.integers(5, 200))) for _ in range(n)]


def test_network_learns_and_tables_agree():
    rng = np.random.default_rng(1)
    texts = texts_of(rng, "abcdefgh", 60) + texts_of(rng, "abcdéfñh", 60) + texts_of(rng, "mnopqrst", 60)
    y = np.repeat([0, 1, 2], 60)
    x, begins, _ = language_id.windows_of(pa.array(texts))
    network = language_id.Network(["x", "y", "z"]).fit(x, np.repeat(y, np.diff(begins)), epochs=4)
    best, score = network.predict(pa.array([*texts, None, ""]))
    assert np.mean([b == "xyz"[k] for b, k in zip(best, y, strict=False)]) > 0.95
    assert best[-2:] == [None, None] and ((score >= 0) & (score <= 1)).all()
    pooled, _ = network._forward(x[:20])
    plain = language_id._softmax(np.maximum(pooled, 0) @ network.weights["out"] + network.weights["out_bias"])
    assert np.allclose(plain, network.probabilities(x[:20]), atol=1e-4)


def test_windows_cover_whole_texts():
    texts = ["", None, "a" * 1000, "É1B" * 100, "x"]
    x, begins, filled = language_id.windows_of(pa.array(["skipped", *texts])[1:])
    for text, a, b in zip(texts, begins[:-1], begins[1:], strict=True):
        data = bytes(language_id._FOLD[np.frombuffer((text or "").encode(), np.uint8)])
        assert x[a:b].tobytes()[: len(data)] == data and filled[a:b].sum() == len(data)


def test_rules_learn_a_conjunction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 9] <= 0.6)).astype(float)
    found = quality.fit(x, y)
    p = found.score(x)
    assert np.mean((p >= 0.5) == (y == 1)) > 0.98
    assert 0 < len(found.rules) < 80
    assert quality.fit(x, y).rules == found.rules


def test_rules_without_both_labels():
    x = np.zeros((3, len(quality.STATISTICS)))
    assert quality.fit(x, np.ones(3)).rules == [] and abs(quality.fit(x, np.ones(3)).score(x)[0] - 4 / 5) < 1e-9
    assert abs(quality.fit(x[:0], np.zeros(0)).score(x)[0] - 0.5) < 1e-9
