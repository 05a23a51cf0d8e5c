"""Work of the PII network: windows are read once, and the path through runs in groups is the best one."""

import numpy as np

from corpusmill.llm import lstm_crf, pii


def plain_path(e, move):
    score = np.where(np.arange(e.shape[1]) == 0, 0.0, -1e9)
    back = []
    for row in e:
        ways = score[:, None] + move + row[None, :]
        back.append(ways.argmax(0))
        score = ways.max(0)
    tag = int(score.argmax())
    path = []
    for come in reversed(back):
        path.append(tag)
        tag = int(come[tag])
    return path[::-1]


def test_windows_are_read_once(monkeypatch):
    model = lstm_crf.LstmCrf(len(pii.TAGGED) + 1)
    model.params["bias"][1:] += 2  # so that places are open
    model.ready()
    seen = []
    read = model.emissions
    monkeypatch.setattr(model, "emissions", lambda x: (seen.append(x.shape[1]), read(x))[1])
    texts = ["some words and mail me@example.org " * 40, "x", "", "tel 0123 456 789 " * 30]
    once = pii.tagged(model, texts)
    step = pii.WINDOW - pii.OVERLAP
    assert once and sum(seen) == sum(max(1, -(-(len(t) - pii.OVERLAP) // step)) for t in texts if t)
    monkeypatch.setattr(pii, "KEPT", 0)
    assert pii.tagged(model, texts) == once


def test_best_path_of_many_runs(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(lstm_crf, "RUNS", 3)
    for n in (1, 63, 64, 65, 777):
        e, move = rng.integers(-9, 9, (n, 6)).astype(np.float32) + rng.random((n, 6), np.float32), rng.normal(0, 2, (6, 6)).astype(np.float32)
        assert lstm_crf.best_path(e, move).tolist() == plain_path(e.astype(float), move.astype(float))


def test_shut_gates_and_the_training_network_agree():
    model = lstm_crf.LstmCrf(6, seed=2)
    model.params["gates0"] *= 400  # sigmoids at 0 and 1
    model.ready()
    x = np.random.default_rng(1).integers(0, 128, (40, 7))
    hs = np.concatenate([model._forward(x, d)[0] for d in (0, 1)], 2)
    want = hs @ model.params["emit"] + model.params["bias"]
    assert np.abs(model.emissions(x).swapaxes(1, 2) - want).max() < 1e-3
