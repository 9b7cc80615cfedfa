"""Windows of the toxicity network: all are scored, and where a passage stands does not matter."""

import numpy as np
import pytest
from workload_lens.llm import toxicity


def _made(n: int, seed: int) -> list[str]:
    return [f"plain{k}" for k in np.random.default_rng(seed).integers(0, 60, n)]


def test_scores_are_those_of_the_highest_window():
    net = toxicity.Network(5)
    sizes = [0, 1, 3, 15, 16, 17, 18, 19, 20, 21, 33, 700, toxicity.CACHED * toxicity.STEP + 2, 5001]
    texts = [" ".join(_made(n, n)) for n in sizes] + [None]
    found = toxicity.Scorer(net).scores(texts)
    for text, score in zip(texts, found, strict=True):
        windows = toxicity._Index(toxicity.windows_of(toxicity.text_words(text)))
        given = net.projected(net.inputs(windows.hashed))
        logits = net.forward(given, windows.index, windows.mask)[0]
        assert score == pytest.approx(toxicity._sigmoid(np.float64(logits.max())), abs=1e-5)


def test_scores_do_not_depend_on_the_other_texts():
    scorer = toxicity.Scorer(toxicity.Network(6))
    texts = [" ".join(_made(n, n)) for n in (40, 7, 2500, 16, 90)]
    together = scorer.scores(texts)
    assert together == pytest.approx([scorer.scores([t])[0] for t in texts], abs=1e-5)
    assert len(scorer.scores([])) == 0


def test_windows_hold_every_short_passage_whole():
    for n in range(17, 120):
        starts = toxicity.window_starts(n)
        assert starts[-1] == n - toxicity.WINDOW and len(set(starts)) == len(starts)
        for at in range(n - 12):
            assert any(s <= at and at + 13 <= s + toxicity.WINDOW for s in starts)


def test_a_passage_is_found_at_every_place():
    make = np.random.default_rng(3)
    docs = []
    for i in range(240):
        own = _made(90, i)
        if i % 4 == 0:
            at = int(make.integers(0, 84))
            own[at : at + 6] = "you utterly nastyword and vileword fool".split()
        docs.append((toxicity.windows_of(own), int(i % 4 == 0), 1.0))
    scorer = toxicity.Scorer(toxicity.train(docs))
    clean = _made(150, 999)
    texts = [" ".join(clean[:at] + "you utterly nastyword and vileword fool".split() + clean[at:]) for at in range(151)]
    assert (scorer.scores(texts) >= toxicity.THRESHOLD).all()
    assert scorer.scores([" ".join(_made(150, 5000 + k)) for k in range(40)]).max() < toxicity.THRESHOLD


def test_of_several_texts_under_one_id_the_smallest_is_learned(spark):
    docs = spark.createDataFrame([(1, "b b"), (1, "a a"), (1, None), (3, "c c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0)], "doc_id long, toxic int")
    kept = {i for i in (1, 3) if not spark.range(1).select(toxicity.held_out(toxicity.F.lit(i))).first()[0]}
    rows = [(w, y) for w, y, _ in toxicity.sample(docs, labels)]
    assert rows == [r for i, r in ((1, ([["a", "a"]], 1)), (3, ([["c", "c"]], 0))) if i in kept] and rows


def test_short_texts_cost_no_more_after_many_words(monkeypatch):
    net = toxicity.Network(8)
    scorer, fresh = toxicity.Scorer(net), toxicity.Scorer(net)
    texts = ["one two three", None, "four two", "zzz"]
    expected = fresh.scores(texts)
    for k in range(6):
        scorer.scores([" ".join(f"w{k}x{i}" for i in range(3000))])
    given, forward = [], toxicity.Network.forward

    def watched(self, table, *args, **kwargs):
        given.append(table.shape[1])
        return forward(self, table, *args, **kwargs)

    monkeypatch.setattr(toxicity.Network, "forward", watched)
    assert scorer.scores(texts) == pytest.approx(expected, abs=1e-6)
    assert given and max(given) <= 6
