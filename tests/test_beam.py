"""Batched prefix search against the plain one, which keeps whole texts in dicts."""

import math
import time

import numpy as np
import pytest

from tonelake.functions.constants import VOCABULARY
from tonelake.operators import ctc


def plain_search(frames: np.ndarray, lm: dict | None, width: int, alpha: float, n: int = 3, vocabulary=VOCABULARY) -> str:
    """Best text under the frame scores and a character model: probabilities of a text ending in a blank or in its last sign are kept apart,
    so that a sign after a blank is a new one."""
    uniform = math.log(1 / max(1, lm["size"])) if lm else 0.0
    beams = {(): (0.0, -math.inf)}
    for frame in frames:
        top = np.argpartition(-frame, min(2 * width, len(frame)) - 1)[: 2 * width]
        new: dict[tuple, list[float]] = {}

        def add(text: tuple, blank: float, sign: float, into=new) -> None:
            had = into.setdefault(text, [-math.inf, -math.inf])
            had[0], had[1] = np.logaddexp(had[0], blank), np.logaddexp(had[1], sign)

        for text, (blank, sign) in beams.items():
            both = np.logaddexp(blank, sign)
            for c in top:
                p = float(frame[c])
                if c == 0:
                    add(text, both + p, -math.inf)
                    continue
                bonus = 0.0
                if lm:
                    context = "".join(vocabulary[i] for i in text)[-(n - 1) :]
                    bonus = alpha * lm["logp"].get((context, vocabulary[c]), lm["unseen"].get(context, uniform))
                if text and text[-1] == c:
                    add(text, -math.inf, sign + p)
                    add((*text, c), -math.inf, blank + p + bonus)
                else:
                    add((*text, c), -math.inf, both + p + bonus)
        beams = dict(sorted(new.items(), key=lambda x: (-np.logaddexp(*x[1]), x[0]))[:width])
    best = max(beams.items(), key=lambda x: (np.logaddexp(*x[1]), [-i for i in x[0]]))[0] if beams else ()
    return " ".join("".join(vocabulary[i] for i in best).split())


def model(rng):
    pairs = {}
    for a in rng.choice(VOCABULARY[1:], 40):
        for b in rng.choice(VOCABULARY[1:], 6):
            pairs[(str(a + b)[-2:], str(rng.choice(VOCABULARY[1:])))] = float(np.log(rng.random()))
    return {"logp": pairs, "unseen": {c: float(np.log(0.01)) for c, _ in pairs}, "size": 40}


@pytest.mark.parametrize("width", [1, 4, 16])
@pytest.mark.parametrize("with_model", [False, True])
def test_batches_equal_the_plain_search(width, with_model):
    rng = np.random.default_rng(width)
    lm = model(rng) if with_model else None
    utterances = [np.log(rng.dirichlet(np.full(len(VOCABULARY), a), int(n))) for n in (0, 1, 2, 7, 30, 60) for a in (0.03, 0.3, 1.0)]
    utterances = [np.maximum(x, -60.0 - rng.random(x.shape)) for x in utterances]  # no ties at minus infinity
    want = [plain_search(x, lm, width, 0.35) for x in utterances]
    assert ctc.prefix_search(utterances, lm, width, 0.35) == want
    assert ctc.prefix_search(utterances[::-1], lm, width, 0.35) == want[::-1]  # whatever else is in the batch


def test_long_utterances_cost_little():
    """Utterances of 500 frames: ten times less Python than the plain search, and the same texts."""
    rng = np.random.default_rng(3)
    lm = model(rng)
    utterances = [np.log(rng.dirichlet(np.full(len(VOCABULARY), 0.05), 500) + 1e-12 * rng.random((500, len(VOCABULARY)))) for _ in range(32)]
    start = time.process_time()
    got = ctc.prefix_search(utterances, lm, 16, 0.35)
    batched = (time.process_time() - start) / len(utterances)
    start = time.process_time()
    assert got[0] == plain_search(utterances[0], lm, 16, 0.35)
    assert 10 * batched < time.process_time() - start
    assert all(len(x) > 50 for x in got)


def test_nothing_to_search():
    assert ctc.prefix_search([], None, 4, 0.0) == [] and ctc.prefix_search([np.empty((0, len(VOCABULARY)))] * 2, None, 4, 0.0) == ["", ""]
