import random

import numpy as np
import pytest

from skyweft.llm import anchors


def brute(rows, within):
    out = []
    first = {}
    for a, c, d, t, _ in rows:
        first[a, c] = min(first.get((a, c), (d, t)), (d, t))
    reps = [r for r in rows if (not r[2] > first[r[:2]][0] and not (within and (r[2], r[3]) > first[r[:2]]))]
    for a, c, d, t, f in rows:
        if d > first[a, c][0] or (within and (d, t) > first[a, c]):
            out.append((d, t, anchors.SURE))
            continue
        group = [r for r in reps if r[0] == a]
        if not within and len({r[2] for r in group}) < 2:
            continue
        state = 0
        for bit, shift in ((anchors.LEFT, 2), (anchors.RIGHT, 18)):
            same = [r for r in group if (r[4] >> shift) & 0xFFFF == (f >> shift) & 0xFFFF]
            state |= bit if len(same) > 1 else 0
        if f & 3 == anchors.HOT:
            state = anchors.LEFT | anchors.RIGHT
        if state:
            out.append((d, t, state))
    return sorted(out)


@pytest.mark.parametrize("within", [True, False])
@pytest.mark.parametrize("seed", range(6))
def test_stream_does_not_depend_on_batches(within, seed):
    rng = random.Random(seed)
    rows = set()
    while len(rows) < 300:
        a = rng.randint(-6, 20) if rng.random() < 0.7 else 3
        rows.add((a, rng.randint(0, 5), rng.randint(0, 12), rng.randint(0, 40)))
    rows = sorted(rows)
    rows = [(*r, rng.randint(0, 3) << 2 | rng.randint(0, 3) << 18 | (anchors.HOT if r[0] == 7 else 0)) for r in rows]
    stream, got, at = anchors._Stream(within), [], 0
    while at < len(rows):
        n = rng.choice((1, 2, 5, 40))
        got += stream.add(*(np.array(x, np.int64) for x in zip(*rows[at : at + n])))
        at += n
    got += stream.finish()
    assert sorted((int(d), int(t), int(s)) for p in got for d, t, s in zip(*p)) == brute(rows, within)


def test_too_many_rows_of_one_anchor_stay_open(monkeypatch):
    monkeypatch.setattr(anchors, "HELD_ROWS", 10)
    rows = [(1, c, c, 0, c << 2) for c in range(50)]
    stream, got = anchors._Stream(True), []
    for at in range(0, 50, 7):
        got += stream.add(*(np.array(x, np.int64) for x in zip(*rows[at : at + 7])))
    got += stream.finish()
    found = sorted((int(d), int(s)) for p in got for d, _, s in zip(*p))
    assert found == [(c, anchors.LEFT | anchors.RIGHT) for c in range(50)]
