"""Ratios of many pairs at once, against difflib's."""

import difflib
import random

import numpy as np

from marginalia.operators import likeness


def texts(rng, n):
    """Pairs of texts, near ones and others, of few and many characters, some periodic, around the lengths at which autojunk begins."""
    for _ in range(n):
        letters = rng.choice(("ab", "abcdefghijklmnop ", "etaoin shrdlucmfwypvbgkjqxz.,TAEé😀"))
        draw = lambda k: "".join(rng.choices(letters, [0.8**i for i in range(len(letters))], k=k))  # noqa: E731, B023
        y = draw(rng.choice((0, 1, 40, 199, 200, 230, 700)))
        if rng.random() < 0.2:
            y = (y[:37] + "Q") * (len(y) // 38)
        x = list(y) if rng.random() < 0.6 else list(draw(rng.choice((0, 30, 250, 500))))
        for _ in range(rng.randint(0, len(x) // 8)):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.randint(0, 6)] = draw(rng.randint(0, 6))
        yield "".join(x).replace("e", rng.choice("ea")), y


def test_blocks_are_those_of_difflib(monkeypatch):
    x, y = zip(*texts(random.Random(5), 500))
    want = [sum(b.size for b in difflib.SequenceMatcher(None, *p).get_matching_blocks()) for p in zip(x, y)]
    for spots, most in ((1 << 17, 1 << 20), (3000, 1 << 20), (1 << 17, 2000)):
        monkeypatch.setattr(likeness, "STEP_SPOTS", spots)
        monkeypatch.setattr(likeness, "MOST_SPOTS", most)
        assert likeness.met(list(x), list(y)).tolist() == want
    need = np.array(want) + np.arange(len(want)) % 2
    got = likeness.met(list(x), list(y), need)
    assert all(g == w if w >= k else g <= w for g, w, k in zip(got.tolist(), want, need.tolist()))


def test_bounds_lose_no_ratio(monkeypatch):
    x, y = zip(*texts(random.Random(6), 300))
    for bits in (1 << 30, 1 << 14):
        monkeypatch.setattr(likeness, "HELD_BITS", bits)
        held = likeness.Texts([*x, *y])
        a = np.arange(len(x))
        ratio = np.array([difflib.SequenceMatcher(None, *p).ratio() if any(p) else 0.0 for p in zip(x, y)])
        bound = held.bound(a, a + len(x), 0.6)
        assert ((bound >= ratio) | (ratio < 0.6)).all()
        assert (bound < 0.6).sum() > 20


def test_other_blocks_are_not_compared(monkeypatch):
    """Of a document's long blocks only those that may be a quote's are compared: difflib isn't called for them, nor a subsequence."""
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", [0.9**i for i in range(26)], k=rng.randint(2, 9))) for _ in range(900)]
    rows = [(k // 10, k, " ".join(rng.choices(words, k=60))) for k in range(120)]
    quotes = [(k, None, t.replace("e", "a", 3)) for _, k, t in rows]
    asked, plain = [], likeness.met
    monkeypatch.setattr(likeness, "met", lambda x, y, need: asked.extend(x) or plain(x, y, need))
    got = {r[1]: (r[3], r[4]) for r in likeness.best_of_cells([(1, quotes, rows)], 0.6, 0.95)}
    assert len(asked) < 2 * len(quotes)
    for ev, _, q in quotes[::20]:
        score = [difflib.SequenceMatcher(None, q, t).ratio() for _, _, t in rows]
        over = next((k for k, s in enumerate(score) if s > 0.95), None)
        best = over if over is not None else max(range(len(rows)), key=lambda k: (score[k], -k))
        assert got.get(ev) == ((best, score[best]) if score[best] >= 0.6 else None)


def test_long_equal_stretches_are_read_once(monkeypatch):
    y = "".join(random.Random(8).choices("etaoin shrd", k=150)) * 60
    y = "".join(c + ("ZQXJK"[i % 5] if i % 90 == 0 else "") for i, c in enumerate(y))
    x = y[:4000] + "a" + y[4000:]
    read, plain = [], likeness._run_on
    monkeypatch.setattr(likeness, "_run_on", lambda *a: read.append(plain(*a)) or read[-1])
    assert likeness.met([x], [y])[0] == sum(b.size for b in difflib.SequenceMatcher(None, x, y).get_matching_blocks())
    diagonals = 2 * len(y) // 90
    assert sum(int(r.sum()) for r in read) < len(y) * diagonals / 4
