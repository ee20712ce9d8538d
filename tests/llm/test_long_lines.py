"""Long lines: few pairs that are not similar come to be compared, and none that is similar is lost."""

from __future__ import annotations

import random

import pytest

from arbor.llm import lines


@pytest.mark.parametrize("long", [1 << 30, 1])
def test_long_lines_by_force(spark, monkeypatch, long):
    met = []

    def verified(pairs, *args, found=lines._verified):
        met.append(pairs.select("a", "b").distinct().count())
        return found(pairs, *args)

    monkeypatch.setattr(lines, "_verified", verified)
    monkeypatch.setattr(lines, "LONG", long)
    monkeypatch.setattr(lines, "SAMPLED", 1)
    rng, every = random.Random(5), [f"w{i}" for i in range(450)]
    made = [rng.sample(every, rng.randrange(100, 160)) for _ in range(120)] + [rng.sample(every, n) for n in (70, 71, 72, 73, 74, 90)]
    for w in made[::6] + made[120:]:  # near copies about the threshold, and shorter and longer ones, about FINE too
        n = len(w)
        for change in (n // 9 - 1, n // 9, n // 9 + 1):
            made.append(w[change:] + [f"x{rng.randrange(10**6)}" for _ in range(change)])
        made += [w[n // 5 :], w[n // 5 + 1 :], w + [f"y{i}" for i in range(n // 4)], w + [f"y{i}" for i in range(n // 4 + 1)]]
    sets = [frozenset(w) for w in made]
    near = [[n for n in range(m) if 100 * len(s & sets[n]) >= 80 * len(s | sets[n])] for m, s in enumerate(sets)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string").repartition(3)
    assert sorted(r._doc for r in lines.kept_lines(df).collect()) == [m for m, x in enumerate(near) if not x]
    assert met[0] <= 1.5 * sum(map(len, near))
