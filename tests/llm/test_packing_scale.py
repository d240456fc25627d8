from __future__ import annotations

import random
from collections import Counter

from assay.llm import packing


def test_placements_do_not_follow_the_counts():
    assert len(packing.plan({100: 100_000})) <= 80  # 40 in each sequence
    rng = random.Random(12)
    lengths = Counter(min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(10_000))
    once, often = (packing.plan({n: k * c for n, c in lengths.items()}) for k in (100, 1_000))
    assert len(often) < 1.2 * len(once)
    for placed, k in ((once, 100), (often, 1_000)):
        found = Counter()
        for length, _, n, _, _ in placed.tolist():
            found[length] += n
        assert found == {n: k * c for n, c in lengths.items()}
