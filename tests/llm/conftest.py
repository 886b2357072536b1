from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "po", "re", "sa", "ti") for b in ("n", "ra", "mel", "dos", "vi", "quen", "bor")]


@pytest.fixture(scope="session")
def babble():
    """Make a text of ``n`` words; the same seed gives the same text."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def edit():
    """Replace ``k`` words of a text."""

    def make(text: str, seed: int, k: int) -> str:
        rng, words = random.Random(seed), text.split(" ")
        for at in rng.sample(range(len(words)), k):
            words[at] = f"new{rng.randrange(10**6)}"
        return " ".join(words)

    return make


def least_reachable(ids, links):
    """Least id of each id's component."""
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least
