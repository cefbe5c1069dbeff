"""Plain Python versions and small corpora for the tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def corpus(n=60, seed=3):
    """(doc_id, text): invented prose with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["ba", "do", "ke", "lu", "mi", "ra", "st", "un"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            text = rng.choice(out)[1]
        elif out and kind < 0.35:
            parts = rng.choice(out)[1].split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        else:
            lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 70))) + "." for _ in range(rng.randint(1, 6))]
            if kind > 0.8:
                lines.insert(rng.randrange(len(lines) + 1), passage)
            text = "\n".join(lines)
        out.append((i * 3 % 101, text))
    return list({i: (i, t) for i, t in out}.values())


class Sets:
    """Union-find."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a
