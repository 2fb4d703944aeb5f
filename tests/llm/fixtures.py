"""Texts and word sets that several tests share."""

import random

import regex

WORDS = regex.compile(r"[\p{L}\p{N}]+")
TEXTS = "rec_id long, text string, source string, labels array<string>, _h string, id string, key string, cls string"


def words(t):
    return frozenset(WORDS.findall(t.lower())) if t else frozenset()


def rows(texts):
    """Records with columns whose names clash with internal ones."""
    return [(i + 1, t, "Src ::aug" if i % 2 else " src", ["safe"], "x", "y", "z", "c") for i, t in enumerate(texts)]


def some_texts(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["the", "a", "and", "of"]
    out = [None, "", "--- ***", "one", "one", "ONE!", "two words", "words two"]
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 30))]
        out.append(" ".join(base))
        for _ in range(2):
            edit = base[:]
            for _ in range(rng.randint(0, 4)):
                edit[rng.randrange(len(edit))] = rng.choice(vocabulary)
            rng.shuffle(edit)
            out.append(", ".join(edit).title())
    out += [out[-1]] * 5 + [" ".join(f"long{i}" for i in range(3000)), " ".join(f"long{i}" for i in range(5, 3005))]
    return out


def similar(a, b, num, den):
    return bool(a and b) and len(a & b) * den >= num * len(a | b)
