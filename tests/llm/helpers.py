"""Small tables with all the awkward cases."""

import random

LONG = "lorem ipsum dolor " * 40_000

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, " \
             "key string, score string, n long, hub string, phase string"


def documents(spark, texts, langs=None, sources=None, ids=None):
    """Documents with extra columns named as some operators name their own."""
    rows = [(ids[k] if ids else k, t, langs[k] if langs else "en",
             sources[k] if sources else f"src{k % 3}", len(t or ""), "x", "y", "z", k, "h", "p")
            for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def edited(text, seed, edits):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
    return " ".join(words)


class Roots:
    """Union-find for brute force."""

    def __init__(self):
        self.up = {}

    def root(self, a):
        while self.up.setdefault(a, a) != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a
