"""Fixtures and plain re-statements shared by the tests of the training-data operators."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}x{rng.randrange(9)}" for _ in range(n)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def odd_texts():
    """Texts that every operator must survive."""
    return [None, "", "   \n\t ", "a", "...", "1 2 3", "éÉ \U0001f600 中文", "x\n\n\nx", "long " * 30_000]


def documents(spark, texts, langs=None, sources=None, extra=None):
    rows = [(i, t, (langs or [None] * len(texts))[i], (sources or [None] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def components(nodes, linked):
    """Smallest node reachable, for a test of two nodes."""
    nodes = sorted(nodes)
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[k + 1:]:
            if linked(a, b):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def rng(seed=5):
    return random.Random(seed)
