import random

import numpy as np

from tabflow.llm import fingerprint


def test_a_passage_leaves_its_names_in_long_texts():
    """With the parameters of the query: a passage of 50 words, shared by two long texts."""
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(5)) for _ in range(n))
    passage = text(50)
    alone, a, b = fingerprint.fingerprints([passage, text(8000) + " " + passage + " " + text(3000), text(2000) + " " + passage + " " + text(9000)])
    assert len(np.intersect1d(a, b)) >= 0.7 * len(alone) > 10
    assert fingerprint.likeness(a, b) > 0
