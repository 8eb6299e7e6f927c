"""A word has one bucket, wherever it stands and however long the text is."""

import numpy as np

from tablelens.llm import language


def test_a_word_has_the_same_bucket_in_every_text(monkeypatch):
    seen = []
    hashed = language._hashed
    monkeypatch.setattr(language, "_hashed", lambda values, salt, buckets: (seen.append(hashed(values, salt, buckets)) if salt == 99 else None, hashed(values, salt, buckets))[1])
    for text in (b"the", b"the cat", b"a dog and the other", b"the " * 50):
        language.features(text, 1 << 14)
    words = [set(s.tolist()) for s in seen]
    assert len(words[0]) == 1 and all(words[0] <= w for w in words) and len(words[3]) == 1
    assert len(words[1]) == 2 and len(np.unique(seen[2])) == 5
