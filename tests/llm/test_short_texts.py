"""Fingerprints of short texts outlive an edit of their last third."""

import random

import numpy as np

from shoal.llm import syncmers


def test_short_texts_stay_alike():
    rng = random.Random(41)
    for n in range(3, 60):
        for after in ("", "XYZ" * 20):
            text = "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
            new = syncmers.edited(text, after)
            if n < syncmers.SHORT:
                assert syncmers.likeness(syncmers.fingerprint(text), syncmers.fingerprint(new)) > 0
            places, hashes = syncmers.anchors(text)
            assert (np.diff(places) >= 0).all()
            assert len(places) == len(hashes) and places.max() < n
    assert syncmers.likeness(syncmers.fingerprint("abcdefg"), syncmers.fingerprint("QRSTUVW")) == 0
