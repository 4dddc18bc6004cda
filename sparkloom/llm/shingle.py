"""Word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def shingles(text: str, width: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of width words; a text of fewer words is one run. Only A-Z are lower-cased."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    data = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(tokens) - width + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:k].tolist(), ends[-k:].tolist(), strict=True)
    return np.fromiter((digest(data[a:b], SEED) for a, b in spans), dtype=np.uint64, count=k)
