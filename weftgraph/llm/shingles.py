"""Sets of word shingles and their exact Jaccard similarities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

from .components import grow

ELEMENTS = 1 << 20  # elements that are looked up at once


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words is one
    shingle, a null text or one without words has none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes)
    width = min(words, len(found))
    starts = (ends - sizes)[: len(found) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts)))


def set_links(sets: list[np.ndarray], similarity: float, may: Callable[[int], np.ndarray] | None = None) -> np.ndarray:
    """For sets 0..n-1, none of them empty, the smallest of each one's component of links of at
    least the Jaccard similarity. may(i): which sets can link with set i, by default all."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    first = np.cumsum(sizes) - sizes
    distinct, terms = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(distinct), bool)

    def near(i: int) -> np.ndarray:
        ok = np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9
        ok = np.flatnonzero(ok if may is None else ok & may(i))
        mark[terms[first[i] : first[i] + sizes[i]]] = True
        out = np.zeros(n, bool)
        for part in np.array_split(ok, 1 + sizes[ok].sum() // ELEMENTS):
            if len(part):
                lens = sizes[part]
                starts = np.cumsum(lens) - lens
                held = mark[terms[np.arange(lens.sum()) + np.repeat(first[part] - starts, lens)]]
                common = np.add.reduceat(held, starts, dtype=np.int64)
                out[part] = common >= similarity * (sizes[i] + lens - common) - 1e-9
        mark[terms[first[i] : first[i] + sizes[i]]] = False
        return out

    return grow(n, near)
