"""SimHash fingerprints of texts. Plain Python and numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 3
SEED = 42
# Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text.

    Words are cut at ASCII white space after lower-casing A-Z; shingles are three words, with
    repeats, or all words of a shorter text. A bit is one if it is set in more than half of the
    shingles' XXH64 hashes. A text without words, or NULL, has fingerprint zero.
    """
    # bytes.lower and bytes.split know ASCII only.
    words = (text or "").encode().lower().split()
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        hashes = [
            digest(b"%b %b %b" % three, SEED)
            for three in zip(part, part[1:], part[2:], strict=False)
        ]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
    ones = np.flatnonzero(2 * counts > n)
    return int((np.uint64(1) << ones.astype(np.uint64)).sum()) if len(ones) else 0
