"""A factorization machine over hashed terms. Plain Python and numpy, for use inside tasks."""

from __future__ import annotations

import re
import zlib

import numpy as np

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
PREFIXES = (3, 4, 5, 6, 7)
# Words whose features are remembered, at most.
REMEMBERED = 500_000


class Terms:
    """Texts to sorted arrays of distinct feature numbers below ``2**bits``.

    A word gives itself and its first 3 to 7 letters, which stand for its inflections.
    """

    def __init__(self, bits: int, only: frozenset[int] | None = None):
        self.mask = (1 << bits) - 1
        # Where a model is applied, only the terms it knows count.
        self.only = only
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        for word in set(WORD.findall((text or "").lower())):
            features = self.known.get(word)
            if features is None:
                features = self._features(word)
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = features
            if features:
                found.update(features)
        return np.fromiter(found, np.int64, len(found))

    def _features(self, word: str) -> tuple[int, ...]:
        names = [f"w {word}", *(f"{n} {word[:n]}" for n in PREFIXES if len(word) > n)]
        numbers = {_mix(zlib.crc32(n.encode())) & self.mask for n in names}
        return tuple(numbers if self.only is None else numbers & self.only)


def _mix(x: int) -> int:
    x = (x ^ x >> 16) * 0x45D9F3B & 0xFFFFFFFF
    return x ^ x >> 16


class Machine:
    """bias + sum of weights + half of (squared sum - sum of squares) of the factors.

    ``terms`` are the numbers of the terms it knows, sorted; all others count nothing.
    """

    def __init__(self, bias: float, terms: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.terms, self.weights, self.factors = bias, terms, weights, factors

    def score(self, features: np.ndarray) -> float:
        """A probability; no known terms at all score by the bias."""
        total = self.bias
        if len(features):
            at = np.searchsorted(self.terms, np.sort(features))
            v = self.factors[at]
            pairs = 0.5 * (np.square(v.sum(axis=0)) - np.square(v).sum(axis=0)).sum()
            total += float(self.weights[at].sum()) + float(pairs)
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit(
    rows: list[np.ndarray],
    labels: np.ndarray,
    bits: int,
    rank: int = 4,
    steps: int = 1_500,
    rate: float = 0.1,
    least_rows: int = 4,
    least_z: float = 3.5,
    shrink: float = 1e-4,
    batch: int = 64,
    seed: int = 7,
) -> Machine:
    """Log loss, AdaGrad, rows in an order set by the seed.

    Only terms take part that ``least_rows`` rows hold and that go with the label: their share of
    rows with label 1 is ``least_z`` standard errors from what chance would give.
    """
    size = 1 << bits
    rng = np.random.default_rng(seed)
    if rows:
        held = np.bincount(np.concatenate(rows), minlength=size)
        ones = [f for f, y in zip(rows, labels, strict=True) if y]
        with_one = np.bincount(np.concatenate(ones), minlength=size) if ones else np.zeros(size)
        n, n1 = len(rows), len(ones)
        spread = np.sqrt(np.maximum(n1 / n * (1 - n1 / n) * held * (1 - held / n), 1e-9))
        z = (with_one - n1 / n * held) / spread
        useful = (held >= least_rows) & (np.abs(z) >= least_z)
        rows = [f[useful[f]] for f in rows]
    share = float(np.clip(labels.mean() if len(labels) else 0.1, 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, rank))
    seen_w, seen_v = np.full(size, 1e-2), np.full((size, rank), 1e-2)
    touched = np.zeros(size, bool)
    for _ in range(max(1, -(-steps * batch // max(1, len(rows))))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = [rows[i] for i in order[at : at + batch]]
            lengths = np.array([len(f) for f in some])
            if not lengths.sum():
                continue
            features = np.concatenate(some)
            of = np.repeat(np.arange(len(some)), lengths)
            vf = v[features]
            sums = np.zeros((len(some), rank))
            np.add.at(sums, of, vf)
            squares = np.bincount(of, np.square(vf).sum(axis=1), len(some))
            total = bias + np.bincount(of, w[features], len(some))
            total += 0.5 * (np.square(sums).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels[order[at : at + batch]]
            bias -= 0.02 * float(error.mean())
            used, where = np.unique(features, return_inverse=True)
            touched[used] = True
            gw = np.bincount(where, error[of], len(used)) / len(some) + shrink * w[used]
            gv = np.zeros((len(used), rank))
            np.add.at(gv, where, error[of][:, None] * (sums[of] - vf))
            gv = gv / len(some) + shrink * v[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            w[used] -= rate * gw / np.sqrt(seen_w[used])
            v[used] -= rate * 0.3 * gv / np.sqrt(seen_v[used])
    terms = np.flatnonzero(touched)
    return Machine(bias, terms, w[terms], v[terms])
