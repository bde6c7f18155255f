"""Rate conversion of signals by a polyphase windowed sinc."""

from __future__ import annotations

from math import gcd

import numpy as np


class Resampler:
    """Converts from ``rate`` to ``target``: up / down in lowest terms, and a phase of the
    filter for each of ``up`` places between two samples.

    The filter is a sinc of 64 zero crossings a side under a Kaiser window (beta 12), cut at
    0.92 of the lower of the two half rates. Tones up to 0.85 of it keep their level within
    0.0001, those beyond it (which would alias) come out 100 dB lower. Beyond its ends a
    signal is zero.
    """

    def __init__(self, rate: int, target: int, half: int = 64, beta: float = 12.0) -> None:
        if rate <= 0 or target <= 0:
            raise ValueError("rates are positive")
        common = gcd(rate, target)
        self.up, self.down = target // common, rate // common
        cut = 0.92 * min(1.0, target / rate)
        #: Samples of the source on either side that an output needs.
        self.reach = int(np.ceil(half / cut))
        self.offsets = np.arange(-self.reach, self.reach + 1)
        at = self.offsets[None, :] - (np.arange(self.up) / self.up)[:, None]
        inside = np.clip(1 - (at / (self.reach + 1)) ** 2, 0, None)
        taps = cut * np.sinc(cut * at) * np.i0(beta * np.sqrt(inside))
        self.taps = taps / taps.sum(1, keepdims=True)

    def length(self, n: int) -> int:
        """Outputs of ``n`` samples."""
        return -(-n * self.up // self.down)

    def needs(self, first: int, count: int) -> tuple[int, int]:
        """The source's samples, from and to, that a range of outputs is made of."""
        return max(0, first * self.down // self.up - self.reach), (first + count) * self.down // self.up + self.reach + 1

    def __call__(self, x: np.ndarray, first: int = 0, count: int | None = None, begin: int = 0, step: int = 16_384) -> np.ndarray:
        """``count`` outputs from number ``first`` on; ``x`` holds the source's samples from
        ``begin`` on. Ranges put together are the whole."""
        count = self.length(begin + len(x)) - first if count is None else count
        out = np.empty(count)
        padded = np.concatenate(([0.0], x.astype(np.float64), [0.0]))
        for at in range(0, count, step):
            places = np.arange(first + at, min(first + at + step, first + count), dtype=np.int64) * self.down
            rows = (places // self.up - begin + 1)[:, None] + self.offsets[None, :]
            out[at : at + len(places)] = np.einsum("ij,ij->i", padded[np.clip(rows, 0, len(padded) - 1)], self.taps[places % self.up])
        return out
