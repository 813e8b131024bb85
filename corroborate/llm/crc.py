"""CRC-32 of joined byte strings from the CRCs of their parts, in numpy.

crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where ``shift`` feeds zero bytes.
It is linear, so it is looked up byte by byte of the CRC.
"""

from __future__ import annotations

import numpy as np

_SHORT = 64


def _one_zero(crc: np.ndarray) -> np.ndarray:
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ np.where(crc & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return crc


def _look_up(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """``tables`` has the shift of each value of each of the four bytes."""
    out = tables[0][crc & np.uint32(255)]
    for byte in (1, 2, 3):
        out = out ^ tables[byte][(crc >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


class CrcShift:
    """Shifts of CRCs by any numbers of bytes."""

    def __init__(self):
        values = np.arange(256, dtype=np.uint32)
        one = np.stack([_one_zero(values << np.uint32(8 * byte)) for byte in range(4)])
        self.powers = [one]  # for 1, 2, 4, ... bytes
        while len(self.powers) < 40:
            self.powers.append(_look_up(self.powers[-1], self.powers[-1]))
        short = [np.stack([values << np.uint32(8 * byte) for byte in range(4)])]
        while len(short) < _SHORT:
            short.append(_look_up(one, short[-1]))
        self.short = np.stack(short).reshape(-1)  # length, byte of the CRC, value

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        near = np.minimum(n, _SHORT - 1).astype(np.int64) * 1024
        out = self.short[near + (crc & np.uint32(255))]
        for byte in (1, 2, 3):
            out = out ^ self.short[near + 256 * byte + ((crc >> np.uint32(8 * byte)) & np.uint32(255))]
        far = np.flatnonzero(n >= _SHORT)
        if len(far):
            out[far] = self.far(crc[far], n[far])
        return out

    def far(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        for bit in range(int(n.max()).bit_length()):
            crc = np.where((n >> bit) & 1, _look_up(self.powers[bit], crc), crc)
        return crc
