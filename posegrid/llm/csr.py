"""Growing list of integer rows, gathered by index without a Python loop."""

from __future__ import annotations

from array import array

import numpy as np

from .common import spread


class Rows:
    def __init__(self, code: str = "I"):
        self.flat, self.ptr = array(code), array("q", [0])
        self.kind = np.dtype(np.uint32 if code == "I" else np.uint8)

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def add(self, row) -> int:
        self.flat.extend(row)
        self.ptr.append(len(self.flat))
        return len(self.ptr) - 2

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        ends = np.cumsum(lengths) + len(self.flat)
        self.flat.frombytes(np.ascontiguousarray(flat, self.kind).tobytes())
        self.ptr.frombytes(ends.astype(np.int64).tobytes())

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated rows, and the length of each."""
        ptr, flat = np.frombuffer(self.ptr, np.int64), np.frombuffer(self.flat, self.kind)
        starts = ptr[index]
        lengths = ptr[index + 1] - starts
        return flat[spread(starts, lengths)] if len(flat) else np.zeros(0, self.kind), lengths
