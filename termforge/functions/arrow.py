"""Batches of texts in parts that bound what Python holds at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut up at once, about; memory is some hundred times that, or of the longest document.
SLICE = 1 << 17


def slices(b: pa.Array | pa.RecordBatch, text: str | None = None) -> Iterator[pa.Array | pa.RecordBatch]:
    """An array of texts, or a batch with them in a column, in parts of SLICE bytes of text, or of one row that has more."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b[text] if text else b), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
        yield b.slice(at, to - at)
        at = to
