"""Words of many texts as numbers, for the operators that compare words inside a text (operators 12 and 13)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(classes, starts) of texts given as lists of words.

    `classes` holds one number per word of all texts in a row; two words have the same number if they are equal and of one
    text, so whatever is compared afterwards never reaches across texts. `starts` holds each text's first place and the end.
    """
    sizes = np.fromiter((len(words) for words in texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = pa.array([word for words in texts for word in words], pa.large_binary())
    encoded = flat.dictionary_encode()
    ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    return np.unique(owner * max(1, len(encoded.dictionary)) + ids, return_inverse=True)[1].astype(np.int64), starts


def windows(classes: np.ndarray, width: int) -> np.ndarray:
    """Class numbers of the windows of `width` words that begin at each place (the last width - 1 places have none)."""
    found = classes
    for step in range(1, width):
        found = found[: len(classes) - step]
        found = np.unique(found * (len(classes) + 1) + classes[step : step + len(found)], return_inverse=True)[1].astype(np.int64)
    return found
