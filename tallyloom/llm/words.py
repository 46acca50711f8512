"""Words of whole Arrow batches of texts, found on the bytes with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: White space in the sense of Unicode beyond the ASCII tab to carriage return and space, as UTF-8 (fixed values).
WIDE_SPACES = ["c285", "c2a0", "e19a80", *[f"e280{x:x}" for x in range(0x80, 0x8B)], "e280a8", "e280a9", "e280af", "e2819f", "e38080"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """Bytes of all texts end to end, the texts' n + 1 borders, and the buffer; NULL counts as empty."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.string())])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[: at[-1]] if data is not None and at[-1] else np.array([], np.uint8)
    return raw, at, data


def _spaces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it belongs to white space, and whether it begins such a character."""
    first = (raw - np.uint8(9) < 5) | (raw == 32)
    inside = first.copy()
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        p = np.flatnonzero(raw == lead)
        if not len(p):
            continue
        for x in WIDE_SPACES:
            b = bytes.fromhex(x)
            if b[0] == lead:
                q = p[p + len(b) <= len(raw)]
                for k in range(1, len(b)):
                    q = q[raw[q + k] == b[k]]
                first[q] = True
                for k in range(len(b)):
                    inside[q + k] = True
    return inside, first


def word_starts(raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where words begin: a run of non-space with the one blank before it, or a run of white space.

    Of white space before a word, the last character is a word of its own, or with a blank the head of the next word; this
    is where the pieces of byte-level vocabularies begin and end. The words of a text, end to end, are the text.
    """
    if not len(raw):
        return np.array([], np.int64)
    inside, first = _spaces(raw)
    start = np.zeros(len(raw) + 1, bool)
    start[borders] = True
    text = start.copy()
    start[1:-1] |= first[1:] & ~inside[:-1]
    after = np.flatnonzero(~inside[1:] & inside[:-1] & ~text[1:-1]) + 1  # the first non-space after white space
    last = after - 1
    for _ in range(2):
        last = np.where(first[last], last, last - 1)
    start[last] = True
    start[after[raw[last] != 32]] = True
    return np.flatnonzero(start[:-1])


def split_batch(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and all words, as an array over the texts' own bytes."""
    raw, borders, data = text_bytes(texts)
    at = word_starts(raw, borders)
    ends = np.searchsorted(at, borders)
    offsets = pa.py_buffer(np.append(at, len(raw)).astype(np.int32))
    return np.diff(ends), pa.StringArray.from_buffers(len(at), offsets, data if data is not None else pa.py_buffer(b""))
