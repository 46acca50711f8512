"""Public vocabularies, read where they lie on each executor; never copied, never trained."""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from pathlib import Path

#: Pattern of the byte-level vocabularies that cuts a text into the pieces merges work in (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEFAULT = "byte_bpe_50k"


def folder(path: str | None = None) -> str:
    """The vocabularies' folder: the argument, else TOKENIZER_DIR, else /opt/tokenizers, else the installed package."""
    for p in (path, os.environ.get("TOKENIZER_DIR"), "/opt/tokenizers"):
        if p and Path(p).is_dir():
            return str(p)
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or not spec.origin:
        raise FileNotFoundError("no folder with tokenizer vocabularies")
    return os.path.dirname(spec.origin)


def ranks(name: str = DEFAULT, path: str | None = None) -> dict[bytes, int]:
    """Byte piece to id, from a .tiktoken file (one base64 piece and its rank a line)."""
    with open(os.path.join(folder(path), f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@functools.lru_cache(maxsize=2)
def encoder(name: str = DEFAULT, path: str | None = None):
    """The vocabulary's encoder without special tokens, loaded once per Python worker."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PIECES, mergeable_ranks=ranks(name, path), special_tokens={})


@functools.lru_cache(maxsize=2)
def piece_sizes(name: str = DEFAULT, path: str | None = None):
    """Number of bytes of each id's piece."""
    import numpy as np

    known = ranks(name, path)
    sizes = np.zeros(max(known.values()) + 1, np.int64)
    for piece, i in known.items():
        sizes[i] = len(piece)
    return sizes


@functools.lru_cache(maxsize=2)
def pieces(name: str = DEFAULT, path: str | None = None):
    """The bytes of each id's piece, in order of the ids, and an empty piece at the end."""
    import pyarrow as pa

    known = {i: piece for piece, i in ranks(name, path).items()}
    return pa.array([known.get(i, b"") for i in range(max(known) + 1)] + [b""], pa.large_binary())
