"""Byte-level BPE token ids from the public vocabulary files, for Arrow batches.

The ``.tiktoken`` file holds the vocabulary of the ``.json`` file as ranks; its library
gives the same ids several times faster (``tests/llm`` compares them). Ids are kept in 16
bits (``ID``), so a vocabulary with larger ones is refused.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

END = "<|endoftext|>"
ID = np.dtype("<u2")


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str, end_id: int):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(end_id, *ranks.values()) > np.iinfo(ID).max:
        raise ValueError(f"{path} has ids of more than 16 bits")
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END: end_id})


def vocabulary(name: str = "byte_bpe_50k.json") -> tuple[str, str, int]:
    """What ``encoder`` needs: the ranks' file, the pattern and the id of ``END``."""
    import public_tokenizers

    return public_tokenizers.path(name.replace(".json", ".tiktoken")), public_tokenizers.PATTERN, 50256


def encoder(vocab: tuple[str, str, int], special: bool = True):
    """A function from a text (or None) to its ids; with ``special``, ``END`` in a text is its own id."""
    e = _encoding(*vocab)
    if special:
        return lambda t: e.encode_to_numpy(t or "", allowed_special="all")
    return lambda t: e.encode_to_numpy(t or "", allowed_special=set(), disallowed_special=())

