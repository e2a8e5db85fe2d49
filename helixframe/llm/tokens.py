"""Token ids of texts, by the public byte-level BPE vocabulary. The vocabulary's path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Split pattern and control token of the byte_bpe_50k vocabulary: fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTROL = {"<|endoftext|>": 50256}


def default_vocabulary() -> str:
    """The ranks of byte_bpe_50k.json: the same vocabulary, for a library that is several times as fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=CONTROL)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """uint32 ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them; null counts as empty.

    As there, a control token's string inside a text becomes that token. Tests hold the two libraries against each other
    over a whole table of documents.
    """
    return np.asarray(_encoding(path).encode_to_numpy(text, allowed_special="all"), np.uint32) if text else np.zeros(0, np.uint32)
