"""The public byte-level vocabularies, loaded once per worker process from a folder given as a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Folder of the vocabulary files; a parameter of every operator that tokenizes.
TOKENIZERS = os.environ.get("WEFT_TOKENIZERS", "/opt/tokenizers")
#: The split pattern that goes with the rank files (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def ranks(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(folder, name), special_tokens={})
