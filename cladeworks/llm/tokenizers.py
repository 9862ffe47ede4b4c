"""Token counts and cuts by a public tokenizer file; its path is a parameter."""

from __future__ import annotations

import base64
import functools

#: How the ranks file named below splits text before merging (fixed value, published with that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@functools.cache
def encoding(path: str):
    """The tiktoken encoding of a ranks file, made once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(path: str, texts: list[str | None]) -> list[int]:
    encode = encoding(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]
