"""Token counts by a public tokenizer. The vocabulary file's path is a parameter."""

from __future__ import annotations

import base64
import os

TOKENIZER = os.environ.get("ATLASPARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern that the 50k byte-level vocabulary belongs to.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a rank file, loaded once per Python worker."""
    import tiktoken

    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def encode(text: str | None, path: str = TOKENIZER) -> list[int]:
    """The token ids of a whole text; none for null. Lone surrogates count as replacement characters."""
    if not text:
        return []
    try:
        return encoding(path).encode_ordinary(text)
    except UnicodeEncodeError:
        return encoding(path).encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
