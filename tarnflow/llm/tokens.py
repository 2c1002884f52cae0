"""Byte-level BPE token ids, with character offsets where asked for.

The tokenizer file (its path is a parameter) is a `tokenizers` JSON.  The ids
are those of `tokenizers`; most texts get them from `tiktoken`, built from the
same file's vocabulary, which is three times as fast and gives the same ids
(the tests compare them).  Texts that hold a special token's string, or are
longer than `LONG` characters, go through `tokenizers` itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

# Fixed value: how this family of byte-level vocabularies cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_symbols() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class ByteBpe:
    """Ids and byte lengths for one tokenizer file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        symbols = _bytes_of_symbols()
        special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        tokens = {bytes(symbols[c] for c in k): v for k, v in data["model"]["vocab"].items() if k not in special}
        self.special = tuple(special)
        self.slow = Tokenizer.from_file(path)
        self.slow.no_padding()
        self.slow.no_truncation()
        self.fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={})
        self.lengths = np.zeros(1 + max([*tokens.values(), *special.values()]), np.int64)
        for k, v in tokens.items():
            self.lengths[v] = len(k)
        for k, v in special.items():
            self.lengths[v] = len(k.encode())

    def encode(self, text: str) -> list[int]:
        if len(text) > LONG or any(x in text for x in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and each token's first and past-last character.

        A token that holds only part of a character's bytes counts as touching
        that whole character.
        """
        ids = np.array(self.encode(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        raw = np.frombuffer(text.encode(), np.uint8)
        # Character of each byte: bytes of the form 10xxxxxx continue one.
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        if not len(ids):
            return ids, ends, ends
        first = char[ends - self.lengths[ids]]
        last = char[ends - 1] + 1
        return ids, first, last


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBpe:
    """One per process and file."""
    return ByteBpe(path)
