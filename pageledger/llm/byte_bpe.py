"""Token ids of whole texts under a byte-level BPE vocabulary, as its ``tokenizers`` file gives them.

The merges are read from the rank file, which holds the same vocabulary.  Tokens that the ``tokenizers`` file adds to it, as the one that
ends a text, are found in a text before it is split, wherever their strings stand.
"""

from __future__ import annotations

import base64
import json

import public_tokenizers
import tiktoken

RANKS, ADDED = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


class Encoder:
    def __init__(self, ranks: str | None = None, added: str | None = None):
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        with open(added or public_tokenizers.path(ADDED), encoding="utf-8") as file:
            special = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(ranks: str | None = None) -> Encoder:
    """This worker's encoder, built once."""
    if ranks not in _ENCODERS:
        _ENCODERS[ranks] = Encoder(ranks)
    return _ENCODERS[ranks]
