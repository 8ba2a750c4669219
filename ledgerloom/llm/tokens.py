"""Token ids of public vocabularies inside tasks."""

from __future__ import annotations

import public_tokenizers

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the rank form of byte_bpe_50k.json: the same ids, encoded faster


def encoder(path: str = RANKS):
    """A tiktoken encoding of a rank file, without special tokens."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(coder, text: str | None):
    """Ids of a whole text as a uint32 array; a null text is empty."""
    return coder.encode_to_numpy(text or "", allowed_special=set(), disallowed_special=())
