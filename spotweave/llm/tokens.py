"""Token ids of documents inside tasks.

The vocabulary file is a parameter. Words seen before come from a bounded
cache; all new words of a slice are encoded in one call, because no token
crosses a space that a character other than white space follows. Texts with
other spaces are encoded as a whole. The ids equal those of the ``tokenizers`` library
with the same vocabulary (tested).
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np

#: Words that one task keeps at most; later words are encoded again in each slice.
CACHE_WORDS = 1 << 18
#: Fixed value: the special token of the vocabulary, read in a text as one id.
SPECIAL = "<|endoftext|>"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str | None = None, cache_words: int = CACHE_WORDS) -> Callable[[list[str | None]], list[bytes]]:
    """Function from texts to their ids as little-endian unsigned 32-bit integers; null is an empty text."""
    import public_tokenizers
    import tiktoken

    with open(path or default_ranks(), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special = np.array([len(ranks)], "<u4").tobytes()
    length = np.zeros(len(ranks), np.int64)
    for token, rank in ranks.items():
        length[rank] = len(token)
    bpe = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, bytes] = {}
    odd: set[str] = set()

    def plain(text: str) -> bytes:
        return bpe.encode_to_numpy(text).astype("<u4").tobytes()

    def learn(words: list[str]) -> dict[str, bytes]:
        """Ids of words that follow a space."""
        text = " " + " ".join(words)
        ids = bpe.encode_to_numpy(text).astype("<u4")
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
        cuts = 4 * (np.searchsorted(np.cumsum(length[ids]), ends) + 1)
        data, starts = ids.tobytes(), np.concatenate(([0], cuts[:-1]))
        return {w: data[a:b] for w, a, b in zip(words, starts.tolist(), cuts.tolist())}

    def segments(texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        new = {w for s in split for w in s[1:]} - known.keys()
        odd.update(w for w in new if not w or w[0].isspace())
        fresh = learn(list(new - odd)) if new - odd else {}
        room = cache_words - len(known)
        if room >= len(fresh):
            known.update(fresh)
        elif room > 0:
            known.update(list(fresh.items())[:room])
        seen = known if room >= len(fresh) else known | fresh
        return [
            plain(s[0]) + b"".join(map(seen.__getitem__, s[1:])) if odd.isdisjoint(s[1:]) else plain(t)
            for t, s in zip(texts, split)
        ]

    def encode(texts: list[str | None]) -> list[bytes]:
        parts = [(t or "").split(SPECIAL) for t in texts]
        ids = iter(segments([p for ps in parts for p in ps]))
        return [special.join([next(ids) for _ in ps]) for ps in parts]

    return encode
