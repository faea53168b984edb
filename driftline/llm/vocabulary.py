"""Byte-level BPE vocabularies read from a public tokenizer file, cached in each worker."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level BPE files.

    Printable Latin-1 characters stand for themselves; the others get code points from 256 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, their merges in order, and the tokens that stand for control strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {to_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {(self.ids[to_bytes(a)], self.ids[to_bytes(b)]): (rank, self.ids[to_bytes(a + b)]) for rank, (a, b) in enumerate(pairs)}
        self.ranks = {a << 32 | b: rank for (a, b), (rank, _) in self.merges.items()}
        self.made = [made for _, made in self.merges.values()]  # by rank
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.longest = max(map(len, self.ids))


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def encoder(path: str, longest: int = 1 << 17):
    """A function from text to an array of unsigned 32-bit ids, as the tokenizers library gives them.

    tiktoken does the merging (ids are merge ranks in such a file).  Texts with a control string, and texts
    of more than ``longest`` characters, on whose runs its pattern could exhaust the stack, are read by
    the streaming encoder.
    """
    import public_tokenizers
    import tiktoken

    from driftline.llm.bpe import encode_packed

    vocabulary = load(path)
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={})
    special = tuple(vocabulary.special)

    def encode(text: str) -> np.ndarray:
        if len(text) > longest or any(s in text for s in special):
            return np.frombuffer(encode_packed(path, text), dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizers library's own tokenizer, without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def merge_rank_is_id(path: str) -> bool:
    """Whether ids rise in merge order, on which :func:`encoder` relies."""
    made = [i for _, i in load(path).merges.values()]
    return all(a < b for a, b in zip(made, made[1:]))
