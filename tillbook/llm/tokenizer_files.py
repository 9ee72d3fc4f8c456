"""Where the public vocabularies lie on a machine, and the per-process cache of loaded ones.

Operators take a path; ``public(name)`` gives the installed package's.  Executors load a file once per Python
worker."""

from __future__ import annotations

import functools

from tokenizers import Tokenizer


def public(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow
    from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """A dictionary that computes missing values and remembers up to ``limit`` of them, so memory stays bounded
    whatever the number of distinct keys.  When full it keeps what it has; after as many misses again it starts
    anew, so that it follows a change in the data.  Text keys over ``longest`` characters are not remembered."""

    def __init__(self, compute, limit: int = 400_000, longest: int | None = None):
        super().__init__()
        self.compute, self.limit, self.longest, self.missed = compute, limit, longest, 0

    def __missing__(self, key):
        value = self.compute(key)
        if self.longest and len(key) > self.longest:
            return value
        if len(self) >= self.limit:
            self.missed += 1
            if self.missed < self.limit:
                return value
            self.clear()
            self.missed = 0
        self[key] = value
        return value
