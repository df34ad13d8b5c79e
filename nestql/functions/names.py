"""Short and safe names for flat results."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import count, product
from string import ascii_lowercase



def short() -> Iterator[str]:
    """a, b, ... z, aa, ab, ..."""
    for size in count(1):
        yield from map("".join, product(ascii_lowercase, repeat=size))


class Namespace:
    """Names for columns: readable or short, always unique. A name that is taken gets the next free number."""

    def __init__(self, minify: bool = False, prefix: str = ""):
        self.prefix, self.fresh = prefix, short() if minify else None
        self.taken: Counter[str] = Counter()

    def name(self, wish: str) -> str:
        stem = next(self.fresh) if self.fresh else re.sub(r"\W", "_", wish)
        found = stem
        while self.taken[found]:
            self.taken[stem] += 1
            found = f"{stem}_{self.taken[stem]}"
        self.taken[found] = 1
        return self.prefix + found
