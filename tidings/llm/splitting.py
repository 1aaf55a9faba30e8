"""Pre-tokens of byte-level vocabularies, and a bounded memory for what they encode to."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import public_tokenizers
import regex

#: Texts whose characters are all below this (Latin, Greek, Cyrillic) are split by a plain
#: pattern with these characters spelled out, at twice the speed.
SIMPLE_BELOW = 0x530


def _ranges(wanted: Callable[[str], bool]) -> str:
    return "".join(re.escape(c) for c in map(chr, range(SIMPLE_BELOW)) if wanted(c))


def simple_pattern() -> re.Pattern:
    """The public splitting pattern, its classes spelled out below ``SIMPLE_BELOW``."""
    letters = _ranges(lambda c: unicodedata.category(c)[0] == "L")
    numbers = _ranges(lambda c: unicodedata.category(c)[0] == "N")
    spaces = " \t\n\r\x0b\x0c\x85\xa0"
    return re.compile(
        f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+"
        f"| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


class Splitter:
    """Splits a text by the simple pattern where that is proved to be the same.

    ``exact`` is the split to agree with. Every character below ``SIMPLE_BELOW`` is tried
    in several surroundings; texts with a character that differs, or any other, go to
    ``exact`` itself.
    """

    def __init__(self, exact: Callable[[str], list[str]]):
        self.exact, self.simple = exact, simple_pattern()
        differing = "".join(
            re.escape(c)
            for c in map(chr, range(SIMPLE_BELOW))
            if any(self.simple.findall(p) != exact(p) for p in _probes(c))
        )
        self.other = re.compile(
            f"[^\x00-{chr(SIMPLE_BELOW - 1)}]" + (f"|[{differing}]" if differing else "")
        )

    def __call__(self, text: str) -> list[str]:
        if self.other.search(text):
            return self.exact(text)
        return self.simple.findall(text)


def _probes(c: str) -> tuple[str, ...]:
    return (f"a{c}1{c}!{c}  b", f" {c}{c} {c}", f"'{c}\n{c}  {c}", f"{c}'s{c}")


def public_split() -> Splitter:
    return Splitter(regex.compile(public_tokenizers.PATTERN).findall)


class Memory(dict):
    """Computed values in two generations, so that the memory of a worker is bounded.

    Once ``most`` values are new, they become the old generation and what was old and not
    asked for again is forgotten. Forgetting costs time only: values are computed anew.
    """

    def __init__(self, compute: Callable, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def turn(self) -> None:
        """Start a new generation if the present one is full."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
