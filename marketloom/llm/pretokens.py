"""Cutting texts into pieces that a byte-level BPE tokenizer treats on their own."""

from __future__ import annotations

import re

#: Fixed value: the special string of byte_bpe_50k.json, one token wherever it stands.
SPECIAL = "<|endoftext|>"
#: Fixed value: the pre-token pattern of byte_bpe_50k.json.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def blanks(text: str) -> list[str] | None:
    """``text`` cut before single spaces, or None where that could change its tokens.

    A pre-token takes at most the one space before it, so a cut before a space is harmless
    if what stands before or after the space isn't white space. Texts with runs of white
    space that such a cut would divide, rare white space or the special string give None.
    """
    if "  " in text or "\n \n" in text or text[-1:] == " " or text[:2] == " \n" or SPECIAL in text or _RARE.search(text):
        return None
    first, *rest = text.split(" ")
    out = [" " + x for x in rest]
    if first:
        out.insert(0, first)
    return out


class Bounded(dict):
    """A cache that empties itself rather than grow beyond ``most`` entries."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def room(self) -> None:
        if len(self) > self.most:
            self.clear()
