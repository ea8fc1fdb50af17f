"""Templates: constant bases and runs of ``-`` for variable regions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from seqtally.functions.bases import reverse_complement_text
from seqtally.schema import Strand


@dataclass(frozen=True)
class Template:
    text: str
    strand: Strand = Strand.FORWARD
    max_size: int | None = None

    def __post_init__(self):
        if self.max_size is not None and len(self.text) > self.max_size:
            raise ValueError(f"maximum template size should be {self.max_size} bp")
        for c in self.text.upper():
            if c not in "ACGT-":
                raise ValueError(f"cannot complement unknown base '{c}'" if self.strand is Strand.REVERSE else f"unknown base '{c}'")

    def __len__(self) -> int:
        return len(self.text)

    @cached_property
    def regions(self) -> list[tuple[int, int]]:
        """[start, end) of each variable region, in order."""
        out: list[tuple[int, int]] = []
        for i, c in enumerate(self.text):
            if c == "-":
                if out and out[-1][1] == i:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i, i + 1))
        return out

    @cached_property
    def reverse_regions(self) -> list[tuple[int, int]]:
        n = len(self)
        return [(n - e, n - s) for s, e in reversed(self.regions)]

    def constants(self, reverse: bool = False) -> list[tuple[int, str]]:
        """(offset, base) of the constant bases as they stand in a read."""
        text = reverse_complement_text(self.text) if reverse else self.text.upper()
        return [(i, c) for i, c in enumerate(text) if c != "-"]

    def segments(self, reverse: bool = False) -> list[tuple[int, str]]:
        """(offset, bases) of the runs of constant bases."""
        out: list[tuple[int, str]] = []
        for i, c in self.constants(reverse):
            if out and out[-1][0] + len(out[-1][1]) == i:
                out[-1] = (out[-1][0], out[-1][1] + c)
            else:
                out.append((i, c))
        return out
