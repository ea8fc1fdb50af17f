"""Options and result columns shared by all designs."""

from __future__ import annotations

from enum import Enum


class Strand(Enum):
    FORWARD = "forward"
    REVERSE = "reverse"
    BOTH = "both"

    @property
    def reversed_flags(self) -> tuple[bool, ...]:
        return {"forward": (False,), "reverse": (True,), "both": (False, True)}[self.value]


class Duplicates(Enum):
    """What an observed sequence gives that is equally near to several barcodes."""

    FIRST = "first"
    LAST = "last"
    NONE = "none"
    ERROR = "error"


OK, AMBIGUOUS = "OK", "AMBIGUOUS"
