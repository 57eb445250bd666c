"""Parameters of the formatter; constants of a query, never columns."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum


class ListSpacing(Enum):
    """How items of a list are set apart."""

    PRESERVE = "preserve"
    LOOSE = "loose"
    TIGHT = "tight"

    @classmethod
    def parse(cls, text: str) -> ListSpacing:
        """The value named by ``text`` in any case; ValueError for other names."""
        try:
            return cls(text.strip().lower())
        except ValueError:
            raise ValueError(f"list spacing must be preserve, loose or tight, not {text!r}") from None


@dataclass(frozen=True)
class FormatOptions:
    """Options of one formatting run.  ``width`` 0 means no limit."""

    width: int = 88
    plaintext: bool = False
    semantic: bool = False
    cleanups: bool = False
    smartquotes: bool = False
    ellipses: bool = False
    list_spacing: ListSpacing = ListSpacing.PRESERVE
    dedent: bool = False

    @classmethod
    def auto(cls, **given) -> FormatOptions:
        """The preset with sentence breaks, clean-ups and typography."""
        return replace(cls(semantic=True, cleanups=True, smartquotes=True, ellipses=True), **given)


#: A line shorter than this takes in the start of the next sentence.
SHORT_LINE = 20
