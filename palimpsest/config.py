"""Parameters of matching."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchConfig:
    """Window sizes and limits.

    window: bytes of a verified match at least. posting: bytes of an indexed window, window - 6 by default.
    blank: a window with this many blank bytes or more says nothing and is left out (if exclude_blank).
    positions: a window that occurs more often than this in the longer of two documents is skipped there.
    results: associations of one query. strict: rank by runs of eight windows, as the original does; otherwise by
    runs of seven, which finds every match of `window` bytes. max_df: windows of more documents than this do not
    rank candidates; None for no limit. hash_width: fold the 32-bit hashes of the original to so many bits;
    None takes wide hashes, which tell all different windows apart but for chance.
    """

    window: int = 30
    posting: int | None = None
    blank: int | None = None
    exclude_blank: bool = True
    positions: int = 100
    results: int = 10
    strict: bool = True
    max_df: int | None = None
    hash_width: int | None = None
    page: int = 100

    def __post_init__(self) -> None:
        if self.window < 2:
            raise ValueError("window is too small")
        if self.hash_width is not None and not 16 <= self.hash_width <= 32:
            raise ValueError("hash_width must be from 16 to 32")

    @property
    def short(self) -> int:
        return self.window - 6 if self.posting is None else self.posting

    @property
    def threshold(self) -> int:
        return self.window // 2 if self.blank is None else self.blank
