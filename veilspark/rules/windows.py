"""How near a component must be: `80`, `200C`, `5L`, `7L,200C`, `-2L,+3L`, or nothing for anywhere."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import RuleError


@dataclass(frozen=True)
class Window:
    """Lines and columns before and after a match; None where there is no limit. Columns without lines are bytes."""

    lines: tuple[int, int] | None = None
    columns: tuple[int, int] | None = None

    def holds(self, primary, component, size: int) -> bool:
        """Whether a component match begins inside the window around a primary match in a value of size bytes."""
        if self.lines is None:
            if self.columns is None:
                return True
            before, after = self.columns
            return max(primary.start - before, 0) <= component.start < min(primary.end + after, size)
        up, down = self.lines
        if not primary.line - up <= component.line <= primary.last_line + down:
            return False
        before, after = self.columns or (0, 0)
        if primary.line == primary.last_line and (before or after):
            width = primary.end - primary.start
            return max(primary.column - before, 0) <= component.column < primary.column + width + after
        return True


def parse(text: str) -> Window:
    """A number alone is columns; `-` sets the part before the match, `+` the part after it, neither both; of several
    the widest holds. A match's own line counts, so NL reaches N - 1 lines away."""
    if text.strip() in ("", "0"):
        return Window()
    reach: dict[tuple[str, str], list[int]] = {}
    for part in text.split(","):
        m = re.fullmatch(r"([+-]?)(\d+)([LlCc]?)", part.strip())
        if not m:
            raise RuleError(f"{text!r} is not a distance")
        unit = m[3].upper() or "C"
        far = int(m[2]) - (unit == "L" and m[2].strip("0") != "")
        for side in "-+" if not m[1] else m[1]:
            reach.setdefault((unit, side), []).append(far)
    limit = lambda unit: tuple(max(reach.get((unit, side), [0])) for side in "-+") if any(u == unit for u, _ in reach) else None
    return Window(limit("L"), limit("C"))
