"""Names of windows and of columns made for them."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

Bound = float | int | None


def validate_windows(windows: Sequence) -> list[tuple[int | None, int | None]]:
    """Windows (lower, upper) in days; one window alone is a list of one. None and infinities are unbounded."""
    if len(windows) == 2 and not any(isinstance(w, list | tuple) for w in windows):
        windows = [windows]
    out = []
    for w in windows:
        if len(w) != 2:
            raise ValueError(f"not a pair of days: {w}")
        lo, hi = (None if b is None or math.isinf(b) else int(b) for b in w)
        if (lo is not None and hi is not None and lo > hi) or w[0] == math.inf or w[1] == -math.inf:
            raise ValueError(f"a window that ends before it begins: {w}")
        out.append((lo, hi))
    return out


def window_name(window: tuple[Bound, Bound]) -> str:
    """0_to_inf, m365_to_m1, minf_to_inf."""
    lo, hi = validate_windows([window])[0]
    part = lambda b, open_: open_ if b is None else f"m{-b}" if b < 0 else str(b)
    return f"{part(lo, 'minf')}_to_{part(hi, 'inf')}"


def format_name_style(template: str, **values: str) -> str:
    """The template with its {names} filled, in snake case."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", str(value))
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+|[0-9]+", re.sub(r"[^A-Za-z0-9]+", " ", template))
    return "_".join(w.lower() for w in words)
