"""Zoom ranges (O-S8)."""

from __future__ import annotations

from collections.abc import Iterable

from tilepyramid.constants import RESOLUTIONS


def parse_zoom_range(text: str) -> list[int]:
    """``"z1-z2"`` to the levels from high to low; anything else is a ``ValueError``."""
    parts = text.split("-")
    if len(parts) != 2:
        raise ValueError("zoom range must be like 'z1-z2'")
    try:
        low, high = (int(p) for p in parts)
    except ValueError:
        raise ValueError("zoom range needs two integers like 'z1-z2'") from None
    if low > high:
        raise ValueError("z1 must not be greater than z2")
    return check_zooms(range(high, low - 1, -1))


def check_zooms(zooms: str | Iterable[int]) -> list[int]:
    """Accept a range string or levels; every level must have a resolution."""
    if isinstance(zooms, str):
        return parse_zoom_range(zooms)
    levels = sorted(set(zooms), reverse=True)
    if not levels:
        raise ValueError("no zoom level given")
    bad = [z for z in levels if not 0 <= z < len(RESOLUTIONS)]
    if bad:
        raise ValueError(f"zoom levels must be in 0-{len(RESOLUTIONS) - 1}, got {bad}")
    return levels
