"""Rounding that two engines agree on."""


def nudge(digits: int) -> float:
    """A shift far below the rounding step. Exact ties such as 0.5301805 at six digits come
    out of different engines an ulp above or below the tie; shifted, both round up."""
    return float(f"1.3e-{digits + 3}")
