"""Bounds of settings, declared as intervals."""

from __future__ import annotations


def within(settings: object, **bounds: str) -> None:
    """Refuse a setting outside its interval: ``within(self, rate="[0, 1)", size="(0,")``.

    A missing upper bound is written by leaving it out; a setting of None is not looked at.
    """
    for name, interval in bounds.items():
        value = getattr(settings, name)
        if value is None:
            continue
        low, _, high = interval[1:].rstrip("])").partition(",")
        below = value <= float(low) if interval[0] == "(" else value < float(low)
        above = bool(high.strip()) and (value > float(high) if interval.endswith("]") else value >= float(high))
        if below or above or value != value:
            raise ValueError(f"{type(settings).__name__}: {name}={value!r} lies outside {interval}")
