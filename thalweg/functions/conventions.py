"""Codings of flow direction, capacities and the texts of views: plain Python over a few parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

# The codes of E, SE, S, SW, W, NW, N, NE in each producer's coding, and its sink, nodata and mouth.
DIRECTIONS = ("E", "SE", "S", "SW", "W", "NW", "N", "NE")
OURS = (1, 2, 4, 8, 16, 32, 64, 128)
CODE_LIMIT = 65535


@dataclass(frozen=True)
class Convention:
    codes: tuple[int, ...]
    sink: int | None = None
    nodata: int | None = None
    mouth: int | None = None

    def to_ours(self) -> dict[int, int]:
        return dict(zip(self.codes, OURS))


CONVENTIONS = {
    "merit": Convention(OURS, 255, 247, 0),
    "esri": Convention(OURS, None, 255, 0),
    "hydrosheds": Convention(OURS, 0, 255, None),
    "taudem": Convention((1, 8, 7, 6, 5, 4, 3, 2), None, 0, None),
    "grass": Convention((8, 7, 6, 5, 4, 3, 2, 1), None, 0, None),
    "degrees": Convention((360, 315, 270, 225, 180, 135, 90, 45), None, 0, None),
}


def convention(name: str, codes: str | None = None, sink: int | None = None, nodata: int | None = None, mouth: int | None = None) -> Convention:
    """A coding by name, or "custom" with codes as E=1,SE=2,...; what is given besides overrides it. Refuses codings that are
    incomplete, out of range or ambiguous."""
    if name != "custom" and name not in CONVENTIONS:
        raise ValueError(f"unknown coding {name!r}: not custom nor one of {', '.join(sorted(CONVENTIONS))}")
    base = CONVENTIONS.get(name, Convention(()))
    known = dict(zip(DIRECTIONS, base.codes))
    for item in filter(str.strip, (codes or "").replace(";", ",").split(",")):
        at, _, value = (x.strip() for x in item.partition("="))
        if at.upper() not in DIRECTIONS or not value.isdigit():
            raise ValueError(f"{item!r} does not read like E=1")
        known[at.upper()] = int(value)
    if len(known) != len(DIRECTIONS):
        raise ValueError(f"{name}: a code is missing for {', '.join(d for d in DIRECTIONS if d not in known)}")
    others = {k: v for k, v in (("sink", sink), ("nodata", nodata), ("mouth", mouth)) if v is not None}
    made = replace(base, codes=tuple(known[d] for d in DIRECTIONS), **others)
    if made.nodata is None:
        raise ValueError(f"{name}: a nodata value is needed")
    values = [*made.codes, *(x for x in (made.sink, made.nodata, made.mouth) if x is not None)]
    if not all(0 <= x <= CODE_LIMIT for x in values) or len(set(values)) != len(values):
        raise ValueError(f"{name}: values are not distinct and between 0 and {CODE_LIMIT}: {values}")
    return made


def top_blocks(side: int) -> int:
    """The blocks of side x side pixels in 2^31 - 1, cut to two significant digits."""
    whole = str((2**31 - 1) // side**2)
    return int(whole[:2].ljust(len(whole), "0"))


def capacity_blocks(text: str, side: int) -> int:
    """A capacity as blocks: 2^20 to 2^40, where 2^31 is top_blocks and its neighbours half or double, or 160, 160deg2, 160blocks."""
    if text.startswith("2^"):
        if not 20 <= (power := int(text[2:])) <= 40:
            raise ValueError(f"{text} is not between 2^20 and 2^40")
        if not (blocks := int(top_blocks(side) * 2.0 ** (power - 31))):
            raise ValueError(f"{text} is less than one block of {side} pixels")
        return blocks
    number = text.removesuffix("deg2").removesuffix("blocks")
    if not number.isdigit() or not int(number):
        raise ValueError(f"{text} is neither 2^k nor a number of blocks")
    return int(number)


def least_basin_km2(side_km: float, height_km: float | None = None) -> float:
    """A quarter of a cell, half up to four decimals; below 0.01 km2 to four significant digits."""
    quarter = Decimal(str(side_km)) * Decimal(str(height_km or side_km)) / 4
    digits = 4 if quarter >= Decimal("0.01") or quarter <= 0 else 3 - quarter.adjusted()
    return float(quarter.quantize(Decimal(10) ** -digits, ROUND_HALF_UP))


def area_text(km2: float) -> str:
    return f"{km2:.4f}" if km2 >= 0.01 else f"{km2:.4g}"
