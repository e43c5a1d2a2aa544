"""Attributes of one's own: a rule names what is summed along paths and over catchments, and the value made of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.operators.flow import fold


@dataclass(frozen=True)
class Attribute:
    """along, above: names to columns of the links (see flow.fold); value: over those names, pix, root and hops; nodata
    stands for a null value. on_channels: the network only, where the links' channel is 1."""

    code: str
    value: Callable[[], Column]
    along: dict[str, str] = field(default_factory=dict)
    above: dict[str, str] = field(default_factory=dict)
    longest: str | None = None
    type: str = "long"
    nodata: int | float | None = None
    on_channels: bool = False


REGISTERED: dict[str, Attribute] = {}


def register(attribute: Attribute) -> None:
    """Refuses a code that another rule has."""
    if REGISTERED.get(attribute.code, attribute) != attribute:
        raise ValueError(f"{attribute.code} is registered already")
    REGISTERED[attribute.code] = attribute


def derive(code: str, flow: DataFrame, closure: Callable[..., DataFrame] = fold) -> DataFrame:
    """(pix, root, value) of every pixel of flow, or of its channels."""
    a = REGISTERED[code]
    folded = closure(flow.where("channel = 1") if a.on_channels else flow, a.along, a.above, a.longest)
    value = a.value().cast(a.type)
    return folded.select("pix", "root", (value if a.nodata is None else F.coalesce(value, F.lit(a.nodata).cast(a.type))).alias("value"))


def by_basin(derived: DataFrame) -> DataFrame:
    """(root, pixels, least, greatest, at_outlet) of an attribute."""
    return derived.groupBy("root").agg(F.count("*").alias("pixels"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.max(F.when(F.col("pix") == F.col("root"), F.col("value"))).alias("at_outlet"))
