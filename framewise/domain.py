"""Ordered value domains: sites, categories and their labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Domain:
    """Levels in display order, with long and short category labels.

    ``excluded_items`` are study equipment that some reports leave out; ``prefixes``
    are the fragments stripped once from an item before it is shown.
    """

    sites: tuple[str, ...]
    categories: tuple[str, ...]
    labels: tuple[str, ...] = ()
    short_labels: tuple[str, ...] = ()
    excluded_items: tuple[str, ...] = ()
    strip: tuple[str, ...] = ()

    def label(self, category: Column, short: bool = False) -> Column:
        """Display label of a category; NULL outside the domain."""
        names = (self.short_labels if short else self.labels) or self.categories
        lookup = F.create_map(*[F.lit(x) for pair in zip(self.categories, names) for x in pair])
        return F.try_element_at(lookup, category)

    def explode_categories(self) -> Column:
        """The category domain as a generator column (a dimension without a join)."""
        return F.explode(F.array(*[F.lit(c) for c in self.categories]))


def ordinal(value: Column, levels: tuple[str, ...]) -> Column:
    """1-based position of ``value`` in ``levels``; NULL outside the domain."""
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), value)
    return F.nullif(position, F.lit(0)).cast("long")


# Fixed values of the published coding scheme (display order).
FIELD_DOMAIN = Domain(
    sites=("Tseltal", "Rossel"),
    categories=(
        "Consumable",
        "Synthetic",
        "Natural",
        "Toy",
        "Mealtime Tool",
        "Clothing",
        "Immovable",
        "Work Tool",
    ),
    labels=(
        "Consumable",
        "Synthetic",
        "Natural",
        "Toy",
        "Tool-M",
        "Clothing",
        "Immovable",
        "Tool-W",
    ),
    short_labels=("C", "S", "N", "T", "M", "CL", "I", "W"),
    excluded_items=("camera", "vest", "camera cover"),
    strip=("-M", "-W", "empty drink "),
)
