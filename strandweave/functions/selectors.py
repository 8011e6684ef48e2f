"""The target selector: ``key=i,j:other=k::reduce_type=min,min=2`` to a boolean column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import gather, positive, reduce_flags


@dataclass
class Selection:
    """Which elements of which array columns, and how to reduce them."""

    targets: list[tuple[str, list[int]]]
    options: dict[str, str] = field(default_factory=dict)

    def array(self) -> Column:
        """All chosen elements as one array."""
        return F.concat(*[gather(F.col(key), places) if places else F.col(key) for key, places in self.targets])

    def condition(self) -> Column:
        how = self.options.get("reduce_type", "any")
        least = self.options.get(how)
        return reduce_flags(positive(self.array()), how, None if least is None else int(least))


def parse_selection(text: str) -> Selection:
    chosen, _, rest = text.partition("::")
    targets = []
    for part in filter(None, chosen.split(":")):
        key, _, places = part.partition("=")
        targets.append((key.strip(), [int(p) for p in places.split(",") if p]))
    options = dict(x.split("=", 1) for x in rest.split(",") if "=" in x)
    return Selection(targets, {k.strip(): v.strip() for k, v in options.items()})
