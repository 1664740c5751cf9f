"""Record predicates: every condition that is set has to hold."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fillgap.functions.intervals import overlaps
from fillgap.schema import ATTRIBUTE_COLUMNS


@dataclass(frozen=True)
class NetPredicate:
    """Conditions on a record. A condition on an attribute fails for records without it; limits are inclusive."""

    kinds: Iterable[str] | None = None
    query_names: Iterable[str] | None = None
    strand: str | None = None
    min_depth: int | None = None
    max_depth: int | None = None
    min_reference_size: int | None = None
    max_reference_size: int | None = None
    reference_overlap: tuple[int, int] | None = None
    chain_ids: Iterable[int] | None = None
    types: Iterable[str] | None = None
    min_score: float | None = None
    max_score: float | None = None
    min_ali: int | None = None
    max_ali: int | None = None
    require_attributes: Iterable[str] = ()
    forbid_attributes: Iterable[str] = ()

    def matches(self) -> Column:
        c, found = F.col, []
        if self.kinds is not None:
            found.append(c("kind").isin(*self.kinds))
        if self.query_names is not None:
            found.append(c("query_name").isin(*self.query_names))
        if self.strand is not None:
            found.append(c("query_strand") == self.strand)
        limits = [
            ("depth", self.min_depth, self.max_depth), ("reference_size", self.min_reference_size, self.max_reference_size),
            ("alignment_score", self.min_score, self.max_score), ("aligned_bases", self.min_ali, self.max_ali),
        ]
        for name, low, high in limits:
            if low is not None:
                found.append(F.coalesce(c(name) >= low, F.lit(False)))
            if high is not None:
                found.append(F.coalesce(c(name) <= high, F.lit(False)))
        if self.reference_overlap is not None:
            start, end = (F.lit(x) for x in self.reference_overlap)
            found.append(overlaps(c("reference_start"), c("reference_end"), start, end))
        if self.chain_ids is not None:
            found.append(F.coalesce(c("chain_id").isin(*self.chain_ids), F.lit(False)))
        if self.types is not None:
            found.append(F.coalesce(c("net_type").isin(*self.types), F.lit(False)))
        found += [c(a).isNotNull() for a in self.require_attributes] + [c(a).isNull() for a in self.forbid_attributes]
        return reduce(lambda a, b: a & b, found, F.lit(True))


def presence_count() -> Column:
    """How many documented attributes a record has."""
    return reduce(lambda a, b: a + b, [F.col(a).isNotNull().cast("int") for a in ATTRIBUTE_COLUMNS])


def presence_mask() -> Column:
    """A bit for each documented attribute that a record has, in the order in which they are written."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.col(a).isNotNull().cast("int") * (1 << i) for i, a in enumerate(ATTRIBUTE_COLUMNS)])


def parse_region(text: str, ordered: bool = True) -> tuple[int, int]:
    """START-END; with ``ordered`` an end before the start is refused."""
    start, _, end = text.partition("-")
    if not (start.isascii() and start.isdigit() and end.isascii() and end.isdigit()):
        raise ValueError(f"region {text!r} is not START-END")
    if ordered and int(end) < int(start):
        raise ValueError(f"region {text!r} ends before it starts")
    return int(start), int(end)
