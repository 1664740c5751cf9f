"""Structural validation of nets: one row an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgap.functions.intervals import overlaps
from fillgap.operators.scan import Parts
from fillgap.operators.tree import with_parent, with_sibling
from fillgap.schema import TREE

#: Severity by rule group and mode; None: not checked.
SEVERITY = {
    "structural": {"syntax": None, "compatible": "warning", "strict": "error"},
    "bounds": {"syntax": "warning", "compatible": "error", "strict": "error"},
    "zero": {"syntax": "warning", "compatible": "warning", "strict": "error"},
}

#: Attributes that count bases and so can't be negative.
COUNTS = [
    "reference_unsequenced", "query_unsequenced", "reference_masked", "query_masked", "reference_new_masked",
    "query_new_masked", "reference_old_masked", "query_old_masked", "reference_tandem", "query_tandem",
]

#: Rules in the order in which a record meets them: number, code, group.
RULES = (
    (1, "reference-out-of-bounds", "bounds"),
    (2, "zero-sized-record", "zero"),
    (3, "child-outside-parent", "structural"),
    (4, "fill-gap-alternation", "structural"),
    (5, "missing-fill-id", "structural"),
    (6, "gap-has-id", "structural"),
    (7, "negative-count", "structural"),
    (8, "sibling-order", "structural"),
    (9, "sibling-overlap", "structural"),
)


def _with_parent_range(records: DataFrame, max_depth: int | None, parts: Parts | None) -> DataFrame:
    """Adds the parent's interval."""
    return with_parent(records, {"reference_start": "parent_start", "reference_end": "parent_end"}, max_depth, parts)


def _with_previous_sibling(records: DataFrame, parts: Parts | None, tops: DataFrame | None, max_depth: int | None) -> DataFrame:
    return with_sibling(records, {"reference_start": "before_start", "reference_end": "before_end", "reference_size": "before_size"}, parts=parts, tops=tops, max_depth=max_depth)


def issues(records: DataFrame, sections: DataFrame, mode: str = "compatible", parts: Parts | None = None, max_depth: int | None = None, tops: DataFrame | None = None) -> DataFrame:
    """severity, code, net_id, pos, detail (the attribute of a negative count, else ''), and the order of discovery (anchor, rule).

    records need pos, parent and their attributes; sections net_id and section_size. ``anchor`` is the record at which a
    walk of the tree finds the issue: the record itself, or for siblings their parent, -1 for roots. ``tops`` are the roots
    among the records, where they are at hand without them.
    """
    needed = [*TREE, "pos", "depth", "parent", "kind", "reference_start", "reference_end", "reference_size", "chain_id", *COUNTS, *[c for c in ("subtree_end",) if c in records.columns]]
    records, size = records.select(*needed), sections.select("net_id", "section_size")
    if tops is not None:  # roots have no parent
        tops = tops.select(*needed, *[F.lit(None).cast("long").alias(c) for c in ("parent_start", "parent_end")])
    rows = _with_previous_sibling(_with_parent_range(records, max_depth, parts), parts, tops, max_depth).join(F.broadcast(size) if size.count() <= 1_000_000 else size, "net_id")
    c = F.col
    fill = c("kind") == "fill"
    tests: dict[str, Column] = {
        "reference-out-of-bounds": (c("reference_size") != 0) & (c("reference_end") > c("section_size")),
        "zero-sized-record": c("reference_size") == 0,
        "child-outside-parent": (c("reference_start") < c("parent_start")) | (c("reference_end") > c("parent_end")),
        "fill-gap-alternation": fill != (c("depth") % 2 == 0),
        "missing-fill-id": fill & c("chain_id").isNull(),
        "gap-has-id": ~fill & c("chain_id").isNotNull(),
        "sibling-order": c("reference_start") < c("before_start"),
        "sibling-overlap": (c("reference_size") != 0) & (c("before_size") != 0) & overlaps(c("reference_start"), c("reference_end"), c("before_start"), c("before_end")),
    }
    found = []
    for rule, code, group in RULES:
        severity = SEVERITY[group][mode]
        if severity is None:
            continue
        anchor = F.coalesce(c("parent"), F.lit(-1)) if rule >= 8 else c("pos")
        at = [F.lit(severity).alias("severity"), F.lit(code).alias("code"), anchor.alias("anchor"), F.lit(rule).alias("rule")]
        if code == "negative-count":
            found += [(c(a) < 0, F.struct(*at, F.lit(a).alias("detail"))) for a in COUNTS]
        else:
            found.append((tests[code], F.struct(*at, F.lit("").alias("detail"))))
    # All rules are columns of one pass; only issues become rows. Joined arrays stay in compiled code, a filter of one doesn't.
    none = F.array().cast("array<struct<severity:string,code:string,anchor:bigint,rule:int,detail:string>>")
    out = rows.select("net_id", "pos", F.explode(F.concat(*[F.when(test, F.array(issue)).otherwise(none) for test, issue in found])).alias("i"))
    return out.select("i.severity", "i.code", "net_id", "pos", "i.detail", "i.anchor", "i.rule")


#: What each code says.
MESSAGES = {
    "reference-out-of-bounds": "ends behind its section",
    "zero-sized-record": "has no reference positions",
    "child-outside-parent": "reaches out of its parent",
    "fill-gap-alternation": "is of the kind that its depth does not have",
    "missing-fill-id": "is a fill without a chain id",
    "gap-has-id": "is a gap with a chain id",
    "negative-count": "counts less than nothing",
    "sibling-order": "starts before the sibling above it",
    "sibling-overlap": "overlaps the sibling above it",
}


def report_lines(found: DataFrame, tsv: bool = True) -> DataFrame:
    """A line of text for each issue, with its place in the order of discovery (net_id, anchor, rule, pos)."""
    says = F.element_at(F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair]), F.col("code"))
    says = F.when(F.col("detail") != "", F.concat("detail", F.lit(" "), says)).otherwise(says)
    if tsv:
        line = F.concat_ws("\t", "severity", "code", F.col("net_id").cast("string"), F.col("pos").cast("string"), says)
    else:
        line = F.concat(F.lit("["), F.initcap("severity"), F.lit("] "), "code", F.lit(" (net "), F.col("net_id").cast("string"), F.lit(", node "), F.col("pos").cast("string"), F.lit("): "), says)
    return found.select("net_id", "anchor", "rule", "pos", line.alias("line"))


def totals(found: DataFrame) -> tuple[int, int]:
    """How many errors and how many warnings."""
    n = {r["severity"]: r["n"] for r in found.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    return n.get("error", 0), n.get("warning", 0)


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("issues"))


def require_valid(records: DataFrame, sections: DataFrame, mode: str = "compatible") -> DataFrame:
    """The records themselves; an error at run time if any issue is an error."""
    errors = issues(records, sections, mode).where("severity = 'error'").agg(F.count(F.lit(1)).alias("n"))
    bad = errors.first()["n"]
    if bad:
        raise ValueError(f"{bad} validation errors")
    return records


def exit_status(found: DataFrame, warnings_fail: bool = False) -> int:
    errors, warnings = totals(found)
    return int(errors > 0 or warnings_fail and warnings > 0)
