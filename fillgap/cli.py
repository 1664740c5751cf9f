"""Commands over net files: filter, view, sort, merge, split, stats, validate, net."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable
from dataclasses import replace
from functools import reduce
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgap.operators import arrange, chain, construct, policies, stats, validate
from fillgap.operators.predicates import NetPredicate, parse_region
from fillgap.session import scratch
from fillgap.sources import chain_text, net_text, sizes, writer


def _read(spark: SparkSession, path: str, mode: str = net_text.COMPATIBLE) -> tuple[DataFrame, DataFrame]:
    options = net_text.ReaderOptions(mode=mode)
    if path == "-":
        return net_text.read_bytes(spark, sys.stdin.buffer.read(), options)
    return net_text.read_nets(spark, path.split(","), options)


def _emit(lines: DataFrame, columns: list[str], out: str, gz: bool | None, parts: bool = False) -> None:
    """To one file, a folder of text parts, or standard output; a closed pipe is no error."""
    if parts:
        ordered = writer.in_order(lines, columns)
        ordered.select("line").write.option("compression", "gzip" if gz or gz is None and out.endswith(".gz") else "none").text(out)
    elif out != "-":
        writer.write_lines_file(lines, columns, out, gz)
    else:
        _print(f"{row['line']}\n" for row in lines.orderBy(*columns).select("line").toLocalIterator(prefetchPartitions=True))


def _print(texts: Iterable[str]) -> None:
    try:
        for text in texts:
            sys.stdout.write(text)
        sys.stdout.flush()
    except BrokenPipeError:
        sys.stderr.close()


def _predicate(a: argparse.Namespace) -> NetPredicate:
    split = lambda x: x.split(",") if x else None
    return NetPredicate(
        kinds=split(a.kind), query_names=split(a.query), strand=a.strand, min_depth=a.min_depth, max_depth=a.max_depth, reference_overlap=parse_region(a.region, ordered=False) if a.region else None,
        chain_ids=[int(x) for x in a.chain.split(",")] if a.chain else None, types=split(a.type), min_score=a.min_score, max_score=a.max_score, min_ali=a.min_ali,
    )


def run(argv: list[str], spark: SparkSession) -> int:
    p = argparse.ArgumentParser(prog="fillgap")
    commands = p.add_subparsers(dest="command", required=True)
    made = {}
    for name in ("filter", "view", "sort", "merge", "split", "stats", "validate", "net"):
        made[name] = commands.add_parser(name)
        made[name].add_argument("--out", default="-")
        made[name].add_argument("--gzip", action="store_true", default=None)
        made[name].add_argument("--parts", action="store_true", help="write a folder of text parts")
        if name not in ("merge", "net"):
            made[name].add_argument("--net", default="-")
    f = made["filter"]
    for flag in ("kind", "query", "strand", "region", "chain", "type"):
        f.add_argument(f"--{flag}")
    for flag, kind in (("min-depth", int), ("max-depth", int), ("min-score", float), ("max-score", float), ("min-ali", int)):
        f.add_argument(f"--{flag}", type=kind)
    f.add_argument("--policy", choices=[policies.PRUNE, policies.RETAIN, policies.PROMOTE], default=policies.PRUNE)
    v = made["view"]
    v.add_argument("--reference")
    v.add_argument("--region")
    v.add_argument("--chain")
    v.add_argument("--max-depth", type=int)
    v.add_argument("--flat", action="store_true")
    made["sort"].add_argument("--nets", choices=[arrange.PRESERVE, arrange.LEXICOGRAPHIC, arrange.NATURAL], default=arrange.NATURAL)
    made["sort"].add_argument("--records", choices=["preserve", "reference"], default="preserve")
    made["sort"].add_argument("--validate", action="store_true")
    m = made["merge"]
    inputs = m.add_mutually_exclusive_group(required=True)
    inputs.add_argument("--nets")
    inputs.add_argument("--file", help="a file that lists one input a line")
    m.add_argument("--duplicates", choices=[arrange.KEEP_ALL, arrange.KEEP_FIRST, arrange.KEEP_LAST, arrange.ERROR], default=arrange.ERROR)
    m.add_argument("--sort", action="store_true")
    made["split"].add_argument("--suffix", default=".net")
    made["split"].add_argument("--manifest")
    made["validate"].add_argument("--mode", choices=["syntax", "compatible", "strict"], default="strict")
    made["validate"].add_argument("--warnings-fail", action="store_true")
    made["validate"].add_argument("--tsv", action="store_true")
    n = made["net"]
    n.add_argument("--chains", default="-")
    for side in (chain.REFERENCE, chain.QUERY):
        given = n.add_mutually_exclusive_group(required=True)
        given.add_argument(f"--{side}-sizes")
        given.add_argument(f"--{side}-2bit")
        n.add_argument(f"--{side}-net")
    sides = n.add_mutually_exclusive_group()
    sides.add_argument("--reference-only", action="store_true")
    sides.add_argument("--query-only", action="store_true")
    n.add_argument("--raw-net-out")
    n.add_argument("--raw-query-net-out")
    n.add_argument("--preset", choices=["ccr"])
    n.add_argument("--min-space", type=int, default=25)
    n.add_argument("--min-fill", type=int)
    n.add_argument("--min-score", type=float)
    n.add_argument("--post-filter", type=int)
    n.add_argument("--haplotypes", action="store_true")
    a = p.parse_args(argv)
    try:
        with scratch(spark):
            return _COMMANDS[a.command](a, spark)
    except (net_text.NetParseError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except (PySparkException, Py4JJavaError) as e:  # found while a job ran: a duplicate section, a missing file
        said = [x.strip() for x in str(e).splitlines() if "USER_RAISED_EXCEPTION" in x] or str(e).splitlines()
        print("error:", said[0], file=sys.stderr)
        return 1


def _nets(a: argparse.Namespace, sections: DataFrame, records: DataFrame, order: str = "net_id") -> int:
    _emit(writer.text_lines(sections, records, order), ["section", "pos"], a.out, a.gzip, a.parts)
    return 0


def _filter(a, spark):
    sections, records = _read(spark, a.net)
    return _nets(a, sections, policies.filter_records(records, _predicate(a).matches(), a.policy))


def _view(a, spark):
    sections, records = _read(spark, a.net)
    if a.reference:
        sections, records = (x.where(F.col("reference_name") == a.reference) for x in (sections, records))
    chosen = NetPredicate(chain_ids=[int(x) for x in a.chain.split(",")] if a.chain else None, reference_overlap=parse_region(a.region) if a.region else None, max_depth=a.max_depth)
    if a.chain or a.region:
        records = policies.filter_records(records, chosen.matches(), policies.RETAIN)
    elif a.max_depth is not None:
        records = policies.filter_records(records, chosen.matches(), policies.PRUNE)
    if not a.flat:
        return _nets(a, sections, records)
    lines = writer.flat_lines(records)
    _emit(lines, ["reference_name", "pos"], a.out, a.gzip, a.parts)
    return 0


def _sort(a, spark):
    sections, records = _read(spark, a.net)
    if a.records == "reference":
        records = arrange.sort_records(records)
        if a.validate:
            validate.require_valid(records, sections)
    ranked = arrange.sort_sections(sections, a.nets)
    return _nets(a, ranked, records.join(ranked.select("net_id", "rank"), "net_id"), "rank")


def _merge(a, spark):
    paths = a.nets.split(",") if a.nets else [x.strip() for x in Path(a.file).read_text().splitlines() if x.strip()]
    if not paths:
        raise ValueError(f"{a.file} lists no input")
    sections, records = net_text.read_nets(spark, paths)
    kept = arrange.merge_sections(sections, a.duplicates, a.sort)
    return _nets(a, kept, arrange.records_of(records, kept), "rank")


def _split(a, spark):
    sections, records = _read(spark, a.net)
    rows = writer.split(sections, records, a.out, a.suffix, bool(a.gzip)).orderBy("net_id")
    lines = (f"{r['reference_name']}\t{r['section_size']}\t{a.out}/{r['file']}\t{r['records']}\n" for r in rows.toLocalIterator())
    if a.manifest:
        with open(a.manifest, "w") as f:
            f.write("reference_name\treference_size\toutput_file\trecords\n")
            f.writelines(lines)
    else:
        _print(lines)
    return 0


def _stats(a, spark):
    sections, records = _read(spark, a.net)
    _print([stats.report(records, sections)])
    return 0


def _validate(a, spark):
    sections, records = _read(spark, a.net)
    found = validate.issues(records, sections, a.mode)
    _emit(validate.report_lines(found, a.tsv), ["net_id", "anchor", "rule", "pos"], a.out, a.gzip, a.parts)
    if not a.tsv:
        print("{} error(s), {} warning(s)".format(*validate.totals(found)), file=sys.stderr)
    return validate.exit_status(found, a.warnings_fail)


def _net(a, spark):
    lines = net_text.lines_of(spark, [sys.stdin.buffer.read()]) if a.chains == "-" else net_text.read_lines(spark, [a.chains])
    chains, metadata = chain_text.parse_chains(lines)
    sides = [(side, getattr(a, f"{side}_sizes"), getattr(a, f"{side}_2bit")) for side in (chain.REFERENCE, chain.QUERY)]
    known = reduce(DataFrame.union, [sizes.from_text(spark, side, text) if text else sizes.from_twobit(spark, side, twobit) for side, text, twobit in sides])
    options = construct.CLEANER if a.preset else construct.NetOptions()
    options = replace(options, min_space=a.min_space, min_fill=a.min_space // 2 if a.min_fill is None else a.min_fill, capture_raw=bool(a.raw_net_out or a.raw_query_net_out), haplotypes=a.haplotypes)
    if a.min_score is not None:
        options = replace(options, min_score=a.min_score)
    if a.post_filter is not None:
        options = replace(options, post_filter=a.post_filter)
    if a.reference_only or a.query_only:
        options = replace(options, side=chain.REFERENCE if a.reference_only else chain.QUERY)
    for side in (chain.REFERENCE, chain.QUERY):
        if options.side in (side, construct.BOTH) and not getattr(a, f"{side}_net"):
            raise ValueError(f"--{side}-net is needed for the chosen side")
    if a.raw_query_net_out and options.side == chain.REFERENCE:
        raise ValueError("--raw-query-net-out needs the query side")
    wrong = chain.chain_errors(chains, known, options.validate_score_order).orderBy("input_ordinal").first()
    if wrong is not None:
        raise ValueError(f"chain {wrong['chain_id']}: {wrong['kind']}, {wrong['reason']}")
    says = [r["line"] for r in metadata.orderBy("line_no").collect()]  # comment lines of a chain file
    made = construct.generate(chains, known, options, says)
    for nets, lines, out in ((made.reference, made.metadata, a.reference_net), (made.query, made.metadata, a.query_net), (made.raw_reference, made.raw_metadata, a.raw_net_out), (made.raw_query, made.raw_metadata, a.raw_query_net_out)):
        if nets and out:
            _emit(writer.with_metadata(writer.text_lines(*nets), lines), ["section", "pos"], out, a.gzip, a.parts)
    return 0


_COMMANDS = {"filter": _filter, "view": _view, "sort": _sort, "merge": _merge, "split": _split, "stats": _stats, "validate": _validate, "net": _net}


def main() -> None:
    spark = SparkSession.builder.appName("fillgap").getOrCreate()
    sys.exit(run(sys.argv[1:], spark))


if __name__ == "__main__":
    main()
