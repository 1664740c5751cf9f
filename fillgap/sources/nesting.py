"""Lines of indented text as trees, in chunks: every line is dealt once, by its chunk, and a chunk is summed up in one row.

A chunk's row says how many lines, bytes and headers it holds, which of its records close what earlier chunks left open,
and what it leaves open itself. A fold over the rows of a file tells each chunk what is open where it starts, and where
the records end that it leaves open. No window runs over a section, and any width of indentation costs the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK = 1 << 16  # places of lines that one task handles at a time
KEYS = ["file_id", "part", "chunk"]
OTHER, HEADER, RECORD, BAD = range(4)  # marks of lines: blank or comment, header, record in the tree, record with an error

FRAME = "array<struct<indent:int,pos:long,beside:int,line:long>>"  # an open record; beside is the indent of the first in its list of siblings
SUM = f"file_id int, part long, chunk long, lines long, bytes long, headers long, lead long, tail long, lowest array<struct<indent:int,first:long,last:long,line:long>>, open {FRAME}"
STATE = f"file_id int, part long, chunk long, line_base long, byte_base long, headers long, pos long, open {FRAME}, ends map<long,long>"
PLACED = "net_id int, line_no long, byte_start long, pos long, parent long, subtree_end long, depth int, above int, beside int, leads boolean, root long, rpos long"


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


NAMES = ("pos", "parent", "subtree_end", "depth", "above", "beside", "leads", "root", "rpos")
WIDTHS = 64  # of as many widths of indents each is a pass over arrays; of more, lines go through a stack


def walk(marks: np.ndarray, indents: np.ndarray, stack: list[tuple], pos: int, inside: bool, base: int) -> tuple[dict[str, np.ndarray], list[tuple], int]:
    """Positions, parents, ends, depths of a chunk's records from what is open before it; with what is open behind it.

    -1 stands for null: all of lines that are no records in a tree, parents of roots, ends that lie behind the chunk.
    """
    headers = np.cumsum(marks == HEADER)
    at = np.flatnonzero((marks == RECORD) & (inside | (headers > 0)))
    first = len(stack)  # what is open stands before the records
    width = np.concatenate([np.array([f[0] for f in stack], np.int64), indents[at].astype(np.int64)])
    widths = np.unique(width)
    if len(widths) > WIDTHS:
        return _stacked(marks.tolist(), indents.tolist(), stack, pos, inside, base)
    n, seg = len(width), np.concatenate([np.zeros(first, np.int64), headers[at].astype(np.int64)])
    here, begin, stop = np.arange(n), np.searchsorted(seg, seg, "left"), np.searchsorted(seg, seg, "right")
    parent, after = np.full(n, -1), np.full(n, n)
    above, below, depth, root = np.full(n, -1), np.full(n + 1, n), np.zeros(n, np.int64), here.copy()
    for w in widths:  # the nearest record before with a smaller indent, and behind with one that is not larger
        own = width == w
        parent[own] = np.where(above[own] >= begin[own], above[own], -1)
        above = np.maximum(above, np.maximum.accumulate(np.where(own, here, -1)))
        below[:n] = np.minimum(below[:n], np.minimum.accumulate(np.where(own, here, n)[::-1])[::-1])
        after[own] = below[1:][own]
        inner = own & (parent >= 0)
        depth[inner], root[inner] = depth[parent[inner]] + 1, root[parent[inner]]
    rank = np.where(seg == 0, pos + here - first, here - begin)
    rank[:first] = [f[1] for f in stack]
    line = np.concatenate([np.array([f[3] for f in stack], np.int64), base + at + 1])
    total = int(headers[-1]) if len(headers) else 0
    open_here = (seg == total) & (after >= stop)
    count = np.where(seg == 0, pos - first, 0) + stop - np.where(seg == 0, 0, begin)  # records of the section up to its end here
    ends = np.where(after < stop, rank[np.minimum(after, n - 1)] if n else after, count)
    beside = width.copy()
    beside[:first] = [f[2] for f in stack]
    beside = beside[np.where(parent >= 0, parent + 1, begin)] if n else beside  # a record's first child follows it
    up = np.maximum(parent, 0)
    found = {
        "pos": rank, "parent": np.where(parent >= 0, rank[up], -1), "subtree_end": np.where(open_here, -1, ends), "depth": depth, "above": np.where(parent >= 0, width[up], 0), "beside": beside,
        "leads": (parent == np.where(here > begin, here - 1, -1)).astype(np.int64), "root": line[root], "rpos": rank - rank[root],
    }
    left = [(int(width[i]), int(rank[i]), int(beside[i]), int(line[i])) for i in np.flatnonzero(open_here)]
    out = {}
    for name, values in found.items():
        out[name] = np.full(len(marks), -1, np.int64)
        out[name][at] = values[first:]
    own = len(at) - int(np.searchsorted(headers[at], total, "left"))
    return out, left, own + (pos if total == 0 else 0)


def _stacked(marks: list[int], indents: list[int], stack: list[tuple], pos: int, inside: bool, base: int) -> tuple[dict[str, np.ndarray], list[tuple], int]:
    """``walk`` by a stack, line after line, whatever the number of widths."""
    out = {c: np.full(len(marks), -1, np.int64) for c in NAMES}
    at, parent, end, depth, above, beside, leads, root, rpos = out.values()
    stack = list(stack)

    def close(frame: tuple) -> None:
        if frame[3] > base:  # it began in this chunk
            end[frame[3] - base - 1] = pos

    for i, mark in enumerate(marks):
        if mark == HEADER:
            for frame in stack:
                close(frame)
            stack, pos, inside = [], 0, True
        elif mark == RECORD and inside:
            width, near = indents[i], None
            while stack and stack[-1][0] >= width:
                near = stack.pop()
                close(near)
            at[i], depth[i], above[i], leads[i] = pos, len(stack), stack[-1][0] if stack else 0, near is None
            parent[i], beside[i] = stack[-1][1] if stack else -1, width if near is None else near[2]
            stack.append((width, pos, int(beside[i]), base + i + 1))
            root[i], rpos[i] = stack[0][3], pos - stack[0][1]
            pos += 1
    return out, stack, pos


def _summed(rows: pa.Table, schema: pa.Schema) -> pa.Table:
    order = pc.sort_indices(rows["place"])
    marks, indents = (rows[c].take(order).to_numpy() for c in ("mark", "indent"))
    headers = int((marks == HEADER).sum())
    to = int(np.argmax(marks == HEADER)) if headers else len(marks)
    found, stack, tail = walk(marks, indents, [], 0, True, 0)
    low = np.flatnonzero(found["depth"][:to] == 0)  # records that nothing in the chunk holds, as runs of one indent
    width, pos = indents[low], found["pos"][low]
    begin = np.flatnonzero(np.diff(width, prepend=-1) != 0)
    last = np.append(begin[1:], len(low))[: len(begin)] - 1
    lowest = [{"indent": int(width[a]), "first": int(pos[a]), "last": int(pos[z]), "line": int(low[z]) + 1} for a, z in zip(begin, last, strict=True)]
    names = ("indent", "pos", "beside", "line")
    row = {k: rows[k][0].as_py() for k in KEYS} | {
        "lines": len(marks), "bytes": pc.sum(rows["bytes"]).as_py(), "headers": headers, "lead": int((marks[:to] == RECORD).sum()), "tail": tail, "lowest": lowest,
        "open": [dict(zip(names, f, strict=True)) for f in (stack if headers else stack[1:])],
    }
    return pa.Table.from_pylist([row], schema=schema)


def _folded(chunks: pa.Table, schema: pa.Schema) -> pa.Table:
    """What is open before each chunk of a file, one row a chunk in and out."""
    rows, out, stack = chunks.sort_by([("part", "ascending"), ("chunk", "ascending")]).to_pylist(), [], []
    lines = size = headers = pos = 0

    def close(frame: tuple, now: int, here: int) -> None:
        if frame[4] != here:  # what a chunk closes itself it knows
            out[frame[4]]["ends"].append((frame[1], now))

    for k, row in enumerate(rows):
        state = {"line_base": lines, "byte_base": size, "headers": headers, "pos": pos, "ends": []}
        out.append({c: row[c] for c in KEYS} | state | {"open": [dict(zip(("indent", "pos", "beside", "line"), f[:4], strict=True)) for f in stack]})
        if headers:
            for run in row["lowest"]:
                near = None
                while stack and stack[-1][0] >= run["indent"]:
                    near = stack.pop()
                    close(near, pos + run["first"], k)
                stack.append((run["indent"], pos + run["last"], run["indent"] if near is None else near[2], lines + run["line"], k))
        if row["headers"]:
            for frame in stack:
                close(frame, pos + row["lead"], k)
            stack, pos = [], 0
        if headers or row["headers"]:
            stack += [(f["indent"], pos + f["pos"], f["beside"], lines + f["line"], k) for f in row["open"]]
            pos += row["tail"]
        lines, size, headers = lines + row["lines"], size + row["bytes"], headers + row["headers"]
    for frame in stack:
        close(frame, pos, -1)
    return pa.Table.from_pylist(out, schema=schema)


def nested_lines(lines: DataFrame, kept: list[str], adds: str = "", add: Callable[[pa.Table, pa.Schema], pa.Table] | None = None) -> DataFrame:
    """``kept`` columns of headers and records with their numbers and, for records in the tree, places in it (PLACED).

    lines: file_id, part, place, mark, indent, bytes and ``kept``. Records before the first header have no net_id.
    ``add`` may change the kept columns of a chunk and give more, which ``adds`` declares.
    """
    # Dealt also where the lines come from one task, so that chunks never stay there.
    dealt = lines.select("file_id", "part", F.floor(F.col("place") / CHUNK).cast("long").alias("chunk"), "place", "mark", "indent", "bytes", *kept).repartition(*KEYS)
    of_chunk, of_file, added = _arrow(SUM), _arrow(STATE), T.StructType.fromDDL(adds) if adds else T.StructType()
    sums = dealt.groupBy(*KEYS).applyInArrow(lambda rows: _summed(rows, of_chunk), SUM)
    state = sums.groupBy("file_id").applyInArrow(lambda rows: _folded(rows, of_file), STATE)  # a row a chunk
    schema = T.StructType([T.StructField("file_id", T.IntegerType()), *T.StructType.fromDDL(PLACED), T.StructField("mark", T.IntegerType()), T.StructField("indent", T.IntegerType()), *[lines.schema[c] for c in kept], *added])
    placed, more = _arrow(PLACED), to_arrow_schema(added)

    def place(rows: pa.Table, states: pa.Table) -> pa.Table:
        rows, state = rows.sort_by("place"), states.to_pylist()[0]
        base, marks = state["line_base"], rows["mark"].to_numpy()
        stack = [(f["indent"], f["pos"], f["beside"], f["line"]) for f in state["open"]]
        found, left, _ = walk(marks, rows["indent"].to_numpy(), stack, state["pos"], state["headers"] > 0, base)
        ends = dict(state["ends"])
        for _, pos, _, line in left:  # what is open at the end stands behind the last header
            if line > base:
                found["subtree_end"][line - base - 1] = ends[pos]
        size = rows["bytes"].to_numpy()
        found |= {"net_id": state["headers"] - 1 + np.cumsum(marks == HEADER), "byte_start": state["byte_base"] + np.cumsum(size) - size, "line_no": np.arange(base + 1, base + 1 + len(marks))}
        columns = [pa.array(found[f.name] > 0 if f.name == "leads" else found[f.name], f.type, mask=found[f.name] < 0) for f in placed]
        table = pa.table([rows["file_id"], *columns, rows["mark"], rows["indent"], *[rows[c] for c in kept]], names=["file_id", *placed.names, "mark", "indent", *kept])
        table = table.filter(pc.not_equal(table["mark"], OTHER))
        return add(table, more) if add else table

    return dealt.groupBy(*KEYS).cogroup(state.groupBy(*KEYS)).applyInArrow(place, schema)
