"""N-gram Jaccard join: classes of documents that chains of similar pairs connect.

A document is the set of hashes of its word n-grams. Two sets of similarity t or more share one of their rarest
n - ceil(t n) + 1 elements, whatever order says which are rare, as long as all documents use the same one. The order
here is by how often an element's bucket of hashes occurs in the whole corpus, counted in a sketch of fixed size, so
passages that many documents share come last and stay out of the prefixes.

1. One pass hashes every whole text: set size, a fingerprint of the set, and the sketch. Documents with the same 128
   bits of fingerprint are one vertex from here on, so exact copies of any number cost one.
2. A second pass sends each vertex's prefix to buckets of hashes; a bucket keeps the elements that two vertices share.
   What a part has of an element beyond a few vertices goes to other buckets, so a hot element is many tasks' work.
3. Each list has a centre, and each vertex is compared with the one centre it meets most often; ``stars`` times over,
   with other centres. This joins large groups of near copies at the cost of a few comparisons for each vertex.
4. Every pair that shares a prefix element, passes the length, positional and count filters and isn't connected yet is
   a candidate. Of those between two components the likeliest is compared first, ``tries`` times over; all that are then
   still apart are compared. Nothing is left out: a pair that no filter excludes is compared or already connected. Long
   lists are dealt into cells of bounded size, and each pair of a list meets in one cell.

Comparisons join the two sets and count what they share, after a suffix filter on the counts by range of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillgap.llm.common import columns_of, cut
from fillgap.llm.hashing import SpanHasher, mixed

SKETCH_BITS = 20
CHUNK = 4_096
HOT = 16  # vertices of one part that an element's own bucket gets
CELL = 2_048  # vertices of a list that meet as many others in one cell
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

def shingles(text: str | None, n: int, hasher: SpanHasher) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams of words; of all its words as one if there are fewer."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate(([False], ~SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    words = hasher(FOLD[data], edges[0::2], edges[1::2])
    if not len(words):
        return words
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = mixed(total * np.uint64(0xA24BAED4963EE407) + words[i : len(words) - size + 1 + i])
    return np.unique(total)


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, as two numbers of 64."""
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def vertex_of(grams: np.ndarray, doubtful: frozenset[int]) -> int:
    """A set's vertex: the first half of its fingerprint; both halves together where unlike sets agree in the first."""
    half, other = fingerprint(grams)
    return half ^ other if half in doubtful else half


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _profiles(n: int):
    """Rows of documents (doc_id, n, both halves of the fingerprint) and, at the end of a part, rows of its sketch (chunk, counts)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, hasher = np.zeros(1 << SKETCH_BITS, np.int64), SpanHasher()
        for batch in rows:
            sizes, marks = [], []
            for text in batch.column(1):
                grams = shingles(text.as_py(), n, hasher)
                sizes.append(len(grams))
                marks.append(fingerprint(grams) if len(grams) else (None, None))
                np.add.at(sketch, (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            k = len(sizes)
            half, other = (pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1))
            yield _batch(doc_id=batch.column(0), n=pa.array(sizes, pa.int64()), half=half, other=other, chunk=pa.nulls(k, pa.int32()), counts=pa.nulls(k, pa.binary()))
        chunks = [c for c in range(len(sketch) // CHUNK) if sketch[c * CHUNK : (c + 1) * CHUNK].any()]
        blobs = [np.minimum(sketch[c * CHUNK : (c + 1) * CHUNK], 2**31 - 1).astype(np.int32).tobytes() for c in chunks]
        k = len(chunks)
        yield _batch(doc_id=pa.nulls(k, pa.int64()), n=pa.nulls(k, pa.int64()), half=pa.nulls(k, pa.int64()), other=pa.nulls(k, pa.int64()), chunk=pa.array(chunks, pa.int32()), counts=pa.array(blobs, pa.binary()))

    return run


def _added(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each chunk that comes here."""
    sums: dict[int, np.ndarray] = {}
    for batch in rows:
        for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[c] = sums.get(c, 0) + np.frombuffer(blob, np.int32).astype(np.int64)
    if sums:
        yield _batch(chunk=pa.array(list(sums), pa.int32()), counts=pa.array([v.tobytes() for v in sums.values()], pa.binary()))


def rare_first(grams: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set in the corpus's order: by the count of the bucket, then by hash."""
    return grams[np.lexsort((grams, sketch[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))]


def _least(numbers: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent * n / 100) in whole numbers."""
    return -(-numbers * percent // 100)


def least_shared(m: Column, n: Column, percent: int) -> Column:
    """How many prefix elements two sets of sizes m and n share at least if they are similar.

    All they share up to the end of one of the two prefixes lies in both. The rest of that set, at most
    ceil(t m) - 1 or ceil(t n) - 1 elements, can't make up for more.
    """
    both = F.ceil((m + n) * percent / F.lit(100 + percent))
    return F.greatest(F.lit(1), both - F.ceil(F.greatest(m, n) * percent / F.lit(100)) + 1)


def _prefixes(n: int, percent: int, sketch, buckets: int, doubtful: frozenset[int], at_once: int = 500_000):
    """For each bucket of hashes the prefix elements of a part's vertices, packed.

    An element's bucket gets HOT vertices of a part at most. The others go to further buckets, dealt by vertex; ``hot``
    entries tell the element's bucket that there are more.
    """

    def packed(entries: list, vertices: list, sizes: list) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(entries)
        owner = np.repeat(np.arange(len(entries), dtype=np.int32), [len(e) for e in entries])
        place = np.concatenate([np.arange(len(e), dtype=np.int32) for e in entries])
        names, counts = np.array(vertices, np.int64), np.array(sizes, np.int32)
        order = np.lexsort((owner, hashes))
        hashes, owner, place = hashes[order], owner[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        many = np.diff(np.append(first, len(hashes)))
        rank = np.arange(len(hashes)) - np.repeat(first, many)
        hot = np.repeat(many > HOT, many)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        bucket = np.where(rank < HOT, bucket, buckets + names[owner] % buckets)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(2 * buckets + 1))
        for b in np.flatnonzero(np.diff(ends)).tolist():
            at = order[ends[b] : ends[b + 1]]
            yield _batch(
                bucket=pa.array([b], pa.int32()), hashes=pa.array([hashes[at].tobytes()]), place=pa.array([place[at].tobytes()]), hot=pa.array([np.packbits(hot[at]).tobytes()]),
                vertex=pa.array([names[owner[at]].tobytes()]), n=pa.array([counts[owner[at]].tobytes()]),
            )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hasher = SpanHasher()
        entries, vertices, sizes, held = [], [], [], 0
        for batch in rows:
            for text in batch.column(0):
                grams = shingles(text.as_py(), n, hasher)
                if not len(grams) or (mark := vertex_of(grams, doubtful)) in seen:
                    continue
                seen.add(mark)
                entries.append(rare_first(grams, sketch.value)[: len(grams) - int(_least(np.array(len(grams)), percent)) + 1])
                vertices.append(mark)
                sizes.append(len(grams))
                held += len(entries[-1])
                if held >= at_once:
                    yield from packed(entries, vertices, sizes)
                    entries, vertices, sizes, held = [], [], [], 0
        if entries:
            yield from packed(entries, vertices, sizes)

    return run


def _shared(buckets: int):
    """The elements of a bucket that several vertices have."""

    def run(table: pa.Table) -> pa.Table:
        hashes, place, vertex, size, hot = [], [], [], [], []
        for row in table.to_batches():
            for k in range(row.num_rows):
                at = {c: row.column(c)[k].as_py() for c in ("hashes", "place", "vertex", "n", "hot")}
                hashes.append(np.frombuffer(at["hashes"], np.uint64))
                place.append(np.frombuffer(at["place"], np.int32))
                vertex.append(np.frombuffer(at["vertex"], np.int64))
                size.append(np.frombuffer(at["n"], np.int32))
                hot.append(np.unpackbits(np.frombuffer(at["hot"], np.uint8), count=len(hashes[-1])).astype(bool))
        hashes, place, vertex, size, hot = map(np.concatenate, (hashes, place, vertex, size, hot))
        order = np.lexsort((vertex, hashes))
        hashes, place, vertex, size, hot = hashes[order], place[order], vertex[order], size[order], hot[order]
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (vertex[1:] != vertex[:-1])))  # a vertex may come from several parts
        hot = np.logical_or.reduceat(hot, np.flatnonzero(new)) if len(new) else hot
        hashes, place, vertex, size = hashes[new], place[new], vertex[new], size[new]
        lists = np.cumsum(np.concatenate(([True], hashes[1:] != hashes[:-1]))) - 1
        keep = (np.bincount(lists)[lists] > 1) | (np.bincount(lists, weights=hot)[lists] > 0)
        return pa.table({"hash": hashes[keep].view(np.int64), "vertex": vertex[keep], "n": size[keep].astype(np.int64), "place": place[keep].astype(np.int64)})

    return run


def _sets(n: int, doubtful: frozenset[int]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in rows:
            grams = [shingles(t.as_py(), n, hasher) for t in batch.column(1)]
            # Of several rows with this doc_id only those with the vertex's own set count.
            same = [len(g) > 0 and vertex_of(g, doubtful) == v for g, v in zip(grams, batch.column(0).to_pylist(), strict=True)]
            yield _batch(vertex=batch.column(0).filter(pa.array(same, pa.bool_())), grams=pa.array([g.tobytes() for g, s in zip(grams, same, strict=True) if s], pa.binary()))

    return run


def _similar(percent: int):
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        pivots = (np.arange(1, 8, dtype=np.uint64)) << np.uint64(61)
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            # 100 i >= percent (m - i) for an intersection of i among m elements in all
            least = -(-percent * (len(x) + len(y)) // (100 + percent))
            p, q = np.searchsorted(x, pivots), np.searchsorted(y, pivots)
            apart = np.abs(np.diff(np.concatenate(([0], p, [len(x)]))) - np.diff(np.concatenate(([0], q, [len(y)])))).sum()
            if len(x) + len(y) - apart < 2 * least:  # suffix filter: too many elements have no partner in their range
                out.append(False)
                continue
            i = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * i >= percent * (len(x) + len(y) - i))
        return pd.Series(out, dtype=bool)

    return similar


def sets_of(docs: DataFrame, vertices: DataFrame, pairs: DataFrame, n: int, doubtful: frozenset[int], small: int = 1_000_000) -> DataFrame:
    """vertex, grams of all vertices of the pairs. vertices: vertex, doc_id of one document each."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().join(vertices, "vertex").select("vertex", F.col("doc_id").alias("__doc"))
    needed = cut(needed)
    needed = F.broadcast(needed) if needed.count() <= small else needed
    texts = docs.join(needed, docs["doc_id"] == F.col("__doc")).select("vertex", "text")
    return cut(texts.mapInArrow(_sets(n, doubtful), "vertex long, grams binary"))


def compare(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""
    with_a = pairs.select("a", "b").join(sets.select(F.col("vertex").alias("a"), F.col("grams").alias("x")), "a")
    both = with_a.join(sets.select(F.col("vertex").alias("b"), F.col("grams").alias("y")), "b")
    return cut(both.where(_similar(percent)("x", "y")).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """vertex, label (its component's smallest vertex) for the vertices of edges (a, b).

    Smallest labels spread, and each label is replaced by its own label, until none moves; every round lowers a label.
    """
    ways = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("vertex"), F.least("a", "m").alias("label")))
    moved = True
    while moved:
        around = ways.join(labels, F.col("b") == F.col("vertex")).groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(around, F.col("vertex") == F.col("a")).select("vertex", F.least("label", "m").alias("new"), "label")
        jump = spread.select(F.col("vertex").alias("v"), F.col("new").alias("further"))
        after = cut(spread.join(jump, F.col("new") == F.col("v")).select("vertex", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")))
        labels, moved = after.select("vertex", "label"), not after.where("moved").isEmpty()
    return labels


def star_pairs(lists: DataFrame, share: DataFrame, labels: DataFrame, turn: int, percent: int) -> DataFrame:
    """For every vertex one of another component to compare with: the centre that it meets in most of its lists.

    A list's centre is, in the first turn, the vertex most of whose elements others have too, and any vertex in later
    turns. A vertex needs not meet its centre in all lists that they share, so half of what similarity asks for will do.
    """
    rows = lists.join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))
    rows = rows.join(share, "vertex").withColumn("rank", F.col("share") if turn == 0 else F.xxhash64(F.lit(turn), "vertex").cast("double"))
    centres = rows.groupBy("hash").agg(F.max(F.struct("rank", F.col("vertex").alias("centre"), F.col("label").alias("of"))).alias("c")).select("hash", "c.centre", "c.of")
    meets = rows.join(centres, "hash").where("label <> of").groupBy("vertex", "centre").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias("n"))
    meets = meets.where(2 * F.col("times") >= least_shared(F.col("n"), F.col("n"), percent))
    best = meets.groupBy("vertex").agg(F.max(F.struct("times", "centre")).alias("m"))
    return best.select(F.least("vertex", "m.centre").alias("a"), F.greatest("vertex", "m.centre").alias("b")).distinct()


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, times) whose components differ, with the components la < lb."""
    at = lambda v, name: labels.select(F.col("vertex").alias(v), F.col("label").alias(name))
    rows = pairs.select("a", "b", "times").join(at("a", "x"), "a", "left").join(at("b", "y"), "b", "left")
    rows = rows.withColumn("x", F.coalesce("x", "a")).withColumn("y", F.coalesce("y", "b")).where("x <> y")
    return cut(rows.select("a", "b", "times", F.least("x", "y").alias("la"), F.greatest("x", "y").alias("lb")))


def in_cells(lists: DataFrame, columns: list[str], per_bucket: int = 200_000) -> tuple[DataFrame, int]:
    """Rows of the lists that hold several components, dealt into cells of bounded size, and into how many buckets they go.

    lists: hash and ``columns``, with vertex and label. Adds cell (i, j, of) and side. A list's largest component needs no
    comparison within itself. In a cell of kind 0 some of its members (side 0) meet some of the other vertices (side 1);
    in kind 1 other vertices meet other vertices, of the same part or of two. Buckets follow the number of rows in cells.
    """
    sizes = lists.groupBy("hash", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("hash").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top"))
    sizes = sizes.where(F.col("all") > F.col("top.c")).withColumns({"k0": F.ceil(F.col("top.c") / CELL).cast("int"), "k1": F.ceil((F.col("all") - F.col("top.c")) / CELL).cast("int")})
    sizes = cut(sizes.select("hash", F.col("top.label").alias("top"), F.col("top.c").alias("members"), (F.col("all") - F.col("top.c")).alias("others"), "k0", "k1"))
    in_all = sizes.agg(F.sum(F.col("members") * F.col("k1") + F.col("others") * (F.col("k0") + F.col("k1")))).first()[0] or 0
    rows = lists.join(sizes.select("hash", "top", "k0", "k1"), "hash")
    inside = F.col("label") == F.col("top")
    own = F.pmod(F.xxhash64(F.lit(9), "vertex"), F.when(inside, F.col("k0")).otherwise(F.col("k1"))).cast("int")
    rows = rows.withColumn("own", own).withColumn("inside", inside)

    def cell(i, j, of, side) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(of).alias("of"), side.cast("int").alias("side"))

    own, least, most = F.col("own"), lambda x: F.least(F.col("own"), x), lambda x: F.greatest(F.col("own"), x)
    members = F.transform(F.sequence(F.lit(0), F.col("k1") - 1), lambda j: cell(own, j, 0, F.lit(0)))
    others = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("k0") - 1), lambda i: cell(i, own, 0, F.lit(1))),
        F.transform(F.sequence(F.lit(0), F.col("k1") - 1), lambda j: cell(least(j), most(j), 1, F.when(own <= j, 0).otherwise(1))),
    )
    rows = rows.select("hash", *columns, F.explode(F.when(F.col("inside"), members).otherwise(others)).alias("cell"))
    return rows.select("hash", *columns, "cell.*"), max(64, -(-int(in_all) // per_bucket))


def cells_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """For each cell of a bucket its columns, the places of one side, those of the other, and whether it is one part that meets itself."""
    t = pa.Table.from_batches(list(batches)).to_pandas().sort_values(["hash", "of", "i", "j", "side"], kind="stable")
    key, side, held = t[["hash", "of", "i", "j"]].to_numpy(), t["side"].to_numpy(), [t[c].to_numpy() for c in columns]
    cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True]))) if len(key) else []
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        middle = int(np.searchsorted(side[s:e], 1))
        one_part = key[s, 1] == 1 and key[s, 2] == key[s, 3]
        few, many = ((0, middle), (middle, e - s)) if 2 * middle <= e - s else ((middle, e - s), (0, middle))
        yield *(x[s:e] for x in held), range(e - s) if one_part else range(*few), slice(*many), one_part


def _crossing(percent: int, at_once: int = 100_000):
    """Pairs of cells that are not connected and that pass the length and positional filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for vertex, size, place, label, few, many, one_part in cells_of(batches, ["vertex", "n", "place", "label"]):
            for i in few:
                at = slice(i + 1, len(vertex)) if one_part else many
                m, least = size[at], -(-percent * (size[at] + size[i]) // (100 + percent))
                other = (label[at] != label[i]) & (np.minimum(m, size[i]) * 100 >= percent * np.maximum(m, size[i]))
                # The first element that a similar pair shares has so few elements before it in both that the rest will do.
                other &= np.minimum(m - place[at], size[i] - place[i]) >= least
                if other.any():
                    v = vertex[at][other]
                    found.append(np.stack([np.minimum(v, vertex[i]), np.maximum(v, vertex[i])], 1))
                    held += len(v)
                    if held >= at_once:
                        yield _pairs(found)
                        found, held = [], 0
        yield _pairs(found)

    return run


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
    return _batch(a=pa.array(pairs[:, 0]), b=pa.array(pairs[:, 1]))


def named_vertices(profile: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """Names each set by its fingerprint: (rows of ``profile`` with vertex for half and other; vertex, doc_id, the smallest
    of its documents; first halves that unlike sets share).

    Wordless rows and rows with a null id have no vertex.
    """
    by_half = profile.where(F.col("half").isNotNull() & F.col("doc_id").isNotNull()).groupBy("half").agg(F.min("doc_id").alias("doc_id"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    vertices = cut(by_half)
    # Of 10^10 sets a few agree in one half by chance, and by chance no two of those few in both halves together.
    doubtful = frozenset(r["half"] for r in vertices.where("lo <> hi").select("half").collect())
    vertex = F.col("half")
    if doubtful:
        vertex = F.when(vertex.isin(list(doubtful)), vertex.bitwiseXOR(F.col("other"))).otherwise(vertex)
    profile = profile.withColumn("vertex", F.when(F.col("doc_id").isNotNull(), vertex)).drop("half", "other")
    if doubtful:
        return profile, cut(profile.where(F.col("vertex").isNotNull()).groupBy("vertex").agg(F.min("doc_id").alias("doc_id"))), doubtful
    return profile, vertices.select(F.col("half").alias("vertex"), "doc_id"), doubtful


def classes(docs: DataFrame, n: int = 5, percent: int = 75, stars: int = 3, tries: int = 2) -> DataFrame:
    """Classes of documents that chains of pairs with a Jaccard similarity of ``percent`` / 100 or more connect.

    Input: doc_id (long), text; other columns are ignored. Output, one row for every input row: doc_id, n_shingles,
    component_id (the smallest doc_id of its class). Null or wordless texts have no n-grams and are alone, with their
    own doc_id. Rows that repeat a doc_id are compared each; rows with a null id come back alone with a null component.
    No rows give no rows. N-grams are compared by 64-bit hashes, sets of them by 128 bits.
    """
    profile, found, _ = _classes(docs, n, percent, stars, tries)
    out = profile.join(found.select("vertex", "component_id"), "vertex", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _classes(docs: DataFrame, n: int = 5, percent: int = 75, stars: int = 3, tries: int = 2) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """(doc_id, n, vertex of every row; vertex, doc_id, label, component_id of every vertex; first halves that unlike sets share)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = cut(rows.mapInArrow(_profiles(n), "doc_id long, n long, half long, other long, chunk int, counts binary"))
    profile = both.where(F.col("chunk").isNull()).select("doc_id", "n", "half", "other")
    sums = both.where(F.col("chunk").isNotNull()).select("chunk", "counts").repartition(16, "chunk").mapInArrow(_added, "chunk int, counts binary").collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in sums:  # 2 ** SKETCH_BITS counts, whatever the corpus
        sketch[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.int64)
    shared_sketch = spark.sparkContext.broadcast(np.minimum(sketch, 2**31 - 1).astype(np.int32))

    profile, vertices, doubtful = named_vertices(profile)

    total = profile.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, int(total * (100 - percent) / 100 / 500_000))
    prefixes = rows.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(_prefixes(n, percent, shared_sketch, buckets, doubtful), "bucket int, hashes binary, place binary, hot binary, vertex binary, n binary")
    lists = cut(prefixes.groupBy("bucket").applyInArrow(_shared(buckets), "hash long, vertex long, n long, place long"))

    edges, labels = None, lists.select("vertex", F.col("vertex").alias("label")).limit(0)
    share = lists.groupBy("vertex").agg((F.count(F.lit(1)) / F.min("n")).alias("share"))
    for i in range(stars):
        first = cut(star_pairs(lists, share, labels, i, percent))
        edges_now = compare(sets_of(rows, vertices, first, n, doubtful), first, percent)
        edges = edges_now if edges is None else edges.union(edges_now)
        labels = components(edges)

    labelled = cut(lists.join(labels, "vertex", "left").select("hash", "vertex", "n", "place", F.coalesce("label", "vertex").alias("label")))
    cells, buckets = in_cells(labelled, ["vertex", "n", "place", "label"])
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("hash", "i", "j", "of"), F.lit(buckets)))
    met = cells.groupBy("bucket").applyInArrow(_crossing(percent), "a long, b long").distinct()
    early = lists.groupBy("vertex").agg(F.collect_set("hash").alias("early"), F.min("n").alias("n"))
    met = met.join(early.toDF("a", "x", "m"), "a").join(early.toDF("b", "y", "n"), "b").withColumn("times", F.size(F.array_intersect("x", "y")))
    pairs = cut(met.where(F.col("times") >= least_shared(F.col("m"), F.col("n"), percent)).select("a", "b", "times"))
    sets = sets_of(rows, vertices, pairs, n, doubtful)
    for _ in range(tries):
        # Of all pairs between two components the likeliest; if it is similar, the others need no comparison.
        pairs = apart(pairs, labels)
        likely = pairs.groupBy("la", "lb").agg(F.max(F.struct("times", "a", "b")).alias("p")).select("p.a", "p.b")
        likely = cut(likely)
        edges = edges.union(compare(sets, likely, percent))
        labels = components(edges)
        pairs = pairs.join(likely, ["a", "b"], "left_anti")
    edges = edges.union(compare(sets, apart(pairs, labels), percent))
    labels = components(edges)

    least = vertices.join(labels, "vertex", "left").select("vertex", "doc_id", F.coalesce("label", "vertex").alias("label"))
    smallest = least.groupBy("label").agg(F.min(F.struct("doc_id", "vertex")).alias("first"))
    found = least.join(smallest, "label").select("vertex", "doc_id", F.col("first.doc_id").alias("component_id"), (F.col("first.vertex") == F.col("vertex")).alias("leads"))
    return profile, found, doubtful


def one_of_each(docs: DataFrame, n: int = 5, **options) -> DataFrame:
    """One document of each class, that with the smallest doc_id, with all columns of ``docs``.

    Wordless texts and rows with a null id are alone in their classes and stay, copies of them too. Of rows that repeat
    a doc_id one stays if its text leads its class: rows with the same id and the same n-grams count as one document,
    of which the row whose columns come first in order of their hash stays.
    """
    profile, found, doubtful = _classes(docs, n, **options)
    leads = found.where("leads").select("vertex", F.col("doc_id").alias("leader"))
    kept = profile.where(F.col("vertex").isNotNull()).join(leads, "vertex").where(F.col("doc_id") == F.col("leader")).groupBy("vertex", "doc_id").count()
    kept = cut(kept.select(F.col("doc_id").alias("__id"), F.col("vertex").alias("__vertex")))
    seen = cut(profile.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("__id"))
    wordless = profile.where(F.col("vertex").isNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id")).distinct()
    id_of = F.col("doc_id").cast("long")
    # Most ids occur once, and the id tells the row; texts of those don't move.
    alone = kept.select("__id").union(wordless).join(seen, "__id", "left_anti")
    once = docs.join(alone, id_of == F.col("__id"), "left_semi")
    often = docs.join(seen, id_of == F.col("__id"), "left_semi")

    @F.pandas_udf("long")
    def vertex(texts: pd.Series) -> pd.Series:
        hasher = SpanHasher()
        grams = [shingles(t, n, hasher) for t in texts]
        return pd.Series([vertex_of(g, doubtful) if len(g) else None for g in grams], dtype="Int64")

    often = often.withColumn("__vertex", vertex("text")).withColumn("__id", id_of)
    first = F.row_number().over(Window.partitionBy("__id", "__vertex").orderBy(F.xxhash64(*columns_of(docs))))
    often = often.join(kept.withColumn("__kept", F.lit(True)), ["__id", "__vertex"], "left").withColumn("__first", first)
    often = often.where("__vertex is null or __kept and __first = 1").select(*columns_of(docs))
    return once.unionByName(often).unionByName(docs.where(F.col("doc_id").isNull()))
