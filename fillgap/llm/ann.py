"""Approximate nearest neighbours by cosine with score-aware quantisation.

Unit vectors are cut into subspaces of two dimensions with 16 codewords each, so that a code has four bits. For inner
products with a query, an error along the vector itself matters more than one across it; codewords and codes therefore
minimise  h * |parallel residual|^2 + |orthogonal residual|^2  with h > 1. A query's products with all codewords make a
table for each subspace, and a scan adds up table entries, two subspaces a byte. The best of each scan are compared by
their exact cosine, and what a code misses is bounded: with the parts p of the residual along the vector and o across it,
a cosine s has  query . code >= s (1 - p) - sqrt(1 - s^2) o.  Candidates whose codes allow them to reach the query's
lowest score so far are compared exactly as well, so nothing near is lost, however close together vectors lie.

Queries and candidates meet in blocks of a fixed size: each block of queries visits every block of candidates. The
visits come in rounds of 1, 1, 2, 4, ... blocks. The best of the rounds before give a query's lowest score, and a visit
returns only what reaches it: nothing below it can be among the best of all. So a round returns few rows a query, and
rounds grow with the logarithm of the blocks. The work is queries times rows, as asked; the less residuals and scores
leave open, the more of it is a table lookup a byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillgap.llm.common import best_of, cut, distinct_vectors, drawn, vector_rows

WIDTH, WORDS = 2, 16


def clean_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v (array of double): rows whose vector is there, not all zero, and holds neither null nor non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False))).where(F.exists("v", lambda x: x != 0))


class Codebook:
    """Codewords by subspace, shape (subspaces, 16, 2)."""

    def __init__(self, words: np.ndarray, h: float):
        self.words, self.h = words, h

    @property
    def spaces(self) -> int:
        return len(self.words)

    def _split(self, x: np.ndarray) -> np.ndarray:
        pad = self.spaces * WIDTH - x.shape[1]
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), self.spaces, WIDTH)

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss; x holds unit vectors."""
        parts = self._split(x)
        codes = np.argmin(((parts[:, :, None] - self.words) ** 2).sum(-1), axis=2)
        taken = np.take_along_axis(self.words[None], codes[:, :, None, None], axis=2)[:, :, 0]
        along = ((parts - taken) * parts).sum(-1)  # parallel residual by subspace
        total = along.sum(1)
        for _ in range(passes):
            for m in range(self.spaces):
                rest = parts[:, m, None] - self.words[m]
                there = (rest * parts[:, m, None]).sum(-1)
                # |r|^2 + (h - 1) (r . x)^2 in all, of which only this subspace's share changes
                loss = (rest**2).sum(-1) + (self.h - 1) * ((total - along[:, m])[:, None] + there) ** 2
                best = np.argmin(loss, axis=1)
                new = there[np.arange(len(x)), best]
                total += new - along[:, m]
                along[:, m], codes[:, m] = new, best
        return codes.astype(np.uint8)

    def residual(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the codes miss of unit vectors: the part along the vector, and the length of the part across it."""
        rest = self._split(x) - np.take_along_axis(self.words[None], codes[:, :, None, None].astype(np.int64), axis=2)[:, :, 0]
        along = (rest * self._split(x)).sum((1, 2))
        return along, np.sqrt(np.maximum((rest**2).sum((1, 2)) - along**2, 0))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of queries with codewords, two subspaces together: (queries, bytes, 256)."""
        t = np.einsum("qmd,mkd->qmk", self._split(q), self.words)
        if t.shape[1] % 2:
            t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
        return (t[:, 0::2, None, :] + t[:, 1::2, :, None]).reshape(len(q), -1, WORDS * WORDS).astype(np.float32)


def bytes_of(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def train(x: np.ndarray, h: float = 4.0, rounds: int = 8, seed: int = 3) -> Codebook:
    """Codewords for unit vectors: assign by the anisotropic loss, then solve each subspace's weighted least squares."""
    rng = np.random.default_rng(seed)
    spaces = -(-x.shape[1] // WIDTH)
    pick = x[rng.choice(len(x), WORDS, replace=len(x) < WORDS)]
    book = Codebook(np.zeros((spaces, WORDS, WIDTH)), h)
    book.words = book._split(pick).transpose(1, 0, 2).copy()
    parts = book._split(x)
    for i in range(rounds):
        codes = book.encode(x, passes=0 if i < rounds // 2 else 1)
        plain = i < rounds // 2
        taken = np.take_along_axis(book.words[None], codes[:, :, None, None].astype(np.int64), axis=2)[:, :, 0]
        total = ((parts - taken) * parts).sum((1, 2))
        for m in range(spaces):
            along = ((parts[:, m] - taken[:, m]) * parts[:, m]).sum(-1)
            other = total - along
            for k in range(WORDS):
                at = codes[:, m] == k
                if not at.any():
                    book.words[m, k] = parts[rng.integers(len(x)), m]
                    continue
                p = parts[at, m]
                if plain:
                    book.words[m, k] = p.mean(0)
                else:
                    # minimise sum |p - c|^2 + (h - 1) (other + (p - c) . p)^2 over c
                    a = len(p) * np.eye(WIDTH) + (h - 1) * p.T @ p
                    b = p.sum(0) + (h - 1) * p.T @ (other[at] + (p**2).sum(-1))
                    book.words[m, k] = np.linalg.solve(a, b)
            taken[:, m] = book.words[m, codes[:, m]]
            total = other + ((parts[:, m] - taken[:, m]) * parts[:, m]).sum(-1)
    return book


def scaled(x: np.ndarray) -> np.ndarray:
    """Every row times a power of two that brings its largest component near 1, so that no square leaves the doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    x = scaled(np.stack(vectors.to_numpy())) if len(vectors) else np.empty((0, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def products(asks: np.ndarray, units: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Exact products where they are wanted, elsewhere -inf: pair by pair if they are few, else as a matrix."""
    out = np.full(wanted.shape, -np.inf)
    at, place = np.nonzero(wanted)
    if len(at) > wanted.size // 32:
        np.copyto(out, asks @ units.T, where=wanted)
    else:
        out[at, place] = np.einsum("nd,nd->n", asks[at], units[place])
    return out


def index(rows: DataFrame, books: dict[int, Codebook]) -> DataFrame:
    """Every row's unit vector and code: id, mark, width, unit and code (binary), along and across (the residual's parts); no code for lengths without a codebook."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for every in parts:
            for width, df in every.groupby("width"):
                x = _matrix(df["v"], width)
                along = across = np.zeros(len(x))
                coded = [None] * len(x)
                if width in books:
                    codes = books[width].encode(x)
                    along, across = books[width].residual(x, codes)
                    coded = [c.tobytes() for c in bytes_of(codes)]
                yield pd.DataFrame({"id": df["id"].to_numpy(), "mark": df["mark"].to_numpy(), "width": df["width"].to_numpy(), "unit": [u.tobytes() for u in x], "code": coded, "along": along, "across": across})

    return rows.select("id", "mark", "width", "v").mapInPandas(run, "id long, mark long, width int, unit binary, code binary, along double, across double")


def kept_of(rows: int, keep: int) -> int:
    """How many candidates a query keeps of so many indexed rows: ``keep``, and beyond 50,000 rows more by their square root.

    Measured ranks that the true neighbours take in the scan grow with about the cube root of the rows.
    """
    return max(keep, math.ceil(keep * math.sqrt(rows / 50_000)))


CODED = 16  # lengths of vectors, the commonest, that get a codebook
BLOCK = 1 << 19  # components of a block of candidates
CLOSE, LOOSE = 1e-12, 1e-5  # rounding of cosines, and of sums of table entries


def search(df: DataFrame, is_query, k: int = 5, keep: int = 200, fit_vectors: int = 10_000, block_rows: int = 8_192, query_rows: int = 4_096, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 3) -> DataFrame:
    """The ``k`` nearest rows by cosine of each row that ``is_query`` picks by its id, itself left out.

    Input: a long id and an array of numbers; other columns are ignored. Output: query_id, rank (from 1), vec_id, score
    (the exact cosine in double precision), nearest first, ties to the smaller id. Rows with a null id or a vector that
    is null, zero or holds null or non-finite components take no part. Vectors of different lengths have no cosine:
    each length is searched by itself. Fewer rows than ``k`` give all there are; no rows give no rows. A row that repeats
    an id with another vector is a row of its own, as query and as candidate; a row that repeats both counts once. The
    codebooks of the CODED commonest lengths learn from about ``fit_vectors`` rows each, rows of other lengths are scanned
    without codes; components may be as small or large as doubles are. Every row is indexed. The best ``keep`` of a scan,
    more if there are many rows (``kept_of``), are reranked, and so is every other row that its code does not exclude.
    """
    spark = df.sparkSession
    rows = vector_rows(clean_vectors(df, id_col, vector_col))
    counts = cut(rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query(F.col("id"))).alias("asked")))
    common = counts.orderBy(F.desc("n"), "width").limit(CODED).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = {}
    for r in common:
        own = rows.where(F.col("width") == r["width"]).select("id", "v")
        sample = own.where(drawn(min(1.0, fit_vectors / r["n"]), "id", "v", seed=seed)).toPandas()
        sample = sample if len(sample) else own.orderBy("id").limit(16).toPandas()
        sample = sample.assign(bytes=[np.asarray(v).tobytes() for v in sample["v"]]).sort_values(["id", "bytes"])
        books[r["width"]] = train(_matrix(sample["v"], r["width"]), seed=seed)

    # Equal vectors are one candidate, so that ties between any number of copies are settled exactly.
    once = cut(distinct_vectors(rows, k))
    blocks = cut(counts.select("width", F.ceil(F.col("n") / F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK) / F.col("width"))))).cast("int").alias("cbs"), F.greatest(F.lit(1), F.ceil(F.col("asked") / query_rows)).cast("int").alias("qbs"), "n"))
    most = blocks.agg(F.max("cbs").alias("cbs"), F.sum("n").alias("n")).first()
    few = F.broadcast(blocks.drop("n")) if blocks.count() <= 100_000 else blocks.drop("n")  # one row a length
    keep = kept_of(most["n"], keep)
    codes = cut(index(once, books).join(few, "width").withColumn("cb", F.pmod(F.xxhash64(F.lit(seed), "id", "mark"), F.col("cbs")).cast("int")))
    queries = rows.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), F.col("mark").alias("query_mark"), "width", "v")
    asked = cut(queries.join(few, "width").withColumn("qb", F.pmod(F.xxhash64(F.lit(seed + 1), "query_id", "query_mark"), F.col("qbs")).cast("int")))

    def kth(scores: np.ndarray) -> np.ndarray:
        """Of each row the score that the best ``k`` and the query itself reach."""
        return -np.partition(-scores, k, axis=1)[:, k] if scores.shape[1] > k else np.full(len(scores), -np.inf)

    def scan(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            width, ids, marks = int(q["width"].iloc[0]), c["id"].to_numpy(), c["mark"].to_numpy()
            units = np.frombuffer(b"".join(c["unit"]), np.float64).reshape(len(c), -1)
            book = books.get(width)
            if book is not None:
                by_byte = np.ascontiguousarray(np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1).T).astype(np.intp)
                along, across = c["along"].to_numpy(np.float32), c["across"].to_numpy(np.float32)
            for s in range(0, len(q), 64):
                some = q.iloc[s : s + 64]
                asks = _matrix(some["v"], width)
                floor = some["floor"].fillna(-np.inf).to_numpy(np.float64)
                if book is None:
                    exact = asks @ units.T
                    reach = exact >= np.maximum(floor, kth(exact))[:, None] - CLOSE
                else:
                    score = np.zeros((len(some), len(ids)), np.float32)
                    tables = book.tables(asks)
                    for j, row in enumerate(by_byte):
                        score += tables[:, j].take(row, axis=1)
                    n = min(keep, len(ids))
                    best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                    near = np.stack([units[b] @ a for a, b in zip(asks, best, strict=True)])
                    floor = np.maximum(floor, kth(near))
                    # No score below 0 excludes anything: there the bound need not rise with the score.
                    low = np.clip(floor, 0, 1)[:, None].astype(np.float32)
                    reach = (score >= low * (1 - along) - np.sqrt(1 - low * low) * across - LOOSE) | (floor[:, None] < 0)
                    np.put_along_axis(reach, best, True, axis=1)
                    exact = products(asks, units, reach)
                    reach &= exact >= np.maximum(floor, kth(exact))[:, None] - CLOSE
                for i in np.flatnonzero(reach.any(1)):
                    found = np.flatnonzero(reach[i])
                    found = found[np.lexsort((ids[found], -exact[i, found]))[:keep]]
                    out.append(pd.DataFrame({"query_id": some["query_id"].iloc[i], "query_mark": some["query_mark"].iloc[i], "id": ids[found], "mark": marks[found], "near": exact[i, found]}))
        found = pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "query_mark", "id", "mark", "near")})
        return found.astype({"query_id": "int64", "query_mark": "int64", "id": "int64", "mark": "int64", "near": "float64"})

    schema, query = "query_id long, query_mark long, id long, mark long, near double", ["query_id", "query_mark"]
    best = Window.partitionBy(*query).orderBy(F.desc("near"), "id", "mark")
    near, start = spark.createDataFrame([], schema), 0
    while start < most["cbs"]:
        stop = min(most["cbs"], max(1, 2 * start))
        floors = near.groupBy(*query).agg(F.when(F.count(F.lit(1)) > k, F.element_at(F.sort_array(F.collect_list("near"), False), k + 1)).alias("floor"))
        visits = asked.where(F.col("cbs") > start).join(floors, query, "left").withColumn("cb", F.explode(F.sequence(F.lit(start), F.least(F.col("cbs"), F.lit(stop)) - 1)))
        visited = codes.where(F.col("cb").between(start, stop - 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)))
        keys = ["width", "cb", "qb"]
        found = visits.groupBy(*keys).cogroup(visited.groupBy(*keys)).applyInPandas(scan, schema)
        near = cut(near.unionByName(found).withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep).drop("place"))
        start = stop
    return rerank(near.drop("near"), queries, once, k)


def rerank(pairs: DataFrame, queries: DataFrame, once: DataFrame, k: int) -> DataFrame:
    """Exact cosines of pairs of a query and a distinct vector, and the best ``k`` rows of each query."""

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.empty(len(a))
        length = a.map(len).to_numpy()
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            x, y = scaled(np.stack(a.iloc[at].to_numpy())), scaled(np.stack(b.iloc[at].to_numpy()))
            out[at] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
        return pd.Series(out)

    both = pairs.join(queries.select("query_id", "query_mark", F.col("v").alias("q")), ["query_id", "query_mark"]).join(once.select("id", "mark", "v"), ["id", "mark"])
    return best_of(both.select("query_id", "query_mark", "id", "mark", cosine("q", "v").alias("score")), once, k)
