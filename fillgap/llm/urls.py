"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the URLs that no rule fits."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgap.llm.common import cut, drawn
from fillgap.llm.licences import LOWER, UPPER

#: (verdict, host, path): fits the host and its subdomains where the URL's path starts with the path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

FEATURES = ["n_chars", "host_chars", "path_chars", "labels", "depth", "digits", "entropy", "params", "dashes", "secure", "suffix1", "suffix2"]


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first ``://``; both empty for null or where that is missing."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, at, below in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(below)
        name, verdict = F.when(fits, F.lit(at + below)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features of ``url`` alone; host and path have to be there."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)

    def times(c: Column, pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern))

    def bits(c: Column) -> Column:
        share = (n - F.length(F.replace(url, c, F.lit("")))) / n
        return -share * F.log2(share)

    chars = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")
    return df.withColumns(
        {
            "n_chars": n.cast("double"), "host_chars": F.length("host").cast("double"), "path_chars": F.length("path").cast("double"),
            "labels": times(F.col("host"), r"[^.]+").cast("double"), "depth": times(F.col("path"), r"/+[^/]").cast("double"),
            "digits": F.when(n > 0, times(url, "[0-9]") / n).otherwise(0.0), "entropy": F.aggregate(F.transform(chars, bits), F.lit(0.0), lambda a, b: a + b),
            "params": times(url, r"[?&][^=&#]+=").cast("double"), "dashes": times(url, r"[-_]").cast("double"), "secure": F.coalesce(url.startswith("https:"), F.lit(False)).cast("double"),
            "s1": F.substring_index("host", ".", -1), "s2": F.substring_index("host", ".", -2),
        }
    )


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """Labelled rows (n) and blocks among them (b) by s1, s2 and fold, of rows with these and label. Each task shuffles one row a group."""
    return cut(labelled.groupBy("s1", "s2", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("b")))


def with_suffixes(df: DataFrame, counts: DataFrame, held: bool, small: int = 200_000) -> DataFrame:
    """Adds suffix1 and suffix2, the smoothed shares of blocks; ``held``: without the rows of the row's own fold. No labelled row gives 0.5.

    Leaving out just the row itself would tell the trees its label: a suffix with both would have two values, one for
    each label. Counts of up to ``small`` suffixes are broadcast; more are joined by a shuffle.
    """

    def joined(df: DataFrame, keys: list[str], n: str, b: str) -> DataFrame:
        table = cut(counts.groupBy(*keys).agg(F.sum("n").alias(n), F.sum("b").alias(b)))
        table = F.broadcast(table) if table.count() <= small else table.hint("shuffle_merge")
        return df.join(table, keys, "left").fillna(0, [n, b])

    for i in (1, 2):
        df, n, b = joined(df, [f"s{i}"], "__n", "__b"), F.col("__n"), F.col("__b")
        if held:
            df, n, b = joined(df, [f"s{i}", "fold"], "__own_n", "__own_b"), n - F.col("__own_n"), b - F.col("__own_b")
        df = df.withColumn(f"suffix{i}", (b + 1) / (n + 2)).drop("__n", "__b", "__own_n", "__own_b")
    return df


def sample_shares(counts: dict[str, int], fit_urls: int) -> dict[str, float]:
    """What share of each verdict's URLs makes about ``fit_urls`` in all, a tenth of that for the rarer verdict at least."""
    total = sum(counts.values())
    return {verdict: min(1.0, max(fit_urls / total, fit_urls / 10 / n)) for verdict, n in counts.items()}


def judge(pages: DataFrame, rules=RULES, fit_urls: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """Allow or block every URL.

    Input: page_id, url; other columns are ignored. Output, one row for every input row: page_id, host, path, rule (null
    where none fits), verdict, score (how likely the trees hold a block; 0 or 1 where a rule decides). The trees learn
    from at most about ``fit_urls`` URLs that rules label, drawn by a hash, a tenth of them at least for the
    rarer verdict and weighted so that it counts as it occurs; suffix statistics are the share
    of blocks among all labelled rows with the same last one or two host labels; for a row that trains, of those in the other nine
    tenths of the URLs. Null or malformed URLs have empty host and path
    and are judged by the trees. Without labelled URLs of both verdicts there are no trees, and the verdict is the one
    that occurs, or allow. Repeated rows are judged alike; no rows give no rows.
    """
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", verdict)
    counts = dict(rows.where("said is not null").groupBy("said").count().collect())
    features = lexical(rows)
    shares = sample_shares(counts, fit_urls)
    share = F.when(F.col("said") == "block", shares.get("block", 1.0)).otherwise(shares.get("allow", 1.0))
    fit = features.where(F.col("said").isNotNull() & drawn(share, "page_id", "url", seed=seed))
    fit = cut(fit.withColumn("label", (F.col("said") == "block").cast("double")).withColumn("weight", F.lit(min(shares.values(), default=1.0)) / share))
    if len(counts) < 2:
        only = "block" if set(counts) == {"block"} else "allow"
        out = rows.withColumn("score", F.lit(float(only == "block")))
    else:
        fold = F.pmod(F.xxhash64(F.lit(seed + 1), "url"), F.lit(10))
        labelled = features.where(F.col("said").isNotNull()).select("s1", "s2", fold.alias("fold"), (F.col("said") == "block").cast("double").alias("label"))
        counted = suffix_counts(labelled)
        vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        train = cut(with_suffixes(fit.withColumn("fold", fold), counted, held=True).select("label", "weight", *FEATURES))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, weightCol="weight", seed=seed).fit(vector.transform(train).coalesce(8))
        out = model.transform(vector.transform(with_suffixes(features, counted, held=False))).withColumn("score", vector_to_array("probability")[1])
    blocked = F.when(F.col("said").isNotNull(), F.col("said") == "block")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.coalesce(blocked.cast("double"), F.col("score")).alias("score"),
    )
