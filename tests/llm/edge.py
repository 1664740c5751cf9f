"""A small table of documents with everything that may go wrong: nulls, empty and very long texts, repeated rows, clashing columns."""

LONG = " ".join(f"word{i % 977} the and you" for i in range(12_000))
ROWS = [
    (1, "The cat sat on the mat and looked at you all day long.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "12 34 !? ... --", "de", "b"),
    (5, LONG, "en", "b"),
    (6, LONG, "en", "b"),
    (6, LONG, "en", "b"),
    (None, "a row without an id", "en", None),
    (7, "Der Hund und die Katze sind nicht da, sagte sie dann.", "de", "a"),
    (8, "x", "de", None),
    (9, "İstanbul don't ''s é <|endoftext|> naïve ½ ٣ 日本語\u0301 \x85 a\x1cb", None, "c"),
    (10, "all rights reserved. CC BY-NC 4.0 licensed under the GNU General Public License, version 3", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators might use themselves.
CLASHES = ["key", "salt", "n", "id", "size", "bucket", "block", "shard", "score", "label", "vertex", "mass", "words", "present", "count", "value", "no", "mark", "number", "held_out", "a.b", "x`y.z"]


def documents(spark, rows=ROWS):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def nothing(spark):
    return documents(spark).limit(0)
