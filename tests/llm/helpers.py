"""Small document tables with columns whose names clash with those that operators make."""

EXTRA = ["score", "shard", "start", "length", "kept", "size", "word", "n", "_row", "_cell", "held_out", "lang_pred", "sequence_id", "region"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=True):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in EXTRA])
    return df


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, "one two three four five six seven"), (5, "one two three four five six seven"), (6, "word " * 40_000), (None, "no id here at all"), (7, "ÄÖÜ ß 漢字 \u0000 🙂"), (8, "one two three four five six seven")]
