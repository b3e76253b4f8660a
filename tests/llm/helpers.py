"""Small document tables with the odd cases: nulls, empty and long texts, repeats, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=True):
    """rows: (doc_id, text[, source]); with ``extra`` there are columns that operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.selectExpr("*", "'x' AS score", "1 AS component_id", "2 AS size", "'k' AS h", "0 AS gone", "'w' AS word") if extra else df


ODD = [(None, "null id text here"), (1, None), (2, ""), (3, " \t\n "), (4, "word " * 30000), (5, "same text twice"), (5, "same text twice"), (6, "ÄÖÜ ñandú 漢字\x00 a b")]
