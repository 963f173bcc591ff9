"""Small tables with the awkward rows every operator has to take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0 if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
