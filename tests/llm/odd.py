"""Small odd inputs that every text operator must take."""

LONG = "Lorem ipsum dolor. " * 30_000
TEXTS = [
    None, "", " ", "\x00\x01", "a", "Same words here again", "SAME words here again", "same words here again",
    "éÉ ünï ß", "x " * 400, LONG, "The cat sat on the mat and looked at the moon.", "The cat sat on the mat and looked at the sun.",
]


def documents(spark, texts=TEXTS, ids=None):
    """Texts as documents, with clashing extra columns and nulls in every other column."""
    ids = ids or range(len(texts))
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else f"src{i % 4}", None, 7, "z") for i, t in zip(ids, texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long, w string"
    df = spark.createDataFrame(rows, schema)
    for c in ("fp", "h", "tag", "score", "rank", "_row", "mix_slot", "start", "count"):
        df = df.withColumn(c, df["n"])
    return df
