"""Small tables that hold the awkward rows every operator must survive."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write_docs(spark, folder, rows):
    """rows: (doc_id, text, lang, source). Writes documents.parquet and returns its folder."""
    data = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    spark.createDataFrame(data, DOC_SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def awkward_rows():
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n ", "en", "a"),
        (4, "the cat sat on the mat " * 3000, "en", "b"),
        (5, "été <|endoftext|> déjà\x1c vu　中文 aaa aaaa 's", None, "b"),
        (6, "été <|endoftext|> déjà\x1c vu　中文 aaa aaaa 's", "fr", None),
        (6, "été <|endoftext|> déjà\x1c vu　中文 aaa aaaa 's", "fr", None),
        (8, "one", "en", "é"),
    ]
