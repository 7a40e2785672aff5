"""Small tables with the awkward rows that every operator must stand."""

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
# Extra columns whose names clash with columns that operators make.
CLASHING = "fp string, component string, key_a long, _key_a long, n long, epoch string, lang_pred string, first string, pos int"


def documents(spark, rows):
    full = [(i, t, lang, s, len(t or ""), "x", "y", 1, 2, 3, "e", "p", "f", 4) for i, t, lang, s in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


def awkward(spark):
    long = "word after word and line after line " * 3000
    return documents(
        spark,
        [
            (1, None, "en", "a"), (2, "", "en", None), (3, " \n \t ", None, "b"), (4, "the same text of some words", "en", "a"),
            (4, "the same text of some words", "en", "a"), (5, "the same text of some words", "de", "b"), (None, "no id at all here", "en", None),
            (6, long, "en", "c"), (7, "x" * 5000, "en", "c"), (8, "日本語 テキスト and мир 123 !!!", None, "d"), (9, "0123456789 " * 50, None, "d"),
        ],
    )


def sf(spark, name, scale="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{scale}/{name}.parquet")
