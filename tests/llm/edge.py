"""Documents with every awkward shape: nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, finds string, kinds string, n_pii long, pass int, shard int, digest string, norm string, key string, fp long, block int"
LONG = "the quick brown fox jumps over the lazy dog and runs away again " * 4000


def docs(spark, extra=()):
    texts = [
        (1, "Hello big wide world of words\nLicensed under the MIT License.\nshared line of text", "en", "b"),
        (2, "hello  big wide world of words Licensed under the MIT License. shared line of text", "en", None),
        (3, None, None, None),
        (4, "", "de", "a"),
        (None, "a row without an id\nshared line of text", None, "a"),
        (None, "a row without an id\nshared line of text", None, "a"),
        (5, LONG, "en", "é"),
        (6, LONG + "x", None, "b"),
        (7, "same same", "fr", "b"),
        (7, "same same", "fr", "b"),
        (8, "\n\n \t\n", "fr", "c"),
        (9, "12345 !!! 67890", "en", "c"),
        (10, "Ünïcode ÀÉÎ text\x0bwith\x1ccontrols \U0001f600 und mehr", "de", "c"),
        *extra,
    ]
    filler = ("f", "k", 5, 6, 7, "d", "n", "y", 8, 9)
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *filler) for i, t, lang, s in texts], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def real(spark, sf_dir, table="documents"):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
