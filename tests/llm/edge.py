"""Odd documents that every operator must handle."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, block string, path string, node string, h1 double, words string, tokens string, toxic string, target string, rank string, run string, kept string, mix_shard string, tox_score string, word string, place string"


def odd_documents(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and columns with clashing names."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\n ", "en", None, 5), (4, "word " * 60_000, "en", "a", 300_000), (5, "x" * 200_000, None, "a", 200_000), (6, "Same line here\nother", "de", "b", 20),
        (7, "Same line here\nother", "de", "b", 20), (7, "Same line here\nother", "de", "b", 20), (None, "no id but words", "en", "b", 15), (8, "é ü 漢字 😀 ​\n\n#", "fr", "", 12), (9, "a b c", "en", "a", 5), (10, "A B C", "en", "a", 5),
    ]
    return spark.createDataFrame([(*r, *[None if i % 2 else x for i, x in enumerate((5, "b", "p", "n", 0.5, "w", "t", "t", "g", "r", "u", "k", "m", "x", "v", "c"))]) for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def shared_ids(spark, parts=3):
    """Different texts under one id, equal rows, and rows without an id, some of them equal."""
    words = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(6)]
    rows = [(0, words[0]), (1, words[0] + " " + words[1]), (1, words[2]), (1, words[2]), (1, None), (None, words[0]), (None, words[3]), (None, words[3]), (2, words[3] + "\nshared line of all"), (3, "shared line of all"), (3, "shared line of all\nand more")]
    return spark.createDataFrame([(i, t, "en", "ab"[len(t or "") % 2], len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
