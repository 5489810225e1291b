"""Small documents tables with the odd cases that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string, doc string"
#: Eighty words that differ.
LONG = " ".join(f"wort{i:03d}" for i in range(80))
ODD = [
    (1, None, None, None, None, "x", "y"),
    (2, "", "en", "s", 0, None, None),
    (None, "alpha beta gamma delta epsilon zeta", "en", None, 5, "x", "y"),
    (4, LONG, "de", "s", 9, "x", "y"),
    (4, LONG, "de", "s", 9, "x", "y"),
    (5, LONG + " und mehr", "de", "t", 9, "x", "y"),
    (6, "Ünïcödé — ẞ 漢字 \U0001f600 \n\t!!", "fr", "s", 9, "x", "y"),
    (7, ("viel text ohne ende " * 4000).strip(), "de", "s", 80000, "x", "y"),
    (8, "!!! *** ...", "en", "s", 3, "x", "y"),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
