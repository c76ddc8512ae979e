"""Small tables with the awkward cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, score string, row int, _doc int"
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
BASE = " ".join(f"tok{i}" for i in range(60))
NEAR = BASE.replace("tok30", "other")
AWKWARD = [
    (1, BASE),
    (2, NEAR),
    (3, BASE),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, LONG),
    (8, LONG + " end"),
    (9, "one two three"),
    (10, "One TWO three"),
    (11, "Éa ßo 日本 語 🙂 tok1 tok2"),
    (None, BASE),
    (None, None),
    (1, BASE),
    (12, "a"),
    (-3, "unrelated words that nobody else has written here " * 3),
]


def docs(spark, rows=AWKWARD):
    """Documents with columns whose names the operators use themselves."""
    sources = ["b", None, "a", ""]
    full = [(i, t, "en", sources[k % 4], None, 9, "x", "y", k, k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def words(text):
    return (text or "").encode().lower().split()
