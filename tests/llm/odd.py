"""A small table of documents with everything odd in it; extra columns clash with names that operators use."""

LONG = " ".join(f"w{i % 977}q{i % 31}" for i in range(60_000))
TEXTS = [
    None, "", "   \t\n", "one", "a b c d e f g", "É À ß ñ 漢字 \U0001f600 mixed", LONG, LONG, "same text here", "same text here", "\n\n\n",
    "x" * 5000, "tail \x0b\x0c\r end", "Idiot idiot IDIOT", "= : </a> '\"", "🙂" * 300, "   　x",
]
ROWS = [(i, t, "en" if i % 2 else None, "k", i, 1.5, "t", i) for i, t in enumerate(TEXTS)] + [
    (8, "same text here", "en", "k", 8, 1.5, "t", 8), (None, "nobody owns this text", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, key string, n_chars long, score double, words string, id long"


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(rows):
    return sorted(map(tuple, rows), key=str)
