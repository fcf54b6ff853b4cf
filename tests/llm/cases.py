"""Small tables with the awkward cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, label int, size long, print long, component_id long, spans string, doc string"


def documents(spark, texts, ids=None, sources=None):
    """Documents with columns whose names operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [(i, t, None, s, None if t is None else len(t), 1, 2, 3, 4, 5, "x", "y") for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts(rng):
    """Empty, blank, repeated, very long and many-byte texts, and texts without white space."""
    words = ["ab", "cd", "efg", "é", "日本", "x" * 40, "Token", "in", "the"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    return [None, "", " \n\t", "word", same, same, long, long + " end", "z" * 30_000, "é" * 5_000, "a b c d", same.upper(), "tail " + same]
