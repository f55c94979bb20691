import random

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def edge_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "été", "größe", "日本", "mit", "license", "x1", "</s>", "end."]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    data = [
        (1, "one two three four five six", "en", "a", 27, 7, 7),
        (2, "one two three four five six", "en", "a", 27, None, 7),
        (2, "one two three four five six", "en", "a", 27, None, 7),
        (3, "", "en", None, 0, 1, None),
        (4, None, None, None, None, 1, 1),
        (None, "no key here", "de", "b", 11, 1, 1),
        (None, None, None, None, None, None, None),
        (5, long, "fr", "b", len(long), 1, 1),
        (6, " \t\n\x0b ", "fr", "c", 5, 1, 1),
        (7, "emoji 😀 and é   nbsp", "xx", "c", 20, 1, 1),
        (8, "word", "en", "d", 4, 2, 2),
    ]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, taken bigint")
