"""Small inputs with what no operator may trip over."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it was for on as with his they at be this from have".split()


def prose(seed: int, words: int) -> str:
    """Words that repeat from seed to seed, in an order of their own."""
    return " ".join(f"{WORDS[(seed * 7 + n * n + n * seed) % len(WORDS)]}{(seed * 31 + n * 17) % 97}" for n in range(words))


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]), with columns whose names operators might use themselves."""
    full = [(*row, *("en", "s0")[len(row) - 2 :], None if row[1] is None else len(row[1])) for row in rows]
    df = spark.createDataFrame(full, SCHEMA)
    clashing = ("score", "lang_pred", "cid", "bucket", "size", "rank", "rest", "digest", "_slot", "taken", "spans", "toxic")
    return df.withColumns({name: F.lit("clash") for name in clashing})


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "!!! ... 123"), (None, "some words here"), (5, "x" * 200_000), (6, "a"), (6, "a")]
