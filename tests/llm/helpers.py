"""Edge-case tables and plain Python counterparts of the training-data operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000)) + "\n" + "la " * 5000

EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one two three four five six seven eight nine ten", "en", None, 10),
    (3, "one two three four five six seven eight nine ten", "en", None, 10),  # repeated row
    (3, "another text under the same id, of some more words than that", "en", "b", 10),
    (None, "no id here but words all the same, enough of them to be a line", "fr", "b", 1),
    (4, " \t\n\r ", "de", "a", 5),
    (5, LONG, "en", "a", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),  # tie with 5
    (7, "é ü ñ 你好 \U0001F600 naïve\u00a0space", "fr", "c", 5),
    (8, "a", "en", "c", 1),
    (9, "1234 5678 !!", None, "c", 3),
]


def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark, df=None):
    """Extra columns named like results, like helpers, and like inputs in another case."""
    from pyspark.sql import functions as F

    df = edge(spark) if df is None else df
    extra = ["TEXT", "Doc_Id", "n_words", "size", "taken", "target", "kept", "group", "k", "x", "pos", "line", "_0", "_1", "_value",
             "spans", "items", "n_hit", "component_id", "n_lines", "h1", "lang_pred", "score", "ref", "path", "rule"]
    for i, name in enumerate(extra):
        df = df.select("*", F.lit(f"extra{i}").alias(name))
    return df


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def as_multiset(rows):
    return sorted(map(repr, rows))
