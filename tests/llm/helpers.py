"""Small tables and plain-Python versions of what the operators compute."""
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside; a table may have them too
CLASH = ["node", "key", "_row", "row", "size", "target", "base", "label", "x", "_d", "_k", "_t", "shard", "word",
         "c", "text_key", "u", "n", "kind", "rule", "p_block", "_h", "url"]

WORDS = ("ring lake moss stone river cloud field amber north winter paper glass copper orchard candle meadow "
         "harbour lantern thistle velvet marble sparrow timber willow ember hollow").split()


def prose(n: int, seed: int) -> str:
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = prose(30_000, 5)
    return [(0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, "  \n\t ", "de", "b", 4), (3, prose(60, 1), None, "b", None),
            (4, prose(60, 1), "en", None, 400), (5, long, "en", "a", len(long)), (6, prose(3, 2), "en", None, 20),
            (7, prose(40, 3), "en", "c", 200), (7, prose(40, 3), "en", "c", 200), (7, prose(40, 4), "en", "c", 200),
            (None, prose(40, 6), "en", "c", 200), (None, None, None, None, None), (8, "x" * 50_000, "en", "c", 50_000),
            (9, "été ñandú 漢字 😀 " + prose(30, 9), "fr", "d", 90)]


def table(spark, rows=None, clash=False, schema=DOCS):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows() if rows is None else rows, schema)
    for name in CLASH if clash else []:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


def blank_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def alnum_words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
