"""Text, number-format, date and JSON expressions.

All are Catalyst expressions (no Python UDFs), so they run inside
whole-stage codegen next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Character replacements applied before the Latin-1 fallback,
# in the reference's order.
SANITIZE_REPLACEMENTS = [
    ("•", "-"),      # bullet
    ("–", "-"),      # en dash
    ("—", "--"),     # em dash
    ("‘", "'"),      # left single quote
    ("’", "'"),      # right single quote
    ("“", '"'),      # left double quote
    ("”", '"'),      # right double quote
    ("…", "..."),    # ellipsis
    ("°", " deg"),   # degree sign
]
NON_LATIN1 = "[^\\x{0}-\\x{FF}]"


#: JSON records name every field, also those that are null
KEEP_NULLS = {"ignoreNullFields": "false"}


def py_fixed(x: Column, digits: int) -> Column:
    """Python ``f"{x:.{digits}f}"`` for a double.

    Python rounds the exact binary value half-to-even. Java's ``%.nf``
    (``format_string``) rounds the shortest decimal repr half-up instead
    (0.15 -> "0.2" vs Python "0.1"); ``format_number`` (DecimalFormat,
    HALF_EVEN on the exact value) agrees with Python, so it is used with its
    grouping separators removed.
    """
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def minutes_text(x: Column) -> Column:
    """F10 ``f"{x:.1f} min"``."""
    return F.concat(py_fixed(x, 1), F.lit(" min"))


def percent_text(ratio: Column) -> Column:
    """F10 ``f"{ratio*100:.1f}%"``."""
    return F.concat(py_fixed(ratio * 100, 1), F.lit("%"))


def thousands(x: Column) -> Column:
    """F10 ``f"{n:,}"`` for an integer."""
    return F.format_number(x.cast("bigint"), 0)


def iso_date(d: Column) -> Column:
    """F11 ``isoformat()`` / ``strftime('%Y-%m-%d')`` of a date."""
    return F.date_format(d, "yyyy-MM-dd")


def config_json(c: Column) -> Column:
    """F12 ``json.dumps(config or {})``: absent config -> '{}'."""
    return F.coalesce(c, F.lit("{}"))


def config_value(c: Column, path: str, type_: str = "string") -> Column:
    """F12 read a field of the JSON config (variant path, e.g. ``$.line``)."""
    return F.variant_get(F.parse_json(config_json(c)), path, type_)


def sanitize_text(c: Column) -> Column:
    """F13 nine Unicode -> ASCII replacements, then any other character
    outside Latin-1 becomes '?' (one per code point)."""
    out = c.cast("string")
    for src, dst in SANITIZE_REPLACEMENTS:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return F.regexp_replace(out, NON_LATIN1, "?")


# Python ``str.strip()`` whitespace (Unicode spaces + ASCII separators).
_PY_SPACE = "[\\s\\x{1C}-\\x{1F}\\x{85}\\p{Z}]"


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_PY_SPACE}+|{_PY_SPACE}+$", "")


def text_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  intro: str = "introduction") -> DataFrame:
    """F15 split each text into numbered sections -> (id, section, content, idx).

    A line whose stripped text starts with ``1.`` .. ``5.`` opens a section
    keyed by the text after its first dot (stripped, lower-cased); lines
    before the first header form ``introduction``. A section with no lines
    is dropped; a repeated key keeps the last non-empty one.

    Work stays within a row: header places are found in the split array, each
    section is a slice of it, and no line is ever shuffled.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    header = F.filter(F.transform("_lines", lambda x, i: F.when(py_strip(x).rlike("^[1-5]\\."), i)),
                      lambda i: i.isNotNull())

    def section(at, idx):
        """The section opened by line ``at`` (-1: the lines before any header)."""
        after = F.coalesce(F.get("_at", idx + 1), F.size("_lines"))
        key = F.lower(py_strip(F.regexp_extract(py_strip(F.get("_lines", at)), "(?s)^[^.]*\\.(.*)$", 1)))
        return F.struct(F.when(idx == 0, F.lit(intro)).otherwise(key).alias("section"),
                        F.slice("_lines", at + 2, after - at - 1).alias("body"), idx.alias("idx"))

    filled = F.filter(F.transform("_at", section), lambda x: F.size(x["body"]) > 0)
    last = F.filter("_all", lambda x: ~F.exists("_all", lambda y: (y["section"] == x["section"]) & (y["idx"] > x["idx"])))
    return (docs.select(id_col, lines.alias("_lines")).filter("_lines IS NOT NULL")
            .withColumn("_at", F.concat(F.array(F.lit(-1)), header))
            .withColumn("_all", filled).select(id_col, F.explode(last).alias("_s"))
            .select(id_col, "_s.section", F.array_join("_s.body", "\n").alias("content"),
                    F.col("_s.idx").cast("bigint").alias("idx")))


def sections_map(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """F15 the ``sections`` dict as a ``MapType`` column per document."""
    return (sections.groupBy(id_col)
            .agg(F.map_from_entries(F.collect_list(F.struct("section", "content")))
                 .alias("sections")))
