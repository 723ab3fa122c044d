"""Text scalars as Column -> Column functions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt patterns whose first group is the field.
MEETING_DATE_PATTERNS = [
    r"(?i)meeting on \*\*(\d{4}-\d{2}-\d{2})(?: \d{2}:\d{2}:\d{2})?\*\*",
    r"(?i)for the \*\*(\d{4}-\d{2}-\d{2})(?: \d{2}:\d{2}:\d{2})?\*\* meeting",
]
SECTION_PATTERNS = [r"(?is)tone and style of the \*\*(.*?)\*\* section"]
TOPIC_PATTERNS = [r"(?is)recent trends in \*\*(.*?)\*\* and related indicators"]
RATE_PATTERNS = [r"(?i)stands at \*\*([0-9.]+)%\*\*", r"(?i)is \*\*([0-9.]+)%\*\*"]
# Coarse labels by prefix.
COARSE_PREFIXES = [("Raise", "Raise"), ("Cut", "Cut"), ("No change", "No change")]
# Month names of dates such as Mar-2001.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# UTF-8 read as Latin-1, and what was meant.
MOJIBAKE = [("â€™", "’"), ("â€œ", "“"), ("â€“", "–"), ("Â", "")]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def meeting_date(c: Column) -> Column:
    """Blank for null, else the first ten characters of the trimmed text."""
    return F.substring(strip(F.coalesce(c.cast("string"), F.lit(""))), 1, 10)


def parse_date(c: Column) -> Column:
    """Quarter, month, compact, ISO and Mon-YYYY dates; null for anything else.

    Year-and-quarter texts (2020Q1) give the quarter's first day.
    """
    t = strip(c)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(t, 1, 3))).cast("int")
    year = F.substring(t, 1, 4).cast("int")
    return (
        F.when(t.rlike(r"^\d{4}Q[1-4]$"), F.make_date(year, F.substring(t, 6, 1).cast("int") * 3 - 2, F.lit(1)))
        .when(t.rlike(r"^\d{4}M(0[1-9]|1[0-2])$"), F.make_date(year, F.substring(t, 6, 2).cast("int"), F.lit(1)))
        .when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(t, "yyyyMMdd"))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10).try_cast("date"))
        .when(t.rlike(r"(?i)^[a-z]{3}-\d{4}$") & (month > 0), F.make_date(F.substring(t, 5, 4).cast("int"), month, F.lit(1)))
    )


def first_match(c: Column, patterns: Sequence[str], fallback: Column | None = None) -> Column:
    """The fallback unless blank, else the trimmed group of the first pattern that matches, else blank."""
    tries = [F.nullif(strip(F.regexp_extract(c, p, 1)), F.lit("")) for p in patterns]
    first = [F.nullif(strip(fallback), F.lit(""))] if fallback is not None else []
    return F.coalesce(*first, *tries, F.lit(""))


def last_match(c: Column, patterns: Sequence[str]) -> Column:
    """The trimmed group of the last of all patterns' matches, in pattern order; blank without one."""
    every = F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns))
    return F.when(F.size(every) > 0, strip(F.element_at(every, -1))).otherwise(F.lit(""))


def block(c: Column, start: str, end: str) -> Column:
    """Trimmed text between two literal marks (first start, nearest end), blank if either is absent."""
    rest = F.regexp_extract(c, "(?s)" + _quote(start) + "(.*?)" + _quote(end), 1)
    return strip(rest)


def _quote(s: str) -> str:
    return "".join("\\" + x if x in r"\.[]{}()*+-?^$|" else x for x in s)


def coarse_vote(c: Column, unknown: str = "Invalid") -> Column:
    t, out = strip(F.coalesce(c, F.lit(""))), None
    for prefix, label in COARSE_PREFIXES:
        out = F.when(t.startswith(prefix), F.lit(label)) if out is None else out.when(t.startswith(prefix), F.lit(label))
    return out.otherwise(F.lit(unknown))


def rate_change_label(bp: Column) -> Column:
    """Within 12 bp no change; else the largest of 100, 75, 50, 25 not above the size, 25 at least."""
    size = F.abs(bp)
    step = F.when(size >= 100, 100).when(size >= 75, 75).when(size >= 50, 50).otherwise(25)
    return F.when(size <= 12, F.lit("No change")).when(bp > 0, F.concat(F.lit("Raise "), step.cast("string"), F.lit("bp"))).when(bp < 0, F.concat(F.lit("Cut "), step.cast("string"), F.lit("bp")))


def boxed_vote(c: Column) -> Column:
    """The first boxed group after the last closing think tag."""
    tail = F.element_at(F.split(c, "</think>"), -1)
    return strip(F.regexp_extract(tail, r"(?s)\\boxed\{(.*?)\}", 1))


def fix_mojibake(c: Column) -> Column:
    for bad, good in MOJIBAKE:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return F.trim(F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"\s+", " "))


def canonical(c: Column, names: dict[str, str]) -> Column:
    """Collapsed white space, then the map's name for the lower-cased text, if any."""
    t = F.trim(F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"\s+", " "))
    found = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.element_at(found, F.lower(t)), t)


def words_count(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def split_top_level(c: Column) -> Column:
    """Parts between commas that stand outside parentheses, trimmed, without blanks."""
    parts = F.transform(F.split(c, r",(?![^()]*\))"), lambda x: strip(x))
    return F.filter(parts, lambda x: x != "")


def table_metrics(c: Column) -> Column:
    """Counts over runs of lines that start with a pipe: tables, those with a data row, those of header only.

    A divider is a line of pipes, dashes, colons and blanks; data rows are what follows
    header and divider.
    """
    lines = F.split(c, "\n")
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("marks"), F.lit(0).alias("tables"), F.lit(0).alias("data"), F.lit(False).alias("divider"))

    def close(s):
        rows = s["run"] - F.when(s["divider"], 1).otherwise(0) - 1
        return s["tables"] + F.when(s["run"] > 0, 1).otherwise(0), s["data"] + F.when((s["run"] > 0) & (rows > 0), 1).otherwise(0)

    def step(s, line):
        mark = F.ltrim(line).startswith("|")
        div = mark & F.ltrim(line).rlike(r"^[|\-: \t]+$") & F.contains(line, F.lit("-"))
        tables, data = close(s)
        return F.struct(
            F.when(mark, s["run"] + 1).otherwise(0).alias("run"),
            s["marks"].alias("marks"),
            F.when(mark, s["tables"]).otherwise(tables).alias("tables"),
            F.when(mark, s["data"]).otherwise(data).alias("data"),
            F.when(mark, s["divider"] | div).otherwise(F.lit(False)).alias("divider"),
        )

    def finish(s):
        tables, data = close(s)
        return F.struct(tables.alias("table_count"), data.alias("data_table_count"), (tables - data).alias("header_only_table_count"))

    return F.aggregate(lines, start, step, finish)


def count_pattern(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda's variable is not evaluated again for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words joined by blanks; none for shorter arrays."""

    def body(w):
        count = F.size(w) - (n - 1)
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(words, body)


def repetition_rate(words: Column, n: int) -> Column:
    """1 - distinct / all n-grams; 0 without any."""
    return let(ngrams(words, n), lambda g: F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def periodic_tail(ids: Column, low: int = 16, high: int = 128, repeats: int = 3) -> Column:
    """Whether the last `repeats` periods of some length low to high are equal."""

    def holds(ids, p):
        n = F.size(ids)
        tail = lambda k: F.slice(ids, F.greatest(n - p * (k + 1) + 1, F.lit(1)), p)
        same = F.lit(True)
        for k in range(1, repeats):
            same = same & (tail(0) == tail(k))
        return (n >= p * repeats) & same

    return let(ids, lambda own: F.exists(F.sequence(F.lit(low), F.lit(high)), lambda p: holds(own, p)))


def hex_mod(hex_text: Column, modulus: int) -> Column:
    """A hexadecimal text as a whole number modulo `modulus`, folded digit by digit."""
    digits = F.transform(F.split(hex_text, ""), lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1)
    return F.aggregate(F.filter(digits, lambda d: d >= 0), F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % modulus)


def release_evidence(df, html: str, day: str):
    """Adds evidence, release_date and lag_days to pages of a calendar.

    Only what follows the link of the exact day's minutes, up to the end of its paragraph,
    counts; one date there is the release, several different ones are ambiguous.
    """
    link = F.concat(F.lit(r'(?is)<a\s[^>]*href="[^"]*minutes'), F.date_format(day, "yyyyMMdd"), F.lit(r'\.html?"[^>]*>[^<]*</a>(.*?)</p>'))
    own = F.regexp_extract_all(F.col(html), link, F.lit(1))
    said = F.flatten(F.transform(own, lambda x: F.regexp_extract_all(x, F.lit(r"(?i)released\s+([a-z]+ \d{1,2}, \d{4})"), F.lit(1))))
    dates = F.array_distinct(F.transform(said, lambda x: F.to_date(x, "MMMM d, yyyy")))
    kind = F.when(F.size(own) == 0, "none").when(F.size(dates) == 0, "link only").when(F.size(dates) > 1, "ambiguous").otherwise("released")
    out = df.withColumn("evidence", kind).withColumn("release_date", F.when(F.col("evidence") == "released", F.element_at(dates, 1)))
    return out.withColumn("lag_days", F.datediff("release_date", day))
