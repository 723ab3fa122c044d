"""Quality flags, gates with reasons, and label handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names that make a section title date-like.
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"


def abnormal_section(c: Column, fixed_titles: tuple[str, ...] = ()) -> Column:
    """Date-like titles, meetings held by video, and given titles."""
    t = F.lower(F.trim(c))
    out = t.rlike(rf"^({_MONTHS}) \d{{1,2}}, \d{{4}}") | t.contains("videoconference meeting")
    return out | t.isin(*map(str.lower, fixed_titles)) if fixed_titles else out


def abnormal_topic(c: Column, allowed: list[str]) -> Column:
    return ~c.isin(*allowed)


def with_flags(df: DataFrame, flags: list[tuple[str, str]], name: str = "quality_flags") -> DataFrame:
    """An array of the flags whose SQL condition holds, in the order given, each once."""
    return df.withColumn(name, F.array_distinct(F.array_compact(F.array(*(F.when(F.expr(test), F.lit(flag)) for flag, test in flags)))))


def gate(df: DataFrame, drop_on: list[str], missing: Column, flags: str = "quality_flags") -> DataFrame:
    """keep and drop_reasons: missing rows always drop, flagged rows where the profile says so."""
    reasons = F.concat(F.when(missing, F.array(F.lit("missing_teacher"))).otherwise(F.array().cast("array<string>")), F.filter(flags, lambda f: f.isin(*drop_on)))
    return df.withColumn("drop_reasons", reasons).withColumn("keep", F.size("drop_reasons") == 0)


def pre_label(section: Column, text: Column, non_core: list[str], least: int) -> Column:
    """Non-core sections, texts that repeat their title and texts below `least` characters; blank otherwise."""
    core = F.lit(False)
    for part in non_core:
        core = core | F.lower(section).contains(part)
    return F.when(core, "Non-Core").when(F.trim(section) == F.trim(text), "Delete").when(F.length(text) < least, "Delete").otherwise("")


def extract_labels(c: Column, patterns: list[str], names: dict[str, str]) -> Column:
    """All bracketed labels, renamed, each once, joined by commas; Not-Found without any."""
    every = F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns))
    lookup = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    renamed = F.array_distinct(F.transform(every, lambda x: F.coalesce(F.element_at(lookup, F.trim(x)), F.trim(x))))
    return F.when(F.size(renamed) > 0, F.array_join(renamed, ", ")).otherwise("Not-Found")


def with_reason(df: DataFrame, reason: Column) -> DataFrame:
    """The exclusion reason, null for accepted rows; both outputs derive from the one column."""
    return df.withColumn("reason", reason)
