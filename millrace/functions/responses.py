"""Structured responses, reward functions and text similarity as Column -> Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Response formats.
XML = r"(?s)^<think>\n?(.*?)\n?</think>\s*<answer>\n?(.*?)\n?</answer>$"
CHANNEL = r"(?s)^<\|channel>thought\n(.*?)<channel\|>(.*)$"
BOUNDARY = r"(?s)^(.*?)</think>(.*)$"


def parse(c: Column) -> Column:
    """Struct (reasoning, answer, format, well_formed) of XML, channel, boundary or plain responses.

    Channel marks together with tags are `mixed`, which is never well formed.
    """
    t = T.strip(c)
    channel, tags = t.contains("<|channel>"), t.rlike(r"</?(think|answer)>")
    kind = F.when(channel & tags, "mixed").when(channel, "channel").when(t.rlike(r"</?answer>|<think>"), "xml").when(t.contains("</think>"), "boundary").otherwise("plain")
    pick = lambda k: T.strip(F.when(kind == "xml", F.regexp_extract(t, XML, k)).when(kind == "channel", F.regexp_extract(t, CHANNEL, k)).when(kind == "boundary", F.regexp_extract(t, BOUNDARY, k)).otherwise(t if k == 2 else F.lit("")))
    once = (F.regexp_count(t, F.lit("</think>")) == 1) & (F.regexp_count(t, F.lit("<think>")) <= 1) & (F.regexp_count(t, F.lit("</?answer>")) <= 2)
    good = F.when(kind == "xml", t.rlike(XML) & once).when(kind == "channel", t.rlike(CHANNEL)).when(kind == "boundary", t.rlike(BOUNDARY) & once & (pick(1) != "") & (pick(2) != "")).otherwise(F.lit(False))
    return F.struct(pick(1).alias("reasoning"), pick(2).alias("answer"), kind.alias("format"), good.alias("well_formed"))


def candidate(c: Column) -> Column:
    """The text after the first answer tag without its close; the whole text where there is none."""
    inside = F.regexp_extract(c, r"(?is)<answer>(.*)$", 1)
    return F.when(c.rlike(r"(?is)<answer>"), T.strip(F.regexp_replace(inside, r"(?is)</answer>.*$", ""))).otherwise(T.strip(c))


def render_xml(reasoning: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>\n"), T.strip(reasoning), F.lit("\n</think>\n<answer>\n"), T.strip(answer), F.lit("\n</answer>"))


def format_reward(c: Column) -> Column:
    return F.when(parse(c)["well_formed"], 1.0).otherwise(0.0)


def tag_count_reward(c: Column) -> Column:
    """A quarter for each of the four tags that occurs exactly once."""
    return sum((F.when(F.regexp_count(c, F.lit(t)) == 1, 0.25).otherwise(0.0) for t in ("<think>", "</think>", "<answer>", "</answer>")), F.lit(0.0))


def steps_reward(c: Column) -> Column:
    """A third for each step mark, at most 1; `^` is the start of the text."""
    return F.least(F.lit(1.0), F.regexp_count(c, F.lit(r"Step \d+:|^\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,")) / 3.0)


def length_reward(length: Column, correct: Column, low: Column, high: Column) -> Column:
    """0.5 less the place between the group's shortest and longest; wrong answers get at most 0; equal lengths 0."""
    value = 0.5 - (length - low) / (high - low)
    return F.when(high == low, 0.0).when(correct, value).otherwise(F.least(F.lit(0.0), value))


def cosine_reward(length: Column, correct: Column, longest: int, wrong: tuple[float, float] = (-1.0, -0.5), right: tuple[float, float] = (0.5, 1.0)) -> Column:
    """Between bounds by the cosine of length over longest, which is not clamped; the bounds swap for wrong answers."""
    wave = 1 + F.cos(length * math.pi / longest)
    low, high = F.when(correct, right[0]).otherwise(wrong[1]), F.when(correct, right[1]).otherwise(wrong[0])
    return low + 0.5 * (high - low) * wave


def repetition_penalty(c: Column, n: int, most: float) -> Column:
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    return T.let(T.ngrams(words, n), lambda g: F.when(F.size(g) > 0, (1 - F.size(F.array_distinct(g)) / F.size(g)) * most).otherwise(F.lit(0.0)))


def decision(c: Column) -> Column:
    """Struct (direction, magnitude) of an object with exactly those keys; null for anything else."""
    own = F.from_json(c, "direction string, magnitude_bp int")
    exact = F.array_sort(F.json_object_keys(c)) == F.array(F.lit("direction"), F.lit("magnitude_bp"))
    ok = exact & own["direction"].isin("hike", "cut", "hold") & own["magnitude_bp"].isin(0, 25, 50, 75, 100) & ((own["direction"] == "hold") == (own["magnitude_bp"] == 0))
    return F.when(ok, own)


def decision_reward(direction: Column, bp: Column, true_direction: Column, true_bp: Column) -> Column:
    """0.05 for the format, 0.45 for the direction, up to 0.30 by closeness if it is right, 0.20 if all is exact; 0 if unread."""
    same = direction == true_direction
    score = F.lit(0.05) + F.when(same, F.lit(0.45) + 0.30 * F.greatest(F.lit(0.0), 1 - F.abs(bp - true_bp) / 100.0)).otherwise(0.0) + F.when(same & (bp == true_bp), 0.20).otherwise(0.0)
    return F.when(direction.isNull() | bp.isNull(), 0.0).otherwise(score)


def fenced_decision_reward(c: Column, true_direction: Column, true_bp: Column) -> Column:
    """The strict object scores in full; an object in a code fence a quarter of the part without the format."""
    strict, inner = decision(T.strip(c)), decision(T.strip(F.regexp_extract(c, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)))
    full = decision_reward(strict["direction"], strict["magnitude_bp"], true_direction, true_bp)
    part = 0.25 * F.greatest(F.lit(0.0), decision_reward(inner["direction"], inner["magnitude_bp"], true_direction, true_bp) - 0.05)
    return F.when(strict.isNotNull(), full).when(inner.isNotNull(), part).otherwise(0.0)


def concision(words: Column, repetition: Column, full: int, none: int) -> Column:
    """1 up to `full` words, then linearly to 0 at `none`; times 1 - min(1, 4 * repetition)."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(none) - words) / float(none - full)))
    return base * (1 - F.least(F.lit(1.0), 4 * repetition))


def grounded(judge: Column, numeric: Column, structure: Column, concise: Column, efficient: Column, penalty: Column) -> Column:
    return 0.50 * judge + 0.25 * numeric + 0.15 * structure + 0.05 * concise + 0.05 * efficient - F.least(F.lit(0.5), penalty)


def polarity(words: Column, positive: list[str], negative: list[str]) -> Column:
    n = lambda own, bag: F.size(F.filter(own, lambda w: w.isin(*bag)))
    return T.let(words, lambda w: (n(w, positive) - n(w, negative)) / F.greatest(F.lit(1), n(w, positive) + n(w, negative)))


def cosine(a: Column, b: Column, floor: float = 1e-6) -> Column:
    """Cosine of two arrays, the product of norms at least `floor`."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.lit(floor), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
