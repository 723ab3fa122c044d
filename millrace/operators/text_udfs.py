"""Text comparisons that no built-in expresses: Arrow-batched Python, never one call a row from the JVM."""

from __future__ import annotations

import difflib
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token patterns.
_WORD = re.compile(r"[A-Za-z]+(?:['’][A-Za-z]+)?|[-+]?\d+(?:\.\d+)?")
_LEAK = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by one bit row: each step is a few operations on whole words of bits."""
    masks: dict[str, int] = {}
    for k, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(a: str | None, b: str | None) -> float:
    x, y = (_WORD.findall((t or "").lower()) for t in (a, b))
    n = lcs_length(x, y) if x and y else 0
    return 2 * n / (len(x) + len(y)) if n else 0.0


@F.pandas_udf(T.DoubleType())
def rouge_l_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def leakage_tokens(text: str | None) -> list[str]:
    """NFKC, case folded, format characters dropped, curly apostrophes straightened."""
    t = unicodedata.normalize("NFKC", text or "").casefold().replace("’", "'")
    return _LEAK.findall("".join(c for c in t if unicodedata.category(c) != "Cf"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def leakage_words(c: pd.Series) -> pd.Series:
    return c.map(leakage_tokens)


class _Sections(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.section, self.held, self.kind, self.rows = "", [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "h3", "h4", "strong"):
            if self.kind == "p" and "".join(self.held).strip():
                return
            self.kind, self.held = "head", []
        elif tag == "p":
            self._close()
            self.kind, self.held = "p", []

    def handle_endtag(self, tag):
        if tag in ("h1", "h2", "h3", "h4", "strong") and self.kind == "head":
            self.section, self.kind, self.held = " ".join("".join(self.held).split()), None, []
        elif tag == "p":
            self._close()

    def handle_data(self, data):
        if self.kind:
            self.held.append(data)

    def _close(self):
        text = " ".join("".join(self.held).split())
        if self.kind == "p" and text:
            self.rows.append((self.section, text))
        self.kind, self.held = None, []


def html_rows(html: str | None) -> list[tuple[str, str]]:
    """(section, paragraph) pairs; headings and bold set the section."""
    p = _Sections()
    p.feed(html or "")
    p.close()
    p._close()
    return p.rows


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("section", T.StringType()), T.StructField("paragraph", T.StringType())])))
def html_sections(c: pd.Series) -> pd.Series:
    return c.map(lambda h: [{"section": s, "paragraph": t} for s, t in html_rows(h)])


def sentence_chunks(text: str | None, budget: int) -> list[str]:
    """Sentences packed greedily up to `budget` words; a longer sentence stands alone, nothing is cut."""
    out, held, n = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", (text or "").strip()):
        words = len(s.split())
        if held and n + words > budget:
            out.append(" ".join(held))
            held, n = [], 0
        if s:
            held.append(s)
            n += words
    return [*out, " ".join(held)] if held else out


def chunks_udf(budget: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunk(c: pd.Series) -> pd.Series:
        return c.map(lambda t: sentence_chunks(t, budget))

    return chunk


def chunk_pairs(df, a: str, b: str, budget: int):
    """Rows of df with `chunk_a`, `chunk_b` and `weight`: the k-th chunk of one text beside the k-th of the other.

    The weight is the larger word count; a chunk without a partner meets null.  Texts without words leave no row.
    """
    cut, words = chunks_udf(budget), lambda c: F.when(c.isNull(), 0).otherwise(F.size(F.split(c, r"\s+")))
    pairs = df.select("*", F.explode(F.arrays_zip(F.coalesce(cut(a), F.array()).alias("x"), F.coalesce(cut(b), F.array()).alias("y"))).alias("_c"))
    pairs = pairs.select(*df.columns, F.col("_c.x").alias("chunk_a"), F.col("_c.y").alias("chunk_b"))
    return pairs.withColumn("weight", F.greatest(words(F.col("chunk_a")), words(F.col("chunk_b"))))


def chunk_weighted(df, key: str, a: str, b: str, budget: int, scorer):
    """(key, pairs, score): the scorer's mean over chunk pairs by weight, 0 for a chunk without a partner; score 0 where no text has words."""
    scored = chunk_pairs(df.select(key, a, b), a, b, budget)
    both = F.col("chunk_a").isNotNull() & F.col("chunk_b").isNotNull()
    scored = scored.withColumn("_s", F.when(both, scorer(F.coalesce("chunk_a", F.lit("")), F.coalesce("chunk_b", F.lit("")))).otherwise(0.0))
    mean = scored.groupBy(key).agg(F.count("*").alias("pairs"), (F.sum(F.col("_s") * F.col("weight")) / F.sum("weight")).alias("score"))
    return df.select(key).join(mean, key, "left").select(key, F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("score", F.lit(0.0)).alias("score"))


# Marks of drafts that must not stay in a cleaned text.
_HEADINGS = r"plan|outline|reasoning|analysis|checking|check|draft|final(?:\s+answer)?|rewrite|fidelity(?:\s+check)?|steps?|claims?|quantities|dates?|directions?|comparisons?|uncertainty"
CONTAMINATION = {
    "evidence_id": r"(?i)\bev-[0-9a-f]+\b",
    "ev_citation_phrase": r"(?i)\b(?:ev[- ]citations?|evidence[- ]citations?)\b",
    "control_marker": r"</?think>|</?answer>|<\|(?:begin|end)_of_sentence\|>",
    "heading": rf"(?im)^\s*(?:#{{1,6}}\s*)?(?:{_HEADINGS})\s*(?::|$)",
    "bullet_marker": r"(?m)^\s*(?:[-*+•]|\d+[.)]|[A-Za-z][.)])\s+",
    "meta:transport_or_role": r"(?i)\b(?:prompt|instruction|task|user|teacher|student|assistant|json|api|schema|field|key|response|final answer|answer tag|control tag|output (?:format|contract|text|answer|response)|the output)\b",
    "meta:fidelity_inventory": r"(?i)\b(?:silent fidelity ledger|fidelity ledger|quantity occurrences?|date markers?|required dates?|numeric multiset|all quantities|every occurrence|correction notes?|source surface forms?)\b",
    "meta:checking": r"(?i)(?:^|\b)(?:check(?:ing|ed)?|verify|verification|ensure|double[- ]check|confirm(?:ing|ed)?|make sure|all (?:quantities|dates|claims|directions|comparisons) (?:are |remain )?(?:present|preserved)|good\.?$)",
    "meta:drafting": r"(?i)\b(?:draft(?:ing|ed)?|rewrite|rephrase|reword|formulation|one formal paragraph|one paragraph|single paragraph|word limit|token limit|minutes[- ]style|formal (?:fomc )?minutes|formal tone|passive voice|past tense|prose should|sentence should|fomc minutes)\b",
    "meta:instruction_recap": r"(?i)\b(?:must|need(?:s)? to|should|do not|don['’]?t|avoid|remove|preserve|retain|include|mention|use exactly|must appear|no extra|without adding|not add|never add|not introduce|no new facts?|no extra information|no rounding|no conversion|no derived quantities|use exact numbers?)\b",
    "meta:self_narration": r"(?i)\b(?:let['’]?s|we\s+(?:need|should|must|will|can)|we['’]?ll|so\s+we['’]?ll|i['’]?ll|i\s+(?:need|should|must|will|can|have|haven['’]?t)|now\s+(?:craft|write|produce|check|rewrite))\b",
    "meta:citation_process": r"(?i)\b(?:citations?|ev[- ]citations?|according to (?:the )?(?:data|source))\b",
    "meta:source_narration": r"(?i)\b(?:(?:provided|source|original|supplied)\s+(?:analysis|text|passage)|the analysis|this analysis)\b",
    "meta:evaluation_chatter": r"(?i)\b(?:seems? faithful|that is faithful|this is faithful|this seems fine|construct (?:a )?(?:cohesive )?paragraph|perhaps\s*:|modal verb may|may is (?:not )?a month)",
}
SENTENCE_END = r"([.!?])[\"'”’)\]]*\s+|\n+"
QUOTED_FROM = 80  # characters from which a normalised source counts as quoted
REPEATED_FROM = 5  # words from which a sentence counts as repeated


def normalized(c):
    """Lower-case words, digits and `%$.-`, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_%$.-]+", " "))


def contamination(c, sources: dict | None = None):
    """Sorted names of the marks in a draft; null has none.

    Besides the fixed patterns: quotes that do not pair, whole sources (by name) that the
    draft repeats, and sentences of five words or more that come twice.
    """
    marks = [F.when(c.rlike(p), F.lit(name)) for name, p in CONTAMINATION.items()]
    odd = (F.regexp_count(c, F.lit('"')) % 2 == 1) | (F.regexp_count(c, F.lit("“")) != F.regexp_count(c, F.lit("”")))
    marks.append(F.when(odd, F.lit("unmatched_quote")))
    for name, source in (sources or {}).items():
        whole = normalized(source)
        marks.append(F.when((F.length(whole) >= QUOTED_FROM) & normalized(c).contains(whole), F.lit(f"quoted_or_repeated:{name}")))
    sentences = F.transform(F.split(F.regexp_replace(c, SENTENCE_END, "$1\n"), "\n"), normalized)
    long = F.filter(sentences, lambda s: F.size(F.split(s, " ")) >= REPEATED_FROM)
    marks.append(F.when(F.size(long) > F.size(F.array_distinct(long)), F.lit("duplicate_sentence")))
    return F.array_sort(F.array_compact(F.array(*marks)))
