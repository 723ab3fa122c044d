"""Personal data by fixed patterns, then by bootstrapped contextual extraction.

The fixed patterns (e-mail, IP, card, phone) give the base spans.  Those are the seeds of
the method: the words around a seed are lexical patterns, "a b _" (two words before) and
"b _ c" (one on either side).  Candidates are other tokens that look like identifiers, in
the same contexts.  Spark scores the graph of patterns and instances in rounds: a
pattern's score for a kind is the share of its occurrences that are instances of that
kind, shrunk towards 0 by SHRINK; a candidate's score is the best of its patterns'.
A candidate of score CONFIDENT or more is an instance like a seed: it backs the patterns
around it, so the next round may score patterns that no seed has.  Patterns of score
CONFIDENT or more that at least SUPPORT different instances back name the candidates that
fit the kind's characters; those spans are added to the base ones.
Contexts that all kinds share score low for each, so ordinary prose names nothing.

Null texts are empty.  Every input row gives one output row, repeated rows and null ids
included.  Offsets are code points, the end exclusive.  An added span never overlaps a
base span of the same text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, record, settle

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 5
CONFIDENT = 0.8
SHRINK = 0.5
#: Rounds at most; they end when no score changes by SETTLED.
ROUNDS, SETTLED = 8, 1e-3
#: Characters on either side that a context is taken from.
AROUND = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs and the look-behind change no match: a match that fails from a run's first digit fails from all of them.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"(?<![\w+.@-])[(]?[0-9][0-9\x20().:-]{4,}[0-9](?![\w@])")
_WORD = re.compile(r"[^\W\d_]+|[=:#]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from their @ in one pass."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_digits(m.group())) <= 15:
                    out.append((3, *m.span()))
    return out


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Other tokens that look like identifiers: numbers of six digits or more, and marks with an @."""
    taken, found = sorted((s, e) for _, s, e in base), []
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if len(_digits(m.group())) >= 6:
                found.append(m.span())
    at = text.find("@")
    while at >= 0:
        s, e = at, at + 1
        while s > 0 and not text[s - 1].isspace() and text[s - 1] != "@":
            s -= 1
        while e < len(text) and not text[e].isspace() and text[e] != "@":
            e += 1
        if s < at < e - 1:
            found.append((s, e))
        at = text.find("@", at + 1)
    out, k = [], 0
    for s, e in sorted(found):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        # Spans of several kinds may nest, so a few before k can still reach past s.
        if not any(x < e and y > s for x, y in taken[max(0, k - 4) : k + 4]) and (not out or out[-1][1] <= s):
            out.append((s, e))
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    left = _WORD.findall(text[max(0, start - AROUND) : start].lower())
    right = _WORD.findall(text[end : end + AROUND].lower())
    out = []
    if len(left) >= 2:
        out.append(f"{left[-2]} {left[-1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    return out


def fits(value: str) -> list[int]:
    """Kinds whose characters a candidate has."""
    digits = len(_digits(value))
    out = [0] if "@" in value else []
    if not out:
        if value.count(".") >= 3 or value.count(":") >= 2:
            out.append(1)
        if 12 <= digits <= 19:
            out.append(2)
        if 6 <= digits <= 15:
            out.append(3)
    return out


SPAN = "struct<kind:int,start:int,end:int>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("seed", pa.int32()), ("fits", pa.list_(pa.int32())), ("patterns", pa.list_(pa.string()))])
FOUND = "array<struct<start:int,end:int,value:string,seed:int,fits:array<int>,patterns:array<string>>>"


def _scan(docs: DataFrame, extra: list[str]) -> DataFrame:
    def run(batch):
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        spans, sha, found = [], [], []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            sha.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
            own = [{"start": s, "end": e, "value": hashlib.sha256(text[s:e].encode("utf-8", "surrogatepass")).hexdigest()[:16], "seed": k, "fits": [k], "patterns": contexts(text, s, e)} for k, s, e in base]
            own += [{"start": s, "end": e, "value": hashlib.sha256(text[s:e].encode("utf-8", "surrogatepass")).hexdigest()[:16], "seed": -1, "fits": fits(text[s:e]), "patterns": contexts(text, s, e)} for s, e in _candidates(text, base)]
            found.append(own)
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in extra), pa.array(spans, pa.list_(_SPAN)), pa.array(sha), pa.array(found, pa.list_(_FOUND))], [*extra, "base", "base_sha256", "found"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in extra), f"base array<{SPAN}>", "base_sha256 string", f"found {FOUND}"])
    return per_batch(docs, schema, run)


def confident_patterns(found: DataFrame) -> DataFrame:
    """(pattern, kind, score) of confident patterns; found: (value, seed, fits, patterns) occurrences."""
    edges = found.select("value", "seed", "fits", F.explode("patterns").alias("pattern"))
    edges = settle(edges.groupBy("pattern", "value", "seed").agg(F.count("*").alias("n"), F.first("fits").alias("fits")), "edges")
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    kinds = F.when(F.col("seed") >= 0, F.array("seed")).otherwise(F.col("fits"))
    own = edges.select("pattern", "value", "n", (F.col("seed") >= 0).alias("is_seed"), F.explode(kinds).alias("kind"))
    # A pattern with fewer values of a kind's characters than SUPPORT cannot be backed in any round.
    able = own.groupBy("pattern", "kind").agg(F.countDistinct("value").alias("values")).where(F.col("values") >= SUPPORT).join(total, "pattern").select("pattern", "kind", "total")
    mine = settle(own.join(able, ["pattern", "kind"]), "mine")
    instance, pattern, before = None, None, None
    for _ in range(ROUNDS):
        now = mine if instance is None else mine.join(instance, ["value", "kind"], "left")
        guess = F.lit(0.0) if instance is None else F.coalesce("instance", F.lit(0.0))
        weight = F.when(F.col("is_seed"), F.lit(1.0)).otherwise(guess)
        score = F.sum(F.col("weight") * F.col("n")) / (F.first("total") + SHRINK)
        backed = F.countDistinct(F.when(F.col("weight") >= CONFIDENT, F.col("value"))) >= SUPPORT
        rows = now.withColumn("weight", weight).groupBy("pattern", "kind").agg(score.alias("score"), backed.alias("backed"))
        pattern = settle(rows.where("backed").select("pattern", "kind", "score"), "pattern")
        state = pattern.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if before is not None and state[0] == before[0] and abs(state[1] - before[1]) <= SETTLED:
            break
        before = state
        instance = mine.where("not is_seed").join(pattern, ["pattern", "kind"]).groupBy("value", "kind").agg(F.max("score").alias("instance"))
    return pattern.where(F.col("score") >= CONFIDENT)


def find(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, row, base and all (arrays of kind, start, end), base_sha256."""
    docs = documents.select(F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_column).cast("string").alias("text"))
    return _found(settle(_scan(docs, ["doc_id", "row"]), "scan"), ["doc_id", "row"])


def _found(scan: DataFrame, extra: list[str]) -> DataFrame:
    occurrence = scan.select("row", F.explode("found").alias("f")).select("row", "f.*")
    known = confident_patterns(occurrence)
    fresh = occurrence.where("seed < 0").select("row", "start", "end", "fits", F.explode("patterns").alias("pattern")).join(known, "pattern").where(F.array_contains("fits", F.col("kind")))
    fresh = fresh.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    fresh = fresh.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    joined = scan.select(*extra, "base", "base_sha256").join(fresh, "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))))
    return joined.select(*extra, "base", "base_sha256", every.alias("all"))


def redacted(documents: DataFrame, columns: tuple[str, ...], text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """documents with every span replaced by its kind; length_column follows the text; null texts stay null.

    Texts are read a second time rather than moved: only the few spans found by context
    travel, and base spans are found again where they are.
    """
    scan = settle(_scan(documents.select(F.col(text_column).cast("string").alias("text")), []), "scan")
    known = confident_patterns(scan.select(F.explode("found").alias("f")).select("f.*"))
    # Confident patterns are backed by SUPPORT seeds each; up to SEND_PATTERNS of them are sent to the texts.
    rows = known.orderBy(F.desc("score"), "pattern", "kind").limit(SEND_PATTERNS + 1).collect()
    if len(rows) > SEND_PATTERNS:
        return _redacted_by_join(documents, columns, text_column, length_column, known)
    names = documents.sparkSession.sparkContext.broadcast({(r["pattern"], r["kind"]): r["score"] for r in rows})
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}

    def run(batch):
        texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
        out = [None if t is None else redact(t, _with_context(t, names.value)) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_column else pa.array([None if t is None else len(t) for t in out], pa.int64()) if c == length_column else batch.column(batch.schema.get_field_index(c)) for c in columns], list(columns))

    return per_batch(documents.select(*columns), ", ".join(f"{c} {'bigint' if c == length_column else kinds[c]}" for c in columns), run)


SEND_PATTERNS = 200_000


def _with_context(text: str, names: dict) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    if not names:
        return base
    out = list(base)
    for s, e in _candidates(text, base):
        best = max(((names[p, k], -k) for p in contexts(text, s, e) for k in fits(text[s:e]) if (p, k) in names), default=None)
        if best:
            out.append((-best[1], s, e))
    return out


def _redacted_by_join(documents: DataFrame, columns, text_column: str, length_column: str, known: DataFrame) -> DataFrame:
    rows = settle(documents.select(*columns, F.monotonically_increasing_id().alias("_row")), "rows")
    scan = settle(_scan(rows.select(F.col("_row").alias("row"), F.col(text_column).cast("string").alias("text")), ["row"]), "scan")
    spans = _found(scan, ["row"]).select(F.col("row").alias("_row"), F.col("all").alias("_all"))
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}

    def run(batch):
        at = batch.schema.get_field_index
        texts, found = batch.column(at(text_column)).to_pylist(), batch.column(at("_all")).to_pylist()
        out = [None if t is None else redact(t, [(x["kind"], x["start"], x["end"]) for x in f]) for t, f in zip(texts, found, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_column else pa.array([None if t is None else len(t) for t in out], pa.int64()) if c == length_column else batch.column(at(c)) for c in columns], list(columns))

    return per_batch(rows.join(spans, "_row"), ", ".join(f"{c} {'bigint' if c == length_column else kinds[c]}" for c in columns), run)


def digest(found: DataFrame) -> DataFrame:
    """The counts and span strings of find()."""
    names = F.array(*(F.lit(k) for k in KINDS))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), "base_sha256", text.alias("spans"))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; spans that overlap give one mark, of the first."""
    out, end = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= end:
            out += [text[end:s], f"<{KINDS[k]}>"]
            end = e
        else:
            end = max(end, e)
    return "".join(out) + text[end:]
