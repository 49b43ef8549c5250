"""Secrets in text, with DataFrame functions only: fixed patterns, and character Markov models for the rest.

Two first-order models of characters are trained from labelled samples: random strings (the values that the patterns
found) and ordinary words and identifiers (shorter runs that no pattern touched).  A run of at least
``LEAST_RUN`` characters outside the patterns' spans is reported when its log-likelihood ratio per character is high enough.

Defined results: null text is empty and has no spans; a null id and repeated rows are kept as they are; where either
sample is empty only the patterns report; other columns are ignored.  Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramwise.llm.common import table

_KEYWORD = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
#: Fixed kinds in their order of report, as Java patterns of whole matches.  A run of hex digits or capitals that is too
#: short fails wherever it starts, so the least length stands in the pattern; that of an assigned value is tested after.
PATTERNS = {
    "assign": _KEYWORD + "[A-Za-z0-9+/_.=-]+",
    "access": "AKIA[A-Z0-9]{16,}+",
    "hex": "(?<![0-9a-f])[0-9a-f]{24,}+",
}
RANDOM = "random"
KINDS = (*PATTERNS, RANDOM)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
LEAST_RUN = 16
LEAST_VALUE = 6
#: Pairs that the frequency of single characters counts as, in the models.
PRIOR = 10.0
_RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]"
_MARK = "\x01"
_STATES = len(ALPHABET) + 1


def _clean(text: Column) -> Column:
    """The text with its own marks replaced by a character that no pattern takes either."""
    return F.translate(F.coalesce(text, F.lit("")), _MARK, "\x02")


def _pieces(text: Column, pattern: str) -> Column:
    """Text between matches and matches in turn."""
    return F.split(F.regexp_replace(text, f"(?:{pattern})", f"{_MARK}$0{_MARK}"), _MARK, -1)


def _spans(pieces: Column, kind: int) -> Column:
    """Offsets of the matches: every second piece, after the lengths of all before."""
    span = "struct<start:int,kind:int,stop:int,value:string>"
    none = F.array().cast(f"array<{span}>")

    def step(state: Column, i: Column) -> Column:
        piece = F.get(pieces, i)
        stop = state["at"] + F.length(piece)
        match = F.struct(state["at"].alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), piece.alias("value"))
        return F.struct(stop.alias("at"), F.when(i % 2 == 1, F.array_append(state["found"], match)).otherwise(state["found"]).cast(f"array<{span}>").alias("found"))

    # The matches are few; text without any takes no step.
    folded = F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 1), F.struct(F.lit(0).alias("at"), none.alias("found")), step)
    return F.when(F.size(pieces) > 1, folded["found"]).otherwise(none)


def _value(match: Column) -> Column:
    """The value of an assignment."""
    return F.regexp_extract(match, f"^{_KEYWORD}([A-Za-z0-9+/_.=-]+)\\z", 1)


def _base(docs: DataFrame) -> DataFrame:
    """The documents with ``base``: spans of the patterns, in order."""
    kinds = list(PATTERNS)
    cut = docs.select("*", *(_pieces(F.col("clean"), PATTERNS[k]).alias(f"cut_{k}") for k in kinds))
    found = [_spans(F.col(f"cut_{k}"), i) for i, k in enumerate(kinds)]
    found[0] = F.filter(found[0], lambda x: F.length(_value(x["value"])) >= LEAST_VALUE)
    return cut.select(*docs.columns, F.array_sort(F.concat(*found)).alias("base"))


def _outside(spans: Column, base: Column) -> Column:
    return F.filter(spans, lambda x: ~F.exists(base, lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])))


def _pairs(strings: DataFrame, label: str) -> DataFrame:
    """Counts of pairs of neighbouring characters, the start and everything else being state 0."""
    codes = F.transform(F.split("value", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    coded = strings.select(codes.alias("codes"))
    pairs = coded.select(
        F.explode(F.transform("codes", lambda c, i: F.when(i > 0, F.get("codes", i - 1)).otherwise(0) * _STATES + c)).alias("pair")
    )
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "pair", "n")


def train(docs: DataFrame, sample: int = 20_000, words: int = 1_000) -> list[float] | None:
    """Log-likelihood ratios of random against ordinary for each pair of characters.

    Random strings come from about ``sample`` different texts, ordinary ones from about ``words`` of them, both drawn by a hash of
    the text, so the work and the table are bounded however many documents and copies there are.
    """
    texts = docs.select(F.xxhash64("clean").alias("hash")).distinct().count()
    draw = F.pmod(F.xxhash64("clean"), F.lit(1_000_000)) / 1_000_000.0
    drawn = _base(docs.select("clean").filter(draw < sample / max(texts, 1)).distinct())
    matches = drawn.select(F.explode("base").alias("x")).select("x.kind", "x.value")
    random = matches.select(F.when(F.col("kind") == 0, _value(F.col("value"))).otherwise(F.col("value")).alias("value"))
    random = random.filter(F.length("value") >= LEAST_RUN)
    # Nearly every word is an example here: what the patterns match is taken out first, so that no offsets are needed.
    rest = F.col("clean")
    for pattern in PATTERNS.values():
        rest = F.regexp_replace(rest, pattern, " ")
    few = drawn.filter(draw < words / max(texts, 1)).select(rest.alias("rest"))
    ordinary = few.select(F.explode(F.regexp_extract_all("rest", F.lit(_RUN + "{4,}+"), F.lit(0))).alias("value"))
    # Longer runs may be what is looked for: they are no examples of either.
    ordinary = ordinary.filter(F.length("value") < LEAST_RUN)
    counts = _pairs(random, "random").unionByName(_pairs(ordinary, "ordinary")).collect()
    tables = {label: [0.0] * _STATES**2 for label in ("random", "ordinary")}
    for row in counts:
        tables[row["label"]][row["pair"]] += row["n"]
    if len({row["label"] for row in counts}) < 2:
        return None
    for cells in tables.values():
        # A state seen rarely leans on how frequent the next character is anywhere.
        single = [0.5 + sum(cells[b::_STATES]) for b in range(_STATES)]
        for a in range(_STATES):
            row_ = slice(a * _STATES, (a + 1) * _STATES)
            total = sum(cells[row_]) + PRIOR
            cells[row_] = [math.log((n + PRIOR * x / sum(single)) / total) for n, x in zip(cells[row_], single, strict=True)]
    return [x - y for x, y in zip(tables["random"], tables["ordinary"], strict=True)]


def scan(docs: DataFrame, ratios: list[float] | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs(clean, ...)`` with ``base``, spans of the patterns, and ``found``, all spans.

    ``least`` is the log-likelihood ratio per character, in natural logarithms, from which a run counts as random.
    """
    rows = _base(docs)
    kept = rows.columns
    if ratios is None:
        return rows.withColumn("found", F.col("base"))
    ratio = F.from_json(F.lit(json.dumps(ratios)), "array<double>")

    def likely(x: Column) -> Column:
        codes = F.transform(F.split(x["value"], ""), lambda c: F.instr(F.lit(ALPHABET), c))
        before = F.concat(F.array(F.lit(0)), F.slice(codes, 1, F.length(x["value"]) - 1))
        pairs = F.transform(F.arrays_zip(before.alias("a"), codes.alias("b")), lambda p: p["a"] * _STATES + p["b"])
        total = F.aggregate(pairs, F.lit(0.0), lambda total, p: total + F.get(ratio, p))
        # Digits alone are a number.
        return x["value"].rlike("[A-Za-z]") & (total >= least * F.length(x["value"]))

    cut = rows.select(*kept, _pieces(F.col("clean"), f"{_RUN}{{{LEAST_RUN},}}+").alias("cut"))
    runs = cut.select(*kept, _outside(_spans(F.col("cut"), len(PATTERNS)), F.col("base")).alias("runs"))
    added = runs.select(*kept, F.filter("runs", likely).alias("added"))
    return added.select(*kept, F.array_sort(F.concat("base", "added")).alias("found"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by a mark; ``spans`` in order."""

    def step(state: Column, x: Column) -> Column:
        gap = F.concat(state["out"], F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit(mark))
        return F.struct(
            F.greatest(state["at"], x["stop"]).alias("at"), F.when(x["start"] >= state["at"], gap).otherwise(state["out"]).alias("out")
        )

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    whole = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _number(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def prepared(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns, and ``clean``: the text to be scanned."""
    return docs.select(*columns, _clean(F.col("text")).alias("clean"))


def secrets(docs: DataFrame) -> DataFrame:
    """Digest columns of the secrets of ``docs(doc_id, text)``."""
    clean = prepared(docs, "doc_id")
    found = scan(clean, train(clean))
    number = [_number(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(PATTERNS)]
    return found.select("doc_id", *number, F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text(F.col("found")).alias("spans"))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secrets(table(spark, sf_dir, "documents"))
