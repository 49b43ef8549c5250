"""Language identification: known words by their frequency in each language, shorter and shorter n-grams for the rest.

Words are runs of letters in lower case.  A known word adds the logarithm of its relative frequency in each language.  An
unseen word is padded and cut into its character n-grams; the longest order with any known n-gram scores it, each
order down costing a fixed factor, and letters never seen add the same to every language.

Defined results: null text and text without a letter are ``und`` with score 0; ties go to the language first in sorted
order; a null id stays null and counts as training data; repeated rows are each returned; other columns are ignored.  Where
nothing was learned every text is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramwise.llm.common import is_held_out, pieces, table, text_bytes, written

UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_COUNTED = "lang string, item string, n bigint"


def _hashes(items: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in items], np.uint64)


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies of words and n-grams, known by their hashes in rising order; one column per language in sorted order.

    ``lost`` is the share of all words of the sample that are not kept, and of all n-grams.
    """

    languages: list[str]
    words: np.ndarray
    word_scores: np.ndarray
    grams: np.ndarray
    gram_scores: np.ndarray
    orders: int
    backoff: float
    lost: tuple[float, float] = (0.0, 0.0)

    @staticmethod
    def find(known: np.ndarray, items: list[str]) -> np.ndarray:
        """Where each item stands among the known ones, -1 for none."""
        if not len(known) or not items:
            return np.full(len(items), -1)
        hashes = _hashes(items)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, at, -1)

    def unseen(self, word: str) -> np.ndarray:
        """Scores of an unseen word: the longest order that knows one of its n-grams."""
        padded = f" {word} "
        for order in range(min(self.orders, len(padded)), 0, -1):
            known = self.find(self.grams, [padded[i : i + order] for i in range(len(padded) - order + 1)])
            known = known[known >= 0]
            if len(known):
                # As much weight as one word, however many n-grams there are.
                return self.gram_scores[known].mean(0) * self.backoff ** (self.orders - order)
        return np.zeros(len(self.languages))

    def scores(self, words: list[str]) -> np.ndarray:
        """One row of scores for each of different words."""
        at = self.find(self.words, words)
        out = np.zeros((len(words), len(self.languages)))
        if len(self.word_scores):
            out[at >= 0] = self.word_scores[at[at >= 0]]
        for i in np.flatnonzero(at < 0).tolist():
            out[i] = self.unseen(words[i])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The words of all texts are numbered first, so that each different one is looked up once."""
        names, certain = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        numbers: dict[str, int] = {}
        rows, found = [], []
        for i, text in enumerate(texts):
            words = _LETTERS.findall(text.lower()) if text and self.languages else []
            if words:
                rows.append(i)
                found.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32))
        if not rows:
            return names, certain
        scores = self.scores(list(numbers))
        for i, words in zip(rows, found, strict=True):
            different, count = np.unique(words, return_counts=True)
            total = count.astype(float) @ scores[different]
            # Evidence of words in a row is not independent: the mean per word, sharpened, gives the certainty.
            share = np.exp((total - total.max()) / len(words) * min(len(words), 20))
            best = int(total.argmax())
            names[i], certain[i] = self.languages[best], float(share[best] / share.sum())
        return names, certain


def _frequent(counted: DataFrame, languages: list[str], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Of ``lang, item, n`` the at most ``most`` items with the largest counts, 2 at least, with add-half log frequencies by
    language, and the share of the counts that others have.  Only these reach the driver, beside a histogram of the counts."""
    number = F.create_map(*[F.lit(x) for j, language in enumerate(languages) for x in (language, j)])
    seen = F.struct(number[F.col("lang")].alias("at"), "n")
    items = counted.groupBy("item").agg(F.sum("n").alias("total"), F.collect_list(seen).alias("seen"))
    sizes = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least, above, distinct = None, 0, 0
    for row in sorted(items.groupBy("total").count().collect(), reverse=True):
        above += row["count"] if least is None else 0
        if least is None and above > most:
            least = row["total"] + 1
        distinct += row["count"]
    kept = items.filter(F.col("total") >= max(2, least or 2)).select("item", "seen.at", "seen.n").toPandas().sort_values("item")
    counts = np.zeros((len(kept), len(languages)))
    if len(kept):
        counts[np.repeat(np.arange(len(kept)), kept["at"].map(len)), np.concatenate(kept["at"].to_list())] = np.concatenate(kept["n"].to_list())
    size = np.array([sizes.get(language, 0) for language in languages])
    hashes = _hashes(kept["item"].to_list())
    order = np.argsort(hashes)
    lost = 1.0 - counts.sum() / max(size.sum(), 1)
    return hashes[order], np.log((counts + 0.5) / (size + 0.5 * max(distinct, 1)))[order], float(lost)


def _flushed(batches: Iterator[dict[tuple[str, str], int]]) -> Iterator[pa.RecordBatch]:
    """Counts of ``(lang, item)`` added up, as rows whenever there are many."""
    found: Counter = Counter()

    def rows():
        langs, items = zip(*found, strict=True)
        return pa.RecordBatch.from_pydict({"lang": pa.array(langs), "item": pa.array(items), "n": pa.array(found.values(), pa.int64())})

    for more in batches:
        for key, n in more.items():
            found[key] += n
        if len(found) > 200_000:
            yield rows()
            found.clear()
    if found:
        yield rows()


def _words(sample: DataFrame) -> DataFrame:
    """``lang, item, n``: the words of ``lang, text``."""

    def texts(batches):
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                yield {(lang, word): n for word, n in Counter(_LETTERS.findall(text.lower())).items()}

    return sample.mapInArrow(lambda batches: _flushed(texts(batches)), _COUNTED).groupBy("lang", "item").agg(F.sum("n").alias("n"))


def _grams(words: DataFrame, orders: int) -> DataFrame:
    """``lang, item, n``: the n-grams of padded words."""

    def cut(batches):
        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "item", "n")), strict=True):
                padded, found = f" {word} ", Counter()
                for order in range(1, orders + 1):
                    for i in range(len(padded) - order + 1):
                        found[lang, padded[i : i + order]] += n
                yield found

    return words.mapInArrow(lambda batches: _flushed(cut(batches)), _COUNTED).groupBy("lang", "item").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, per_language: int = 4000, orders: int = 5, backoff: float = 0.7, vocabulary: int = 200_000) -> LanguageModel:
    """Learns from ``text, lang`` of a sample: about ``per_language`` different whole texts of each language, by a hash of the text.
    At most ``vocabulary`` words and as many n-grams are kept, the most frequent; only they are brought to the driver, and the model
    says which share is lost by that."""
    labelled = rows.filter("text is not null and lang is not null").select("text", "lang")
    # Copies count once: all of them are drawn or none.
    hashes = labelled.select("lang", F.xxhash64("text").alias("hash")).distinct()
    sizes = {r["lang"]: r["count"] for r in hashes.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], _hashes([]), np.zeros((0, 0)), _hashes([]), np.zeros((0, 0)), orders, backoff)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000.0
    words = written(_words(labelled.filter(draw < share[F.col("lang")]).select("lang", "text").distinct()), "words")
    grams = written(_grams(words, orders), "grams")
    (known, scores, lost), (pieces, piece_scores, lost_pieces) = (_frequent(x, languages, vocabulary) for x in (words, grams))
    return LanguageModel(languages, known, scores, pieces, piece_scores, orders, backoff, (lost, lost_pieces))


def identify(docs: DataFrame, model: LanguageModel, text_column: str = "text", sent: list | None = None) -> DataFrame:
    """The rows with ``lang_pred`` and ``score``; the text is read by itself, so no other column can enter.

    The broadcast model is added to ``sent``, for a caller that destroys it once the rows are written.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))
    if sent is not None:
        sent.append(shared)

    def predict(batches):
        known = LanguageModel(*shared.value)
        for batch in batches:
            names, scores = [], []
            _, offsets = text_bytes(batch.column(text_column))
            for low, high in pieces(offsets):
                more = known.predict(batch.column(text_column).slice(low, high - low).to_pylist())
                names += more[0]
                scores += more[1]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    schema = docs.select(columns).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(columns).mapInArrow(predict, schema)


def op3_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = is_held_out("doc_id", 3, 1)
    model = fit(docs.filter(~held).select("text", "lang"))
    out = identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
