"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

Tokens are runs without white space.  Those with a digit or ``@`` and their neighbours form chains; all other tokens are outside by
definition.  Features are the word shapes of a token and its neighbours.  Weights and transitions are trained by
gradient ascent of the likelihood on a small labelled table, and chains are decoded by Viterbi, many at once.  Decoded spans
that touch no span of the patterns are added to those.

Defined results: null text is empty and has no spans; a null id and repeated rows are kept as they are; without labelled chains
only the patterns report; other columns are ignored.  Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramwise.llm.common import table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its start fails at every later digit too.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]")
#: Tokens on either side of one with a digit or @ that belong to its chain.
_REACH = 2
_EDGE = ".,;:!?\"'[]{}<>"

Span = tuple[int, int, int]


def _emails(text: str) -> list[Span]:
    """Leftmost matches: an address starts where the run of characters before its @ does, or where the last match ended."""
    out, end, past, at = [], 0, 0, text.find("@")
    while at >= 0:
        local = text[max(end, past) : at]
        domain = _DOMAIN.match(text, at + 1)
        length = len(local) - len(local.rstrip(_LOCAL))
        if domain and length:
            end = domain.end()
            out.append((0, at - length, end))
        past = at + 1
        at = text.find("@", past)
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` of the patterns, by kind and start."""
    out = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# --- chains and features ------------------------------------------------------------------------------------------

Chain = list[tuple[int, int]]


def chains(text: str) -> list[Chain]:
    """Runs of tokens near a digit or @."""
    if not _TRIGGER.search(text):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    marks = np.array([_TRIGGER.search(text, a, b) is not None for a, b in tokens])
    near = np.convolve(marks, np.ones(2 * _REACH + 1), "same")[: len(tokens)] > 0 if len(tokens) > 2 * _REACH else np.full(len(tokens), marks.any())
    edges = np.flatnonzero(np.diff(near.astype(np.int8), prepend=0, append=0))
    return [tokens[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _shape(word: str) -> str:
    word = re.sub(r"[0-9]", "9", word[:48])
    return re.sub(r"[^\W\d_]+", "a", word)


def features(text: str, chain: Chain) -> list[list[str]]:
    """Word shapes of each token and its neighbours."""
    shapes = ["<", *(_shape(text[a:b]) for a, b in chain), ">"]
    short = [re.sub(r"(.)\1+", r"\1", x) for x in shapes]
    out = []
    for i in range(1, len(shapes) - 1):
        digits = shapes[i].count("9")
        out.append(
            [
                "bias",
                f"s={shapes[i]}",
                f"c={short[i]}",
                f"m={shapes[i].strip(_EDGE)}",
                f"d={min(digits, 20)}",
                f"p={short[i - 1]}",
                f"n={short[i + 1]}",
                f"pc={short[i - 1]} {short[i]}",
                f"cn={short[i]} {short[i + 1]}",
                f"at={'@' in shapes[i]} plus={'+' in shapes[i]}",
            ]
        )
    return out


def labels(chain: Chain, spans: list[Span]) -> list[int]:
    """Kind + 1 of the span that covers most of each token, 0 where none does."""
    out = []
    for a, b in chain:
        best = max(((min(b, e) - max(a, s), k + 1) for k, s, e in spans if s < b and a < e), default=(0, 0))
        out.append(best[1])
    return out


# --- the model ----------------------------------------------------------------------------------------------------


def _padded(chains_: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers as chains x tokens x templates, and which tokens are real."""
    longest, width = max(map(len, chains_)), len(chains_[0][0])
    index = np.zeros((len(chains_), longest, width), np.int64)
    real = np.zeros((len(chains_), longest), bool)
    for i, x in enumerate(chains_):
        index[i, : len(x)] = x
        real[i, : len(x)] = True
    return index, real


@dataclass(frozen=True)
class Crf:
    """Feature numbers, weights by feature and label (row 0 for unknown features), transitions, start weights."""

    known: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def numbers(self, rows: list[list[str]]) -> list[list[int]]:
        return [[self.known.get(x, 0) for x in row] for row in rows]

    def decode(self, chains_: list[list[list[int]]]) -> list[np.ndarray]:
        """Viterbi over chains of similar length at once."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains_)
        order = sorted(range(len(chains_)), key=lambda i: len(chains_[i]))
        while order:
            longest = len(chains_[order[-1]])
            group, order = order[-max(1, 200_000 // longest) :], order[: -max(1, 200_000 // longest)]
            index, real = _padded([chains_[i] for i in group])
            emit = self.weights[index].sum(2)
            score, back = self.start + emit[:, 0], np.zeros(emit.shape, np.int64)
            for t in range(1, longest):
                step = score[:, :, None] + self.moves
                back[:, t] = step.argmax(1)
                new = step.max(1) + emit[:, t]
                score = np.where(real[:, t, None], new, score)
            path = np.zeros(real.shape, np.int64)
            state, ends = score.argmax(1), real.sum(1) - 1
            for t in range(longest - 1, -1, -1):
                inside = t <= ends
                path[:, t] = np.where(inside, state, 0)
                if t:
                    state = np.where(inside, back[np.arange(len(group)), t, state], state)
            for i, row, end in zip(group, path, ends, strict=True):
                out[i] = row[: end + 1]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(examples: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-3, least: int = 2) -> Crf | None:
    """Maximum likelihood with weight decay on labelled chains, by forward-backward over all of them and Adagrad steps."""
    if not examples:
        return None
    counts: dict[str, int] = {}
    for rows, _ in examples:
        for row in rows:
            for x in row:
                counts[x] = counts.get(x, 0) + 1
    known = {x: i + 1 for i, x in enumerate(sorted(x for x, n in counts.items() if n >= least))}
    n, kinds = len(known) + 1, len(KINDS) + 1
    model = Crf(known, np.zeros((n, kinds)), np.zeros((kinds, kinds)), np.zeros(kinds))
    index, real = _padded([model.numbers(rows) for rows, _ in examples])
    gold = np.zeros(real.shape, np.int64)
    for i, (_, wanted) in enumerate(examples):
        gold[i, : len(wanted)] = wanted
    hot = np.eye(kinds)[gold] * real[:, :, None]
    seen = np.einsum("sta,stb->ab", hot[:, :-1], hot[:, 1:])
    weights, moves, start = model.weights, model.moves, model.start
    squares = [np.full(x.shape, 1e-8) for x in (weights, moves, start)]
    length = index.shape[1]
    for _ in range(rounds):
        emit = weights[index].sum(2)
        ahead, behind = np.zeros(emit.shape), np.zeros(emit.shape)
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, length):
            new = _log_sum(ahead[:, t - 1, :, None] + moves, 1) + emit[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        total = _log_sum(ahead[:, -1], 1)
        for t in range(length - 2, -1, -1):
            new = _log_sum(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(real[:, t + 1, None], new, 0)
        share = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
        expected = np.zeros_like(moves)
        for t in range(1, length):
            pair = ahead[:, t - 1, :, None] + moves + (emit[:, t] + behind[:, t])[:, None, :] - total[:, None, None]
            expected += np.exp(pair[real[:, t]]).sum(0)
        slope = (hot - share)[real]
        by_feature = np.zeros_like(weights)
        for column in range(index.shape[2]):
            np.add.at(by_feature, index[:, :, column][real], slope)
        by_feature[0] = 0
        scale = 1 / len(examples)
        gradients = by_feature * scale - decay * weights, (seen - expected) * scale - decay * moves, (hot - share)[:, 0].sum(0) * scale
        for value, gradient, square in zip((weights, moves, start), gradients, squares, strict=True):
            square += gradient**2
            value += rate * gradient / np.sqrt(square)
    return model


def found_spans(text: str, chains_: list[Chain], paths: list[np.ndarray], base: list[Span]) -> list[Span]:
    """The patterns' spans and those that the paths add: runs of one kind, without punctuation at the ends."""
    added = []
    for chain, path in zip(chains_, paths, strict=True):
        edges = np.flatnonzero(np.diff(path, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if path[a]:
                start, end = chain[a][0], chain[b - 1][1]
                value = text[start:end]
                start += len(value) - len(value.lstrip(_EDGE))
                end -= len(value) - len(value.rstrip(_EDGE))
                if end > start and not any(s < end and start < e for _, s, e in base):
                    added.append((int(path[a]) - 1, start, end))
    return sorted(base + added)


def _text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def labelled_chains(docs: DataFrame, sample: int = 2_000, chars: int = 20_000) -> list[tuple[list[list[str]], list[int]]]:
    """A small labelled table from ``docs(text)``: about ``sample`` different pieces with a digit or @, by a hash of the piece;
    texts are cut into pieces of ``chars`` characters, from the first to the last.  The patterns give the labels."""
    last = F.call_function("div", F.greatest(F.length("text") - 1, F.lit(0)), F.lit(chars))
    cut = F.transform(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")), lambda k: F.substring(F.col("text"), (k * chars + 1).cast("int"), F.lit(chars)))
    rows = docs.filter("text is not null").select(F.explode(cut).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000.0
    # Copies count once: all of them are drawn or none.
    total = rows.select(F.xxhash64("text").alias("hash")).distinct().count()
    out = []
    for row in rows.filter(draw < sample / max(total, 1)).distinct().orderBy("text").collect():
        spans = base_spans(row["text"])
        out += [(features(row["text"], x), labels(x, spans)) for c in chains(row["text"]) for x in (c[i : i + 40] for i in range(0, len(c), 40))]
    return out


def personal_data(docs: DataFrame, model: Crf | None) -> DataFrame:
    """``doc_id``, the counts and digest of the patterns' spans, and all spans, of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model and tuple(vars(model).values()))

    def find(batches):
        field = shared.value and Crf(*shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            base = [base_spans(x) for x in texts]
            spans = list(base)
            if field:
                found = [chains(x) for x in texts]
                flat = [field.numbers(features(x, c)) for x, cs in zip(texts, found, strict=True) for c in cs]
                paths = iter(field.decode(flat))
                spans = [found_spans(x, cs, [next(paths) for _ in cs], b) if cs else b for x, cs, b in zip(texts, found, base, strict=True)]
            columns = {"doc_id": batch.column("doc_id")}
            for k, kind in enumerate(KINDS):
                columns[f"n_{kind}"] = pa.array([sum(x[0] == k for x in b) for b in base], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(_text(b).encode()).hexdigest() for b in base])
            columns["spans"] = pa.array([_text(x) for x in spans])
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(find, schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, train(labelled_chains(docs)))
