"""Language ID by cross-parsing: the language whose text explains a text best wins.

A text is cut into the longest phrases that occur in a language's reference text.
The fewer phrases it takes, weighed by what a phrase of that reference costs, the
closer the language. A suffix automaton of each reference finds the phrases.
Phrases also end at every ``BLOCK`` bytes of a text, in all languages alike, so that
long texts are parsed in step with others: one phrase more in so many bytes at most.

A null text and one without letters is ``und`` with score 0. Ties go to the first
language in order. Labelled rows without a text teach nothing; without any labelled
text all are ``und``. Rows with an equal doc_id are judged one by one. Other columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
REFERENCE_BYTES = 40_000  # of each language, or less where there are very many
REFERENCE_DOCS = 48  # labelled texts of each language
TABLE_BYTES = 192 << 20  # of all languages' automata together

# Texts are parsed in blocks, which keeps many in step.
BLOCK = 2048
SHARPNESS = 8.0  # of the score: bits per byte are weighed so many times

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = ord(" ")
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def folded(text: str) -> np.ndarray:
    """UTF-8 bytes in lower case, with one blank for each run of other ASCII."""
    data = _FOLD[np.frombuffer(text.lower().encode("utf-8", "ignore"), np.uint8)]
    blank = data == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    return data[keep]


def suffix_automaton(codes: list[int], symbols: int) -> np.ndarray:
    """``next[state, symbol]``, where state 0 is none and state 1 the start."""
    moves: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for code in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(1)
        at = last
        while at and code not in moves[at]:
            moves[at][code] = new
            at = link[at]
        if at:
            to = moves[at][code]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = copy
                while at and moves[at].get(code) == to:
                    moves[at][code] = copy
                    at = link[at]
        last = new
    table = np.zeros((len(moves), symbols), np.int32)
    for state, out in enumerate(moves):
        for code, to in out.items():
            table[state, code] = to
    return table


class Languages:
    """Reference texts by language; workers build the automata once."""

    def __init__(self, references: dict[str, list[str]]) -> None:
        parts = {lang: [folded(t) for t in texts] for lang, texts in references.items()}
        symbols = len(np.unique(np.concatenate([np.zeros(0, np.uint8), *sum(parts.values(), [])]))) + 1
        # an automaton has up to two states a byte
        most = min(REFERENCE_BYTES, TABLE_BYTES // max(1, len(parts)) // (8 * symbols))
        self.names = sorted(lang for lang in parts if sum(map(len, parts[lang])))
        self.texts = {}
        for lang in self.names:
            share = max(1, most // len(parts[lang]))
            spread = np.concatenate([p[:share] for p in parts[lang]])
            rest = np.concatenate([p[share:] for p in parts[lang]])
            self.texts[lang] = np.concatenate([spread, rest])[:most]

    def __getstate__(self) -> dict:
        return {"names": self.names, "texts": self.texts}

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of bytes, all automata in one flat table, and where each begins."""
        symbol = np.zeros(256, np.int64)
        used = np.unique(np.concatenate(list(self.texts.values())))
        symbol[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        each = [suffix_automaton(symbol[self.texts[n]].tolist(), width) for n in self.names]
        starts = np.cumsum([0] + [t.size for t in each[:-1]])
        # a state is the place of its row in the flat table, 0 is none
        flat = np.concatenate(
            [np.where(t > 0, t * width + s, 0).ravel() for t, s in zip(each, starts, strict=True)]
        )
        return symbol, flat.astype(np.int32), (starts + width).astype(np.int32)

    @cached_property
    def costs(self) -> np.ndarray:
        """Bits that name a phrase: a place in the reference."""
        return np.array([math.log2(len(self.texts[n]) + 1) for n in self.names])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """How many phrases each text takes in each language; whole texts, in blocks."""
        symbol, flat, roots = self.tables
        owner, blocks = [], []
        for k, text in enumerate(texts):
            for at in range(0, len(text), BLOCK):
                owner.append(k)
                blocks.append(text[at : at + BLOCK])
        found = np.zeros((len(texts), len(self.names)), np.int64)
        order = sorted(range(len(blocks)), key=lambda b: -len(blocks[b]))
        for first in range(0, len(order), 4096):
            part = order[first : first + 4096]
            sizes = np.array([len(blocks[b]) for b in part])
            codes = np.zeros((sizes[0], len(part)), np.int32)
            for column, b in enumerate(part):
                codes[: sizes[column], column] = symbol[blocks[b]]
            counts = np.ones((len(self.names), len(part)), np.int32)
            state = np.repeat(roots[:, None], len(part), axis=1)
            root = state.copy()
            active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
            for step, n in enumerate(active):
                code = codes[step, :n]
                to = flat[state[:, :n] + code]
                stuck = to == 0
                counts[:, :n] += stuck
                # the byte that ends a phrase begins the next
                again = flat[root[:, :n] + code]
                to = np.where(stuck, again, to)
                state[:, :n] = np.where(to == 0, root[:, :n], to)
            np.add.at(found, [owner[b] for b in part], counts.T)
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        given = [t if t and _LETTER.search(t) else None for t in texts]
        data = [folded(t) if t else np.zeros(0, np.uint8) for t in given]
        if not self.names:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        sizes = np.maximum(1, [len(d) for d in data])
        bits = self.phrases(data) * self.costs / sizes[:, None]
        best = bits.argmin(axis=1)
        weight = np.exp2((bits.min(axis=1, keepdims=True) - bits) * SHARPNESS)
        score = 1.0 / weight.sum(axis=1)
        names = [self.names[b] if t else UNDETERMINED for b, t in zip(best, given, strict=True)]
        return names, [float(s) if t else 0.0 for s, t in zip(score, given, strict=True)]


def learn(labelled: DataFrame) -> Languages:
    """From ``text, lang``: ``REFERENCE_DOCS`` distinct texts of each language, chosen by hash.

    Only hashes are counted and ranked; texts are read for those chosen, up to
    ``REFERENCE_BYTES`` characters of each. What is broadcast and collected is
    bounded by these and the number of languages.
    """
    rows = labelled.select("lang", "text", F.xxhash64("text").alias("h"))
    rows = rows.where("lang is not null and text is not null")
    distinct = rows.select("lang", "h").distinct()
    place = F.pmod("h", F.lit(1_000_000_007).cast("long"))
    n = distinct.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("n"))
    few = distinct.join(n, F.col("lang") == F.col("_lang")).where(
        place * F.col("n") < 4 * REFERENCE_DOCS * 1_000_000_007
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))
    chosen = few.select("lang", "h", rank.alias("r")).where(F.col("r") <= REFERENCE_DOCS)
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "r")
    texts = texts.agg(F.min(F.substring("text", 1, REFERENCE_BYTES)).alias("text"))
    references: dict[str, list[str]] = {}
    for row in texts.orderBy("lang", "r").collect():
        references.setdefault(row["lang"], []).append(row["text"])
    return Languages(references)


def held_out(key: Column) -> Column:
    """Rows that take no part in learning: a quarter, by a checksum of their key."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, languages: Languages, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores = shared.value.predict(batch.to_pylist())
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"]
            )

    found = F.arrow_udf(run, "lang string, score double")(F.col(text))
    rest = [c for c in docs.columns if c != text]
    return docs.withColumn("_found", found).select(
        *rest, F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score")
    )


def language_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, learnt from the rows not held out."""
    out = held_out(F.col("doc_id"))
    languages = learn(docs.where(~out))
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), languages)
