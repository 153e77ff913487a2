"""Language identification by word-first backoff.

A known word adds the logarithm of its frequency in each language. An unknown word is read as character n-grams: the longest n for which
any of its n-grams is known gives its mean log frequencies, shorter ones are only tried after that. A text's languages are compared by
the mean over its words; the score is the winner's share after a softmax over the words' evidence.

The model is fitted on training rows chosen by a hash of their id and text: about ``fit_rows`` of every language at most, so that a rare
language is learned beside one that holds nearly all rows. It keeps the ``max_words`` most frequent words and n-grams a language, which
bounds what is broadcast; any other word is scored by its n-grams, as are runs of more than 40 letters. Every row is scored over its
whole text.

Defined results: a null text and a text without a letter are ``und`` with score 0, and so is every text if nothing was learned. Ties go
to the language that sorts first. Rows with a null id are in no fold: they are scored but not learned from. Repeated rows are scored
each; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.llm.common import opened, shared_value, slices
from logsift.scratch import saved

UNKNOWN = "und"
LONGEST_GRAM = 4
LONGEST_WORD = 40  # longer runs of letters are no words of the model; they are scored by their n-grams like any unknown word
KEPT_WORDS = 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked."""
    marked = f"<{word}>"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    words: dict[str, tuple[float, ...]]  # log frequency by language
    grams: dict[str, tuple[float, ...]]
    floor: tuple[float, ...]

    def evidence(self, word: str) -> tuple[float, ...]:
        """Log frequencies of one word by language."""
        found = self.words.get(word)
        if found is not None:
            return found
        for n in range(LONGEST_GRAM, 0, -1):
            known = [self.grams[g] for g in grams(word, n) if g in self.grams]
            if known:
                return tuple(sum(x) / len(known) for x in zip(*known, strict=True))
        return self.floor


class Scorer:
    """Scores texts, with the evidence of words kept between texts."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.kept: dict[str, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        found = self.kept.get(word)
        if found is None:
            found = np.array(self.model.evidence(word))
            if len(word) <= LONGEST_WORD:  # long runs seldom return, and would fill the memory
                if len(self.kept) >= KEPT_WORDS:
                    self.kept.clear()
                self.kept[word] = found
        return found

    def score(self, text: str | None) -> tuple[str, float]:
        counts = Counter(LETTERS.findall(text.lower())) if text else None
        if not counts or not self.model.languages or not any(c.isalpha() for word in counts for c in word):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages))
        for word, n in counts.items():
            # A word that fills the text says little more than the word itself.
            total += self.word(word) * (1 + math.log(n))
        best = int(total.argmax())
        share = np.exp(total - total[best])
        return self.model.languages[best], float(1 / share.sum())


def fit(training: DataFrame, fit_rows: int = 10_000, max_words: int = 20_000, max_grams: int = 20_000) -> Model:
    """A model of ``text, lang``. Spark counts the words; the most frequent of each language come to the driver, n-grams are theirs."""
    rows = training.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    # The bound on what is learned from. Rows are chosen by a hash, so the choice is the same on every run.
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.count(F.lit(1))).alias("share"))
    share = saved(share, "language-shares")  # a row for each language
    rows = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    every = F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"[\p{L}]+"), 0)
    counted = saved(
        rows.select("lang", F.explode(every).alias("word")).where(F.length("word") <= LONGEST_WORD).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")),
        "words",
    )
    words = _frequent(counted, max_words)
    # N-grams are counted over different words, as that is where they are needed.
    pieces = {lang: Counter(g for word in held for n in range(1, LONGEST_GRAM + 1) for g in grams(word, n)) for lang, held in words.items()}
    return Model(*_tables(words, {lang: dict(held.most_common(max_grams)) for lang, held in pieces.items()}))


def _frequent(counted: DataFrame, most: int) -> dict[str, dict[str, int]]:
    """The ``most`` frequent words by language: limited in every task first, so that no task and not the driver meets all of them."""
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(64)))
    order = [F.desc("n"), "word"]
    early = salted.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= most)
    top = early.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    found: dict[str, dict[str, int]] = {}
    for row in top.orderBy("lang", "rank").select("lang", "word", "n").collect():
        found.setdefault(row["lang"], {})[row["word"]] = row["n"]
    return found


def _tables(words: dict[str, dict[str, int]], pieces: dict[str, dict[str, int]]) -> tuple:
    languages = sorted(words)

    def logs(counts: dict[str, dict[str, int]]) -> dict[str, tuple[float, ...]]:
        totals = [sum(counts.get(x, {}).values()) + 1 for x in languages]
        keys = {k for x in languages for k in counts.get(x, {})}
        return {k: tuple(math.log((counts.get(x, {}).get(k, 0) + 0.5) / t) for x, t in zip(languages, totals, strict=True)) for k in keys}

    return languages, logs(words), logs(pieces), tuple(0.0 for _ in languages)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``doc_id, text``, from the text alone."""
    shared = shared_value(docs.sparkSession, model)

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(opened(shared))
        for batch in slices(batches, 512):
            found = [scorer.score(x) for x in batch.column("text").to_pylist()]
            languages, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(scored, "doc_id bigint, lang_pred string, score double")


def learn_and_identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """Fit on the rows that are not held out and have an id, then identify every row; ``held_out`` comes along."""
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
