"""Language identification by multilingual mixture inference.

Languages are known by counts of hashed character n-grams of their words. A document is a mixture: each of its words
comes from one language, in unknown proportions, which expectation-maximisation estimates from the words' n-gram
likelihoods. The set of languages is the one with the best penalised likelihood: starting from all, the smallest
language is taken out while that improves the score. The prediction is the language with the largest proportion.

Learning counts all rows that may be learned from, aggregated before anything is shuffled. The model keeps, for each
bucket, the languages that have it and their counts, at most MAX_COUNTS of them whatever the input, and goes to the tasks
with the function that uses it.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from corvane.llm.common import settle

BUCKETS = 1 << 16
#: Pairs of a language and a bucket that a model holds; learning more than that is an error.
MAX_COUNTS = 1 << 24
#: More values than this in the language column aren't languages.
MAX_LANGUAGES = 1 << 16
NGRAM = 3
SMOOTHING = 0.2
#: What one more language costs, times the logarithm of the number of words.
PENALTY = 3.0
ROUNDS = 25
#: Distinct words whose counts a task holds while it learns.
HELD_WORDS = 300_000
#: Likelihoods that a task holds, and that it works on at a time: words times languages.
HELD_VALUES = 1_200_000
VALUES_AT_ONCE = 800_000

_WORD = re.compile(r"[^\W\d_]+")


def _letters(word: str) -> list[str]:
    """The stretches of letters: the pattern also takes fractions, superscripts, circled and Roman numbers for letters."""
    return "".join(c if c.isalpha() else " " for c in word).split()


def words_of(text: str | None) -> list[str]:
    words = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [part for word in words for part in ([word] if word.isalpha() else _letters(word))]


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of words, their ends marked, one word after the other; and how many each has."""
    held, out, sizes = {}, [], []
    for word in words:
        marked = f"^{word}$"
        grams = [marked[i : i + NGRAM] for i in range(len(marked) - NGRAM + 1)]
        out += grams
        sizes.append(len(grams))
    for gram in set(out):
        held[gram] = xxh32_intdigest(gram.encode("utf-8", "surrogatepass")) % BUCKETS
    return np.fromiter(map(held.__getitem__, out), np.int64, len(out)), np.array(sizes, np.int64)


@dataclass(frozen=True)
class Languages:
    names: tuple[str, ...]
    #: Log probability, for each language, of a bucket that it doesn't have.
    unseen: np.ndarray
    #: Where the languages of each bucket begin; the languages; by how much they exceed `unseen` there.
    starts: np.ndarray
    langs: np.ndarray
    gains: np.ndarray

    def of(self, words: list[str]) -> np.ndarray:
        """Log likelihoods, words by languages."""
        at, sizes = buckets_of(words)
        many = np.diff(self.starts)[at]
        places = np.arange(many.sum()) + np.repeat(self.starts[at] - (many.cumsum() - many), many)
        cell = np.repeat(np.repeat(np.arange(len(words)), sizes) * len(self.names), many) + self.langs[places]
        sums = np.bincount(cell, weights=self.gains[places], minlength=len(words) * len(self.names))
        return sums.reshape(len(words), -1) + sizes[:, None] * self.unseen


def model_of(names: tuple[str, ...], langs: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> Languages:
    """A model of counts of pairs of a language's number and a bucket."""
    order = np.argsort(buckets, kind="stable")
    langs, buckets, counts = langs[order], buckets[order], counts[order]
    totals = np.bincount(langs, weights=counts, minlength=len(names))
    used = max(len(np.unique(buckets)), 1)
    unseen = np.log(SMOOTHING) - np.log(totals + SMOOTHING * 2 * used)
    return Languages(names, unseen, np.searchsorted(buckets, np.arange(BUCKETS + 1)), langs.astype(np.int32), np.log(counts / SMOOTHING + 1.0))


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Languages:
    """N-gram counts of every row with a text and a language, whole texts of any length. Repeated rows count as often as they
    occur; other columns are ignored. ValueError if there is no such row, or more than MAX_LANGUAGES languages or MAX_COUNTS counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush() -> Iterator[pd.DataFrame]:
            for lang, words in seen.items():
                at, sizes = buckets_of(list(words))
                often = np.fromiter(words.values(), np.int64, len(words))
                sums = np.bincount(at, weights=np.repeat(often, sizes), minlength=BUCKETS).astype(np.int64)
                at = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": sums[at]})

        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                seen.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, seen.values())) > HELD_WORDS:
                    yield from flush()
                    seen = {}
        yield from flush()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counted = settle(rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "n-grams")
    names = tuple(sorted(r.lang for r in counted.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()))
    if not names or len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages to learn from; 1 to {MAX_LANGUAGES} are possible")
    if (size := counted.count()) > MAX_COUNTS:
        raise ValueError(f"{size} pairs of languages and n-grams; at most {MAX_COUNTS} are possible")
    found = counted.toArrow()
    number = {name: i for i, name in enumerate(names)}
    lang = found.column("lang").combine_chunks().dictionary_encode()
    langs = np.array([number[x] for x in lang.dictionary.to_pylist()], np.int64)[lang.indices.to_numpy()]
    return model_of(names, langs, found.column("bucket").to_numpy(), found.column("n").to_numpy())


class Likelihoods:
    """Log likelihoods of words under each language, each word's computed once while it is held."""

    def __init__(self, model: Languages):
        self.model, self.at, self.rows = model, {}, np.empty((1024, len(model.names)))
        self.most, self.part = max(1, HELD_VALUES // len(model.names)), max(1, VALUES_AT_ONCE // 4 // len(model.names))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.at) > self.most:
            self.at = {}
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if new:
            first, end = len(self.at), len(self.at) + len(new)
            while end > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.at.update(zip(new, range(first, end)))
            for start in range(0, len(new), self.part):
                part = new[start : start + self.part]
                self.rows[first + start : first + start + len(part)] = self.model.of(part)
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def mixtures(logs: np.ndarray, counts: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document, by expectation-maximisation over the languages allowed to it.
    logs: words by languages; counts: of the words; starts: of the documents' words; allowed: documents by languages."""
    sizes = np.diff(np.r_[starts, len(logs)])
    doc = np.repeat(np.arange(len(starts)), sizes)
    masked = np.where(allowed[doc], logs, -np.inf)
    top = masked.max(axis=1, keepdims=True)
    like = np.exp(masked - top)
    total = np.add.reduceat(counts, starts)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        joint = like * share[doc]
        both = joint.sum(axis=1)
        new = np.add.reduceat(joint * (counts / both)[:, None], starts) / total[:, None]
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-3:
            break
    both = (like * share[doc]).sum(axis=1)
    return share, np.add.reduceat(counts * (np.log(np.maximum(both, 1e-300)) + top[:, 0]), starts)


def _subset(rows: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words of some documents, and where each document's begin there."""
    ends = np.r_[starts[1:], n]
    sizes = (ends - starts)[rows]
    at = np.r_[0, np.cumsum(sizes)[:-1]]
    return np.arange(sizes.sum()) + np.repeat(starts[rows] - at, sizes), at


def best_mixtures(logs: np.ndarray, counts: np.ndarray, starts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of each document over its best set of languages; zero outside the set."""
    n_docs, n_langs = len(starts), logs.shape[1]
    cost = penalty * np.log(np.add.reduceat(counts, starts) + 1)
    alone = np.add.reduceat(logs * counts[:, None], starts)
    best = np.zeros((n_docs, n_langs))
    best[np.arange(n_docs), alone.argmax(axis=1)] = 1.0
    score = alone.max(axis=1) - cost
    allowed = np.ones((n_docs, n_langs), bool)
    open_ = np.arange(n_docs)
    for size in range(n_langs, 1, -1):
        at, begin = _subset(open_, starts, len(logs))
        share, like = mixtures(logs[at], counts[at], begin, allowed[open_])
        better = like - size * cost[open_] > score[open_]
        best[open_[better]], score[open_[better]] = share[better], (like - size * cost[open_])[better]
        left = like - 2 * cost[open_] > score[open_]  # no smaller set can have a higher likelihood than this one
        left |= better & (size > 2)
        smallest = np.where(allowed[open_], share, np.inf).argmin(axis=1)
        allowed[open_, smallest] = False
        open_ = open_[left]
        if not len(open_):
            break
    return best


def identify(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, lang_pred, score, and langs and shares of the whole set, largest first.

    `und` with score 0 if the text is null or has no letter. Equal shares go by the languages' order. Only the text is
    read; repeated rows get equal results. The whole text counts, however long. An empty table gives an empty result.
    """
    names = model.names

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Likelihoods(model)

        def close(found: list[Counter]) -> list[tuple]:
            some = [c for c in found if c]
            shares = iter(())
            if some:
                logs = held.of([w for c in some for w in c])
                counts = np.concatenate([np.fromiter(c.values(), float, len(c)) for c in some])
                shares = iter(best_mixtures(logs, counts, np.r_[0, np.cumsum([len(c) for c in some])[:-1]]))
            out = []
            for c in found:
                if not c:
                    out.append(("und", 0.0, [], []))
                    continue
                share = next(shares)
                order = [i for i in np.argsort(-share, kind="stable") if share[i] > 0]
                out.append((names[order[0]], float(min(share[order[0]], 1.0)), [names[i] for i in order], [float(share[i]) for i in order]))
            return out

        for batch in batches:
            rows, waiting, size = [], [], 0
            for text in batch["text"]:
                waiting.append(Counter(words_of(text)))
                size += len(waiting[-1])
                if size * len(names) > VALUES_AT_ONCE:
                    rows, waiting, size = rows + close(waiting), [], 0
            rows += close(waiting)
            yield pd.concat([batch[["id"]], pd.DataFrame(rows, columns=["lang_pred", "score", "langs", "shares"], index=batch.index)], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInPandas(infer, f"id {kind}, lang_pred string, score double, langs array<string>, shares array<double>").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo 3, is 1; rows without an id are held out too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))
