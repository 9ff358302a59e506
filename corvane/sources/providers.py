"""What the engine takes from outside: embeddings, extractions, page fetches. Each is a function that a caller gives; the
ones here work offline and always give the same result."""

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.contents import Source, valid_page
from corvane.functions.text import decoded
from corvane.session import settle

#: texts -> one vector each
Embedder = Callable[[list[str]], np.ndarray]
#: url -> (status, body)
Fetcher = Callable[[str], tuple[int, bytes]]


def hashed_embedder(size: int = 64) -> Embedder:
    """Unit vectors of hashed words: texts with words in common point the same way."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % size] += 1 if h >> 32 & 1 else -1
            row /= np.linalg.norm(row) or 1
        return out

    return embed


def embedded(text: Column, embed: Embedder) -> Column:
    """Vectors of a text column, a batch at a time; null for null."""

    def run(texts: pd.Series) -> pd.Series:
        vectors = embed(["" if t is None else t for t in texts])
        return pd.Series([None if t is None else v for t, v in zip(texts, vectors)], dtype=object)

    return F.pandas_udf(run, "array<float>")(text)


def retry_delay(attempt: int) -> float:
    return min(0.5 * 2 ** (attempt - 1) + 0.1 * attempt, 30)


@dataclass(frozen=True)
class RetryRule:
    """Which answers are asked for again, how often, and after how many seconds (of the number of the try, from 1)."""

    tries: int
    again: Callable[[int], bool]
    delay: Callable[[int], float]


#: 403, 429 and 5xx are tried again, with growing pauses; what is left is an error.
PATIENT = RetryRule(6, lambda status: status in (403, 429) or status >= 500, retry_delay)
#: Three tries, one, two and four seconds apart; of 4xx only 429 is tried again, and all of them are errors.
BRIEF = RetryRule(3, lambda status: status == 429 or status >= 500, lambda k: float(2 ** (k - 1)))


def fetched(urls: DataFrame, fetch: Fetcher, tries: int | None = None, pause: Callable[[float], None] = time.sleep, gap: float = 0.0, rule: RetryRule = PATIENT) -> DataFrame:
    """(url, http_status, body, error, tries) of each url. Answers that the rule names, and requests that fail, are tried again, other
    answers stand; each task keeps `gap` seconds between its requests."""
    most = tries or rule.tries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                status, body, error, k = None, None, None, 0
                for k in range(1, most + 1):
                    try:
                        status, body = fetch(url)
                        error = f"http {status}" if rule.again(status) else None
                    except OSError as problem:
                        status, body, error = None, None, str(problem)
                    if error is None or k == most:
                        break
                    pause(rule.delay(k))
                rows.append((url, status, body if error is None else None, error, k))
                if gap:
                    pause(gap)
            yield pd.DataFrame(rows, columns=["url", "http_status", "body", "error", "tries"]).astype({"http_status": "Int32"})

    return urls.select("url").mapInPandas(run, "url string, http_status int, body binary, error string, tries int")


def fetch_missing(wanted: DataFrame, manifest: DataFrame, keys: list[str], fetch: Fetcher, **options) -> DataFrame:
    """Pages that no valid record of the manifest covers yet."""
    return fetched(wanted.join(manifest.where("valid").select(*keys), keys, "left_anti"), fetch, **options)


def fetch_records(wanted: DataFrame, stored: DataFrame, source: Source, fetch: Fetcher, force: bool = False, **options) -> DataFrame:
    """(section, url, http_status, bytes, content_sha256, valid, cached, error, body) for each wanted section (section, url): pages that are
    stored (section, body) and not empty are checked again instead of being fetched, unless `force`; the others are fetched. A
    page is valid if it is large enough and has what the source's pages have; bodies of pages that aren't are null, so that only valid ones get
    stored. Answers that stay refused are errors, which the next run tries again. Fetches are made once: they are settled."""
    text = F.coalesce(decoded(F.col("body")), F.lit(""))
    held = wanted.limit(0).select("section", F.lit(None).cast("binary").alias("body")) if force else stored.where("octet_length(body) > 0").select("section", "body")
    cached = wanted.join(held, "section").select("section", "url", "body", F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    missing = wanted.join(held.select("section"), "section", "left_anti")
    fresh = settle(missing.select("url").distinct().transform(lambda urls: fetched(urls, fetch, **options)), "fetched")
    asked = missing.join(fresh, "url").select("section", "url", "body", F.coalesce("http_status", F.lit(0)).alias("http_status"), "error", F.lit(False).alias("cached"))
    both = cached.unionByName(asked)
    valid = F.col("error").isNull() & F.coalesce(valid_page(text, source), F.lit(False)) & F.col("body").isNotNull()
    checked = both.withColumn("valid", valid)
    return checked.select(
        "section", "url", "http_status", F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("bytes"), F.when(F.col("body").isNull(), "").otherwise(F.sha2("body", 256)).alias("content_sha256"), "valid", "cached", "error",
        F.when(F.col("valid"), F.col("body")).alias("body"),
    )


def classified(text: Column, classify: Callable[[str], list[str]], tries: int = 3, pause: Callable[[float], None] = time.sleep) -> Column:
    """struct(tags, error) by a classifier, such as a language model, that a caller passes in. A call that raises OSError
    is tried again after a pause; what fails to the end has null tags and its error. Null texts have no tags. Each task
    calls for one text at a time, so tasks are the bound on calls at once."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            tags, error = None, None
            for k in range(1, tries + 1 if t is not None else 0):
                try:
                    tags, error = classify(t), None
                    break
                except OSError as problem:
                    error = str(problem)
                    if k < tries:
                        pause(retry_delay(k))
            rows.append((tags, error))
        return pd.DataFrame(rows, columns=["tags", "error"])

    return F.pandas_udf(run, "tags array<string>, error string").asNondeterministic()(text)
