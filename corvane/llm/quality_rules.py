"""Quality rules as a learned decision list.

Sequential covering: a rule is a conjunction of thresholds on text statistics. Rows are split into a growing and a
pruning part; a rule grows by the threshold with the best information gain until it covers no good row, loses its last
conditions while that helps on the pruning part, and joins the list if it is precise enough there. The rows that it
covers go, and the next rule is grown on the rest. The list becomes one ordered chain of Spark conditionals.

Learning reads a bounded sample of labelled rows (`sample_rows`); statistics and verdicts cover every row and whole
text, without any shuffle.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import free_name

SAMPLE_ROWS = 20_000
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_punct")

_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _repeated(words: list[bytes], ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of five found twice or more, counted exactly."""
    m = len(words) - WINDOW + 1
    if m < 2:
        return 0
    key, size = ids[:m].copy(), distinct
    for i in range(1, WINDOW):
        if size * distinct >= 1 << 62:  # ranks in place of numbers that would not fit
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            size = int(key.max()) + 1
        key = key * distinct + ids[i : i + m]
        size *= distinct
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for i in range(WINDOW):
        inside[i : i + m] |= twice
    return int(inside.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS, of a whole text; null has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines, dup = set(), 0
    every = raw.split(b"\n")
    for line in every:
        if line.strip():
            dup += line in lines
            lines.add(line)
    at = lambda chars: int(of[list(chars)].sum())
    return (
        len(words), len(text or "") - at(SPACES), at(SYMBOLS), dup, _repeated(words, ids, len(seen)),
        len(every), len(seen), int(of[65:91].sum()), int(of[48:58].sum()), at(_PUNCT),
    )


def _counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(t) for t in texts], columns=COUNTS, dtype="int64")


def with_counts(docs: DataFrame, text_col: str = "text", into: str = "_counts") -> DataFrame:
    """`docs` and a struct column of the counts of each text."""
    counts = F.pandas_udf(_counts, ", ".join(f"{c} long" for c in COUNTS)).asNondeterministic()  # so that a filter on it doesn't count again
    return docs.withColumn(into, counts(F.col(text_col)))


def _share(a: str, b: str):
    return lambda c: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))


#: The statistics that rules may use, each as a column over the counts.
STATISTICS = {
    "words": lambda c: c("n_words").cast("double"),
    "word_length": _share("word_chars", "n_words"),
    "symbols_per_word": _share("n_symbols", "n_words"),
    "dup_line_share": _share("n_dup_lines", "n_lines"),
    "repeat_share": _share("n_repeat_words", "n_words"),
    "distinct_share": _share("n_distinct", "n_words"),
    "words_per_line": _share("n_words", "n_lines"),
    "upper_share": _share("n_upper", "word_chars"),
    "digit_share": _share("n_digits", "word_chars"),
    "punct_share": _share("n_punct", "word_chars"),
}


def statistics(counts: str = "_counts") -> dict[str, Column]:
    return {name: make(lambda c: F.col(f"{counts}.{c}")) for name, make in STATISTICS.items()}


def base_failed(counts: str = "_counts") -> Column:
    """Fewer than ten words, or more than a fifth of the words in repeated windows."""
    c = lambda name: F.col(f"{counts}.{name}")
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above, threshold): over the threshold if `above`, else at most the threshold."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def column(self, stats: dict[str, Column]) -> Column:
        found = F.lit(True)
        for name, above, cut in self.conditions:
            found = found & (stats[name] > F.lit(cut) if above else stats[name] <= F.lit(cut))
        return found

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if above else '<='} {cut:.6g}" for n, above, cut in self.conditions)


def _covers(x: dict[str, np.ndarray], conditions, n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for name, above, cut in conditions:
        hit &= x[name] > cut if above else x[name] <= cut
    return hit


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, hit: np.ndarray, cuts: int):
    p0, n0 = int((bad & hit).sum()), int((~bad & hit).sum())
    base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
    for name, values in x.items():
        here, is_bad = values[hit], bad[hit]
        order = np.argsort(here, kind="stable")
        v, b = here[order], is_bad[order]
        edge = np.flatnonzero(v[1:] > v[:-1])
        if not len(edge):
            continue
        edge = edge[np.unique(np.linspace(0, len(edge) - 1, cuts).astype(int))]
        below = np.cumsum(b)[edge].astype(float)
        for above, p, total in ((False, below, edge + 1.0), (True, p0 - below, len(v) - edge - 1.0)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / total) - base), 0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = gain[i], (name, above, float((v[edge[i]] + v[edge[i] + 1]) / 2))
    return best[1]


def learn_rules(frame: pd.DataFrame, bad: np.ndarray, seed: int = 5, most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.95, least_covered: int = 20, cuts: int = 256) -> list[Rule]:
    """A decision list for `bad` rows over the columns of `frame`; empty if nothing precise enough is found. Thresholds are
    tried at up to `cuts` places of each statistic, evenly spread over its distinct values; a list has at most `most_rules`
    rules of `most_conditions` conditions."""
    rules: list[Rule] = []
    grows = np.random.default_rng(seed).random(len(frame)) < 2 / 3
    x = {c: frame[c].to_numpy(float) for c in frame}
    left = np.ones(len(frame), bool)
    while len(rules) < most_rules:
        g, p = np.flatnonzero(left & grows), np.flatnonzero(left & ~grows)
        xg, bg, xp, bp = {c: v[g] for c, v in x.items()}, bad[g], {c: v[p] for c, v in x.items()}, bad[p]
        hit, conditions = np.ones(len(g), bool), []
        while (bg & hit).any() and (~bg & hit).any() and len(conditions) < most_conditions:
            found = _best_condition(xg, bg, hit, cuts)
            if not found:
                break
            conditions.append(found)
            hit &= _covers(xg, [found], len(g))

        def worth(k: int) -> float:
            h = _covers(xp, conditions[:k], len(p))
            return (2 * bp[h].mean() - 1) if h.any() else -1.0

        if not conditions:
            break
        keep = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        conditions = conditions[:keep]
        h = _covers(xp, conditions, len(p))
        covered = left & _covers(x, conditions, len(frame))
        if covered.sum() < least_covered or not h.any() or bp[h].mean() < least_precision or bad[covered].mean() < least_precision:
            break
        rules.append(Rule(tuple(conditions), float(bad[covered].mean()), int(covered.sum())))
        left &= ~covered
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, **options) -> list[Rule]:
    """Rules that reject rows labelled 0, from at most `sample_rows` labels, chosen by a hash of the id.

    Null labels and labels without a row are skipped. No labels, or labels of one kind: no rules.
    """
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) == 0).alias("_bad"))
    some = some.orderBy(F.xxhash64("_id"), "_id", "_bad").limit(sample_rows)
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(some), "_id")  # at most sample_rows
    rows = with_counts(read, "_t").where(~base_failed()).select("_id", "_bad", *(c.alias(n) for n, c in statistics().items()))
    sample = rows.toPandas().sort_values(["_id", "_bad"], ignore_index=True)
    if sample["_bad"].nunique() < 2:
        return []
    return learn_rules(sample[list(STATISTICS)], sample["_bad"].to_numpy(bool), **options)


def verdict(rules: list[Rule], counts: str = "_counts") -> tuple[Column, Column]:
    """(kept, rule): false where the base rules or a learned rule reject; the number of the first rule that fired,
    0 for the base rules, null if none did."""
    stats = statistics(counts)
    fired = F.when(base_failed(counts), F.lit(0))
    for i, rule in enumerate(rules, 1):
        fired = fired.when(rule.column(stats), F.lit(i))
    return fired.isNull(), fired


def quality_report(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, the counts, base_failed, kept and rule. Null and empty texts have no word and
    fail the base rules. Repeated rows get equal results; other columns are ignored."""
    kept, fired = verdict(rules)
    counted = with_counts(docs.select(F.col(id_col), F.col(text_col).alias("_t")), "_t")
    return counted.select(id_col, *(F.col(f"_counts.{c}").alias(c) for c in COUNTS[:5]), base_failed().alias("base_failed"), kept.alias("kept"), fired.alias("rule"))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of `docs` that neither the base rules nor a learned rule rejects, with all their columns.

    Null and empty texts have no word, so they go. Texts may be of any length. Repeated rows stay or go together. An empty
    table gives an empty result.
    """
    name = free_name(docs, "_counts")
    return with_counts(docs, text_col, name).where(verdict(rules, name)[0]).select(*docs.columns)
