"""Alignment of two tokenisers' tokens over the bytes of each text.

Both tokenisers cut the same bytes, a space and the text. Each marks the last byte of its tokens in a packed bitset. The
AND of the two holds the cuts they share; the number of bits before a cut, from running popcounts, gives the tokens of
either side that end there, and so the groups of tokens that cover the same bytes. The OR holds every end of a piece that
lies in one token on either side: each piece is one link, and the popcounts before it give the two tokens it links.

How often a pair of ids is linked in the whole corpus weighs the links. Texts and tokens stay where they are: a task makes
blocks of texts of a few million characters and settles, for each block, its distinct pairs with their counts and, packed, which of
them each text has how often - a sparse matrix of texts by pairs. Pairs are summed over blocks, the largest
count for each id is found, and the weights of its pairs go back to a block, which multiplies its matrix with them.
"""

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corvane.llm.common import settle
from corvane.llm.packing import Encoder

VOCABULARIES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of texts that make up a block; a longer text is a block by itself.
BLOCK_CHARS = 4_000_000
#: Texts of a block at most, so that many short ones don't make it large.
BLOCK_TEXTS = 20_000


class ByteTokens(Encoder):
    """A byte-level vocabulary of the `tokenizers` library. Special tokens in a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        n = self.fast.max_token_value + 1
        known = self.fast._mergeable_ranks  # noqa: SLF001  the bytes of each token
        self.bytes = [b""] * n
        for token, i in known.items():
            self.bytes[i] = token

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except MemoryError:
            raise
        except BaseException as gave_up:  # noqa: BLE001  the engine's panics aren't Exceptions
            if not isinstance(gave_up, Exception) and type(gave_up).__name__ != "PanicException":
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
                self.slow.encode_special_tokens = True
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)


class PieceTokens:
    """A vocabulary of `sentencepiece`, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text)


class Aligner:
    """Two tokenisers and what is known of their tokens."""

    def __init__(self, first: str, second: str):
        self.a, self.b = ByteTokens(first), PieceTokens(second)
        self.sizes = [np.array([len(t) for t in side.bytes], np.int64) for side in (self.a, self.b)]
        self.written = [f"{i}{end}" for i in range(max(map(len, self.sizes))) for end in ",|;"]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both sides; None where either's bytes aren't the space and the text, and for an empty text."""
        if not text:
            return None
        whole = f" {text}"
        data = whole.encode("utf-8", "surrogatepass")
        second = self.b(text)
        if b"".join(map(self.b.bytes.__getitem__, second)) != data:
            return None
        a, b = self.a(whole), np.array(second, np.int64)
        return (a, b) if self.sizes[0][a].sum() == len(data) else None  # A's tokens are stretches of the bytes it was given

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of A, tokens of B) that end at or before each shared cut, and the numbers of the linked tokens."""
        bits = [end_bits(size[ids]) for size, ids in zip(self.sizes, (a, b))]
        before = [ranks(x) for x in bits]
        shared = places(bits[0] & bits[1])
        pieces = places(bits[0] | bits[1])
        cuts = [rank(x, r, shared) + 1 for x, r in zip(bits, before)]
        links = [rank(x, r, pieces) for x, r in zip(bits, before)]
        return *cuts, *links

    def groups_text(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """Each group's ids as a1,a2|b1, groups joined by semicolons."""
        own, other = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        own[cut_a - 1], other[cut_b - 1] = 1, 2  # what follows a token: its kin, the other side, the next group
        before = np.r_[0, cut_b[:-1]]  # tokens of B in the groups before
        place_a = np.arange(len(a)) + np.repeat(before, np.diff(cut_a, prepend=0))
        place_b = np.arange(len(b)) + np.repeat(cut_a, np.diff(cut_b, prepend=0))
        line = np.empty(len(a) + len(b), np.int64)
        line[place_a], line[place_b] = 3 * a + own, 3 * b + other
        return "".join(map(self.written.__getitem__, line.tolist()))[:-1]


def end_bits(sizes: np.ndarray) -> np.ndarray:
    """A bitset of bytes, in words of 64, with the last byte of each token marked."""
    ends = sizes.cumsum()
    marks = np.zeros((int(ends[-1]) + 63) // 64 * 64, np.uint8)
    marks[ends - 1] = 1
    return np.packbits(marks, bitorder="little").view("<u8")


def ranks(bits: np.ndarray) -> np.ndarray:
    """How many bits are set before each word."""
    counts = np.bitwise_count(bits).astype(np.int64)
    return counts.cumsum() - counts


def rank(bits: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set before each place."""
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    return before[word] + np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))


def places(bits: np.ndarray) -> np.ndarray:
    """The places of all set bits."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


@lru_cache(maxsize=2)
def aligner(first: str, second: str) -> Aligner:
    return Aligner(first, second)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return tuple(public_tokenizers.path(v) for v in VOCABULARIES)


def _pack(x: np.ndarray, kind: str) -> bytes:
    return zlib.compress(x.astype(kind).tobytes(), 1)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind).astype(np.int64)


#: Bits of an id of the second side within the number of a pair.
_SHIFT = 32


def _block(work: Aligner, texts: list[str], with_groups: bool) -> tuple[list[dict], np.ndarray, np.ndarray, dict]:
    """Columns of each text; the block's distinct pairs and their counts; its matrix, packed."""
    rows, pairs = [], []
    for text in texts:
        ids = work.tokens(text)
        if ids is None:
            rows.append({"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": "" if with_groups else None, "groups_sha256": ""})
            pairs.append(np.empty(0, np.int64))
            continue
        a, b = ids
        cut_a, cut_b, link_a, link_b = work.align(a, b)
        groups = work.groups_text(a, b, cut_a, cut_b)
        sha = hashlib.sha256(groups.encode()).hexdigest()
        rows.append({"n_a": len(a), "n_b": len(b), "n_groups": len(cut_a), "n_links": len(link_a), "groups": groups if with_groups else None, "groups_sha256": sha})
        pairs.append(a[link_a] << _SHIFT | b[link_b])
    inverse, keys = pd.factorize(np.concatenate(pairs), sort=True)
    counts = np.bincount(inverse, minlength=len(keys))
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in pairs])
    cells, times = np.unique(owner * max(len(keys), 1) + inverse, return_counts=True)  # by text, then by pair
    text, pair = np.divmod(cells, max(len(keys), 1))
    starts = np.searchsorted(text, np.arange(len(texts) + 1))
    first = np.zeros(len(pair), bool)
    first[starts[:-1][starts[:-1] < starts[1:]]] = True
    steps = np.where(first, pair, np.diff(pair, prepend=0))  # small numbers within a text
    return rows, keys, counts, {"starts": _pack(starts, "<i8"), "steps": _pack(steps, "<i4"), "times": _pack(times, "<i4")}


def blocks_of(docs: DataFrame, id_col: str, text_col: str, vocabularies: tuple[str, str], with_groups: bool, block_chars: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    columns = "n_a: long, n_b: long, n_groups: long, n_links: long, groups: string, groups_sha256: string"
    schema = f"block long, texts array<struct<id: {kind}, {columns}>>, pairs array<long>, counts array<long>, starts binary, steps binary, times binary"

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def cut(batches: Iterator) -> Iterator:
        work, number = aligner(*vocabularies), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id").to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and end - at < BLOCK_TEXTS and (end == at or size + len(texts[end]) <= block_chars):
                    size += len(texts[end])
                    end += 1
                rows, keys, counts, matrix = _block(work, texts[at:end], with_groups)
                row = {"block": number, "texts": [{"id": i, **r} for i, r in zip(ids[at:end], rows)], "pairs": keys, "counts": counts, **matrix}
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in arrow], schema=arrow)
                at, number = end, number + 1

    return docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(cut, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): links that hold the pair linked, and whether no other pair of its second id is linked more often."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = settle(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    second = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    most = counts.groupBy(second.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", second).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None, with_groups: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row: the id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; `with_groups` adds the
    groups themselves, as a1,a2|b1;a3|b2,b3.

    `vocabularies` are the paths of a byte-level BPE file (A) and of a sentencepiece model (B). A text that is null or
    empty, or whose tokens of either side don't join to a space and the text, has no tokens: zeros and an empty
    groups_sha256. Repeated rows count as often as they occur; null ids are carried along; other columns are ignored;
    an empty table gives an empty result. A very long text is a block by itself.

    A pair that every text has comes once per block, and is summed by partial aggregation; its join with the sums is a
    plain one, whose oversized partitions adaptive execution splits.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = settle(blocks_of(docs, id_col, text_col, vocabularies or default_vocabularies(), with_groups, block_chars), "blocks")
    weights = settle(pair_counts(blocks), "pair-weights")
    pairs = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    weighed = pairs.join(weights, "pair").select(F.col("block").alias("of"), "at", "n", "best")
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"
    names = [c.split()[0] for c in schema.split(", ")]

    def multiply(blocks: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        pairs = pairs.sort_values("at")
        n, best = pairs["n"].to_numpy(np.int64), pairs["best"].to_numpy(bool)
        for row in blocks.itertuples():
            starts, steps, times = _unpack(row.starts, "<i8"), _unpack(row.steps, "<i4"), _unpack(row.times, "<i4")
            for text, lo, hi in zip(row.texts, starts, starts[1:]):
                at, k = steps[lo:hi].cumsum(), times[lo:hi]
                out.append({**text, "n_best": int(k[best[at]].sum()), "count_sum": int(k @ n[at])})
        return pd.DataFrame({c: pd.Series([r[c] for r in out], dtype=object) for c in names})

    moved = blocks.select("block", "texts", "starts", "steps", "times")
    done = moved.groupBy("block").cogroup(weighed.groupBy("of")).applyInPandas(multiply, schema)
    return done.withColumnRenamed("id", id_col).drop(*[] if with_groups else ["groups"])
