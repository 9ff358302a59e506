"""Packing tokens into sequences: first-fit decreasing over a tournament tree, in randomised groups.

Each document is tokenised once; its ids and an end id are cut into pieces of at most `length`. Only the pieces' sizes
travel from there on. A piece goes to a group by a seeded hash, in groups of about `group_pieces` at every input size,
and each group is packed on its own: sizes in decreasing order, each to the first sequence with room for it. A
tournament tree over the sequences' free room, whose inner nodes hold the larger of their two children, finds that
sequence in logarithmic time.
"""

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import settle

LENGTH = 2048
END_ID = 1
GROUP_PIECES = 4096
#: Equal pieces that one row deals out.
COPIES_AT_ONCE = 1 << 16
VOCABULARY = "byte_bpe_50k.json"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Ids of a byte-level BPE file of the `tokenizers` library, special tokens in a text recognised as it does.

    The same merges run here in tiktoken, several times as fast. A text that makes its pattern engine give up (some
    hundred thousand white spaces in a row) goes to the library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self.slow = path, None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except MemoryError:
            raise
        except BaseException as gave_up:  # noqa: BLE001  the engine's panics aren't Exceptions
            if not isinstance(gave_up, Exception) and type(gave_up).__name__ != "PanicException":
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) for each piece of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    rows.append((key, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), *([piece.astype(np.int32)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")]).astype({"id": batch["id"].dtype})

    return docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(cut, schema)


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size, its bin and its offset there: largest first, ties in the order given, each to the first bin with
    room. Sizes are 1 to `room`."""
    n = len(sizes)
    leaves = 1 << max(n - 1, 0).bit_length()
    tree = [room] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for item in np.argsort(-sizes, kind="stable"):
        size, at = int(sizes[item]), 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[item], offsets[item] = at - leaves, room - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
    return bins, offsets


def _numbered_copies(pieces: DataFrame) -> DataFrame:
    """Pieces with the number of each among equal ones, so that the rows of a piece that repeats spread over groups. Equal
    pieces are counted and dealt out again, COPIES_AT_ONCE of them by one row."""
    whole = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    rest = [F.first(c).alias(c) for c in pieces.columns if c not in whole]
    counted = pieces.groupBy(*whole).agg(F.count(F.lit(1)).alias("_n"), *rest)
    parts = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES_AT_ONCE).cast("long"))))
    parts = parts.repartition("id", "start", "_from")
    last = F.least(F.col("_n"), F.col("_from") + COPIES_AT_ONCE) - 1
    return parts.select(*pieces.columns, F.explode(F.sequence("_from", last)).alias("_copy"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, seed: int = 11, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id and offset (with `with_ids` also
    the ids themselves).

    Null and empty texts are the end id alone; texts may be of any length. Repeated rows are packed as often as they occur, each
    in a group of its own choosing. Null ids are carried
    along. Other columns are ignored. An empty table gives an empty result. Sequence ids are the group's number times
    2^32 plus the sequence's number in the group.
    """
    pieces = settle(token_pieces(docs, id_col, text_col, vocabulary or default_vocabulary(), length, end_id, with_ids), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    numbered = _numbered_copies(pieces)
    group = F.pmod(F.xxhash64("id", "start", "ids_crc32", "_copy", F.lit(seed)), F.lit(groups)).cast("long")
    order = ["id", "start", "ids_crc32", "_copy"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ignore_index=True).drop(columns=["_group", "_copy"])
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        return rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return numbered.withColumn("_group", group).groupBy("_group").applyInPandas(fill, schema).withColumnRenamed("id", id_col)
