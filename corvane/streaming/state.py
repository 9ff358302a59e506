"""State by key: what was last known of each key, kept by the stream itself instead of being read from a target."""

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from corvane.session import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MICROS, _KEY, _BUCKET = "_at_micros", "_key", "_bucket"


@contextmanager
def state_store(spark: SparkSession):
    """Streams that are started within use the state store that keeps keyed state out of the heap; the session's own setting comes back."""
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _STORE)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old)


class Known:
    """Digest, best quality and last time (microseconds) of each key of a bucket; a key is forgotten `keep` after its last record."""

    STATE = "keys array<string>, digests array<string>, qualities array<double>, seen array<long>"

    def __init__(self, digest: str, quality: str, rest: list[str], keep: timedelta, out: list[str]):
        self.digest, self.quality, self.rest, self.keep, self.out = digest, quality, rest, keep // timedelta(microseconds=1), out

    def __call__(self, bucket, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(rows)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        known = {key: last for key, *last in zip(*state.get)} if state.exists else {}
        order = self._order(batch)
        statuses, bests = np.empty(len(batch), dtype=object), np.empty(len(batch))
        for i, key, at, new, quality in zip(order, *(batch[c].to_numpy()[order].tolist() for c in (_KEY, _MICROS, self.digest, self.quality))):
            at = None if at != at else int(at)
            quality = None if pd.isna(quality) else float(quality)
            new = new if isinstance(new, str) else None if pd.isna(new) else str(new)
            digest, best, seen = known.get(key, (None, None, None))
            if seen is None or at is not None and at - seen > self.keep:
                status, best = "new", quality
            else:
                status = "cached" if new == digest else "fresh"
                best = quality if best is None else best if quality is None else max(best, quality)
            known[key] = (new, best, at if seen is None or at is None else max(seen, at))  # what follows a record without a time is new
            statuses[i], bests[i] = status, np.nan if best is None else best
        self._hold(known, state)
        yield batch[self.out].assign(status=statuses, best_quality=bests)

    def _order(self, batch: pd.DataFrame) -> np.ndarray:
        """Places of the records by time; the other columns are only looked at where two have one time."""
        order = np.argsort(batch[_MICROS].to_numpy(), kind="stable")
        if (np.diff(batch[_MICROS].to_numpy()[order]) > 0).all():
            return order
        return batch.reset_index(drop=True).sort_values([_MICROS, *self.rest, self.digest], kind="stable").index.to_numpy()

    def _hold(self, known: dict, state: GroupState) -> None:
        """Keep the keys that the watermark hasn't passed, until it has passed the last of them."""
        watermark = state.getCurrentWatermarkMs()
        held = [(key, *last) for key, last in known.items() if last[2] is not None and self._end(last[2]) >= watermark]
        if held:
            state.update(tuple(list(column) for column in zip(*held)))
            state.setTimeoutTimestamp(max(max(self._end(seen) for *_, seen in held), 1))
        else:
            state.remove()

    def _end(self, seen: int) -> int:
        return (seen + self.keep) // 1000 + 1


def with_status(stream: DataFrame, key: str, digest: str, quality: str, at: str, keep: timedelta, delay: str = "1 hour", order: tuple[str, ...] = (), buckets: int = 4096) -> DataFrame:
    """A stream's records with `status` and `best_quality`: new for a key that isn't known, cached for the digest that it had
    last, fresh for another one; the best quality since it was new.

    A key is known for `keep` after its last record: then it is new again. Records of one time go by the columns in `order`, then by
    digest. Records that come later than `delay` after the newest are dropped; null keys are one key, keys are compared as strings; a
    null digest is a digest; what follows a record without a time is new. A target isn't read.

    State is a row for each bucket of keys, since a call and a row of state for each key cost more than its records do. The
    states of keys that the watermark has passed go when records reach their bucket, else a timer drops the bucket's row once the
    last of its keys is over. A micro-batch reads and writes all keys of the buckets that it touches: take more `buckets` for
    many keys and small micro-batches, and leave the number as it is while the stream lives. Of one bucket's records those of a
    micro-batch are in memory at once, which the source's trigger limits bound. Start the stream within `state_store`.
    """
    ship(stream.sparkSession)
    timed = stream.withWatermark(at, delay).withColumn(_MICROS, F.unix_micros(F.col(at).cast("timestamp")))
    keyed = timed.withColumn(_KEY, F.col(key).cast("string")).withColumn(_BUCKET, F.pmod(F.xxhash64(_KEY), F.lit(buckets)))
    fields = [StructField(f.name, f.dataType, True) for f in timed.schema if f.name != at]
    known = Known(digest, quality, list(order), keep, [f.name for f in fields])
    out = StructType([*fields, *StructType.fromDDL("status string, best_quality double")])
    done = keyed.groupBy(_BUCKET).applyInPandasWithState(known, out, StructType.fromDDL(Known.STATE), "append", GroupStateTimeout.EventTimeTimeout)
    back = F.timestamp_micros(_MICROS).cast(stream.schema[at].dataType).alias(at)
    return done.select(*[back if c == at else c for c in stream.columns], "status", "best_quality")
