"""A recorder's episode buffer as a structured stream: frames are held until their episode is saved, and go when it is discarded.

Nothing of an episode leaves the buffer before its save, so a discarded one never reaches a sink.  State is kept by recorder in the state
store (a list of frames), not in the executor's memory; with a checkpoint and a sink that tells batches apart
(``sources.dataset.write_stream``) a restart loses and doubles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FRAME_KIND, SAVE, DISCARD = "frame", "save", "discard"
OUT = "recorder STRING, episode_index BIGINT, frame_index BIGINT, seq BIGINT, payload STRING"
BLOCK_FRAMES = 4096


@dataclass
class EpisodeBuffer(StatefulProcessor):
    """Rows of a recorder: ``seq``, ascending; ``kind`` (frame, save or discard); and a frame's ``payload``.

    ``save`` hands out the frames held, numbered from 0, as the recorder's next episode; ``discard`` forgets them, and the episode's number
    is used again.  Neither does anything without frames.  An episode to which nothing is added for ``abandoned_ms`` is
    discarded, by a timer that every row sets anew, so that a long episode keeps its first frames.  A row whose ``seq`` is not above the last one's has been
    seen before and is dropped.  Other kinds, and a null ``seq``, are ignored.
    """

    abandoned_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", "seq BIGINT, payload STRING")
        self.last = handle.getValueState("last", "seq BIGINT, episode BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Each call to the state goes to the JVM and back, and each table handed on is an Arrow batch, so there are few of both, however many
        episodes a batch has: the list is only read and cleared when it holds frames, and a table has frames of many episodes."""
        tables = list(rows)
        batch = tables[0] if len(tables) == 1 else pd.concat(tables, ignore_index=True)  # a recorder's rows of one batch
        batch = batch[batch["seq"].notna()] if batch["seq"].hasnans else batch
        batch = batch if batch["seq"].is_monotonic_increasing else batch.sort_values("seq", kind="stable")
        known = self.last.get()
        seen, episode = (int(known[0]), int(known[1])) if known else (None, 0)
        stored = known is not None and self.frames.exists()
        held: list[tuple] = []  # frames not yet in the store
        out: list[tuple] = []  # saved frames not yet handed on
        for seq, kind, payload in zip(batch["seq"].tolist(), batch["kind"].tolist(), batch["payload"].tolist(), strict=True):
            seq = int(seq)
            if seen is not None and seq <= seen:
                continue
            seen = seq
            if kind == FRAME_KIND:
                held.append((seq, payload))
                if len(held) >= BLOCK_FRAMES:
                    self.frames.appendList(held)
                    held, stored = [], True
            elif kind in (SAVE, DISCARD):
                if kind == SAVE:
                    number = 0
                    for number, (at, frame) in enumerate(chain(self.frames.get() if stored else (), held), 1):
                        out.append((key[0], episode, number - 1, int(at), frame))
                        if len(out) >= BLOCK_FRAMES:
                            yield self._table(out)
                            out = []
                    episode += number > 0
                if stored:
                    self.frames.clear()
                held, stored = [], False
        if out:
            yield self._table(out)
        if held:
            self.frames.appendList(held)
        if seen is not None:
            self.last.update((seen, episode))
        if self.abandoned_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held or stored:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.abandoned_ms)

    def _table(self, block: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(block, columns=["recorder", "episode_index", "frame_index", "seq", "payload"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.frames.clear()
        return iter(())

    def close(self) -> None:
        pass


def buffered(events: DataFrame, abandoned_ms: int | None = None) -> DataFrame:
    """Saved frames of a stream of ``recorder, seq, kind, payload``: ``recorder, episode_index, frame_index, seq, payload``.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = events.select(F.col("recorder").cast("string"), F.col("seq").cast("long"), "kind", F.col("payload").cast("string"))
    return rows.groupBy("recorder").transformWithStateInPandas(
        statefulProcessor=EpisodeBuffer(abandoned_ms), outputStructType=OUT, outputMode="append", timeMode="none" if abandoned_ms is None else "processingTime"
    )
