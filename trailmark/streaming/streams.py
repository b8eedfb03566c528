"""Structured Streaming operators: overlapping windows, request dedup, sessions, task states."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def segments(samples: DataFrame, key: str, pos: str, value: str, length: int, overlap: int) -> DataFrame:
    """Overlapping segments of a sample stream by place (batch or stream): full ones only."""
    hop = length - overlap
    last, first = F.floor(F.col(pos) / hop), F.greatest(F.lit(0), F.ceil((F.col(pos) - length + 1) / hop))
    rows = samples.withColumn("segment", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return rows.groupBy(key, "segment").agg(F.count("*").alias("n"), F.sum(value).alias("total")).where(F.col("n") == length)


def live_segments(chunks: DataFrame, key: str, order: str, samples: str, length: int, overlap: int) -> DataFrame:
    """(key, segment, samples) of a live stream of ragged chunks: the first segment is all new, later ones begin with the last overlap samples before.

    What does not fill a segment stays as the key's state (fewer than length samples) until the next micro-batch, so segments do not depend on how the stream
    is cut into chunks or batches. Chunks of a batch are taken by order, batches as they come; null chunks are empty.
    """
    if not 0 <= overlap < length:
        raise ValueError("the overlap must be shorter than a segment")

    def cut(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, segment = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(frames)).sort_values(order)
        made = []
        for chunk in rows[samples]:
            rest.extend(() if chunk is None else np.asarray(chunk).tolist())  # the state takes plain values only
            while len(rest) >= length:
                made.append((k[0], segment, rest[:length]))
                rest, segment = rest[length - overlap :], segment + 1
        state.update((rest, segment))
        yield pd.DataFrame(made, columns=[key, "segment", samples])

    kind = lambda c: chunks.schema[c].dataType.simpleString()
    return chunks.select(key, order, samples).groupBy(key).applyInPandasWithState(cut, f"{key} {kind(key)}, segment long, {samples} {kind(samples)}", f"rest {kind(samples)}, segment long", "append", GroupStateTimeout.NoTimeout)


METRICS = "map<string, map<string, double>>"


def results_with_metrics(messages: DataFrame, key: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """(key, message, metrics) of the first result of every request, with the metrics of its stages so far.

    messages: (key, order, kind: stage_metrics or result, message, metrics: {METRICS}). Metrics of a later message win field by field inside a stage, and
    those of a result count too. Repeated results go, and results of requests that known lacks; messages without a key go. A result waits for nothing: metrics that come after it
    are kept but change nothing.
    """

    def gather(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored, done = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, False)
        made = []
        for row in pd.concat(list(frames)).sort_values(order).itertuples():
            if done and row.kind == "result":
                continue
            for stage, fields in dict(row.metrics or {}).items():  # maps come as dicts or as lists of pairs
                stored.setdefault(stage, {}).update({f: float(v) for f, v in dict(fields or {}).items() if v is not None})
            if row.kind == "result":
                made.append((k[0], row.message, {s: dict(f) for s, f in stored.items()}))
                done = True
        state.update((json.dumps(stored), done))
        yield pd.DataFrame(made, columns=[key, "message", "metrics"])

    asked = messages.where(F.col(key).isNotNull())
    if known is not None:
        asked = asked.join(known, key, "left_semi")
    kind = messages.schema[key].dataType.simpleString()
    return asked.select(key, order, "kind", "message", F.col("metrics").cast(METRICS)).groupBy(key).applyInPandasWithState(gather, f"{key} {kind}, message string, metrics {METRICS}", "stored string, done boolean", "append", GroupStateTimeout.NoTimeout)


def tumbling(pos: Column, first: int, rest: int) -> Column:
    """Index of the tumbling window when the first one has another length."""
    return F.when(pos < first, 0).otherwise(1 + F.floor((pos - first) / rest)).cast("long")


def once(requests: DataFrame, key: str, time: str, late: str, known: DataFrame | None = None) -> DataFrame:
    """Requests without repeats inside the watermark, and only of known keys where a table of them is given."""
    out = requests.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return out if known is None else out.join(known, key, "left_semi")


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Session windows that close after a gap."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: Moves of a task's state.
MOVES = {("", "submit"): "PENDING", ("PENDING", "start"): "PROCESSING", ("PROCESSING", "finish"): "COMPLETED", ("PROCESSING", "fail"): "FAILED", ("PENDING", "cancel"): "CANCELLED", ("PROCESSING", "cancel"): "CANCELLED"}


def fold_states(actions: list[str], state: str = "") -> str:
    for a in actions:
        state = MOVES.get((state, a), state)
    return state


def fold_table(events: DataFrame, key: str, order: str, action: str) -> DataFrame:
    """(key, state) of every task after all its actions in a table.

    Rows are dealt by ranges of (key, order), so that a task's actions may spread over tasks of the cluster. Each sorted part becomes one map from
    the state before it to the state after it; maps of a key's parts, as few as its ranges, are applied in order.
    """
    states = sorted({"", *MOVES.values()})
    at = {s: k for k, s in enumerate(states)}
    moves = {a: [at[MOVES.get((s, a), s)] for s in states] for a in {a for _, a in MOVES}}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # key, first order, map

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array([held[0]], kinds[0]), pa.array([held[1]], kinds[1]), pa.array([held[2]], pa.list_(pa.int32()))], names=[key, "_from", "_map"])

        kinds: list = []
        for batch in batches:
            kinds = kinds or [batch.schema.field(c).type for c in (key, order)]
            for k, o, a in zip(*(batch.column(c).to_pylist() for c in (key, order, action))):
                if held is None or held[0] != k:
                    if held is not None:
                        yield told()
                    held = [k, o, list(range(len(states)))]
                if (move := moves.get(a)) is not None:
                    held[2] = [move[s] for s in held[2]]
        if held is not None:
            yield told()

    kind = lambda c: events.schema[c].dataType.simpleString()
    parts = events.select(key, order, action).repartitionByRange(key, order).sortWithinPartitions(key, order).mapInArrow(fold, f"{key} {kind(key)}, _from {kind(order)}, _map array<int>")
    steps = F.array_sort(F.collect_list(F.struct("_from", "_map")))
    last = F.aggregate(steps, F.lit(at[""]), lambda s, p: F.element_at(p["_map"], s + 1))
    return parts.groupBy(key).agg(F.element_at(F.array(*map(F.lit, states)), last + 1).alias("state"))


def task_states(events: DataFrame, key: str, order: str, action: str) -> DataFrame:
    """The state of every task after each batch, from a stream of actions; moves that a state does not allow are ignored."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values(order)
        now = fold_states(rows[action].tolist(), now)
        state.update((now,))
        yield pd.DataFrame({key: [k[0]], "state": [now]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, state string", "state string", "update", GroupStateTimeout.NoTimeout)
