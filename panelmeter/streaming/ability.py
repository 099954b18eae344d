"""Ability tracking over a stream of responses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.posterior import _with_log_curves, posterior_from_loglik


def track_loglik(responses: DataFrame, curves: DataFrame) -> DataFrame:
    """Running log-likelihood per rater: (rater, ll, n_responses).

    Log-likelihoods add up, so the state of a rater is one vector, whatever the
    number of responses. A `weight` column (-1 takes a response back) is used if
    the stream has one, see outcome_changes.
    """
    logs = _with_log_curves(curves).drop("m")
    weight = F.col("weight").cast("double") if "weight" in responses.columns else F.lit(1.0)
    each = responses.withColumn("_w", weight).join(logs, "item").select(
        "rater", "_w", F.expr("transform(IF(y = 1, ll_pass, ll_fail), x -> x * _w)").alias("ll"))
    sums = each.groupBy("rater").agg(
        Summarizer.sum(array_to_vector("ll")).alias("v"), F.sum("_w").alias("n_responses"))
    return sums.select("rater", vector_to_array("v").alias("ll"), "n_responses")


def track_ability(responses: DataFrame, curves: DataFrame) -> DataFrame:
    """Posterior per rater after every micro-batch: (rater, n_responses, post)."""
    return posterior_from_loglik(track_loglik(responses, curves), keep=("rater", "n_responses"))


def running_pass_rate(responses: DataFrame) -> DataFrame:
    """(rater, n_obs, n_pass, pass_rate), updated with every micro-batch."""
    return responses.groupBy("rater").agg(
        F.count("*").alias("n_obs"), F.sum(F.col("y").cast("bigint")).alias("n_pass"),
        F.avg("y").alias("pass_rate"))


STATE_BUCKETS = 1_024       # fixed value: states of a stream are bound to their keys


def _read_table(state) -> pd.DataFrame | None:
    return pa.ipc.open_stream(state.get()[0]).read_pandas() if state.exists() else None


def _write_table(state, known: pd.DataFrame) -> None:
    table, sink = pa.Table.from_pandas(known, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))


def _bucketed(keyed: DataFrame, *keys: str) -> DataFrame:
    """keyed by a hash of the keys; rows with a null key have states of their own, so ids keep their type."""
    null = sum((F.col(k).isNull().cast("int") * 2 ** n for n, k in enumerate(("rater", "item"))), F.lit(0))
    return keyed.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(STATE_BUCKETS)) * 4 + null).groupBy("bucket")


class _LastOutcomes(StatefulProcessor):
    """The outcomes with the largest order so far of all (rater, item) of a bucket."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "known binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values
                        ) -> Iterator[pd.DataFrame]:
        pair, old = ["rater", "item"], _read_table(self.last)
        # of equal orders the first of a batch counts, and a batch before what is known
        new = pd.concat(list(rows))[[*pair, "y", "ord"]].sort_values("ord", ascending=False, kind="stable").drop_duplicates(pair)
        new = new.astype({"y": "int64", "ord": "int64"})
        if old is None:
            _write_table(self.last, new)
            yield new[[*pair, "y"]].assign(weight=1)
            return
        known = pd.concat([new, old]).sort_values("ord", ascending=False, kind="stable").drop_duplicates(pair)
        _write_table(self.last, known)
        now = new[pair].merge(known[[*pair, "y"]], on=pair, how="left")
        before = new[pair].merge(old[[*pair, "y"]], on=pair, how="left")["y"]
        changed = (before.to_numpy() != now["y"].to_numpy())
        undone = changed & before.notna().to_numpy()
        added = pd.concat([now[undone][pair].assign(y=before[undone].astype("int64"), weight=-1),
                           now[changed].assign(weight=1)])
        if len(added):
            yield added

    def close(self) -> None:
        pass


def outcome_changes(responses: DataFrame, order: str = "ord") -> DataFrame:
    """Signed responses under 'the last outcome of an item counts'.

    A first outcome is emitted with weight 1; when a later one differs, the old
    outcome is emitted with weight -1 and the new one with weight 1, so sums over
    the result always equal sums over last outcomes. (rater, item) are dealt over
    STATE_BUCKETS states, evenly however active a rater is; a state is one Arrow table,
    read and written once per batch that touches it, where a state per pair cost some
    calls to the store for every response. Write the result to a table and feed that
    to track_ability.

    dropDuplicatesWithinWatermark would be cheaper but keeps the first outcome.
    """
    keyed = responses.select("rater", "item", F.col("y").cast("int").alias("y"),
                             F.col(order).cast("bigint").alias("ord"))
    schema = T.StructType([keyed.schema["rater"], keyed.schema["item"],
                           T.StructField("y", T.IntegerType()),
                           T.StructField("weight", T.IntegerType())])
    return _bucketed(keyed, "rater", "item").transformWithStateInPandas(
        statefulProcessor=_LastOutcomes(), outputStructType=schema, outputMode="Append",
        timeMode="None")


class _Answered(StatefulProcessor):
    """All items of the raters of a bucket with their last outcomes; a rater's are told whole when the rater answers."""

    CHUNK = 100_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "known binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values
                        ) -> Iterator[pd.DataFrame]:
        old = _read_table(self.last)
        new = pd.concat(list(rows))[["rater", "item", "y", "ord"]]
        # of equal orders the one that came last counts
        known = (new if old is None else pd.concat([old, new])).sort_values("ord", kind="stable").drop_duplicates(
            ["rater", "item"], keep="last")
        _write_table(self.last, known)
        told = known[known["rater"].isin(new["rater"].unique())][["rater", "item", "y"]]
        for at in range(0, len(told), self.CHUNK):
            yield told.iloc[at:at + self.CHUNK]

    def close(self) -> None:
        pass


def answered_so_far(responses: DataFrame, order: str = "ord") -> DataFrame:
    """(rater, item, y): the last outcomes of every rater who answers in a micro-batch, old and new.

    Both the rater's ability and what is left to ask follow from a batch alone, and nothing
    that arrives later can be known. Raters are dealt over STATE_BUCKETS states, each one
    Arrow table with at most an entry per rater and item of the bank, read and written once
    per batch that touches it. Responses without rater, item or y
    are left out; an outcome that arrives late does not undo a later one.
    """
    keyed = responses.where("rater IS NOT NULL AND item IS NOT NULL AND y IS NOT NULL").select(
        "rater", "item", F.col("y").cast("int").alias("y"), F.col(order).cast("bigint").alias("ord"))
    schema = T.StructType([keyed.schema["rater"], keyed.schema["item"], T.StructField("y", T.IntegerType())])
    return _bucketed(keyed, "rater").transformWithStateInPandas(
        statefulProcessor=_Answered(), outputStructType=schema, outputMode="Append", timeMode="None")
