"""Folds that go on: the last state of each key is kept, so a sequence that grows is continued instead of folded again."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.storage import written
from ..sources.store import Rows, Store
from ..sources.upserts import replace_keys

#: Groups of keys that share a state, and rows of a frame that a group tells.
GROUPS, ROWS = 1024, 50_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def lasting_state(spark: SparkSession) -> Iterator[None]:
    """The state store that folds need, for queries that start within."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class _Fold(StatefulProcessor):
    """A group's rows of a batch: each key's, in order, onto its last state. Rows whose predecessors haven't come wait in the state.

    The states of a group are one text, read and written once a batch, as every call between Spark and Python costs far more than a row.
    """

    def __init__(self, step: Callable, start, first: int | None, encode: Callable, decode: Callable):
        self.step, self.start, self.first, self.encode, self.decode = step, start, first, encode, decode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "states string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        # a key's name -> place, count, failed, state, and waiting tokens by place
        kept = {name: own for name, *own in json.loads(self.kept.get()[0])} if self.kept.exists() else {}
        come: dict[object, dict[int, str]] = {}
        for frame in rows:
            for k, a, t in zip(frame["key"].tolist(), frame["at"].tolist(), frame["token"].tolist(), strict=True):
                own = come.setdefault(k, {})
                own[a] = min(t, own[a]) if a in own else t  # of several tokens for one place the least stays
        told = []
        for k, tokens in come.items():
            kept[str(k)] = self._folded(k, tokens, told, *kept.get(str(k), (None, 0, False, None, [])))
        self.kept.update((json.dumps([(name, *own) for name, own in kept.items()]),))
        for i in range(0, len(told), ROWS):
            yield pd.DataFrame(told[i : i + ROWS], columns=["key", "step", "state", "token", "error"])

    def _folded(self, key, tokens: dict[int, str], told: list, at: int | None, count: int, failed: bool, state: str | None, waiting: list) -> tuple:
        if failed:
            return at, count, failed, state, waiting
        tokens = {a: t for a, t in tokens.items() if at is None or a > at} | dict(waiting)  # what came before stays
        state = self.start if count == 0 else self.decode(state)
        wanted = self.first if at is None else at + 1
        for a in sorted(tokens):
            if self.first is not None and a < self.first:
                tokens.pop(a)  # there is no such place
                continue
            if self.first is not None and a != wanted:
                break
            at, count, wanted, t = a, count + 1, a + 1, tokens.pop(a)
            try:
                state, text = self.step(state, t)
            except Exception as e:  # noqa: BLE001  a user's rule: the key goes to quarantine with the reason
                told.append((key, count, None, t, f"{type(e).__name__}: {e}"))
                return at, count, True, None, []
            told.append((key, count, text, t, None))
        return at, count, False, self.encode(state), list(tokens.items())

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, key: str, at: str, token: str, step: Callable, start, key_type: str = "long", first: int | None = None, encode: Callable = json.dumps, decode: Callable = json.loads, groups: int = GROUPS) -> DataFrame:
    """key, step, state, token, error of a stream of tokens: those that are new in each batch.

    step(state, token) -> (state, text). at: a token's place (whole numbers); a place that has been folded is left out when it comes
    again. first: the first place, if places have no gaps; tokens then wait until all before them have come, in whatever batch. Without it,
    tokens must come in order from batch to batch. Rows without key, place or token are left out. After a failing step a key
    tells its failure and nothing more; what it told before has to go, as FoldedStates does. encode, decode: how a state is stored as text.
    groups: keys are dealt to so many groups by their hash, and one group's states, with its tokens of a batch, are held at a time;
    a checkpoint keeps the number that it began with.
    """
    rows = stream.select(F.col(key).cast(key_type).alias("key"), F.col(at).cast("long").alias("at"), F.col(token).cast("string").alias("token")).where("key IS NOT NULL AND at IS NOT NULL AND token IS NOT NULL")
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    return rows.groupBy("group").transformWithStateInPandas(_Fold(step, start, first, encode, decode), f"key {key_type}, step int, state string, token string, error string", "Append", "None")


class FoldedStates:
    """A sink of fold_stream: tables `states` and `failures` of a store, each batch once; a failing key's states go."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.store = Store(spark, folder, {"states": ["key"], "failures": ["key"]}, buckets)

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = written(batch)
        failed = rows.where("error IS NOT NULL").drop("state")
        keys = failed.select("key")
        good = rows.where("error IS NULL").drop("error").join(keys, "key", "left_anti")
        states = Rows(good, lambda old, new: replace_keys(old, new, keys, ["key"]), rows.select("key"))
        self.store.commit("fold", number, {"states": states, "failures": Rows(failed)})
        self.store.vacuum()

    def states(self) -> DataFrame:
        return self.store.read("states")

    def failures(self) -> DataFrame:
        return self.store.read("failures")
