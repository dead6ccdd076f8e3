"""The evolution fold as a stream: each tenant's store is the state between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import evolution as E

DECISION = "tenant string, seq bigint, decision string, action string, target_id bigint, memory_id bigint, reason_codes array<string>"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    store = pickle.loads(state.get[0]) if state.exists else E.Store()
    rows = pd.concat(list(batches))
    out = [{"tenant": key[0], **d} for d in E.fold(store, rows)]
    state.update((pickle.dumps(store),))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])


def evolve_stream(statements: DataFrame) -> DataFrame:
    """Decisions of a stream of statements (tenant, seq, content, category, optional embedding).

    Arrival order decides between micro-batches, ``seq`` within one; event time plays no part, as late
    statements are statements all the same. A tenant's store has to fit its state.
    """
    keyed = E.with_facts(statements).groupBy("tenant")
    return keyed.applyInPandasWithState(_update, DECISION, "store binary", "append", GroupStateTimeout.NoTimeout)
