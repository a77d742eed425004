"""Strikes of sessions in a stream; the batch twin is `flowstore.operators.guard.strikes`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def striking(stream: DataFrame, session: str, turn: str, most: int) -> DataFrame:
    """(session, turn, strikes, locked, decision) of rows with boolean columns violation and is_input.

    The state of a session is its strikes and whether it is locked. Rows of one batch are
    taken by turn.
    """
    kind = dict(stream.dtypes)[session]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        strikes, locked = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values(turn, kind="stable")
        out = []
        for t, violation, is_input in zip(rows[turn], rows["violation"], rows["is_input"]):
            if violation and is_input:
                strikes += 1
            elif is_input:
                strikes = 0
            locked = locked or (bool(violation) and strikes >= most)
            out.append((key[0], t, strikes, locked, "block" if violation or locked else "allow"))
        state.update((int(strikes), bool(locked)))
        yield pd.DataFrame(out, columns=[session, turn, "strikes", "locked", "decision"])

    schema = f"`{session}` {kind}, `{turn}` {dict(stream.dtypes)[turn]}, strikes int, locked boolean, decision string"
    return stream.groupBy(session).applyInPandasWithState(step, schema, "strikes int, locked boolean", "append", GroupStateTimeout.NoTimeout)
