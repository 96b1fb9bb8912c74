"""The span ledger as a stream: each span is judged by the first session that held its key.

An extension: reuse is online by nature, since a request sees earlier ones only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_OUT = "key string, sid long, snap int, s int, n int, reuse string"


def judge(spans: DataFrame) -> DataFrame:
    """Streaming spans(key, sid, snap, s, n) with reuse: first, in_session or cross_session.

    State holds one owner for each key. Within a micro-batch spans arrive in the order of
    (sid, snap, s).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["sid", "snap", "s"], ignore_index=True)
        owner = state.get[0] if state.exists else None
        kinds = []
        for sid in rows["sid"]:
            if owner is None:
                owner = int(sid)
                kinds.append("first")
            else:
                kinds.append("in_session" if int(sid) == owner else "cross_session")
        state.update((owner,))
        yield rows.assign(reuse=kinds)[["key", "sid", "snap", "s", "n", "reuse"]]

    return spans.groupBy("key").applyInPandasWithState(step, _OUT, "owner long", "append", "NoTimeout")
