"""Bounded message memory as keyed streaming state (M1, M2)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conv_id bigint, turn bigint, role string, text string"
STATE = "turns array<bigint>, roles array<string>, texts array<string>"


def remember(n: int):
    """The update of one session: keeps its n last messages by turn and emits what it now remembers.

    A message with role 'clear' empties the session. Messages that arrive late but belong to the n last enter at their place.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, roles, texts = state.get if state.exists else ([], [], [])
        kept = list(zip(turns, roles, texts, strict=True))
        for batch in batches:
            kept += [(int(t), r, x) for t, r, x in zip(batch["turn"], batch["role"], batch["text"], strict=True)]
            kept.sort(key=lambda m: m[0])
            cleared = max((i for i, m in enumerate(kept) if m[1] == "clear"), default=-1)
            kept = kept[max(0, cleared) :][-(n + 1) :] if cleared >= 0 else kept[-n:]
        said = [m for m in kept if m[1] != "clear"][-n:]
        marks = [m for m in kept if m[1] == "clear"][-1:]
        kept = marks + said
        state.update(([m[0] for m in kept], [m[1] for m in kept], [m[2] for m in kept]))
        yield pd.DataFrame({"conv_id": [key[0]] * len(said), "turn": [m[0] for m in said], "role": ["user" if m[1] == "user" else "assistant" for m in said], "text": [m[2] for m in said]})

    return update


def memory_stream(turns: DataFrame, n: int = 10) -> DataFrame:
    """M1 over a stream of (conv_id, turn, role, text): after each micro-batch, the memory of the sessions it touched."""
    return turns.groupBy("conv_id").applyInPandasWithState(remember(n), OUT, STATE, "update", GroupStateTimeout.NoTimeout)
