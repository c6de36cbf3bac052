"""The sliding window over unbounded streams: the last lines of each stream are kept as state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandlog.functions.distances import Measure
from strandlog.operators.window import check_window, choose
from strandlog.runtime import ship

OUTPUT = "stream string, line_no long, begin int, ref_no long, distance double, is_match boolean"


def nearest_stream(lines: DataFrame, window: int = 8, distance: str = "minhash", q: int = 3, threshold: float = 0.06) -> DataFrame:
    """`nearest` for a streaming DataFrame of (stream, line_no, line).

    Inside a micro-batch lines are put in the order of line_no; batches of a stream must come in that order.
    """
    check_window(window)
    ship(lines.sparkSession)
    measure = Measure(distance, q)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, numbers = state.get if state.exists else ([], [])
        queue = deque(((x, measure.prepare(x), n) for x, n in zip(kept, numbers, strict=True)), maxlen=window)
        out = []
        rows = pd.concat(list(frames)).sort_values("line_no")
        for no, text in zip(rows["line_no"].tolist(), rows["line"].tolist(), strict=True):
            line = (text or "").encode()
            mine = measure.prepare(line)
            begin, d = choose(line, queue, measure, mine)
            out.append((key[0], no, begin, queue[begin][2] if begin >= 0 else None, d, begin >= 0 and d < threshold))
            queue.append((line, mine, no))
        state.update(([x for x, _, _ in queue], [n for _, _, n in queue]))
        made = pd.DataFrame(out, columns=["stream", "line_no", "begin", "ref_no", "distance", "is_match"])
        made["ref_no"] = made["ref_no"].astype("Int64")
        yield made

    return lines.groupBy("stream").applyInPandasWithState(step, OUTPUT, "lines array<binary>, numbers array<long>", "append", GroupStateTimeout.NoTimeout)
