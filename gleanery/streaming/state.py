"""Crawl state by URL as a stateful streaming operator: the same back-off as operators.crawl.recrawl_schedule, kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanery.operators.crawl import MAX_BACKOFF, MAX_HOURS, MIN_MINUTES

OUT = T.StructType([T.StructField("url", T.StringType()), T.StructField("crawls", T.LongType()), T.StructField("backoff", T.IntegerType()), T.StructField("last_crawl", T.DoubleType()), T.StructField("next_crawl", T.DoubleType())])
STATE = T.StructType([T.StructField("hash", T.StringType()), T.StructField("changed", T.DoubleType()), T.StructField("backoff", T.IntegerType()), T.StructField("crawls", T.LongType()), T.StructField("last", T.DoubleType())])


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known, changed, backoff, crawls, last = state.get if state.exists else (None, 0.0, 1, 0, -1.0)
    rows = pd.concat(list(batches)).drop_duplicates().sort_values(["t", "h"])
    for t, h in zip(rows["t"], rows["h"]):
        if known is None or h != known:
            known, changed, backoff = h, t, 1
        else:
            backoff = min(MAX_BACKOFF, backoff * 2)
        crawls, last = crawls + 1, t
    minutes = max(MIN_MINUTES, min(MAX_HOURS, max(1, int((last - changed) // 3600) * backoff)) * 60)
    state.update((known, changed, backoff, crawls, last))
    yield pd.DataFrame({"url": [key[0]], "crawls": [crawls], "backoff": [backoff], "last_crawl": [last], "next_crawl": [last + minutes * 60]})


def crawl_state(stream: DataFrame) -> DataFrame:
    """stream: url, t (seconds), h (hash). One row for each URL of a batch with its state after that batch; state is kept for all URLs.

    Crawls of a URL are expected in order between batches, as the crawler delivers them; within a batch they are sorted.
    """
    return stream.groupBy("url").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
