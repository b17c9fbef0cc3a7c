"""Extension points: feed readers by type, scorers and deliverers as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.session import set_aside
from feedspark.sources.feeds import parse_feeds

# Landed responses in, entries and warnings out.
Reader = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
# Requests in, one recorded answer per request out.
Scorer = Callable[[DataFrame], DataFrame]
# Posts in, one delivery outcome per post out.
Deliverer = Callable[[DataFrame], DataFrame]


class ReaderRegistry:
    """Readers by source type; asking for an unknown type raises ``KeyError`` while planning."""

    def __init__(self, stage: Callable[[DataFrame], DataFrame] = set_aside) -> None:
        self._readers: dict[str, Reader] = {"rss": partial(parse_feeds, stage=stage)}

    def register(self, source_type: str, reader: Reader) -> None:
        self._readers[source_type] = reader

    def get(self, source_type: str) -> Reader:
        return self._readers[source_type]


def recorded_scorer(responses: DataFrame) -> Scorer:
    """A scorer that looks each request up in a table of recorded answers."""

    def score(requests: DataFrame) -> DataFrame:
        return (
            requests.drop("input_text", "prompt")
            .join(responses.drop("domain_id", "articles"), "batch_id", "left")
            .withColumn("ok", F.coalesce("ok", F.lit(False)))
        )

    return score


def recorded_deliverer(outcomes: DataFrame) -> Deliverer:
    """A deliverer that looks each post up in a table of recorded outcomes."""

    def deliver(posts: DataFrame) -> DataFrame:
        return posts.select("article_id").join(outcomes, "article_id", "inner")

    return deliver
