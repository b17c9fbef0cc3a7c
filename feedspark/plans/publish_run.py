"""One publish step, and a capped run, over recorded delivery outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from feedspark.operators.publish import (
    capped_decisions,
    capped_publish,
    next_to_publish,
    publish_decisions,
    publish_stats,
)
from feedspark.operators.rendering import render_posts
from feedspark.operators.state import apply_decisions, decision_events
from feedspark.session import set_aside
from feedspark.sources.connectors import Deliverer


@dataclass(frozen=True)
class PublishRun:
    decisions: DataFrame
    changed: DataFrame
    events: DataFrame
    stats: DataFrame | None = None


def outbox(articles: DataFrame, sources: DataFrame, domains: DataFrame) -> DataFrame:
    """The next post, rendered."""
    return render_posts(next_to_publish(articles, sources, domains)).withColumnRenamed("id", "article_id")


def publish_once(
    articles: DataFrame, sources: DataFrame, domains: DataFrame, deliver: Deliverer, now: Column
) -> PublishRun:
    """Deliver the next post, if any.  It is written aside so that it is sent exactly as chosen."""
    posts = set_aside(outbox(articles, sources, domains))
    decisions = set_aside(publish_decisions(posts.withColumnRenamed("article_id", "id"), deliver(posts)))
    changed = apply_decisions(articles, decisions, now, only_changed=True)
    return PublishRun(decisions, changed, decision_events(decisions, now))


def publish_capped(
    articles: DataFrame, sources: DataFrame, domains: DataFrame, outcomes: DataFrame, cap: int, max_age_hours: int,
    now: Column,
) -> PublishRun:
    handled = set_aside(capped_publish(articles, sources, domains, outcomes, cap, max_age_hours, now))
    decisions = capped_decisions(handled)
    changed = apply_decisions(articles, decisions, now, only_changed=True)
    return PublishRun(decisions, changed, decision_events(decisions, now), publish_stats(handled))
