"""Undecided articles to requests, and recorded answers to decisions and cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.text import or_dash
from feedspark.operators.batching import article_text, build_requests, plan_batches
from feedspark.operators.decisions import batch_decisions, batch_summary, match_results, single_decisions
from feedspark.operators.selection import with_source_name
from feedspark.operators.state import apply_decisions, decision_events
from feedspark.operators.usage import price_usage, summarize_usage, usage_by_batch
from feedspark.session import set_aside


@dataclass(frozen=True)
class EditorialRun:
    decisions: DataFrame
    changed: DataFrame
    events: DataFrame
    batch_counts: DataFrame | None
    usage: DataFrame | None
    usage_totals: DataFrame | None


def plan_requests(
    states: DataFrame, articles: DataFrame, sources: DataFrame, domains: DataFrame, prompts: DataFrame,
    max_total: int | None, batch_size: int,
) -> tuple[DataFrame, DataFrame]:
    """``(batches, requests)`` of a run; write the requests before answers are collected.

    Candidates come from the narrow ``states``; ``articles`` are read only for the chosen content.
    The plan is written aside: with its size known, a small one is broadcast against the article
    content instead of shuffling it.
    """
    batches = set_aside(plan_batches(states, sources, domains, max_total, batch_size))
    if max(int(batch_size), 1) > 1:
        return batches, build_requests(batches, articles, sources, prompts)
    payload = with_source_name(
        articles.select(
            F.col("id").alias("article_id"), "source_id", "canonical_url", "published_at", "title", "content"
        ),
        sources,
    )
    single = batches.join(payload, "article_id").select(
        "batch_id", "domain_id", "batch_index", F.lit(1).alias("articles"), article_text().alias("input_text")
    )
    return batches, single.join(prompts.select("domain_id", "prompt"), "domain_id", "left")


def apply_answers(
    states: DataFrame, domains: DataFrame, batches: DataFrame, answers: DataFrame, pricing: DataFrame,
    now: Column, *, default_language: str = "ru",
) -> EditorialRun:
    """Decide every article of the answered batches.

    Answers are parsed once.  Both results are written aside, so their size is known: few decisions
    are broadcast against the store, many are joined by id.
    """
    matched = set_aside(match_results(batches, answers))
    decisions = set_aside(batch_decisions(matched, domains, default_language))
    priced = price_usage(answers, pricing)
    return EditorialRun(
        decisions,
        apply_decisions(states, decisions, now, only_changed=True),
        decision_events(decisions, now),
        batch_summary(matched),
        usage_by_batch(priced),
        summarize_usage(priced),
    )


def apply_single_answers(
    states: DataFrame, domains: DataFrame, batches: DataFrame, answers: DataFrame, now: Column,
    *, default_language: str = "ru",
) -> EditorialRun:
    """Batch size one: strict single answers, and no usage is recorded."""
    asked = batches.select("batch_id", "domain_id", "article_id").join(
        answers.select("batch_id", "ok", "error_message", "output_text"), "batch_id", "left"
    )
    usable = asked.withColumns(
        {"ok": F.coalesce("ok", F.lit(False)), "error_message": or_dash(F.col("error_message"))}
    )
    decisions = set_aside(single_decisions(usable, domains, default_language))
    changed = apply_decisions(states, decisions, now, only_changed=True)
    return EditorialRun(decisions, changed, decision_events(decisions, now), None, None, None)
