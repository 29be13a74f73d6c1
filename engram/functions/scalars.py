"""Column functions of scoring, normalising and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.settings import DEFAULTS, Settings


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def content_id(given: Column, text: Column) -> Column:
    """The given id, else the md5 of the text."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.md5(text))


def vector_score(cosine: Column) -> Column:
    """Cosine from -1..1 to 0..1."""
    return (clamp(cosine, -1.0, 1.0) + 1) / 2


def graph_score(score: Column, low: Column, high: Column) -> Column:
    """Position between the bounds, 0.5 without usable bounds."""
    usable = low.isNotNull() & high.isNotNull() & (high > low) & score.isNotNull()
    return F.when(usable, clamp((score - low) / (high - low))).otherwise(F.lit(0.5))


def semantic_score(raw: Column, kind: str) -> Column:
    """rerank: logistic; rrf: share of 0.035; anything else is clamped."""
    if kind == "rerank":
        return F.when(raw >= 0, 1 / (1 + F.exp(-raw))).otherwise(F.exp(raw) / (1 + F.exp(raw)))
    return clamp(raw / 0.035) if kind == "rrf" else clamp(raw)


def raw_semantic(rerank: Column, rrf: Column) -> Column:
    """The rerank score unless it is missing or 0, else the fused score, else 0.5."""
    return F.coalesce(F.nullif(rerank, F.lit(0.0)), rrf, F.lit(0.5))


def category_of(category: Column, memory_type: Column) -> Column:
    return F.coalesce(category, memory_type, F.lit("default"))


def parse_time(text: Column) -> Column:
    """An instant from ISO text; without an offset it is UTC (the session's zone), junk is null."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))


def temporal_decay(event_time: Column, category: Column, now: Column, half_lives: dict | None = None) -> Column:
    """0.5 ** (age / half-life), at least 0.01; 0.5 without a time, 1 for the future."""
    lives = half_lives or DEFAULTS.half_lives
    fallback = F.lit(float(lives.get("default", 30.0)))
    life = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in lives.items() for x in (k, float(v))]), F.coalesce(category, F.lit("default"))), fallback)
    life = F.when(life <= 0, F.lit(30.0)).otherwise(life)
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(event_time.cast("timestamp"))) / F.lit(86400e6)
    return F.when(event_time.isNull(), F.lit(0.5)).when(days < 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.01), F.exp(-F.log(F.lit(2.0)) * days / life)))


def merge_half_lives(override: dict | None, base: dict | None = None) -> dict:
    """Defaults with the override's usable entries; an unusable override changes nothing."""
    out = dict(base or DEFAULTS.half_lives)
    if isinstance(override, dict):
        try:
            out |= {str(k): float(v) for k, v in override.items()}
        except (TypeError, ValueError):
            return dict(base or DEFAULTS.half_lives)
    return out


def composite_score(semantic: Column, temporal: Column, frequency: Column | None = None, importance: Column | None = None, weights: dict | None = None) -> Column:
    """The weighted sum, clamped; custom weights count missing parts as 0."""
    w = weights or {"semantic": 0.55, "temporal": 0.30, "frequency": 0.10, "importance": 0.05}
    frequency, importance = (F.lit(0.5) if x is None else x for x in (frequency, importance))
    return clamp(w.get("semantic", 0.0) * semantic + w.get("temporal", 0.0) * temporal + w.get("frequency", 0.0) * frequency + w.get("importance", 0.0) * importance)


def pipeline_weights(settings: Settings = DEFAULTS) -> dict:
    rest = settings.frequency_weight + settings.importance_weight
    return {"semantic": max(0.0, 1 - settings.temporal_weight - rest), "temporal": settings.temporal_weight, "frequency": settings.frequency_weight, "importance": settings.importance_weight}


def duplicate_action(found: Column, explicit: Column, category: Column) -> Column:
    """What to do with an item: append when it has no duplicate, an explicit wish wins, else by category."""
    by_category = F.when(category.isin("debug", "scratch"), "skip").when(category == "decision", "update").when(category.isin("research", "context", "pattern"), "append").otherwise("skip")
    return F.when(~found, "append").when(explicit.isin("skip", "update", "append"), explicit).otherwise(by_category)


def best_score(*candidates: Column) -> Column:
    """The first candidate that is a number; 0 counts."""
    return F.coalesce(*(c.try_cast("double") for c in candidates))


def normalize_tags(tags: Column) -> Column:
    """Trimmed, non-empty, distinct tags in order."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "")))


def public_keys(metadata: Column) -> Column:
    """The map without keys that begin with an underscore."""
    return F.map_filter(metadata, lambda k, v: ~F.startswith(k, F.lit("_")))


def metadata_json(metadata: Column) -> Column:
    return F.to_json(metadata)


def metadata_map(text: Column) -> Column:
    """The JSON object as a map; anything else under the key _raw."""
    parsed = F.from_json(text, "map<string,string>")
    return F.when(text.isNull(), F.lit(None).cast("map<string,string>")).when(F.coalesce(F.size(parsed), F.lit(-1)) >= 0, parsed).otherwise(F.create_map(F.lit("_raw"), text))


def safe_token(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9_-]", "_")


def word_estimate(text: Column) -> Column:
    """Words between white space; none in blank text."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+"))).cast("long")


def relative_dates(text: Column, now: Column) -> Column:
    """today, yesterday, last week and last month as dates, in the spelling with a small or a capital letter."""
    day = now.cast("date")
    show = lambda d: F.date_format(d, "MMMM dd, yyyy")
    monday = F.date_sub(F.date_trunc("week", day).cast("date"), 7)
    first = F.add_months(F.trunc(day, "month"), -1)
    span = lambda a, b: F.concat(F.lit("between "), show(a), F.lit(" and "), show(b))
    values = (("today", show(day)), ("yesterday", show(F.date_sub(day, 1))), ("last week", span(monday, F.date_add(monday, 6))), ("last month", span(first, F.last_day(first))))
    for words, value in values:
        text = F.regexp_replace(text, F.lit(f"{words}|{words[0].upper()}{words[1:]}"), value)
    return text


# Words that mark a question about the past.
RECALL_WORDS = ("remember", "recall", "memory", "past", "previous", "do you know", "do you have", "heard of", "familiar with", "know anything about", "tell me about", "what about", "know of")


def is_recall(query: Column) -> Column:
    text = F.lower(query)
    flag = F.lit(False)
    for w in RECALL_WORDS:
        flag = flag | F.contains(text, F.lit(w))
    return flag


def recall_category(query: Column, category: Column) -> Column:
    """The category that the older search looks at first: a question about the past asks for past conversations."""
    return F.when(is_recall(query), "past_conversation").otherwise(category)


def boosted(query: Column, topic: str, boosts: list[str]) -> Column:
    """The query with the boost words after it, if it names the topic and none of them."""
    text = F.lower(query)
    has = F.lit(False)
    for b in boosts:
        has = has | F.contains(text, F.lit(b))
    return F.when(F.contains(text, F.lit(topic)) & ~has, F.concat_ws(" ", query, *map(F.lit, boosts))).otherwise(query)


def judged_score(response: Column) -> Column:
    """The score of a judge's JSON answer; null unless a number from 0 to 1."""
    s = F.from_json(response, "score double").getField("score")
    return F.when(s.between(0, 1), s)


def fit_scores(scores: Column, n: Column) -> Column:
    """Exactly n scores: padded with 0, or cut."""
    return F.slice(F.concat(F.coalesce(scores, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), n.cast("int"))), F.lit(1), n.cast("int"))


def candidate_text(content: Column, text: Column, everything: Column, limit: int = 1000) -> Column:
    """The first of content and text that is not blank, else the whole row as JSON; at most limit characters."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.substring(F.coalesce(blank(content), blank(text), everything), 1, limit)
