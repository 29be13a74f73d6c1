"""Entity names: canonical forms, identifiers in content, and mentions in queries."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ENTITIES = 20
MAX_BYTES = 100_000

# File endings and patterns of identifiers.
EXTENSIONS = "tsx|jsx|yaml|py|md|ts|json|yml|sh|toml|js|rs|go"
PATH = rf"(?:(?:[a-zA-Z0-9_.-]{{1,200}}/){{1,10}}[a-zA-Z0-9_.-]{{1,200}}\.(?:{EXTENSIONS})\b)"
BARE_FILE = rf"\b[a-zA-Z0-9_-]{{1,200}}\.(?:{EXTENSIONS})\b"
CAMEL_CASE = r"\b[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b"
BACKTICK = r"`([^`\n]{1,60})`"
PHRASE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
ACRONYM = r"\b(API|MCP|SDK|CLI|VPS|LLM|NER|RRF|MMR|NDCG|FTMO|MT5)\b"

# Common names that queries mention, with their types. Names of one's own projects are given as a parameter.
KNOWN_NAMES = {
    "pinecone": "technology",
    "neo4j": "technology",
    "redis": "technology",
    "langfuse": "technology",
    "telegram": "technology",
    "python": "technology",
    "fastapi": "technology",
    "docker": "technology",
    "nginx": "technology",
    "metatrader": "technology",
    "mt5": "technology",
    "metaapi": "technology",
    "tradingview": "technology",
    "circuit breaker": "concept",
    "dead man switch": "concept",
    "heartbeat": "concept",
    "reranker": "concept",
    "embedding": "concept",
    "checkpoint": "concept",
    "webhook": "concept",
}


def canon(raw: Column, aliases: dict[str, str] | None = None) -> Column:
    """The canonical form of a name; null for a blank one."""
    s = F.regexp_replace(F.regexp_replace(F.lower(raw), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    slashed = F.regexp_replace(F.regexp_replace(F.replace(s, F.lit("\\"), F.lit("/")), r"^\./", ""), r"(?<=.)/$", "")
    s = F.when(F.contains(s, F.lit("/")) | F.contains(s, F.lit("\\")), slashed).otherwise(s)
    if aliases:
        s = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), s), s)
    return F.nullif(s, F.lit(""))


def canon_text(raw: str, aliases: dict[str, str] | None = None) -> str | None:
    """canon() of one Python string."""
    s = " ".join(raw.split()).lower()
    if "/" in s or "\\" in s:
        s = s.replace("\\", "/").removeprefix("./")
        s = s[:-1] if len(s) > 1 and s.endswith("/") else s
    return (aliases or {}).get(s, s) or None


def identifiers(text: str, limit: int = MAX_ENTITIES, aliases: dict[str, str] | None = None, most: int | None = MAX_BYTES) -> list[str]:
    """Names in content in order of place: paths, files, CamelCase and backticked spans, the first of each canonical form.

    At most `limit` names, of the first `most` bytes of the content (None: of all of it).
    """
    text = text if most is None else text.encode("utf-8", "ignore")[:most].decode("utf-8", "ignore")
    paths = [m.span() for m in re.finditer(PATH, text)]
    starts = [a for a, _ in paths]

    def in_path(at: int) -> bool:  # paths are in order and do not overlap
        i = bisect_right(starts, at)
        return i > 0 and at < paths[i - 1][1]

    hits = [(a, text[a:b]) for a, b in paths]
    for pattern in (BARE_FILE, CAMEL_CASE):
        hits += [(m.start(), m[0]) for m in re.finditer(pattern, text) if not in_path(m.start())]
    hits += [(m.start(1), m[1]) for m in re.finditer(BACKTICK, text)]
    first: dict[str, tuple[int, str]] = {}
    for place, raw in sorted(hits, key=lambda h: h[0]):
        name = canon_text(raw, aliases)
        if name:
            first.setdefault(name, (place, raw))
    return [raw for _, raw in sorted(first.values(), key=lambda h: (h[0], -len(h[1])))[:limit]]


def identifiers_of(limit: int = MAX_ENTITIES, aliases: dict[str, str] | None = None, most: int | None = MAX_BYTES):
    """Column function: identifiers() in Arrow batches; places of matches are beyond the built-in functions."""

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([identifiers(t or "", limit, aliases, most) for t in texts.to_pylist()], pa.list_(pa.string()))

    return found


def pattern_names(text: Column, pattern: str = CAMEL_CASE, group: int = 0) -> Column:
    """Distinct matches of one pattern, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def query_mentions(text: Column, known: dict[str, str] | None = None) -> Column:
    """array<struct<name, entity_type, confidence>>: known names, capitalised phrases and acronyms, by confidence, names once."""
    known = KNOWN_NAMES if known is None else known
    one = lambda n, t, c: F.struct(n.alias("name"), t.alias("entity_type"), F.lit(c).alias("confidence"))
    lower = F.lower(text)
    listed = F.filter(F.array(*(one(F.lit(n), F.lit(t), 1.0) for n, t in known.items())), lambda e: F.contains(lower, e["name"]))
    phrases = F.transform(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(1)), lambda n: one(n, F.lit("unknown"), 0.6))
    acronyms = F.transform(F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(1)), lambda n: one(n, F.lit("technology"), 0.8))
    # names met before in this order are dropped: known, phrases, acronyms
    every = F.concat(listed, phrases, acronyms)
    kept = F.filter(every, lambda e, i: F.array_position(F.transform(every, lambda x: F.lower(x["name"])), F.lower(e["name"])) == i + 1)

    def sure(c: float) -> Column:
        return F.filter(kept, lambda e: e["confidence"] == c)

    return F.concat(sure(1.0), sure(0.8), sure(0.6))
