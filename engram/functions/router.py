"""Query routing: the retrieval mode of each query, from patterns in its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of each mode, over text in lower case. The capital I in some can never match.
PATTERNS = {
    "TEMPORAL": [
        r"\b(last|recent|latest|today|yesterday|this week)\b",
        r"what (did|have) (we|I) (do|done|work)",
        r"\b(just did|earlier today|most recent|recently)\b",
        r"\b(what happened|current state|catch up)\b",
    ],
    "DECISION": [
        r"\b(decid\w*|decision\w*|chose|chosen|rationale)\b",
        r"why did (we|I|you) (choose|pick|go with|decide|select)",
        r"what (was|is) the (plan|approach|strategy|reasoning)",
        r"\b(trade-?offs?|pros and cons|justification)\b",
    ],
    "PATTERN": [
        r"\b(how do we|pattern|workflow|best practice|standard)\b",
        r"\b(usual|typical|convention|how should)\b",
        r"\b(common approach|established|guideline|procedure)\b",
    ],
    "SESSION": [
        r"\b(session|checkpoint|resume|pick up where)\b",
        r"\b(last time|previous session|continue from)\b",
        r"\b(where were we|where did we leave|left off)\b",
    ],
    "GRAPH": [
        r"\b(relat|connect|link|between|depend|upstream|downstream)\b",
        r"\b(associated with|interact with|network of)\b",
        r"\b(compare|contrast)\b",
    ],
    "VECTOR": [
        r"\b(define|explain|summarize|describe|what is|who is)\b",
        r"\b(list all|tell me about|overview of)\b",
    ],
}
# The order in which ties are broken.
PRIORITY = ("DECISION", "SESSION", "PATTERN", "TEMPORAL", "GRAPH", "VECTOR")

# Keywords of the older, coarser router.
VECTOR_WORDS = ("what is", "who is", "define", "explain", "list", "summarize", "when did", "where is", "how to", "steps to", "procedure for")
GRAPH_WORDS = ("relationship", "related to", "connection between", "link between", "how does", "why does", "compare", "contrast", "network of", "associated with", "interact with")


def mode_counts(text: Column) -> dict[str, Column]:
    """How many of each mode's patterns are in the text (lower case, trimmed)."""
    out = {}
    for mode, patterns in PATTERNS.items():
        total = F.lit(0)
        for p in patterns:
            total = total + F.rlike(text, F.lit("(?U)" + p)).cast("int")
        out[mode] = total
    return out


def route(query: Column) -> Column:
    """The mode of a query: most patterns, ties by PRIORITY, HYBRID without any."""
    text = F.trim(F.lower(F.coalesce(query, F.lit(""))))
    counts = F.struct(*(c.alias(mode) for mode, c in mode_counts(text).items()))
    # one entry, so that the decision refers to counts that are there and no pattern is matched twice
    return F.get(F.transform(F.array(counts), _mode_of), F.lit(0))


def _mode_of(n: Column) -> Column:
    kinds = sum(((n[mode] > 0).cast("int") for mode in PATTERNS), F.lit(0))
    generic = (n["VECTOR"] > 0).cast("int") + (n["GRAPH"] > 0).cast("int")
    most = F.greatest(*(n[mode] for mode in PATTERNS))
    out = F.when(most == 0, "HYBRID")
    out = out.when((kinds == 2) & (n["SESSION"] > 0) & (n["TEMPORAL"] > 0), "SESSION")
    out = out.when((n["TEMPORAL"] > 0) & (kinds > 1) & (kinds == generic + 1), "TEMPORAL_SEMANTIC")
    for mode in PRIORITY:
        out = out.when(n[mode] == most, mode)
    return out.otherwise("HYBRID")


def route_by_keywords(query: Column) -> Column:
    text = F.lower(query)
    has = lambda words: F.greatest(*(F.contains(text, F.lit(w)) for w in words))
    vector, graph = has(VECTOR_WORDS), has(GRAPH_WORDS)
    return F.when(vector & ~graph, "VECTOR").when(graph & ~vector, "GRAPH").otherwise("HYBRID")


#: Modes whose results are not expanded over the graph.
NOT_EXPANDED = ("PATTERN", "TEMPORAL")


def expands(mode: Column) -> Column:
    return ~mode.isin(*NOT_EXPANDED)
