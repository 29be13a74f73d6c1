"""Logical schemas of the store's tables."""

from __future__ import annotations

MEMORIES = (
    "memory_id string, text string, embedding array<float>, event_seq long, event_time timestamp, memory_type string, category string, project string, "
    "session_id string, thread_id string, run_id string, agent string, source string, tags array<string>, entities array<string>, fixes_task_id string, extra map<string,string>"
)
EDGES = (
    "source_id string, target_id string, edge_type string, weight double, created_at timestamp, last_seen_at timestamp, created_by string, run_id string, edge_version int, metadata string"
)
MENTIONS = "memory_id string, project string, name string, weight double, created_at timestamp, last_seen_at timestamp, created_by string, run_id string, edge_version int"
SESSIONS = "session_id string, started_at timestamp, ended_at timestamp, last_event_seq long, summary string, project string, thread_id string"
FOLLOWS = "session_id string, prev_session_id string"
TIMELINE = "scope string, event_seq long, memory_id string, memory_type string, project string, session_id string"

EDGE_KEY = ["source_id", "target_id", "edge_type"]
#: Parts of batch jobs whose rows are in the store.
JOBS = "run_id string, kind string, part int, parts int, project string, found long"
