"""Schemas and configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The id that no document has, and the answer of lookups that find nothing.
DELETED_UID, NOT_FOUND = -(1 << 63), -1
#: Tiers, freshest first.
TIERS = ("B", "A", "disk")


@dataclass
class IngestConfig:
    batch_size: int = 1000  # changes that start a flush
    batch_delay_ms: int = 300_000  # the longest that changes wait for one
    max_batch_size: int = 10_000  # changes that may wait before producers have to
    realtime: bool = True
    realtime_batch_size: int = 100  # events that are made visible together
    max_events_per_minute: int | None = None  # None: unlimited


@dataclass
class MergeConfig:
    """Segment layout: how many large segments, how many segments at most, and when small ones are merged."""

    large_segments: int = 10
    merge_factor: int = 10
    small_segments: int | None = None  # None: large_segments + 2 * merge_factor
    max_merge_docs: int = (1 << 31) - 1
    partial_expunge: bool = False

    @property
    def small_cap(self) -> int:
        return self.large_segments + 2 * self.merge_factor if self.small_segments is None else self.small_segments


@dataclass
class SearchRequest:
    query: str | None = None
    k: int = 10


@dataclass
class SearchHit:
    score: float
    fields: dict[str, list[str]]


@dataclass
class SearchResult:
    total_hits: int
    total_docs: int
    time_ms: float
    hits: list[SearchHit] = field(default_factory=list)
