"""Validated configuration of a collection."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from enum import Enum, IntFlag

from .errors import InvalidArgument


class Metric(str, Enum):
    """How near two vectors are; smaller is nearer."""

    L2 = "l2"
    COSINE = "cosine"
    IP = "ip"


class Index(str, Enum):
    HNSW = "hnsw"
    FLAT = "flat"


class OpenMode(IntFlag):
    READONLY = 0
    READWRITE = 1
    CREATE = 2
    TRUNCATE = 4


# Defaults and limits of the public contract.
DEFAULT_M, DEFAULT_EF_CONSTRUCTION, DEFAULT_EF_SEARCH = 16, 200, 100
MOST_M = 10_000


def _enum(kind: type[Enum], value: object) -> Enum:
    try:
        return value if isinstance(value, kind) else kind(list(kind)[value].value if isinstance(value, int) else str(value).lower())
    except (ValueError, IndexError):
        raise InvalidArgument(f"{value!r} is no {kind.__name__.lower()}") from None


@dataclass(frozen=True)
class Config:
    """Immutable; ``with_`` gives a changed copy.  0 stands for a default, as in the contract.

    ``pool_mb`` is accepted and has no effect: Spark manages its own memory.
    """

    dimension: int
    metric: Metric = Metric.L2
    index: Index = Index.HNSW
    m: int = DEFAULT_M
    ef_construction: int = DEFAULT_EF_CONSTRUCTION
    ef_search: int = DEFAULT_EF_SEARCH
    pool_mb: int = 8
    shard_rows: int = 50_000

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        if isinstance(self.dimension, bool) or not isinstance(self.dimension, int) or self.dimension <= 0:
            raise InvalidArgument("dimension must be a positive integer")
        put("metric", _enum(Metric, self.metric))
        put("index", _enum(Index, self.index))
        put("m", self.m or DEFAULT_M)
        if not 2 <= self.m <= MOST_M:
            raise InvalidArgument(f"m must be 2 to {MOST_M}")  # 1 has no level scale
        put("ef_construction", max(self.ef_construction or DEFAULT_EF_CONSTRUCTION, self.m))
        put("ef_search", self.ef_search or DEFAULT_EF_SEARCH)
        if self.ef_construction < 0 or self.ef_search < 0 or self.pool_mb < 0 or self.shard_rows <= 0:
            raise InvalidArgument("sizes must not be negative")

    def with_(self, **changes: object) -> Config:
        return replace(self, **changes)

    def to_dict(self) -> dict[str, object]:
        return asdict(self) | {"metric": self.metric.value, "index": self.index.value}

    @property
    def effort(self) -> int:
        return self.ef_search

    def ef(self, k: int, asked: int = 0) -> int:
        """Beam width of a search: asking can raise it and never lowers it."""
        return max(asked, k, self.ef_search)
