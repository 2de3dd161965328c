"""Results kept by fingerprint: persisted frames for a session, Parquet for longer."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..spec import QuerySpec


class ResultCache:
    """The last ``most`` results, by query and data version; older ones are unpersisted."""

    def __init__(self, most: int = 64):
        self.most, self.held, self.hits, self.misses = most, OrderedDict(), 0, 0

    def get(self, spec: QuerySpec, version: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = spec.fingerprint(version)
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key]
        self.misses += 1
        self.held[key] = make().persist(StorageLevel.MEMORY_AND_DISK)
        if len(self.held) > self.most:
            self.held.popitem(last=False)[1].unpersist()
        return self.held[key]

    def clear(self) -> None:
        while self.held:
            self.held.popitem()[1].unpersist()


def data_version(df: DataFrame) -> str:
    """Changes when the frame's files change."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(df.inputFiles())).encode()).hexdigest()
