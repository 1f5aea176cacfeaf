"""Path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def directory(path: Column) -> Column:
    """All before the last slash; empty if there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def normalise(path: Column) -> Column:
    """Resolve ``.`` and ``..``: a ``..`` drops the component before it, if any."""

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def directory_at_depth(path: Column, depth: int) -> Column:
    """The first ``depth`` components of the directory, ``root`` if they are empty."""
    parts = F.split(path, "/")
    joined = F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/")
    return F.when(joined == "", F.lit("root")).otherwise(joined)
