"""Path columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """The parts of a path that are not empty."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def component(path: Column, depth: int) -> Column:
    """The part at a depth from 1; 'unknown' where there is none."""
    return F.coalesce(F.try_element_at(components(path), F.lit(depth)), F.lit("unknown"))


def clean(path: Column) -> Column:
    """POSIX cleaning: single slashes, no '.' parts, '..' takes the part before it, '/' at the root."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        empty,
        lambda acc, x: F.when(x != "..", F.array_append(acc, x)).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def within(path: Column, scope: str) -> Column:
    """At a directory or below it."""
    scope = scope.rstrip("/")
    return (path == scope) | path.startswith(scope + "/") if scope else path.isNotNull()


def above(path: Column, scope: str) -> Column:
    """A proper ancestor of a directory."""
    return F.lit(scope).startswith(F.concat(F.regexp_replace(path, "/$", ""), F.lit("/"))) & (path != scope)


def lineage(path: Column) -> Column:
    """The path and all that lie above it, '/' first."""
    parts = components(path)
    own = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.when(path.isNotNull(), own)


def version_key(fsid: Column, path: Column, revision: Column) -> Column:
    """Binary key whose order is that of fsid, path and revision; a path sorts right before what lies below it."""
    whole = lambda c, digits: F.unhex(F.lpad(F.hex(c.cast("long")), digits, "0"))
    return F.concat(whole(fsid, 8), F.encode(path, "UTF-8"), F.lit(b"\0"), whole(revision, 16))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def classify(path: Column, prefixes: list[str], depth: int) -> Column:
    """The longest configured prefix on a part boundary, else the part at a depth."""
    out = component(path, depth)
    for p in sorted(prefixes, key=lambda p: (len(p), p)):
        out = F.when(within(path, p), p.rstrip("/")).otherwise(out)
    return out
