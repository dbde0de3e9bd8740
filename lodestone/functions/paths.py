"""Path expressions; all of them columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that are never scanned, extensions that are, and their languages (fixed values).
EXCLUDED = ["node_modules", "venv", "__pycache__", ".git", "dist", "build"]
LANGUAGES = {".py": "python", ".js": "javascript", ".java": "java"}
#: Roots of a checkout, and prefixes of places where checkouts are put (fixed values).
ROOTS = ["src", "lib", "app", "backend", "frontend", "pkg"]
TEMPORARY = ["/tmp/", "/temp/", "C:/Users/", "c:/Users/"]


def forward(path: Column) -> Column:
    """The path with forward slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def parts(path: Column) -> Column:
    """The path's segments, without empty ones."""
    return F.filter(F.split(forward(path), "/"), lambda x: x != "")


def name(path: Column) -> Column:
    return F.element_at(F.split(forward(path), "/"), -1)


def extension(path: Column) -> Column:
    """The last suffix with its dot, or an empty string; a leading dot is no suffix."""
    return F.regexp_extract(name(path), r"^.+?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"^(.+?)\.[^.]*$", "$1")


def parent(path: Column) -> Column:
    """The directory's name; null for a bare name."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.element_at(p, -2))


def language(ext: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(known[ext], F.lit("unknown"))


def included(path: Column) -> Column:
    """Whether no segment of the path is an excluded directory."""
    return ~F.arrays_overlap(F.split(forward(path), "/"), F.array(*map(F.lit, EXCLUDED)))


def last_segments(path: Column, k: int) -> Column:
    """The last ``k`` segments, or all if there are no more."""
    p = parts(path)
    return F.array_join(F.slice(p, F.greatest(F.size(p) - k + 1, F.lit(1)), k), "/")


def label(path: Column, k: int = 2) -> Column:
    """The last ``k`` segments as a label; just the file's name where the path has no more than ``k``."""
    return F.when(F.size(parts(path)) <= k, name(path)).otherwise(last_segments(path, k))


def canonical(path: Column) -> Column:
    """A path without the place of its checkout.

    Below a temporary prefix it begins at the first known root directory; without one it is the last three segments, or all
    of a shorter path.
    """
    p = forward(path)
    segments = F.split(p, "/")
    at = F.array_position(F.transform(segments, lambda x: x.isin(ROOTS)), True)
    cut = F.when(at > 0, F.array_join(F.slice(segments, at.cast("int"), F.size(segments)), "/"))
    short = F.when(F.size(segments) >= 3, F.array_join(F.slice(segments, -3, 3), "/")).otherwise(p)
    temporary = F.lit(False)
    for prefix in TEMPORARY:
        temporary = temporary | p.startswith(prefix)
    return F.when(temporary, F.coalesce(cut, short)).otherwise(p)


def looks_like_file(node: Column) -> Column:
    return node.contains("/") | node.contains("\\")
