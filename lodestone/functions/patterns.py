"""Classes of files in architecture patterns, by words in their names and directories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

# Fixed values: (class, words in the stem, words in the directory), the first that fits counts. Words are found within names.
LAYERED = [
    ("presentation", "controller route view handler endpoint api rest", "controller api route presentation ui views handlers"),
    ("business", "service business logic usecase manager processor", "service business domain core logic services"),
    ("data", "repository dao model entity db database", "repository dao data persistence model models db database"),
]
MVC = [("controllers", "controller route endpoint api", "controller api"), ("models", "model entity schema dto", "model"), ("views", "view template page", "view template page")]
HEXAGONAL = [("ports", "port interface iface", "port"), ("adapters", "adapter impl implementation", "adapter"), ("domain", "", "domain core business")]
EVENTS = [("events", "event message notification", ""), ("publishers", "publisher emitter producer", ""), ("subscribers", "subscriber listener consumer handler", "")]


def classified(node: Column, classes: list[tuple[str, str, str]]) -> Column:
    """The node's class, or null."""
    stem, directory = F.lower(paths.stem(node)), F.lower(F.coalesce(paths.parent(node), F.lit("")))
    out = None
    for word, stems, directories in classes:
        hit = F.lit(False)
        if stems:
            hit = hit | stem.rlike("|".join(stems.split()))
        if directories:
            hit = hit | directory.rlike("|".join(directories.split()))
        out = F.when(hit, word) if out is None else out.when(hit, word)
    return out
