"""Paths and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_NAMES = ["mod", "__init__", "index", "lib"]


def last_segment(name: Column) -> Column:
    """The part of a name after its last ``::`` or ``.``."""
    return F.element_at(F.split(name, r"::|\."), -1)


def qualified_name(owner: Column, name: Column) -> Column:
    """A1: ``Owner::name``, or the name alone."""
    return F.concat_ws("::", owner, name)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """The basename before its first dot; of an index file, the name of its folder."""
    own = F.element_at(F.split(basename(path), r"\."), 1)
    folder = basename(parent(path))
    return F.when(own.isin(*INDEX_NAMES) & (folder != ""), folder).otherwise(own)


def normalise(path: Column) -> Column:
    """Fold ``.`` and ``..`` segments; a path that climbs above its root is null."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    state = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok"))

    def step(acc: Column, s: Column) -> Column:
        kept = acc.getField("kept")
        up = s == ".."
        popped = F.when(F.size(kept) > 0, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.struct(F.when(up, popped).otherwise(F.array_append(kept, s)).alias("kept"), (acc.getField("ok") & ~(up & (F.size(kept) == 0))).alias("ok"))

    done = F.aggregate(parts, state, step)
    return F.when(done.getField("ok"), F.array_join(done.getField("kept"), "/"))


def import_segments(text: Column) -> Column:
    """Names that an import mentions: its parts between path and list signs."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"""[:./{},"'\\ \s<>]+"""), lambda s: s != "")


def qualifier(receiver: Column) -> Column:
    """A receiver's last segment without trailing parentheses and generics."""
    return F.regexp_replace(last_segment(F.regexp_replace(receiver, r"(\([^()]*\)|<[^<>]*>)+$", "")), r"(\([^()]*\)|<[^<>]*>)+$", "")
