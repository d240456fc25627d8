"""Whether archive members or links would leave the folder they are unpacked into, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of archives.
ARCHIVE_SUFFIXES = "zip jar war ear apk xpi gz tgz bz2 tbz2 xz txz 7z rar tar zst lz lz4 cab iso arj z".split()


def _slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def _climbs(parts: Column) -> Column:
    """Whether a walk along parts is ever above where it began."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + F.when(p == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), (acc["out"] | (depth < 0)).alias("out"))

    return F.aggregate(F.filter(parts, lambda p: ~p.isin("", ".")), start, step, lambda acc: acc["out"])


def _rooted(path: Column) -> Column:
    return path.startswith("/") | path.rlike("^[A-Za-z]:")


def unsafe_member(name: Column) -> Column:
    path = _slashed(name)
    return F.coalesce((name != "") & (name.contains("\x00") | _rooted(path) | _climbs(F.split(path, "/", -1))), F.lit(False))


def unsafe_link(member: Column, target: Column) -> Column:
    """Whether a link at member to target points outside: normalised from member's folder it ends above the root.

    Only where the walk ends counts, not where it passes.  A rooted folder ends nowhere above.
    """
    to, parts = _slashed(target), F.split(_slashed(member), "/", -1)
    folder = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    walk = F.filter(F.concat(folder, F.split(to, "/", -1)), lambda p: ~p.isin("", "."))
    start = F.struct(F.lit(0).alias("down"), F.lit(0).alias("up"))

    def step(acc: Column, p: Column) -> Column:
        back = p == ".."
        return F.struct(F.when(back, F.greatest(acc["down"] - 1, F.lit(0))).otherwise(acc["down"] + 1).alias("down"), (acc["up"] + (back & (acc["down"] == 0)).cast("int")).alias("up"))

    ends_above = F.aggregate(walk, start, step, lambda acc: acc["up"] > 0) & ~_slashed(member).startswith("/")
    return F.coalesce((target != "") & (target.contains("\x00") | _rooted(to) | ends_above), F.lit(False))


def nested_archive(name: Column) -> Column:
    return name.rlike(f"(?i)\\.({'|'.join(sorted(ARCHIVE_SUFFIXES))})\n?\\z")
