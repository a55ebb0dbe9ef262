"""Minimax contiguous sharding of equal-text groups, ordered by the MD5 of the text.

The driver never holds all groups. It starts from the bytes below each 16-bit prefix of the MD5 (65,536
numbers at most) and looks closer only where a cut can fall: the smallest capacity lies between the one for
prefixes taken whole and the one for prefixes that could be split anywhere, and only prefixes that a cut
may meet within those bounds are divided by the next 8 bits, until they are single texts. So the capacity and
the cuts are those over all single texts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.sources.scratch import materialise


def cuts_within(capacity: int, ends: list[int], shards: int) -> list[int] | None:
    """Greedy check: first group of shards 1.. if every shard holds at most `capacity`, else None.

    ends: running totals of the ordered group sizes.
    """
    cuts, start, at = [], 0, 0
    for _ in range(shards):
        at = bisect_right(ends, start + capacity)
        if at == len(ends):
            return cuts
        if at == 0 or ends[at - 1] == start:
            return None
        start = ends[at - 1]
        cuts.append(at)
    return None


def level_cuts(capacity: int, ends: list[int], shards: int) -> list[int]:
    """Cuts within a feasible capacity: each shard aims at the bytes left divided by the shards left.

    No shard is empty while there are groups for it.
    """
    shards = min(shards, len(ends))
    latest, lowest = len(ends), [len(ends)]  # lowest[k]: first group from which k shards hold all the rest
    for _ in range(shards):
        latest = bisect_left(ends, ends[latest - 1] - capacity) + 1 if latest and ends[latest - 1] > capacity else 0
        lowest.append(latest)
    cuts, start, at = [], 0, 0
    for left in range(shards - 1, 0, -1):
        low = max(lowest[left], at + 1)
        high = min(bisect_right(ends, start + capacity), len(ends) - left)
        aim = start + (ends[-1] - start) / (left + 1)
        at = min(max(bisect_left(ends, aim) + 1, low), high)
        if at > low and aim - ends[at - 2] < ends[at - 1] - aim:
            at -= 1
        start = ends[at - 1]
        cuts.append(at)
    return cuts


def smallest_capacity(sizes: list[int], ends: list[int], shards: int) -> int:
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if cuts_within(mid, ends, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def level(sizes: list[int], shards: int) -> list[int]:
    """Cuts that give a group above the mean a shard of its own, both its sides their part of the others."""
    shards, ends = min(shards, len(sizes)), list(accumulate(sizes))
    top = max(range(len(sizes)), key=sizes.__getitem__)
    left, right = sizes[:top], sizes[top + 1 :]
    others = shards - 1
    if shards < 2 or sizes[top] * shards <= ends[-1] or others < bool(left) + bool(right):
        return level_cuts(smallest_capacity(sizes, ends, shards), ends, shards)
    part = round(others * sum(left) / max(1, ends[-1] - sizes[top]))
    part = min(max(part, bool(left), others - len(right)), len(left), others - bool(right))
    cuts = [*level(left, part), top] if left else []
    return cuts + ([top + 1, *(top + 1 + c for c in level(right, others - part))] if right else [])


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity of `shards` runs over ordered sizes (binary search), and level cuts within it."""
    ends = list(accumulate(sizes))
    if not ends:
        return 0, []
    capacity, cuts = smallest_capacity(sizes, ends, shards), level(sizes, shards)
    bounds = [0, *(ends[c - 1] for c in cuts), ends[-1]]
    if max(b - a for a, b in zip(bounds, bounds[1:])) > capacity:
        cuts = level_cuts(capacity, ends, shards)
    return capacity, cuts


def split_capacity(ends: list[int], single: list[bool], atom: int, shards: int) -> int:
    """The smallest capacity if a cell that is no single text could be cut anywhere: none over single texts is lower."""

    def enough(capacity: int) -> bool:
        end = 0
        for _ in range(shards):
            end += capacity
            if end >= ends[-1]:
                return True
            k = bisect_right(ends, end)
            if single[k]:
                end = ends[k - 1] if k else 0
        return False

    low, high = max(atom, -(-ends[-1] // shards)), ends[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid + 1, high)
    return low


def open_cells(sizes: list[int], low: int, high: int, shards: int) -> set[int]:
    """The cells in which a greedy cut may fall for some capacity from low to high, wherever it falls inside cells."""
    ends, out = list(accumulate(sizes)), set()
    first, last = 0, 0  # least and greatest start of the next shard
    for _ in range(shards - 1):
        a = bisect_right(ends, first + low)  # the earliest end is in cell a, at its first byte at least
        b = min(bisect_right(ends, last + high), len(ends) - 1)
        if a >= len(ends):
            break
        out.update(range(a, b + 1))
        first, last = (ends[a - 1] if a else 0), min(ends[b], last + high)
    return out


class Cells:
    """Ordered ranges of the MD5 (as hexadecimal prefixes) with their bytes, rows and distinct texts."""

    def __init__(self, rows: DataFrame, digits: int = 4):
        self.rows, self.digits = rows, digits
        self.held = self.measured(rows, digits)

    def measured(self, rows: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
        """(prefix, bytes, one text): texts with equal MD5 are added up in the tasks first."""
        texts = rows.groupBy("md5").agg(F.sum("size").alias("size"))
        cells = texts.groupBy(F.substring("md5", 1, digits).alias("cell")).agg(F.sum("size").alias("size"), F.min("md5").alias("least"), F.max("md5").alias("most"), F.max("size").alias("atom"))
        found = cells.select("cell", "size", "atom", F.when(F.col("least") == F.col("most"), F.col("least")).alias("only")).collect()
        self.atom = max([getattr(self, "atom", 0), *(r["atom"] for r in found)])
        return sorted((r["only"] or r["cell"], r["size"], r["only"] is not None) for r in found)

    def divide(self, places: list[int]) -> None:
        """The cells at these places by two more digits each."""
        spark, digits = self.rows.sparkSession, self.digits
        by: dict[int, list[str]] = {}
        for k in places:
            by.setdefault(len(self.held[k][0]), []).append(self.held[k][0])
        for length, cells in by.items():
            wanted = spark.createDataFrame([(c,) for c in cells], "cell string")  # a few hundred
            own = self.rows.withColumn("cell", F.substring("md5", 1, length)).join(F.broadcast(wanted), "cell", "left_semi")
            gone = set(cells)
            self.held = sorted([c for c in self.held if c[0] not in gone] + self.measured(own.drop("cell"), length + 2))
        self.digits = digits


def exact_cuts(rows: DataFrame, shards: int, digits: int = 4) -> tuple[int, list[str]]:
    """Smallest capacity over single texts of rows (md5, size) in the order of md5, and the first md5 of shards 1.."""
    cells = Cells(rows, digits)
    while cells.held:
        sizes = [c[1] for c in cells.held]
        high, cuts = minimax_cuts(sizes, shards)
        single = [c[2] for c in cells.held]
        low = split_capacity(list(accumulate(sizes)), single, cells.atom, shards)
        places = open_cells(sizes, low, high, shards) | {c + k for c in cuts for k in (-1, 0) if c + k < len(sizes)}
        coarse = [k for k in sorted(places) if not single[k]]
        if not coarse:
            return high, [cells.held[c][0] for c in cuts]
        cells.divide(coarse)
    return 0, []


def shard(docs: DataFrame, shards: int = 24, digits: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: the shards are contiguous in the order of the text's MD5 and nearly equal in bytes.

    Atomic groups are equal texts. Slots are gapless from 0 in each shard: rows are sorted by MD5 over range
    partitions, equal ones dealt between neighbours by chance, and numbered by the place in their partition and
    the rows before it, so that no group, null id or repeated row has to fit one task. Null texts count as empty
    ones (size 8, CRC 0); null doc_ids and repeated rows keep their row; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("md5"),
    )
    rows = materialise(rows, "shard-rows")
    _, cuts = exact_cuts(rows.select("md5", "size"), shards, digits)
    number = F.lit(0)
    for cut in cuts:  # one comparison for each shard
        number = number + (F.col("md5") >= F.lit(cut)).cast("int")
    placed = rows.withColumn("shard", number).withColumn("chance", F.rand(17)).repartitionByRange("md5", "chance").sortWithinPartitions("md5", "chance")
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("at"))
    placed = materialise(placed.withColumn("part", F.shiftright("at", 33).cast("int")), "shard-placed")
    runs = placed.groupBy("part", "shard").agg(F.min("at").alias("from"), F.count("*").alias("n")).orderBy("part", "shard").collect()  # partitions + shards rows at most
    before, starts = [0] * shards, []
    for r in runs:
        starts.append((r["part"], r["shard"], before[r["shard"]] - r["from"]))
        before[r["shard"]] += r["n"]
    kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("shift", T.LongType())])
    shift = F.broadcast(docs.sparkSession.createDataFrame(starts, kind))
    return placed.join(shift, ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"))
