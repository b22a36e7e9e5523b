"""SimHash near-duplicates by a grid join on per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import components, values, written

SEED = 42
SEGMENTS = 32  # two bits each: a count of 0 to 2, all 32 of them packed into one long
PAIRS = 0x5555555555555555


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles; null and texts without words give zero."""
    parts = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII blanks only
    if not parts:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(parts) <= words:
        hashes = [digest(join(parts), SEED)]
    else:
        whole = join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = [0, *ends[: len(parts) - words].tolist()]
        stops = (ends[words - 1 :] - 1).tolist()
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts, stops)]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority).view(">i8")[0])


def fingerprint_column(text: str | Column, words: int = 3) -> Column:
    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t, words) for t in values(batch)], pa.int64())

    return of(text)


def hex_fingerprint(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def segment_counts(fp: Column) -> Column:
    """The bit count of each two-bit segment, in the place of that segment."""
    low, high = fp.bitwiseAND(F.lit(PAIRS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(PAIRS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """The sum of the segments' count differences: never above the number of differing bits.

    Counts differ by 2 where only the high bit of their exclusive or is set, else by its bits' maximum.
    """
    x = a.bitwiseXOR(b)
    high = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(PAIRS))
    low = x.bitwiseAND(F.lit(PAIRS))
    return 2 * F.bit_count(high) + F.bit_count(low) - 2 * F.bit_count(high.bitwiseAND(low))


def group_masks(groups: int) -> list[int]:
    """The segments dealt into ``groups`` runs of about one length, as bit masks."""
    bounds = [round(i * SEGMENTS / groups) for i in range(groups + 1)]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(bounds, bounds[1:])]


def _cells(points: DataFrame, groups: int, distance: int) -> DataFrame:
    """A row for each point and each choice of ``groups - distance`` groups: the grid cell of its counts there.

    ``before`` holds the groups left out that come before the last one chosen.
    """
    masks = group_masks(groups)
    grids = []
    for i, chosen in enumerate(combinations(range(groups), groups - distance)):
        before = sum(1 << g for g in range(chosen[-1]) if g not in chosen)
        mask = _signed(sum(masks[g] for g in chosen))
        grids.append(F.struct(F.lit(i).alias("grid"), F.lit(mask).alias("mask"), F.lit(before).alias("before")))
    return points.select("fp", "counts", F.explode(F.array(*grids)).alias("g")).select(
        "fp", "counts", "g.grid", F.col("counts").bitwiseAND(F.col("g.mask")).alias("cell"), "g.before"
    )


def _links(cells: DataFrame, groups: int, distance: int) -> DataFrame:
    """Pairs of one cell that differ in at most ``distance`` bits, from the first grid alone in which they meet."""
    a, b = cells.alias("a"), cells.alias("b")
    x = F.col("a.counts").bitwiseXOR(F.col("b.counts"))
    agree = F.lit(0)
    for g, mask in enumerate(group_masks(groups)):
        agree = agree + F.when(x.bitwiseAND(F.lit(_signed(mask))) == 0, F.lit(1 << g)).otherwise(F.lit(0))
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    bound = manhattan(F.col("a.counts"), F.col("b.counts")) <= distance
    meet = (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell"))
    first = agree.bitwiseAND(F.col("a.before")) == 0
    return a.join(b, meet & (F.col("a.fp") < F.col("b.fp")) & bound & close & first).select(
        F.col("a.fp").alias("u"), F.col("b.fp").alias("v")
    )


def links(
    fps: DataFrame, distance: int = 3, groups: int = 6, fine_groups: int = 10, max_cell: int = 64
) -> DataFrame:
    """Every pair ``u < v`` of the distinct fingerprints ``fp`` that differ in at most ``distance`` bits.

    A fingerprint becomes the point of its 32 segment counts. Points within Manhattan distance
    ``distance`` agree in at least ``groups - distance`` of ``groups`` groups of segments, so they
    share a cell in one of the grids that leave ``distance`` groups out. Points of cells with more
    than ``max_cell`` of them meet in the finer grids of ``fine_groups`` groups instead. Cells join
    under the Manhattan bound, and the bits decide. For more rows, raise both numbers of groups:
    cells get smaller, rows per point grow from C(6, 3) on; no number loses a pair.
    """
    points = fps.select("fp", segment_counts(F.col("fp")).alias("counts"))
    cells = _cells(points, groups, distance)
    sizes = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(
        cells.join(sizes, ["grid", "cell"]).select(
            "fp", "counts", "grid", "cell", "before", (F.col("n") > max_cell).alias("full")
        ),
        "simhash-cells",
    )
    coarse = _links(shared.where("not full"), groups, distance)
    fine = _cells(shared.where("full").select("fp", "counts").distinct(), fine_groups, distance)
    return coarse.unionByName(_links(fine, fine_groups, distance)).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, **grid
) -> DataFrame:
    """``doc_id, fp, component_id`` for each row; component_id is the smallest id that links reach.

    Rows of one fingerprint are one point, so copies are never paired. Null and empty texts have
    fingerprint zero and are linked like any other. A row with a null id joins its group; a group
    without any id has a null component_id. Repeated rows come back as often as they came.
    """
    marked = written(
        docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), words).alias("fp")),
        "simhash-fingerprints",
    )
    return grouped(marked, distance, **grid)


def grouped(marked: DataFrame, distance: int = 3, **grid) -> DataFrame:
    """``marked`` (``doc_id, fp``, more) with the root and the component_id of each row's fingerprint."""
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(fps, distance, **grid)).withColumnRenamed("node", "fp")
    member = fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(member.join(least, "root").select("fp", "root", "component_id"), "fp", "left")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, **grid
) -> DataFrame:
    """The rows of ``docs``, one of each group: that of the smallest id, and of its texts the one with the least hash.

    Rows with a null id stay only where their group has no id. Of repeated rows one stays.
    """
    keys = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"),
            fingerprint_column(F.col(text_col), words).alias("fp"),
        ),
        "simhash-keys",
    )
    chosen = written(
        grouped(keys, distance, **grid)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
        .groupBy("root", "doc_id").agg(F.min(F.struct("h", "n")).alias("least"))
        .select("doc_id", "least.h", "least.n"),
        "simhash-chosen",
    )
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64(f"d.{text_col}") == F.col("k.h"))
    kept = docs.alias("d").join(chosen.alias("k"), same, "left_semi").select("d.*")
    return kept if chosen.where("n > 1").isEmpty() else kept.dropDuplicates([id_col, text_col])
