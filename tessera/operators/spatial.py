"""Overlap and suppression of crowded images: boxes meet in the cells of a grid instead of in their image.

Images (or classes of an image) of up to FEW boxes are compared whole, by one shuffle; only fuller ones go to cells.
Boxes that overlap more than a share `least` (over 0) have longer sides within a factor of 1 / least of each other. So a box
is entered at its own level, in a grid whose cells are one to two of its sides wide, and as a guest at the few coarser
levels where it can meet a larger partner: four cells a level at most, whatever the sizes. Two boxes meet only at the
larger one's level, where that one is no guest.

Boxes without an area, or with null or infinite coordinates, overlap nothing and stay.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.operators.detections import BOX, OVERLAP, iou, overlapping, suppress
from tessera.session import settled

CELL = ["g", "level", "cx", "cy"]
#: Boxes of an image up to which it is compared whole, and of a cell up to which each is compared with all others of the cell
#: when suppression looks for what may stay.
FEW = 256
#: Boxes of a part of the ranking, tasks that sort one, and parts at most; each batch of parts is GROWTH times the one before.
PART, SLICES, PARTS, GROWTH = 1_000_000, 8, 1000, 4
#: Boxes that a task may hold of a tile, and overlapping pairs of them that it orders at a time (unless few boxes have more).
EDGES, PAIRS = 1_200_000, 4_000_000
#: Levels (powers of two of the longer side) of a band, whose boxes share a grid of tiles; the side of a tile and how far it
#: looks beyond its edges, both in longest sides of the band.
LEVELS, SPAN, HALO = 6, 6, 1.5
TILE = ["band", "tx", "ty"]
#: What a tile knows of a box: whether it sees all that may overlap it, whether it is the one to tell, whether it stays for sure.
SURE, CORE, FIXED = 1, 2, 4


def _proper() -> F.Column:
    finite = lambda c: F.abs(F.col(c)) < float("inf")  # noqa: E731  false for NaN too, as NaN is above infinity
    return F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & finite("x1") & finite("x2") & finite("y1") & finite("y2"), F.lit(False))


def _entered(boxes: DataFrame, keys: list[str], least: float, more: list[str]) -> DataFrame:
    """A row for each box (of proper ones) and cell: the cell, whether it is at the box's own level, the box, `more`."""
    levels = math.ceil(math.log2(1 / least)) + 1  # one more than the sides' ratio asks for, as logarithms are rounded
    own = F.floor(F.log2(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))))
    rows = boxes.filter(_proper()).select(F.struct(*keys).alias("g"), *BOX, *more, own.alias("at"))
    rows = rows.select("*", F.explode(F.sequence("at", F.col("at") + levels)).alias("level")).withColumn("own", F.col("level") == F.col("at"))
    for a, low, high in (("cx", "x1", "x2"), ("cy", "y1", "y2")):
        rows = rows.select("*", F.explode(F.sequence(_cell(low), _cell(high))).alias(a))
    return rows.drop("at")


def _cell(x: str | F.Column) -> F.Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / F.pow(F.lit(2.0), F.col("level") + 1))


def _shared() -> F.Column:
    """The overlap of a box and one whose columns begin with a_."""
    return iou({k: F.col(f"a_{k}") for k in BOX}, {k: F.col(k) for k in BOX})


def _split(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of up to FEW rows, and of larger ones (none if there are no such groups). Groups are counted, not held."""
    full = settled(rows.groupBy(*keys).count().filter(F.col("count") > FEW).select(F.struct(*keys).alias("g")), "full")
    if full.isEmpty():
        return rows, None
    on = F.struct(*[rows[k] for k in keys]) == full["g"]
    return rows.join(full, on, "left_anti"), rows.join(full, on, "left_semi")


def overlapping_by_space(detections: DataFrame, least: float = OVERLAP, agnostic: bool = False) -> DataFrame:
    """overlapping() without a join of crowded images: their boxes meet by an equality join on cells; a pair is told only in
    the cell that holds the upper left corner of what the two share, so once. Groups of up to FEW boxes are gathered and
    paired. `least` of 0 or below joins whole images, as sides tell nothing then."""
    if least <= 0:
        return overlapping(detections, least, agnostic)
    keys = ["img"] if agnostic else ["img", "cls"]
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)  # null equals nothing, as in a join
    boxes = settled(detections.filter(_proper()).filter(known).select(*keys, "det_id", *BOX), "boxes")
    few, many = _split(boxes, keys)
    groups = few.groupBy(*keys).agg(F.collect_list(F.struct("det_id", *BOX)).alias("all")).filter(F.size("all") > 1)
    two = groups.select("img", "all", F.explode("all").alias("a")).select("img", "a", F.explode(F.filter("all", lambda b: b["det_id"] > F.col("a.det_id"))).alias("b"))
    pairs = two.select("img", F.col("a.det_id").alias("id_a"), F.col("b.det_id").alias("id_b"), iou(F.col("a"), F.col("b")).alias("iou")).filter(F.col("iou") > least)
    return pairs if many is None else pairs.union(_met(many, keys, least))


def _met(boxes: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(img, id_a, id_b, iou) of proper boxes that meet in cells."""
    rows = settled(_entered(boxes, keys, least, ["det_id"]), "cells")
    a = rows.filter("own").drop("own").withColumnsRenamed({c: f"a_{c}" for c in (*BOX, "det_id")})
    met = a.join(rows, CELL).filter((F.col("det_id") != F.col("a_det_id")) & (~F.col("own") | (F.col("a_det_id") < F.col("det_id"))))
    corner = (_cell(F.greatest("x1", "a_x1")) == F.col("cx")) & (_cell(F.greatest("y1", "a_y1")) == F.col("cy"))
    return met.filter(corner).select(F.col("g.img").alias("img"), F.least("det_id", "a_det_id").alias("id_a"), F.greatest("det_id", "a_det_id").alias("id_b"), _shared().alias("iou")).filter(F.col("iou") > least)


def suppress_by_rounds(detections: DataFrame, least: float = OVERLAP, agnostic: bool = False) -> DataFrame:
    """suppress() for images of any number of boxes; ties beyond det_id go to any one row.

    Groups of up to FEW boxes are folded by suppress(). The boxes of fuller ones are ranked by one sort and taken in batches,
    best first, each batch some times larger than the one before. What overlaps a box that stays goes at once; the rest is
    decided tile by tile, each tile with what lies around it. Boxes whose fate hangs on what a tile doesn't see are left
    to the next look, through tiles in other places. If a tile holds too many boxes the batch is made smaller, down to
    a part of the ranking, which is then resolved in rounds.
    """
    if least <= 0:
        return suppress(detections, least, agnostic)
    keys = ["img"] if agnostic else ["img", "cls"]
    rows = settled(detections.withColumn("__uid", F.monotonically_increasing_id()), "boxes")
    proper, kept = rows.filter(_proper()), rows.filter(~_proper())
    few, many = _split(proper, keys)
    if re.search("map<|variant", rows.schema.simpleString()):  # can't be sorted with the rest of a row
        few, many = None, proper
    if few is not None:
        kept = kept.union(suppress(few, least, agnostic))
    if many is not None:
        light = set(detections.columns) <= {"img", "cls", "score", "det_id", *BOX} and all(detections.schema[c].dataType.typeName() in ("double", "float") for c in BOX)
        stay = _suppress_crowd(many, keys, least, [c for c in detections.columns if c not in (*keys, *BOX)] if light else [])
        kept = kept.union((stay if light else many.join(stay, "__uid", "left_semi")).select(rows.columns))
    return kept.drop("__uid")


def _suppress_crowd(boxes: DataFrame, keys: list[str], least: float, more: list[str]) -> DataFrame:
    """The boxes that stay: keys, coordinates, __uid and `more` columns."""
    spark = boxes.sparkSession
    parts = max(1, min(PARTS, math.ceil(boxes.count() / PART)))
    order = [-F.col("score"), F.col("det_id"), F.col("__uid")]
    ranked = boxes.repartitionByRange(parts * SLICES, *order).sortWithinPartitions(*order)
    # ids grow from row to row and from partition to partition: the place in the ranking, and the part of it
    place = [F.monotonically_increasing_id().alias("det_id"), F.floor(F.spark_partition_id() / SLICES).alias("part")]
    box = [F.col(c) if boxes.schema[c].dataType.typeName() in ("double", "float") else F.col(c).cast("double").alias(c) for c in BOX]
    ranked = settled(ranked.select(*place, "__uid", *keys, *box, *[F.col(c).alias(f"__{c}") for c in more]), "ranked")
    last, levels = ranked.agg(F.max("part"), F.collect_set(_level())).first()
    parts = 1 + (last or 0)
    stay = spark.createDataFrame([], ranked.schema)
    at, step = 0, 1
    while at < parts:
        step = min(step, parts - at)
        batch = ranked.filter(F.col("part").between(at, at + step - 1))
        live = batch if at == 0 else settled(_untouched(batch, stay, keys, least, levels), "live")
        safe = _beaten(live, keys, least, levels)
        if safe is None and step > 1:
            step = max(1, step // GROWTH)
            continue
        safe = settled(_rounds(live, keys, least).select(ranked.columns), "stay") if safe is None else safe
        stay = safe if at == 0 else stay.union(safe)
        at, step = at + step, GROWTH * step
    return stay.select(*keys, *BOX, "__uid", *[F.col(f"__{c}").alias(c) for c in more])


def _level() -> F.Column:
    return F.floor(F.log2(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))))


def _tiles(boxes: DataFrame, least: float, levels: list[int], turn: int = 0, core: bool = False, span: float = SPAN) -> DataFrame:
    """A row for each box and tile that sees it, or only for the tile that tells it (that of its middle, in the box's own band),
    with `see`, what the tile knows. Bands are counted from the largest of `levels` down; those of the levels beside a band
    whose boxes may overlap one of it are its guests. Every other turn tiles lie half a tile further."""
    top, more = max(levels), math.ceil(math.log2(1 / least)) + 1
    used = sorted({(top - x) // LEVELS for x in levels})
    band = lambda by: F.floor((F.lit(top) - _level() + by) / LEVELS)
    rows = boxes.withColumn("own", band(0))
    if core or len(used) == 1:
        rows = rows.withColumn("band", F.col("own"))
    else:
        rows = rows.withColumn("band", F.explode(F.sequence(band(-more), band(more)))).filter(F.col("band").isin(used))
    side = F.pow(F.lit(2.0), F.lit(top + 1) - LEVELS * F.col("band"))
    # all of these grow with x, so whatever overlaps a box that ends within a tile's sight is seen there, however x is rounded
    tile = lambda x, by: F.floor((x / side + by) / span + turn % 2 / 2)
    tells, sure = F.col("band") == F.col("own"), F.col("band") == F.col("own")
    for t, low, high in (("tx", F.col("x1"), F.col("x2")), ("ty", F.col("y1"), F.col("y2"))):
        middle = tile(low + (high - low) / 2, 0)
        rows = rows.withColumn(t, middle if core else F.explode(F.sequence(tile(low, -HALO), tile(high, HALO))))
        tells &= F.col(t) == middle
        sure &= F.col(t).between(tile(high, -HALO), tile(low, HALO))
    see = F.when(tells, F.lit(CORE | SURE)).when(sure, F.lit(SURE)).otherwise(F.lit(0))
    return rows.select(*boxes.columns, *TILE, see.alias("see"))


def _most(tiles: DataFrame, keys: list[str]) -> int:
    return tiles.groupBy(*keys, *TILE).count().agg(F.max("count")).first()[0] or 0


def _by_tile(tiles: DataFrame, on: list[str], rows: int, f, schema: str) -> DataFrame:
    spark = tiles.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, rows // 250_000)
    return tiles.repartition(tasks, *on).groupBy(*on).applyInArrow(f, schema)


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema] + list(more))


def _untouched(boxes: DataFrame, stay: DataFrame, keys: list[str], least: float, levels: list[int]) -> DataFrame:
    """The boxes that none of those that stay overlaps. The boxes of a full tile are dealt to several tasks."""
    told, rows = _tiles(boxes, least, levels, core=True), boxes.count()
    shares = math.ceil(_most(told, keys) / EDGES) if rows > EDGES else 1
    fixed = _tiles(stay, least, levels).withColumn("see", F.lit(FIXED)).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    both = told.withColumn("share", F.pmod("det_id", F.lit(shares)).cast("int")).unionByName(fixed)
    names = boxes.columns

    def rest(table: pa.Table) -> pa.Table:
        see = table["see"].to_numpy()
        fixed, free = np.flatnonzero(see == FIXED), np.flatnonzero(see != FIXED)
        box, left = _sides(table), np.ones(len(free), bool)
        for _, j in _hits([x[fixed] for x in box], [x[free] for x in box], least):
            left[j] = False
        return table.select(names).take(pa.array(free[left]))

    return _by_tile(both, [*keys, *TILE, "share"], rows, rest, _schema(boxes))


def _beaten(live: DataFrame, keys: list[str], least: float, levels: list[int]) -> DataFrame | None:
    """The boxes (det_id is the place in the ranking) that stay once the beaten are out, those that a better one suppresses
    which stays; none if a tile has too many boxes.

    No look is in vain: the best of the boxes that are left to the next one is told there, as the tile that tells a box
    sees all that overlap it. From the third look on tiles grow, if they don't hold too much then, so that long chains end soon."""
    rows = live.count()
    if rows > EDGES and _most(_tiles(live, least, levels), keys) > EDGES:
        return None
    names, on, left, stay, turn, span = live.columns, [*keys, *TILE], live, None, 0, SPAN

    def decide(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["det_id"].to_numpy())))
        see = table["see"].to_numpy()
        state = _resolve(_sides(table), see, least)
        out = np.flatnonzero((see & CORE > 0) & (see & FIXED == 0) & (state < GONE))
        return table.select(names).take(pa.array(out)).append_column("open", pa.array(state[out] == OPEN))

    while True:
        tiles = _tiles(left, least, levels, turn, span=span)
        if stay is not None:
            told = _tiles(left, least, levels, turn, True, span).select(*on).distinct()
            tiles, fixed = [x.join(told, reduce(lambda a, b: a & b, [x[k].eqNullSafe(told[k]) for k in on]), "left_semi") for x in (tiles, _tiles(stay, least, levels, turn, span=span))]
            tiles = tiles.union(fixed.withColumn("see", F.lit(FIXED)))
        out = settled(_by_tile(tiles, on, rows, decide, _schema(live, "open boolean")), "told")
        safe, left = out.filter("NOT open").select(names), out.filter("open").select(names)
        stay, turn = safe if stay is None else stay.union(safe), turn + 1
        if left.isEmpty():
            return stay
        if turn > 1 and (rows <= EDGES or _most(_tiles(stay.union(left), least, levels, turn, span=GROWTH * span), keys) <= EDGES):
            span *= GROWTH


OPEN, STAYS, GONE = 0, 1, 2


def _sides(table: pa.Table) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in BOX]


def _hits(a: list[np.ndarray], b: list[np.ndarray], least: float):
    """Places in a and in b of boxes that overlap more than `least`, array by array. b's boxes are taken by size; each is looked
    up in one cell, that of its middle, from the cells where a partner's middle can lie."""
    if not len(a[0]) or not len(b[0]):
        return
    a64, b64 = [[x.astype(float, copy=False) for x in y] for y in (a, b)]
    sides = [[x[2] - x[0], x[3] - x[1]] for x in (a64, b64)]
    area = [(x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)]
    long = [np.maximum(*x) for x in sides]
    kind = np.floor(2 * np.log2(long[1]))
    for at in np.unique(kind):
        j = np.flatnonzero(kind == at)
        i = np.ones(len(long[0]), bool)
        for x, y in (long, area):  # what two share is no more than the smaller side or area, of at least the larger one's share
            i &= (x >= 0.999 * least * y[j].min()) & (x * (0.999 * least) <= y[j].max())
        i = np.flatnonzero(i)
        if not len(i):
            continue
        ranges, w = [], long[1][j].max() / 2
        for d in (0, 1):
            side, other = sides[0][d][i], sides[1][d][j]
            cell = np.floor((b64[d][j] + other / 2) / w)
            first, cells = cell.min(), int(np.ptp(cell)) + 1
            # middles are apart by half of both sides at most, less the share of the larger that both must cover
            near = 1.001 * other.max() / 2 - 0.999 * least * np.maximum(side, other.min())
            start, end = np.floor((a64[d][i] - near) / w) - first, np.floor((a64[d + 2][i] + near) / w) - first
            ranges.append(((cell - first).astype(np.int64), cells, np.clip(start, 0, cells).astype(np.int64), np.clip(end, -1, cells - 1).astype(np.int64)))
        (x, wide, x1, x2), (y, _, y1, y2) = ranges
        keys = y * wide + x
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        high = np.where(x1 > x2, 0, np.maximum(y2 - y1 + 1, 0))
        k = np.repeat(np.arange(len(i)), high)  # a row of cells each
        row = (y1[k] + np.arange(len(k)) - np.repeat(np.cumsum(high) - high, high)) * wide
        start, end = np.searchsorted(keys, row + x1[k]), np.searchsorted(keys, row + x2[k], "right")
        some = end > start
        k, start, n = i[k[some]], start[some], (end - start)[some]
        until = np.cumsum(n)
        cut = 0
        while cut < len(n):  # some candidates at a time
            to = max(cut + 1, int(np.searchsorted(until, (until[cut - 1] if cut else 0) + 1_000_000)))
            m = n[cut:to]
            p = np.repeat(k[cut:to], m)
            q = j[order[np.repeat(start[cut:to] - (np.cumsum(m) - m), m) + np.arange(m.sum())]]
            both = np.maximum(np.minimum(a[2][p], b[2][q]) - np.maximum(a[0][p], b[0][q]), 0.0) * np.maximum(np.minimum(a[3][p], b[3][q]) - np.maximum(a[1][p], b[1][q]), 0.0)
            with np.errstate(all="ignore"):
                hit = both / (area[0][p] + area[1][q] - both) > least
            yield p[hit], q[hit]
            cut = to


def _resolve(box: list[np.ndarray], see: np.ndarray, least: float) -> np.ndarray:
    """The state of each of a tile's boxes, which come best first: it stays if all better ones that overlap it are seen and
    gone, and is gone if one of them stays. Boxes are taken some at a time, so that few meet those that stay."""
    state = np.where(see & FIXED > 0, STAYS, OPEN)
    of = lambda places: [x[places] for x in box]
    stay, todo, wait = np.flatnonzero(state == STAYS), np.flatnonzero(state == OPEN), np.zeros(0, np.int64)
    at, step = 0, 1000
    while at < len(todo):
        some = todo[at : at + step]
        for _, j in _hits(of(stay), of(some), least):
            state[some[j]] = GONE
        nodes = np.concatenate([wait, some[state[some] == OPEN]])
        sure = see[nodes] & SURE > 0
        told = np.flatnonzero(sure)
        pairs, n = [], 0
        for i, j in _hits(of(nodes[told]), of(nodes), least):
            i = told[i]
            once = (i < j) | ((i > j) & ~sure[j])  # pairs of two that are not sure tell nothing
            pairs.append((np.minimum(i, j)[once], np.maximum(i, j)[once]))
            n += int(once.sum())
            if n > PAIRS and step > 100:
                break
        if n > PAIRS and step > 100:
            step = max(100, step // GROWTH)
            continue
        better, worse = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        state[nodes] = _ordered(sure, better, worse)
        stay, wait = np.concatenate([stay, nodes[state[nodes] == STAYS]]), nodes[state[nodes] == OPEN]
        at, step = at + step, GROWTH * step
    return state


def _ordered(sure: np.ndarray, better: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """States by the pairs that overlap: all at once what nothing open stands before, again and again, then what is left of
    long chains pair by pair."""
    state = np.full(len(sure), OPEN)
    for _ in range(20):
        free = (state == OPEN) & sure
        free[worse] = False
        if not free.any():
            return state
        state[free] = STAYS
        state[worse[free[better]]] = GONE
        open_ = (state[better] == OPEN) & (state[worse] == OPEN)
        better, worse = better[open_], worse[open_]
    gone, doubt = [False] * len(sure), (~sure).tolist()
    order = np.lexsort((better, worse))
    for a, b in zip(better[order].tolist(), worse[order].tolist()):  # all that could suppress a box come before it as the second of a pair
        if not gone[a]:
            (doubt if doubt[a] else gone)[b] = True
    return np.where(state != OPEN, state, np.where(gone, GONE, np.where(doubt, OPEN, STAYS)))


def _rounds(boxes: DataFrame, keys: list[str], least: float) -> DataFrame:
    """The boxes (det_id is the place in the ranking) that stay.

    In each round a box that nothing better overlaps can't be suppressed any more; it stays, and what it overlaps goes. In
    cells of up to FEW boxes that is looked up box by box; in fuller ones only the best box is known to stay (a guest: where
    it is better than the cell's own boxes), so a round compares each remaining box with FEW others at most and a crowd
    on one spot goes in one round. No round is empty: the best of all always stays. The rest is a table in the shared
    folder after each round; only whether it is empty reaches the driver.
    """
    live = settled(_entered(boxes.withColumn("rank", F.col("det_id")), keys, least, ["rank"]), "cells")
    stay: DataFrame | None = None
    while not live.isEmpty():
        heads = live.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("head"), F.min(F.when(F.col("own"), F.col("rank"))).alias("own_head"))
        leads = F.when(F.col("own"), F.col("rank") == F.col("head")).otherwise(F.col("own_head").isNull() | (F.col("rank") < F.col("own_head")))
        seen = live.join(heads, CELL).groupBy("rank").agg(F.bool_and((F.col("n") <= FEW) | leads).alias("leads"))
        few = live.join(heads.filter(F.col("n").between(2, FEW)).select(CELL), CELL, "left_semi")
        better = few.withColumnsRenamed({c: f"a_{c}" for c in (*BOX, "rank", "own")})
        beaten = better.join(few, CELL).filter((F.col("a_own") | F.col("own")) & (F.col("a_rank") < F.col("rank")) & (_shared() > least)).select("rank")
        safe = settled(seen.filter("leads").select("rank").join(beaten, "rank", "left_anti"), "safe")
        entered = live.join(safe, "rank", "left_semi").withColumnsRenamed({c: f"a_{c}" for c in (*BOX, "rank", "own")})
        out = [entered.filter(f).join(live.filter(t), CELL).filter((_shared() > least) & (F.col("a_rank") != F.col("rank"))).select("rank") for f, t in (("a_own", F.lit(True)), ("NOT a_own", F.col("own")))]
        gone = settled(out[0].union(out[1]).union(safe).distinct(), "gone")
        live = settled(live.join(gone, "rank", "left_anti"), "cells")
        stay = safe if stay is None else stay.union(safe)
    return boxes.limit(0) if stay is None else boxes.join(stay.select(F.col("rank").alias("det_id")), "det_id", "left_semi")
