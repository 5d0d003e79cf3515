"""Links between frames, ancestry, path covers, segments and runs.

Cells are rows with a cell_id; a link is a parent_id, null without one. Numbers
grow from frame to frame, so a child's number exceeds its parent's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motrac.sources.scratch import materialize


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def pairs_within(a: DataFrame, b: DataFrame, rmax: float, on: list[tuple[str, str]], coords: tuple[str, ...] = ("x", "y"), strict: bool = True) -> DataFrame:
    """Rows of a with rows of b at a distance under rmax that agree on the given columns.

    An equi join over a grid with spacing rmax: b stands in its own grid cell and
    a in the cells around it, so no pair is missed and none appears twice. b's
    columns are prefixed b_; d is the distance.
    """
    ga = a
    for c in coords:
        ga = ga.withColumn(f"_g{c}", F.explode(F.sequence(_cell(F.col(c), rmax) - 1, _cell(F.col(c), rmax) + 1)))
    gb = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], *[_cell(F.col(c), rmax).alias(f"_h{c}") for c in coords])
    cond = [F.col(f"_g{c}") == F.col(f"_h{c}") for c in coords] + [F.col(x) == F.col(f"b_{y}") for x, y in on]
    d = F.sqrt(sum(((F.col(c) - F.col(f"b_{c}")) * (F.col(c) - F.col(f"b_{c}")) for c in coords), F.lit(0.0)))
    out = ga.join(gb, cond).withColumn("d", d).drop(*[f"_g{c}" for c in coords], *[f"_h{c}" for c in coords])
    return out.where(F.col("d") < rmax) if strict else out.where(F.col("d") <= rmax)


def nearest_links(cells: DataFrame, distcut: float = 5.0, coords: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Each cell's nearest cell of the frame before, if nearer than distcut; ties go to the smaller number. Adds parent_id and d."""
    before = cells.select("cell_id", (F.col("frame") + 1).alias("frame"), *coords)
    near = pairs_within(cells, before, distcut, [("frame", "frame")], coords)
    best = near.groupBy("cell_id").agg(F.min(F.struct("d", F.col("b_cell_id").alias("id"))).alias("k"))
    return cells.drop("parent_id").join(best, "cell_id", "left").select(*[c for c in cells.columns if c != "parent_id"], F.col("k.id").alias("parent_id"), F.col("k.d").alias("d"))


def cap_children(links: DataFrame, most: int = 2) -> DataFrame:
    """Keeps the nearest children of each parent, at most so many; ties by number."""
    w = Window.partitionBy("parent_id").orderBy("d", "cell_id")
    return links.withColumn("_k", F.row_number().over(w)).where(F.col("parent_id").isNull() | (F.col("_k") <= most)).drop("_k")


def overlap_links(pixels: DataFrame, overlapcut: int = 0) -> DataFrame:
    """Each label's most overlapping label of the frame before, if over overlapcut pixels; ties go to the smaller label."""
    now = pixels.where("label > 0")
    before = now.select((F.col("frame") + 1).alias("frame"), "x", "y", F.col("label").alias("parent_label"))
    n = now.join(before, ["frame", "x", "y"]).groupBy("frame", "label", "parent_label").agg(F.count("*").alias("overlap"))
    w = Window.partitionBy("frame", "label").orderBy(F.desc("overlap"), "parent_label")
    return n.withColumn("_k", F.row_number().over(w)).where((F.col("_k") == 1) & (F.col("overlap") > overlapcut)).drop("_k")


def children_count(cells: DataFrame) -> DataFrame:
    n = cells.where("parent_id is not null").groupBy(F.col("parent_id").alias("cell_id")).agg(F.count("*").alias("n_children"))
    return cells.select("cell_id").join(n, "cell_id", "left").select("cell_id", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def parents(cells: DataFrame) -> DataFrame:
    p = cells.select(F.col("cell_id").alias("parent_id"), F.col("frame").alias("parent_frame"))
    return cells.select("cell_id", "frame", "parent_id").join(p, "parent_id").select("cell_id", "parent_id", (F.col("frame") - F.col("parent_frame")).alias("gap"))


def ancestors(cells: DataFrame, of: DataFrame, depth: int | None = None) -> DataFrame:
    """(cell_id, ancestor_id, back): the chain of parents of each given cell, itself at 0, at most depth steps.

    Pointer doubling: the table of 2^k-th parents is joined with itself and
    written each round, so a chain of n cells takes about log n rounds.
    """
    jump = cells.where("parent_id is not null").select("cell_id", "parent_id")
    reach = of.select("cell_id", F.col("cell_id").alias("ancestor_id"), F.lit(0).alias("back"))
    step = 1
    while depth is None or step <= depth:
        jump = materialize(jump, "jump")
        if not jump.head(1):
            break
        onward = jump.select(F.col("cell_id").alias("ancestor_id"), F.col("parent_id").alias("_p"))
        reach = reach.unionByName(reach.join(onward, "ancestor_id").select("cell_id", F.col("_p").alias("ancestor_id"), (F.col("back") + step).alias("back")))
        if depth is not None:
            reach = reach.where(F.col("back") <= depth)
        reach = materialize(reach, "reach")
        jump = jump.join(jump.select(F.col("cell_id").alias("parent_id"), F.col("parent_id").alias("_p")), "parent_id").select("cell_id", F.col("_p").alias("parent_id"))
        step *= 2
    return reach


def segments(cells: DataFrame, length: int, key: str = "traj_id") -> DataFrame:
    """Every window of length cells in a row along a trajectory: key, pos of the first, cell_ids."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(0, length - 1)
    return cells.withColumn("cell_ids", F.collect_list("cell_id").over(w)).where(F.size("cell_ids") == length).select(key, "pos", "cell_ids")


def steps(segs: DataFrame, nlag: int = 1, key: str = "traj_id") -> DataFrame:
    """Each segment with the one nlag positions later in its trajectory."""
    w = Window.partitionBy(key).orderBy("pos")
    return segs.withColumn("next_ids", F.lead("cell_ids", nlag).over(w)).where("next_ids is not null")


def ab_runs(series: DataFrame, a: int, b: int | None = None, include_direct: bool = False) -> DataFrame:
    """Half-open runs (traj_id, start, stop).

    With one state, the maximal runs of it. With two, what lies strictly between
    leaving a and entering b with neither between, one position more at each end;
    such runs that touch are one. A step from a to b at once has nothing between
    and counts only with include_direct.
    """
    w = Window.partitionBy("traj_id").orderBy("pos")
    if b is None:
        marked = series.withColumn("m", F.col("state") == a)
    else:
        edge = F.when(F.col("state").isin(a, b), F.col("state"))
        last = F.last(edge, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        later = F.first(edge, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        core = (last == a) & (later == b) & ~F.col("state").isin(a, b) & (F.col("pos") > 0)
        s = series.withColumn("core", F.coalesce(core, F.lit(False)))
        if include_direct:
            s = s.withColumn("direct", (F.col("state") == a) & (F.lead("state").over(w) == b))
        near = F.max(F.col("core").cast("int")).over(w.rowsBetween(-1, 1)) == 1
        marked = s.withColumn("m", near | (F.coalesce(F.col("direct") | F.lag("direct").over(w), F.lit(False)) if include_direct else F.lit(False)))
    marked = marked.withColumn("new", (F.col("m") & ~F.coalesce(F.lag("m").over(w), F.lit(False))).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("m")
    return marked.groupBy("traj_id", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop")).select("traj_id", "start", "stop")


def last_descendants(cells: DataFrame) -> DataFrame:
    """(cell_id, owner): the highest number among a cell and all its descendants, by pointer doubling.

    A round knows the highest within 2^k steps and hands it 2^k steps up, so a
    row a cell is written each round, whatever the depth.
    """
    jump = materialize(cells.where("parent_id is not null").select("cell_id", "parent_id"), "jump")
    best = cells.select("cell_id", F.col("cell_id").alias("owner"))
    while jump.head(1):
        sent = jump.join(best, "cell_id").groupBy(F.col("parent_id").alias("cell_id")).agg(F.max("owner").alias("_sent"))
        best = materialize(best.join(sent, "cell_id", "left").select("cell_id", F.greatest("owner", F.coalesce("_sent", "owner")).alias("owner")), "owners")
        jump = materialize(jump.join(jump.select(F.col("cell_id").alias("parent_id"), F.col("parent_id").alias("_p")), "parent_id").select("cell_id", F.col("_p").alias("parent_id")), "jump")
    return best


def unique_trajectories(cells: DataFrame, extra_depth: int = 0) -> DataFrame:
    """The greedy cover of a lineage: (owner, pos, cell_id).

    The greedy rule takes the highest uncovered cell and walks to the root up to
    what is covered. Numbers grow with frames, so a cell belongs to the highest of
    its descendants or itself, and a chain's cells stand in the order of their
    numbers; a chain has extra_depth more cells above it, where there are any.
    """
    owned = last_descendants(cells)
    up = cells.where("parent_id is not null").select("cell_id", "parent_id")
    out, top = owned, owned.groupBy("owner").agg(F.min("cell_id").alias("cell_id"))
    for _ in range(extra_depth):
        top = top.join(up, "cell_id").select("owner", F.col("parent_id").alias("cell_id"))
        out = out.unionByName(top)
    w = Window.partitionBy("owner").orderBy("cell_id")
    return out.select("owner", (F.row_number().over(w) - 1).alias("pos"), "cell_id")


def sandwich(cells: DataFrame, past: int = 1, future: int = 1) -> DataFrame:
    """(cell_id, related_id, offset): ancestors up to past steps back, all descendants up to future steps on."""
    up = ancestors(cells, cells, past).select("cell_id", F.col("ancestor_id").alias("related_id"), (-F.col("back")).alias("offset"))
    down = ancestors(cells, cells, future).where("back > 0").select(F.col("ancestor_id").alias("cell_id"), F.col("cell_id").alias("related_id"), F.col("back").alias("offset"))
    return up.unionByName(down)


def segment_lookup(series: DataFrame, segs: DataFrame, length: int, drop_last: bool = False) -> DataFrame:
    """Windows of each trajectory that are exactly one row of a segment table: traj_id, pos, seg_id."""
    wins = segments(series, length)
    if drop_last:
        wins = wins.where(F.lead("pos").over(Window.partitionBy("traj_id").orderBy("pos")).isNotNull())
    found = wins.join(segs.select("cell_ids", "seg_id"), "cell_ids")
    return found.withColumn("n", F.count("*").over(Window.partitionBy("traj_id", "pos"))).where("n = 1").select("traj_id", "pos", "seg_id")


def common_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of the columns that both tables have, in order; nulls count as equal."""
    return a.select(*columns).intersect(b.select(*columns)).orderBy(*columns)


def sequence_in(sub: Column, full: Column) -> Column:
    """Whether the array sub stands in full element by element, in one piece; an empty one does."""
    n = F.size(sub)
    starts = F.when(F.size(full) >= n, F.sequence(F.lit(1), F.size(full) - n + 1)).otherwise(F.array().cast("array<int>"))
    return (n == 0) | F.exists(starts, lambda i: F.slice(full, i, n) == sub)


def transport_links(cells: DataFrame, points: DataFrame, distcut: float, cost_cut: float | None = None) -> DataFrame:
    """Each cell's parent among the last frame's cells nearer than distcut: the one with the cheapest transport between borders.

    cells: frame, label, x, y. points: frame, label, px, py. One task at a time
    holds the borders of one candidate pair.
    """
    import numpy as np
    import pandas as pd

    from motrac.operators.boundary import transport

    before = cells.select((F.col("frame") + 1).alias("frame"), F.col("label").alias("parent_label"), "x", "y")
    near = pairs_within(cells.select("frame", "label", "x", "y"), before, distcut, [("frame", "frame")]).select("frame", "label", F.col("b_parent_label").alias("parent_label"))
    own = near.join(points, ["frame", "label"]).select("frame", "label", "parent_label", "px", "py", F.lit(0).alias("side"))
    other = near.join(points.select((F.col("frame") + 1).alias("frame"), F.col("label").alias("parent_label"), "px", "py"), ["frame", "parent_label"]).select("frame", "label", "parent_label", "px", "py", F.lit(1).alias("side"))

    def cost(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["side"] == s][["px", "py"]].to_numpy(float) for s in (0, 1))
        value = transport(a, b)[1] if len(a) and len(b) else np.inf
        return pdf[["frame", "label", "parent_label"]].iloc[:1].assign(cost=value)

    costs = own.unionByName(other).groupBy("frame", "label", "parent_label").applyInPandas(cost, "frame int, label int, parent_label int, cost double")
    if cost_cut is not None:
        costs = costs.where(F.col("cost") < cost_cut)
    best = costs.groupBy("frame", "label").agg(F.min(F.struct("cost", "parent_label")).alias("k"))
    return best.select("frame", "label", F.col("k.parent_label").alias("parent_label"), F.col("k.cost").alias("cost"))


def assignment_links(cells: DataFrame, distcut: float) -> DataFrame:
    """One-to-one links between following frames with the least summed distance, none over distcut: the constrained tracker.

    A frame pair is one group; its cells are as many as one picture holds.
    """
    import numpy as np
    import pandas as pd

    from motrac.operators.boundary import assignment

    now = cells.select("frame", "label", "x", "y", F.lit(0).alias("side"))
    pairs = now.unionByName(cells.select((F.col("frame") + 1).alias("frame"), "label", "x", "y", F.lit(1).alias("side")))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["side"] == s].sort_values("label") for s in (0, 1))
        if a.empty or b.empty:
            return pd.DataFrame({"frame": [], "label": [], "parent_label": [], "d": []}).astype({"frame": "int32", "label": "int32", "parent_label": "int32"})
        d = np.sqrt(((a[["x", "y"]].to_numpy()[:, None] - b[["x", "y"]].to_numpy()[None]) ** 2).sum(2))
        n = len(a) + len(b)
        cost = np.full((n, n), float(distcut))
        cost[: len(a), : len(b)] = np.where(d < distcut, d, 4 * distcut * n)
        cost[len(a) :, len(b) :] = 0
        to = assignment(cost)[: len(a)]
        ok = np.flatnonzero(to < len(b))
        ok = ok[d[ok, to[ok]] < distcut]
        return pd.DataFrame({"frame": a["frame"].to_numpy()[ok], "label": a["label"].to_numpy()[ok], "parent_label": b["label"].to_numpy()[to[ok]], "d": d[ok, to[ok]]})

    return pairs.groupBy("frame").applyInPandas(link, "frame int, label int, parent_label int, d double")
