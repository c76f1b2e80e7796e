"""Unrooted binary trees as edge tables.

Leaves are 0..n-1, internal nodes n..2n-3, edges (u, v) with u < v. Work that
depends on depth runs by pointer doubling over an Euler tour: the number of
rounds grows with the logarithm of the tree, not with its depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.ordering import running_total, running_totals
from cladeframe.session import cut_apart as cut, empty


def directed(edges: DataFrame) -> DataFrame:
    """Both directions (src, dst) of every edge."""
    return edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("src"), F.col("v").alias("dst")),
        F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("_e")).select("_e.*")


def neighbors(edges: DataFrame) -> DataFrame:
    """(node, near): sorted neighbours, at most three in a binary tree."""
    return directed(edges).groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("near"))


def degree_report(edges: DataFrame, leaves: int) -> DataFrame:
    """One row of counts that a binary tree must satisfy."""
    degree = directed(edges).groupBy("src").agg(F.count("*").alias("rows"), F.countDistinct("dst").alias("degree"))
    leaf = F.col("src") < leaves
    nodes = degree.agg(
        F.count("*").alias("nodes"),
        F.count(F.when(leaf & (F.col("degree") == 1), 1)).alias("good_leaves"),
        F.count(F.when(~leaf & (F.col("degree") == 3), 1)).alias("good_internal"),
        F.sum(F.col("rows") - F.col("degree")).alias("repeated"))
    count = edges.agg(F.count("*").alias("edges"), F.count(F.when(F.col("u") >= F.col("v"), 1)).alias("unordered"))
    return nodes.crossJoin(count)  # one row by one row


def component_count(edges: DataFrame) -> int:
    """Number of connected components, by minimum labels and pointer jumping."""
    both = cut(directed(edges))
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")))
    while True:
        label = labels.select(F.col("node").alias("dst"), F.col("label").alias("near"))
        # Hook every current label to the smallest label seen across its members' edges.
        seen = both.join(label, "dst").groupBy(F.col("src").alias("node")).agg(F.min("near").alias("near"))
        hooked = labels.join(seen, "node", "left").groupBy("label").agg(
            F.least(F.first("label"), F.min("near")).alias("target"))
        hooks = cut(hooked.select(F.col("label"), F.col("target")))
        while True:
            jump = hooks.select(F.col("label").alias("target"), F.col("target").alias("_next"))
            jumped = cut(hooks.join(jump, "target", "left").select(
                "label", F.coalesce("_next", "target").alias("target"), (F.col("_next") < F.col("target")).alias("_moved")))
            moved = not empty(jumped.where("_moved"))
            hooks = jumped.drop("_moved")
            if not moved:
                break
        if empty(hooks.where("target < label")):
            return labels.select("label").distinct().count()
        labels = cut(labels.join(hooks, "label").select("node", F.col("target").alias("label")))


def validate(edges: DataFrame, leaves: int) -> DataFrame:
    """The degree report; raises unless the table is one unrooted binary tree."""
    report = degree_report(edges, leaves)
    row = report.first()
    good = (row.good_leaves == leaves and row.good_internal == leaves - 2 and row.nodes == 2 * leaves - 2
            and row.edges == 2 * leaves - 3 and row.repeated == 0 and row.unordered == 0)
    if not good or component_count(edges) != 1:
        raise ValueError(f"not an unrooted binary tree of {leaves} leaves: {row.asDict()}")
    return report


def euler_tour(edges: DataFrame, root: int = 0) -> DataFrame:
    """(src, dst, at): the walk around the tree from leaf ``root``, at = 0, 1, ...

    The step after (u, v) leaves v to the neighbour that follows u in cyclic
    order. Distances to the end of the walk come from pointer doubling.
    """
    near = neighbors(edges)
    steps = near.select("node", "near", F.posexplode("near").alias("i", "src"))
    following = F.element_at("near", (F.col("i") + 1) % F.size("near") + 1)
    links = steps.select("src", F.col("node").alias("dst"), following.alias("to"))
    # The walk ends on the way back into the root.
    last = F.col("dst") == root
    state = cut(links.select(
        "src", "dst", F.when(~last, F.col("dst")).alias("nsrc"), F.when(~last, F.col("to")).alias("ndst"),
        F.when(last, 0).otherwise(1).cast("long").alias("left")))
    total = 2 * edges.count()
    reach = 1
    while reach < total:
        # Three lookups in the same table reach four times as far.
        ahead = state.select(F.col("src").alias("nsrc"), F.col("dst").alias("ndst"),
                             F.col("nsrc").alias("_ns"), F.col("ndst").alias("_nd"), F.col("left").alias("_l"))
        jumped = state
        for _ in range(3):
            jumped = jumped.join(ahead, ["nsrc", "ndst"], "left").select(
                "src", "dst", F.col("_ns").alias("nsrc"), F.col("_nd").alias("ndst"),
                (F.col("left") + F.coalesce("_l", F.lit(0))).alias("left"))
        state, reach = cut(jumped), reach * 4
    return state.select("src", "dst", (F.lit(total - 1) - F.col("left")).alias("at"))


def rooted(edges: DataFrame, leaves: int, root: int = 0, tour: DataFrame | None = None) -> DataFrame:
    """(node, parent, depth, enter, leave, tips) seen from leaf ``root``.

    ``enter`` and ``leave`` are tour steps into and out of the subtree of a
    node, ``tips`` the number of leaves below it. The root has no parent.
    """
    tour = cut(euler_tour(edges, root) if tour is None else tour)
    back = tour.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("at").alias("back"))
    steps = cut(tour.join(back, ["src", "dst"]).withColumn("down", F.col("at") < F.col("back")))
    tips = cut(running_totals(steps, "at", {
        "depth": F.when(F.col("down"), 1).otherwise(-1),
        "tip_run": F.when(F.col("down") & (F.col("dst") < leaves), 1).otherwise(0)}))
    end = tips.select(F.col("at").alias("back"), F.col("tip_run").alias("tip_end"))
    below = tips.where("down").join(end, "back").select(
        F.col("dst").alias("node"), F.col("src").alias("parent"), "depth", F.col("at").alias("enter"),
        F.col("back").alias("leave"),
        (F.col("tip_end") - F.col("tip_run") + F.when(F.col("dst") < leaves, 1).otherwise(0)).alias("tips"))
    top = edges.sparkSession.createDataFrame(
        [(root, None, 0, -1, 2 * (2 * leaves - 3), leaves)],
        "node long, parent long, depth long, enter long, leave long, tips long")
    return below.unionByName(top)


def split_members(nodes: DataFrame, leaves: int) -> DataFrame:
    """(node, leaf): leaves below every node that separates an inner split.

    Leaves sit on the tour, subtrees are intervals of it; each interval is
    listed for the tour blocks it touches.
    """
    block = 1024
    inner = nodes.where(F.col("tips").between(2, leaves - 2)).select(
        "node", "enter", "leave",
        F.explode(F.sequence(F.floor(F.col("enter") / block), F.floor(F.col("leave") / block))).alias("_b"))
    tips = nodes.where((F.col("node") < leaves) & (F.col("enter") >= 0)).select(
        F.col("node").alias("leaf"), F.col("enter").alias("_at"), F.floor(F.col("enter") / block).alias("_b"))
    return inner.join(tips, "_b").where(F.col("_at").between(F.col("enter"), F.col("leave"))).select("node", "leaf")


def split_keys(nodes: DataFrame, names: DataFrame, leaves: int) -> DataFrame:
    """(node, side, h1, h2): canonical identity of every inner split.

    Two sums of 40-bit name digests are accumulated along the tour, so no leaf
    lists are built. The side without the root represents the split; all trees over
    the same leaves must be rooted at the same name.
    """
    tips = nodes.where("enter >= 0").join(names, "node", "left")
    digest = F.md5(F.col("name").cast("binary"))
    masked = [F.coalesce(F.conv(F.substring(digest, at, 10), 16, 10).cast("long"), F.lit(0).cast("long"))
              for at in (1, 11)]
    rows = tips.select("node", "enter", "leave", "tips", masked[0].alias("_h1"), masked[1].alias("_h2"))
    rows = cut(running_totals(rows, "enter", {"run1": "_h1", "run2": "_h2"}))
    # A node of ``tips`` leaves spans 2 * tips - 1 nodes; its last entered node closes the interval.
    last = rows.select(F.col("enter").alias("_last"), F.col("run1").alias("end1"), F.col("run2").alias("end2"))
    spans = cut(_last_entered(rows))
    return (
        rows.join(spans, "node").join(last, "_last").where(F.col("tips").between(2, leaves - 2))
        .select("node", F.col("tips").alias("side"), (F.col("end1") - F.col("run1") + F.col("_h1")).alias("h1"),
                (F.col("end2") - F.col("run2") + F.col("_h2")).alias("h2"))
    )


def _last_entered(rows: DataFrame) -> DataFrame:
    """Last tour step that enters a node inside each subtree.

    The walk out of a subtree is preceded by upward steps only; the deepest
    entered node before ``leave`` is a leaf and the steps back up are the
    difference of depths, found by the running count of entries.
    """
    ranked = running_total(rows.select("node", "enter", "leave", "tips"), "enter", F.lit(1), "number")
    ranked = cut(ranked)
    by_number = ranked.select(F.col("number").alias("_n"), F.col("enter").alias("_last"))
    return ranked.withColumn("_n", F.col("number") + 2 * F.col("tips") - 2).join(by_number, "_n").select("node", "_last")


def compare_splits(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: split counts, shared splits, RF and normalised RF."""
    key = ["side", "h1", "h2"]
    joined = first.select(*key, F.lit(1).alias("_a")).join(second.select(*key, F.lit(1).alias("_b")), key, "full")
    sizes = joined.agg(F.count("_a").alias("splits_a"), F.count("_b").alias("splits_b"),
                       F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("shared"))
    total = F.col("splits_a") + F.col("splits_b")
    return sizes.withColumn("rf", total - 2 * F.col("shared")).withColumn(
        "nrf", F.when(total > 0, F.col("rf") / total).otherwise(F.lit(0.0)))


# Two primes below 2^40 and 2^22 that spread split sums over 62 bits.
SPREAD_PRIME, SPREAD = 1099511627689, (4194301, 2097143)


def topology_key(splits: DataFrame) -> DataFrame:
    """One row that identifies a topology: count, exclusive or and sum of its mixed splits."""
    mix = (F.col("h1") % SPREAD_PRIME * SPREAD[0]).bitwiseXOR(F.col("h2") % SPREAD_PRIME * SPREAD[1] + F.col("side"))
    return splits.agg(F.count("*").alias("splits"), F.bit_xor(mix).alias("mix"),
                      F.sum(mix.bitwiseAND(F.lit((1 << 40) - 1))).alias("total"))


def frames(edges: DataFrame, leaves: int) -> DataFrame:
    """(u, v, a, b, c, d): inner edges with a < b beyond u and c < d beyond v."""
    near = neighbors(edges)
    inner = edges.select("u", "v").where((F.col("u") >= leaves) & (F.col("v") >= leaves))
    u = near.select(F.col("node").alias("u"), F.col("near").alias("_nu"))
    v = near.select(F.col("node").alias("v"), F.col("near").alias("_nv"))
    left = F.array_remove("_nu", F.col("v"))
    right = F.array_remove("_nv", F.col("u"))
    return inner.join(u, "u").join(v, "v").select(
        "u", "v", left[0].alias("a"), left[1].alias("b"), right[0].alias("c"), right[1].alias("d"))


def nearest_leaves(edges: DataFrame, leaves: int, k: int) -> DataFrame:
    """(src, dst, near): the ``k`` leaves beyond src -> dst closest to dst.

    ``near`` holds (d, leaf) in order; d counts edges from dst. A list grows
    from the two lists one edge further until nothing changes. The k-th
    nearest leaf of a binary tree is close, so few rounds are needed.
    """
    both = directed(edges)
    around = neighbors(edges)
    onward = both.join(around.select(F.col("node").alias("dst"), F.col("near").alias("_n")), "dst").select(
        "src", "dst", F.array_remove("_n", F.col("src")).alias("_on"))
    links = cut(onward.select("src", "dst", F.get("_on", F.lit(0)).alias("x"), F.get("_on", F.lit(1)).alias("y")))
    start = F.when(F.col("dst") < leaves, F.array(F.struct(F.lit(0).alias("d"), F.col("dst").cast("long").alias("leaf"))))
    none = F.expr("cast(array() as array<struct<d:int,leaf:bigint>>)")
    state = links.select("src", "dst", F.coalesce(start, none).alias("near"))
    while True:
        one = state.select(F.col("src").alias("dst"), F.col("dst").alias("x"), F.col("near").alias("_x"))
        two = state.select(F.col("src").alias("dst"), F.col("dst").alias("y"), F.col("near").alias("_y"))
        grown = F.expr("transform(concat(coalesce(_x, _none), coalesce(_y, _none)), "
                       "s -> named_struct('d', s.d + 1, 'leaf', s.leaf))")
        after = links.join(one, ["dst", "x"], "left").join(two, ["dst", "y"], "left").withColumn("_none", none).select(
            "src", "dst", F.when(F.col("dst") < leaves, F.coalesce(start, none)).otherwise(
                F.slice(F.array_sort(grown), 1, k)).alias("near"))
        after = cut(after.join(state.select("src", "dst", F.col("near").alias("_before")), ["src", "dst"]).select(
            "src", "dst", "near", (F.col("near") != F.col("_before")).alias("_moved")))
        state = after.select("src", "dst", "near")
        if empty(after.where("_moved")):
            return state


def frame_lists(frame: DataFrame, nearest: DataFrame) -> DataFrame:
    """Frames with the nearest leaves of their four groups as la, lb, lc, ld."""
    for end, letters in (("u", "ab"), ("v", "cd")):
        for x in letters:
            frame = frame.join(nearest.select(
                F.col("src").alias(end), F.col("dst").alias(x), F.col("near").alias(f"l{x}")), [end, x])
    return frame


def explode_lists(frame: DataFrame) -> DataFrame:
    """One row per choice of one leaf from each group: (u, v, x0, x1, x2, x3)."""
    rows = frame
    for i, x in enumerate("abcd"):
        rows = rows.withColumn(f"x{i}", F.explode(f"l{x}")).withColumn(f"x{i}", F.col(f"x{i}.leaf"))
    return rows.select("u", "v", "a", "b", "c", "d", "x0", "x1", "x2", "x3")


def round_robin_panel(frame: DataFrame, size: int) -> DataFrame:
    """Trim the four lists so that ``size`` leaves are taken in turns by rank.

    A list offers its r-th leaf in turn r; groups take turns in order a, b,
    c, d. The r-th leaf of group g is number sum(min(r, len)) + earlier
    groups with a leaf of that rank.
    """
    lists = [F.col(f"l{x}") for x in "abcd"]

    def kept(g: int) -> Column:
        def number(i: Column) -> Column:
            place = F.lit(1)
            for other, items in enumerate(lists):
                turns = F.least(i + (1 if other < g else 0), F.size(items)) if other != g else i
                place = place + turns
            return place

        return F.filter(lists[g], lambda item, i: number(i) <= size)

    return frame.select(*[c for c in frame.columns if c not in ("la", "lb", "lc", "ld")],
                        *[kept(g).alias(f"l{x}") for g, x in enumerate("abcd")])


def beyond_counts(edges: DataFrame, leaves: int, marked: DataFrame) -> DataFrame:
    """(src, dst, marked): marked leaves beyond every directed edge."""
    nodes = cut(rooted(edges, leaves))
    flag = marked.select(F.col("leaf").alias("node"), F.lit(1).cast("long").alias("_m")).distinct()
    rows = nodes.where("enter >= 0").join(flag, "node", "left").na.fill(0, ["_m"])
    runs = cut(running_total(rows, "enter", "_m", "run"))
    last = runs.select(F.col("enter").alias("_last"), F.col("run").alias("_end"))
    below = cut(runs.join(_last_entered(runs), "node").join(last, "_last").select(
        "node", "parent", (F.col("_end") - F.col("run") + F.col("_m")).alias("n")))
    total = marked.select("leaf").distinct().count()
    down = below.select(F.col("parent").alias("src"), F.col("node").alias("dst"), F.col("n").alias("marked"))
    up = below.select(F.col("node").alias("src"), F.col("parent").alias("dst"), (F.lit(total) - F.col("n")).alias("marked"))
    return down.unionByName(up)


def anchored_frames(frame: DataFrame, beyond: DataFrame) -> DataFrame:
    """(u, v, allowed): an interchange is vetoed when all four groups hold anchors."""
    rows = frame
    for end, letters in (("u", "ab"), ("v", "cd")):
        for x in letters:
            rows = rows.join(beyond.select(F.col("src").alias(end), F.col("dst").alias(x),
                                           F.col("marked").alias(f"_m{x}")), [end, x])
    return rows.select("u", "v", (F.least("_ma", "_mb", "_mc", "_md") == 0).alias("allowed"))


def subdivide(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Attach one leaf to each listed edge: (u, v, leaf, center)."""
    kept = edges.select("u", "v").join(targets.select("u", "v"), ["u", "v"], "left_anti")
    center = F.col("center")
    new = targets.select(F.explode(F.array(*[
        F.struct(F.least(F.col(x), center).alias("u"), F.greatest(F.col(x), center).alias("v"))
        for x in ("u", "v", "leaf")])).alias("_e")).select("_e.*")
    return kept.unionByName(new)


def induced(edges: DataFrame, leaves: int, keep: DataFrame) -> DataFrame:
    """Subtree of the kept leaves with degree-two nodes suppressed.

    Each kept subtree hangs from its nearest kept or branching ancestor: nodes
    whose kept leaves all lie below one child are passed over by doubling.
    """
    nodes = cut(rooted(edges, leaves))
    flagged = nodes.join(keep.select(F.col("leaf").alias("node"), F.lit(1).alias("_kept")), "node", "left")
    runs = running_total(flagged.where("enter >= 0"), "enter", F.coalesce("_kept", F.lit(0)), "run")
    runs = cut(runs)
    spans = cut(_last_entered(runs))
    last = runs.select(F.col("enter").alias("_last"), F.col("run").alias("_end"))
    counts = cut(runs.join(spans, "node").join(last, "_last").select(
        "node", "parent", (F.col("_end") - F.col("run") + F.coalesce("_kept", F.lit(0))).alias("kept")))
    alive = counts.where("kept > 0")
    single = alive.select("node", F.col("kept").alias("_k"), F.col("parent"))
    # A node is passed over when one child carries all its kept leaves and it is no kept leaf.
    above = single.select(F.col("node").alias("parent"), F.col("_k").alias("_pk"))
    linked = single.join(above, "parent", "left").withColumn("_skip", F.col("_k") == F.col("_pk"))
    state = cut(linked.select("node", F.col("parent").alias("up"), F.coalesce("_skip", F.lit(False)).alias("open")))
    chain = cut(state)
    while not empty(chain.where("open")):
        ahead = chain.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("open").alias("_open"))
        chain = cut(chain.join(ahead, "up", "left").select(
            "node", F.when(F.col("open"), F.col("_up")).otherwise(F.col("up")).alias("up"),
            F.when(F.col("open"), F.coalesce("_open", F.lit(False))).otherwise(F.lit(False)).alias("open")))
    passed = state.where("open").select(F.col("up").alias("node"))
    root_kept = not empty(keep.where("leaf = 0"))
    tops = chain.join(passed.distinct(), "node", "left_anti").where("up is not null")
    pairs = tops.select("node", "up")
    if not root_kept:
        # Without the root leaf the topmost branching node has degree two: join its two children.
        total = keep.select("leaf").distinct().count()
        head = alive.where(F.col("kept") == total).join(passed.distinct(), "node", "left_anti").select("node")
        two = pairs.join(head.withColumnRenamed("node", "up"), "up", "left_semi")
        bridge = two.agg(F.min("node").alias("node"), F.max("node").alias("up"))
        pairs = pairs.join(head, "node", "left_anti").join(
            head.withColumnRenamed("node", "up"), "up", "left_anti").select("node", "up").unionByName(bridge.select("node", "up"))
    return pairs.select(F.least("node", "up").alias("u"), F.greatest("node", "up").alias("v"))
