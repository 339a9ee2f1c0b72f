"""Connected components and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from plumbline.operators.forests import contract
from plumbline.operators.graph import Graph, heavy_ends
from plumbline.operators.numbering import number_rows
from plumbline.plans.cutting import cut, stage
from plumbline.plans.skew import GROUP_LIMIT, HEAVY_KEY, heavy_among, if_any, lookup_join


#: Links that one task may contract at the end (16 bytes each).
ONE_TASK = 2_000_000


def undirected(edges: DataFrame, distinct: bool = True) -> DataFrame:
    """Distinct [child, parent] pairs with child > parent; self-loops removed."""
    pairs = edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("child"), F.least("src", "dst").alias("parent")
    )
    return pairs.distinct() if distinct else pairs


def connected_components(
    vertices: DataFrame, edges: DataFrame, group_limit: int = GROUP_LIMIT, one_task: int = ONE_TASK
) -> DataFrame:
    """[id, component], a component being named after its smallest id.

    Ids that are no whole numbers stand as 64-bit hashes, which are checked to be
    distinct, or else as numbers in their order. Every partition of the edges is
    contracted to a forest of stars where it lies, so only forest links are shuffled. What
    is then left is shrunk round by round (:func:`_shrunk`) until it has at most ``one_task``
    links, which one task contracts. Names come back in the end: the smallest id of a
    component, joined to its members.
    """
    if isinstance(edges.schema["src"].dataType, IntegralType):
        ids = vertices.select("id").distinct()
        links = _settled(edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")), group_limit, one_task)
        return ids.join(links, F.col("id") == F.col("child"), "left").select(
            "id", F.coalesce(F.col("parent").cast(vertices.schema["id"].dataType), "id").alias("component")
        )
    pairs = edges.where(F.col("src") != F.col("dst")).select("src", "dst")
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(False).alias("listed"))
    listed = vertices.select("id", F.lit(True).alias("listed")).unionByName(ends)
    names = stage(listed.groupBy("id").agg(F.bool_or("listed").alias("listed")).withColumn("number", _number("id")), "names")
    if names.groupBy("number").count().where("count > 1").isEmpty():
        numbers = pairs.select(_number("src").alias("src"), _number("dst").alias("dst"))
    else:
        names = stage(number_rows(names.drop("number"), ["id"], "number"), "names")
        numbers = pairs
        for end in ("src", "dst"):
            known = names.select(F.col("id").alias("of"), F.col("number").alias(f"{end}_number"))
            numbers = lookup_join(numbers, known, end, "of", limit=group_limit)
        numbers = numbers.select(F.col("src_number").alias("src"), F.col("dst_number").alias("dst"))
    links = _settled(numbers, group_limit, one_task)
    members = names.join(links, F.col("number") == F.col("child"), "left").select(
        "id", "listed", F.coalesce("parent", "number").alias("root")
    )
    return _named(members, links, group_limit).where("listed").select("id", F.coalesce("component", "id").alias("component"))


def _named(members: DataFrame, links: DataFrame, group_limit: int) -> DataFrame:
    """``members`` with the smallest id of their root; they are shuffled once, those of large components not at all."""
    smallest = F.min("id").over(Window.partitionBy("root"))
    heavy = if_any(cut(heavy_among(links.groupBy("parent").agg(F.count(F.lit(1)).alias("size")), "parent", "size", group_limit)))
    if heavy is None:
        return members.withColumn("component", smallest)
    marked = stage(members.join(F.broadcast(heavy), F.col("root") == F.col(HEAVY_KEY), "left").drop("_salts"), "members")
    crowded = marked.where(F.col(HEAVY_KEY).isNotNull())
    names = crowded.groupBy(F.col("root").alias("of")).agg(F.min("id").alias("component"))
    crowded = crowded.join(F.broadcast(names), F.col("root") == F.col("of")).drop("of")
    return marked.where(F.col(HEAVY_KEY).isNull()).withColumn("component", smallest).unionByName(crowded)


def _number(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.xxhash64(name))


def _settled(edges: DataFrame, group_limit: int, one_task: int) -> DataFrame:
    """[child, parent] of every id that is not its component's smallest, with that one.

    Rounds that shrink the graph go on while each takes a quarter of the links at least;
    should one take less, star rounds settle what is left.
    """
    links = stage(contract(undirected(edges, distinct=False)), "links")
    n, before, steps = links.count(), None, []
    while n > one_task and (before is None or 4 * n <= 3 * before):
        step, links = _shrunk(links, group_limit)
        steps.append(step)
        n, before = links.count(), n
    found = stage(contract(links.repartition(1)), "found") if n <= one_task else _star_rounds(cut(links.distinct()), group_limit)
    for step in reversed(steps):
        found = stage(_followed(step, found, group_limit), "found")
    return found


def _shrunk(links: DataFrame, group_limit: int) -> tuple[DataFrame, DataFrame]:
    """[child, low], every child's smallest parent, and the links between those.

    All ends move to their smallest parent, if they have one. Two ids are connected after
    that if and only if they were before, and a component's smallest id stays where it is, so a
    component that has come together leaves no links. Nobody's smallest parent is left
    out, so fewer ids remain each time, unlike in star rounds, which shuffle all of them to the end.
    """
    around = Window.partitionBy("child").orderBy("parent")
    ranked = links.select("child", "parent", F.first("parent").over(around).alias("low"), F.row_number().over(around).alias("rank"))
    ranked = stage(ranked.select("child", "parent", "low", (F.col("rank") == 1).alias("lowest")), "ranked")
    step = ranked.where("lowest").select("child", "low")
    lower = step.select(F.col("child").alias("of"), F.col("low").alias("to"))
    moved = lookup_join(ranked.select("low", "parent"), lower, "parent", "of", "left", limit=group_limit)
    ends = moved.select(F.col("low").alias("src"), F.coalesce("to", "parent").alias("dst"))
    return step, stage(contract(undirected(ends, distinct=False)), "links")


def _followed(step: DataFrame, found: DataFrame, group_limit: int) -> DataFrame:
    """[child, parent] before a step, from those found after it."""
    after = found.select(F.col("child").alias("of"), F.col("parent").alias("to"))
    moved = lookup_join(step, after, "low", "of", "left", limit=group_limit)
    # a smallest parent with no smaller one is in no step, but can have been linked to one later
    unmoved = found.join(step.select("child"), "child", "left_anti")
    return moved.select("child", F.coalesce("to", "low").alias("parent")).unionByName(unmoved)


def _star_rounds(links: DataFrame, group_limit: int) -> DataFrame:
    """Links that all point straight at the smallest id of their component.

    Alternates the large-star and small-star contractions of Kiveris et al.,
    "Connected Components in MapReduce and Beyond" (SoCC 2014), which takes O(log^2 n)
    rounds. Each round is cut once. Rounds go on until settled; one that changes nothing
    is an error.
    """
    before = None
    while True:
        # per vertex: its smallest neighbour and how many lie on either side
        around = (
            links.select(F.col("child").alias("at"), F.col("parent").alias("other"))
            .unionByName(links.select(F.col("parent").alias("at"), F.col("child").alias("other")))
            .groupBy("at")
            .agg(
                F.least(F.min("other"), F.col("at")).alias("low"),
                F.count_if(F.col("other") < F.col("at")).alias("below"),
                F.count_if(F.col("other") > F.col("at")).alias("above"),
            )
            .persist()
        )
        facts = around.agg(
            F.bool_or((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("above") > 0))).alias("unsettled"),
            F.max("above").alias("above"),
            F.max("below").alias("below"),
            F.bit_xor(F.xxhash64("at", "low", "below", "above")).alias("fingerprint"),
        ).first()
        if not facts["unsettled"]:
            around.unpersist()
            return links
        if facts["fingerprint"] == before:
            raise RuntimeError("a round of contraction changed nothing")
        before = facts["fingerprint"]
        heavy = heavy_among(around, "at", "above", group_limit) if facts["above"] > group_limit else None
        # re-pointing can merge a vertex's parents but never add one
        crowded = facts["below"] > group_limit
        links = cut(_small_star(_large_star(links, around, heavy), group_limit if crowded else None))
        around.unpersist()


def _large_star(links, around, heavy):
    """Re-point every larger neighbour of a vertex at the vertex's smallest neighbour."""
    shortcuts = around.where(F.col("low") < F.col("at")).select(F.col("at").alias("via"), "low")
    moved = lookup_join(links, shortcuts, "parent", "via", how="left", heavy=heavy)
    return moved.select("child", F.coalesce("low", "parent").alias("parent"))


def _small_star(links, group_limit):
    """Re-point a vertex and its smaller neighbours at the smallest of them."""
    lowest = links.groupBy(F.col("child").alias("via")).agg(
        F.min("parent").alias("low"), F.count(F.lit(1)).alias("parents")
    )
    heavy = None if group_limit is None else heavy_among(lowest, "via", "parents", group_limit)
    single = lowest.select(F.col("via").alias("child"), F.col("low").alias("parent"))
    several = lowest.where(F.col("parents") > 1).select("via", "low")
    siblings = (
        lookup_join(links, several, "child", "via", heavy=heavy)
        .where(F.col("parent") != F.col("low"))
        .select(F.col("parent").alias("child"), F.col("low").alias("parent"))
    )
    return single.unionByName(siblings).distinct()


def label_endpoints(
    edges: DataFrame, components: DataFrame, how: str = "inner", group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Edges with ``src_component`` and ``dst_component``; with ``how="left"`` null for unknown ids."""
    # both ends are measured on the edges as they came, not on the first join
    heavy = heavy_ends(edges, group_limit)
    for end in ("src", "dst"):
        named = components.select(F.col("id").alias("_member"), F.col("component").alias(f"{end}_component"))
        edges = lookup_join(edges, named, end, "_member", how=how, heavy=heavy[end])
    return edges


def cross_component_edges(
    edges: DataFrame, components: DataFrame, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """[src, dst, src_component, dst_component] of edges between components."""
    labelled = label_endpoints(edges.select("src", "dst"), components, group_limit=group_limit)
    return labelled.where("src_component <> dst_component")


def same_component(pairs: DataFrame, components: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Pairs [src, dst, ...] with a boolean ``same_component``, null if an id is in no component."""
    labelled = label_endpoints(pairs, components, how="left", group_limit=group_limit)
    return labelled.withColumn("same_component", F.col("src_component") == F.col("dst_component")).drop(
        "src_component", "dst_component"
    )


def pairs_across_components(pairs: DataFrame, components: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The pairs whose two ids are known to lie in different components."""
    return same_component(pairs, components, group_limit).where(~F.col("same_component")).drop("same_component")


def cycle_report(graph: Graph, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row: self_loops, links, vertices, components and ``has_cycle``.

    Edges count as undirected and parallel ones once. A forest has exactly
    vertices - components links, so one link more means a cycle; a self-loop is one.
    """
    links = undirected(graph.edges)
    components = connected_components(graph.vertices, graph.edges, group_limit=group_limit)
    facts = (
        components.agg(
            F.count(F.lit(1)).alias("vertices"),
            F.count_if(F.col("id") == F.col("component")).alias("components"),
        )
        .withColumn("links", links.agg(F.count(F.lit(1)).alias("n")).scalar())
        .withColumn("self_loops", graph.edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("n")).scalar())
    )
    tree_links = F.col("vertices") - F.col("components")
    return facts.select(
        "self_loops", "links", "vertices", "components",
        ((F.col("self_loops") > 0) | (F.col("links") > tree_links)).alias("has_cycle"),
    )


def has_cycle(graph: Graph, group_limit: int = GROUP_LIMIT) -> bool:
    """Whether the undirected graph has a cycle."""
    if not graph.edges.where(F.col("src") == F.col("dst")).isEmpty():
        return True
    return cycle_report(graph, group_limit).first()["has_cycle"]


def cycle_core(graph: Graph, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """[id] of the vertices left after peeling dead ends again and again.

    Every cycle lies inside the result, as do the paths between cycles. A self-loop
    keeps its vertex. A round removes whole chains: vertices with at most two links
    form paths, and a path with a dead end unravels from there. What becomes a dead end
    then had lost two chains or more, so the rounds grow with the logarithm of the size.
    """
    looped = cut(graph.edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("id")).distinct())
    links = cut(undirected(graph.edges))
    while True:
        ends = links.select(F.col("child").alias("at")).unionByName(links.select(F.col("parent").alias("at")))
        reach = cut(ends.groupBy("at").agg(F.count(F.lit(1)).alias("links")))
        thin = reach.where(F.col("links") <= 2).join(looped, F.col("at") == F.col("id"), "left_anti")
        tips = thin.where(F.col("links") == 1).select(F.col("at").alias("tip"))
        if tips.isEmpty():
            return reach.select(F.col("at").alias("id")).union(looped).distinct()
        thin = thin.select("at")
        chain = links.join(thin, F.col("child") == F.col("at"), "left_semi").join(thin, F.col("parent") == F.col("at"), "left_semi")
        paths = connected_components(
            thin.select(F.col("at").alias("id")), chain.select(F.col("child").alias("src"), F.col("parent").alias("dst")), group_limit
        )
        paths = cut(paths)
        open_ended = paths.join(tips, F.col("id") == F.col("tip"), "left_semi").select(F.col("component").alias("path")).distinct()
        gone = paths.join(open_ended, F.col("component") == F.col("path"), "left_semi").select("id")
        most = reach.agg(F.max("links")).first()[0]
        heavy = heavy_among(reach, "at", "links", group_limit) if most > group_limit else None
        links = cut(_without(links, gone, heavy))


def _without(links, gone, heavy):
    """Drop every link that ends in one of ``gone``."""
    for end in ("child", "parent"):
        marked = gone.select(F.col("id").alias("_gone"), F.lit(True).alias(f"{end}_gone"))
        links = lookup_join(links, marked, end, "_gone", how="left", heavy=heavy)
    return links.where(F.col("child_gone").isNull() & F.col("parent_gone").isNull()).select("child", "parent")
