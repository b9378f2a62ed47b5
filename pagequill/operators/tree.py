"""Crawl tree and authority tree for display: hierarchy on the cluster, emission of a bounded node budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequill.functions.scalars import flow_role, places, scale
from pagequill.functions.shared import discard, join_by_group, materialize, new_path, without
from pagequill.functions.urls import canonical, cluster_id, page_label
from pagequill.operators import linkgraph

# Display bounds.
MAX_NODES = 250
CRAWL_DEPTH, CRAWL_CHILDREN = 5, 12
AUTHORITY_DEPTH, AUTHORITY_CHILDREN = 3, 10
FOCUS_CHILDREN = 75
CROSS_PER_NODE, CROSS_TO_ROOT, CROSS_TOTAL = 2, 3, 120
NODE_SIZE, EDGE_WIDTH = (15, 60), (1, 10)


def home_page(metrics: DataFrame) -> str | None:
    """The least deep page, then the shortest URL, then the first."""
    row = metrics.orderBy(F.coalesce("depth", F.lit(0)), F.length("norm"), "ord").select("norm").first()
    return row and row[0]


def bfs_tree(metrics: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """(node, parent, level, rank): the first discoverer in queue order, then link order, over all reachable pages.

    A level is a join of the frontier with the edges and an anti-join with what is
    seen, of which a mark table leaves few rows open. rank is the queue position.
    Each level is written once, to a folder of its own, and what is seen is one
    scan of the folders so far.
    """
    known = metrics.select("norm")
    rows = linkgraph.internal_links(links).where("placement <> 'image' and s <> t")
    rows = rows.join(known.withColumnRenamed("norm", "s"), "s", "left_semi").join(known.withColumnRenamed("norm", "t"), "t", "left_semi")
    adj = materialize(rows.groupBy("s", "t").agg(F.min("ord").alias("o")), "bfs-edges")
    spark = metrics.sparkSession
    root_row = spark.createDataFrame([(root, None, 0, 0)], "node string, parent string, level int, rank long")
    paths = [new_path(spark, "bfs-level")]
    root_row.write.parquet(paths[0])
    read = lambda ps: spark.read.schema(root_row.schema).parquet(*ps)
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1024)  # so that a level's numbers fit in 2^44
    while True:
        found = adj.join(read(paths[-1:]).select(F.col("node").alias("s"), "rank"), "s")
        best = without(found.groupBy("t").agg(F.min(F.struct("rank", "o", "s")).alias("b")), "t", read(paths).select(F.col("node").alias("t")))
        # Queue positions: a range sort by (parent's rank, link order), numbered per partition.
        ordered = best.select("t", "b.*").repartitionByRange(parts, "rank", "o").sortWithinPartitions("rank", "o")
        new = ordered.select(F.col("t").alias("node"), F.col("s").alias("parent"), F.lit(len(paths)).alias("level"), (F.monotonically_increasing_id() + len(paths) * (1 << 44)).alias("rank"))
        path = new_path(spark, "bfs-level")
        new.write.parquet(path)
        if read([path]).isEmpty():
            return read(paths)
        paths.append(path)


def authority_parents(flow: DataFrame, root: str) -> DataFrame:
    """(node, parent, flow): the strongest source of each page but the root, ties (to nine places) to the first edge."""
    rows = flow.where((F.col("flow") > 0) & (F.col("t") != root))
    best = rows.groupBy("t").agg(F.max(F.struct(places(F.col("flow"), 9).alias("f"), (-F.col("ord")).alias("o"), F.col("s"), F.col("flow"))).alias("b"))
    return best.select(F.col("t").alias("node"), F.col("b.s").alias("parent"), places(F.col("b.flow"), 2).alias("flow"))


def reachable(children: DataFrame, root: str) -> DataFrame:
    """Nodes that chains of parents connect to the root; the root itself is one. A node has one parent at most.

    Pointer doubling: each round, a node's pointer becomes its target's pointer,
    so a chain of length n takes log2(n) rounds. Nodes whose pointer is the root
    are done; those that point to a node without a parent never get there, nor do
    cycles, which are what is left once pointers have spanned all nodes. A node
    that many point to is one row that is joined to them in pieces.
    """
    up = materialize(children.where(F.col("node") != root).groupBy("node").agg(F.min("parent").alias("to")), "tree-pointers")
    total, span = up.count(), 1
    arrived, on_the_way = F.col("to") == root, F.col("to") != root
    while span <= total and not up.where(on_the_way).isEmpty():
        asked = up.where(on_the_way).groupBy("to").agg(F.count("*").alias("n"))
        jumps = asked.join(up.select(F.col("node").alias("to"), F.col("to").alias("next")), "to")
        ahead = join_by_group(up.where(on_the_way), jumps, "to", "n", total).where(F.col("next").isNotNull()).select("node", F.col("next").alias("to"))
        before, up = up, materialize(up.where(arrived).unionByName(ahead), "tree-pointers")
        discard(before)
        span *= 2
    return children.sparkSession.createDataFrame([(root,)], "node string").unionByName(up.where(arrived).select("node"))


def cross_flow(flow: DataFrame, shown: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """(s, t, flow): the strongest further flows between shown pages."""
    rows = flow.where("flow > 0").join(shown.withColumnRenamed("node", "s"), "s", "left_semi").join(shown.withColumnRenamed("node", "t"), "t", "left_semi").join(existing, ["s", "t"], "left_anti")
    w = Window.partitionBy("t").orderBy(F.desc("flow"), F.desc("s"))
    cap = F.when(F.col("t") == root, CROSS_TO_ROOT).otherwise(CROSS_PER_NODE)
    rows = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap)
    return rows.orderBy(F.desc("flow"), F.desc("s"), F.desc("t")).limit(CROSS_TOTAL).select("s", "t", F.round("flow", 2).alias("flow"))


def page_nodes(metrics: DataFrame, flow: DataFrame) -> DataFrame:
    """Display columns of each page."""
    rows = metrics.join(linkgraph.node_flows(flow), "norm", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.select(
        F.col("norm").alias("id"), page_label(F.col("norm")).alias("label"), "url", F.col("authority_score").alias("authority"), "status_code", "depth",
        cluster_id(F.col("norm")).alias("cluster"), "is_orphan", places(zero("inflow"), 1).alias("inflow"), places(zero("outflow"), 1).alias("outflow"),
        F.coalesce("in_pages", F.lit(0)).alias("in_pages"), F.coalesce("out_pages", F.lit(0)).alias("out_pages"),
        flow_role(zero("inflow"), zero("outflow")).alias("flow_role"), scale(F.col("authority_score"), F.lit(100.0), *NODE_SIZE).alias("size"),
    )


@dataclass
class Graph:
    mode: str
    nodes: list[dict]
    edges: list[dict]
    clusters: list[dict]


def _emit(root: str, kids: DataFrame, depth_cap: int, child_cap: int, root_cap: int) -> tuple[list, list]:
    """Breadth-first emission. Each level asks the cluster for the ranked children of the shown nodes only,
    at most root_cap each, so the driver holds a few hundred rows."""
    nodes, edges, level = [(root, "page", 0, None)], [], [root]
    for depth in range(depth_cap + 1):
        if not level or len(nodes) >= MAX_NODES:
            break
        mine = kids.where(F.col("parent").isin(level))
        w = Window.partitionBy("parent").orderBy("k")
        rows = mine.withColumn("i", F.row_number().over(w)).where(F.col("i") <= max(child_cap, root_cap)).collect()
        counts = {r["parent"]: r["n"] for r in mine.groupBy("parent").agg(F.count("*").alias("n")).collect()}
        by: dict = {}
        for r in sorted(rows, key=lambda r: r["i"]):
            by.setdefault(r["parent"], []).append(r)
        after: list[str] = []
        for u in level:
            if len(nodes) >= MAX_NODES:
                break
            if not counts.get(u):
                continue
            if depth >= depth_cap:
                nodes.append((f"more:{u}", "group", depth + 1, f"+{counts[u]} deeper"))
                edges.append((u, f"more:{u}", None))
                continue
            shown = by[u][: min(root_cap if u == root else child_cap, MAX_NODES - len(nodes))]
            for r in shown:
                nodes.append((r["node"], "page", depth + 1, None))
                edges.append((u, r["node"], r["flow"]))
                after.append(r["node"])
            if counts[u] > len(shown):
                nodes.append((f"more:{u}", "group", depth + 1, f"+{counts[u] - len(shown)} more"))
                edges.append((u, f"more:{u}", None))
        level = after
    return nodes, edges


def build_graph(pages: DataFrame, links: DataFrame, mode: str = "crawltree", focus: str | None = None, cluster_rows: int | None = None) -> Graph:
    """Nodes and edges for display, and all clusters (or cluster_rows of them). An unknown focus raises ValueError."""
    from pagequill.operators.clusters import detect_clusters

    found = detect_clusters(pages).limit(cluster_rows) if cluster_rows is not None else detect_clusters(pages)
    meta = [{"cluster_id": r["cluster_id"], "name": r["name"], "page_count": r["size"], "color_index": i} for i, r in enumerate(found.toLocalIterator())]
    pages, links = linkgraph.site_graph(pages, links)
    weighted = materialize(linkgraph.edges(pages, links), "graph-edges")
    metrics = materialize(linkgraph.page_metrics(pages, links, weighted), "graph-metrics")
    if metrics.isEmpty():
        return Graph(mode, [], [], meta)
    root = canonical(focus, True) if focus else home_page(metrics)
    if metrics.where(F.col("norm") == root).isEmpty():
        raise ValueError(f"Unknown page: {focus}")
    flow = materialize(linkgraph.flows(weighted, metrics), "graph-flow")
    if mode == "authority":
        parents = materialize(authority_parents(flow, root), "graph-parents")
        kids = parents.select("node", "parent", "flow", F.struct((-F.col("flow")).alias("f"), F.col("node").alias("o")).alias("k"))
        unreached = metrics.count() - reachable(parents, root).count()
        nodes, edges = _emit(root, kids, AUTHORITY_DEPTH, AUTHORITY_CHILDREN, FOCUS_CHILDREN if focus else AUTHORITY_CHILDREN)
        note = "pages receive their authority from elsewhere"
    else:
        tree = bfs_tree(metrics, links, root)
        kids = tree.where("parent is not null").join(metrics.select(F.col("norm").alias("node"), "authority_score"), "node")
        kids = materialize(kids.select("node", "parent", F.lit(None).cast("double").alias("flow"), F.struct((-F.col("authority_score")).alias("a"), F.col("rank").alias("o")).alias("k")), "graph-kids")
        unreached = metrics.count() - tree.count()
        nodes, edges = _emit(root, kids, CRAWL_DEPTH, CRAWL_CHILDREN, FOCUS_CHILDREN if focus else CRAWL_CHILDREN)
        note = "pages not linked from root"
    shown = [n[0] for n in nodes if n[1] == "page"]
    facts = {r["id"]: r.asDict() for r in page_nodes(metrics.where(F.col("norm").isin(shown)), flow).collect()}
    out = [facts.get(n, {"id": n, "label": label}) | {"type": kind, "tree_depth": depth, "is_root": n == root} for n, kind, depth, label in nodes]
    lines = [{"source": s, "target": t, "flow": f, "cross": False} for s, t, f in edges]
    if mode == "authority":
        spark = pages.sparkSession
        at = spark.createDataFrame([(n,) for n in shown], "node string")
        has = spark.createDataFrame([(s, t) for s, t, _ in edges] or [("", "")], "s string, t string")
        lines += [{"source": r["s"], "target": r["t"], "flow": r["flow"], "cross": True} for r in cross_flow(flow, at, has, root).collect()]
    if unreached and not focus:
        out.append({"id": "unlinked", "type": "group", "label": f"{unreached} {note}", "tree_depth": 1, "is_root": False})
        lines.append({"source": root, "target": "unlinked", "flow": None, "cross": False})
    top = max((e["flow"] or 0 for e in lines), default=0)
    for e in lines:
        share = (min(max((e["flow"] or 0) / top, 0), 1) ** 0.5) if top > 0 else 0
        e["width"] = round(EDGE_WIDTH[0] + (EDGE_WIDTH[1] - EDGE_WIDTH[0]) * share, 1) if e["flow"] is not None else 1
    return Graph(mode, out, lines, meta)
