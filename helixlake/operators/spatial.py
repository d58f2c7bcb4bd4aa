"""Single-cell and spatial statistics over cells (cell, cluster, v, x, y) and their long form (cell, cluster, gene, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import mathx as m
from helixlake.session import cut

#: Cluster connectivities from which a walk goes on, an edge is drawn, and a neighbour counts as strong.
WALK, EDGE, STRONG = 0.1, 0.15, 0.3
FATES = ["productive", "stressed", "quiescent"]


def qc_flags(cells: DataFrame, mito: float = 20.0, min_counts: int = 500, min_genes: int = 200) -> DataFrame:
    """Adds ``qc_pass`` to (mito_percent, total_counts, n_genes): mito strictly below, the others at least."""
    return cells.withColumn("qc_pass", (F.col("mito_percent") < mito) & (F.col("total_counts") >= min_counts) & (F.col("n_genes") >= min_genes))


def qc_summary(cells: DataFrame, mito: float = 20.0, min_counts: int = 500, min_genes: int = 200) -> DataFrame:
    """One row: totals, and medians over the passing cells (0 if none passes)."""
    own = lambda c: F.coalesce(F.median(F.when(F.col("qc_pass"), F.col(c))), F.lit(0.0))
    return qc_flags(cells, mito, min_counts, min_genes).agg(
        F.count("*").alias("total_cells"), F.count_if("qc_pass").alias("passed_cells"), F.count_if(~F.col("qc_pass")).alias("filtered_cells"),
        own("total_counts").alias("median_counts"), own("n_genes").alias("median_genes"), own("mito_percent").alias("median_mito"),
    )


def qc_or_all(cells: DataFrame, **thresholds) -> DataFrame:
    """The passing cells, or all of them with ``qc_fallback`` true if none passes."""
    flags = qc_flags(cells, **thresholds)
    any_pass = flags.agg(F.count_if("qc_pass").alias("passed"))
    return flags.crossJoin(F.broadcast(any_pass)).where("qc_pass OR passed = 0").withColumn("qc_fallback", F.col("passed") == 0).drop("passed")


def cell_totals(counts: DataFrame, mito: Column | None = None) -> DataFrame:
    """(cell, total_counts, n_genes, mito_percent) of a count matrix (cell, gene, count); mitochondrial genes start with MT-."""
    is_mito = F.upper(F.col("gene").cast("string")).startswith("MT-") if mito is None else mito
    g = counts.groupBy("cell").agg(F.sum("count").alias("total_counts"), F.count_if(F.col("count") > 0).alias("n_genes"), F.sum(F.when(is_mito, F.col("count")).otherwise(0)).alias("mito"))
    return g.select("cell", "total_counts", "n_genes", m.js_round(m.ratio(F.col("mito") * 100.0, "total_counts"), 2).alias("mito_percent"))


def normalize_log1p(counts: DataFrame, target: float = 10_000.0) -> DataFrame:
    """ln(1 + count * target / cell total); a total of 0 counts as 1."""
    total = counts.groupBy("cell").agg(F.sum("count").alias("total"))
    return counts.join(total, "cell").select("cell", "gene", F.log(1 + F.col("count") * (F.lit(target) / F.when(F.col("total") == 0, 1).otherwise(F.col("total")))).alias("value"))


def gene_stats(expression: DataFrame) -> DataFrame:
    """(gene, mean, variance) over all cells; a cell without the gene counts as 0, the variance is the population's."""
    n = expression.agg(F.count_distinct("cell").alias("n"))
    s = expression.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")).crossJoin(F.broadcast(n))
    mean = F.col("s") / F.col("n")
    return s.select("gene", mean.alias("mean"), F.when(F.col("n") > 1, F.col("ss") / F.col("n") - mean * mean).otherwise(0.0).alias("variance"))


def hvg(expression: DataFrame, n_top: int) -> DataFrame:
    """Variable genes: variance over the mean variance of the genes nearby by mean (5 % or 5 on each side); ``rank`` by that.

    The trend is one window over the genes, a table of the size of the genome.
    """
    stats = gene_stats(expression)
    half = max(5, stats.count() // 20)
    by_mean = Window.orderBy("mean", "gene")
    trend = F.avg("variance").over(by_mean.rowsBetween(-half, half))
    out = stats.withColumn("variance_norm", F.col("variance") / F.greatest(trend, F.lit(1e-12))).withColumn("mean_rank", F.row_number().over(by_mean))
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance_norm"), "mean_rank")))
    return out.withColumn("is_hvg", F.col("rank") <= n_top)


def knn(points: DataFrame, k: int = 6, key: str = "cell", x: str = "x", y: str = "y") -> DataFrame:
    """(i, j, d, rank): the k nearest other points of each, ties to the smaller key.

    Exact, over a grid: a round compares a point with the nine squares around it and is final where the
    k-th neighbour is no farther than a square is wide; for the rest the squares are doubled. Points in
    the same place are one place, of which the k + 1 smallest keys can be anyone's neighbours.
    """
    own = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    numbered = own.withColumn("n", F.row_number().over(Window.partitionBy("x", "y").orderBy("key")))
    held = cut(numbered.where(F.col("n") <= k + 1).drop("n"))
    box = own.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not box.n:
        return own.select(F.col("key").alias("i"), F.col("key").alias("j"), F.col("x").alias("d"), F.lit(0).alias("rank"))
    extent = max(box.x1 - box.x0, box.y1 - box.y0) or 1.0
    side = extent / max(1.0, (box.n / (k + 1)) ** 0.5)
    left, done = own, None
    while True:
        square = lambda c, low: F.floor((F.col(c) - low) / side)  # noqa: B023, E731
        cand = held.select(F.col("key").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), square("x", box.x0).alias("sx"), square("y", box.y0).alias("sy"))
        near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        ask = left.select("key", "x", "y", F.explode(near).alias("o")).select("key", "x", "y", (square("x", box.x0) + F.col("o.a")).alias("sx"), (square("y", box.y0) + F.col("o.b")).alias("sy"))
        d = F.sqrt((F.col("x") - F.col("xj")) * (F.col("x") - F.col("xj")) + (F.col("y") - F.col("yj")) * (F.col("y") - F.col("yj")))
        pairs = ask.join(cand, ["sx", "sy"]).where("key <> j").select("key", "j", d.alias("d"))
        best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("d", "j"))).where(F.col("rank") <= k)
        whole = side > extent
        best = cut(best)
        ok = best.groupBy("key").agg(F.count("*").alias("n"), F.max("d").alias("far")).where(F.lit(whole) | ((F.col("n") == k) & (F.col("far") <= side)))
        final = best.join(ok.select("key"), "key", "left_semi").select(F.col("key").alias("i"), "j", "d", "rank")
        done = final if done is None else done.union(final)
        if whole:
            return done
        left = cut(left.join(ok, "key", "left_anti"))
        if left.isEmpty():
            return done
        side *= 2


def expression_knn(cells: DataFrame, k: int = 15, block: int = 512, most: int = 16384, blocks: int = 8) -> DataFrame:
    """(i, j, d, rank): the k nearest other cells in the whole gene space, ties to the smaller id. Exact.

    Every cell meets every other: cells are dealt into about ``blocks`` blocks, of ``block`` to ``most`` cells each, and a task
    compares two of them. A cell is sent to a task for each pair of its block, so what is shuffled grows with the number of
    blocks, not with the cells that a cell is compared with; a task hands over k candidates of each cell.
    """
    import numpy as np
    import pandas as pd

    n = cells.count()
    if not n:
        return cells.select(F.col("cell").alias("i"), F.col("cell").alias("j"), F.lit(0.0).alias("d"), F.lit(1).alias("rank"))
    size = min(most, max(block, -(-n // blocks)))
    parts = -(-n // size)
    kind = cells.schema["cell"].dataType.simpleString()
    own = cut(cells.select("cell", "v", F.pmod(F.xxhash64("cell"), F.lit(parts)).cast("int").alias("b")))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"i": [], "j": [], "d": []})
        a, b, keys, ids, rows = np.stack(left["v"].to_numpy()), np.stack(right["w"].to_numpy()), left["cell"].to_numpy(), right["to"].to_numpy(), []
        a2, b2 = (a * a).sum(1), (b * b).sum(1)
        for at in range(0, len(a), 256):
            x, x2 = a[at : at + 256], a2[at : at + 256]
            rough = x2[:, None] + b2 - 2 * (x @ b.T)
            slack = 1e-11 * (x2 + b2.max()) + 1e-300  # over what the product loses by rounding; the distances themselves are worked out below
            bound = np.partition(rough, k, axis=1)[:, k] if len(b) > k + 1 else np.full(len(x), np.inf)  # one more, as the cell itself may be there
            maybe = rough <= (bound + 2 * slack)[:, None]
            maybe |= ~np.isfinite(rough)
            r, c = np.nonzero(maybe)
            d = np.sqrt(((b[c] - x[r]) ** 2).sum(1))
            good = ids[c] != keys[at + r]
            r, c, d = r[good], c[good], d[good]
            order = np.lexsort((ids[c], d, r))
            r, c, d = r[order], c[order], d[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            rows.append((keys[at + r[first]], ids[c[first]], d[first]))
        i, j, d = (np.concatenate(c) for c in zip(*rows))
        return pd.DataFrame({"i": i, "j": j, "d": d})

    ask = own.select("cell", "v", "b", every.alias("hb"))
    held = own.select(F.col("cell").alias("to"), F.col("v").alias("w"), F.col("b").alias("hb"), every.alias("b"))
    found = ask.groupBy("b", "hb").cogroup(held.groupBy("b", "hb")).applyInPandas(compare, f"i {kind}, j {kind}, d double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)


def average_neighbors(cells: DataFrame, edges: DataFrame) -> DataFrame:
    return cells.agg(F.count("*").alias("n_cells")).crossJoin(edges.agg(F.count("*").alias("n_edges"))).select("n_cells", "n_edges", m.js_round(m.ratio("n_edges", "n_cells"), 2).alias("avg_neighbors"))


def morans_i(expression: DataFrame, edges: DataFrame) -> DataFrame:
    """Moran's I per gene over directed neighbour edges (i, j), with expectation, z and p; restricted if p < 0.05 and I > 0.2."""
    g = expression.groupBy("gene").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    x = expression.join(g, "gene").select("cell", "gene", "n", (F.col("value") - F.col("mean")).alias("z"))
    den = x.groupBy("gene").agg(F.sum(F.col("z") * F.col("z")).alias("den"), F.first("n").alias("n"))
    a = x.select(F.col("cell").alias("i"), "gene", F.col("z").alias("zi"))
    b = x.select(F.col("cell").alias("j"), "gene", F.col("z").alias("zj"))
    num = edges.select("i", "j").join(a, "i").join(b, ["j", "gene"]).groupBy("gene").agg(F.sum(F.col("zi") * F.col("zj")).alias("num"))
    degree = edges.groupBy("i").count()
    w = degree.agg(F.sum("count").alias("w"), F.sum(F.pow(F.col("count") * 2.0, F.lit(2.0))).alias("s2"))
    t = den.join(num, "gene", "left").crossJoin(F.broadcast(w))
    n, w_, s2 = F.col("n").cast("double"), F.coalesce("w", F.lit(0)).cast("double"), F.coalesce("s2", F.lit(0.0))
    flat = F.col("den") == 0
    i = F.when(flat | (w_ == 0), 0.0).otherwise(n / w_ * F.col("num") / F.col("den"))
    expected = F.when(n > 1, F.try_divide(F.lit(-1.0), n - 1)).otherwise(0.0)
    w2 = F.when(w_ == 0, 1.0).otherwise(w_ * w_)
    under = w2 * (n * n - 1)
    var = (n * n * 2 * w_ - n * s2 + 3 * w2) / F.when(under == 0, 1.0).otherwise(under) - expected * expected
    z = F.when(flat, 0.0).otherwise((i - expected) / F.sqrt(F.greatest(var, F.lit(1e-12))))
    out = t.select("gene", i.alias("moran_i"), expected.alias("expected_i"), z.alias("z"), F.when(flat, 1.0).otherwise(m.two_tailed_p(z)).alias("p"))
    return out.withColumn("restricted", (F.col("p") < 0.05) & (F.col("moran_i") > 0.2))


def hotspots(moran: DataFrame, n: int = 12) -> DataFrame:
    return moran.orderBy(F.desc("moran_i"), "gene").limit(n)


def neighbor_purity(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of neighbour edges within a cluster."""
    c = cells.select("cell", "cluster")
    both = edges.join(c.withColumnsRenamed({"cell": "i", "cluster": "ci"}), "i").join(c.withColumnsRenamed({"cell": "j", "cluster": "cj"}), "j")
    return both.agg(F.coalesce(F.avg((F.col("ci") == F.col("cj")).cast("double")), F.lit(0.0)).alias("purity"))


def modularity(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Newman's Q of the clusters over the undirected edges."""
    e = edges.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    c = cells.select("cell", "cluster")
    both = e.join(c.withColumnsRenamed({"cell": "a", "cluster": "ca"}), "a").join(c.withColumnsRenamed({"cell": "b", "cluster": "cb"}), "b")
    total = both.agg(F.count("*").alias("m"), F.count_if(F.col("ca") == F.col("cb")).alias("inner"))
    degree = both.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").count().agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("dd"))
    return total.crossJoin(degree).select((m.ratio("inner", "m") - m.ratio("dd", F.col("m") * 4.0 * F.col("m"))).alias("modularity"))


def cluster_sizes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cluster").agg(F.count("*").alias("size"))


def centroids(expression: DataFrame) -> DataFrame:
    """(cluster, gene, mean), a cell without a gene counting as 0."""
    n = expression.groupBy("cluster").agg(F.count_distinct("cell").alias("n"))
    return expression.groupBy("cluster", "gene").agg(F.sum("value").alias("s")).join(n, "cluster").select("cluster", "gene", (F.col("s") / F.col("n")).alias("mean"))


def paga_edges(expression: DataFrame) -> DataFrame:
    """Connectivity of every pair of clusters (a < b): 1 - distance of centroids / the largest one; ``drawn`` above 0.15."""
    c = centroids(expression)
    d = c.alias("p").join(c.alias("q"), (F.col("p.gene") == F.col("q.gene")) & (F.col("p.cluster") < F.col("q.cluster")))
    d = d.groupBy(F.col("p.cluster").alias("a"), F.col("q.cluster").alias("b")).agg(F.sqrt(F.sum(F.pow(F.col("p.mean") - F.col("q.mean"), F.lit(2.0)))).alias("d"))
    far = d.agg(F.max("d").alias("far"))
    w = 1 - F.col("d") / F.when(F.col("far") == 0, 1.0).otherwise(F.col("far"))
    return d.crossJoin(F.broadcast(far)).select("a", "b", w.alias("weight")).withColumn("drawn", F.col("weight") > EDGE)


def pseudotime(sizes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, pseudotime) in 0..1: a breadth-first walk from the largest cluster along connectivities of at least 0.1.

    One small group per dataset (clusters by clusters), in a grouped function, as a walk is sequential.
    """
    import pandas as pd

    nodes = sizes.select(F.lit(1).alias("one"), F.col("cluster").alias("a"), F.col("cluster").alias("b"), F.col("size").cast("double").alias("w"), F.lit(True).alias("node"))
    links = edges.select(F.lit(1).alias("one"), "a", "b", F.col("weight").alias("w"), F.lit(False).alias("node"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.node].sort_values("a")
        w = {}
        for a, b, x in pdf.loc[~pdf.node, ["a", "b", "w"]].itertuples(index=False):
            w[a, b] = w[b, a] = x
        root = own.sort_values(["w", "a"], ascending=[False, True]).a.iloc[0]
        time, order = {root: 0.0}, [root]
        for at in order:
            for to in own.a:
                if to not in time and w.get((at, to), 0.0) >= WALK:
                    time[to] = time[at] + 1 - w[at, to]
                    order.append(to)
        out = [time.get(a, float(len(own))) for a in own.a]
        far = max(out)
        return pd.DataFrame({"cluster": own.a, "pseudotime": [t / far if far > 0 else t for t in out]})

    kind = sizes.schema["cluster"].dataType.simpleString()
    return nodes.unionByName(links).groupBy("one").applyInPandas(walk, f"cluster {kind}, pseudotime double")


def branching(edges: DataFrame, times: DataFrame) -> DataFrame:
    """(cluster, child, fate, divergence): clusters with two strong neighbours or more, of which two or more come later."""
    strong = edges.where(F.col("weight") > STRONG)
    both = strong.select(F.col("a").alias("cluster"), F.col("b").alias("child")).union(strong.select("b", "a"))
    t = times.select("cluster", "pseudotime")
    j = both.join(t, "cluster").join(t.withColumnsRenamed({"cluster": "child", "pseudotime": "later"}), "child").where("later > pseudotime")
    w = Window.partitionBy("cluster")
    n, total = F.count("*").over(w), times.agg(F.count("*").alias("clusters"))
    fate = F.try_element_at(F.array(*map(F.lit, FATES)), ((F.row_number().over(w.orderBy("child")) - 1) % 3 + 1).cast("int"))
    j = j.crossJoin(F.broadcast(total)).withColumns({"n": n, "fate": fate}).where("n >= 2")
    return j.select("cluster", "child", "fate", F.least(F.lit(1.0), F.col("n") / F.col("clusters") + 0.3).alias("divergence"))


def trajectory_layout(times: DataFrame) -> DataFrame:
    """(cluster, x, y): time to the right, clusters spread evenly upwards."""
    n = times.agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy("cluster")) - 1
    return times.crossJoin(F.broadcast(n)).select("cluster", F.col("pseudotime").alias("x"), m.ratio(place, F.col("n") - 1).alias("y"))


def centroid_silhouette(cells: DataFrame, expression: DataFrame) -> DataFrame:
    """Mean over cells of (b - a) / max(a, b, 1e-6) with the distances to the own and the nearest other centroid."""
    c = centroids(expression).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("gene", "mean"))).alias("g")).select(F.col("cluster").alias("to"), F.transform("g", lambda x: x["mean"]).alias("centre"))
    d = cells.crossJoin(F.broadcast(c)).select("cell", "cluster", "to", m.distance(F.col("v"), F.col("centre")).alias("d"))  # a row per cluster on the small side
    s = d.groupBy("cell").agg(F.min(F.when(F.col("to") == F.col("cluster"), F.col("d"))).alias("a"), F.min(F.when(F.col("to") != F.col("cluster"), F.col("d"))).alias("b"))
    value = F.when(F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-6)))
    return s.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"))


def marker_genes(expression: DataFrame, k: int = 5) -> DataFrame:
    """(cluster, gene, mean_expression, pct_expressed, rank): the k largest mean x share of expressing cells."""
    n = expression.groupBy("cluster").agg(F.count_distinct("cell").alias("n"))
    g = expression.groupBy("cluster", "gene").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("e")).join(n, "cluster")
    g = g.select("cluster", "gene", (F.col("s") / F.col("n")).alias("mean"), (F.col("e") / F.col("n") * 100).alias("pct"))
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.col("mean") * F.col("pct")), "gene"))).where(F.col("rank") <= k)
    return g.select("cluster", "gene", m.js_round("mean", 3).alias("mean_expression"), m.js_round("pct", 1).alias("pct_expressed"), "rank")


def high_yield(sizes: DataFrame, times: DataFrame, branches: DataFrame, markers: DataFrame, restricted: DataFrame) -> DataFrame:
    """Clusters by productivity: efficiency 1 - pseudotime times the share of cells; fate by efficiency, else by branch."""
    total = sizes.agg(F.sum("size").alias("total"))
    fates = branches.groupBy(F.col("child").alias("cluster")).agg(F.max_by("fate", "cluster").alias("branch_fate"))
    local = markers.join(restricted.where("restricted").select("gene"), "gene", "left_semi").select("cluster").distinct().withColumn("localized", F.lit(True))
    t = sizes.join(times, "cluster").crossJoin(F.broadcast(total)).join(fates, "cluster", "left").join(local, "cluster", "left")
    e = 1 - F.col("pseudotime")
    fate = F.when(e > 0.6, "productive").when(e < 0.3, "stressed").otherwise(F.coalesce("branch_fate", F.lit("quiescent")))
    return t.select("cluster", "size", m.js_round(e, 3).alias("efficiency"), m.js_round(e * F.col("size") / F.col("total"), 3).alias("productivity"), fate.alias("fate"), F.coalesce("localized", F.lit(False)).alias("localized"))


def cluster_summary(cells: DataFrame, expression: DataFrame, gene) -> DataFrame:
    """(cluster, size, mean_gene): mean of one gene per cluster, a missing value counting as 0."""
    g = expression.where(F.col("gene") == gene).groupBy("cluster").agg(F.sum("value").alias("s"))
    return cluster_sizes(cells).join(g, "cluster", "left").select("cluster", "size", (F.coalesce("s", F.lit(0.0)) / F.col("size")).alias("mean_gene"))


def coexpression(expression: DataFrame, gene, k: int = 6) -> DataFrame:
    """(gene, r): the k genes with the largest absolute correlation with ``gene`` over all cells."""
    own = expression.where(F.col("gene") == gene).select("cell", F.col("value").alias("x"))
    s = expression.where(F.col("gene") != gene).join(own, "cell").groupBy("gene").agg(
        F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("value").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("value") * F.col("value")).alias("syy"), F.sum(F.col("x") * F.col("value")).alias("sxy"),
    )
    c = s.select("gene", m.pearson(*(F.col(q) for q in ("n", "sx", "sy", "sxx", "syy", "sxy"))).alias("r"))
    return c.orderBy(F.desc(F.abs("r")), "gene").limit(k)


def view_points(cells: DataFrame, mode: str, cluster=None) -> DataFrame:
    """(cell, x, y, z, selected): coordinates by view mode (spatial, or the first three of the embedding), of one cluster if named."""
    at = lambda i: F.try_element_at("v", F.lit(i))
    xyz = (F.col("x"), F.col("y"), F.lit(None).cast("double")) if mode == "spatial" else (at(1), at(2), at(3))
    own = cells if cluster is None else cells.where(F.col("cluster") == cluster)
    return own.select("cell", xyz[0].alias("x"), xyz[1].alias("y"), xyz[2].alias("z"), (F.lit(cluster is not None)).alias("selected"))


def selected_cluster(cells: DataFrame, wanted) -> DataFrame:
    """The wanted cluster if it exists, else the one of the first cell."""
    return cells.agg(F.coalesce(F.max(F.when(F.col("cluster") == wanted, F.col("cluster"))), F.min_by("cluster", "cell")).alias("cluster"))


def gene_maps(rows: DataFrame, genes: list[str]) -> DataFrame:
    """Sparse rows (cell, indices, values) as maps gene -> value; indices out of range are skipped."""
    names = F.array(*map(F.lit, genes))
    pairs = F.filter(F.arrays_zip("indices", "values"), lambda p: (p["indices"] >= 0) & (p["indices"] < len(genes)))
    return rows.select("cell", F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.try_element_at(names, (p["indices"] + 1).cast("int")), p["values"]))).alias("expression"))


def cluster_ordinals(obs: DataFrame) -> DataFrame:
    """Labels (ord, label) as numbers from 0 by first appearance; blank labels go to 0 if any label is there."""
    clean = obs.withColumn("label", F.nullif(F.trim("label"), F.lit("")))
    first = clean.where("label IS NOT NULL").groupBy("label").agg(F.min("ord").alias("first"))
    numbered = first.withColumn("cluster", F.row_number().over(Window.orderBy("first")) - 1).drop("first")  # a row per label
    return clean.join(numbered, "label", "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))


def runtime_views(has_places: Column, has_embedding: Column, has_clusters: Column) -> Column:
    """Which views of a dataset there are, by name; the table always is."""
    own = {"spatial-2d": has_places, "spatial-3d": has_places, "umap": has_embedding, "trajectory": has_clusters, "table": F.lit(True)}
    return F.create_map(*[x for name, there in own.items() for x in (F.lit(name), F.coalesce(there, F.lit(False)))])


def query_response(cells: DataFrame, gene: int, requested: str = "spatial-2d", k: int = 6) -> DataFrame:
    """One row an artifact out of one scan of its cells (artifact, cell, cluster, v, x, y): sizes, selection, cluster summaries, coexpressed genes, views.

    The scan makes a row of sums for every artifact, cluster and gene; all parts are made of these. ``cluster_summaries`` are by
    size, the largest first, and the first of them is selected; ``coexpression`` are the ``k`` genes that correlate most with ``gene``.
    """
    from helixlake.operators.agent import view_mode
    from helixlake.session import cut

    value = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    placed = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    each = cells.select("artifact", "cluster", (placed("x") & placed("y")).alias("placed"), value(F.get("v", F.lit(gene))).alias("own"), F.posexplode("v").alias("gene", "raw")).withColumn("value", value(F.col("raw")))
    sums = cut(each.groupBy("artifact", "cluster", "gene").agg(F.count("*").alias("n"), F.count_if("placed").alias("placed"), F.sum("own").alias("sx"), F.sum("value").alias("sy"), F.sum(F.col("own") * F.col("own")).alias("sxx"), F.sum(F.col("value") * F.col("value")).alias("syy"), F.sum(F.col("own") * F.col("value")).alias("sxy")))
    by_cluster = sums.groupBy("artifact", "cluster").agg(F.max("n").alias("size"), F.max("placed").alias("placed"), F.max_by("sx", "n").alias("s"))
    summary = F.struct(F.negate("size").alias("o"), "cluster", "size", (F.col("s") / F.col("size")).alias("mean"))
    heads = by_cluster.groupBy("artifact").agg(F.sum("size").alias("n_cells"), F.sum("placed").alias("n_placed"), F.count("cluster").alias("n_clusters"), F.array_sort(F.collect_list(summary)).alias("c"))  # clusters of one dataset
    moments = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    genes = sums.groupBy("artifact", "gene").agg(*[F.sum(c).cast("double").alias(c) for c in moments])
    r = genes.select("artifact", "gene", m.pearson(*(F.col(c) for c in moments)).alias("r"))
    ranked = r.where(F.col("gene") != gene).withColumn("rank", F.row_number().over(Window.partitionBy("artifact").orderBy(F.desc(F.abs("r")), "gene"))).where(F.col("rank") <= k)
    close = ranked.groupBy("artifact").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gene", "r"))), lambda x: F.struct(x["gene"].alias("gene"), x["r"].alias("r"))).alias("coexpression"))  # k rows
    views = runtime_views(F.col("n_placed") > 0, F.lit(False), F.col("n_clusters") > 0)
    j = heads.join(close, "artifact", "left").withColumn("views", views)
    clusters = F.transform("c", lambda x: F.struct(x["cluster"].alias("cluster"), x["size"].alias("size"), x["mean"].alias("mean_gene")))
    return j.select("artifact", "n_cells", "n_placed", F.struct(F.lit(gene).alias("gene"), F.get("c", F.lit(0))["cluster"].alias("cluster"), view_mode(F.lit(requested), F.col("views")).alias("view")).alias("selection"), clusters.alias("cluster_summaries"), "coexpression", "views")
