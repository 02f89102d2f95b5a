"""Graphs as edge tables: PageRank, cycles, neighbourhoods, import resolution.

Iterations are cut by tables under ``spark.checkpoint.dir``: neither plans nor the work lost
with an executor grow with the rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..storage import checkpoint as _checkpoint

#: Graphs of at most so many vertices and edges are ranked and searched in memory on the driver; larger ones
#: by joins.  Both ways give the same rows.
IN_MEMORY = 1_000_000


def _small(vertices: DataFrame | None, edges: DataFrame, most: int) -> tuple[list, list] | None:
    """(vertices, edges) as lists, if neither passes ``most``: one row more is enough to tell."""
    got = edges.select("src", "dst").limit(most + 1).toArrow()
    if got.num_rows > most:
        return None
    every = None if vertices is None else vertices.limit(most + 1).toArrow()
    if every is not None and every.num_rows > most:
        return None
    pairs = list(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))
    return (sorted({x for p in pairs for x in p}) if every is None else sorted(every.column(0).to_pylist())), pairs


def pagerank(vertices: DataFrame, edges: DataFrame, *, damping: float = 0.85, rounds: int = 20, spread_dangling: bool = True, scale_to_max: bool = False, cut_every: int = 5, in_memory: int = IN_MEMORY) -> DataFrame:
    """(id, rank) after so many rounds.  Parallel edges count each; edges need both ends in
    ``vertices``.  Rank without an outgoing edge is spread over all vertices, or dropped."""
    vertices = vertices.select("id").where("id is not null").distinct()
    small = _small(vertices, edges, in_memory)
    if small is not None:
        ids, pairs = small
        at = {x: i for i, x in enumerate(ids)}
        ends = np.array([(at[a], at[b]) for a, b in pairs if a in at and b in at], np.int64).reshape(-1, 2)
        n, src, dst = len(ids), ends[:, 0], ends[:, 1]
        degree = np.bincount(src, minlength=n)
        rank = np.full(n, 1.0 / max(n, 1))
        for _ in range(rounds):
            lost = rank[degree == 0].sum() if spread_dangling else 0.0
            rank = (1 - damping) / max(n, 1) + damping * (np.bincount(dst, weights=(rank / np.maximum(degree, 1))[src], minlength=n) + lost / max(n, 1))
        if scale_to_max and n:
            rank = rank / rank.max()
        kind = pa.schema([("id", pa.array(ids).type if ids else pa.int64()), ("rank", pa.float64())])
        made = vertices.sparkSession.createDataFrame(pa.Table.from_arrays([pa.array(ids, kind.field(0).type), pa.array(rank, pa.float64())], schema=kind))
        return made.select(F.col("id").cast(vertices.schema["id"].dataType).alias("id"), "rank")
    v = _checkpoint(vertices.select("id").distinct())
    e = edges.select("src", "dst").join(v.select(F.col("id").alias("src")), "src", "left_semi").join(v.select(F.col("id").alias("dst")), "dst", "left_semi")
    out = e.groupBy("src").agg(F.count("*").alias("degree"))
    e = _checkpoint(e.groupBy("src", "dst").agg(F.count("*").alias("many")).join(out, "src").select("src", "dst", (F.col("many") / F.col("degree")).alias("share")))
    n = v.count()
    if n == 0:
        return v.select("id", F.lit(0.0).alias("rank"))
    ends = v.join(out.select(F.col("src").alias("id"), F.lit(True).alias("_out")), "id", "left").select("id", F.col("_out").isNull().alias("dangling"))
    ends = _checkpoint(ends)
    ranks = ends.select("id", "dangling", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        got = ranks.join(e, ranks["id"] == e["src"]).groupBy(F.col("dst").alias("_to")).agg(F.sum(F.col("rank") * F.col("share")).alias("_in"))
        base = ends.join(got, ends["id"] == got["_to"], "left").select("id", "dangling", F.coalesce("_in", F.lit(0.0)).alias("_in"))
        if spread_dangling:
            lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("_lost"))
            base = base.crossJoin(F.broadcast(lost))  # one row
        else:
            base = base.withColumn("_lost", F.lit(0.0))
        ranks = base.select("id", "dangling", ((1 - damping) / n + damping * (F.col("_in") + F.col("_lost") / n)).alias("rank"))
        if (i + 1) % cut_every == 0:
            ranks = _checkpoint(ranks)
    if scale_to_max:
        ranks = ranks.crossJoin(F.broadcast(ranks.agg(F.max("rank").alias("_max")))).withColumn("rank", F.col("rank") / F.col("_max"))  # one row
    return ranks.select("id", "rank")


def _strong(vertices: list, pairs: list) -> list[list]:
    """Strongly connected components, by an iterative depth-first search that keeps low links."""
    out: dict = {x: [] for x in vertices}
    for a, b in pairs:
        out[a].append(b)
    order, low, open_, stack, found = {}, {}, set(), [], []
    for start in vertices:
        if start in order:
            continue
        path = [(start, iter(out[start]))]
        order[start] = low[start] = len(order)
        stack.append(start)
        open_.add(start)
        while path:
            x, rest = path[-1]
            y = next(rest, None)
            if y is None:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[x])
                if low[x] == order[x]:
                    group = []
                    while not group or group[-1] != x:
                        group.append(stack.pop())
                    open_.difference_update(group)
                    found.append(sorted(group))
            elif y not in order:
                order[y] = low[y] = len(order)
                stack.append(y)
                open_.add(y)
                path.append((y, iter(out[y])))
            elif y in open_:
                low[x] = min(low[x], order[y])
    return found


def cycles(edges: DataFrame, *, in_memory: int = IN_MEMORY) -> DataFrame:
    """(component, members): strongly connected components of more than one vertex, by their least
    member.  Beyond ``in_memory`` edges: vertices without a way in or out are trimmed first; then labels go forward and
    back: the vertices that reach, and are reached from, the least vertex of their label are a component."""
    edges = edges.where("src <> dst").select("src", "dst").distinct()
    small = _small(None, edges, in_memory)
    kind = edges.schema["src"].dataType.simpleString()
    if small is not None:
        rows = [(g[0], g) for g in _strong(*small) if len(g) > 1]
        return edges.sparkSession.createDataFrame(rows, f"component {kind}, members array<{kind}>")
    left = _checkpoint(edges)
    done = None
    while True:
        while True:  # trim
            before = left.count()
            left = _checkpoint(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            if left.count() == before:
                break
        if before == 0:
            break

        def spread(forward: bool, start: DataFrame) -> DataFrame:
            """Least label that reaches each vertex, with the edges or against them."""
            a, b = ("src", "dst") if forward else ("dst", "src")
            now = _checkpoint(start)
            while True:
                came = left.join(now.withColumnRenamed("id", a), a).select(F.col(b).alias("id"), "label")
                after = _checkpoint(now.unionByName(came).groupBy("id").agg(F.min("label").alias("label")))
                if after.exceptAll(now).isEmpty():
                    return after
                now = after

        every = left.select(F.col("src").alias("id")).unionAll(left.select(F.col("dst").alias("id"))).distinct()
        fwd = spread(True, every.select("id", F.col("id").alias("label")))
        # back from each root, only along vertices of its own label
        same = left.join(fwd.select(F.col("id").alias("src"), F.col("label").alias("l1")), "src").join(fwd.select(F.col("id").alias("dst"), F.col("label").alias("l2")), "dst").where("l1 = l2").select("src", "dst", F.col("l1").alias("label"))
        found = _checkpoint(fwd.where("id = label"))
        while True:
            came = same.join(found.withColumnRenamed("id", "dst"), ["dst", "label"]).select(F.col("src").alias("id"), "label")
            after = _checkpoint(found.unionByName(came).distinct())
            if after.count() == found.count():
                break
            found = after
        done = found if done is None else _checkpoint(done.unionByName(found))
        left = _checkpoint(left.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"))
    if done is None:
        return edges.select(F.col("src").alias("component"), F.array("src").alias("members")).limit(0)
    groups = done.groupBy(F.col("label").alias("component")).agg(F.sort_array(F.collect_set("id")).alias("members"))
    return groups.where(F.size("members") > 1)


def importers(edges: DataFrame, target) -> DataFrame:
    return edges.where(F.col("dst") == target).select("src").distinct()


def all_importers(edges: DataFrame) -> DataFrame:
    """(dst, src): the importers of every target."""
    return edges.where("dst is not null and src is not null").select("dst", "src").distinct()


def imported(edges: DataFrame, source) -> DataFrame:
    return edges.where(F.col("src") == source).select("dst").distinct()


_INDEX = {"python": ("{}.py", "{}/__init__.py"), "rust": ("{}.rs", "{}/mod.rs"), "go": ("{}.go",), "java": ("{}.java",)}
_SCRIPT = ("{}", "{}.ts", "{}.tsx", "{}.js", "{}.jsx", "{}/index.ts", "{}/index.tsx", "{}/index.js", "{}/index.jsx")


def relative(source: Column, target: Column) -> Column:
    """A target that begins with a dot, seen from the folder of the file that names it; others as they are."""
    folder = F.regexp_extract(source.cast("string"), r"^(.*/)", 1)
    return F.when(target.rlike(r"^\.\.?(/|$)"), paths.normalise(F.concat(folder, target))).otherwise(target)


#: Files, and with them imports, of one task where imports are looked up.
PART = 8192


def resolve(imports: DataFrame, files: DataFrame, part: int = PART) -> DataFrame:
    """imports (src, language, target, ...) with ``dst``: the first candidate path that is a file, else the first
    file whose dotted module is the target or the longest beginning of it, else null.

    Candidates carry their order; one equality join against the listing finds all at once, and ``imports`` is
    gone through once.  Nulls resolve to nothing; equal rows are one.

    The listing is cut into hash tables of about ``part`` files that candidates stream past, so that a name that
    every file imports is never held.  What was found and one row of each import move on, in as many parts:
    the memory of a task doesn't grow with the tree.
    """
    count = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // part))
    shapes = F.create_map(*(x for k, v in _INDEX.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    forms = F.coalesce(F.try_element_at(shapes, F.coalesce("language", F.lit(""))), F.array(*map(F.lit, _SCRIPT)))
    parts = F.split(F.regexp_replace(F.regexp_replace("target", r"^crate::", ""), r"::|/", "."), r"\.")
    heads = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct(F.col("language").alias("of"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("key")))
    # modules are asked only by names with dots or colons, which aren't paths, and in their own language
    named = F.col("target").rlike(r"^\w+([.:]+\w+)*$") & F.col("language").isin("python", "rust", "java")
    tried = F.transform(forms, lambda f: F.struct(F.lit("").alias("of"), F.replace(f, F.lit("{}"), F.col("_at")).alias("key")))
    every = F.concat(tried, F.when(named, heads).otherwise(F.array().cast("array<struct<of:string,key:string>>")))
    placed = imports.withColumn("_at", relative(F.col("src"), F.col("target"))).select(*imports.columns, F.posexplode_outer(every).alias("_nth", "_try"))
    known = files.select(F.col("relative_path").alias("_path")).where("_path is not null").distinct()
    modules = known.select(paths.language(F.col("_path")).alias("_of"), F.regexp_replace(paths.dotted_module(F.col("_path")), r"\.(__init__|mod)$", "").alias("_key"), "_path").where("_of in ('python', 'rust', 'java')").groupBy("_of", "_key").agg(F.min("_path").alias("_path"))
    table = known.select(F.lit("").alias("_of"), F.col("_path").alias("_key"), "_path").unionByName(modules)
    asked = placed.withColumns({"_a": F.col("_try.of"), "_b": F.col("_try.key")}).drop("_try").repartition(count, "_a", "_b")
    found = asked.join(table.repartition(count, "_of", "_key").hint("shuffle_hash"), (F.col("_a") == F.col("_of")) & (F.col("_b") == F.col("_key")), "left")
    found = found.where("_path is not null or coalesce(_nth, 0) = 0").drop("_a", "_b", "_of", "_key").repartition(count, *imports.columns)
    return found.groupBy(*imports.columns).agg(F.min_by("_path", F.when(F.col("_path").isNotNull(), F.col("_nth"))).alias("dst"))
