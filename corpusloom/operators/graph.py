"""File graphs, content trees and catalog integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import normal_path
from corpusloom.session import cut, numbered


def parent(path: Column) -> Column:
    """Directory of a path, '.' at the top."""
    up = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(up == "", ".").otherwise(up)


# Type and group of a file by extension, and of a directory; names that are left out.
FILE_TYPES = {
    "rs": ("Logic", 1), "tsx": ("Sensory", 2), "ts": ("Sensory", 2), "css": ("Visual", 3), "html": ("Visual", 3),
    "toml": ("Processor", 4), "json": ("Processor", 4), "md": ("Memory", 5),
}
DIRECTORY_TYPE = ("Network Structure", 8)
GRAPH_IGNORED = ("node_modules", "target", ".git", ".gemini")


def file_type(path: Column) -> Column:
    """struct(type, grp) by extension, whose case counts; anything else is ('Gist', 0)."""
    ext = F.regexp_extract(normal_path(path), r"[^/]\.([^./]+)$", 1)
    kind, grp = F.lit("Gist"), F.lit(0)
    for e, (k, g) in FILE_TYPES.items():
        kind, grp = F.when(ext == e, k).otherwise(kind), F.when(ext == e, g).otherwise(grp)
    return F.struct(kind.alias("type"), grp.alias("grp"))


def graph_files(paths: DataFrame) -> DataFrame:
    """(name): distinct paths without a component that is left out."""
    rows = paths.where("path IS NOT NULL").select(normal_path("path").alias("name")).distinct()
    return rows.where(~F.exists(F.split("name", "/"), lambda c: c.isin(*GRAPH_IGNORED)))


def file_nodes(paths: DataFrame) -> DataFrame:
    """(id, name, kind, type, grp): a node for each file and each directory that directly holds one,
    numbered from 0 by name and kind. Without any file there is one node that says so."""
    files = graph_files(paths)
    dirs = files.select(parent(F.col("name")).alias("name")).distinct()
    one = files.withColumn("kind", F.lit("file")).withColumn("t", file_type(F.col("name")))
    two = dirs.withColumn("kind", F.lit("directory")).withColumn("t", F.struct(F.lit(DIRECTORY_TYPE[0]).alias("type"), F.lit(DIRECTORY_TYPE[1]).alias("grp")))
    nodes = numbered(one.unionByName(two).select("name", "kind", "t.type", "t.grp"), ["name", "kind"], "id").select("id", "name", "kind", "type", "grp")
    if nodes.isEmpty():
        return paths.sparkSession.createDataFrame([(0, "no files found", "error", "Error", 1)], "id long, name string, kind string, type string, grp int")
    return nodes


def file_links(paths: DataFrame) -> DataFrame:
    """(source, target): each file and its directory."""
    return graph_files(paths).select(F.col("name").alias("source"), parent(F.col("name")).alias("target"))


def neighbour_lists(links: DataFrame) -> DataFrame:
    """(name, other): each pair of neighbours both ways, once; a row a neighbour, so that no node's
    neighbours gather in one row."""
    both = links.select(F.col("source").alias("name"), F.col("target").alias("other")).unionByName(links.select(F.col("target").alias("name"), F.col("source").alias("other")))
    return both.distinct()


def neighbours(links: DataFrame) -> DataFrame:
    """(name, degree): number of distinct neighbours, both ways."""
    both = links.select(F.col("source").alias("name"), F.col("target").alias("other")).unionByName(links.select(F.col("target").alias("name"), F.col("source").alias("other")))
    return both.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


def directory_tree(paths: DataFrame, max_files: int | None = None) -> DataFrame:
    """(node, up, depth): every prefix of every path with its parent; the root is '.'. With max_files, of
    that many files, the first by path."""
    if max_files is not None:
        paths = paths.where("path IS NOT NULL").select(normal_path("path").alias("path")).distinct().orderBy("path").limit(max_files)
    rows = paths.where("path IS NOT NULL").select(F.filter(F.split(normal_path("path"), "/"), lambda c: (c != "") & (c != ".")).alias("cs")).distinct()
    prefixes = rows.select("cs", F.explode(F.when(F.size("cs") > 0, F.sequence(F.lit(1), F.size("cs")))).alias("depth"))
    node = F.array_join(F.slice("cs", 1, F.col("depth")), "/")
    up = F.when(F.col("depth") == 1, ".").otherwise(F.array_join(F.slice("cs", 1, F.col("depth") - 1), "/"))
    return prefixes.select(node.alias("node"), up.alias("up"), "depth").distinct()


def merkle_digests(nodes: DataFrame) -> DataFrame:
    """(node, depth, digest) of a forest (node, up, own): a node without children has its own digest; any
    other the hash of its own digest followed by its children's, each with the child's name.

    Children are hashed in blocks by the first two letters of their names, so that of a directory
    with a third of all nodes no task holds more than a block; the blocks' digests follow in order.
    Nodes whose `up` is unknown are roots; nodes that only a cycle leads to have no row. Levels are
    found from the roots down and hashed from the leaves up, each cut from its lineage."""
    rows = cut(nodes.where("node IS NOT NULL").groupBy("node").agg(F.max(F.struct("own", "up")).alias("x")).select("node", "x.up", F.coalesce("x.own", F.lit("")).alias("own")), "nodes")
    known = rows.select(F.col("node").alias("up"))
    level = cut(rows.join(known, "up", "left_anti"), "level")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        level = cut(rows.join(level.select(F.col("node").alias("up")), "up").select(*rows.columns), "level")
    below, done = None, None
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth].withColumn("digest", F.col("own"))
        if below is not None:
            item = F.array_sort(F.collect_list(F.struct("node", "digest")))
            parts = below.groupBy("up", F.substring("node", 1, 2).alias("block")).agg(F.sha2(F.array_join(F.transform(item, lambda c: F.concat(c["digest"], c["node"])), ""), 256).alias("part"))
            inner = parts.groupBy(F.col("up").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda c: c["part"]), "").alias("inner"))
            here = here.join(inner, "node", "left").withColumn("digest", F.when(F.col("inner").isNull(), F.col("own")).otherwise(F.sha2(F.concat("own", "inner"), 256)))
        below = cut(here.select("node", "up", F.lit(depth).alias("depth"), "digest"), "digests")
        done = below if done is None else done.unionByName(below)
    if done is None:
        return rows.select("node", F.lit(0).alias("depth"), F.col("own").alias("digest"))
    return done.select("node", "depth", "digest")


def catalog_totals(chunks: DataFrame) -> DataFrame:
    """(catalog_id, chunks, files, bytes, tokens): totals from the texts themselves. Repeated
    deliveries of a chunk count once; chunks without text count as chunks with no bytes."""
    one = chunks.where("chunk_id IS NOT NULL").groupBy("catalog_id", "chunk_id").agg(F.max("path").alias("path"), F.max(F.octet_length("text")).alias("bytes"))
    path = F.regexp_replace(normal_path("path"), r"^\./", "")
    tokens = F.when(F.col("bytes").isNotNull(), F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(3.2))))
    return one.groupBy("catalog_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct(path).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens")
    )


def page_count(page: int) -> Column:
    """Number of pages of a file of `size` bytes."""
    return F.ceil(F.col("size") / F.lit(page)).cast("int")


def layer_pages(files: DataFrame, page: int) -> DataFrame:
    """(file, page_no, start, length): fixed-size pages of files (file, size); empty files have none."""
    n = page_count(page)
    rows = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("page_no"))
    start = F.col("page_no").cast("long") * page
    return rows.select("file", "page_no", start.alias("start"), F.least(F.lit(page).cast("long"), F.col("size") - start).alias("length"))


# Pages a task gives, tasks at most, pages dealt to a task together, pages a task holds at once.
TASK_PAGES, PAGE_TASKS, RUN_PAGES, STEP_PAGES = 1 << 22, 20_000, 1 << 14, 1 << 6


def spread_pages(files: DataFrame, page: int) -> DataFrame:
    """(file, page_no): the pages of files (file, size), the work in proportion to the pages. A file is a
    short row and may have any number of pages, so runs of pages are dealt over as many tasks as the
    total asks for; a task sorts its steps, which keeps the expansion of one from joining the next's."""
    rows = files.where("size > 0").select("file", page_count(page).alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    end = lambda x, size: F.col(x) + F.least(F.col("n") - F.col(x), F.lit(size)) - 1
    runs = rows.select("file", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(RUN_PAGES))).alias("run"))
    dealt = runs.repartition(min(PAGE_TASKS, max(1, -(-total // TASK_PAGES))))
    steps = dealt.select("file", "n", F.explode(F.sequence("run", end("run", RUN_PAGES), F.lit(STEP_PAGES))).alias("step")).sortWithinPartitions("file", "step")
    return steps.select("file", F.explode(F.sequence("step", end("step", STEP_PAGES))).alias("page_no"))


def layer_files(files: DataFrame, page: int = 512 << 20) -> DataFrame:
    """(file, layer): layers that model files (file, size) hold. A .gguf file has one for each page; of
    other files those named layer_N have layer N, however often they are listed."""
    single = spread_pages(files.where(F.col("file").endswith(".gguf")), page).withColumnRenamed("page_no", "layer")
    named = files.where(~F.col("file").endswith(".gguf")).select("file", F.regexp_extract("file", r"layer_([0-9]+)[^/]*$", 1).try_cast("int").alias("layer"))
    return single.unionByName(named.where("layer IS NOT NULL").distinct())


def snapshot_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): added, removed, changed or same, by the digests of two snapshots (keys, digest)."""
    both = before.withColumnRenamed("digest", "__a").join(after.withColumnRenamed("digest", "__b"), keys, "full_outer")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed").otherwise("same")
    return both.select(*keys, change.alias("change"))


def running_chain(blocks: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """(key, root): root = sha256(root || digest) over each key's blocks in order, from an empty root.
    A chain is sequential by nature; keys run in parallel."""
    rows = F.array_sort(F.collect_list(F.struct(order, digest)))
    fold = F.aggregate(rows, F.lit(""), lambda s, x: F.sha2(F.concat(s, x[digest]), 256))
    return blocks.groupBy(key).agg(fold.alias("root"))
