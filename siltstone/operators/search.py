"""The declared code-search queries.  What the contract leaves open is chosen here: cosine similarity, md5 hashes, depth from the root, no revisits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.paths import to_unix_path
from siltstone.functions.text import count_lines
from siltstone.plans.lineage import cut

TOP_K, MAX_LAYER = 10, 10


def cosine(a: Column, b: Column) -> Column:
    """In double; null where either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def semantic_top_k(vectors: DataFrame, query: list[float], k: int = TOP_K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """TOP-01, CQ-08: the k best by cosine, ties by id; each partition sends its k best only."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col(vector), q)).where("score IS NOT NULL").orderBy(F.desc("score"), id_col).limit(k)


def relation_tree(edges: DataFrame, roots: DataFrame, max_layer: int = MAX_LAYER) -> DataFrame:
    """CQ-01, JON-10: (root, node, layer) of what the roots reach over (parent, child) edges; each node once, on its first layer.

    One join for each layer, written to the shared folder, so that a layer is computed once.  A node already seen from its root is not visited
    again, so cycles end, and an empty layer is the last.
    """
    edges = edges.select("parent", "child").distinct()
    seen = front = cut(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("layer")).distinct())
    for layer in range(1, max_layer + 1):
        nxt = front.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        known = seen.select(F.col("root").alias("r"), F.col("node").alias("n"))
        front = cut(nxt.join(known, (F.col("root") == F.col("r")) & (F.col("node") == F.col("n")), "left_anti").withColumn("layer", F.lit(layer)))
        if not front.take(1):
            break
        seen = seen.unionByName(front)
    return seen


def with_nodes(tree: DataFrame, nodes: DataFrame, content: bool = False) -> DataFrame:
    """CQ-01: the tree's rows with their nodes' type, file and position, and with content only if asked for; a node without a row keeps nulls.

    nodes: node, node_type, path, start_line, start_column, end_line, end_column, content; one row for each node.
    """
    place = F.struct("start_line", "start_column", "end_line", "end_column").alias("position")
    return tree.join(nodes.select("node", "node_type", "path", place, *(["content"] if content else [])), "node", "left")


def definitions_of_snippets(symbols: DataFrame, requests: DataFrame, snippet: str = "snippet") -> DataFrame:
    """CQ-02 by code: (request columns, symbol columns) for each symbol whose name is an identifier of the snippet; each symbol once for each request."""
    names = requests.withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all(F.col(snippet), F.lit(r"([\p{L}_][\p{L}\p{N}_]*)"), 1))))
    return names.join(symbols, "name")


def definitions(symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """CQ-02, JON-09: symbols of the requested file that overlap the requested lines; an equi join on the file, then the overlap."""
    return requests.join(symbols, "path").where((F.col("start_line") <= F.col("to_line")) & (F.col("end_line") >= F.col("from_line")))


def structure(symbols: DataFrame, path: Column) -> DataFrame:
    """CQ-03: a file's symbols by place; the place is in the columns, the order is the reader's."""
    return symbols.where(F.col("path") == path)


def file_hashes(files: DataFrame, path: Column, content: Column) -> DataFrame:
    """CQ-07."""
    return files.select(path.alias("path"), F.md5(F.encode(content, "UTF-8")).alias("hash"))


def hash_diff(client: DataFrame, server: DataFrame) -> DataFrame:
    """JON-11: paths that differ, as added (client only), deleted (server only) or modified."""
    both = client.alias("c").join(server.alias("s"), "path", "full")
    state = F.when(F.col("s.hash").isNull(), "added").when(F.col("c.hash").isNull(), "deleted").otherwise("modified")
    return both.where(~F.col("c.hash").eqNullSafe(F.col("s.hash"))).select("path", state.alias("change"))


def directory_tree(files: DataFrame, depth: int = 0, include_files: bool = True, path: str = "path", size: str = "size", sub_dir: str = "") -> DataFrame:
    """CQ-06, AGG-07: (path, parent, depth, is_dir, n_files, size) of every directory, and of files; depth 0 is unlimited.

    With sub_dir only what lies below it counts, and depths are counted from there.  Each file gives a row for each of its ancestors; sizes are summed map-side first.
    """
    top = [p for p in sub_dir.split("/") if p]
    if top:
        whole = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
        below = F.array_join(F.slice(whole, F.lit(len(top) + 1), F.greatest(F.size(whole) - len(top), F.lit(0))), "/")
        found = directory_tree(files.where(F.slice(whole, 1, len(top)) == F.array(*map(F.lit, top))).select(below.alias(path), size), depth, include_files, path, size)
        head = F.lit("/" + "/".join(top))
        return found.withColumns({"path": F.concat(head, "path"), "parent": F.when(F.col("parent") == "/", head).otherwise(F.concat(head, F.col("parent")))})
    parts = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    rows = files.select(parts.alias("parts"), F.col(size).cast("long").alias("size")).where(F.size("parts") > 0)
    levels = F.when(F.lit(depth) > 0, F.least(F.size("parts"), F.lit(depth))).otherwise(F.size("parts"))
    rows = rows.select("parts", "size", F.explode(F.sequence(F.lit(1), levels)).alias("depth"))
    name = lambda n: F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), n), "/"))
    rows = rows.select(name(F.col("depth")).alias("path"), F.when(F.col("depth") == 1, "/").otherwise(name(F.col("depth") - 1)).alias("parent"), "depth", (F.col("depth") < F.size("parts")).alias("is_dir"), "size")
    rows = rows if include_files else rows.where("is_dir")
    return rows.groupBy("path", "parent", "depth").agg(F.max("is_dir").alias("is_dir"), F.count("*").alias("n_files"), F.sum("size").alias("size"))


def tree_totals(files: DataFrame, size: str = "size") -> DataFrame:
    """AGG-05."""
    return files.agg(F.count("*").alias("total_files"), F.sum(F.col(size).cast("long")).alias("total_size"))


def index_summary(files: DataFrame, by: str, content: str, key: str) -> DataFrame:
    """CQ-09, AGG-06: files, chunks (lines here) and the last id of each index."""
    return files.groupBy(by).agg(F.countDistinct(key).alias("total_files"), F.sum(count_lines(F.col(content))).alias("total_chunks"), F.max(key).alias("last_id"))


def without_deleted(index: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """CQ-11, CQ-12: what stays of an index."""
    return index.join(deleted, key, "left_anti")


INDEX_TYPES = ("embedding", "codegraph", "all")


def index_tasks(requests: DataFrame) -> DataFrame:
    """CQ-10: (task_id, index_type, files) for requests of (index_type, files map); an id depends on the content only, an unknown type has none."""
    body = F.to_json(F.struct("index_type", F.array_sort(F.map_entries("files")).alias("files")))
    task = F.when(F.col("index_type").isin(*INDEX_TYPES), F.left(F.sha2(body, 256), F.lit(32)))
    return requests.select(task.alias("task_id"), "index_type", "files")


def store_upload(files: DataFrame, target: str, partition: str) -> None:
    """CQ-05: an upload appended to the partitioned store."""
    files.withColumn("path", to_unix_path(F.col("path"))).write.mode("append").partitionBy(partition).parquet(target)
