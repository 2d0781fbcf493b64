"""Files as sources and sinks: JSON trees, CSV, media folders, request batches."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.relational import natural_key

from .shared import store, written
from .tables import TREE

#: Folders of a title and whether their files are read as text or named by path.
MODES = {"prompt": True, "caption": True, "image": False, "audio": False}


def unique() -> str:
    """A name that no other call gets."""
    return uuid.uuid4().hex


def json_trees(spark: SparkSession, path: str, least_nodes: int = 0, lines: bool = False) -> DataFrame:
    """Trees of JSON files, each an array of trees or one tree, or one tree a line, with at least ``least_nodes`` nodes."""
    trees = spark.read.schema(TREE).json(path, multiLine=not lines)
    return trees.where(F.coalesce(F.size("mapping"), F.lit(0)) >= least_nodes)


def tree_nodes(trees: DataFrame) -> DataFrame:
    """Adjacency rows (conv, id, parent, ordinal, role, text): siblings in the order of their parent's list, others last by id."""
    node = trees.select(F.col("id").alias("conv"), F.explode("mapping").alias("key", "n"))
    order = node.select("conv", F.posexplode("n.children").alias("ordinal", "key"))
    return node.join(order.groupBy("conv", "key").agg(F.min("ordinal").alias("ordinal")), ["conv", "key"], "left").select(
        "conv", F.col("key").alias("id"), F.col("n.parent").alias("parent"), F.coalesce("ordinal", F.lit(2**31)).cast("long").alias("ordinal"), F.col("n.message.role").alias("role"), F.get(F.col("n.message.parts"), F.lit(0)).alias("text")
    )


def trees_to_json(nodes: DataFrame) -> DataFrame:
    """(conv, json): each tree as one document; nulls are left out."""
    kids = nodes.where("parent IS NOT NULL").groupBy("conv", F.col("parent").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]).alias("children"))
    full = nodes.join(kids, ["conv", "id"], "left")
    message = F.struct("id", "role", F.array("text").alias("parts"))
    entry = F.struct(F.col("id"), F.struct("id", "parent", "children", message.alias("message")).alias("node"))
    trees = full.groupBy("conv").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("mapping"))
    return trees.select("conv", F.to_json(F.struct(F.col("conv").alias("id"), "mapping")).alias("json"))


def new_trees(trees: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees to import, and those whose id is known or comes twice."""
    twice = trees.groupBy("id").count().where("count > 1").select("id")
    bad = known.select("id").unionByName(twice).distinct()
    return trees.join(bad, "id", "left_anti"), trees.join(bad, "id", "left_semi")


def tickets(spark: SparkSession, path: str) -> DataFrame:
    """(name, tickets) of a CSV with a header; a wrong number or a missing column is an error; a later row of a name wins."""
    rows = spark.read.csv(path, header=True, mode="FAILFAST", schema="name string, tickets long", enforceSchema=False)
    return rows.withColumn("_n", F.monotonically_increasing_id()).groupBy("name").agg(F.max_by("tickets", "_n").alias("tickets"))


LISTED = "path string, is_folder boolean, size long"


def listing(spark: SparkSession, path: str, deep: bool = True) -> DataFrame:
    """(path, is_folder, size) of what is in a folder (or those that a pattern names) and, if ``deep``, below it; hidden names ("." or "_" first) are left out.

    Folders are dealt out to tasks, which list them; a round goes one level
    down, so the driver sees only how many folders a level has.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(path)
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    bases = [s.getPath().toString() for s in found or []]
    if not bases:
        raise FileNotFoundError(f"nothing is at {path}")

    def look(batches):
        from pyarrow import fs

        for b in batches:
            for uri in b.column(0).to_pylist():
                reach, at = store(uri)
                own = reach.get_file_info(at)
                inside = reach.get_file_info(fs.FileSelector(at)) if own.type == fs.FileType.Directory else [own]
                inside = [f for f in inside if not f.base_name.startswith((".", "_"))]
                prefix = uri[: len(uri) - len(at)] if uri.endswith(at) else uri[: uri.index("/")]
                columns = [[prefix + f.path for f in inside], [f.type == fs.FileType.Directory for f in inside], [f.size or 0 for f in inside]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64()))], ["path", "is_folder", "size"])

    level, levels = spark.createDataFrame([(b,) for b in bases], "path string"), []
    while n := level.count():
        parts = min(n, 4 * spark.sparkContext.defaultParallelism)
        levels.append(written(level.repartition(parts).mapInArrow(look, LISTED), "listing"))
        level = levels[-1].where("is_folder").select("path")
        if not deep:
            break
    return reduce(DataFrame.unionByName, levels)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content, size) of all files below ``path`` but system ones; empty ones, which Spark's reader passes over, come from ``listing``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.col("length").alias("size"))
    empty = listing(spark, path).where("NOT is_folder AND size = 0").select("path", F.lit(b"").alias("content"), "size")
    f = f.where("size > 0").unionByName(empty)
    name = F.element_at(F.split("path", "/"), -1)
    return f.withColumn("name", name).where(~F.lower("name").isin(".ds_store", "thumbs.db") & ~F.startswith("name", F.lit("."))).select("path", "name", "content", "size")


def media(spark: SparkSession, base: str) -> DataFrame:
    """(title, prompt, caption, image, audio): arrays per title of the tree title/mode/folder/file, in natural order.

    Text modes hold contents, the others paths; titles are those with an image folder.
    """
    parts = F.split("path", "/")
    f = files(spark, base).select("path", "name", "content", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -3).alias("mode"), F.element_at(parts, -4).alias("title"))
    f = f.where(F.col("mode").isin(*MODES)).join(f.where("mode = 'image'").select("title").distinct(), "title", "left_semi")
    text = F.col("mode").isin(*[m for m, t in MODES.items() if t])
    row = F.struct(natural_key(F.col("folder")).alias("f"), natural_key(F.col("name")).alias("k"), "name", F.when(text, F.decode("content", "UTF-8")).otherwise(F.col("path")).alias("v"))
    lists = f.groupBy("title").pivot("mode", list(MODES)).agg(F.array_sort(F.collect_list(row)))
    return lists.select("title", *[F.transform(F.coalesce(m, F.array().cast(lists.schema[m].dataType)), lambda x: x["v"]).alias(m) for m in MODES])


def scenes(media_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(title, script) and (title, pos, part_title, content, caption, image, audio): prompts split at the first newline, the others taken by index."""
    from braidwork.functions.text import title_and_body
    from braidwork.operators.relational import zipped

    rows = zipped(media_rows, "prompt", "caption", "image", "audio")
    head, body = title_and_body(F.col("prompt"))
    sections = rows.select("title", "pos", head.alias("part_title"), body.alias("content"), "caption", "image", "audio")
    script = F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("pos", "content"))))
    return sections.groupBy("title").agg(F.array_join(F.transform(script, lambda x: x["content"]), "\n").alias("script")), sections


def requests(rows: DataFrame, model: str, max_tokens: int = 512, endpoint: str = "/v1/chat/completions") -> DataFrame:
    """(n, value): a JSON request per row (n, system_message?, user_message?, assistant_message?).

    The system message only where it is not null, user and assistant only
    where both are not; a missing column is as null.
    """
    have = set(rows.columns)
    text = lambda r: F.col(f"{r}_message") if f"{r}_message" in have else F.lit(None).cast("string")
    message = lambda r: F.struct(F.lit(r).alias("role"), text(r).alias("content"))
    both = text("user").isNotNull() & text("assistant").isNotNull()
    messages = F.array_compact(F.array(F.when(text("system").isNotNull(), message("system")), F.when(both, message("user")), F.when(both, message("assistant"))))
    body = F.struct(F.lit(model).alias("model"), messages.alias("messages"), F.lit(max_tokens).alias("max_tokens"))
    request = F.struct(F.concat(F.lit("request-"), F.col("n").cast("string")).alias("custom_id"), F.lit("POST").alias("method"), F.lit(endpoint).alias("url"), body.alias("body"))
    return rows.select("n", F.to_json(request).alias("value"))


def first_number(path: Column) -> Column:
    """The first number in the last part of a path; null without one."""
    n = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d+)", 1)
    return F.when(n != "", n.cast("long"))


def prompt_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(path, n): the first number in each file's name."""
    f = listing(spark, path, deep=False).where("NOT is_folder")
    return f.select("path", first_number(F.col("path")).alias("n")).where("n IS NOT NULL")


def named_tables(spark: SparkSession, *names: str) -> dict[str, DataFrame]:
    """Tables of the catalog by name, each read by itself; all of them without names. An unknown name is an error."""
    known = {t.name for t in spark.catalog.listTables()}
    if missing := set(names) - known:
        raise ValueError(f"no tables {sorted(missing)}; there are {sorted(known)}")
    return {n: spark.table(n) for n in sorted(names or known)}


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of CSV with a header; types by ``schema``, else inferred. Quoted fields may hold newlines."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def csv_batches(df: DataFrame, path: str, batch: str = "batch") -> None:
    """CSV with a header, a folder for each value of ``batch``."""
    df.write.partitionBy(batch).option("header", True).option("escape", '"').csv(path, mode="overwrite")


def append(df: DataFrame, path: str) -> DataFrame:
    """Rows added to a Parquet table at ``path``; returns the whole."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_lines(df: DataFrame, path: str, text: str = "text") -> None:
    """One line of text per row, added to the folder ``path``."""
    df.select(text).write.mode("append").text(path)


def flat_columns(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns named by their path; arrays and maps stay; a later column of a name wins."""
    from pyspark.sql import types as T

    found: dict[str, object] = {}

    def walk(kind, col, path):
        for f in kind.fields:
            c, p = col(f.name), [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, lambda n, c=c: c.getField(n), p)
            else:
                found[sep.join(p)] = c

    walk(df.schema, lambda n: F.col(f"`{n}`"), [])
    return df.select(*[c.alias(n) for n, c in found.items()])
