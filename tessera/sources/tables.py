"""A property graph and its side tables out of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spatial(key: str):  # noqa: ANN202
    k = F.col(key).cast("long")
    face = (k % 6 + 1).cast("int")
    return F.struct(
        (k * 7919 % 3600 / 10.0).cast("double").alias("x"),
        (k * 104729 % 3600 / 10.0).cast("double").alias("y"),
        (k % 101 / 100.0).cast("double").alias("z"),
        F.when(k % 13 == 0, -face).otherwise(face).alias("face"),
    )


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions and nations are directories, suppliers and customers files, parts classes, methods and variables, orders
    functions. Folders contain, customers define orders, orders and some parts call, suppliers import, parts inherit."""
    t = lambda n: table(spark, sf_dir, n)
    region, nation, part, orders = t("region"), t("nation"), t("part"), t("orders")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name", F.concat_ws("/", "r_name", "n_name").alias("folder")
    )
    place = F.broadcast(place)  # nations of the world
    none = F.lit(None).cast("int")
    no_place = F.lit(None).cast("struct<x:double,y:double,z:double,face:int>")

    def rows(df, id_, kind, name, path, line=none, spatial=no_place):  # noqa: ANN001, ANN202
        return df.select(
            id_.alias("id"), kind.alias("type"), name.alias("name"), path.alias("path"),
            line.cast("int").alias("line_start"), spatial.alias("spatial"),
        )

    def files(df, nation_key, name):  # noqa: ANN001, ANN202
        path = F.concat_ws("/", "folder", name)
        return rows(df.join(place, F.col(nation_key) == F.col("n_nationkey")), F.concat(F.lit("file::"), path), F.lit("file"), F.col(name), path)

    part_path = F.concat(F.lit("parts/"), F.lower("p_type"), F.lit("/"), F.col("p_brand"))
    part_id = F.concat(F.lit("class::"), part_path, F.lit("::"), F.col("p_partkey"))
    part_kind = F.when(F.col("p_size") % 4 == 0, "method").when(F.col("p_size") % 4 == 1, "variable").otherwise("class")
    order_path = F.concat(F.lit("orders/"), F.col("o_orderstatus"))
    order_id = F.concat(F.lit("func::"), order_path, F.lit("::"), F.col("o_orderkey"))
    order_name = F.concat(F.col("o_orderpriority"), F.lit("_"), F.col("o_orderkey") % 50)
    nodes = (
        rows(spark.range(1), F.lit("dir::."), F.lit("directory"), F.lit("."), F.lit(""))
        .unionByName(rows(region, F.concat(F.lit("dir::"), "r_name"), F.lit("directory"), F.col("r_name"), F.col("r_name")))
        .unionByName(rows(place, F.concat(F.lit("dir::"), "folder"), F.lit("directory"), F.col("n_name"), F.col("folder")))
        .unionByName(files(t("supplier"), "s_nationkey", "s_name"))
        .unionByName(files(t("customer"), "c_nationkey", "c_name"))
        .unionByName(rows(part, part_id, part_kind, F.col("p_name"), part_path, F.col("p_size"), _spatial("p_partkey")))
        .unionByName(rows(orders, order_id, F.lit("function"), order_name, order_path, F.col("o_orderkey") % 500, _spatial("o_orderkey")))
    )

    def edges(df, source, target, kind, line=none):  # noqa: ANN001, ANN202
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), line.cast("int").alias("call_line"))

    parts = part.select("p_partkey", part_id.alias("part_id"))
    order_ids = orders.select("o_orderkey", "o_custkey", order_id.alias("order_id"))
    file_id = lambda name: F.concat(F.lit("file::"), F.concat_ws("/", "folder", name))
    customers = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    line = t("lineitem")
    used = line.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n"))
    sold = line.select("l_suppkey", "l_partkey").distinct()
    to_part = parts.withColumnsRenamed({"p_partkey": "_k", "part_id": "to_id"})
    to_order = order_ids.select(F.col("o_orderkey").alias("_k"), F.col("order_id").alias("to_id"))
    third = parts.where("p_partkey % 3 = 0").join(to_part, F.col("_k") == F.col("p_partkey") * 3 + 1)
    half = parts.where("p_partkey % 10 = 0 and p_partkey > 0").join(to_part, F.col("_k") == F.expr("p_partkey div 2"))
    nxt = order_ids.where("o_orderkey % 7 = 0").join(to_order, F.col("_k") == F.col("o_orderkey") + 1)
    folder = F.concat(F.lit("dir::"), "folder")
    told = (
        edges(region, F.lit("dir::."), F.concat(F.lit("dir::"), "r_name"), "contains")
        .unionByName(edges(place, F.concat(F.lit("dir::"), "r_name"), folder, "contains"))
        .unionByName(edges(suppliers, folder, file_id("s_name"), "contains"))
        .unionByName(edges(customers, folder, file_id("c_name"), "contains"))
        .unionByName(edges(customers.join(order_ids, F.col("c_custkey") == F.col("o_custkey")), file_id("c_name"), F.col("order_id"), "defines"))
        .unionByName(
            edges(
                used.join(order_ids, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")),
                F.col("order_id"), F.col("part_id"), "calls", F.col("n"),
            )
        )
        .unionByName(
            edges(
                sold.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")),
                file_id("s_name"), F.col("part_id"), "imports",
            )
        )
        .unionByName(edges(third, F.col("part_id"), F.col("to_id"), "calls"))
        .unionByName(edges(half, F.col("part_id"), F.col("to_id"), "inherits"))
        .unionByName(edges(nxt, F.col("order_id"), F.col("to_id"), "calls"))
    )
    return Graph(nodes, told)


def star_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("label"), "label").alias("type"), "embedding"
    )


def star_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: documents as files."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("path"),
        F.coalesce("text", F.lit("")).alias("content"),
    )


def star_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations out of the document labels."""
    d = table(spark, sf_dir, "labels")
    target = F.when(
        F.col("doc_id") % 2 == 0,
        F.struct(F.lit("file").alias("type"), F.concat(F.lit("docs/"), "doc_id").alias("file_path"), F.lit(None).cast("string").alias("node_id")),
    ).otherwise(F.struct(F.lit("node").alias("type"), F.lit(None).cast("string").alias("file_path"), F.concat(F.lit("node"), "doc_id").alias("node_id")))
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("quality") == 1, "note").otherwise("tag").alias("type"),
        target.alias("target"),
        F.array(F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic")).alias("tags"),
        F.lit(False).alias("stale"),
    )


def star_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-index runs out of the events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts").alias("started_at"),
        F.col("event_type").alias("strategy"),
        F.col("value").alias("duration_ms"),
        (F.col("user_id") % 100).alias("files_total"),
        (F.col("event_id") % 7).alias("edges_added"),
        (F.col("event_id") % 5).alias("edges_removed"),
    )


def star_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of files out of the orders: later some are gone, some new, some changed, some only touched."""
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("orders/"), F.col("o_orderkey")).alias("rel_path")
    content = F.concat_ws("|", "o_orderstatus", F.col("o_custkey").cast("string"))
    old = o.where("o_orderkey % 11 <> 3").select(
        path, F.sha2(content, 256).alias("sha256"), F.col("o_orderkey").cast("long").alias("mtime_ns"), F.length(content).cast("long").alias("size")
    )
    changed = F.when(F.col("o_orderkey") % 13 == 5, F.concat(content, F.lit("x"))).otherwise(content)
    stamp = F.when((F.col("o_orderkey") % 13 == 5) | (F.col("o_orderkey") % 17 == 1), F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey"))
    new = o.where("o_orderkey % 11 <> 4").select(
        path, F.sha2(changed, 256).alias("sha256"), stamp.cast("long").alias("mtime_ns"), F.length(changed).cast("long").alias("size")
    )
    return old, new
