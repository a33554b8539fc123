"""Symbols and the edges that follow from names: calls, inheritance, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import module
from tessera.plans.scratch import small


def symbols(nodes: DataFrame) -> DataFrame:
    """name, target: what each name stands for. Functions, classes and variables go by their own and their module's
    name, methods by their class's. Of nodes with one name the last in order of path, line and id is meant; the
    reference order of files is fixed by that, so results don't depend on which file was parsed first."""
    named = nodes.where(F.col("type").isin("function", "class", "method", "variable")).where("name is not null")
    named = named.where(~F.col("id").rlike("^var::[^:]*(?::[^:]+)*::.+::.+$"))  # class variables aren't registered
    mod = module(F.col("path"))
    own = F.when(F.col("type") == "method", F.concat_ws(".", "parent_class", "name")).otherwise(F.col("name"))
    keys = F.array(own, F.concat_ws(".", mod, own))
    seq = F.struct(F.col("path"), F.coalesce("line_start", "line", F.lit(0)).alias("line"), F.col("id"))
    return (
        named.select(F.explode(keys).alias("name"), seq.alias("_seq"))
        .groupBy("name")
        .agg(F.max("_seq").alias("_seq"))
        .select("name", F.col("_seq.id").alias("target"))
    )


def import_map(imports: DataFrame) -> DataFrame:
    """path, head, qualified: what a file's imported names stand for. imports: path, module, names, alias, line; the
    last import of a name wins."""
    names = F.when(
        F.size(F.coalesce("names", F.array().cast("array<string>"))) > 0,
        F.transform("names", lambda n: F.struct(n.alias("head"), F.concat_ws(".", "module", n).alias("qualified"))),
    ).otherwise(
        F.array(
            F.struct(
                F.coalesce("alias", F.element_at(F.split("module", r"\."), -1)).alias("head"),
                F.col("module").alias("qualified"),
            )
        )
    )
    flat = imports.select("path", "line", F.inline(names))
    return flat.groupBy("path", "head").agg(F.max_by("qualified", F.struct("line", "qualified")).alias("qualified"))


def calls(called: DataFrame, imports: DataFrame, table: DataFrame) -> DataFrame:
    """source, target, type, call_args, call_line of the calls (caller, path, name, args, line) that resolve: by the
    whole name, else with its head expanded by the file's imports, else by its last part. Calls of oneself are none.

    The table of symbols is broadcast only while it is small.
    """
    head = F.get(F.split("name", r"\."), F.lit(0))
    tail = F.regexp_replace("name", r"^[^.]*", "")
    last = F.when(F.instr("name", ".") > 0, F.element_at(F.split("name", r"\."), -1))
    base = called.withColumns({"_head": head, "_tail": tail, "_last": last})
    maps = import_map(imports)
    base = base.join(maps.withColumnRenamed("head", "_head"), ["path", "_head"], "left").withColumn(
        "_qualified", F.concat(F.col("qualified"), F.col("_tail"))
    )
    t = small(table)
    for n, key in enumerate(("name", "_qualified", "_last")):
        base = base.join(t.select(F.col("name").alias(key), F.col("target").alias(f"_t{n}")), key, "left")
    target = F.coalesce("_t0", "_t1", "_t2")
    return (
        base.withColumn("target", target)
        .where("target is not null and target <> caller")
        .select(
            F.col("caller").alias("source"),
            "target",
            F.lit("calls").alias("type"),
            F.col("args").alias("call_args"),
            F.col("line").alias("call_line"),
        )
    )


def inherits(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """Edges from classes to the bases that are known."""
    bases = nodes.where("type = 'class'").select(F.col("id").alias("source"), F.explode("bases").alias("name"))
    found = bases.join(small(table), "name").where("target <> source")
    return found.select("source", "target", F.lit("inherits").alias("type")).distinct()


def tests(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """Edges from a test function to the function that its name names after test_."""
    named = nodes.where("type = 'function' and is_test and name like 'test\\\\_%'").select(
        F.col("id").alias("source"), F.regexp_replace("name", "^test_", "").alias("name")
    )
    found = named.where("name <> ''").join(small(table), "name").where("target <> source")
    return found.select("source", "target", F.lit("tests").alias("type")).distinct()
