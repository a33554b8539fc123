"""Lines, searches in texts, sections and file statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import glob_regex, language
from tessera.plans.scratch import cut

# The limits of searches and excerpts.
FILE_MATCHES, PROJECT_MATCHES, PROJECT_CHARS, SECTION_LINES, CONTENT_BYTES = 200, 500, 200_000, 800, 2_000_000


class PatternError(ValueError):
    """A search pattern that isn't a valid regular expression."""


class RangeError(ValueError):
    """Line numbers that are no range."""


class ChangedError(ValueError):
    """A text that isn't the expected one any more."""


class NotFoundError(LookupError):
    """A path or name that isn't there."""


def lines(texts: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, n, text: lines from 1. \\r\\n and \\r end lines too; a text's last empty piece is none."""
    flat = F.regexp_replace(F.col(content), "\r\n?", "\n")
    pieces = F.split(flat, "\n", -1)
    pieces = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))).otherwise(
        pieces
    )
    return texts.select(F.col(path).alias("path"), F.posexplode(pieces).alias("n", "text")).withColumn("n", F.col("n") + 1)


def pattern(text: str, regex: bool = True) -> str:
    """A Java pattern. Python's named groups are translated; PatternError if it isn't valid."""
    if not regex:
        return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    try:
        re.compile(text)
    except re.error as e:
        raise PatternError(f"invalid pattern: {e}") from e
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<", "(?<", text))


def grep(texts: DataFrame, sought: str, regex: bool = True, context: int = 5, limit: int | None = FILE_MATCHES) -> DataFrame:
    """path, line_no, text, context_before, context_after: matching lines of texts (path, content) with up to
    ``context`` lines on each side, the first ``limit`` of each path.

    The context is cut from the text's own array of lines, so nothing is shuffled.
    """
    rx = pattern(sought, regex)
    flat = F.regexp_replace(F.col("content"), "\r\n?", "\n")
    pieces = F.split(flat, "\n", -1)
    base = texts.where(F.col("content").rlike(f"(?m){rx}") if "\n" not in sought else F.lit(True)).select("path", pieces.alias("_l"))
    base = base.withColumn(
        "_l", F.when(F.element_at("_l", -1) == "", F.slice("_l", 1, F.greatest(F.size("_l") - 1, F.lit(0)))).otherwise(F.col("_l"))
    )
    places = F.filter(F.sequence(F.lit(1), F.size("_l")), lambda i: F.element_at(F.col("_l"), i).rlike(rx))
    places = F.when(F.size("_l") > 0, places).otherwise(F.array().cast("array<int>"))
    if limit is not None:
        places = F.slice(places, 1, limit)
    hits = base.withColumn("_at", places).select("path", "_l", F.explode("_at").alias("line_no"))
    first = F.greatest(F.lit(1), F.col("line_no") - context)
    return hits.select(
        "path",
        "line_no",
        F.element_at("_l", F.col("line_no")).alias("text"),
        F.slice("_l", first, F.col("line_no") - first).alias("context_before"),
        F.slice("_l", F.col("line_no") + 1, F.lit(context)).alias("context_after"),
    )


def project_grep(texts: DataFrame, sought: str, globs: str = "*.py", regex: bool = True, context: int = 5) -> DataFrame:
    """grep over the paths whose base name fits one of the globs, in order of path and line, until PROJECT_MATCHES
    matches or PROJECT_CHARS characters; the match that crosses that budget is still told.

    Only the first PROJECT_MATCHES matches, found by a distributed top-k, enter the running sum.
    """
    names = [g.strip() for g in globs.split(",") if g.strip()] or ["*.py"]
    base = F.element_at(F.split("path", "/"), -1)
    wanted = F.lit(False)
    for g in names:
        wanted = wanted | base.rlike(glob_regex(g))
    fit = texts.where(wanted)
    # The first matches by their places alone; only their texts are cut into contexts.
    places = grep(fit, sought, regex, 0, None).select("path", "line_no").orderBy("path", "line_no").limit(PROJECT_MATCHES)
    places = F.broadcast(cut(places))
    some = fit.join(F.broadcast(places.select("path").distinct()), "path", "left_semi")
    found = grep(some, sought, regex, context, None).join(places, ["path", "line_no"], "left_semi")
    chars = lambda c: F.aggregate(F.col(c), F.lit(0), lambda s, x: s + F.length(x))
    size = F.length("text") + chars("context_before") + chars("context_after")
    first = found.withColumn("_size", size)
    before = F.sum("_size").over(Window.orderBy("path", "line_no").rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < PROJECT_CHARS).drop("_size", "_before")


def checked(texts: DataFrame, path: str, md5: str | None = None) -> DataFrame:
    """The row of a path. NotFoundError if there is none, ChangedError if its MD5 isn't the expected one."""
    found = texts.where(F.col("path") == path)
    told = found.select(F.md5(F.col("content").cast("binary"))).first()
    if told is None:
        raise NotFoundError(f"no such file: {path}")
    if md5 is not None and told[0] != md5:
        raise ChangedError(f"{path} has changed: its MD5 is {told[0]}, not {md5}")
    return found


def section(texts: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Lines start..end of one text, SECTION_LINES at most. RangeError for a range that can't be."""
    if start < 1 or end < start:
        raise RangeError(f"invalid range: {start} to {end}")
    last = min(end, start + SECTION_LINES - 1)
    return lines(texts.where(F.col("path") == path)).where(F.col("n").between(start, last)).orderBy("n")


def content(texts: DataFrame, path: str) -> DataFrame:
    """path, text, size, truncated, language: a whole text, up to CONTENT_BYTES."""
    size = F.octet_length("content")
    head = F.decode(F.substring(F.encode("content", "UTF-8"), 1, CONTENT_BYTES), "UTF-8")
    return texts.where(F.col("path") == path).select(
        "path",
        F.when(size > CONTENT_BYTES, head).otherwise(F.col("content")).alias("text"),
        size.alias("size"),
        (size > CONTENT_BYTES).alias("truncated"),
        language(F.col("path")).alias("language"),
    )


def unchanged(texts: DataFrame, path: str, md5: str) -> DataFrame:
    """path, same: whether the text's MD5 is still the expected one."""
    return texts.where(F.col("path") == path).select("path", (F.md5(F.col("content").cast("binary")) == md5).alias("same"))


def file_stats(texts: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """path, lines, size, md5, language of each text, and with nodes functions, classes and imports (50 at most)."""
    n = F.when(F.col("content") == "", 0).otherwise(
        F.size(F.split("content", "\n")) - F.when(F.col("content").endswith("\n"), 1).otherwise(0)
    )
    out = texts.select(
        "path",
        n.alias("lines"),
        F.octet_length("content").alias("size"),
        F.md5(F.col("content").cast("binary")).alias("md5"),
        language(F.col("path")).alias("language"),
    )
    if nodes is None:
        return out
    counts = nodes.groupBy("path").agg(
        F.count_if(F.col("type") == "function").alias("functions"),
        F.count_if(F.col("type") == "class").alias("classes"),
        F.slice(F.sort_array(F.collect_set(F.when(F.col("type") == "import", F.col("module")))), 1, 50).alias("imports"),
    )
    return out.join(counts, "path", "left").fillna(0, ["functions", "classes"])


def comment_tags(texts: DataFrame) -> DataFrame:
    """path, n, tag, text: tagged comments after a #."""
    rx = r"(?i)#\s*(TODO|FIXME|NOTE|HACK|XXX)\b[:\s]*(.*)"
    return (
        lines(texts)
        .where(F.col("text").rlike(rx))
        .select(
            "path",
            "n",
            F.upper(F.regexp_extract("text", rx, 1)).alias("tag"),
            F.trim(F.regexp_extract("text", rx, 2)).alias("text"),
        )
    )


def spans(headings: DataFrame, totals: DataFrame) -> DataFrame:
    """headings (path, line_start, level, name) with line_end and parent_section.

    A section ends before the next heading, or at the last line (totals: path, lines). Its parent is the nearest earlier
    heading of a smaller level: the latest of the last headings of each smaller level.
    """
    w = Window.partitionBy("path").orderBy("line_start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    told = headings.join(totals, "path").withColumn(
        "line_end", F.lead("line_start").over(w) - 1
    )
    told = told.withColumn("line_end", F.coalesce("line_end", "lines").cast("int"))
    for k in range(1, 6):
        mark = F.when(F.col("level") == k, F.struct("line_start", "name"))
        told = told.withColumn(f"_h{k}", F.last(mark, ignorenulls=True).over(before))
    # Null structs are passed over by greatest().
    parents = [F.when(F.col("level") > k, F.col(f"_h{k}")) for k in range(1, 6)]
    told = told.withColumn("parent_section", F.greatest(*parents)["name"])
    return told.drop("lines", *[f"_h{k}" for k in range(1, 6)])


def headings(texts: DataFrame) -> DataFrame:
    """path, line_start, level, name: ATX headings outside fenced blocks."""
    told = lines(texts)
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("text").rlike(r"^ {0,3}(```|~~~)")
    told = told.withColumn("_open", F.sum(fence.cast("int")).over(w) % 2 == 1)
    rx = r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"
    return told.where(~F.col("_open") & ~fence & F.col("text").rlike(rx)).select(
        "path",
        F.col("n").alias("line_start"),
        F.length(F.regexp_extract("text", rx, 1)).alias("level"),
        F.regexp_extract("text", rx, 2).alias("name"),
    )


def flatten_csv(header: Column, row: Column) -> Column:
    """"name: value; name: value" of two arrays of strings."""
    return F.array_join(F.zip_with(header, row, lambda h, v: F.concat_ws(": ", h, F.coalesce(v, F.lit("")))), "; ")
