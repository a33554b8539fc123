"""Schemas of the property graph and its side tables."""

from __future__ import annotations

from pyspark.sql import types as T


_PLAIN = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _parts(spec: str, mark: str) -> list[str]:
    """spec cut at mark outside of angle brackets."""
    out, depth, last = [], 0, 0
    for k, c in enumerate(spec):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == mark and not depth:
            out.append(spec[last:k])
            last = k + 1
    return [x.strip() for x in [*out, spec[last:]]]


def _type(spec: str) -> T.DataType:
    if spec.startswith("array<"):
        return T.ArrayType(_type(spec[6:-1]))
    if spec.startswith("struct<"):
        return struct(spec[7:-1], ":")
    return _PLAIN[spec]


def struct(spec: str, between: str = " ") -> T.StructType:
    """The schema of "name type, name type"; unlike Spark's own parser it needs no session, so modules can hold schemas."""
    return T.StructType([T.StructField(n, _type(t)) for n, t in (x.split(between, 1) for x in _parts(spec, ","))])


#: Union of all node types; what a type doesn't have is null.
NODE = struct(
    "id string, type string, name string, path string, abs_path string, line_start int, line_end int, line int,"
    " source string, source_md5 string, file_md5 string, signature_hash string, args array<string>,"
    " decorators array<string>, bases array<string>, names array<string>, patterns array<string>,"
    " context_managers array<string>, exceptions array<string>, headers array<string>,"
    " params array<struct<name:string,default:string,annotation:string,kind:string>>,"
    " class_vars array<struct<name:string,line:int,annotation:string,value:string>>, return_annotation string,"
    " docstring string, module_docstring string, annotation string, value string, title string, parent_class string,"
    " parent_section string, module string, tag string, text string, kind string, doc_type string, language string,"
    " url string, link_type string, is_async boolean, is_nested boolean, is_test boolean, is_dataclass boolean,"
    " is_namedtuple boolean, type_checking boolean, is_image boolean, checked boolean, complexity int, loc int,"
    " level int, frontmatter string, rows array<array<string>>, embedding array<float>,"
    " spatial struct<x:double,y:double,z:double,face:int>"
)
EDGE = struct("source string, target string, type string, call_args array<string>, call_line int")
FILE_STATE = struct("rel_path string, sha256 string, mtime_ns long, size long")
ANNOTATION = struct(
    "id string, type string, target struct<type:string,file_path:string,node_id:string>, content string,"
    " tags array<string>, color string, highlight_range struct<start:int,end:int>, stale boolean, created_at timestamp,"
    " last_modified_at timestamp"
)
COLLECTION = struct("id string, name string, annotation_ids array<string>, created_at timestamp")
THREAD = struct(
    "id string, title string, project_id string, created_at timestamp, updated_at timestamp,"
    " messages array<struct<role:string,content:string,timestamp:timestamp>>"
)
REINDEX_RUN = struct(
    "started_at timestamp, strategy string, duration_ms double, files_total long, files_parsed long,"
    " files_skipped long, files_affected long, edges_resolved long, edges_added long, edges_removed long, nodes long"
)

# The edge kinds by phase; of two edges of one pair the later phase's stays.
EDGE_PHASE = {"contains": 0, "defines": 1, "imports": 2, "inherits": 3, "tests": 4, "calls": 5}
# Node types that a word cloud leaves out, and types whose source is embedded.
CLOUD_EXCLUDED = ("directory", "file", "import")
EMBEDDED_TYPES = ("function", "method", "class", "document", "section")
MIN_EMBEDDED_CHARS = 40


def conform(df, schema: T.StructType):  # noqa: ANN001, ANN201
    """df with exactly the columns of schema; missing ones are null."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )
