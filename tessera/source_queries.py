"""Registered queries over sources that are laid out of the tables and parsed in Spark: a Python module and a page of
notes for each nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changes, find, resolve, text
from tessera.plans import ingest
from tessera.plans.scratch import cut
from tessera.queries import register
from tessera.schema import EDGE, NODE, conform
from tessera.sources import files
from tessera.sources import tables as T
from tessera.sources.parsers import registry

#: Of nation %1$d, which uses the module of nation %2$d in region %3$d.
MODULE = '''"""Module %1$d."""
import os
from src.r%3$d.m%2$d import f%2$d, C%2$d
import src.r%3$d.m%2$d as peer

LIMIT = %1$d


class C%1$d(C%2$d):
    size = %1$d

    def run(self, a, b=2):
        # TODO: check %1$d
        return f%2$d(a)

    def reset(self):
        return self.run(1)


def f%1$d(x):
    if x > %1$d and x:
        return f%2$d(x)
    for i in range(x):
        helper(i)
    return os.getcwd()


def helper(x):
    return x


def test_f%1$d():
    assert f%1$d(1)
'''
NOTES = """# Nation %1$d

See [its module](https://example.com/m%1$d).

## Tasks

- [ ] open %1$d
- [x] done %1$d
"""
LATER = "\n\ndef extra%1$d():\n    return 1\n"

MODULES_SQL = """
WITH pairs AS (
  SELECT a.n_nationkey AS k, a.n_regionkey AS r, b.n_nationkey AS j, b.n_regionkey AS s
  FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % (SELECT count(*) FROM nation)),
m AS (
  SELECT *, 'src/r' || r || '/m' || k || '.py' AS path, 'src/r' || s || '/m' || j || '.py' AS other,
    'src.r' || r || '.m' || k AS module, 'src.r' || s || '.m' || j AS peer FROM pairs),
top AS (SELECT max(path) AS last FROM m)
"""


def _modules(spark: SparkSession, sf_dir: str, later: bool = False) -> DataFrame:
    """path, content; later: every fifth module has one more function."""
    n = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    count = F.broadcast(n.agg(F.count("*").alias("_n")))
    other = F.broadcast(n.select(F.col("k").alias("j"), F.col("r").alias("s")))
    both = n.crossJoin(count).join(other, F.col("j") == (F.col("k") + 1) % F.col("_n"))
    made = F.format_string(MODULE, "k", "j", "s")
    if later:
        made = F.when(F.col("k") % 5 == 0, F.concat(made, F.format_string(LATER, "k"))).otherwise(made)
    return both.select(F.format_string("src/r%d/m%d.py", "r", "k").alias("path"), made.alias("content"))


def _parsed(spark: SparkSession, sf_dir: str, later: bool = False) -> DataFrame:
    return cut(files.parse_texts(_modules(spark, sf_dir, later), registry()))


def _nodes(spark: SparkSession, sf_dir: str, later: bool = False) -> DataFrame:
    return conform(_parsed(spark, sf_dir, later).select(F.inline("nodes")), NODE)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.table(spark, sf_dir, "nation")
    texts = n.select(
        F.format_string("notes/%d.md", "n_nationkey").alias("path"), F.format_string(NOTES, "n_nationkey").alias("content")
    )
    return conform(files.parse_texts(texts, registry()).select(F.inline("nodes")), NODE)


def _sql(body: str) -> str:
    return MODULES_SQL + body


_NODES_SQL = """
SELECT 'file::' || path AS id, 'file' AS type, 'm' || k || '.py' AS name, path FROM m
UNION ALL SELECT 'func::' || path || '::f' || k, 'function', 'f' || k, path FROM m
UNION ALL SELECT 'func::' || path || '::helper', 'function', 'helper', path FROM m
UNION ALL SELECT 'func::' || path || '::test_f' || k, 'function', 'test_f' || k, path FROM m
UNION ALL SELECT 'class::' || path || '::C' || k, 'class', 'C' || k, path FROM m
UNION ALL SELECT 'var::' || path || '::C' || k || '::size', 'variable', 'size', path FROM m
UNION ALL SELECT 'method::' || path || '::C' || k || '::run', 'method', 'run', path FROM m
UNION ALL SELECT 'method::' || path || '::C' || k || '::reset', 'method', 'reset', path FROM m
UNION ALL SELECT 'import::' || path || '::os::L2', 'import', 'import os', path FROM m
UNION ALL SELECT 'import::' || path || '::' || peer || '::L3', 'import', 'from ' || peer || ' import f' || j || ', C' || j, path FROM m
UNION ALL SELECT 'import::' || path || '::' || peer || '::L4', 'import', 'import ' || peer, path FROM m
UNION ALL SELECT 'var::' || path || '::LIMIT', 'variable', 'LIMIT', path FROM m
UNION ALL SELECT 'comment::' || path || '::L13', 'comment', 'TODO: check ' || k, path FROM m
"""


@register(_sql(_NODES_SQL), graph=False)
def py_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).select("id", "type", "name", "path")


@register(_sql("""
SELECT path, 'f' || k AS name, 20 AS line_start, 25 AS line_end, 'x' AS args, 4 AS complexity, 6 AS loc, false AS is_test FROM m
UNION ALL SELECT path, 'helper', 28, 29, 'x', 1, 2, false FROM m
UNION ALL SELECT path, 'test_f' || k, 32, 33, '', 2, 2, true FROM m"""), graph=False)
def py_functions(spark, sf_dir):
    told = _nodes(spark, sf_dir).where("type = 'function'")
    return told.select("path", "name", "line_start", "line_end", F.array_join("args", ",").alias("args"), "complexity", "loc", "is_test")


@register(_sql("""
SELECT 'C' || k AS parent_class, 'run' AS name, 12 AS line_start, 'self,a,b' AS args, 1 AS complexity, 3 AS loc FROM m
UNION ALL SELECT 'C' || k, 'reset', 16, 'self', 1, 2 FROM m"""), graph=False)
def py_methods(spark, sf_dir):
    told = _nodes(spark, sf_dir).where("type = 'method'")
    return told.select("parent_class", "name", "line_start", F.array_join("args", ",").alias("args"), "complexity", "loc")


@register(_sql("""
SELECT path, p AS name, CASE WHEN p = 'b' THEN '2' END AS "default", 'arg' AS kind FROM m, (VALUES ('self'), ('a'), ('b')) t(p)"""), graph=False)
def py_params(spark, sf_dir):
    told = _nodes(spark, sf_dir).where("type = 'method' and name = 'run'").select("path", F.inline("params"))
    return told.select("path", "name", "default", "kind")


@register(_sql("SELECT path, 'C' || k AS name, 'C' || j AS base, 9 AS line_start, 17 AS line_end, 'size' AS held, false AS is_dataclass FROM m"), graph=False)
def py_classes(spark, sf_dir):
    told = _nodes(spark, sf_dir).where("type = 'class'")
    held = F.array_join(F.transform("class_vars", lambda v: v["name"]), ",")
    return told.select("path", "name", F.array_join("bases", ",").alias("base"), "line_start", "line_end", held.alias("held"), "is_dataclass")


@register(_sql("""
SELECT path, 'os' AS module, '' AS names, CAST(NULL AS VARCHAR) AS alias, 2 AS line FROM m
UNION ALL SELECT path, peer, 'f' || j || ',C' || j, NULL, 3 FROM m
UNION ALL SELECT path, peer, '', 'peer', 4 FROM m"""), graph=False)
def py_imports(spark, sf_dir):
    told = _parsed(spark, sf_dir).select(F.inline("imports"))
    return told.select("path", "module", F.array_join("names", ",").alias("names"), "alias", "line")


_CALLS_SQL = """
SELECT 'func::' || path || '::f' || k AS caller, 'f' || j AS name, 'x' AS args, 22 AS line FROM m
UNION ALL SELECT 'func::' || path || '::f' || k, 'range', 'x', 23 FROM m
UNION ALL SELECT 'func::' || path || '::f' || k, 'helper', 'i', 24 FROM m
UNION ALL SELECT 'func::' || path || '::f' || k, 'os.getcwd', '', 25 FROM m
UNION ALL SELECT 'method::' || path || '::C' || k || '::run', 'f' || j, 'a', 14 FROM m
UNION ALL SELECT 'method::' || path || '::C' || k || '::reset', 'self.run', '1', 17 FROM m
UNION ALL SELECT 'func::' || path || '::test_f' || k, 'f' || k, '1', 33 FROM m
"""


@register(_sql(_CALLS_SQL), graph=False)
def py_calls(spark, sf_dir):
    told = _parsed(spark, sf_dir).select(F.inline("calls"))
    return told.select("caller", "name", F.array_join("args", ",").alias("args"), "line")


@register(_sql("SELECT path, 'TODO' AS tag, 'check ' || k AS text, 13 AS line FROM m"), graph=False)
def py_comments(spark, sf_dir):
    return _nodes(spark, sf_dir).where("type = 'comment'").select("path", "tag", "text", "line")


@register(_sql("SELECT path, 'Module ' || k || '.' AS docstring, 'pytest' AS patterns FROM m"), graph=False)
def py_patterns(spark, sf_dir):
    told = _nodes(spark, sf_dir).where("type = 'file'")
    return told.select("path", F.col("module_docstring").alias("docstring"), F.array_join("patterns", ",").alias("patterns"))


@register(_sql("""
SELECT path, 'f' || k AS name,
  'def f' || k || '(x):\n    if x > ' || k || ' and x:\n        return f' || j || '(x)\n    for i in range(x):\n        helper(i)\n    return os.getcwd()' AS source
FROM m"""), graph=False)
def py_function_source(spark, sf_dir):
    told = _nodes(spark, sf_dir).where("type = 'function' and name not in ('helper') and not is_test")
    return told.select("path", "name", "source")


_OWN_SQL = """
SELECT 'file::' || path AS source, x AS target, CASE WHEN starts_with(x, 'import') THEN 'imports' ELSE 'defines' END AS type
FROM (SELECT path, unnest([
  'func::' || path || '::f' || k, 'func::' || path || '::helper', 'func::' || path || '::test_f' || k,
  'class::' || path || '::C' || k, 'var::' || path || '::LIMIT', 'comment::' || path || '::L13',
  'import::' || path || '::os::L2', 'import::' || path || '::' || peer || '::L3', 'import::' || path || '::' || peer || '::L4']) AS x FROM m)
UNION ALL SELECT 'class::' || path || '::C' || k, x, 'defines'
FROM (SELECT path, k, unnest(['var::' || path || '::C' || k || '::size', 'method::' || path || '::C' || k || '::run',
  'method::' || path || '::C' || k || '::reset']) AS x FROM m)
"""


@register(_sql(_OWN_SQL), graph=False)
def py_own_edges(spark, sf_dir):
    return _parsed(spark, sf_dir).select(F.inline("edges")).select("source", "target", "type")


@register(_sql("""
SELECT path, 'os' AS head, 'os' AS qualified FROM m UNION ALL SELECT path, 'f' || j, peer || '.f' || j FROM m
UNION ALL SELECT path, 'C' || j, peer || '.C' || j FROM m UNION ALL SELECT path, 'peer', peer FROM m"""), graph=False)
def py_import_map(spark, sf_dir):
    return resolve.import_map(_parsed(spark, sf_dir).select(F.inline("imports")))


@register(_sql("""
SELECT unnest(['f' || k, module || '.f' || k]) AS name, 'func::' || path || '::f' || k AS target FROM m
UNION ALL SELECT unnest(['test_f' || k, module || '.test_f' || k]), 'func::' || path || '::test_f' || k FROM m
UNION ALL SELECT unnest(['C' || k, module || '.C' || k]), 'class::' || path || '::C' || k FROM m
UNION ALL SELECT unnest(['C' || k || '.run', module || '.C' || k || '.run']), 'method::' || path || '::C' || k || '::run' FROM m
UNION ALL SELECT unnest(['C' || k || '.reset', module || '.C' || k || '.reset']), 'method::' || path || '::C' || k || '::reset' FROM m
UNION ALL SELECT module || '.helper', 'func::' || path || '::helper' FROM m
UNION ALL SELECT module || '.LIMIT', 'var::' || path || '::LIMIT' FROM m
UNION ALL SELECT 'helper', 'func::' || last || '::helper' FROM top UNION ALL SELECT 'LIMIT', 'var::' || last || '::LIMIT' FROM top"""), graph=False)
def py_symbols(spark, sf_dir):
    return resolve.symbols(_nodes(spark, sf_dir))


_RESOLVED_SQL = """
SELECT 'func::' || path || '::f' || k AS source, 'func::' || other || '::f' || j AS target, 'x' AS args, 22 AS call_line FROM m
UNION ALL SELECT 'func::' || path || '::f' || k, 'func::' || last || '::helper', 'i', 24 FROM m, top
UNION ALL SELECT 'method::' || path || '::C' || k || '::run', 'func::' || other || '::f' || j, 'a', 14 FROM m
UNION ALL SELECT 'func::' || path || '::test_f' || k, 'func::' || path || '::f' || k, '1', 33 FROM m
"""


@register(_sql(_RESOLVED_SQL), graph=False)
def py_resolved_calls(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    table = resolve.symbols(conform(parsed.select(F.inline("nodes")), NODE))
    told = resolve.calls(parsed.select(F.inline("calls")), parsed.select(F.inline("imports")), table)
    return told.select("source", "target", F.array_join("call_args", ",").alias("args"), "call_line")


@register(_sql("SELECT 'class::' || path || '::C' || k AS source, 'class::' || other || '::C' || j AS target, 'inherits' AS type FROM m"), graph=False)
def py_inherits(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return resolve.inherits(nodes, resolve.symbols(nodes))


@register(_sql("SELECT 'func::' || path || '::test_f' || k AS source, 'func::' || path || '::f' || k AS target, 'tests' AS type FROM m"), graph=False)
def py_tests(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return resolve.tests(nodes, resolve.symbols(nodes))


# Of a test's two edges to what it tests, that of its call stays.
_GRAPH_SQL = f"""
, own AS ({_OWN_SQL}), calls AS ({_RESOLVED_SQL})
SELECT source, target, type FROM own
UNION ALL SELECT source, target, 'calls' FROM calls
UNION ALL SELECT 'class::' || path || '::C' || k, 'class::' || other || '::C' || j, 'inherits' FROM m
UNION ALL SELECT DISTINCT 'dir::src/r' || r, 'file::' || path, 'contains' FROM m
UNION ALL SELECT DISTINCT 'dir::src', 'dir::src/r' || r, 'contains' FROM m
UNION ALL SELECT 'dir::.', 'dir::src', 'contains'
"""


def _graph(spark: SparkSession, sf_dir: str, later: bool = False):  # noqa: ANN202
    return ingest.assemble(_parsed(spark, sf_dir, later), "project")


@register(_sql(_GRAPH_SQL), graph=False)
def source_graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir).edges.select("source", "target", "type")


@register(_sql(f"SELECT id, type FROM ({_NODES_SQL}) UNION ALL SELECT DISTINCT 'dir::src/r' || r, 'directory' FROM m"
               " UNION ALL SELECT 'dir::src', 'directory' UNION ALL SELECT 'dir::.', 'directory'"), graph=False)
def source_graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir).nodes.select("id", "type")


@register(_sql(f", e AS (SELECT * FROM ({_GRAPH_SQL.replace(', own AS', 'WITH own AS', 1)})) SELECT type, count(*) AS n FROM e WHERE type IN ('calls', 'inherits', 'tests') GROUP BY type"), graph=False)
def source_edges_resolved(spark, sf_dir):
    told = _graph(spark, sf_dir).edges.where(F.col("type").isin("calls", "inherits", "tests"))
    return told.groupBy("type").agg(F.count("*").alias("n"))


@register(_sql("SELECT DISTINCT other AS file, path AS dependent FROM m UNION SELECT last, path FROM m, top WHERE path <> last"), graph=False)
def source_dependencies(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return changes.dependencies(type(graph)(graph.nodes, graph.edges.where("type = 'calls'")))


@register(_sql("SELECT path AS rel_path, 'modified' AS op FROM m WHERE k % 5 = 0"), graph=False)
def source_dirty_files(spark, sf_dir):
    old, new = (_parsed(spark, sf_dir, later).select("rel_path", "sha256") for later in (False, True))
    return changes.dirty_files(old, new)


@register(_sql("""
SELECT 'func::' || path || '::extra' || k AS id, 'added' AS op FROM m WHERE k % 5 = 0
UNION ALL SELECT 'file::' || path, 'modified' FROM m WHERE k % 5 = 0"""), graph=False)
def source_node_diff(spark, sf_dir):
    old, new = (_nodes(spark, sf_dir, later) for later in (False, True))
    return changes.node_diff(old, new)


@register(_sql("SELECT 'file::' || path AS source, 'func::' || path || '::extra' || k AS target, 'defines' AS type, 'added' AS op FROM m WHERE k % 5 = 0"), graph=False)
def source_edge_diff(spark, sf_dir):
    old, new = (conform(_graph(spark, sf_dir, later).edges, EDGE) for later in (False, True))
    return changes.edge_diff(old, new)


@register(_sql("""
SELECT path, CAST(CASE WHEN k % 5 = 0 THEN 37 ELSE 33 END AS INT) AS lines, CAST(CASE WHEN k % 5 = 0 THEN 4 ELSE 3 END AS BIGINT) AS functions,
  CAST(1 AS BIGINT) AS classes, 'os,' || peer AS imports FROM m"""), graph=False)
def source_file_stats(spark, sf_dir):
    told = text.file_stats(_modules(spark, sf_dir, later=True), _nodes(spark, sf_dir, later=True))
    return told.select("path", "lines", "functions", "classes", F.array_join("imports", ",").alias("imports"))


@register(_sql("SELECT DISTINCT 'src/r' || r AS path, 'src' AS parent, 'r' || r AS name FROM m UNION ALL SELECT 'src', '', 'src'"), graph=False)
def source_folders(spark, sf_dir):
    return find.lineage(_modules(spark, sf_dir).select("path"))


@register("SELECT 'notes/' || n_nationkey || '.md' AS path, 'Nation ' || n_nationkey AS name, 1 AS level, 1 AS line_start FROM nation"
          " UNION ALL SELECT 'notes/' || n_nationkey || '.md', 'Tasks', 2, 5 FROM nation", graph=False)
def md_sections(spark, sf_dir):
    return _notes(spark, sf_dir).where("type = 'section'").select("path", "name", "level", "line_start")


@register("SELECT 'notes/' || n_nationkey || '.md' AS path, 'its module' AS name, 'https://example.com/m' || n_nationkey AS url, 3 AS line FROM nation", graph=False)
def md_links(spark, sf_dir):
    return _notes(spark, sf_dir).where("type = 'link'").select("path", "name", "url", "line")


@register("SELECT 'notes/' || n_nationkey || '.md' AS path, 'open ' || n_nationkey AS text, false AS checked, 7 AS line FROM nation"
          " UNION ALL SELECT 'notes/' || n_nationkey || '.md', 'done ' || n_nationkey, true, 8 FROM nation", graph=False)
def md_tasks(spark, sf_dir):
    return _notes(spark, sf_dir).where("type = 'task_item'").select("path", "text", "checked", "line")
