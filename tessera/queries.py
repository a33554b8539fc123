"""The registered queries of the graph operators, with the SQL of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import changes, find, notes, rank, resolve, spatial, text, traverse, vector
from tessera.plans.graph import Graph, unique_edges
from tessera.sources import tables as T
from tessera.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GRAPH_SQL = """
place AS (SELECT n_nationkey, n_name, r_name, r_name || '/' || n_name AS folder
          FROM nation JOIN region ON n_regionkey = r_regionkey),
parts AS (SELECT *, 'parts/' || lower(p_type) || '/' || p_brand AS path FROM part),
part_ids AS (SELECT *, 'class::' || path || '::' || p_partkey AS id FROM parts),
order_ids AS (SELECT *, 'func::orders/' || o_orderstatus || '::' || o_orderkey AS id FROM orders),
nodes AS (
  SELECT 'dir::.' AS id, 'directory' AS type, '.' AS name, '' AS path, NULL::INT AS line_start, NULL::BIGINT AS key
  UNION ALL SELECT 'dir::' || r_name, 'directory', r_name, r_name, NULL, NULL FROM region
  UNION ALL SELECT 'dir::' || folder, 'directory', n_name, folder, NULL, NULL FROM place
  UNION ALL SELECT 'file::' || folder || '/' || s_name, 'file', s_name, folder || '/' || s_name, NULL, NULL
    FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 'file::' || folder || '/' || c_name, 'file', c_name, folder || '/' || c_name, NULL, NULL
    FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT id, CASE WHEN p_size % 4 = 0 THEN 'method' WHEN p_size % 4 = 1 THEN 'variable' ELSE 'class' END,
    p_name, path, p_size, p_partkey FROM part_ids
  UNION ALL SELECT id, 'function', o_orderpriority || '_' || (o_orderkey % 50), 'orders/' || o_orderstatus,
    CAST(o_orderkey % 500 AS INT), o_orderkey FROM order_ids),
edges AS (
  SELECT 'dir::.' AS source, 'dir::' || r_name AS target, 'contains' AS type, NULL::INT AS call_line FROM region
  UNION ALL SELECT 'dir::' || r_name, 'dir::' || folder, 'contains', NULL FROM place
  UNION ALL SELECT 'dir::' || folder, 'file::' || folder || '/' || s_name, 'contains', NULL
    FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 'dir::' || folder, 'file::' || folder || '/' || c_name, 'contains', NULL
    FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT 'file::' || folder || '/' || c_name, o.id, 'defines', NULL
    FROM customer JOIN place ON c_nationkey = n_nationkey JOIN order_ids o ON c_custkey = o_custkey
  UNION ALL SELECT o.id, p.id, 'calls', min(l_linenumber)
    FROM lineitem JOIN order_ids o ON l_orderkey = o_orderkey JOIN part_ids p ON l_partkey = p_partkey GROUP BY 1, 2
  UNION ALL SELECT DISTINCT 'file::' || folder || '/' || s_name, p.id, 'imports', NULL::INT
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN place ON s_nationkey = n_nationkey
    JOIN part_ids p ON l_partkey = p_partkey
  UNION ALL SELECT a.id, b.id, 'calls', NULL FROM part_ids a JOIN part_ids b ON b.p_partkey = a.p_partkey * 3 + 1
    WHERE a.p_partkey % 3 = 0
  UNION ALL SELECT a.id, b.id, 'inherits', NULL FROM part_ids a JOIN part_ids b ON b.p_partkey = a.p_partkey // 2
    WHERE a.p_partkey % 10 = 0 AND a.p_partkey > 0
  UNION ALL SELECT a.id, b.id, 'calls', NULL FROM order_ids a JOIN order_ids b ON b.o_orderkey = a.o_orderkey + 1
    WHERE a.o_orderkey % 7 = 0),
degrees AS (SELECT id, count(e) AS degree FROM nodes LEFT JOIN (
  SELECT source AS e FROM edges UNION ALL SELECT target FROM edges) ON e = id GROUP BY id),
coords AS (SELECT id, type, name, path, key * 7919 % 3600 / 10.0 AS x, key * 104729 % 3600 / 10.0 AS y,
  key % 101 / 100.0 AS z, CAST(CASE WHEN key % 13 = 0 THEN -(key % 6 + 1) ELSE key % 6 + 1 END AS INT) AS face
  FROM nodes WHERE key IS NOT NULL)
"""
TEXT_SQL = """
texts AS (SELECT 'docs/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS content FROM documents),
pieces AS (SELECT path, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS p
  FROM texts),
kept AS (SELECT path, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM pieces),
lines AS (SELECT path, unnest(p) AS text, CAST(generate_subscripts(p, 1) AS INT) AS n FROM kept)
"""

ORDER_ROOT = "func::orders/{}::0"


def register(sql: str | None = None, graph: bool = True, recursive: bool = False):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = f"WITH {'RECURSIVE ' * recursive}{GRAPH_SQL}" if graph else ""
            ORACLES[f.__name__] = f"{head}{',' if graph and recursive else ''} {sql}"
        return f

    return add


def _hub(g: Graph) -> str:
    """A node to start from: the function of order 7's, which calls another."""
    return g.nodes.where("type = 'function' and id like '%::7'").first()["id"]


HUB = "(SELECT id FROM nodes WHERE type = 'function' AND id LIKE '%::7' LIMIT 1)"
USED = "(SELECT id FROM nodes WHERE id LIKE 'class::%::1')"


def _used(g: Graph) -> str:
    """Part 1, which orders call."""
    return g.nodes.where("id like 'class::%::1'").first()["id"]


# Counts, lookups


@register("SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'node', NULL, count(*) FROM nodes"
          " UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'edge', NULL, count(*) FROM edges")  # fmt: skip
def graph_stats(spark, sf_dir):
    return find.stats(T.star_graph(spark, sf_dir))


@register("SELECT id, type, name FROM nodes WHERE contains(lower(name), 'ring')")
def find_substring(spark, sf_dir):
    return find.find(T.star_graph(spark, sf_dir).nodes, "RING").select("id", "type", "name")


@register("SELECT id, type, name FROM nodes WHERE contains(lower(name), 'widget') AND type = 'method'")
def find_typed(spark, sf_dir):
    return find.find(T.star_graph(spark, sf_dir).nodes, "widget", "method").select("id", "type", "name")


@register("SELECT id FROM nodes WHERE starts_with(path, 'ASIA/')")
def path_prefix(spark, sf_dir):
    return find.under(T.star_graph(spark, sf_dir).nodes, "ASIA/").select("id")


@register("SELECT id, type, name, path, line_start FROM nodes WHERE type IN ('directory', 'file')")
def type_filter(spark, sf_dir):
    g = T.star_graph(spark, sf_dir)
    return g.nodes.where(F.col("type").isin("directory", "file")).select("id", "type", "name", "path", "line_start")


@register(f"SELECT type, target AS other, n.name, n.type AS other_type, n.path = (SELECT path FROM nodes WHERE id = {HUB}) AS same_file"
          f" FROM edges e JOIN nodes n ON n.id = e.target WHERE source = {HUB}".replace("SELECT type,", "SELECT e.type,"))  # fmt: skip
def node_detail_out(spark, sf_dir):
    g = T.star_graph(spark, sf_dir)
    told = find.edge_details(g, _hub(g)).where("direction = 'out'")
    return told.select("type", "other", "name", "other_type", "same_file")


@register(f"SELECT e.type, source AS other, n.name, n.type AS other_type FROM edges e JOIN nodes n ON n.id = e.source WHERE target = {HUB}")
def node_detail_in(spark, sf_dir):
    g = T.star_graph(spark, sf_dir)
    return find.edge_details(g, _hub(g)).where("direction = 'in'").select("type", "other", "name", "other_type")


@register(f"SELECT n.id, n.name FROM nodes n WHERE n.id = (SELECT min(source) FROM edges WHERE target = {HUB} AND type = 'defines')")
def defined_in(spark, sf_dir):
    g = T.star_graph(spark, sf_dir)
    return find.defined_in(g, _hub(g)).select("id", "name")


@register("SELECT n.id, n.type, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'dir::ASIA' AND e.type IN ('defines', 'contains')")
def children(spark, sf_dir):
    return find.children(T.star_graph(spark, sf_dir), "dir::ASIA").select("id", "type", "name")


@register("SELECT n.id FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'dir::ASIA/NATION_2' AND e.type IN ('defines', 'contains') AND n.type = 'file'")
def children_typed(spark, sf_dir):
    return find.children(T.star_graph(spark, sf_dir), "dir::ASIA/NATION_2", "file").select("id")


@register("SELECT source, target, type FROM edges WHERE source IN (SELECT id FROM nodes WHERE type <> 'function') AND target IN (SELECT id FROM nodes WHERE type <> 'function')")
def induced_edges(spark, sf_dir):
    g = T.star_graph(spark, sf_dir)
    return find.induced(g, g.nodes.where("type <> 'function'")).select("source", "target", "type")


@register("SELECT n.id, e.source AS parent FROM nodes n LEFT JOIN (SELECT * FROM edges WHERE type = 'contains') e ON e.target = n.id WHERE n.type IN ('directory', 'file')")
def tree_edges(spark, sf_dir):
    return find.tree(T.star_graph(spark, sf_dir)).select("id", "parent")


@register("SELECT e.source AS parent, count(*) FILTER (n.type = 'directory') AS dirs, count(*) FILTER (n.type = 'file') AS files"
          " FROM edges e JOIN nodes n ON n.id = e.target WHERE e.type = 'contains' GROUP BY 1")  # fmt: skip
def tree_child_counts(spark, sf_dir):
    return find.tree_counts(T.star_graph(spark, sf_dir))


@register("SELECT DISTINCT p AS path, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS parent,"
          " regexp_extract(p, '[^/]*$') AS name FROM (SELECT unnest([array_to_string(s[:k], '/') for k in range(1, len(s))]) AS p"
          " FROM (SELECT string_split(path, '/') AS s FROM nodes WHERE type = 'file'))")  # fmt: skip
def directory_lineage(spark, sf_dir):
    return find.lineage(T.star_graph(spark, sf_dir).nodes.where("type = 'file'").select("path"))


# Degrees and clouds


@register("SELECT * FROM degrees")
def degree(spark, sf_dir):
    return rank.degree(T.star_graph(spark, sf_dir))


def _cloud(mode: str, top: int, least: int) -> None:
    sql = f"""SELECT name, value, count, total FROM (SELECT name, CAST(sum(degree) AS DOUBLE) AS value, count(*) AS count,
      count(*) OVER () AS total FROM nodes JOIN degrees USING (id)
      WHERE type NOT IN ('directory', 'file', 'import') AND name <> '' GROUP BY name)
      WHERE value >= {least} ORDER BY value DESC, name LIMIT {top}"""

    def query(spark, sf_dir):
        return rank.word_cloud(T.star_graph(spark, sf_dir), mode)

    query.__name__ = f"wordcloud_{mode}"
    register(sql)(query)


_cloud("strong", 30, 2)
_cloud("relevant", 100, 2)
_cloud("all", 500, 0)


@register("SELECT type, CAST(dense_rank() OVER (ORDER BY type) - 1 AS INT) AS category FROM (SELECT DISTINCT type FROM nodes)")
def category_index(spark, sf_dir):
    return rank.category_index(T.star_graph(spark, sf_dir).nodes)


_CAPPED = """top AS (SELECT id, type, degree FROM nodes JOIN degrees USING (id) WHERE type IN ('class', 'function', 'method')
  ORDER BY degree DESC, id LIMIT 200)"""


def _capped(spark, sf_dir):  # noqa: ANN001, ANN202
    return rank.capped(T.star_graph(spark, sf_dir), types=["class", "function", "method"], limit=200, max_edges=300)


@register(f", {_CAPPED} SELECT id, type, degree, CAST(dense_rank() OVER (ORDER BY type) - 1 AS INT) AS category, CAST(least(greatest("
          "trunc(10 + degree / (SELECT max(degree) FROM top) * 40), 10), 50) AS INT) AS symbol_size FROM top")  # fmt: skip
def capped_nodes(spark, sf_dir):
    return _capped(spark, sf_dir)[0].select("id", "type", "degree", "category", "symbol_size")


@register(f", {_CAPPED} SELECT source, target, e.type FROM edges e JOIN top a ON a.id = source JOIN top b ON b.id = target"
          " ORDER BY a.degree + b.degree DESC, source, target LIMIT 300")  # fmt: skip
def capped_edges(spark, sf_dir):
    return _capped(spark, sf_dir)[1]


# Traversals


def _bfs(name: str, direction: str, types: str | None, depth: int, start: tuple = (HUB, _hub)) -> None:
    pairs = {
        "out": "SELECT source AS here, target AS there, type FROM edges",
        "in": "SELECT target AS here, source AS there, type FROM edges",
    }
    pairs["both"] = f"{pairs['out']} UNION ALL {pairs['in']}"
    cond = f"WHERE type IN ({', '.join(repr(t) for t in types.split(','))})" if types else ""
    sql = f"""pairs AS (SELECT * FROM ({pairs[direction]}) {cond}),
      bfs AS (SELECT {start[0]} AS id, 0 AS depth UNION SELECT there, depth + 1 FROM bfs JOIN pairs ON here = id WHERE depth < {depth})
      SELECT b.id, min(depth) AS depth, any_value(n.type) AS type FROM bfs b JOIN nodes n ON n.id = b.id WHERE depth > 0 GROUP BY b.id"""

    def query(spark, sf_dir):
        g = T.star_graph(spark, sf_dir)
        found = traverse.neighbors(g, start[1](g), depth, types.split(",") if types else None, direction)
        return found.select("id", "depth", "type")

    query.__name__ = name
    register(sql, recursive=True)(query)


_bfs("callees_d1", "out", "calls", 1)
_bfs("callees_d3", "out", "calls", 3)
_bfs("callers_d1", "in", "calls", 1, (USED, _used))
_bfs("callers_d2", "in", "calls", 2, (USED, _used))
_bfs("references_d2", "both", None, 2)
_bfs("neighbors_typed", "both", "defines,contains", 3)


@register("""starts AS (SELECT id AS origin FROM coords WHERE abs(x - 100) <= 20 AND abs(y - 100) <= 20
    ORDER BY abs(x - 100) + abs(y - 100), id LIMIT 20),
  bfs AS (SELECT origin, origin AS id, 0 AS depth FROM starts
    UNION SELECT origin, target, depth + 1 FROM bfs JOIN edges ON source = id AND type = 'calls' WHERE depth < 2)
  SELECT origin, id, min(depth) AS depth FROM bfs WHERE id <> origin AND id IN (SELECT id FROM coords) GROUP BY 1, 2""", recursive=True)
def spatial_structural(spark, sf_dir):
    return spatial.with_neighbors(T.star_graph(spark, sf_dir), 100.0, 100.0, 20.0, depth=2)


def _entry_sql(levels: int) -> str:
    out = ["d0 AS (SELECT id, 0 AS depth FROM nodes WHERE id NOT IN (SELECT target FROM edges WHERE type = 'calls'))"]
    for k in range(1, levels + 1):
        out.append(f"""d{k} AS (SELECT * FROM d{k - 1} UNION ALL SELECT DISTINCT target, {k} FROM edges
          WHERE type IN ('calls', 'defines') AND source IN (SELECT id FROM d{k - 1} WHERE depth = {k - 1})
          AND target NOT IN (SELECT id FROM d{k - 1}))""")
    return ",".join(out)


@register(f""", {_entry_sql(6)} SELECT n.id, round(CASE WHEN depth IS NULL THEN 180.0 ELSE depth / greatest((SELECT max(depth) FROM d6), 1) * 360.0 END, 6) AS y
  FROM nodes n LEFT JOIN d6 USING (id)""")
def entry_depth(spark, sf_dir):
    return traverse.entry_depth(T.star_graph(spark, sf_dir)).select("id", F.round("y", 6).alias("y"))


def _pagerank_sql(steps: int) -> str:
    out = ["""size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes), outs AS (SELECT source, count(*) AS k FROM edges GROUP BY 1),
      r0 AS (SELECT id, 1.0 / n AS rank FROM nodes, size)"""]
    for k in range(1, steps + 1):
        out.append(f"""r{k} AS MATERIALIZED (SELECT id, 0.85 * coalesce(s, 0) + 0.15 / n + 0.85 * l / n AS rank FROM nodes
          LEFT JOIN (SELECT target, sum(rank / k) AS s FROM edges JOIN r{k - 1} ON id = source JOIN outs USING (source) GROUP BY 1) ON target = id,
          size, (SELECT coalesce(sum(rank), 0) AS l FROM r{k - 1} WHERE id NOT IN (SELECT source FROM outs)))""")
    return ",".join(out)


@register(f", {_pagerank_sql(5)} SELECT id, round(rank * n, 4) AS rank FROM r5, size")
def pagerank_k5(spark, sf_dir):
    g = T.star_graph(spark, sf_dir)
    n = g.nodes.count()
    return rank.pagerank(g, max_iter=5, tol=None).select("id", F.round(F.col("rank") * n, 4).alias("rank"))


@register(f", {_pagerank_sql(10)} SELECT id, round(rank * n, 4) AS rank FROM r10, size")
def pagerank_k10(spark, sf_dir):
    g = T.star_graph(spark, sf_dir)
    n = g.nodes.count()
    return rank.pagerank(g, max_iter=10, tol=None).select("id", F.round(F.col("rank") * n, 4).alias("rank"))


@register()
def importance_z(spark, sf_dir):
    return rank.importance(T.star_graph(spark, sf_dir))


@register("""SELECT id, CASE WHEN contains(lower(path), 'test_') OR contains(lower(path), '_test') OR contains(lower(path), '/tests/')
    OR starts_with(lower(path), 'tests/') THEN 6
  WHEN regexp_matches(lower(path), 'config|settings|env') THEN 5 WHEN type = 'variable' THEN 5
  WHEN regexp_matches(lower(path), 'util|helper|format|common') THEN 4
  WHEN regexp_matches(lower(path), 'storage|db|data|model|store') THEN 3
  WHEN NOT called AND type IN ('function', 'method') THEN 1 WHEN called AND calls THEN 2
  WHEN type IN ('function', 'method', 'class') THEN 2 ELSE 1 END
  * CASE WHEN starts_with(name, '_') AND NOT starts_with(name, '__') THEN -1 ELSE 1 END AS face
  FROM (SELECT *, id IN (SELECT target FROM edges WHERE type = 'calls') AS called,
    id IN (SELECT source FROM edges WHERE type = 'calls') AS calls FROM nodes)""")
def face_assign(spark, sf_dir):
    return rank.faces(T.star_graph(spark, sf_dir))


@register()
def projection_x(spark, sf_dir):
    return rank.projection(T.star_vectors(spark, sf_dir)).select("id", F.round("x", 3).alias("x"))


@register()
def coordinates(spark, sf_dir):
    """The whole graph; a part has the embedding whose vec_id is its key, other nodes have none."""
    g = T.star_graph(spark, sf_dir)
    key = F.regexp_extract("id", "^class::.*::([0-9]+)$", 1)
    parts = g.nodes.select(F.col("id").alias("node"), F.when(key != "", key).cast("long").alias("id"))
    vectors = T.star_vectors(spark, sf_dir).join(parts, "id").select(F.col("node").alias("id"), "embedding")
    return rank.coordinates(g, vectors)


# Coordinates


@register("SELECT id, round(abs(x - 180) + abs(y - 90), 6) AS distance FROM coords WHERE abs(x - 180) <= 30 AND abs(y - 90) <= 30 AND z >= 0.25"
          " ORDER BY abs(x - 180) + abs(y - 90), id LIMIT 20")  # fmt: skip
def spatial_range(spark, sf_dir):
    found = spatial.in_range(T.star_graph(spark, sf_dir).nodes, 180.0, 90.0, 30.0, 0.25)
    return found.select("id", F.round("distance", 6).alias("distance"))


@register("SELECT id, round(abs(x - 180) + abs(y - 90), 6) AS distance FROM coords WHERE abs(x - 180) <= 60 AND abs(y - 90) <= 60 AND face = 3")
def spatial_range_face(spark, sf_dir):
    found = spatial.in_range(T.star_graph(spark, sf_dir).nodes, 180.0, 90.0, 60.0, top=0, face=3)
    return found.select("id", F.round("distance", 6).alias("distance"))


@register("SELECT id, z FROM coords WHERE face = -2")
def spatial_face(spark, sf_dir):
    return spatial.on_face(T.star_graph(spark, sf_dir).nodes, -2).select("id", F.col("spatial.z").alias("z"))


_CENTRE = f"c AS (SELECT x AS cx, y AS cy FROM coords WHERE id = {HUB})"


@register(f""", {_CENTRE}, near AS (SELECT id, abs(x - cx) + abs(y - cy) AS d FROM coords, c WHERE abs(x - cx) <= 30 AND abs(y - cy) <= 30 ORDER BY d, id LIMIT 21)
  SELECT id, round(d, 6) AS distance FROM near WHERE id <> {HUB} ORDER BY d, id LIMIT 20""")
def spatial_near(spark, sf_dir):
    g = T.star_graph(spark, sf_dir)
    return spatial.near(g.nodes, _hub(g)).select("id", F.round("distance", 6).alias("distance"))


@register(f""", {_CENTRE} SELECT id, CAST(CASE WHEN id = {HUB} THEN 0 ELSE greatest(1, ceil(greatest(abs(x - cx), abs(y - cy)) / 15.0)) END AS INT) AS ring
  FROM coords, c WHERE id = {HUB} OR greatest(abs(x - cx), abs(y - cy)) <= 60""")
def spatial_walk(spark, sf_dir):
    g = T.star_graph(spark, sf_dir)
    return spatial.walk(g.nodes, _hub(g), 15.0, 4).select("id", "ring")


# Vectors


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return T.star_vectors(spark, sf_dir).where("id = 1").first()["embedding"]


_COSINE = """FROM (SELECT vec_id AS id, 'label' || label AS type, CASE WHEN list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
  THEN list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) ELSE 0 END AS s FROM embeddings)"""


@register(f"SELECT id, round(s, 6) AS score {_COSINE} ORDER BY s DESC, id LIMIT 10", graph=False)
def cosine_topk(spark, sf_dir):
    return vector.top(T.star_vectors(spark, sf_dir), _query_vector(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@register(f"SELECT id, round(s, 6) AS score {_COSINE} WHERE type = 'label2' ORDER BY s DESC, id LIMIT 10", graph=False)
def cosine_topk_typed(spark, sf_dir):
    found = vector.top(T.star_vectors(spark, sf_dir), _query_vector(spark, sf_dir), node_type="label2")
    return found.select("id", F.round("score", 6).alias("score"))


@register(f"SELECT id, round(s, 6) AS score {_COSINE} WHERE s <> 0 ORDER BY s DESC, id LIMIT 25", graph=False)
def cosine_nonzero(spark, sf_dir):
    found = vector.top(T.star_vectors(spark, sf_dir), _query_vector(spark, sf_dir), k=25, drop_zero=True)
    return found.select("id", F.round("score", 6).alias("score"))


@register()
def ann_topk(spark, sf_dir):
    index = vector.InvertedFile(T.star_vectors(spark, sf_dir))
    return index.search(_query_vector(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@register("""SELECT id, string_agg(q, ',' ORDER BY k) AS matched FROM (
  SELECT * FROM (SELECT id, 1 AS k, 'ring' AS q FROM nodes WHERE contains(lower(name), 'ring') ORDER BY id LIMIT 10)
  UNION ALL SELECT * FROM (SELECT id, 2, 'red' FROM nodes WHERE contains(lower(name), 'red') ORDER BY id LIMIT 10)
  UNION ALL SELECT * FROM (SELECT id, 3, 'small' FROM nodes WHERE contains(lower(name), 'small') ORDER BY id LIMIT 10)) GROUP BY id""")
def multi_query_merge(spark, sf_dir):
    found = vector.multi_find(T.star_graph(spark, sf_dir).nodes, ["ring", "red", "small"])
    return found.select("id", F.array_join("matched", ",").alias("matched"))


@register("SELECT id FROM nodes WHERE contains(lower(name), 'bolt') ORDER BY id LIMIT 10")
def hybrid_search(spark, sf_dir):
    return vector.search(T.star_graph(spark, sf_dir).nodes, "bolt", None).select("id")


# Texts


@register(f"WITH {TEXT_SQL} SELECT path, n AS line_no, text FROM lines WHERE contains(text, 'the') QUALIFY row_number() OVER (PARTITION BY path ORDER BY n) <= 200", graph=False)
def grep_literal(spark, sf_dir):
    return text.grep(T.star_texts(spark, sf_dir), "the", regex=False, context=0).select("path", "line_no", "text")


@register(f"""WITH {TEXT_SQL} SELECT path, n AS line_no, array_to_string(p[greatest(1, n - 2):n - 1], chr(10)) AS before,
  array_to_string(p[n + 1:n + 2], chr(10)) AS after FROM lines JOIN kept USING (path) WHERE regexp_matches(text, 'licen[cs]e|License')""", graph=False)
def grep_context(spark, sf_dir):
    found = text.grep(T.star_texts(spark, sf_dir), "licen[cs]e|License", context=2)
    return found.select(
        "path", "line_no", F.array_join("context_before", "\n").alias("before"), F.array_join("context_after", "\n").alias("after")
    )


@register(f"""WITH {TEXT_SQL}, hits AS (SELECT path, n AS line_no, length(text) + list_sum([0] || [length(x) FOR x IN p[greatest(1, n - 1):n - 1] || p[n + 1:n + 1]]) AS size
  FROM lines JOIN kept USING (path) WHERE contains(text, 'of') AND starts_with(path, 'docs/') ORDER BY path, line_no LIMIT 500)
  SELECT path, line_no FROM (SELECT *, sum(size) OVER (ORDER BY path, line_no) - size AS b FROM hits) WHERE b < 200000""", graph=False)
def project_search(spark, sf_dir):
    return text.project_grep(T.star_texts(spark, sf_dir), "of", "*.txt", regex=False, context=1).select("path", "line_no")


@register(f"WITH {TEXT_SQL} SELECT n, text FROM lines WHERE path = 'docs/en/6.txt' AND n BETWEEN 2 AND 9", graph=False)
def file_section(spark, sf_dir):
    return text.section(T.star_texts(spark, sf_dir), "docs/en/6.txt", 2, 9).select("n", "text")


@register(f"WITH {TEXT_SQL} SELECT path, CAST(CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 - CAST(ends_with(content, chr(10)) AS INT) END AS INT) AS lines,"
          " CAST(octet_length(encode(content)) AS INT) AS size, md5(content) AS md5, 'text' AS language FROM texts", graph=False)  # fmt: skip
def file_stats(spark, sf_dir):
    return text.file_stats(T.star_texts(spark, sf_dir))


@register(f"WITH {TEXT_SQL} SELECT path, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY path", graph=False)
def line_counts(spark, sf_dir):
    return text.lines(T.star_texts(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("n"))


def _parents_sql() -> str:
    """For each level, the last earlier heading of it; the parent is the latest of those of smaller levels."""
    before = "OVER (PARTITION BY path ORDER BY line_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    last = ", ".join(f"CASE WHEN level > {k} THEN max(CASE WHEN level = {k} THEN line_start END) {before} END" for k in range(1, 6))
    return f"greatest({last})"


@register(f"""WITH {TEXT_SQL}, h AS (SELECT path, n AS line_start, CAST(length(text) % 6 + 1 AS INT) AS level, substr(text, 1, 20) AS name FROM lines),
  up AS (SELECT *, {_parents_sql()} AS parent_line, coalesce(lead(line_start) OVER (PARTITION BY path ORDER BY line_start) - 1, count(*) OVER (PARTITION BY path)) AS line_end FROM h)
  SELECT up.path, up.line_start, up.level, up.name, CAST(line_end AS INT) AS line_end, h.name AS parent_section
  FROM up LEFT JOIN h ON h.path = up.path AND h.line_start = up.parent_line""", graph=False)
def section_spans(spark, sf_dir):
    """Lines as headings: their level is their length modulo 6, from 1."""
    rows = text.lines(T.star_texts(spark, sf_dir))
    heads = rows.select("path", F.col("n").alias("line_start"), (F.length("text") % 6 + 1).alias("level"), F.substring("text", 1, 20).alias("name"))
    return text.spans(heads, rows.groupBy("path").agg(F.count("*").alias("lines")))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", graph=False)
def json_keys(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", F.expr("variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))


@register("SELECT n_nationkey, 'key: ' || n_nationkey || '; name: ' || n_name AS line FROM nation", graph=False)
def csv_flatten(spark, sf_dir):
    head = F.array(F.lit("key"), F.lit("name"))
    row = F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))
    return T.table(spark, sf_dir, "nation").select("n_nationkey", text.flatten_csv(head, row).alias("line"))


@register("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages", graph=False)
def html_titles(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@register("""SELECT page_id, CASE WHEN regexp_matches(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//|^(mailto|tel):') THEN 'external'
  WHEN starts_with(url, '#') THEN 'anchor' ELSE 'internal' END AS kind FROM pages""", graph=False)
def link_kinds(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", paths.link_kind(F.col("url")).alias("kind"))


@register("SELECT id FROM nodes WHERE type = 'file' AND regexp_matches(name, '^Customer#.*[13]$')")
def glob_match(spark, sf_dir):
    rx = paths.glob_regex("Customer#*[13]")
    return T.star_graph(spark, sf_dir).nodes.where((F.col("type") == "file") & F.col("name").rlike(rx)).select("id")


# Names and dependencies


@register("SELECT DISTINCT split_part(target, '::', 2) AS file, split_part(source, '::', 2) AS dependent FROM edges WHERE type IN ('calls', 'imports') AND split_part(target, '::', 2) <> split_part(source, '::', 2)")
def dep_index(spark, sf_dir):
    return changes.dependencies(T.star_graph(spark, sf_dir))


def _affected(name: str, hops: int) -> None:
    sql = f"""deps AS (SELECT DISTINCT split_part(target, '::', 2) AS file, split_part(source, '::', 2) AS dependent FROM edges
        WHERE type IN ('calls', 'imports') AND split_part(target, '::', 2) <> split_part(source, '::', 2)),
      a AS (SELECT path AS rel_path, 0 AS hop FROM part_ids WHERE p_partkey = 1 UNION
        SELECT dependent, hop + 1 FROM a JOIN deps ON file = rel_path WHERE hop < {hops})
      SELECT rel_path, min(hop) AS hop FROM a GROUP BY 1"""

    def query(spark, sf_dir):
        g = T.star_graph(spark, sf_dir)
        dirty = g.nodes.where("id like 'class::%::1'").select(F.col("path").alias("rel_path"))
        return traverse.affected(changes.dependencies(g), dirty, hops)

    query.__name__ = name
    register(sql, recursive=True)(query)


_affected("affected_files_h1", 1)
_affected("affected_files_h2", 2)

_SYMBOLS = """keyed AS (SELECT id, path, line_start, name AS k FROM nodes WHERE type IN ('function', 'class', 'variable')
    UNION ALL SELECT id, path, line_start, replace(path, '/', '.') || '.' || name FROM nodes WHERE type IN ('function', 'class', 'variable')),
  symbols AS (SELECT k AS name, id AS target FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY path DESC, coalesce(line_start, 0) DESC, id DESC) = 1)"""


def _symbols(g: Graph) -> DataFrame:
    plain = g.nodes.where("type <> 'method'").withColumns({"parent_class": F.lit(None).cast("string"), "line": F.lit(None).cast("int")})
    return resolve.symbols(plain)


@register(f", {_SYMBOLS} SELECT * FROM symbols")
def symbol_table(spark, sf_dir):
    return _symbols(T.star_graph(spark, sf_dir))


@register(f""", {_SYMBOLS}, called AS (SELECT id AS caller, CASE WHEN o_orderkey % 3 = 0 THEN 'small ring' WHEN o_orderkey % 3 = 1 THEN 'self.red widget' ELSE 'unknown' END AS name,
    CAST(o_orderkey % 9 AS INT) AS line FROM order_ids)
  SELECT caller AS source, s.target, line AS call_line FROM called JOIN symbols s ON s.name = CASE WHEN called.name LIKE 'self.%' THEN substr(called.name, 6) ELSE called.name END
  WHERE s.target <> caller""")
def resolve_calls(spark, sf_dir):
    g = T.star_graph(spark, sf_dir)
    key = F.element_at(F.split("id", "::"), -1).try_cast("long")
    name = F.when(key % 3 == 0, "small ring").when(key % 3 == 1, "self.red widget").otherwise("unknown")
    called = g.nodes.where("type = 'function'").select(
        F.col("id").alias("caller"), "path", name.alias("name"), F.array().cast("array<string>").alias("args"), (key % 9).cast("int").alias("line")
    )
    imports = spark.createDataFrame([], "path string, module string, names array<string>, alias string, line int")
    return resolve.calls(called, imports, _symbols(g)).select("source", "target", "call_line")


@register("""SELECT l_orderkey AS source, l_partkey AS target, max_by(type, phase) AS type FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'contains' WHEN 'N' THEN 'calls' ELSE 'imports' END AS type,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 5 ELSE 2 END AS phase FROM lineitem) GROUP BY 1, 2""", graph=False)
def one_edge_per_pair(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "contains").when(F.col("l_returnflag") == "N", "calls").otherwise("imports")
    return unique_edges(
        T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), kind.alias("type"))
    )


# Changes

_OLD = "SELECT id, name, line_start FROM nodes WHERE key % 11 <> 3 OR key IS NULL"
_NEW = "SELECT id, CASE WHEN key % 13 = 5 THEN name || 'x' ELSE name END AS name, line_start FROM nodes WHERE key % 11 <> 4 OR key IS NULL"


def _versions(g: Graph) -> tuple[DataFrame, DataFrame]:
    key = F.when(F.col("spatial").isNotNull(), F.element_at(F.split("id", "::"), -1).try_cast("long"))
    base = g.nodes.select("id", "name", "line_start", key.alias("_key"))
    old = base.where("_key % 11 <> 3 or _key is null").drop("_key")
    new = base.where("_key % 11 <> 4 or _key is null").withColumn(
        "name", F.when(F.col("_key") % 13 == 5, F.concat("name", F.lit("x"))).otherwise(F.col("name"))
    )
    return old, new.drop("_key")


@register(f""", o AS ({_OLD}), n AS ({_NEW}) SELECT id, 'added' AS op FROM n WHERE id NOT IN (SELECT id FROM o)
  UNION ALL SELECT id, 'removed' FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT o.id, 'modified' FROM o JOIN n USING (id) WHERE o.name IS DISTINCT FROM n.name""")
def node_diff(spark, sf_dir):
    return changes.node_diff(*_versions(T.star_graph(spark, sf_dir)))


@register(""", o AS (SELECT source, target, type FROM edges WHERE hash_mod(target) <> 1), n AS (SELECT source, target, CASE WHEN type = 'inherits' THEN 'calls' ELSE type END AS type FROM edges WHERE hash_mod(source) <> 1)
  SELECT *, 'added' AS op FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)"""
          .replace("hash_mod(target)", "length(target) % 5").replace("hash_mod(source)", "length(source) % 5"))
def edge_diff(spark, sf_dir):
    e = T.star_graph(spark, sf_dir).edges
    old = e.where("length(target) % 5 <> 1")
    new = e.where("length(source) % 5 <> 1").withColumn("type", F.when(F.col("type") == "inherits", "calls").otherwise(F.col("type")))
    return changes.edge_diff(old, new)


_STATES = """WITH base AS (SELECT o_orderkey AS k, 'orders/' || o_orderkey AS rel_path, o_orderstatus || '|' || o_custkey AS c FROM orders),
  old AS (SELECT rel_path, c, k AS m FROM base WHERE k % 11 <> 3),
  new AS (SELECT rel_path, CASE WHEN k % 13 = 5 THEN c || 'x' ELSE c END AS c, CASE WHEN k % 13 = 5 OR k % 17 = 1 THEN k + 1 ELSE k END AS m FROM base WHERE k % 11 <> 4)"""


@register(f"""{_STATES} SELECT coalesce(o.rel_path, n.rel_path) AS rel_path, CASE WHEN o.rel_path IS NULL THEN 'added' WHEN n.rel_path IS NULL THEN 'deleted' ELSE 'modified' END AS op
  FROM old o FULL JOIN new n ON o.rel_path = n.rel_path WHERE o.c IS DISTINCT FROM n.c""", graph=False)
def dirty_files(spark, sf_dir):
    return changes.dirty_files(*T.star_states(spark, sf_dir))


@register(f"{_STATES} SELECT rel_path, m AS mtime_ns FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.rel_path = n.rel_path AND o.m = n.m AND length(o.c) = length(n.c))", graph=False)
def stat_prefilter(spark, sf_dir):
    old, new = T.star_states(spark, sf_dir)
    return changes.to_read(old, new).select("rel_path", "mtime_ns")


# Notes, chats, runs

_NOTES = """WITH notes AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'note' ELSE 'tag' END AS type,
  CASE WHEN doc_id % 2 = 0 THEN 'docs/' || doc_id END AS file_path, CASE WHEN doc_id % 2 = 1 THEN 'node' || doc_id END AS node_id,
  ['q' || quality, 't' || toxic] AS tags FROM labels)"""


@register(f"{_NOTES} SELECT id, type FROM notes WHERE list_contains(tags, 't1')", graph=False)
def annotation_by_tag(spark, sf_dir):
    return notes.by_tag(T.star_notes(spark, sf_dir), "t1").select("id", "type")


@register(f"{_NOTES} SELECT id FROM notes WHERE file_path = (SELECT 'docs/' || min(doc_id) FROM labels WHERE doc_id % 2 = 0)", graph=False)
def annotation_by_target(spark, sf_dir):
    first = T.table(spark, sf_dir, "labels").where("doc_id % 2 = 0").agg(F.min("doc_id")).first()[0]
    return notes.by_target(T.star_notes(spark, sf_dir), file_path=f"docs/{first}").select("id")


def _remap(spark, sf_dir):  # noqa: ANN001, ANN202
    ids = T.table(spark, sf_dir, "labels").select("doc_id")
    moves = ids.where("doc_id % 6 = 0").select(F.concat(F.lit("docs/"), "doc_id").alias("old"), F.concat(F.lit("moved/"), "doc_id").alias("new"))
    remap = ids.where("doc_id % 5 = 1").select(
        F.concat(F.lit("node"), "doc_id").alias("old"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("new"), "doc_id")).alias("new")
    )
    return notes.retarget(T.star_notes(spark, sf_dir), moves, remap)


@register(f"""{_NOTES} SELECT id, CASE WHEN file_path IS NOT NULL AND CAST(id AS INT) % 6 = 0 THEN 'moved/' || id ELSE file_path END AS file_path,
  CASE WHEN node_id IS NOT NULL AND CAST(id AS INT) % 5 = 1 AND CAST(id AS INT) % 3 <> 0 THEN 'new' || id ELSE node_id END AS node_id,
  node_id IS NOT NULL AND CAST(id AS INT) % 5 = 1 AND CAST(id AS INT) % 3 = 0 AS stale FROM notes""", graph=False)
def annotation_remap(spark, sf_dir):
    return _remap(spark, sf_dir)[0].select("id", "target.file_path", "target.node_id", "stale")


@register(f"""{_NOTES} SELECT count(*) FILTER ((file_path IS NOT NULL AND CAST(id AS INT) % 6 = 0) OR (node_id IS NOT NULL AND CAST(id AS INT) % 5 = 1 AND CAST(id AS INT) % 3 <> 0)) AS remapped,
  count(*) FILTER (node_id IS NOT NULL AND CAST(id AS INT) % 5 = 1 AND CAST(id AS INT) % 3 = 0) AS stale FROM notes""", graph=False)
def annotation_remap_counts(spark, sf_dir):
    return _remap(spark, sf_dir)[1]


@register(f"{_NOTES} SELECT count(*) AS newly_stale FROM notes WHERE file_path IS NOT NULL AND CAST(id AS INT) % 4 <> 0", graph=False)
def annotation_validate(spark, sf_dir):
    files = T.table(spark, sf_dir, "labels").where("doc_id % 4 = 0").select(F.concat(F.lit("docs/"), "doc_id").alias("path"))
    return notes.validate_files(T.star_notes(spark, sf_dir), files)[1]


@register("SELECT quality, array_to_string(list_sort([x FOR x IN list(CAST(doc_id AS VARCHAR)) IF x <> '2']), ',') AS ids FROM labels GROUP BY quality", graph=False)
def collection_prune(spark, sf_dir):
    made = T.table(spark, sf_dir, "labels").groupBy("quality").agg(F.collect_list(F.col("doc_id").cast("string")).alias("annotation_ids"))
    return notes.without_member(made, "2").select("quality", F.array_join(F.sort_array("annotation_ids"), ",").alias("ids"))


@register("""SELECT conv_id, count(*) AS messages, coalesce(CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '...' ELSE t END, 'New Chat') AS title FROM conversations
  LEFT JOIN (SELECT conv_id, min_by(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1) USING (conv_id) GROUP BY conv_id, t""", graph=False)
def thread_summary(spark, sf_dir):
    return notes.thread_summary(T.table(spark, sf_dir, "conversations"))


@register("""SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'the') AND conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id DESC LIMIT 100)
  ORDER BY conv_id DESC LIMIT 20""", graph=False)
def session_search(spark, sf_dir):
    return notes.search_sessions(T.table(spark, sf_dir, "conversations"), "THE")


@register("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2", graph=False)
def session_prune(spark, sf_dir):
    return notes.keep_last(T.table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn")


@register("SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id DESC LIMIT 20", graph=False)
def session_recent(spark, sf_dir):
    return T.table(spark, sf_dir, "conversations").select("conv_id").distinct().orderBy(F.desc("conv_id")).limit(20)


@register("""SELECT count(*) AS total_runs, round(avg(value), 6) AS avg_duration_ms, CAST(sum(user_id % 100) AS BIGINT) AS total_files_indexed,
  CAST(sum(event_id % 7) AS BIGINT) AS total_edges_added, CAST(sum(event_id % 5) AS BIGINT) AS total_edges_removed,
  (SELECT string_agg(event_type, ',' ORDER BY event_type) FROM (SELECT DISTINCT event_type FROM events)) AS strategies FROM events""", graph=False)
def reindex_summary(spark, sf_dir):
    return changes.run_summary(T.star_runs(spark, sf_dir)).withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


@register("SELECT count(*) FILTER (event_type <> 'error') >= 50 AS force FROM (SELECT * FROM events ORDER BY ts DESC LIMIT 50)", graph=False)
def force_full(spark, sf_dir):
    runs = T.star_runs(spark, sf_dir).withColumn("strategy", F.when(F.col("strategy") == "error", "full").otherwise(F.col("strategy")))
    return changes.force_full(runs)


@register("SELECT ts AS started_at, event_type AS strategy FROM events ORDER BY ts DESC LIMIT 100", graph=False)
def run_history(spark, sf_dir):
    return changes.last_runs(T.star_runs(spark, sf_dir)).select("started_at", "strategy")


# Streams, and their batch twins


@register("""SELECT user_id, min(ts) AS begun, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""", graph=False)
def debounce_sessions(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    told = e.groupBy("user_id", F.session_window("ts", "10 minutes")).agg(F.count("*").alias("n"))
    return told.select("user_id", F.col("session_window.start").alias("begun"), "n")


@register("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", graph=False)
def last_event_per_key(spark, sf_dir):
    return changes.last_per_key(T.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_UNCHANGED = "SELECT event_id FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@register(_UNCHANGED, graph=False)
def dedupe_unchanged(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = T.table(spark, sf_dir, "events").withColumn("_b", F.lag("event_type").over(w))
    return e.where(~F.col("event_type").eqNullSafe(F.col("_b"))).select("event_id")


@register(_UNCHANGED, graph=False)
def stream_dedupe(spark, sf_dir):
    return stream.replay(spark, sf_dir, stream.unchanged_dropped, "event_id")


@register(ORACLES["debounce_sessions"], graph=False)
def stream_debounce(spark, sf_dir):
    return stream.replay(spark, sf_dir, stream.debounced, "user_id", "begun", "n")
