"""The three relations: read, written as versioned snapshots, or projected from the star schema."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwalk.functions.vocabulary import TIERS
from tierwalk.session import shared_folder

VERSION = "1"
_BUILT: dict[tuple[str, str, tuple], str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
FILES = "path string, language string, hash string, parsed_ok boolean"
NODES = "kind string, name string, qualified_name string, file_path string, line_start int, is_test boolean"
EDGES = "kind string, source_qname string, target_qname string, target_raw string, file_path string, line int, confidence_tier string, args array<string>"


@dataclass(frozen=True)
class Graph:
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def first_nodes(self) -> DataFrame:
        """One declaration a name: the first by file, line and kind."""
        order = Window.partitionBy("qualified_name").orderBy("file_path", "line_start", "kind")
        return self.nodes.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")

    def linked(self) -> DataFrame:
        return self.edges.where("target_qname is not null")


def load(spark: SparkSession, folder: str) -> Graph:
    """A snapshot written by `save`; another version is refused."""
    meta = {r.key: r.value for r in spark.read.schema("key string, value string").json(f"{folder}/meta").collect()}
    if meta.get("version") != VERSION:
        raise ValueError(f"snapshot has version {meta.get('version')}, this is {VERSION}")
    return _read(spark, folder)


def _read(spark: SparkSession, folder: str) -> Graph:
    def one(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{name}").select(*[c.split(" ")[0] for c in schema.split(", ")])

    return Graph(one("files", FILES), one("nodes", NODES), one("edges", EDGES))


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Lengths and times of the tables the projection reads."""
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = []
    for name in TABLES:
        at = path(f"{sf_dir}/{name}.parquet")
        status = at.getFileSystem(conf).getFileStatus(at)
        out.append((status.getLen(), status.getModificationTime()))
    return tuple(out)


def built(spark: SparkSession, sf_dir: str) -> Graph:
    """The projection of a folder's tables, written once an application as a snapshot, as an index would be, and read from it.

    Edges lie by kind and only the columns a query needs are read. Tables that change under the same path are projected anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir))
    if key not in _BUILT:
        folder = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
        save(project(spark, sf_dir), folder)
        _BUILT[key] = folder
    return _read(spark, _BUILT[key])


def save(graph: Graph, folder: str) -> None:
    """Edges are laid out by kind, so that reads of one kind skip the other folders, and in the order of their targets within a
    file, so that a point read skips most of each."""
    spark = graph.files.sparkSession
    graph.files.write.mode("overwrite").parquet(f"{folder}/files")
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.edges.sortWithinPartitions("kind", "target_qname").write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edges")
    spark.createDataFrame([("version", VERSION)], "key string, value string").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def raw_schema() -> str:
    """Of adapter output: one object a file, with its nodes and edges."""
    node = "struct<kind:string,name:string,qualified_name:string,line_start:int,is_test:boolean>"
    edge = "struct<kind:string,source_qname:string,target_qname:string,target_raw:string,line:int,confidence_tier:string,args:array<string>>"
    return f"path string, language string, hash string, parsed_ok boolean, nodes array<{node}>, edges array<{edge}>"


def from_rows(raw: DataFrame) -> Graph:
    """Repeated nodes of a file keep the first; an empty target is an unlinked one."""
    files = raw.select("path", "language", "hash", F.coalesce("parsed_ok", F.lit(True)).alias("parsed_ok")).dropDuplicates(["path"])
    nodes = raw.select(F.col("path").alias("file_path"), F.posexplode("nodes").alias("seq", "n")).select("n.kind", "n.name", "n.qualified_name", "file_path", "n.line_start", F.coalesce("n.is_test", F.lit(False)).alias("is_test"), "seq")
    edges = raw.select(F.col("path").alias("file_path"), F.explode("edges").alias("e")).select("e.kind", "e.source_qname", F.expr("nullif(e.target_qname, '')").alias("target_qname"), "e.target_raw", "file_path", "e.line", F.coalesce("e.confidence_tier", F.lit(TIERS[0])).alias("confidence_tier"), "e.args")
    return Graph(files, keep_first(nodes), edges)


def from_jsonl(spark: SparkSession, path: str) -> Graph:
    return from_rows(spark.read.schema(raw_schema()).json(path).where("path is not null"))


def empty(spark: SparkSession) -> Graph:
    return Graph(*(spark.createDataFrame([], s) for s in (FILES, NODES, EDGES)))


def keep_first(nodes: DataFrame) -> DataFrame:
    """The first of nodes of one name in one file, in the order of `seq`; nodes without a name all stay."""
    order = Window.partitionBy("qualified_name", "file_path").orderBy("seq")
    ranked = nodes.withColumn("rn", F.row_number().over(order))
    return ranked.where("rn = 1 or qualified_name is null").drop("rn", "seq")


def project(spark: SparkSession, sf_dir: str) -> Graph:
    """The star schema as a graph: customers, parts and suppliers are classes, orders are methods, lines are calls."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in TABLES}
    place = F.broadcast(t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    cust = t["customer"].join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("k"), "c_name", F.col("c_nationkey").alias("nk"), (F.col("c_mktsegment") == "MACHINERY").alias("t"), F.expr("concat('sales/', r_name, '/', c_mktsegment, '/c', c_custkey % 23, '.crm')").alias("path")
    )
    supp = t["supplier"].join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("k"), "s_name", F.col("s_nationkey").alias("nk"), F.expr("concat('supply/', r_name, '/nation_', s_nationkey, '/s', s_suppkey, '.sup')").alias("path"))
    part = t["part"].select(F.col("p_partkey").alias("k"), "p_name", F.lower("p_type").alias("type"), "p_size", F.expr("concat('catalog/', replace(p_brand, '#', '_'), '/p', p_partkey, '.prt')").alias("path"))
    kinds = t["events"].select("event_type").distinct()
    types = part.select("type").distinct()

    files = (
        cust.selectExpr("path", "'crm' as language", "true as parsed_ok")
        .union(supp.selectExpr("path", "'sup'", "k % 17 <> 3"))
        .union(part.selectExpr("path", "'prt'", "k % 29 <> 5"))
        .union(kinds.selectExpr("concat('events/', event_type, '.tbl')", "'tbl'", "true"))
        .union(types.selectExpr("concat('catalog/lib/', type, '.prt')", "'prt'", "true"))
        .distinct()
        .selectExpr("path", "language", "md5(path) as hash", "parsed_ok")
    )
    orders = t["orders"].select("o_orderkey", "o_custkey").join(cust.select(F.col("k").alias("o_custkey"), "path", "t"), "o_custkey")
    method = "concat('cust.', o_custkey, '::o', o_orderkey)"
    nodes = (
        files.selectExpr("'File' as kind", "substring_index(path, '/', -1) as name", "path as qualified_name", "path as file_path", "1 as line_start", "false as is_test")
        .union(cust.selectExpr("'Class'", "c_name", "concat('cust.', k)", "path", "cast(k div 23 + 1 as int)", "t"))
        .union(orders.selectExpr("'Method'", "concat('o', o_orderkey)", method, "path", "cast(o_orderkey % 1000 + 1 as int)", "t"))
        .union(part.selectExpr("'Class'", "p_name", "concat('part.', k)", "path", "1", "false"))
        .union(supp.selectExpr("'Class'", "s_name", "concat('supp.', k)", "path", "1", "false"))
        .union(cust.select("nk", "path").union(supp.select("nk", "path")).distinct().selectExpr("'Namespace'", "concat('nation_', nk)", "concat('nation.', nk)", "path", "1", "false"))
        .union(types.selectExpr("'Function'", "concat('price_', type)", "concat('fn.price_', type)", "concat('catalog/lib/', type, '.prt')", "1", "false"))
        .union(kinds.selectExpr("'Table'", "event_type", "concat('evt.', event_type)", "concat('events/', event_type, '.tbl')", "1", "false"))
        .union(kinds.selectExpr("event_type", "explode(array('value', 'props', 'user_id')) as c").selectExpr("'Column'", "c", "concat('evt.', event_type, '::', c)", "concat('events/', event_type, '.tbl')", "2", "false"))
    )
    none = "cast(null as array<string>) as args"
    # A line becomes its call and its creation before either is made distinct: as numbers, and where the lines of its order
    # are already. So lines are moved once, and strings are built where they are written.
    said = "cast(if(l_tax = 0, 16, 0) + if(l_linestatus = 'O', 8, 0) + if(l_quantity < 10, 4, 0) + case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end as int) as said"
    lines = t["lineitem"].selectExpr("l_orderkey as o_orderkey", "l_partkey", "l_suppkey", "l_linenumber", said).join(orders.drop("t"), "o_orderkey")
    lines = lines.selectExpr("o_custkey", "o_orderkey", "path", "inline(array(struct(true as call, l_partkey as k, l_linenumber as line, said), struct(false as call, l_suppkey as k, 0 as line, 0 as said)))").distinct()
    named = "concat(if(call, 'part.', 'supp.'), k)"
    uses_of_lines = lines.selectExpr(
        "if(call, 'CALLS', 'NEW') as kind", f"{method} as source_qname", f"if(said >= 16, null, {named}) as target_qname", f"{named} as target_raw", "path as file_path", "line",
        "case said & 3 when 2 then 'DYNAMIC' when 1 then 'HEURISTIC' else 'RESOLVED' end as confidence_tier", "if(call, array(if(said & 8 = 8, 'true', 'false'), if(said & 4 = 4, 'null', null)), null) as args",
    )
    extends = part.where("k > 0").selectExpr("'EXTENDS'", "concat('part.', k)", "concat('part.', k div 2)", "concat('part.', k div 2)", "path", "1", "'RESOLVED'", none)
    contains = orders.selectExpr("'CONTAINS'", "concat('cust.', o_custkey)", method, method, "path", "cast(o_orderkey % 1000 + 1 as int)", "'RESOLVED'", none)
    columns = nodes.where("kind = 'Column'").selectExpr("'CONTAINS'", "substring_index(qualified_name, '::', 1)", "qualified_name", "qualified_name", "file_path", "2", "'RESOLVED'", none)
    paths = part.selectExpr("k as partkey", "path as part_path")
    includes = t["lineitem"].groupBy("l_suppkey").agg(F.min("l_partkey").alias("partkey")).join(supp, F.col("l_suppkey") == F.col("k")).join(paths, "partkey").selectExpr("'INCLUDES'", "path", "part_path", "part_path", "path", "1", "'RESOLVED'", none)
    imports = t["lineitem"].groupBy("l_partkey").agg(F.min("l_suppkey").alias("sk")).join(part, F.col("l_partkey") == F.col("k")).selectExpr("'IMPORTS'", "concat('part.', k)", "concat('supp.', sk)", "concat('supp.', sk)", "path", "2", "'RESOLVED'", none)
    back = t["orders"].groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")).join(supp, F.col("o_custkey") == F.col("k")).selectExpr("'CALLS'", "concat('supp.', k)", method, method, "path", "3", "'RESOLVED'", none)
    priced = part.selectExpr("'CALLS'", "concat('part.', k)", "cast(null as string)", "concat('price_', type)", "path", "p_size", "'RESOLVED'", none)
    # Distinct while a name is a number and an event type.
    seen = t["events"].selectExpr("user_id as k", "event_type", "if(value < 100, '::value', '') as member", "coalesce(value >= 200, false) as read", "coalesce(value < 10, false) as weak", "cast(event_id % 50 + 1 as int) as line")
    seen = seen.join(cust.select("k", "path"), "k").select("k", "path", "event_type", "member", "read", "weak", "line").distinct()
    column = "concat('evt.', event_type, member)"
    uses = seen.selectExpr("if(read, 'READS', 'WRITES')", "concat('cust.', k)", column, column, "path", "line", "if(weak, 'HEURISTIC', 'RESOLVED')", none)
    edges = uses_of_lines
    for more in (extends, contains, columns, includes, imports, back, priced, uses):
        edges = edges.union(more)
    return Graph(files, nodes, edges)


#: The same projection for DuckDB, as the head of a query.
SQL = """
WITH RECURSIVE place AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey k, c_name, c_nationkey nk, c_mktsegment = 'MACHINERY' t, 'sales/' || r_name || '/' || c_mktsegment || '/c' || (c_custkey % 23) || '.crm' path FROM customer JOIN place ON c_nationkey = n_nationkey),
supp AS (SELECT s_suppkey k, s_name, s_nationkey nk, 'supply/' || r_name || '/nation_' || s_nationkey || '/s' || s_suppkey || '.sup' path FROM supplier JOIN place ON s_nationkey = n_nationkey),
prt AS (SELECT p_partkey k, p_name, lower(p_type) type, p_size, 'catalog/' || replace(p_brand, '#', '_') || '/p' || p_partkey || '.prt' path FROM part),
kinds AS (SELECT DISTINCT event_type FROM events), types AS (SELECT DISTINCT type FROM prt),
files AS (SELECT path, language, md5(path) hash, parsed_ok FROM (SELECT path, 'crm' AS language, true parsed_ok FROM cust UNION SELECT path, 'sup', k % 17 <> 3 FROM supp UNION SELECT path, 'prt', k % 29 <> 5 FROM prt UNION SELECT 'events/' || event_type || '.tbl', 'tbl', true FROM kinds UNION SELECT 'catalog/lib/' || type || '.prt', 'prt', true FROM types)),
ords AS (SELECT o_orderkey, o_custkey, path, t, 'cust.' || o_custkey || '::o' || o_orderkey m FROM orders JOIN cust ON o_custkey = k),
nodes AS (SELECT 'File' AS kind, split_part(path, '/', -1) AS name, path AS qualified_name, path AS file_path, 1 AS line_start, false AS is_test FROM files
  UNION ALL SELECT 'Class', c_name, 'cust.' || k, path, (k // 23 + 1)::INT, t FROM cust
  UNION ALL SELECT 'Method', 'o' || o_orderkey, m, path, (o_orderkey % 1000 + 1)::INT, t FROM ords
  UNION ALL SELECT 'Class', p_name, 'part.' || k, path, 1, false FROM prt
  UNION ALL SELECT 'Class', s_name, 'supp.' || k, path, 1, false FROM supp
  UNION ALL SELECT 'Namespace', 'nation_' || nk, 'nation.' || nk, path, 1, false FROM (SELECT nk, path FROM cust UNION SELECT nk, path FROM supp)
  UNION ALL SELECT 'Function', 'price_' || type, 'fn.price_' || type, 'catalog/lib/' || type || '.prt', 1, false FROM types
  UNION ALL SELECT 'Table', event_type, 'evt.' || event_type, 'events/' || event_type || '.tbl', 1, false FROM kinds
  UNION ALL SELECT 'Column', c, 'evt.' || event_type || '::' || c, 'events/' || event_type || '.tbl', 2, false FROM (SELECT event_type, unnest(['value', 'props', 'user_id']) c FROM kinds)),
li AS (SELECT * FROM lineitem JOIN ords ON l_orderkey = o_orderkey),
edges AS (SELECT DISTINCT 'CALLS' AS kind, m AS source_qname, CASE WHEN l_tax = 0 THEN NULL ELSE 'part.' || l_partkey END AS target_qname, 'part.' || l_partkey AS target_raw, path AS file_path, l_linenumber::INT AS line,
    CASE l_returnflag WHEN 'R' THEN 'DYNAMIC' WHEN 'A' THEN 'HEURISTIC' ELSE 'RESOLVED' END AS confidence_tier, [CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END, CASE WHEN l_quantity < 10 THEN 'null' END] AS args FROM li
  UNION ALL SELECT DISTINCT 'NEW', m, 'supp.' || l_suppkey, 'supp.' || l_suppkey, path, 0, 'RESOLVED', NULL FROM li
  UNION ALL SELECT 'EXTENDS', 'part.' || k, 'part.' || (k // 2), 'part.' || (k // 2), path, 1, 'RESOLVED', NULL FROM prt WHERE k > 0
  UNION ALL SELECT 'CONTAINS', 'cust.' || o_custkey, m, m, path, (o_orderkey % 1000 + 1)::INT, 'RESOLVED', NULL FROM ords
  UNION ALL SELECT 'CONTAINS', split_part(qualified_name, '::', 1), qualified_name, qualified_name, file_path, 2, 'RESOLVED', NULL FROM nodes WHERE kind = 'Column'
  UNION ALL SELECT 'INCLUDES', s.path, p.path, p.path, s.path, 1, 'RESOLVED', NULL FROM (SELECT l_suppkey, min(l_partkey) pk FROM lineitem GROUP BY 1) x JOIN supp s ON l_suppkey = s.k JOIN prt p ON pk = p.k
  UNION ALL SELECT 'IMPORTS', 'part.' || k, 'supp.' || sk, 'supp.' || sk, path, 2, 'RESOLVED', NULL FROM (SELECT l_partkey, min(l_suppkey) sk FROM lineitem GROUP BY 1) x JOIN prt ON l_partkey = k
  UNION ALL SELECT 'CALLS', 'supp.' || k, 'cust.' || k || '::o' || ok, 'cust.' || k || '::o' || ok, path, 3, 'RESOLVED', NULL FROM (SELECT o_custkey, min(o_orderkey) ok FROM orders GROUP BY 1) x JOIN supp ON o_custkey = k
  UNION ALL SELECT 'CALLS', 'part.' || k, NULL, 'price_' || type, path, p_size::INT, 'RESOLVED', NULL FROM prt
  UNION ALL SELECT DISTINCT CASE WHEN value >= 200 THEN 'READS' ELSE 'WRITES' END, 'cust.' || user_id, CASE WHEN value < 100 THEN 'evt.' || event_type || '::value' ELSE 'evt.' || event_type END, CASE WHEN value < 100 THEN 'evt.' || event_type || '::value' ELSE 'evt.' || event_type END, path, (event_id % 50 + 1)::INT, CASE WHEN value < 10 THEN 'HEURISTIC' ELSE 'RESOLVED' END, NULL FROM events JOIN cust ON user_id = k),
first_nodes AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY file_path, line_start, kind) = 1),
ranked AS (SELECT *, CASE confidence_tier WHEN 'HEURISTIC' THEN 1 WHEN 'DYNAMIC' THEN 2 ELSE 0 END AS tr FROM edges)
"""
