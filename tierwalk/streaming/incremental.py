"""Graph snapshots that grow by micro-batches of re-read and removed files.

A snapshot is a list of folders, one for each bucket of files and each relation; a pointer file names them and is replaced in
one rename, so readers see the old graph or the new one. A batch replaces all rows of its files and writes anew only the
buckets it touches; folders that neither the new snapshot nor the one before it names are deleted.

Edges keep what the adapter gave beside what linking made of it. A batch resets and links again the open edges of its own
files, and of every file that names something the batch brought, took away or changed, so that the result is that of a full
build. Where inheritance or aliases change, all open edges are linked again; edges on chains of declared types always are.

Edge cases: files whose hash is unchanged are skipped; a batch that was applied before is not applied again; of several reads
of one file in a batch the last hash in order counts, whole; a removal of a file that is not there does nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tierwalk.functions import columns as C
from tierwalk.functions.vocabulary import INHERIT_KINDS, PATH_KINDS, TYPE_OF
from tierwalk.operators import resolve
from tierwalk.session import materialise
from tierwalk.sources.graph import EDGES, FILES, NODES, Graph, from_rows, raw_schema

STORED = {"files": FILES, "nodes": NODES, "edges": EDGES + ", given_qname string, given_tier string, extra boolean"}
STRUCTURE = (*INHERIT_KINDS, "ALIASES")


def _columns(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _tail(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.\\/:]*)$", 1)


def _asked() -> Column:
    """Lower-case names that an open edge's answer can depend on."""
    raw = F.col("target_raw")
    parts = F.array(raw, C.member("target_raw"), _tail(raw), _tail(C.container("target_raw")), F.when(F.col("kind").isin(*PATH_KINDS), F.substring_index(raw, "/", -1)))
    return F.array_distinct(F.filter(F.transform(parts, F.lower), lambda x: x.isNotNull() & (x != "")))


def _given() -> Column:
    """Lower-case names under which a node can be asked for."""
    name = F.col("qualified_name")
    return F.array_distinct(F.transform(F.array("name", name, C.member("qualified_name"), _tail(name), F.substring_index(name, "/", -1)), F.lower))


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._buckets = buckets

    def _manifest(self) -> dict:
        at = f"{self.root}/CURRENT"
        if not self._fs.exists(self._path(at)):
            return {"version": 0, "batch": -1, "before": [], "parts": {t: [""] * self._buckets for t in STORED}}
        return json.loads(self.spark.read.text(at).first()[0])

    def pointer(self) -> tuple[int, int]:
        """(version, last batch applied); (0, -1) before the first."""
        m = self._manifest()
        return m["version"], m["batch"]

    def _table(self, manifest: dict, name: str, only: set[int] | None = None) -> DataFrame:
        folders = [f"{self.root}/{at}/{name}/bucket={b}" for b, at in enumerate(manifest["parts"][name]) if at and (only is None or b in only)]
        if not folders:
            return self.spark.createDataFrame([], STORED[name])
        return self.spark.read.schema(STORED[name]).parquet(*folders)

    def graph(self) -> Graph:
        m = self._manifest()
        return Graph(self._table(m, "files"), self._table(m, "nodes"), self._table(m, "edges").select(*_columns(EDGES)))

    def _bucket(self, manifest: dict, path: str) -> Column:
        return F.expr(f"cast(pmod(xxhash64({path}), {len(manifest['parts']['files'])}) as int)")

    def _write(self, manifest: dict, version: int, name: str, rows: DataFrame, only: set[int]) -> None:
        """Rows of the touched buckets into a folder of this version; the manifest names it, or nothing for an empty bucket."""
        at = f"{self.root}/v{version}/{name}"
        path = "path" if name == "files" else "file_path"
        rows.withColumn("bucket", self._bucket(manifest, path)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        for b in only:
            manifest["parts"][name][b] = f"v{version}" if self._fs.exists(self._path(f"{at}/bucket={b}")) else ""

    def _publish(self, manifest: dict) -> None:
        fresh = self._path(f"{self.root}/.CURRENT-{manifest['version']}")
        out = self._fs.create(fresh, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf).rename(fresh, self._path(f"{self.root}/CURRENT"), options)
        held = {at for parts in manifest["parts"].values() for at in parts} | set(manifest["before"])
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and name not in held:
                self._fs.delete(status.getPath(), True)

    def _touched(self, manifest: dict, paths: DataFrame) -> set[int]:
        return {r.b for r in paths.select(self._bucket(manifest, "file_path").alias("b")).distinct().collect()}

    def apply(self, raw: DataFrame, batch: int) -> int:
        """Replace the batch's changed files, take out the removed ones, and link; returns how many files that were.

        Only files that a batch reads several times are ranked: objects of whole files are large to move.
        """
        m = self._manifest()
        if batch <= m["batch"]:
            return 0
        several = materialise(raw.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path"), "batch-several")
        if not several.isEmpty():
            order = Window.partitionBy("path").orderBy(F.desc_nulls_last("hash"))
            last = raw.join(several, "path", "left_semi").withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
            raw = raw.join(several, "path", "left_anti").unionByName(last)
        removed = F.coalesce("removed", F.lit(False)) if "removed" in raw.columns else F.lit(False)
        new = materialise(raw.where(~removed).join(self._table(m, "files").select("path", "hash"), ["path", "hash"], "left_anti"), "batch")
        return self._replace(m, from_rows(new), raw.where(removed).select("path"), batch)

    def replace(self, part: Graph, removed: DataFrame, batch: int) -> int:
        """As `apply`, for files that are given as rows, each once, with their nodes and edges: no file has to fit in one object."""
        m = self._manifest()
        if batch <= m["batch"]:
            return 0
        paths = part.files.join(self._table(m, "files").select("path", "hash"), ["path", "hash"], "left_anti").select(F.col("path").alias("file_path"))
        changed = materialise(paths, "batch-changed")

        def of(rows: DataFrame, path: str) -> DataFrame:
            return rows.join(changed.withColumnRenamed("file_path", path), path, "left_semi").select(*rows.columns)

        fresh = Graph(of(part.files, "path"), of(part.nodes, "file_path"), of(part.edges, "file_path"))
        return self._replace(m, fresh, removed.select("path"), batch)

    def _replace(self, m: dict, part: Graph, removed: DataFrame, batch: int) -> int:
        """Puts the part's files in the place of what is held of them. What linking reads many times is written once before."""
        part = Graph(*(materialise(rows, f"batch-{name}") for name, rows in (("files", part.files), ("nodes", part.nodes), ("edges", part.edges))))
        gone = removed.join(self._table(m, "files").select("path"), "path", "left_semi").select("path")
        paths = materialise(part.files.select("path").union(gone).select(F.col("path").alias("file_path")), "batch-paths")
        n = paths.count()
        if not n:
            return 0
        own = self._touched(m, paths)
        files = self._table(m, "files").join(paths.withColumnRenamed("file_path", "path"), "path", "left_anti").unionByName(part.files.select(*_columns(FILES)))
        held_nodes, held_edges = self._table(m, "nodes"), self._table(m, "edges")
        nodes = held_nodes.join(paths, "file_path", "left_anti").unionByName(part.nodes.select(*_columns(NODES))).select(*_columns(NODES))
        fresh = part.edges.select(*_columns(EDGES)).withColumns({"given_qname": F.col("target_qname"), "given_tier": F.col("confidence_tier"), "extra": F.lit(False)})
        kept = held_edges.join(paths, "file_path", "left_anti").select(*_columns(STORED["edges"]))
        again = materialise(self._again(m, part, paths, own, kept), "batch-again")
        # Links that go are undone: the row as it was given, without the further rows of several targets.
        dirty = again.withColumn("dirty", F.lit(True))
        marked = kept.join(dirty, "file_path", "left").withColumn("dirty", F.coalesce("dirty", F.lit(False))).where("not (dirty and extra)")
        reset = marked.withColumn("target_qname", F.when(F.col("dirty"), F.col("given_qname")).otherwise(F.col("target_qname"))).withColumn("confidence_tier", F.when(F.col("dirty"), F.col("given_tier")).otherwise(F.col("confidence_tier")))
        edges = reset.drop("dirty").select(*fresh.columns).unionByName(fresh)
        within = materialise(again.union(paths).distinct(), "batch-within")
        nodes = materialise(nodes, "batch-all-nodes")
        linked = resolve.linked(Graph(files, nodes, edges), within=within).select(*fresh.columns)
        touched = own | self._touched(m, again)
        beside = self._table(m, "edges", touched).join(within, "file_path", "left_anti").select(*fresh.columns)
        version = m["version"] + 1
        after = json.loads(json.dumps(m))
        in_own = self._bucket(m, "file_path").isin(*own)
        self._write(after, version, "files", files.where(self._bucket(m, "path").isin(*own)), own)
        self._write(after, version, "nodes", nodes.where(in_own), own)
        self._write(after, version, "edges", beside.unionByName(linked), touched)
        before = sorted({at for parts in m["parts"].values() for at in parts if at})
        self._publish({**after, "version": version, "batch": batch, "before": before})
        return n

    def _again(self, m: dict, part: Graph, paths: DataFrame, own: set[int], kept: DataFrame) -> DataFrame:
        """(file_path) outside the batch whose open edges may have another answer now."""
        open_edges = kept.where("given_qname is null and not extra")
        old = self._table(m, "edges", own).join(paths, "file_path", "left_semi")

        def structure(edges: DataFrame) -> DataFrame:
            return edges.where(F.col("kind").isin(*STRUCTURE)).select("kind", "source_qname", "target_raw").distinct()

        before, after = materialise(structure(old), "structure"), materialise(structure(part.edges), "structure")
        if not before.exceptAll(after).union(after.exceptAll(before)).isEmpty():
            return open_edges.select("file_path").distinct()
        language = self._table(m, "files", own).select(F.col("path").alias("file_path"), "language")
        names = ("kind", "name", "qualified_name", "file_path", "language")
        had = self._table(m, "nodes", own).join(paths, "file_path", "left_semi").join(language, "file_path", "left").select(*names)
        has = part.nodes.join(part.files.select(F.col("path").alias("file_path"), "language"), "file_path", "left").select(*names)
        had, has = materialise(had, "names"), materialise(has, "names")
        changed = had.exceptAll(has).union(has.exceptAll(had)).select(F.explode(_given()).alias("key")).distinct()
        # What is named by an alias of a changed name may change with it.
        real = kept.where("kind = 'ALIASES'").select(F.lower("source_qname").alias("alias"), F.lower("target_raw").alias("key")).distinct()
        changed = materialise(changed.union(resolve.preimages(real, changed)).distinct(), "changed")
        chained = open_edges.where(F.col("target_raw").contains(TYPE_OF + "::")).select("file_path")
        hit = open_edges.select("file_path", F.explode(_asked()).alias("key")).join(changed, "key", "left_semi").select("file_path")
        return hit.union(chained).distinct()


def follow(spark: SparkSession, source: str, root: str, checkpoint: str) -> StreamingQuery:
    """Apply all adapter output waiting in `source` and stop; a restart goes on where the checkpoint ends."""
    store = Store(spark, root)
    stream = spark.readStream.schema(raw_schema() + ", removed boolean").json(source)
    return stream.writeStream.foreachBatch(lambda df, batch: store.apply(df.where("path is not null"), batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
