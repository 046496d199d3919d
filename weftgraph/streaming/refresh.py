"""Keeping a stored graph up with changed files: one batch of them, or a stream.

A change is propagated instead of indexing anew, and the graph equals ``build.assemble`` over all files. Detectors read the changed
files alone. Nodes and edges that these reported or report now are merged again from all their reports; edges of nodes that
appeared, vanished or changed their name come along. From old and new rows follow old and new facts (``operators.claims``); only
groups whose facts differ claim edges again, and only claims that differ reach the edges. A build file that comes, goes or
changes its name takes the nodes below its folder along. Tables are read by the buckets of the keys in question, and only
buckets with a change in them are written; the two lists that the driver sees are numbers of buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph import model as M
from weftgraph.detectors import engine
from weftgraph.operators import claims as C
from weftgraph.operators import enrich, layers, linkers, merge, search
from weftgraph.operators.neighbours import drop_dangling
from weftgraph.operators.settle import settled
from weftgraph.sources.bucketed import Change
from weftgraph.sources.graph_store import FIELDS, GraphStore, commit, stored_columns

ARRIVAL = ["path", "content_hash", "seq"]
KEY = C.KEY


def newest(changes: DataFrame) -> DataFrame:
    """Of several changes of one path in a batch, the one with the largest hash: a batch has no order of its own."""
    return changes.groupBy("path").agg(F.max_by(F.struct("language", "content", "content_hash"), F.coalesce("content_hash", F.lit(""))).alias("f")).select("path", "f.*")


def _differ(old: DataFrame, new: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that went, rows that came), rows being told apart by their columns ``by``."""
    return settled(old.join(new.select(by), by, "left_anti").select(old.columns)), settled(new.join(old.select(by), by, "left_anti").select(new.columns))


def _swap(change: Change, table: str, gone: DataFrame, come: DataFrame, by: list[str]) -> None:
    """Rewrite the buckets that ``gone`` (told apart by ``by``) and ``come`` fall into."""
    key = change.tables.schemas[table][1]
    buckets = change.touched(gone.select(key).unionByName(come.select(key)))
    if buckets:
        left = change.beside(table, buckets).join(gone.select(by).distinct(), by, "left_anti")
        change.put(table, buckets, left.unionByName(come, allowMissingColumns=True))


def _both(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    return a.select(*columns).unionByName(b.select(*columns)).distinct()


def _up(paths: DataFrame) -> DataFrame:
    """(path, dir): every folder above each of ``paths``, the root's name being ''."""
    parts = F.split("path", "/")
    return paths.select("path", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))).alias("dir"))


class Refresh:
    """One change of one store. Methods go from reports to nodes, from these to facts, claims and edges."""

    def __init__(self, store: GraphStore, changes: DataFrame, project: str):
        self.store, self.spark, self.project, self.change = store, store.spark, project, store.begin()
        if self.change.note.get("whole"):
            raise ValueError("this graph was stored whole: reset it and refresh it with all its files")
        self.changed = settled(newest(changes).select("path", "language", "content", "content_hash"))
        self.paths, self.there = self.changed.select("path"), self.changed.filter("content IS NOT NULL")

    def reports(self) -> None:
        """What detectors find in the changed files takes the place of what they found before."""
        c, paths = self.change, self.paths
        found = settled(engine.detect(self.there))
        nodes, edges = engine.raw_nodes(found), engine.raw_edges(found)
        old = {t: settled(c.then(t, paths)) for t in ("reported", "tied")}
        new = {"reported": nodes.select("path", "id").distinct(), "tied": edges.select("path", *KEY).distinct()}
        self.ids = settled(_both(old["reported"], new["reported"], "id").unionByName(self.below_changed_modules()).distinct())
        self.keys = _both(old["tied"], new["tied"], *KEY)
        _swap(c, "files", self.changed, self.there, ["path"])
        for t in ("reported", "tied"):
            _swap(c, t, old[t], new[t], ["path"])
        _swap(c, "raw_nodes", old["reported"].select("path", "id"), nodes, ["path", "id"])
        _swap(c, "raw_edges", old["tied"], edges, ["path", *KEY])
        _swap(c, "into", old["tied"], new["tied"], ["path", *KEY])

    def below_changed_modules(self) -> DataFrame:
        """Ids of nodes below folders whose build file names another service now; the modules before and after are kept."""
        c = self.change
        dirs = self.paths.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).distinct()
        old = settled(c.then("builds", dirs))
        new = enrich.build_files(self.there)
        gone = old.join(self.paths.withColumnRenamed("path", "file"), "file", "left_semi")
        had_any = has_any = not c.then("builds").isEmpty()
        quiet = gone.isEmpty() and new.isEmpty()
        if not quiet:
            _swap(c, "builds", gone, new, ["dir", "file"])
            has_any = not c.now("builds").isEmpty()
        modules = lambda rows, any_: enrich.build_modules(rows, self.project) if any_ else enrich.no_build_file(self.spark, self.project)
        self.modules_of = lambda read, any_, dirs: modules(read("builds", dirs), any_)
        self.any = had_any, has_any
        none = enrich.no_build_file(self.spark, self.project)
        if quiet and c.note.get("refreshed", False):
            self.root_moved, self.modules_gone = False, none.limit(0)
            self.modules_come = self.modules_gone
            return self.paths.limit(0).select(F.col("path").alias("id"))
        before = modules(old, True).unionByName(none.filter(F.lit(not had_any and c.note.get("refreshed", False))))
        after = modules(c.now("builds", dirs), True).unionByName(none.filter(F.lit(not has_any)))
        self.modules_gone, self.modules_come = _differ(before, after, before.columns)
        moved = settled(_both(self.modules_gone, self.modules_come, "dir"))
        self.root_moved = not moved.filter("dir = ''").isEmpty()
        if moved.isEmpty():
            return self.paths.limit(0).select(F.col("path").alias("id"))
        places = c.then("nodes").filter("source IS NULL OR source NOT IN ('service_detector', 'module_linker')").select("id", F.coalesce("file_path", F.lit("")).alias("path"))
        inside = _up(places.select("path").distinct()).join(moved, "dir", "left_semi").select("path").distinct()
        return places.join(inside, "path", "left_semi").select("id")

    def nodes(self) -> None:
        """Merged nodes of the touched ids before (as stored) and now, and ids whose name or existence changed."""
        c = self.change
        self.merged = settled(merge.merge_nodes(c.now("raw_nodes", self.ids), ARRIVAL))
        self.stored = settled(c.then("nodes", self.ids).select(*(f.name for f in M.NODES)))
        shape = ["id", "kind", "label"]
        gone, come = _differ(self.stored.select(shape), self.merged.select(shape), shape)
        self.flipped = _both(gone, come, "id")

    def edges(self) -> None:
        """Detectors' claims to the touched edges before and now: both ends must be nodes that detectors report."""
        c = self.change
        drop = settled(self.flipped)
        near = c.now("into", drop).select(*KEY).unionByName(c.now("raw_edges", drop).select(*KEY))
        self.keys = settled(self.keys.unionByName(near).distinct())
        reports = c.now("raw_edges", self.keys.select("src")).join(self.keys, KEY, "left_semi")
        ends = self.keys.select(F.col("src").alias("id")).unionByName(self.keys.select(F.col("dst").alias("id"))).distinct()
        known = c.now("raw_nodes", ends).select("id").distinct()
        self.claims_new = C.claimed(drop_dangling(settled(known), merge.merge_edges(reports, ARRIVAL)), C.DETECTORS)
        self.claims_old = c.then("claims", self.keys.select("src")).filter(F.col("rank") == C.DETECTORS).join(self.keys, KEY, "left_semi").select(*C.CLAIM)
        self.claims_new, self.claims_old = settled(self.claims_new), settled(self.claims_old)

    def calls(self) -> tuple[DataFrame, DataFrame]:
        """Call sites before and now of the changed files and of those whose methods changed."""
        c = self.change
        methods = lambda rows: rows.filter("kind = 'method' AND file_path <> ''").select(F.col("file_path").alias("path"))
        files = settled(self.paths.unionByName(methods(self.stored)).unionByName(methods(self.merged)).distinct())
        old = c.then("calls", files)
        # A node's file reports it, so what files report leads to their methods.
        ids = c.now("reported", files).select("id").distinct()
        now = c.then("nodes", ids).select("id", "kind", "label", "file_path").join(self.ids, "id", "left_anti").unionByName(self.merged.select("id", "kind", "label", "file_path"))
        new = settled(enrich.extract_calls(c.now("files", files), now).select("path", "src", "name").distinct())
        _swap(c, "calls", files, new, ["path"])
        return settled(old), new

    def facts(self) -> None:
        """Facts that went and came, and all facts of their groups before and now."""
        c = self.change
        ends = self.keys.select(F.col("dst").alias("id")).distinct()
        shape = ["id", "kind", "label"]
        old_ends = c.then("nodes", ends).select(shape)
        new_ends = old_ends.join(self.ids, "id", "left_anti").unionByName(self.merged.select(shape))
        old_calls, new_calls = self.calls()
        old = C.node_facts(self.stored).unionByName(C.topic_facts(self.claims_old, old_ends)).unionByName(C.call_facts(old_calls))
        new = C.node_facts(self.merged).unionByName(C.topic_facts(self.claims_new, new_ends)).unionByName(C.call_facts(new_calls))
        gone, come = _differ(old.distinct(), new.distinct(), C.FACT)
        groups = settled(_both(gone, come, "linker", "group"))
        self.facts_old = settled(c.then("facts", groups.select("group")).join(groups, ["linker", "group"], "left_semi").select(*C.FACT))
        _swap(c, "facts", gone, come, C.FACT)
        self.facts_new = settled(c.now("facts", groups.select("group")).join(groups, ["linker", "group"], "left_semi").select(*C.FACT))

    def services(self, rows: DataFrame, read, any_: bool) -> DataFrame:
        """``rows`` with the modules that hold them."""
        dirs = _up(rows.select(F.coalesce("file_path", F.lit("")).alias("path")).distinct()).select("dir").distinct()
        return enrich.placed_nodes(rows, settled(self.modules_of(read, any_, dirs)))

    def finish(self, manifest: str) -> None:
        c, names = self.change, [f.name for f in M.NODES]
        before, after = C.module_names(self.facts_old), C.module_names(self.facts_new)
        gone_modules, come_modules = _differ(before, after, ["group"])
        if self.root_moved:  # module nodes belong to no file, so the root's service holds them
            held = c.then("nodes").filter("source = 'module_linker'").select(F.col("label").alias("group"))
            stay = settled(held.join(gone_modules, "group", "left_anti").join(come_modules, "group", "left_anti"))
            gone_modules, come_modules = gone_modules.unionByName(stay), come_modules.unionByName(stay)
        gone_ids = gone_modules.select(F.concat(F.lit("module:"), "group").alias("id"))
        fresh = self.merged.unionByName(linkers.module_nodes(come_modules.select(F.col("group").alias("module"))))
        files = settled(c.now("files", fresh.filter("file_path <> ''").select("file_path").distinct()))
        fresh = layers.classify(fresh)
        fresh = settled(enrich.with_types(enrich.with_comments(enrich.with_config_keys(fresh), files), files).select(*names))
        old_rows = self.stored.unionByName(c.then("nodes", gone_ids).select(*names))
        was, now = settled(self.services(old_rows, c.then, self.any[0])), settled(self.services(fresh, c.now, self.any[1]))
        # Services: those that gained, lost or are renamed; their counts move by what moved.
        count = lambda d, sign: d.filter("service_id IS NOT NULL").groupBy("service_id").agg((sign * F.count_if(F.col("kind") == "endpoint")).alias("e"), (sign * F.count_if(F.col("kind") == "entity")).alias("t"))
        moves = count(was, -1).unionByName(count(now, 1)).groupBy("service_id").agg(F.sum("e").alias("e"), F.sum("t").alias("t"))
        touched = settled(_both(moves.filter("e <> 0 OR t <> 0"), self.modules_gone.unionByName(self.modules_come), "service_id"))
        old_services = settled(c.then("nodes", touched).filter("source = 'service_detector'").select(*names))
        dirs = old_services.select(F.col("file_path").alias("dir")).unionByName(self.modules_come.select("dir")).distinct()
        modules = settled(self.modules_of(c.now, self.any[1], settled(dirs))).join(touched, "service_id", "left_semi")
        held = old_services.select(F.col("id").alias("service_id"), *(F.col("props")[p].cast("long").alias(a) for p, a in (("endpoint_count", "e0"), ("entity_count", "t0"))))
        zero = F.lit(0).cast("long")
        counted = modules.join(held, "service_id", "left").join(moves, "service_id", "left").withColumn("n_endpoints", F.coalesce("e0", zero) + F.coalesce("e", zero)).withColumn("n_entities", F.coalesce("t0", zero) + F.coalesce("t", zero))
        services = settled(enrich.service_nodes(counted))
        gone = _both(self.stored, old_services, "id").unionByName(gone_ids)
        rows = stored_columns(enrich.stamped(now, names).unionByName(services))
        _swap(c, "nodes", gone, rows, ["id"])
        for fields in FIELDS:  # indexes that were built
            index = self.store.index(fields)
            if index.exists():
                come = search.node_text(rows, fields).withColumnRenamed("id", "key")
                index.update(settled(come.unionByName(gone.join(rows.select("id"), "id", "left_anti").select(F.col("id").alias("key"), F.lit(None).cast("string").alias("text")))))
        old_claims = [self.claims_old, C.derived(self.facts_old), C.claimed(enrich.service_edges(was), C.SERVICES)]
        new_claims = [self.claims_new, C.derived(self.facts_new), C.claimed(enrich.service_edges(now), C.SERVICES)]
        # Claims of one rank, group and key are the same but for detectors', which are merged anew.
        told = [*KEY, "rank", "group"]
        row = F.when(F.col("rank") == C.DETECTORS, F.to_json(F.struct("id", "confidence", "source", "props"))).otherwise("")
        whole = lambda found: found[0].unionByName(found[1]).unionByName(found[2]).withColumn("row", row)
        lost, won = _differ(whole(old_claims), whole(new_claims), [*told, "row"])
        _swap(c, "claims", lost, won.drop("row"), told)
        keys = settled(_both(lost, won, *KEY))
        best = C.survivors(c.now("claims", keys.select("src")).join(keys, KEY, "left_semi"))
        _swap(c, "edges", keys, best, KEY)
        commit(c, manifest, refreshed=True)


def refresh(store: GraphStore, changes: DataFrame, manifest: str = "", project: str = "root") -> tuple[int, int]:
    """Put ``changes`` (path, language, content, content_hash; null content: the file is gone) into the stored graph, which was
    reset or refreshed before. How many nodes and edges there are then. The same batch again leaves the same graph."""
    r = Refresh(store, changes, project)
    r.reports()
    r.nodes()
    r.edges()
    r.facts()
    r.finish(manifest)
    return store.nodes().count(), store.edges().count()


def follow(store: GraphStore, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Refresh the stored graph from a stream of changes (columns as in ``refresh``); ``trigger`` as for a stream's writer."""
    writer = changes.writeStream.foreachBatch(lambda batch, number: refresh(store, batch.persist(), f"batch {number}") and batch.unpersist())
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
