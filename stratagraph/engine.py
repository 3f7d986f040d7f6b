"""The engine over one repository: build, look up, search, coverage, explanations, tasks, submissions.

All answers are plans over the relations of the index; only the documents being written pass
through the driver.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.extract.model import digest
from stratagraph.functions import text as X
from stratagraph.functions.paths import directory
from stratagraph.operators import coverage as C
from stratagraph.operators import features, graph, linking, reports, search, tasks
from stratagraph.operators import staleness as S
from stratagraph.sources import documents as D
from stratagraph.sources import index as I
from stratagraph.sources import repo
from stratagraph.staging import checkpointed


class Engine:
    def __init__(self, spark: SparkSession, root: str, pack: str, index: DataFrame, links: tuple[DataFrame, DataFrame] | None = None):
        self.spark, self.root, self.pack = spark, root, pack
        self.index = index
        self.rel = I.Relations.of(index)
        self.spans = None
        if links is not None:
            self.imports, self.flows = links
            if pack == "cpp":
                self._pair()
            return
        self.imports = checkpointed(linking.resolve_imports(self.rel, pack))
        if pack == "cpp":
            self._pair()
            words = linking.cpp_edges(self.rel, self.reached)
            own = words.select("from_file", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("specifier"), F.regexp_extract("target", "([^:.]*)$", 1).alias("imported_name"), F.lit(None).cast("string").alias("local_name"), F.lit("word").alias("form"), F.substring_index("target", "::", 1).alias("target_file"), "target")
            self.imports = checkpointed(self.imports.unionByName(own))
        self.flows = checkpointed(linking.resolve_flows(self.rel, self.imports))

    def _pair(self) -> None:
        """Definitions join the declarations that their files reach; what is left of the symbols is the engine's."""
        from stratagraph.operators import pairing, reachability

        self.reached = reachability.over(linking.include_hops(self.imports))  # pairing and word links both ask it
        pairs = pairing.pair(self.rel.symbols, self.reached)
        symbols, spans = pairing.apply(self.rel.symbols, pairs)
        self.rel.symbols, self.spans = checkpointed(symbols), checkpointed(spans)

    def save(self, cache: str) -> None:
        """Store the index and the resolved links beside it."""
        I.save(self.index, f"{cache}/index")
        for name, df in (("imports", self.imports), ("flows", self.flows)):
            df.withColumn("index_digest", F.lit(self._digest(self.index))).write.mode("overwrite").parquet(f"{cache}/{name}")

    @staticmethod
    def _digest(index: DataFrame) -> str:
        """Of the files and their texts, whatever their order."""
        row = index.agg(F.count("*").alias("n"), F.sum(F.xxhash64("file", "source_hash").cast("decimal(38,0)")).alias("s")).first()
        return f"{row.n}:{row.s}"

    @classmethod
    def _links(cls, spark: SparkSession, cache: str, index: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """Stored links, if they are of the same files."""
        from pyspark.errors import AnalysisException

        try:
            found = [spark.read.parquet(f"{cache}/{name}") for name in ("imports", "flows")]
        except AnalysisException:
            return None
        wanted = cls._digest(index)
        if any(not df.where(F.col("index_digest") != wanted).isEmpty() for df in found):
            return None
        return found[0].drop("index_digest"), found[1].drop("index_digest")

    @classmethod
    def build(cls, spark: SparkSession, root: str, pack: str | None = None) -> Engine:
        """A cold build: walk, route, read and extract, all files in one pass."""
        paths = repo.walk(root)
        pack = pack or repo.detect(spark, paths)
        files = repo.read(spark, root, [*paths, *repo.generated(root, paths)])
        return cls(spark, root, pack, checkpointed(I.extract(repo.routed(files, pack), repo.known_names(root, pack, paths))))

    @classmethod
    def open(cls, spark: SparkSession, root: str, cache: str, pack: str | None = None) -> Engine:
        """From a stored index, extracting only files whose text has changed since."""
        paths = repo.walk(root)
        pack = pack or repo.detect(spark, paths)
        old = I.load(spark, f"{cache}/index", pack)
        old = old if old is not None else I.load(spark, cache, pack)
        if old is None:
            return cls.build(spark, root, pack)
        now = repo.routed(repo.read(spark, root, [*paths, *repo.generated(root, paths)]), pack)
        same = now.select("file", F.sha2("text", 256).alias("source_hash"))
        kept = old.join(same, ["file", "source_hash"], "left_semi")
        moved = now.join(kept.select("file"), "file", "left_anti")
        index = checkpointed(kept.select(*old.columns).unionByName(I.extract(moved, repo.known_names(root, pack, paths)).select(*old.columns)))
        return cls(spark, root, pack, index, cls._links(spark, cache, index))  # links are resolved again only where a file has moved

    # Lookups

    def get_symbol(self, id_: str) -> DataFrame:
        return self.rel.symbols.where(F.col("id") == id_)

    def get_source(self, id_: str, context: int = 0) -> DataFrame:
        """(id, source, truncated, in_sync) of a symbol or file."""
        c = min(context, search.MAX_SOURCE_CONTEXT)
        files = self.rel.files.select("file", "text", "source_hash")
        in_sync = (F.sha2("text", 256) == F.col("source_hash")).alias("in_sync")
        symbol = self.get_symbol(id_).select("id", "file", "start_line", "end_line").join(files, "file")
        part = symbol.select("id", X.cap_bytes(X.span(F.col("text"), F.col("start_line"), F.col("end_line"), c), search.MAX_SOURCE_BYTES).alias("c"), in_sync)
        whole = files.where(F.col("file") == id_).select(F.col("file").alias("id"), X.cap_bytes(F.col("text"), search.MAX_SOURCE_BYTES).alias("c"), in_sync)
        return part.unionByName(whole).select("id", F.col("c.text").alias("source"), F.col("c.truncated").alias("truncated"), "in_sync")

    def get_callers(self, id_: str) -> DataFrame:
        """Imports of the target; of a table, the files that refer to it."""
        table = self.rel.symbols.where((F.col("id") == id_) & (F.col("kind") == "schema")).select(F.col("id").alias("target"))
        refs = self.flows.where("kind = 'table-ref'").join(table, "target", "left_semi").select("from_file", "target")
        plain = self.imports.where(F.col("target") == id_).join(table, "target", "left_anti").select("from_file", "target")
        return plain.unionByName(refs)

    def get_callees(self, id_: str) -> DataFrame:
        """All imports of the file that owns the symbol, with the target or null."""
        return self.imports.where(F.col("from_file") == id_.split("::")[0]).select("from_file", "specifier", "imported_name", "target").orderBy("specifier", "imported_name")

    def search_code(self, query: str, path: str = "", ignore_case: bool = False, context_lines: int = 0, max_results: int = search.MAX_MATCHES) -> DataFrame:
        """Over every file that the walk shows, not only those of the pack."""
        return search.search(repo.read(self.spark, self.root, repo.walk(self.root)), query, path, ignore_case, context_lines, max_results)

    # Features

    def entry_points(self) -> DataFrame:
        return features.entry_points(self.pack, self.rel.files, self.rel.symbols, self.flows)

    def participants(self) -> DataFrame:
        entries = self.entry_points()
        files = entries.select(F.col("id").alias("entry"), "file")
        edges = self.imports.select("from_file", "target_file", "target").unionByName(self.flows.select("from_file", "target_file", "target"))
        may = features.admitted(self.pack, entries, self.rel.files, self.rel.symbols, self.flows, self.imports)
        return graph.participants(files, edges, may, self.rel.symbols)

    # Hashes

    def documented(self) -> DataFrame:
        """Top-level callables and containers of files that aren't generated, in declaration order."""
        live = self.rel.files.where("role <> 'generated'").select("file", "role")
        return self.rel.symbols.where("is_top_level AND kind IN ('callable', 'container')").join(live, "file")

    def _target_hashes(self) -> DataFrame:
        symbols = self.rel.symbols.groupBy(F.col("id").alias("target")).agg(F.first(F.coalesce("interface_hash", "source_hash")).alias("hash"))
        return symbols.unionByName(self.rel.files.select(F.col("file").alias("target"), F.col("source_hash").alias("hash")))

    def dependencies(self) -> DataFrame:
        """(file, owner, target, hash): a file's targets, and those whose names a symbol's own text writes."""
        targets = self.imports.where("target IS NOT NULL").select(F.col("from_file").alias("file"), "target", F.coalesce("local_name", "imported_name").alias("word")).distinct()
        hashed = targets.join(self._target_hashes(), "target")
        files = hashed.select("file", F.col("file").alias("owner"), "target", "hash")
        texts = self.documented().select("file", "id", "start_line", "end_line").join(self.rel.files.select("file", "text"), "file")
        wrote = texts.select("file", F.col("id").alias("owner"), X.words(X.span(F.col("text"), F.col("start_line"), F.col("end_line"))).alias("words"))
        scoped = wrote.join(hashed, "file").where(F.array_contains("words", F.col("word")) & (F.col("target") != F.col("owner")))
        return files.unionByName(scoped.select("file", "owner", "target", "hash")).distinct()

    def hashes(self) -> DataFrame:
        """(id, file, source_hash, deps_hash) of every file and symbol that should have a document."""
        own = self.documented()
        files = own.select("file").distinct().join(self.rel.files.select("file", F.col("fingerprint").alias("source_hash")), "file")
        ids = files.select(F.col("file").alias("id"), "file", "source_hash").unionByName(own.select("id", "file", "source_hash"))
        deps = self.dependencies().groupBy(F.col("owner").alias("id")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("target", "hash"))), lambda p: F.concat_ws(":", p.target, p["hash"])), "\n"), 256).alias("deps_hash"))
        return ids.join(deps, "id", "left").select("id", "file", "source_hash", F.coalesce("deps_hash", F.lit(digest(""))).alias("deps_hash"))

    # Documents

    def _stored(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return D.tables(self.spark, D.load(self.root)[0])

    def changes(self) -> DataFrame:
        """(id, file, action): source and dependency differences of files and symbols against their documents."""
        docs, sections, _, _ = self._stored()
        stored = docs.where("doc_kind = 'file'").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file"), F.col("fingerprint").alias("source_hash"), "deps_hash", "spec_hash")
        stored = stored.unionByName(sections.select(F.col("symbol_id").alias("id"), F.col("doc_id").alias("file"), "source_hash", "deps_hash", "spec_hash")).where("spec_hash <> ''")
        return S.unit_changes(self.hashes(), stored, ["id", "file"])

    def coverage(self, scope: str = "") -> DataFrame:
        """One row per document that should exist: files and folders; with status, fan-in, smells, generations."""
        from stratagraph.functions.paths import within_scope

        docs, sections, children, _ = self._stored()
        want = self.hashes().where(within_scope(F.col("file"), scope))
        changed = self.changes().groupBy("id").agg(F.collect_set("change").alias("changes"))
        missing = F.coalesce(F.exists("changes", lambda c: c.startswith("added:")), F.lit(False))
        smell = sections.select(F.col("symbol_id").alias("id"), X.smells(F.concat_ws("\n", "summary", "behavior")).alias("smells")).unionByName(docs.select(F.col("doc_id").alias("id"), X.smells(F.col("summary")).alias("smells")))
        units = want.join(changed, "id", "left").join(smell, "id", "left").select("id", "file", missing.alias("missing"), F.col("changes").isNotNull().alias("changed"), F.coalesce("smells", F.array().cast("array<string>")).alias("smells"))
        status = reports.status_of(F.col("missing"), ~F.col("changed"))
        pending = F.count_if(F.col("missing") | F.col("changed") | (F.size("smells") > 0))
        tests = self.rel.files.where("role = 'test'").select(F.col("file").alias("from_file"))
        tops = self.rel.symbols.where("is_top_level").select(F.col("id").alias("target"), "file")
        fan = self.imports.join(tests, "from_file", "left_anti").join(tops, "target").groupBy("file").agg(F.count("*").alias("fan_in"))
        files = units.groupBy("file").agg(status.alias("status"), pending.alias("generations"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("smells")))).alias("smells"))
        files = files.join(fan, "file", "left").join(self.rel.files.select("file", "role"), "file").select(F.col("file").alias("id"), F.lit("file").alias("kind"), directory(F.col("file")).alias("module"), "role", "status", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), "smells", "generations")
        dirs = files.where("role <> 'test'").groupBy("module").agg(F.count("*").alias("n"), F.collect_list("id").alias("own")).where("n >= 2 AND module <> '.'")
        spec = docs.where("doc_kind = 'file'").select(F.col("doc_id").alias("child_id"), "spec_hash")
        stale = files.where("status <> 'current'").select(F.col("id").alias("child_id"), F.lit(1).alias("bad"))
        now = dirs.select(F.concat(F.lit("rollup:"), "module").alias("doc_id"), F.explode("own").alias("child_id")).join(spec, "child_id", "left").join(stale, "child_id", "left")
        now = now.select("doc_id", "child_id", F.when(F.col("bad").isNull(), F.coalesce("spec_hash", F.lit(""))).otherwise(F.lit("")).alias("hash"))
        written = docs.where("doc_kind = 'rollup' AND spec_hash <> ''").select("doc_id", F.lit(1).alias("written"))
        diff = S.hash_diff(now, children, ["doc_id", "child_id"]).groupBy("doc_id").agg(F.count("*").alias("moved"))
        state = F.when(F.col("written").isNull(), "missing").when(F.col("moved").isNull(), "current").otherwise("stale")
        rollups = dirs.select(F.concat(F.lit("rollup:"), "module").alias("doc_id"), "module").join(written, "doc_id", "left").join(diff, "doc_id", "left")
        rollups = rollups.select(F.col("doc_id").alias("id"), F.lit("rollup").alias("kind"), "module", F.lit("domain").alias("role"), state.alias("status"), F.lit(0).cast("long").alias("fan_in"), F.array().cast("array<string>").alias("smells"), F.when(state == "current", 0).otherwise(1).cast("long").alias("generations"))
        return files.unionByName(rollups).withColumn("smelly", F.size("smells") > 0)

    def coverage_report(self, scope: str = "") -> DataFrame:
        return C.coverage_report(self.coverage(scope))

    def coverage_answer(self, scope: str = "", cursor: int = 0) -> dict:
        """Everything that coverage says of a scope: sums and ratios of all, by kind and by module, the weighted
        freshness, the top stale files, orphans, a page of pending units and the next page's cursor, the number of
        generated files, and the files that were read in part, worst first.

        The inventory is staged once; what is collected is sums, orphans and pages.
        """
        from stratagraph.functions.paths import within_scope

        items = checkpointed(self.coverage(scope))
        sums = C.coverage_report(items).collect()
        row = lambda r: {k: v for k, v in r.asDict().items() if k != "level"}
        due = C.prioritize(items)
        total = due.count()
        role = F.when(F.col("role") == "test", 1).when(F.col("role") == "generated", 2).otherwise(0)
        worst = reports.worst_read(self.rel.files, "file", "parse_errors", role).collect()
        made = reports.generated_count(self.rel.files, F.col("role") == "generated").first()
        start = min(cursor, total)
        return {
            "all": next((row(r) for r in sums if r.level == "all"), {}),
            "by_kind": [row(r) for r in sums if r.level == "kind"],
            "by_module": [row(r) for r in sums if r.level == "module"],
            "generations_remaining": items.agg(F.coalesce(F.sum("generations"), F.lit(0))).first()[0],
            "weighted_freshness": C.weighted_freshness(items.where("kind = 'file'")).first()[0],
            "top_stale": [r.asDict() for r in C.top_stale(items).select("id", "status", "fan_in").collect()],
            "orphaned": [r.asDict() for r in self.orphaned().where(within_scope(F.col("id"), scope)).orderBy("id").collect()],
            "pending": [r.asDict() for r in C.page(due, start).select("id", "kind", "status", "fan_in", "tier", "urgency").collect()],
            "next_cursor": start + C.PAGE if start + C.PAGE < total else None,
            "generated": made.generated or None,
            "partly_read": {"files": worst[0].files, "worst": [{"file": r.file, "errors": r.errors} for r in worst]} if worst else None,
        }

    def pending(self, scope: str = "", cursor: int = 0) -> DataFrame:
        return C.page(C.prioritize(self.coverage(scope)), cursor)

    def orphaned(self) -> DataFrame:
        """Documents of files that are gone, and sections of symbols that are gone."""
        docs, sections, _, _ = self._stored()
        live = self.hashes()
        files = S.orphans(docs.where("doc_kind = 'file'").select(F.col("doc_id").alias("id")), live.select("id"), "id").withColumn("kind", F.lit("document"))
        alive = sections.join(live.select(F.col("file").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("symbol_id").alias("id"))
        return files.unionByName(S.orphans(alive, live.select("id"), "id").withColumn("kind", F.lit("section")))

    def explain(self, id_: str | None = None) -> DataFrame:
        """(id, file, cause, target): why documents are stale; dependency causes name the targets that moved."""
        rows = self.changes()
        rows = rows if id_ is None else rows.where((F.col("id") == id_) | (F.col("file") == id_))
        cause = F.when(F.col("change") == "changed:source", "source").when(F.col("change") == "changed:dependencies", "dependency").when(F.col("change").startswith("added"), "missing").otherwise("removed")
        _, _, _, recorded = self._stored()
        now = self.dependencies().select("owner", "target", F.substring("hash", 1, 12).alias("hash12"))
        moved = S.hash_diff(now, recorded, ["owner", "target"], "hash12").select(F.col("owner").alias("id"), F.concat_ws(":", "action", "target").alias("target"), F.lit("dependency").alias("cause"))
        return rows.withColumn("cause", cause).select("id", "file", "cause").distinct().join(moved, ["id", "cause"], "left")

    def explain_corpus(self) -> DataFrame:
        """How many documents are stale for which causes."""
        return S.cause_label(self.explain(), "file", "cause").groupBy("label").agg(F.count("*").alias("documents"))

    def file_inputs(self, scope: str = "", page: int = tasks.PAGE, most: int = reports.RAW_PAGES) -> DataFrame:
        """(file, input_kind, input, pages): what a writer is shown of each file, see ``tasks.file_inputs``."""
        from stratagraph.functions.paths import within_scope

        _, sections, _, _ = self._stored()
        files = self.rel.files.where(within_scope(F.col("file"), scope))
        return tasks.file_inputs(files, self.rel.symbols, sections.select(F.col("symbol_id").alias("id"), "summary"), page, most)

    def file_task(self, file: str, cursor: str | None = None, page: int = tasks.PAGE, most: int = reports.RAW_PAGES) -> dict:
        """One page of what a writer is shown of a file: nothing of it is cut off, the cursor leads to the next page.

        A cursor holds a hash of what is paged: once that has changed the cursor is refused.
        """
        row = self.file_inputs(file, page, most).where(F.col("file") == file).first()
        if row is None:
            raise ValueError(f"no such file: {file}")
        at = 0 if cursor is None else X.decode_cursor(cursor, file, row.input, page)
        follow = X.encode_cursor(at + 1, file, row.input) if at + 1 < len(row.pages) else None
        return {"id": file, "input_kind": row.input_kind, "source": row.pages[at], "page": at + 1, "pages": len(row.pages), "next_cursor": follow}

    def next_task(self, file: str) -> dict | None:
        """The first unit of a file that isn't current, in declaration order, then the file itself; None when all is.

        The file itself comes in pages, see ``file_task``.
        """
        order = self.documented().select("id", "ord").unionByName(self.rel.files.select(F.col("file").alias("id"), F.lit(2**30).alias("ord")))
        _, sections, _, _ = self._stored()
        edited = sections.select(F.col("symbol_id").alias("id"), "edited")
        row = (
            self.changes().where((F.col("file") == file) & ~F.col("change").startswith("removed")).groupBy("id", "file").agg(F.array_sort(F.collect_set("change")).alias("changes"))
            .join(order, "id").join(edited, "id", "left").orderBy("ord").limit(1)
            .select("id", "changes", S.reconcile(F.exists("changes", lambda c: c.contains("source")), F.coalesce("edited", F.lit(False))).alias("action")).first()
        )
        if row is None:
            return None
        if row.id == file:
            return {**self.file_task(file), "changes": list(row.changes), "action": row.action, "truncated": False}
        source = self.get_source(row.id).first()
        return {"id": row.id, "changes": list(row.changes), "action": row.action, "source": source.source, "truncated": source.truncated}

    def next_unit(self, target: str = "", cursor: int = 0) -> dict | None:
        """The next task of a file, a folder, a feature or the whole system (``system`` or nothing), from the bottom up.

        Files come before their folder's document, folders before features, features before the system; a document
        whose parts aren't current yet has no task of its own. ``cursor`` skips that many units that are due.
        """
        if self.rel.files.where(F.col("file") == target).count():
            return self.next_task(target)
        items, upper = self.coverage(), self.upper_status()
        due = items.where("status <> 'current' OR smelly").select("id", "kind", "module", "status")
        ready = reports.children_gate(items.where("kind = 'file' AND role <> 'test'"), "module", F.col("status") == "current").where("ready").select("module")
        files = due.where("kind = 'file'").select("id", "kind", "module")
        folders = due.where("kind = 'rollup'").join(ready, "module", "left_semi").select("id", "kind", "module")
        parts = self.participants().where("tier = 'core'").select(F.concat(F.lit("feature:"), "entry").alias("id"), F.col("target").alias("file")).join(items.select(F.col("id").alias("file"), "status"), "file")
        open_ = parts.where("status <> 'current'").select("id").distinct()
        features_ = upper.where("kind = 'feature' AND status <> 'current'").join(open_, "id", "left_anti").select("id", "kind", F.lit("").alias("module"))
        system = upper.where("kind = 'system' AND status <> 'current'").select("id", "kind", F.lit("").alias("module"))
        if target in ("", "system"):
            below = items.where("kind IN ('file', 'rollup') AND status <> 'current'").count() + upper.where("kind = 'feature' AND status <> 'current'").count()
            units = files.unionByName(folders).unionByName(features_).unionByName(system if not below else system.limit(0))
        elif target.startswith("feature:"):
            units = parts.where((F.col("id") == target) & (F.col("status") != "current")).select(F.col("file").alias("id"), F.lit("file").alias("kind"), F.lit("").alias("module")).unionByName(features_.where(F.col("id") == target))
        else:
            module = target.removeprefix("rollup:")
            units = files.unionByName(folders).where(F.col("module") == module)
        row = reports.bottom_up(units).offset(cursor).limit(1).first()
        if row is None:
            return None
        if row.kind == "file":
            return self.next_task(row.id) or {"id": row.id, "kind": "file", "changes": []}
        kids = {d.id: d.summary for d in D.load(self.root)[0]}
        return {"id": row.id, "kind": row.kind, "parts": {k: v for k, v in kids.items() if row.kind == "system" and k.startswith(("rollup:", "feature:")) or row.kind == "rollup" and k.startswith(row.module + "/")}}

    def submit(self, id_: str, summary: str, behavior: str = "") -> Path:
        """Record a document's text with the hashes of what it describes; replaces the file as a whole."""
        if any(s.startswith("#") for s in (summary + "\n" + behavior).split("\n")):
            raise ValueError("a text may not hold headings")
        found = [r for r in self.spark.createDataFrame([(summary,)], "t string").select(X.smells(F.col("t"), F.lit(X.has_open_code_span(summary))).alias("s")).first().s if r != "suspiciously_short"]
        if found:
            raise ValueError(f"the text has smells: {', '.join(found)}")
        now = self.hashes().where(F.col("id") == id_).first()
        if now is None:
            raise ValueError(f"no document is wanted for {id_}")
        docs = {d.id: d for d in D.load(self.root)[0]}
        doc = docs.get(now.file) or D.Document("file", now.file)
        if id_ == now.file:
            raw = self.rel.files.where(F.col("file") == id_).first()
            doc.summary, doc.source_hash, doc.fingerprint, doc.deps_hash = summary, raw.source_hash, now.source_hash, now.deps_hash
            doc.spec_hash = D.body_hash(doc)
        else:
            doc.sections[id_] = {"source_hash": now.source_hash, "deps_hash": now.deps_hash, "summary": summary, "behavior": behavior}
            doc.sections[id_]["spec_hash"] = D.body_hash(doc, id_)
            doc.signatures = {r.id: r.signature for r in self.documented().where(F.col("file") == now.file).select("id", "signature").collect()}  # a file's symbols
            live = {r.id: r.ord for r in self.documented().where(F.col("file") == now.file).select("id", "ord").collect()}  # a file's symbols
            doc.sections = dict(sorted(((k, v) for k, v in doc.sections.items() if k in live), key=lambda kv: live[kv[0]]))
        deps = self.dependencies().where(F.col("owner") == id_).select("owner", "target", F.substring("hash", 1, 12).alias("h")).collect()  # a unit's targets
        doc.dep_targets = sorted([t for t in doc.dep_targets if t[0] != id_] + [(r.owner, r.target, r.h) for r in deps])
        return D.write(self.root, doc)

    def submit_rollup(self, module: str, summary: str) -> Path:
        """A folder's document, once all its files' documents are current."""
        items = self.coverage().where((F.col("module") == module) & (F.col("kind") == "file") & (F.col("role") != "test"))
        docs, _, _, _ = self._stored()
        rows = items.join(docs.select(F.col("doc_id").alias("id"), "spec_hash"), "id", "left").select("id", "status", "spec_hash").collect()  # a folder's files
        if not rows or any(r.status != "current" for r in rows):
            raise ValueError(f"not all documents of {module} are current")
        doc = D.Document("rollup", f"rollup:{module}", summary, children=sorted((r.id, r.spec_hash) for r in rows))
        heads = {d.id: d.summary.strip().split("\n")[0] for d in D.load(self.root)[0]}
        doc.contents = {"Contents": [(r.id, heads.get(r.id, "")) for r in sorted(rows)]}
        doc.spec_hash = D.body_hash(doc)
        return D.write(self.root, doc)

    # Features and the system

    def participant_hashes(self) -> DataFrame:
        """(entry, id, hash): core files by text, dependencies by interface (else source), tables by source."""
        own = self.participants()
        files = self.rel.files.select(F.col("file").alias("target"), F.col("source_hash").alias("text_hash"))
        symbols = self.rel.symbols.groupBy(F.col("id").alias("target")).agg(F.first("source_hash").alias("s"), F.first("interface_hash").alias("i"))
        rows = own.join(files, "target", "left").join(symbols, "target", "left")
        value = F.when(F.col("tier") == "core", F.col("text_hash")).when(F.col("tier") == "data", F.col("s")).otherwise(F.coalesce("i", "s"))
        return rows.select("entry", F.col("target").alias("id"), value.alias("hash"))

    def upper_status(self) -> DataFrame:
        """(id, kind, status) of features and the system: missing, or current while all recorded parts are as they were."""
        docs, _, children, _ = self._stored()
        want = self.entry_points().select(F.concat(F.lit("feature:"), "id").alias("doc_id"), F.lit("feature").alias("kind"))
        parts = self.participant_hashes().select(F.concat(F.lit("feature:"), "entry").alias("doc_id"), F.col("id").alias("child_id"), "hash")
        kids = docs.where("doc_kind IN ('rollup', 'feature')").select(F.lit("system").alias("doc_id"), F.col("doc_id").alias("child_id"), F.col("spec_hash").alias("hash"))
        system = self.spark.range(1).select(F.lit("system").alias("doc_id"), F.lit("system").alias("kind"))
        recorded = children.join(docs.where("doc_kind IN ('feature', 'system')").select("doc_id"), "doc_id", "left_semi")
        rows = S.upper_status(want.unionByName(system), parts.unionByName(kids), recorded, docs.where("spec_hash <> ''"))
        return rows.withColumnRenamed("doc_id", "id")

    def submit_feature(self, entry: str, summary: str) -> Path:
        rows = self.participant_hashes().where(F.col("entry") == entry).select("id", "hash").collect()  # one entry's participants
        if not rows:
            raise ValueError(f"no entry point is named {entry}")
        doc = D.Document("feature", f"feature:{entry}", summary, children=sorted((r.id, r["hash"] or "") for r in rows))
        doc.spec_hash = D.body_hash(doc)
        return D.write(self.root, doc)

    def submit_system(self, summary: str) -> Path:
        """The system's document, once every feature's is current."""
        late = self.upper_status().where("kind = 'feature' AND status <> 'current'")
        if not late.isEmpty():
            raise ValueError("not all features' documents are current")
        kids = [(d.id, d.spec_hash) for d in D.load(self.root)[0] if d.kind in ("rollup", "feature")]
        doc = D.Document("system", "system", summary, children=sorted(kids))
        heads = {d.id: d.summary.strip().split("\n")[0] for d in D.load(self.root)[0]}
        doc.contents = {"Modules": [(i, heads[i]) for i, _ in sorted(kids) if i.startswith("rollup:")], "Features": [(i, heads[i]) for i, _ in sorted(kids) if i.startswith("feature:")]}
        doc.spec_hash = D.body_hash(doc)
        return D.write(self.root, doc)

    # Moved documents and older ones

    def adoption_plan(self) -> DataFrame:
        """What to do with sections whose symbol is gone: adopt under a new id, or why not."""
        from stratagraph.operators import adopt

        _, sections, _, _ = self._stored()
        name = F.regexp_extract("id", r"([^:.]*)$", 1).alias("name")
        now = self.documented().select("id", "file", name, F.col("source_hash").alias("hash"))
        old = sections.select(F.col("symbol_id").alias("id"), F.col("doc_id").alias("file"), F.col("source_hash").alias("hash")).join(now.select("id"), "id", "left_anti")
        free = now.join(sections.select(F.col("symbol_id").alias("id")), "id", "left_anti")
        return adopt.plan(old.select("id", "file", name, "hash"), free)

    def adopt(self) -> list[tuple[str, str]]:
        """Move the texts of adoptable sections to their successors; returns (old id, new id)."""
        moves = [(r.id, r.successor) for r in self.adoption_plan().where("disposition = 'adopt'").orderBy("id").collect()]  # documents to write
        texts = {k: (d.id, h) for d in D.load(self.root)[0] for k, h in d.sections.items()}
        for old, new in moves:
            _, h = texts[old]
            self.submit(new, h["summary"], h["behavior"])
        for d in D.load(self.root)[0]:
            gone = [o for o, _ in moves if o in d.sections]
            if gone:
                d.sections = {k: v for k, v in d.sections.items() if k not in gone}
                if d.sections or self.rel.files.where(F.col("file") == d.id).count():
                    D.write(self.root, d)
                else:
                    Path(self.root, D.ROOT, D.path_of(d.kind, d.id)).unlink()
        return moves

    def backfill_dep_targets(self) -> int:
        """Record dependency targets in documents that lack them, where the recorded hash can be made again."""
        docs, sections, _, recorded = self._stored()
        units = docs.where("doc_kind = 'file'").select(F.col("doc_id").alias("id"), "deps_hash").unionByName(sections.select(F.col("symbol_id").alias("id"), "deps_hash"))
        bare = units.join(recorded.select(F.col("owner").alias("id")), "id", "left_anti").join(self.hashes().select("id", "deps_hash"), ["id", "deps_hash"], "left_semi")
        made = self.dependencies().join(bare.select(F.col("id").alias("owner")), "owner", "left_semi")
        deps: dict[str, list[tuple[str, str, str]]] = {}
        for r in made.select("owner", "target", F.substring("hash", 1, 12).alias("h")).collect():  # what is written into documents, no more
            deps.setdefault(r.owner, []).append((r.owner, r.target, r.h))
        done = 0
        for d in D.load(self.root)[0]:
            have = {o for o, _, _ in d.dep_targets}
            for owner in [d.id, *d.sections]:
                if d.kind == "file" and owner not in have and deps.get(owner):
                    d.dep_targets += deps[owner]
                    done += 1
            if len(d.dep_targets) > len([1 for o, _, _ in d.dep_targets if o in have]):
                d.dep_targets.sort()
                D.write(self.root, d)
        return done

    def migrate_fingerprints(self) -> int:
        """Give documents that describe their file's present text the present fingerprint; others stay stale."""
        docs = self._stored()[0].where("doc_kind = 'file' AND spec_hash <> ''").select(F.col("doc_id").alias("file"), "source_hash", F.col("fingerprint").alias("_was"))
        due = self.rel.files.join(docs, ["file", "source_hash"]).where(~F.col("fingerprint").eqNullSafe(F.col("_was")))
        now = {r.file: r.fingerprint for r in due.select("file", "fingerprint").collect()}  # documents that are rewritten, no more
        done = 0
        for d in D.load(self.root)[0] if now else []:
            if d.kind == "file" and d.id in now:
                d.fingerprint = now[d.id]
                D.write(self.root, d)
                done += 1
        return done

    def migrate_documents(self) -> int:
        """Bring older documents to the present keys, title and provenance line; running it again changes nothing."""
        done = 0
        for path in sorted(Path(self.root, D.ROOT).rglob("*.md")):
            text = path.read_text()
            new = D.migrate_keys(text) if text.startswith("---\n") else text
            if new != text:
                path.with_suffix(".md.tmp").write_text(new)
                path.with_suffix(".md.tmp").replace(path)
                done += 1
        return done

    def get_spec(self, id_: str) -> dict:
        """A document's text with its status, what changed and its smells."""
        docs = {d.id: d for d in D.load(self.root)[0]}
        doc = docs.get(id_) or docs.get(id_.split("::")[0])
        if doc is None or ("::" in id_ and id_ not in doc.sections):
            return {"id": id_, "status": "missing", "content": None, "changed": [], "smells": []}
        content = doc.summary if "::" not in id_ else f"{doc.sections[id_]['summary']}\n{doc.sections[id_]['behavior']}"
        changed = sorted(r.change for r in self.changes().where(F.col("id") == id_).collect()) if doc.kind == "file" else []  # one document's changes
        if doc.kind != "file":
            state = self.upper_status() if doc.kind in ("feature", "system") else self.coverage()
            stale = state.where((F.col("id") == id_) & (F.col("status") != "current")).count() > 0
        else:
            stale = bool(changed)
        smells = self.spark.createDataFrame([(content,)], "t string").select(X.smells(F.col("t"), F.lit(X.has_open_code_span(content))).alias("s")).first().s
        return {"id": id_, "status": "stale" if stale else "current", "content": content, "changed": changed, "smells": list(smells)}

    def statistics(self) -> DataFrame:
        """Counts of symbols by kind and of edges by form, with how many are resolved."""
        nodes = self.rel.symbols.groupBy(F.concat_ws(":", F.lit("symbol"), "kind").alias("what")).agg(F.count("*").alias("total"), F.count_if("is_exported").alias("resolved"))
        edges = self.imports.groupBy(F.concat_ws(":", F.lit("import"), "form").alias("what")).agg(F.count("*").alias("total"), F.count("target").alias("resolved"))
        links = self.flows.groupBy(F.concat_ws(":", F.lit("flow"), "kind").alias("what")).agg(F.count("*").alias("total"), F.count("target").alias("resolved"))
        return nodes.unionByName(edges).unionByName(links)
