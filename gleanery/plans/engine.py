"""Engine: one object over a corpus of notes and code that answers searches, reads, inventories, links and packs.

The corpus is a table notes (path, mtime, text) and optionally sources (path, text), no_text (path, mtime, reason),
failures (path, reason) and vectors (path, off, mtime, v).

The index is a list of segments in a folder. A build writes one more segment with the rows of new and changed paths and
a list of the paths whose rows in earlier segments are dead; a small file, replaced at once, names the segments. After
MAX_SEGMENTS builds they are merged. Postings stand in ranges of terms, so a search reads the row groups of its own
terms. Links are stored resolved, with a table of the names they ask for: a build parses the links of changed notes alone
and resolves anew only those and the links whose names came or went with notes. One build runs at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import code, markdown, units
from gleanery.functions import text as T
from gleanery.functions.arrow import generate
from gleanery.operators import codegraph, files, fusion, lexical, links, refresh, windows
from gleanery.session import only_writer, prepare, read_text, remove_shared, replace_text

VERSIONS = {"tokenizer": T.TOKENIZER_VERSION, "graph": 5, "layout": 3}
MAX_SEGMENTS = 8
LINKS = [("kind", "string"), ("target", "string"), ("scaffold", "boolean")]


class EngineError(Exception):
    """code is one of not_found, out_of_root, changed, index_cold, unconverted, bad_argument, consent_required."""

    def __init__(self, code_: str, message: str = "") -> None:
        super().__init__(message or code_)
        self.code = code_


class Engine:
    def __init__(
        self, spark: SparkSession, notes: DataFrame, index_dir: str, sources: DataFrame | None = None, no_text: DataFrame | None = None,
        failures: DataFrame | None = None, vectors: DataFrame | None = None, embed: Callable[[str], Sequence[float]] | None = None,
    ) -> None:
        self.spark, self.notes, self.index_dir = prepare(spark), notes, index_dir.rstrip("/")
        self.sources = sources if sources is not None else spark.createDataFrame([], "path string, text string")
        self.no_text = no_text if no_text is not None else spark.createDataFrame([], "path string, mtime double, reason string")
        self.failures = failures if failures is not None else spark.createDataFrame([], "path string, reason string")
        self.vectors, self.embed = vectors, embed

    # Index ----------------------------------------------------------------------------------------

    def _live(self) -> DataFrame:
        code_files = self.sources.select("path", F.lit(0.0).alias("mtime"), "text", F.lit(True).alias("is_code"))
        return self.notes.select("path", F.col("mtime").cast("double").alias("mtime"), "text", F.lit(False).alias("is_code")).unionByName(code_files)

    def _meta(self) -> dict | None:
        """segments, retired, n and avgdl of the index, null if there is none of these versions."""
        content = read_text(self.spark, f"{self.index_dir}/meta.json")
        meta = json.loads(content) if content else None
        return meta if meta and meta["versions"] == VERSIONS else None

    def _stored(self, name: str, meta: dict | None = None) -> DataFrame | None:
        """The live rows of a table of the index: those of each segment without the paths that a later one declares dead."""
        meta = meta or self._meta()
        if meta is None:
            return None
        read = lambda segment, table: self.spark.read.parquet(f"{self.index_dir}/{segment}/{table}")
        parts = []
        for i, segment in enumerate(meta["segments"]):
            rows, later = read(segment, name), meta["segments"][i + 1 :]
            every = lambda table, later=later: reduce(DataFrame.union, [read(x, table) for x in later]).distinct()
            rows = rows.join(every("dead"), "path", "left_anti") if later else rows
            if later and name in ("resolved", "wanted"):
                rows = rows.join(every("dead_links"), ["path", "target"], "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    def _changes(self) -> DataFrame:
        stamps = self._stored("stamps")
        if stamps is None:
            stamps = self.spark.createDataFrame([], "path string, mtime double")
        return refresh.changes(self._live().select("path", "mtime"), stamps.select("path", "mtime"))

    def state(self) -> dict:
        row = refresh.state(self._changes(), self._meta() is not None).first()
        return {"state": row["state"], "pending": row["pending"]}

    def _documents(self, live: DataFrame) -> DataFrame:
        """key, path, off, is_code, text of what is scored first: notes with their name, code units."""
        notes = live.where(~F.col("is_code"))
        name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]+$", "")
        docs = notes.select(F.col("path").alias("key"), "path", F.lit(None).cast("int").alias("off"), "is_code", F.concat(name, F.lit("\n"), T.text_of("text")).alias("text"))
        parts = codegraph.units(live.where("is_code").select("path", "text"))
        return docs.unionByName(parts.select(F.concat_ws("#", "path", F.col("off").cast("string")).alias("key"), "path", "off", F.lit(True).alias("is_code"), "text"))

    def _sections(self, live: DataFrame) -> DataFrame:
        notes = units.sections(live.where(~F.col("is_code")), "path", "text").select("path", "off", "text", "title", F.lit(False).alias("is_code"))
        parts = codegraph.units(live.where("is_code").select("path", "text")).select("path", "off", "text", "title", F.lit(True).alias("is_code"))
        both = notes.unionByName(parts)
        return both.withColumn("key", F.when(F.col("is_code"), F.concat_ws("#", "path", F.col("off").cast("string"))).otherwise(F.col("path")))

    def build(self, rebuild: bool = False) -> dict:
        """Bring the index up to the live files; unchanged paths keep their rows. The old segments serve until the new one is whole."""
        with only_writer(self.spark, f"{self.index_dir}/lock") as mine:
            if not mine:
                raise EngineError("changed", "another build of this index is running")
            return self._build(rebuild)

    def _build(self, rebuild: bool) -> dict:
        meta = self._meta()
        kept = None if rebuild else meta
        for segment in (meta or {}).get("retired", []):
            remove_shared(self.spark, f"{self.index_dir}/{segment}")
        changed = self._changes().cache()
        counts = {r["change"]: r["count"] for r in changed.groupBy("change").count().collect()}
        told = {"changed": counts.get("new", 0) + counts.get("changed", 0), "gone": counts.get("gone", 0)}
        if kept is not None and not any(told.values()):
            changed.unpersist()
            return told
        live = self._live()
        todo = live if kept is None else live.join(changed.where("change IN ('new', 'changed')").select("path"), "path", "left_semi")
        dead = changed.where("change IN ('changed', 'gone')").select("path")
        docs, sections = self._documents(todo), self._sections(todo)
        segment = uuid.uuid4().hex
        prose = live.where(~F.col("is_code")).select("path")
        fresh = self._parsed_links(todo.where(~F.col("is_code"))).withColumnRenamed("path", "src")
        if kept is None:
            renewed, redone = links.resolve(fresh, prose), dead.where("false").select("path", F.lit("").alias("target"))
        else:
            _, renewed, hit = self._patched(kept, changed, prose, fresh)
            redone = hit.select(F.col("src").alias("path"), "target")
        self._write(segment, {"resolved": renewed.withColumnRenamed("src", "path")})
        renewed = self.spark.read.parquet(f"{self.index_dir}/{segment}/resolved").withColumnRenamed("path", "src")
        self._write(segment, {
            "postings": units.terms(docs, ["key", "path"], T.index_tokens("text")),
            "documents": docs.select("key", "path", F.size(T.index_tokens("text")).cast("long").alias("dl"), "is_code"),
            "section_terms": units.terms(sections, ["key", "path", "off"], T.index_tokens("text")),
            "sections": sections.select("key", "path", "off", "title", "text", "is_code", F.size(T.index_tokens("text")).cast("long").alias("dl")),
            "stamps": todo.select("path", "mtime"),
            "wanted": links.wanted_names(renewed).withColumnRenamed("src", "path").repartitionByRange("name", "path").sortWithinPartitions("name"),
            "dead": dead if kept is not None else dead.where("false"),
            "dead_links": redone,
        })
        new = {"versions": VERSIONS, "segments": [*(kept["segments"] if kept else []), segment], "retired": [] if kept or not meta else meta["segments"]}
        if len(new["segments"]) > MAX_SEGMENTS:
            merged = uuid.uuid4().hex
            names = ("postings", "documents", "section_terms", "sections", "stamps", "resolved", "wanted")
            none = {"dead": dead.where("false"), "dead_links": redone.where("false")}
            self._write(merged, {name: self._stored(name, new) for name in names} | none)
            new |= {"segments": [merged], "retired": new["segments"]}
        n, total = self._stored("documents", new).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        replace_text(self.spark, f"{self.index_dir}/meta.json", json.dumps(new | {"n": n, "avgdl": total / n if n else 1.0}))
        changed.unpersist()
        return told

    def _write(self, segment: str, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            if "term" in rows.columns:  # ranges of terms, those of a very common one cut by key
                rows = rows.repartitionByRange("term", "key").sortWithinPartitions("term", "key")
            rows.write.parquet(f"{self.index_dir}/{segment}/{name}")

    def _index(self, terms: Sequence[str]) -> lexical.Index:
        """The part of the index that knows these terms."""
        meta = self._meta()
        if meta is None:
            raise EngineError("index_cold")
        postings = self._stored("postings", meta).where(F.col("term").isin(*terms) if terms else F.lit(False))
        frequencies = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        stats = self.spark.range(1).select(F.lit(meta["n"]).alias("n"), F.lit(float(meta["avgdl"])).alias("avgdl"))
        return lexical.Index("key", postings, self._stored("documents", meta), frequencies, stats)

    # Search ---------------------------------------------------------------------------------------

    def search(self, query: str, queries: Sequence[str] = (), folder: str | None = None, k: int = 5, per_doc: int = 2, width: int = 600) -> dict:
        """Ranked, located passages with honest signals of what the corpus doesn't cover."""
        state = self.state()
        if refresh.should_refresh(state["state"], state["pending"]):
            self.build()
            state = self.state()
        groups = [query, *(q for q in queries if q.strip())]
        asked = self.spark.createDataFrame(list(enumerate(groups)), "grp int, text string")
        grouped = lexical.query_terms(asked, "grp", T.index_tokens("text")).cache()
        terms = sorted({r["term"] for r in grouped.collect()})  # those of one query
        ix = self._index(terms)
        whole = grouped.select(F.lit(0).alias("qid"), "term").distinct()
        weights = lexical.weigh(ix, whole).cache()
        known = weights.where("df > 0").select("term", "df", "idf")
        mass = weights.agg(F.sum("idf")).first()[0] or 1.0
        by_group = grouped.select(F.col("qid"), "term").join(known, "term")
        in_scope = files.in_folder(F.col("path"), folder)
        paths = ix.documents.select("key", "path", "is_code")
        scored = lexical.score(ix, by_group).join(paths.where(in_scope), "key")
        by = [F.desc("score"), F.asc("key")]
        dense = self._dense(query, in_scope)
        if len(groups) == 1 and dense is None:
            order = scored.select("key", "path", "score", "matched", "mass", F.col("score").alias("fused"))
        else:
            lists = [fusion.ranked(scored, "bm25", "key", by)]
            fused_lists = [one.withColumn("qid", F.lit(0)) for one in lists]
            if dense is not None:
                keyed = dense.groupBy("key").agg(F.max("cosine").alias("cosine")).withColumn("qid", F.lit(0))
                fused_lists.append(fusion.ranked(keyed, "dense", "key", [F.desc("cosine"), F.asc("key")]))
            fused = fusion.rrf(fused_lists, "key").select("key", "fused")
            raw = scored.groupBy("key").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("matched"))
            order = fused.join(raw, "key", "left").join(paths, "key").select(
                "key", "path", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("matched", F.array().cast("array<string>")).alias("matched"), "fused")
        order = order.withColumn("qid", F.lit(0)).cache()
        pool = lexical.top(order, lexical.pool_size(k), [F.desc("fused"), F.asc("key")]).cache()
        hits = self._hits(pool, by_group, weights, groups, dense, k, per_doc, width, terms)
        idf = {r["term"]: r["idf"] for r in known.collect()}  # the query's own terms
        share = lambda matched: round(sum(idf.get(t, 0.0) for t in matched) / mass, 2)
        found_paths = {h["path"] for h in hits}
        documents = [
            {"path": r["path"], "score": round(r["score"], 2), "matched_terms": sorted(r["matched"]), "coverage": share(r["matched"])}
            for r in pool.orderBy("rank").collect() if r["rank"] <= k or r["path"] in found_paths]
        inside = ix.documents.where(in_scope)
        out = {
            "query": query, "hits": [h | {"coverage": share(h["matched_terms"])} for h in hits], "documents": documents, "candidates": order.count(),
            "terms_absent": [r["term"] for r in weights.where("df = 0").orderBy("term").collect()],
            "scope": {"folder": folder or "", "docs": inside.select("path").distinct().count(),
                      "unconverted": self.no_text.where(in_scope).count(), "failed": self.failures.where(in_scope).count()},
            "dense": {"state": refresh.dense_state(self.embed is not None, True, False, False, 1 if self.vectors is not None else 0)}, "index": state}
        if folder:
            scope = inside.select("key")
            out["terms_absent_in_scope"] = next((r["absent_in_scope"] for r in lexical.absent_in_scope(ix, weights, scope).collect()), [])
        if len(groups) > 1:
            out["queries"] = groups[1:]
        for frame in (grouped, weights, order, pool):
            frame.unpersist()
        return out

    def _dense(self, query: str, in_scope) -> DataFrame | None:
        """key, path, off, cosine of the sections whose document is as it was when embedded; the first query alone."""
        if self.embed is None or self.vectors is None:
            return None
        try:
            asked = [(0, [float(x) for x in self.embed(query)])]
        except Exception:  # noqa: BLE001  without the embedder the words still answer
            return None
        q = self.spark.createDataFrame(asked, "qid int, query_vector array<double>").withColumn("query_vector", fusion.unit(F.col("query_vector")))
        live = self._live().select("path", "mtime", "is_code")
        vectors = self.vectors.withColumn("mtime", F.col("mtime").cast("double")).join(live, ["path", "mtime"]).where(in_scope)
        found = fusion.cosine(vectors.withColumn("v", fusion.unit(F.col("v"))).withColumn("at", F.struct("path", "off", "is_code")), q, "at", "path", "v")
        return found.select(F.when(F.col("at.is_code"), F.concat_ws("#", "at.path", F.col("at.off").cast("string"))).otherwise(F.col("at.path")).alias("key"), F.col("at.path").alias("path"), F.col("at.off").alias("off"), "cosine")

    def _hits(self, pool, by_group, weights, groups, dense, k, per_doc, width, terms) -> list[dict]:
        meta = self._meta()
        section_terms, sections = self._stored("section_terms", meta), self._stored("sections", meta)
        section_terms = section_terms.where(F.col("term").isin(*terms) if terms else F.lit(False))
        keys = ["key", "path", "off"]
        lengths = sections.where("dl > 0").select(*keys, "dl")
        wanted = pool.select("qid", "key")
        scored = lexical.score_sections(section_terms, wanted, weights, keys, lengths)
        by = [F.desc("score"), F.asc("path"), F.asc("off")]
        if dense is not None:
            near = dense.join(wanted.select("key"), "key", "left_semi").select(F.lit(0).alias("qid"), *keys, "cosine")
            scored = scored.join(near, ["qid", *keys], "full_outer").withColumns({"score": F.coalesce("score", F.lit(0.0)), "matched": F.coalesce("matched", F.array().cast("array<string>"))})
        else:
            scored = scored.withColumn("cosine", F.lit(None).cast("double"))
        if len(groups) == 1 and dense is None:
            ranked, order = scored, by
        else:
            at = F.struct(*keys)
            group_pool = by_group.select("qid").distinct().crossJoin(F.broadcast(wanted.select("key")))
            lists = [fusion.ranked(lexical.score_sections(section_terms, group_pool, by_group, keys, lengths).withColumn("at", at), "bm25", "at", [F.desc("score"), F.asc("at")]).withColumn("qid", F.lit(0))]
            if dense is not None:
                lists.append(fusion.ranked(near.withColumn("at", at), "dense", "at", [F.desc("cosine"), F.asc("at")]))
            fused = fusion.rrf(lists, "at").select("at", "fused")
            ranked, order = scored.withColumn("at", at).join(fused, "at").drop("at"), [F.desc("fused"), F.asc("path"), F.asc("off")]
        best = lexical.cap(ranked, "path", per_doc, k, order)
        best = best.cache()
        found = [r["path"] for r in best.select("path").distinct().collect()]  # k at most
        live = self._live().where(F.col("path").isin(*found) if found else F.lit(False))
        rows = best.join(sections.drop("dl"), keys).join(live.select("path", F.col("text").alias("_whole")), "path")
        idf = [(r["term"], r["idf"]) for r in weights.where("df > 0").collect()]
        asked = self.spark.range(1).select(T.window_terms(F.lit(" ".join(groups))).alias("t")).first()["t"]
        lookup = dict(idf)
        rows = windows.with_densest(rows, "text", [(t, lookup.get(t, 1.0)) for t in asked], width, "_at", "_density")
        rows = rows.withColumn("_snap", F.when(F.length("text") <= width, F.lit(0)).otherwise(windows.snapped(F.col("text"), F.col("_at"), width)))
        whole = F.length("text") <= width
        window = F.when(whole, F.col("text")).otherwise(F.substring("text", F.col("_snap") + 1, F.col("_at") + width - F.col("_snap")))
        line = units.line_at(F.col("_whole"), F.col("off") + F.col("_snap"))
        first = units.line_at(F.col("_whole"), F.col("off"))
        last = first + F.regexp_count(F.rtrim(F.regexp_replace("text", r"\s+$", "")), F.lit("\n"))
        rows = rows.select("rank", "path", F.col("title").alias("section"), line.alias("line"), T.version("_whole").alias("version"), F.round("score", 2).alias("score"),
                           F.array_sort("matched").alias("matched_terms"), window.alias("window"), F.when(F.col("is_code"), F.array(first, last)).alias("span"), F.round("cosine", 3).alias("dense"))
        out = []
        for r in rows.orderBy("rank").collect():  # k rows
            hit = {x: r[x] for x in ("path", "section", "line", "version", "score", "matched_terms", "window")}
            out.append(hit | ({"span": list(r["span"])} if r["span"] else {}) | ({"dense": r["dense"]} if r["dense"] is not None else {}))
        return out

    # Reading, inventory, links, code --------------------------------------------------------------

    def read(self, path: str, start: int = 1, end: int | None = None, section: str | None = None, max_chars: int = 20_000, expect_version: str | None = None) -> dict:
        """Lines of one file, by number or by the title of a section."""
        if path.startswith("/") or ".." in path.split("/"):
            raise EngineError("out_of_root", path)
        one = self._live().where(F.col("path") == path).select("path", T.text_of("text").alias("text"))
        row = one.select("text", T.version("text").alias("version")).first()
        if row is None:
            raise EngineError("unconverted" if self.no_text.where(F.col("path") == path).count() else "not_found", path)
        if expect_version and expect_version != row["version"]:
            raise EngineError("changed", path)
        if section:
            found = markdown.headings(row["text"]) if code.language_for(path) is None else [(2 if s[2] else 1, f"{s[2]}.{s[1]}" if s[2] else s[1], s[5], s[6]) for s in code.skeleton(row["text"], code.language_for(path)).symbols]
            hit = [h for h in found if h[1].casefold() == section.casefold()] or [h for h in found if h[1].casefold().startswith(section.casefold())]
            if len(hit) != 1:
                raise EngineError("bad_argument" if hit else "not_found", section)
            start, end = hit[0][2], hit[0][3]
        rows = files.read_slice(units.lines(one, "path", "text"), "path", start, end, max_chars).orderBy("line").collect()
        following = rows[0]["next_start"] if rows else None
        return {"path": path, "version": row["version"], "start": start, "text": "\n".join(r["text"] for r in rows), "truncated": following is not None, "next_start": following}

    def outline(self, path: str) -> list[dict]:
        row = self._live().where(F.col("path") == path).select("text").first()
        if row is None:
            raise EngineError("not_found", path)
        return [{"level": a, "title": b, "line": c, "end_line": d} for a, b, c, d in markdown.headings(row["text"])]

    def files(self, folder: str | None = None, status: str | None = None, limit: int = 100, cursor: str | None = None) -> dict:
        live = self._live().withColumn("bytes", F.octet_length(T.text_of("text")).cast("long")).select("path", "mtime", "bytes")
        live = live.unionByName(self.no_text.select("path", F.col("mtime").cast("double").alias("mtime"), F.lit(0).cast("long").alias("bytes")).join(live, "path", "left_anti"))
        stamps = self._stored("stamps")
        stamps = stamps if stamps is not None else live.where("false").select("path", "mtime")
        rows = files.statuses(live, stamps, self.no_text, self.failures, files.code_suffixes()).where(files.in_folder(F.col("path"), folder))
        counts = {r["status"]: r["n"] for r in files.status_counts(rows).collect()}
        page, following = files.page(rows.where(F.col("status") == status) if status else rows, limit, cursor)
        return {"files": [r.asDict() for r in page.collect()], "counts": counts, "next_cursor": following}

    def _parsed_links(self, notes: DataFrame) -> DataFrame:
        """path, target, scaffold of notes; those without any mark of a link are never parsed."""
        marked = notes.where(F.col("text").rlike(r"\[|<|ADR-|&#|&l")).select("path", "text")
        rows = generate(marked, ["path"], ["text"], lambda t: markdown.link_rows(t), LINKS)
        return rows.where("kind = 'link'").select("path", "target", "scaffold")

    def _patched(self, meta: dict, changed: DataFrame, prose: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The stored graph brought up to changed (path, change): what stays of it, the links resolved anew, and which stored ones these replace."""
        of = lambda *kinds: changed.where(F.col("change").isin(*kinds)).select("path")
        stored, wanted = (self._stored(x, meta).withColumnRenamed("path", "src") for x in ("resolved", "wanted"))
        return links.patch(stored, wanted, prose, of("new"), of("gone"), of("changed", "gone"), fresh)

    def resolved_links(self) -> DataFrame:
        """src, target, scaffold, dst of all notes: the stored graph, patched where notes have changed since."""
        meta, notes = self._meta(), self.notes
        if meta is None:
            return links.resolve(self._parsed_links(notes).withColumnRenamed("path", "src"), notes.select("path"))
        changed = self._changes()
        fresh = notes.join(changed.where("change IN ('new', 'changed')").select("path"), "path", "left_semi")
        stays, renewed, _ = self._patched(meta, changed, notes.select("path"), self._parsed_links(fresh).withColumnRenamed("path", "src"))
        return stays.unionByName(renewed)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        resolved = self.resolved_links()
        return links.edges(resolved), links.unresolved(resolved)

    def search_names(self, queries: Sequence[str]) -> DataFrame:
        """qid, path: notes whose name holds a query."""
        return links.search_names(self.notes.select("path"), self.spark.createDataFrame(list(enumerate(queries)), "qid int, q string"))

    def search_context(self, queries: Sequence[str], per_note: int = 20) -> DataFrame:
        """qid, path, line, snippet, note_matches: the lines that hold a query word for word, without regard to case."""
        asked = self.spark.createDataFrame(list(enumerate(queries)), "qid int, q string")
        return links.context_search(units.lines(self.notes, "path", "text"), asked, per_note)

    def links_of(self, path: str) -> list[str]:
        edges, ghosts = self.graph()
        rows = edges.where(F.col("src") == path).select("dst").union(ghosts.where(F.col("src") == path).select("target"))
        return sorted(r[0] for r in rows.collect())

    def backlinks_of(self, path: str) -> list[str]:
        return sorted(r["src"] for r in self.graph()[0].where(F.col("dst") == path).collect())

    def orphans(self, most: int = 200) -> list[str]:
        return [r["path"] for r in links.orphans(self.notes.select("path"), self.graph()[0]).orderBy("path").limit(most).collect()]

    def unresolved(self) -> list[tuple[str, str]]:
        return sorted((r["src"], r["target"]) for r in self.graph()[1].collect())

    def lint(self, path: str) -> list[dict]:
        rows = links.lint(self.notes.where(F.col("path") == path).select("path", "text"), self.notes.select("path"))
        return [r.asDict() for r in rows.orderBy("line", "target").collect()]

    def code_pack(self, target: str, budget: int = 12_000) -> dict:
        return codegraph.pack(self.sources, target, budget)

    def status(self) -> DataFrame:
        """check, verdict: what a user would look at first."""
        state, meta = self.state(), self._meta()
        some = lambda frame: frame.limit(1).count() > 0
        shared = self.spark.conf.get("spark.checkpoint.dir", None)
        rows = [
            ("corpus", "ok" if some(self.notes) or some(self.sources) else "fail", "" if some(self.notes) else "no notes"),
            ("index", "ok" if state["state"] == "ready" else "warn", f"{state['state']}, {state['pending']} pending"),
            ("segments", "ok" if meta and len(meta["segments"]) <= MAX_SEGMENTS else "warn", str(len(meta["segments"])) if meta else "no index"),
            ("unconverted", "ok" if not some(self.no_text) else "warn", "files without text" if some(self.no_text) else ""),
            ("failures", "ok" if not some(self.failures) else "warn", ""),
            ("vectors", "ok" if self.vectors is not None and self.embed is not None else "warn", "" if self.embed is not None else "no embedder"),
            ("shared folder", "ok" if shared else "warn", shared or "spark.checkpoint.dir is not set")]
        return self.spark.createDataFrame(rows, "check string, verdict string, note string")
