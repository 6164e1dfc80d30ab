"""The link graph of notes: resolving targets, degrees, orphans, unresolved links, context search.

notes (path); raw_links (src, target, scaffold). A path has few suffixes, so a target that names the end of a path meets
the notes in an equi-join on suffixes written out once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import markdown
from gleanery.functions import text as T
from gleanery.functions.arrow import generate
from gleanery.operators import grams

def bare(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.md$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def relative(source: Column, target: Column) -> Column:
    """A target of ./ and ../ steps joined to the source's folder; null if it leaves the root."""
    start = F.filter(F.split(folder(source), "/"), lambda p: p != "")
    up = F.struct(start.alias("at"), F.lit(True).alias("ok"))

    def step(acc: Column, part: Column) -> Column:
        back = F.struct(F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0))).alias("at"), (acc["ok"] & (F.size(acc["at"]) > 0)).alias("ok"))
        return F.when(part.isin("", "."), acc).when(part == "..", back).otherwise(F.struct(F.concat(acc["at"], F.array(part)).alias("at"), acc["ok"].alias("ok")))

    return F.aggregate(F.split(target, "/"), up, step, lambda acc: F.when(acc["ok"], F.array_join(acc["at"], "/")))


def suffixes(notes: DataFrame) -> DataFrame:
    """path, suffix, whole: every lower-case tail of a path without .md, and whether it is the whole path."""
    parts = F.split(F.lower(bare(F.col("path"))), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/").alias("suffix"), (i == 1).alias("whole")))
    return notes.select("path", F.explode(tails).alias("t")).select("path", "t.suffix", "t.whole")


def ancestors(path: Column) -> Column:
    """The folders that a path lies in, from the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def asking(raw_links: DataFrame) -> DataFrame:
    """src, target, scaffold with what a link asks for: a name (_wanted), a record's number, and whether the target is the note itself or relative."""
    clean = bare(F.regexp_replace(F.col("target"), r"[#^|].*$", ""))
    is_rel = F.col("target").rlike(r"^\.{1,2}/")
    wanted = F.lower(F.when(is_rel, bare(relative(F.col("src"), F.col("target")))).otherwise(clean))
    rows = raw_links.select("src", "target", "scaffold", wanted.alias("_wanted"), (F.col("target").rlike(r"^[#^]") | (F.trim(clean) == "")).alias("_self"),
                            is_rel.alias("_rel"), folder(F.col("src")).alias("_from"))
    return rows.withColumn("_number", F.regexp_replace(F.regexp_extract("_wanted", r"^adr[- ]?(\d{1,4})$", 1), "^0+", ""))


def numbered(notes: DataFrame) -> DataFrame:
    """path, name: the numbers of decision records."""
    return notes.select("path", F.regexp_extract(F.lower("path"), r"(?:^|/)0*(\d{1,4})-[^/]*$", 1).alias("name")).where("name <> ''").distinct()


def places(notes: DataFrame) -> DataFrame:
    """i, name, below, path: the first path for each name of a kind i, below each folder and anywhere (below the empty name).

    Kinds: whole paths, ends of paths, numbers in a folder of records, numbers elsewhere. First is the path with the least
    number of slashes, then the least without regard to case; one row a name and folder, however common the name is.
    """
    tails, records = suffixes(notes).select("path", F.col("suffix").alias("name"), "whole"), numbered(notes)
    kind = F.when(F.lower("path").rlike(r"(^|/)adrs?/"), 2).otherwise(3)
    every = tails.select("path", "name", F.explode(F.when(F.col("whole"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("i")).unionByName(
        records.select("path", "name", kind.alias("i")))
    under = every.select("i", "name", "path", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("below"))
    return under.groupBy("i", "name", "below").agg(F.min(F.struct(depth(F.col("path")).alias("d"), F.lower("path").alias("l"), "path"))["path"].alias("path"))


def names_of(notes: DataFrame) -> DataFrame:
    """path, name: every name by which a link can find a note; a record's number as #number."""
    tails = suffixes(notes).select("path", F.col("suffix").alias("name"))
    return tails.union(numbered(notes).select("path", F.concat(F.lit("#"), "name"))).distinct()


def wanted_names(raw_links: DataFrame) -> DataFrame:
    """src, target, scaffold, name: the reverse table, the names that decide where each link leads. Links to the note itself have none."""
    names = F.array_compact(F.array(F.col("_wanted"), F.when(F.col("_number") != "", F.concat(F.lit("#"), "_number"))))
    return asking(raw_links).where("NOT _self").select("src", "target", "scaffold", F.explode(F.array_distinct(names)).alias("name"))


def patch(stored: DataFrame, wanted: DataFrame, notes: DataFrame, added: DataFrame, gone: DataFrame, stale: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of a resolved graph after notes have changed, and the links resolved anew, both as src, target, scaffold, dst; src, target of the stored ones that these replace.

    stored is the graph before, wanted its reverse table. notes are all there are now, added and gone those that came and
    went, stale the sources whose stored links hold no more (path each), fresh the links of new and changed notes. A link
    is resolved anew only if it is fresh or asks for a name that a note brought or took away, and it meets only notes
    that have a name it asks for.
    """
    alive = stored.join(stale.select(F.col("path").alias("src")), "src", "left_anti")
    moved = names_of(added.select("path").union(gone.select("path"))).select("name").distinct()
    hit = wanted.join(moved, "name", "left_semi").select("src", "target").distinct()
    redo = alive.join(hit, ["src", "target"], "left_semi").select("src", "target", "scaffold").unionByName(fresh.select("src", "target", "scaffold"))
    asked = wanted_names(redo).select("name").distinct()
    near = names_of(notes).join(asked, "name", "left_semi").select("path").distinct()
    return alive.join(hit, ["src", "target"], "left_anti").select("src", "target", "scaffold", "dst"), resolve(redo, near), hit


def resolve(raw_links: DataFrame, notes: DataFrame) -> DataFrame:
    """src, target, scaffold, dst: dst is null where no note fits.

    An anchor is the note itself; a relative target is normalised; a target with a slash is a whole path, else a path's
    end; a name is a file's stem, else a numbered decision record. Of several notes those under the source's folder come
    first, then the least number of slashes, then the least lower-case path. Each lookup meets one row a name.
    """
    rows = asking(raw_links).groupBy("src", "target", "scaffold", "_wanted", "_number", "_self", "_rel", "_from").agg(F.count(F.lit(1)).alias("_n"))
    slash = F.contains(F.col("_wanted"), F.lit("/"))
    tries = [("_wanted", slash | F.col("_rel")), ("_wanted", ~F.col("_rel")), ("_number", F.col("_number") != ""), ("_number", F.col("_number") != "")]
    asks = []
    for i, (name, when) in enumerate(tries):
        for kind, below in enumerate((F.when(F.col("_from") != "", F.col("_from")), F.lit(""))):  # under the source's folder, then anywhere
            asks.append(F.when(when & ~F.col("_self") & below.isNotNull(), F.struct(F.lit(i).alias("i"), F.col(name).alias("name"), below.alias("below"), F.lit(2 * i + kind).alias("order"))))
    asked = rows.select("src", "target", "scaffold", "_self", "_n", F.explode_outer(F.array_compact(F.array(*asks))).alias("a"))
    asked = asked.select("src", "target", "scaffold", "_self", "_n", "a.*")
    found = asked.join(places(notes), ["i", "name", "below"], "left")
    best = F.min(F.when(F.col("path").isNotNull(), F.struct("order", "path")))["path"]
    found = found.groupBy("src", "target", "scaffold", "_self", "_n").agg(best.alias("dst"))
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))  # equal links were looked up once
    return found.select("src", "target", "scaffold", F.when(F.col("_self"), F.col("src")).otherwise(F.col("dst")).alias("dst"))


def edges(resolved: DataFrame) -> DataFrame:
    """src, dst, scaffold: one row a pair; a scaffold edge is one that no prose link makes."""
    return resolved.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.bool_and(F.col("scaffold")).alias("scaffold"))


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where("dst IS NULL").select("src", bare(F.col("target")).alias("target")).distinct()


def backlink_counts(notes: DataFrame, graph: DataFrame) -> DataFrame:
    """path, links, backlinks: links counts unresolved ones only where they are added."""
    out = graph.groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("links"))
    into = graph.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("backlinks"))
    rows = notes.select("path").join(out, "path", "left").join(into, "path", "left")
    return rows.select("path", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("backlinks", F.lit(0)).alias("backlinks"))


def orphans(notes: DataFrame, graph: DataFrame) -> DataFrame:
    """Notes that nothing links to; a note's link to itself counts."""
    return notes.select("path").join(graph, notes["path"] == graph["dst"], "left_anti")


def neighbourhood(graph: DataFrame, around: DataFrame) -> DataFrame:
    """Edges that begin or end at one of the notes around."""
    ends = around.select(F.col("path").alias("_p")).distinct()
    return graph.join(ends, F.col("src") == F.col("_p"), "left_semi").union(graph.join(ends, F.col("dst") == F.col("_p"), "left_semi")).distinct()


def lint(texts: DataFrame, notes: DataFrame) -> DataFrame:
    """path, line, target of wikilinks whose target is no note's stem or path, without regard to case."""
    rows = texts.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line_text"))
    rows = rows.select("path", (F.col("n") + 1).cast("long").alias("line"), F.explode(F.regexp_extract_all("line_text", F.lit(r"\[\[([^\[\]|#^]+)"), F.lit(1))).alias("target"))
    known = notes.select(F.lower(bare(F.col("path"))).alias("_known")).union(notes.select(F.lower(bare(F.regexp_extract("path", r"([^/]*)$", 1)))))
    rows = rows.withColumn("target", F.trim("target"))
    return rows.join(known.distinct(), F.lower(bare(F.col("target"))) == F.col("_known"), "left_anti")


def alias_index(notes: DataFrame) -> DataFrame:
    """alias (lower case), path: other names that notes (path, text) give themselves in their frontmatter."""
    marked = notes.where(F.startswith("text", F.lit("---")))
    found = generate(marked.select("path", "text"), ["path"], ["text"], lambda t: [(a.lower(),) for a in markdown.aliases(t)], [("alias", "string")])
    return found.select("alias", "path").distinct()


def properties(notes: DataFrame) -> DataFrame:
    """path, name, value (as JSON) of the frontmatter of notes (path, text)."""

    def one(text: str | None) -> list[tuple[str, str]]:
        return [(str(k), json.dumps(v, ensure_ascii=False, default=str)) for k, v in (markdown.frontmatter(text)[0] or {}).items()]

    marked = notes.where(F.startswith("text", F.lit("---")))
    return generate(marked.select("path", "text"), ["path"], ["text"], one, [("name", "string"), ("value", "string")])


def path_mentions(notes: DataFrame) -> DataFrame:
    """path, mention: paths that notes (path, text) name between backticks, outside fences: a folder and a file, or a file with an ending."""
    prose = F.regexp_replace(T.text_of("text"), T.FENCED, " ")
    spans = F.regexp_extract_all(prose, F.lit(r"`([^`\n]+)`"), F.lit(1))
    paths = F.filter(spans, lambda x: x.rlike(r"^[\w.-]+(/[\w.-]+)+/?$|^[\w-]+(\.[\w-]+)*\.[A-Za-z]{1,5}$"))
    return notes.select("path", F.explode(F.array_distinct(paths)).alias("mention"))


def search_names(notes: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, path: notes whose name (a path's last part without .md) holds a stated query (qid, q), without regard to case."""
    named = notes.select("path", F.lower(F.regexp_extract(bare(F.col("path")), r"([^/]*)$", 1)).alias("_name"))
    stated = queries.select("qid", F.lower("q").alias("_q"))
    return grams.holding(named, ["path"], "_name", stated, "qid", "_q").select("qid", "path")


def search_names_once(notes: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, same_as, path: search_names() for many queries that ask the same, which aren't written out for each of them.

    Every query has a row that names the first one that asks the same, with no path; the first one also has a row for each
    note. So the rows are as many as the queries and what the distinct ones find.
    """
    stated = queries.select("qid", F.lower("q").alias("q"))
    first = stated.groupBy("q").agg(F.min("qid").alias("same_as"))
    found = search_names(notes, first.select(F.col("same_as").alias("qid"), "q"))
    members = stated.join(first, "q").select("qid", "same_as", F.lit(None).cast("string").alias("path"))
    return members.unionByName(found.select("qid", F.col("qid").alias("same_as"), "path"))


def context_search(lines: DataFrame, queries: DataFrame, per_note: int = 20) -> DataFrame:
    """qid, path, line, snippet, note_matches: lines (path, line, text) that hold a stated query (qid, q), the first per_note of a note.

    A line found by many queries is sorted for each of them; where lines have a shorter snippet than their text, that is what goes along.
    """
    shown = F.col("snippet") if "snippet" in lines.columns else F.col("text").alias("snippet")
    low = lines.select("path", "line", shown, F.lower("text").alias("_low"))
    stated = queries.select("qid", F.lower("q").alias("_q"))
    hits = grams.holding(low, ["path", "line"], "_low", stated, "qid", "_q")
    count = ((F.length("_low") - F.length(F.replace(F.col("_low"), F.col("_q"), F.lit("")))) / F.length("_q")).cast("long")
    each, first = Window.partitionBy("qid", "path"), Window.partitionBy("qid", "path").orderBy("line")
    hits = hits.withColumn("_c", count).withColumns({"note_matches": F.sum("_c").over(each), "_nth": F.row_number().over(first)})
    return hits.where(F.col("_nth") <= per_note).select("qid", "path", "line", "snippet", "note_matches")
