"""The questions a user asks of an indexed tree, each as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators import fuse, graph, reports, text
from lattica.operators.joins import longest_prefix_join, overlap_innermost
from lattica.sources.files import language

IN_RELATIONS, OUT_RELATIONS = ("calls implements extends references".split(), "calls implements imports extends references".split())


class Index:
    """Nodes, edges, and what can be asked of them.

    ``nodes`` follow :data:`lattica.schema.NODES` as far as a question needs them; ``files(path, text)``
    serves line searches and code excerpts; ``scopes(prefix)`` splits ranking into sub-projects.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, scopes: DataFrame | None = None):
        self.nodes, self.edges, self.files, self.scopes = nodes, edges, files, scopes

    def under(self, prefix: str) -> Index:
        """The part below a path; an error if nothing is indexed there."""
        part = self.nodes.where(S.under_prefix(F.col("path"), prefix))
        if prefix and part.isEmpty():
            raise ValueError(f"nothing is indexed under {prefix!r}")
        return Index(part, self.edges, self.files, self.scopes)

    def _documents(self) -> DataFrame:
        body = F.col("body_text") if "body_text" in self.nodes.columns else F.lit("")
        return self.nodes.select("id", "name", "path", "kind", F.coalesce(body, F.lit("")).alias("body"))

    def ask(self, query: str, limit: int = 8, graph_rank: bool = True) -> DataFrame:
        """``(id, name, path, score)``: by structure where the query asks for callers or callees, else ranked."""
        found = self._structural(query, limit)
        return found if found is not None else self._lexical(query, limit, graph_rank)

    def _structural(self, query: str, limit: int) -> DataFrame | None:
        intent = reports.structural_intent(query)
        if intent is None:
            return None
        for word in reports.subject_words(query):
            subjects = graph.resolve_symbol(self.nodes, word)
            if subjects.isEmpty():
                continue
            near, far, relations = ("target", "source", IN_RELATIONS) if intent == "in" else ("source", "target", OUT_RELATIONS)
            hit = self.edges.where(F.col("relation").isin(*relations)).join(subjects.select(F.col("id").alias(near)), near, "left_semi")
            rows = hit.select(F.col(far).alias("id")).distinct().join(self.nodes, "id", "left").select("id", F.coalesce("name", "id").alias("name"), F.coalesce("path", "id").alias("path"), F.lit(1.0).alias("score"))
            return None if rows.isEmpty() else rows.orderBy("path", "id").limit(limit)
        return None

    def _lexical(self, query: str, limit: int, graph_rank: bool) -> DataFrame:
        docs = self._documents()
        lexical = text.lexical_rank(docs, query)
        ranked = lexical.select("id", "path", "score")
        if graph_rank:
            walk = graph.personalised_pagerank(self.edges, self.nodes, lexical.select("id", F.col("score").alias("weight")))
            ranked = text.blend(lexical, walk, docs, query)
        if self.scopes is not None:
            scoped = longest_prefix_join(ranked, "path", self.scopes).select("id", "scope", "score")
            ranked = fuse.combine_comparable(scoped).select("id", "score").join(docs.select("id", "path"), "id")
        out = ranked.select("id", "path", "score").join(docs.select("id", "name"), "id")
        return out.select("id", "name", "path", "score").orderBy(F.desc("score"), "name", "id").limit(limit)

    def coverage(self, query: str) -> DataFrame:
        """One row ``(coverage, strong)``: the best match by all fields, and by names of symbols alone."""
        docs = self._documents()
        every = text.coverage(docs, query, ("name", "path", "body")).agg(F.max("share").alias("coverage"))
        named = text.coverage(docs, query, ("name",)).join(docs.where("kind <> 'file'").select("id"), "id").agg(F.max("share").alias("strong"))
        return every.crossJoin(named).select(F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("strong", F.lit(0.0)).alias("strong"))

    def skeleton(self, file: str) -> DataFrame:
        """Definitions of one file in order; by path, else by a base name that only one file has."""
        named = self.nodes.where((F.col("path") == file) | (S.base_name(F.col("path")) == file)).select("path").distinct()
        paths = [r.path for r in named.orderBy((F.col("path") != file), "path").limit(9).collect()]
        if file not in paths and len(paths) > 1:
            raise ValueError(f"{file!r} is in several files: {', '.join(paths)}")
        one = file if file in paths else paths[0] if paths else file
        return self.nodes.where((F.col("path") == one) & (F.col("kind") != "file")).select("id", "name", "kind", "start_line", "end_line", "signature").orderBy("start_line", "name")

    def callers(self, symbol: str, direction: str = "in", depth: str | int | None = 1, prefix: str = "") -> DataFrame:
        """``(id, depth, relation, name, path)``; one row an edge at depth 1, each node once beyond."""
        if direction not in ("in", "out"):
            raise ValueError("direction is 'in' or 'out'")
        seeds = graph.resolve_symbol(self.nodes, symbol, prefix)
        steps = reports.depth_of(depth, 1)
        if steps == 1:
            found = graph.neighbours(self.edges, self.nodes, seeds, direction).select("id", F.lit(1).alias("depth"), "relation")
        else:
            inside = self.nodes.join(seeds.where("kind = 'file'").select("path").distinct(), "path", "left_semi").select("id")
            found = graph.reach(self.edges, seeds.select("id").union(inside).distinct(), direction, steps)
        return found.join(self.nodes.select("id", "name", "path"), "id", "left")

    def grep(self, pattern: str, literal: bool = False, ignore_case: bool = False) -> DataFrame:
        """``(path, symbol, in_degree, hits, dropped)``: matching lines by innermost symbol, the most used first; 300 lines at most, and ``dropped`` counts the rest."""
        lines = self.files.select("path", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")
        spans = self.nodes.where("kind <> 'file'").select("path", "id", "start_line", "end_line", F.col("start_line").alias("ord"))
        every = reports.grep(lines, spans, pattern, literal, ignore_case)
        dropped = F.lit(max(0, every.count() - reports.MOST_HITS))
        hits = every.orderBy("path", "line").limit(reports.MOST_HITS)
        groups = hits.groupBy("path", "symbol").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("hits"))
        degree = graph.in_degree(self.edges).withColumnRenamed("id", "symbol")
        return groups.join(degree, "symbol", "left").select("path", "symbol", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), "hits", dropped.alias("dropped")).orderBy(F.desc("in_degree"), "path", "symbol")

    def repo_map(self, dirs: int = 16, hubs: int = 3) -> DataFrame:
        """``(dir, files, symbols, languages, hubs, dropped)``; a directory of over 60 % of the files is split once."""
        first = S.dir_key(F.col("path"), 1)
        n = self.nodes.withColumn("one", first)
        size = n.where("kind = 'file'").groupBy("one").agg(F.count("*").alias("n"))
        big = size.crossJoin(size.agg(F.sum("n").alias("all"))).where("n > 0.6 * all").select(F.col("one").alias("big"))
        keyed = n.join(F.broadcast(big), n["one"] == big["big"], "left").withColumn("dir", F.when(F.col("big").isNotNull(), S.dir_key(F.col("path"), 2)).otherwise(F.col("one")))
        counts = keyed.groupBy("dir").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") != "file").alias("symbols"), F.array_sort(F.collect_set(F.when(F.col("kind") == "file", language(F.col("path"), 2)))).alias("languages"))
        ranked = keyed.where("kind <> 'file'").join(graph.in_degree(self.edges), "id")
        order = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("in_degree"), "name", "path"))
        top = ranked.withColumn("rank", order).where(F.col("rank") <= hubs).groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "path", "in_degree"))).alias("hubs"))
        total = counts.agg(F.greatest(F.count("*") - dirs, F.lit(0)).alias("dropped"))
        return counts.orderBy(F.desc("symbols"), "dir").limit(dirs).join(top, "dir", "left").crossJoin(total).orderBy(F.desc("symbols"), "dir")

    def blast(self, ranges: DataFrame, depth: str | int | None = 2) -> DataFrame:
        """``(id, depth, origins)`` reached from changed ``ranges(path, start, end)``, all files walked together."""
        symbols = self.nodes.where("kind <> 'file'").select("path", "id", "start_line", "end_line")
        seeds = overlap_innermost(ranges, symbols)
        bare = ranges.select("path").distinct().join(seeds.select("path").distinct(), "path", "left_anti")
        seeds = seeds.unionByName(self.nodes.where("kind = 'file'").join(bare, "path", "left_semi").select("path", "id"))
        steps = reports.depth_of(depth, 2)
        # One walk, keyed by the file that it began in; a symbol's depth is the least over all of them.
        walk = graph.stored(graph.walk_edges(self.edges).select(F.col("target").alias("at"), F.col("source").alias("id")).distinct())
        marks = graph.checkpointed(seeds.select(F.col("path").alias("origin"), "id").distinct())
        pairs, frontier, level = marks.withColumn("depth", F.lit(0)), marks, 0
        while steps is None or level < steps:
            level += 1
            new = graph.checkpointed(frontier.withColumnRenamed("id", "at").join(walk, "at").select("origin", "id").distinct().join(pairs, ["origin", "id"], "left_anti"))
            if new.isEmpty():
                break
            pairs, frontier = pairs.unionByName(new.withColumn("depth", F.lit(level))), new
        found = pairs.groupBy("id").agg(F.min("depth").alias("depth"), F.array_sort(F.collect_set("origin")).alias("origins"))
        return found.where("depth > 0").select("id", "depth", "origins")

    def check(self, recorded: DataFrame) -> DataFrame:
        """``(id, drift)`` against nodes recorded earlier, by body."""
        from lattica.operators.joins import full_outer_diff

        return full_outer_diff(recorded.select("id", "body_hash"), self.nodes.select("id", "body_hash"), "id", "body_hash").where("drift <> 'same'")


def federated(children: dict[str, Index], question: Callable[[Index], DataFrame]) -> DataFrame:
    """The same question of each repository, labelled; a repository that can't answer is left out."""
    out = None
    for repo, index in children.items():
        try:
            rows = question(index).withColumn("repo", F.lit(repo))
        except ValueError:
            continue
        rows = rows.withColumn("path", F.concat_ws("/", "repo", "path")) if "path" in rows.columns else rows
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no repository can answer")
    return out


def federated_ask(children: dict[str, Index], query: str, limit: int = 8, only: set[str] | None = None) -> DataFrame:
    """Ranked lists of repositories with a real match, fused by reciprocal rank."""
    asked = {r: i for r, i in children.items() if only is None or r in only}
    if only is None:
        stats = federated(asked, lambda i: i.coverage(query))
        passed = {r.repo for r in fuse.federation_gate(stats).select("repo").collect()}  # a row a repository
        asked = {r: i for r, i in asked.items() if r in passed}
    if not asked:
        asked = dict(list(children.items())[:1])
    hits = federated(asked, lambda i: i.ask(query, max(4 * limit, 20)))
    keyed = hits.withColumn("key", F.concat_ws("/", "repo", "id"))
    ranked = fuse.reciprocal_rank_fusion(keyed.select(F.col("key").alias("id"), F.col("repo").alias("scope"), "score"))
    return ranked.select(F.col("id").alias("key"), F.col("score").alias("fused")).join(keyed, "key").select("repo", "id", "name", "path", F.col("fused").alias("score")).orderBy(F.desc("score"), "repo", "id").limit(limit)


