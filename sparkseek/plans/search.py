"""Hybrid search of a batch of queries as one plan, and the evaluation harness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import image_name, letters_of, match_strength, ordered_pairs, partial_credibility
from ..functions.text import adjacent_pairs, content_terms, indexable_summary, indexable_tasks, normalize_name
from ..operators import fusion, lexical, vector
from ..operators.postings import Stored, indexed
from ..schema import RankingOptions
from ..sources.scratch import scratch_table


#: Columns of entities that may be left out.
OPTIONAL = {
    "summary": "string", "tasks": "array<string>", "synonyms": "array<string>", "details": "string", "features": "string", "publisher": "string", "source": "string", "kind": "int",
    "launch_kind": "int", "launch_target": "string", "icon_source": "string", "embedding": "array<float>", "launch_count": "bigint", "last_launched_at": "timestamp",
}
FIELDS = ["name", "summary", "tasks", "synonyms", "details", "publisher", "features"]
#: Rows that are sent to every executor at most.
SMALL = 100_000
#: Keys alone that are sent to every executor at most.
KEYS = 500_000


def complete(entities: DataFrame) -> DataFrame:
    """Entities with all columns that the search reads."""
    return entities.select("key", "display_name", *(F.col(c) if c in entities.columns else F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items()))


def match_text(name: Column, summary: Column, tasks: Column | None = None, synonyms: Column | None = None) -> Column:
    """What says what a thing is for, lower-cased; the summary as it is."""
    lists = [F.array_join(x, " ") for x in (tasks, synonyms) if x is not None]
    return F.concat(F.lit(" "), F.lower(F.concat_ws(" ", name, F.coalesce(summary, F.lit("")), *lists)), F.lit(" "))


def name_matches(queries: DataFrame, names: DataFrame, o: RankingOptions) -> DataFrame:
    """(qid, name, strength, reason) of the names (name) that a query matches.

    Every kind of match has the query's characters in the name in their order (a beginning, initials
    and chunks of words too).  So the pairs of characters that stand in order in the query do so in the name:
    each query waits at its rarest pair, each name comes by at all of its pairs, and they meet by
    equality.  What meets is tested by two numbers (length, a bit a character) and then matched."""
    q = queries.select("qid", "query", normalize_name(F.col("query")).alias("q")).where("q <> ''").withColumn("qm", letters_of(F.col("q")))
    n = names.distinct().withColumn("n", normalize_name(F.col("name"))).where("n <> ''").withColumn("nm", letters_of(F.col("n")))
    longest = n.agg(F.max(F.length("n"))).first()[0] or 0
    q = q.where(F.length("q") <= longest)
    often = scratch_table(n.select(F.explode(ordered_pairs(F.col("n"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("names")), "pairs")
    waits = q.select("qid", "query", "q", "qm", F.explode(ordered_pairs(F.col("q"))).alias("pair")).join(_sent(often), "pair", "left")
    waits = waits.groupBy("qid", "query", "q", "qm").agg(F.min_by("pair", F.struct(F.coalesce("names", F.lit(0)), "pair")).alias("pair"))
    waits = scratch_table(waits, "waits")
    asked = _sent(waits)
    near = n.select("name", "n", "nm", F.explode(ordered_pairs(F.col("n"))).alias("pair")).join(asked, "pair").where("length(q) <= length(n) and (qm & ~nm) = 0")
    strength, reason = match_strength(F.col("query"), F.col("name"), o)
    return near.select("qid", "name", strength.alias("strength"), reason.alias("reason")).where("strength > 0")


def literal_arm(queries: DataFrame, entities: DataFrame, o: RankingOptions, df: DataFrame | None = None, total: int = 0) -> DataFrame:
    """(qid, key, strength, reason, literal): all matches of names, and of the names of the images
    that entities run, ranked plainly; the better of the two counts.  df (t, df) of ``total`` rows: a
    partial match of one common word is damped."""
    called = entities.select("key", "display_name", F.col("display_name").alias("name"), F.lit(0).alias("by"))
    if {"launch_kind", "launch_target"} <= set(entities.columns):
        image = F.when(F.coalesce(F.col("launch_kind") != 3, F.lit(True)), image_name(F.col("launch_target"), F.col("display_name")))
        called = called.union(entities.select("key", "display_name", image.alias("name"), F.lit(1).alias("by")).where("name is not null"))
    found = name_matches(queries, called.select("name"), o)
    hits = _sent(scratch_table(found, "found")).join(called, "name").groupBy("qid", "key", "display_name").agg(F.max(F.struct("strength", -F.col("by"), "reason")).alias("best")).select("qid", "key", "display_name", "best.strength", "best.reason")
    if df is not None:
        word = normalize_name(F.col("query"))
        often = queries.select("qid", "query", word.alias("t")).join(df, "t").select("qid", partial_credibility(F.col("query"), F.col("df"), F.lit(float(total)), o).alias("credible"))
        damped = F.when(F.col("reason").isin("word prefix", "subsequence"), F.col("strength") * F.coalesce("credible", F.lit(1.0))).otherwise(F.col("strength"))
        hits = hits.join(_sent(often), "qid", "left").withColumn("strength", damped).drop("credible").where("strength > 0")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("strength"), F.upper("display_name"), "key")) - 1
    power = F.least(F.col("strength") / o.exact_match_boost, F.lit(1.0))
    return hits.withColumn("place", place).select("qid", "key", "strength", "reason", (power * fusion.reciprocal(o.literal_arm_weight, F.col("place"), o.rrf_k)).alias("literal"))


def stretches() -> Column:
    """The stretches of words of all that an entity says, in which neighbours are looked for."""
    return fusion.joined_segments(F.concat_ws(". ", "display_name", "summary", "details", "features", F.array_join("tasks", ". "), F.array_join("synonyms", ". ")))


def _sent(table: DataFrame, most: int | None = None) -> DataFrame:
    """A table sent to every executor if it has at most ``SMALL`` rows, else joined by a shuffle, whatever the size of its
    files.  most: a known bound of their number."""
    return F.broadcast(table) if (table.count() if most is None else most) <= SMALL else table.hint("merge")


def hybrid_search(entities: DataFrame, queries: DataFrame, as_of: Column, options: RankingOptions | None = None, limit: int = 10, stem: bool = True, order_all: bool = False, root: str = "C:\\Windows", texts: Stored | None = None, said: DataFrame | None = None) -> DataFrame:
    """(qid, key, place, score, band, reason, ...) of the entities shown.

    entities: key, display_name and the columns of ``OPTIONAL`` (embedding of unit length or null).
    queries: qid, query, embedding.  root: where the system's own files lie.  texts: the stored
    postings of the entities' projection; said: a stored table of the entities' texts; without them the texts are
    indexed, and written, first.

    A query may match any share of the names, so candidates are many times the entities: they go without texts, which are
    read only where they can count."""
    o = options or RankingOptions()
    entities = complete(entities)
    said = complete(said) if said is not None else scratch_table(entities, "said", "zstd")
    name = F.col("display_name")
    tasks = F.size(F.coalesce(indexable_tasks(F.col("tasks"), name), F.array().cast("array<string>")))
    unsaid = indexable_summary(F.col("summary"), name).isNull() & (tasks == 0) & (F.coalesce(F.trim("details"), F.lit("")) == "")
    component = fusion.system_component(F.col("kind"), F.col("launch_kind"), F.col("launch_target"), F.col("icon_source"), root)
    short = entities.select("key", "display_name", "source", "launch_kind", "launch_target", "embedding", component.alias("component"), F.coalesce(fusion.usage_boost(F.col("launch_count"), F.col("last_launched_at"), as_of, o), F.lit(0.0)).alias("usage"))
    entities = scratch_table(short.join(said.select("key", unsaid.alias("name_only_semantics")), "key"), "entities")  # read several times below
    own = entities.where("embedding is not null").select("key", "embedding")
    asked = queries.where("embedding is not null").select("qid", "embedding")
    near = vector.scores(own, asked, "key", "embedding", floor=max(o.min_vector_score, 1e-9), k=o.candidates_per_arm)
    vec = fusion.tiered_ranks(near, "key", o.rank_tier_tolerance)
    vec = vec.select("qid", "key", F.lit(True).alias("vector_ranked"), (fusion.reciprocal(o.vector_arm_weight, F.col("tier"), o.rrf_k) + o.vector_magnitude_weight * F.col("score")).alias("vector"))
    texts = texts or indexed(lexical.projection(said, "key"), "key", FIELDS, stem)
    bm = texts.bm25(lexical.query_phrases(queries, stem), o.candidates_per_arm)
    lex = fusion.tiered_ranks(bm, "key", o.rank_tier_tolerance).select("qid", "key", F.col("score").alias("lexical"), "tier")
    # weights of the queries' terms alone: a map per query
    match = match_text(F.col("display_name"), F.col("summary"), F.col("tasks"), F.col("synonyms"))
    total, n_queries = entities.count(), queries.count()
    terms = queries.select("qid", "query", content_terms(F.col("query")).alias("terms_list"))
    wanted = terms.select(F.explode("terms_list").alias("t")).union(terms.select(normalize_name(F.col("query")))).distinct()
    df = scratch_table(lexical.document_frequency(said, match).withColumnRenamed("word", "t").join(_sent(wanted, 13 * n_queries), "t"), "df")
    weights = terms.select("qid", F.explode("terms_list").alias("t")).join(df, "t", "left").select("qid", "t", lexical.idf(F.coalesce("df", F.lit(0)), total).alias("w"))
    weights = weights.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("t", "w"))).alias("idf"))
    terms = terms.select("qid", "terms_list").join(weights, "qid", "left").withColumn("idf", F.coalesce("idf", F.create_map().cast("map<string,double>")))
    terms = scratch_table(terms, "query-terms")
    # each arm has a row for a query and a key: together they are one
    names = literal_arm(queries, entities, o, df, total)
    arms = vec.unionByName(lex, allowMissingColumns=True).unionByName(names, allowMissingColumns=True)
    found_by = scratch_table(arms.groupBy("qid", "key").agg(*(F.max(c).alias(c) for c in arms.columns if c not in ("qid", "key"))), "arms")
    rows = _sent(found_by).join(entities.drop("launch_kind", "launch_target"), "key").join(_sent(terms.select("qid", F.size("terms_list").alias("terms")), n_queries), "qid")
    # every candidate's cosine counts as evidence, whether the arm ranked it or not
    cosine = F.round(vector.dot(F.col("embedding"), F.col("asked")), 6)
    rows = rows.join(_sent(asked.withColumnRenamed("embedding", "asked"), n_queries), "qid", "left").withColumn("cosine", cosine).drop("embedding", "asked").withColumn("vector_ranked", F.coalesce("vector_ranked", F.lit(False)))
    rows = scratch_table(rows, "candidates")
    leads = scratch_table(rows.groupBy("qid").agg(F.max("lexical").alias("lead_lex"), F.coalesce(F.max("cosine"), F.lit(0.0)).alias("lead_cos")), "leads")
    found = F.col("lexical").isNotNull()
    agreed = F.when(F.col("lead_cos") > 0, F.least(F.greatest(F.coalesce("cosine", F.lit(0.0)) / F.col("lead_cos"), F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    rows = rows.join(_sent(leads, n_queries), "qid").withColumn("agreed", agreed)
    told = scratch_table(evidence(rows.where((F.col("terms") >= 2) & (found | (F.col("agreed") > 0))).select("qid", "key", found.alias("found"), "agreed"), said, terms, n_queries), "evidence")
    n_told = told.count()
    adj = fusion.tiered_ranks(told.where("adjacent > 0").select("qid", "key", F.col("adjacent").alias("score")), "key", o.rank_tier_tolerance).select("qid", "key", F.col("tier").alias("adj_tier"))
    told = told.join(_sent(adj, n_told), ["qid", "key"], "left")
    rows = rows.drop("agreed").join(_sent(told, n_told), ["qid", "key"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(1.0))).withColumn("name_only_lexis", F.coalesce("name_only_lexis", F.lit(False)))
    rows = rows.withColumn("lex_part", F.when(F.col("lexical") >= o.min_lexical_contribution_ratio * F.col("lead_lex"), F.col("coverage") * fusion.reciprocal(o.lexical_arm_weight, F.col("tier"), o.rrf_k)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = zero("vector") + zero("lex_part") + zero("literal") + zero(F.when(F.col("adj_tier").isNotNull(), F.col("adjacent") * fusion.reciprocal(o.adjacency_arm_weight, F.col("adj_tier"), o.rrf_k)))
    rows = rows.withColumn("score", fusion.penalised(score, F.col("source"), F.col("usage"), o)).drop("lead_lex", "lead_cos", "adjacent", "adj_tier", "tier", "source", "usage")
    rows = scratch_table(rows, "scored")
    arm = rows.withColumnRenamed("literal", "literal_part").withColumn("literal", F.col("strength"))
    shown = fusion.leaders(arm).withColumn("shown", fusion.surfaces(o))
    shown = shown if order_all else shown.where("shown")
    shown = shown.withColumn("why", fusion.explain(F.col("reason"), F.col("literal_part"), F.col("vector"), F.col("lex_part"), F.col("cosine"), F.col("lexical")))
    out = fusion.final_order(shown, F.col("display_name"), limit, o=o)
    return out.select("qid", "key", "place", "score", "band", "cosine", "lexical", "coverage", "strength", "component", "why")


def evidence(asks: DataFrame, said: DataFrame, terms: DataFrame, n_queries: int) -> DataFrame:
    """(qid, key, coverage, name_only_lexis, adjacent) of what the texts of asks (qid, key, found, agreed) say otherwise
    than nothing: covered as a whole, not by name alone, no neighbours.

    The queries of an entity meet its texts in one row, where its stretches of words are cut once; no text is shuffled but to
    meet them, and none if the entities asked for are few."""
    few = n_queries <= SMALL
    with_terms = lambda rows: rows.join(_sent(terms, n_queries), "qid")
    asks = scratch_table(asks, "asks")
    by_key = scratch_table(asks.select("key").distinct(), "asked-keys")
    each = asks if few else with_terms(asks)
    lists = each.groupBy("key").agg(F.collect_list(F.struct(*each.drop("key").columns)).alias("asks"))
    wide = said.select("key", "display_name", "summary", "tasks", "synonyms", "details", "features")
    n_asks = asks.count()
    wide = wide.join(F.broadcast(by_key), "key", "left_semi") if n_asks > SMALL and by_key.count() <= KEYS else wide
    match = match_text(F.col("display_name"), F.col("summary"), F.col("tasks"), F.col("synonyms"))
    rows = wide.join(_sent(lists, n_asks), "key").withColumn("match", match).withColumn("lines", stretches()).drop("features")
    rows = rows.select("*", F.inline("asks")).drop("asks")
    rows = with_terms(rows) if few else rows
    pairs, one = adjacent_pairs(F.col("terms_list")), F.array().cast("array<string>")
    rows = rows.withColumn("stated", fusion.stated_in(pairs, F.col("lines")))
    covered = fusion.coverage(F.col("terms_list"), F.col("match"), F.col("idf"), F.coalesce(fusion.phrased_terms(F.col("stated")), one))
    alone = fusion.name_only_lexis(F.col("terms_list"), F.col("display_name"), F.col("summary"), F.col("tasks"), F.col("synonyms"), F.col("details"))
    beside = fusion.adjacency_strength(pairs, F.col("stated"), F.col("idf")) * F.col("agreed")
    rows = rows.select("qid", "key", F.when(F.col("found"), covered).otherwise(1.0).alias("coverage"), F.when(F.col("found"), alone).otherwise(False).alias("name_only_lexis"), beside.alias("adjacent"))
    return rows.where("coverage <> 1 or name_only_lexis or adjacent > 0")


def with_text(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """Hits with what is shown of them: tasks that say more than the name, details that are no
    boilerplate of the index."""
    entities = complete(entities)
    told = fusion.shared_details(entities, "details", "key")
    shown = entities.select("key", "display_name", "summary", indexable_tasks(F.col("tasks"), F.col("display_name")).alias("tasks"))
    return hits.join(shown, "key").join(told, "key")


def evaluate(hits: DataFrame, cases: DataFrame, by: str = "qid") -> DataFrame:
    """Outcome of each case: hits (qid, name, place); cases (qid, acceptable, forbidden, required,
    expect_no_results, max_results, within_top_n).  by: the column of both that says whose hits a case
    has, if several cases share theirs.

    Of a name its first place decides, so hits are aggregated by name before cases meet them."""
    word = lambda c: F.array_distinct(F.filter(F.split(normalize_name(c), " "), lambda w: w != ""))
    within = lambda a, b: (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    first = hits.groupBy(by, "name").agg(F.min("place").alias("place"), F.count("*").alias("n")).select(by, "n", F.struct("place", word(F.col("name")).alias("words"), normalize_name(F.col("name")).alias("plain")).alias("hit"))
    listed = first.groupBy(by).agg(F.sum("n").cast("int").alias("n_hits"), F.collect_list("hit").alias("hits"))
    kind = dict(listed.dtypes)["hits"]
    words = [F.transform(c, word).alias(f"{c}_words") for c in ("acceptable", "required")]
    rows = cases.select("*", *words, F.transform("forbidden", normalize_name).alias("banned")).join(listed, by, "left").withColumn("hits", F.coalesce("hits", F.array().cast(kind)))
    good = F.filter("hits", lambda h: F.exists("acceptable_words", lambda a: within(a, h["words"])))
    rank = F.array_min(F.transform(good, lambda h: h["place"]))
    missing = F.exists("required_words", lambda r: ~F.exists("hits", lambda h: (h["place"] <= 8) & within(r, h["words"])))
    banned = F.exists("hits", lambda h: F.array_contains("banned", h["plain"]))
    n = F.coalesce("n_hits", F.lit(0))
    rows = rows.withColumn("rank", rank)
    ok = F.when(F.col("expect_no_results"), n == 0).otherwise((F.size("acceptable") == 0) | F.coalesce(F.col("rank") <= F.col("within_top_n"), F.lit(False)))
    ok = ok & ~F.coalesce(missing, F.lit(False)) & ~F.coalesce(banned, F.lit(False)) & F.coalesce(n <= F.col("max_results"), F.lit(True))
    return rows.select("qid", ok.alias("passed"), F.col("rank").alias("matched_rank"), (F.size("acceptable") > 0).alias("ranked"), n.alias("n_hits"))


def report(outcomes: DataFrame) -> DataFrame:
    """One row: cases, pass rate, mean reciprocal rank and top-1 rate."""
    ranked = F.col("ranked")
    return outcomes.agg(
        F.count("*").alias("cases"), F.avg(F.col("passed").cast("int")).alias("pass_rate"),
        F.avg(F.when(ranked, F.coalesce(1 / F.col("matched_rank"), F.lit(0.0)))).alias("mrr"), F.avg(F.when(ranked, F.coalesce((F.col("matched_rank") == 1).cast("int"), F.lit(0)))).alias("top1"),
    )


def exit_code(pass_rate: float, gate: float = 0.7) -> int:
    return 0 if pass_rate >= gate else 2


def typing_stability(search, cases: DataFrame, most: int = 3) -> DataFrame:
    """(qid, dropped, passed): whether each case's query still recalls what it must with 1..most
    trailing characters dropped (two characters at least stay).  cases: as :func:`evaluate`
    takes them, with query and embedding.  search: queries -> hits (qid, name, place)."""
    cut = cases.select("*", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("dropped")).where(F.length("query") - F.col("dropped") >= 2)
    cut = cut.withColumn("case", F.struct("qid", "dropped")).withColumn("query", F.expr("substring(query, 1, length(query) - dropped)"))
    cut = scratch_table(cut.withColumn("qid", F.concat_ws("-", F.col("dropped").cast("string"), F.col("qid").cast("string"))), "cut")  # a number leads, so no two are equal
    only = cut.withColumn("forbidden", F.array().cast("array<string>")).withColumn("max_results", F.lit(None).cast("int"))
    done = evaluate(search(cut.select("qid", "query", "embedding")), only)
    return done.join(cut.select("qid", "case"), "qid").select("case.qid", "case.dropped", "passed")


def first_unstable(outcomes: DataFrame) -> DataFrame:
    """(qid, dropped): the fewest characters whose loss breaks a case."""
    return outcomes.where("not passed").groupBy("qid").agg(F.min("dropped").alias("dropped"))
