"""Keywords against the entities of a profile: ordered containment joins.

An entity is contained in a keyword if its words stand there in a row. Both sides are cut into words, the keyword's runs of
words are joined to the entities by equality (no pairwise pattern tests), and the first entity in order wins by an aggregate.
Entities that normalise to nothing match nothing; null keywords match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.runtime import bounded_rows

MAX_COMPANIES = 100  # names of one profile's company
FEW_ENTITIES = 2_000  # entities that are broadcast to the keywords


def word_text(c: Column) -> Column:
    """Words of letters and digits, lower case, one blank between."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def word_runs(keywords: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    """(row_id, run): the distinct runs of each keyword that have one of these numbers of words."""
    words = F.split(word_text(F.col(column)), " ")
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.size("_w"))
    runs = F.flatten(
        F.transform(fitting, lambda n: F.transform(
            F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " ")))
    )
    return keywords.select("row_id", words.alias("_w")).select("row_id", F.explode(F.array_distinct(runs)).alias("run")).filter("run <> ''")


def _hits(keywords: DataFrame, entities: DataFrame, column: str) -> DataFrame:
    """row_id and all columns of every entity contained in each keyword, once or more.

    The runs have just the numbers of words that occur among the entities. They are many more than the table's size tells the planner, so
    how they are joined isn't left to it: few entities are broadcast, else both sides are sorted; the runs are never broadcast.
    """
    patterns = entities.withColumn("run", word_text(F.col("entity"))).filter("run <> ''")
    sizes = patterns.groupBy(F.size(F.split("run", " ")).alias("words")).agg(F.count(F.lit(1)).alias("n")).collect()
    few = sum(r.n for r in sizes) <= FEW_ENTITIES
    patterns = F.broadcast(patterns) if few else patterns.hint("merge")
    return word_runs(keywords, column, sorted(r.words for r in sizes)).join(patterns, "run").select("row_id", *entities.columns)


def contained(keywords: DataFrame, entities: DataFrame, column: str = "keyword") -> DataFrame:
    """(row_id, kind, ord, entity): every entity contained in each keyword; entities are (kind, ord, entity)."""
    return _hits(keywords, entities.select("kind", "ord", "entity"), column).distinct()


def first_match(found: DataFrame) -> DataFrame:
    """(row_id, kind, entity): the first in order of each kind."""
    return found.groupBy("row_id", "kind").agg(F.min_by("entity", F.struct("ord", "entity")).alias("entity"))


def all_matches(found: DataFrame) -> DataFrame:
    """(row_id, kind, entities, n): all in order; bounded by the words of a keyword."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "entity")))
    return found.groupBy("row_id", "kind").agg(F.array_join(F.transform(listed, lambda x: x["entity"]), "|").alias("entities"), F.count(F.lit(1)).alias("n"))


def profile_context(found: DataFrame) -> DataFrame:
    """One row a keyword that matches: first brand, category and so on, the number of brands, and the reason."""
    wide = first_match(found).groupBy("row_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("entity"))).alias(k) for k in ("brand", "category")])
    brands = all_matches(found.filter("kind = 'brand'")).select("row_id", F.col("n").alias("n_brands"))
    parts = F.concat_ws(" and ", *[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k} '"), F.col(k), F.lit("'"))) for k in ("brand", "category")])
    return wide.join(brands, "row_id", "left").select(
        "row_id", "brand", "category", F.coalesce("n_brands", F.lit(0)).alias("n_brands"),
        F.when(F.col("n_brands") > 1, "Comparison query").otherwise(F.concat(F.lit("Matched "), parts)).alias("reason"),
    )


#: The kinds of entities in the order of the resolvers, and the confidence of a match.
KINDS = ("family", "product", "brand", "category", "technology", "synonym")
SCORES = {"brand": 0.98, "family": 1.0, "product": 1.0, "technology": 1.0, "synonym": 1.0}
CATEGORY_SCORE, STRONG_CATEGORY_SCORE, STRONG_EVIDENCE = 0.85, 0.92, 1.0


def resolve(keywords: DataFrame, entities: DataFrame, column: str = "keyword") -> DataFrame:
    """(row_id, kind, entity, parent, score): for each keyword and kind the first entity in order, with its confidence.

    Entities are (kind, ord, entity, parent, evidence); parent is what a synonym stands for or the category a family or product belongs
    to, 'Unknown' where a family or product has none. A category of more evidence than ``STRONG_EVIDENCE`` has the higher score.
    """
    found = _hits(keywords, entities.select("kind", "ord", "entity", "parent", "evidence"), column)
    best = found.groupBy("row_id", "kind").agg(F.min(F.struct("ord", "entity", "parent", "evidence")).alias("_f"))
    score = F.lit(None).cast("double")
    for k, v in SCORES.items():
        score = F.when(F.col("kind") == k, v).otherwise(score)
    strong = F.coalesce(F.col("_f.evidence") > STRONG_EVIDENCE, F.lit(False))
    score = F.when(F.col("kind") == "category", F.when(strong, STRONG_CATEGORY_SCORE).otherwise(CATEGORY_SCORE)).otherwise(score)
    parent = F.when(F.col("kind").isin("family", "product"), F.coalesce("_f.parent", F.lit("Unknown"))).otherwise(F.col("_f.parent"))
    return best.select("row_id", "kind", "_f.entity", parent.alias("parent"), score.alias("score"))


def rule_context(keywords: DataFrame, entities: DataFrame, company: str = "", column: str = "keyword") -> DataFrame:
    """One row a keyword: brand, category, family, product, technology, synonym, n_brands, confidence, needs_review, reason.

    A family's or product's category stands unless a category of its own is contained; the company stands for the brand of families and
    products, and is the brand of a keyword that names it. More than one brand is a comparison, and like a keyword without a match it needs a review.
    """
    found = resolve(keywords, entities, column)
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = found.groupBy("row_id").agg(
        *[of(k, "entity").alias(k) for k in KINDS], of("product", "parent").alias("_pc"), of("family", "parent").alias("_fc"), F.max("score").alias("_score")
    )
    brands = contained(keywords, entities.filter("kind = 'brand'"), column).groupBy("row_id").agg(
        F.count_distinct("entity").alias("n_brands"), F.max(F.when(F.lower("entity") == company.lower(), F.col("entity"))).alias("_own")
    )
    parts = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k} '"), F.col(k), F.lit("'"))) for k in KINDS]
    # a row a keyword: sorted and merged, as what the planner takes for small is up to a row of every keyword
    both = keywords.select("row_id").join(wide.hint("merge"), "row_id", "left").join(brands.hint("merge"), "row_id", "left")
    n = F.coalesce("n_brands", F.lit(0))
    made_by = F.when(F.coalesce("product", "family").isNotNull() & F.lit(company != ""), F.lit(company))
    return both.select(
        "row_id",
        F.coalesce("_own", "brand", made_by).alias("brand"),
        F.coalesce("category", "_pc", "_fc").alias("category"),
        "family", "product", "technology", "synonym", n.alias("n_brands"),
        F.when((n > 1) | F.col("_score").isNull(), 0.0).otherwise(F.col("_score")).alias("confidence"),
        ((n > 1) | F.col("_score").isNull()).alias("needs_review"),
        F.when(F.col("_score").isNull(), "No match").when(n > 1, "Comparison query")
        .otherwise(F.concat(F.lit("Matched "), F.concat_ws(" and ", *parts))).alias("reason"),
    )


#: The levels of the cascade: kind, base confidence, growth with the evidence, most.
LEVELS = (
    ("company", 99, 0, 99), ("taxonomy", 90, 0, 90), ("brand", 70, 5, 95), ("product", 65, 5, 90), ("category", 60, 5, 85), ("family", 60, 5, 85),
    ("alias", 85, 0, 85), ("technology", 80, 0, 80), ("service", 75, 0, 75), ("segment", 70, 0, 70), ("keyword", 65, 0, 65),
)


def cascade(keywords: DataFrame, entities: DataFrame, column: str = "keyword") -> DataFrame:
    """(row_id, level, kind, entity, relevance, confidence): the first hit of the lowest level; without one a keyword is UNCERTAIN with 0.

    Entities are (kind, ord, entity, evidence). The company counts wherever its letters stand, all else by whole words. Ties go to the
    lower order, then the lesser entity. Companies are few names (one a profile) and compared as text.
    """
    levels = keywords.sparkSession.createDataFrame([(k, i, b, g, m) for i, (k, b, g, m) in enumerate(LEVELS, 1)], "kind string, level int, base int, growth int, most int")
    known = entities.join(F.broadcast(levels), "kind")
    hit = ("level", "kind", "ord", "entity", "confidence")
    known = known.withColumn("confidence", F.least(F.col("most").cast("double"), F.col("base") + F.col("growth") * F.coalesce("evidence", F.lit(0.0)))).select(*hit)
    found = _hits(keywords, known.filter("kind <> 'company'"), column)
    names = bounded_rows(known.filter("kind = 'company' and entity <> ''"), MAX_COMPANIES, "the company names")
    if names:
        kinds = {c: known.schema[c].dataType for c in hit}
        listed = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in hit]) for r in names])
        text = keywords.select("row_id", F.lower(column).alias("_t"))
        found = found.unionByName(text.select("row_id", F.inline(F.filter(listed, lambda c: F.col("_t").contains(F.lower(c["entity"]))))))
    best = found.groupBy("row_id").agg(F.min(F.struct("level", "ord", "entity", "kind", "confidence")).alias("_f"))
    best = best.hint("merge")  # up to a row of every keyword
    return keywords.select("row_id").join(best, "row_id", "left").select(
        "row_id", "_f.level", "_f.kind", "_f.entity",
        F.when(F.col("_f").isNull(), "UNCERTAIN").otherwise("RELEVANT").alias("relevance"), F.coalesce("_f.confidence", F.lit(0.0)).alias("confidence"),
    )


def match_counts(keywords: DataFrame, found: DataFrame, kinds: tuple[str, ...] = ("brand", "category")) -> DataFrame:
    """(kind, matches, misses): keywords with and without an entity of each kind; a kind without any hit has 0 matches."""
    listed = keywords.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    hit = found.groupBy("kind").agg(F.count_distinct("row_id").alias("matches"))
    n = F.coalesce("matches", F.lit(0))
    return listed.join(hit, "kind", "full").select("kind", n.alias("matches"), (F.lit(keywords.count()) - n).alias("misses"))
