"""Queries of the core, by name: (spark, sf_dir) -> DataFrame. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import textnorm as tn
from lexiforge.functions.similarity import indel_ratio
from lexiforge.operators import analytics, badrows, dedup, drift, lookup, match, profile, schema
from lexiforge.runtime import table

COMPANY_WORDS = {"cindibrax studio": "cindibrax", "obrottan": "obro"}


# --- training-data problems of the core


def p5_found(s, d):
    return drift.schema_changes(table(s, d, "feed_files"), table(s, d, "feed_rows"))


def p5_unified(s, d):
    return drift.unified(table(s, d, "feed_rows"))


def p5_union(s, d):
    return drift.union_schema(table(s, d, "feed_rows"))


def p7_found(s, d):
    return badrows.rejected_rows(table(s, d, "raw_lines")).select("line_id", "reason")


def p7_clean(s, d):
    return badrows.clean_rows(table(s, d, "raw_lines"))


# --- normalisation


def _kw(s, d):
    return table(s, d, "demo_keywords")


def _rule(rule):
    def query(s, d):
        return _kw(s, d).select("row_id", rule(F.coalesce("keyword", F.lit(""))).alias("text"))

    return query


def _after(rule):
    """A rule on text that the first three rules made plain."""
    return _rule(lambda c: rule(tn.fold_unicode(tn.squeeze_blanks(tn.lower_case(c)))))


norm_case_whitespace = _rule(lambda c: tn.squeeze_blanks(tn.lower_case(c)))
norm_unicode_fold = _rule(tn.fold_unicode)
norm_punctuation = _rule(tn.open_punctuation)
norm_dictionary = _after(tn.replace_words(tn.DICTIONARY))
norm_company_dictionary = _after(tn.replace_words(COMPANY_WORDS))
norm_units = _after(tn.join_units)
norm_lemmas = _after(tn.lemmatise)
norm_numeric = _after(tn.strip_zeros)
norm_stop_words = _after(tn.drop_stop_words)
norm_token_sort = _after(tn.sort_tokens)


def norm_engine(s, d):
    return tn.normalise(_kw(s, d)).select("row_id", "normalized_keyword", "normalization_trace")


def norm_metrics(s, d):
    return tn.normalisation_metrics(tn.normalise(_kw(s, d)))


def string_functions(s, d):
    k = F.col("keyword")
    return _kw(s, d).select(
        "row_id", tn.cache_key(F.col("company_id").cast("string"), k, F.lit("mock"), F.lit("1.0.0")).alias("cache_key"),
        tn.truncated(k, 12).alias("short"), tn.is_semver(k).alias("semver"), tn.acronym(tn.squeeze_blanks(tn.fold_unicode(k))).alias("acronym"),
    )


def profile_keys(s, d):
    return table(s, d, "companies").select("company_id", tn.profile_key(F.col("company_name"), F.col("website")).alias("profile_key"), profile.domain_brand(F.col("website")).alias("domain_brand"))


# --- schema


def schema_projection(s, d):
    raw = _kw(s, d).select("row_id", F.col("keyword").alias(" Search Keyword "), F.col("search_volume").alias("SV"), F.col("country").alias("Location"), F.col("cpc").alias("Cost per Click"), F.lit(1).alias("noise"))
    return schema.project_canonical(raw)[0]


def column_resolution(s, d):
    """Every field name of the feeds against the names of the keyword column."""
    names = drift.cells(table(s, d, "feed_rows")).select(F.trim(F.lower("field")).alias("field")).distinct()
    aliases = F.array(*[F.lit(a) for a in schema.KEYWORD_ALIASES])
    scored = names.select("field", F.explode(aliases).alias("alias")).withColumn("score", indel_ratio("field", "alias"))
    best = scored.groupBy("field").agg(F.max("score").alias("score"))
    method = F.when(F.col("field") == "keyword", "EXACT").when(F.col("field").isin(*schema.KEYWORD_ALIASES), "ALIAS").when(F.col("score") >= 90, "FUZZY").otherwise("NONE")
    shown = F.when(method == "EXACT", 100.0).when(method == "ALIAS", 95.0).otherwise(F.round("score", 2))
    return best.select("field", method.alias("method"), shown.alias("score"))


def drop_empty_and_repeats(s, d):
    return schema.first_of_each(schema.drop_empty_keywords(schema.drop_blank_rows(_kw(s, d)))).select("row_id", "keyword")


# --- duplicates


def dedup_exact(s, d):
    return dedup.exact_edges(_kw(s, d))


def dedup_normalized(s, d):
    return dedup.normalised_edges(_kw(s, d))


def _part_keywords(s, d):
    p = table(s, d, "part")
    k = F.pmod("p_partkey", F.lit(10))
    kw = F.when(k == 1, F.concat(F.upper("p_name"), F.lit("  "))).when(k == 2, F.concat("p_name", F.lit("x"))).when(k == 3, F.concat("p_name", F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("row_id"), kw.alias("keyword"))


def dedup_fuzzy_edges(s, d):
    return dedup.fuzzy_edges(_part_keywords(s, d)).select("src", "dst", F.round("confidence", 4).alias("confidence"))


def dedup_groups(s, d):
    return dedup.groups(dedup.all_edges(_part_keywords(s, d))).select("canonical", "member")


def dedup_status(s, d):
    return dedup.detect(_part_keywords(s, d))[1].select("row_id", "keyword", "status")


def dedup_stats(s, d):
    edges, marked = dedup.detect(_part_keywords(s, d))
    return dedup.dedup_statistics(edges, marked)


# the same over the whole keyword table: no SQL twins, as SQL would score every pair of a first letter


def keyword_fuzzy_edges(s, d):
    return dedup.fuzzy_edges(_kw(s, d)).select("src", "dst", F.round("confidence", 4).alias("confidence"))


def keyword_groups(s, d):
    return dedup.groups(dedup.all_edges(_kw(s, d))).select("canonical", "member")


def keyword_status(s, d):
    return dedup.detect(_kw(s, d))[1].select("row_id", "keyword", "status")


def keyword_stats(s, d):
    edges, marked = dedup.detect(_kw(s, d))
    return dedup.dedup_statistics(edges, marked)


def keyword_components(s, d):
    """Components of keywords that share a light key, over the whole keyword table."""
    return dedup.components(dedup.normalised_edges(_kw(s, d)))


def blocking_prefix(s, d):
    return _kw(s, d).filter("keyword <> ''").groupBy(dedup.prefix_block().alias("block")).agg(F.count(F.lit(1)).alias("n"))


def blocking_length(s, d):
    return _kw(s, d).filter("keyword <> ''").groupBy(F.length("keyword").alias("block")).agg(F.count(F.lit(1)).alias("n"))


# --- pages and facts


def _pages(s, d):
    return table(s, d, "collected_content")


def extract_navigation(s, d):
    return profile.navigation(_pages(s, d)).groupBy("page_id", "entity").agg(F.count(F.lit(1)).alias("n"))


def extract_headings(s, d):
    return profile.headings(_pages(s, d)).select("page_id", "level", "ord", "entity", "parent")


def extract_url_segments(s, d):
    return profile.url_segments(_pages(s, d))


def extract_links(s, d):
    return profile.links(_pages(s, d))


def page_text(s, d):
    return profile.page_text(_pages(s, d)).select("page_id", "title", F.length("text").alias("n_chars"))


def url_filter(s, d):
    return _pages(s, d).filter(profile.crawlable(F.col("source_url"))).select("page_id")


def crawl_budget(s, d):
    return profile.crawl_budget(_pages(s, d))


def entity_evidence(s, d):
    return profile.evidence(profile.mentions(_pages(s, d)))


def taxonomy_edges(s, d):
    return profile.relations(profile.mentions(_pages(s, d)))


def _entities(s, d):
    """Alias bases as entity names, in order of their first id."""
    return table(s, d, "fact_aliases").filter("base is not null").groupBy(F.col("base").alias("entity")).agg(F.min("alias_id").alias("ord"))


def entity_split(s, d):
    return profile.split_entities(_entities(s, d)).select("entity")


def family_mining(s, d):
    return profile.families(_entities(s, d), "Snorandoq")


def alias_mining(s, d):
    return profile.aliases(_entities(s, d))


def synonym_mining(s, d):
    return profile.synonyms(_entities(s, d))


def brand_canonical(s, d):
    c = table(s, d, "companies")
    return c.select("company_id", profile.canonical_brand(F.col("company_name"), F.lit("")).alias("brand"))


def fact_warnings(s, d):
    return profile.fact_warnings(profile.evidence(profile.mentions(_pages(s, d))), table(s, d, "fact_aliases").filter("base is not null"))


def profile_quality(s, d):
    return profile.profile_quality(_pages(s, d), profile.evidence(profile.mentions(_pages(s, d))))


# --- matching


def _terms(s, d):
    return table(s, d, "canon_terms").select("kind", F.col("term_id").alias("ord"), F.col("term_name").alias("entity"))


def match_all(s, d):
    return match.all_matches(match.contained(_kw(s, d), _terms(s, d)))


def match_first(s, d):
    return match.first_match(match.contained(_kw(s, d), _terms(s, d)))


def match_profile(s, d):
    return match.profile_context(match.contained(_kw(s, d), _terms(s, d)))


def match_counts(s, d):
    k = _kw(s, d)
    return match.match_counts(k, match.contained(k, _terms(s, d)))


TECHNOLOGIES = ("144hz", "16gb", "usb c", "dual band", "bluetooth")


def _resolved(s, d):
    """Entities of all kinds: the list's brands, categories and short writings, families by the last word of a category, aliases as products."""
    terms = table(s, d, "canon_terms").select("term_id", "kind", "term_name", "short_forms")
    aliases = table(s, d, "fact_aliases")
    seen = aliases.join(F.broadcast(terms.select("term_name")), F.col("base") == F.col("term_name"), "left_semi").groupBy(F.col("base").alias("term_name")).agg(F.count(F.lit(1)).cast("double").alias("evidence"))
    none, zero = F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("evidence")
    named = terms.join(seen, "term_name", "left").select("kind", F.col("term_id").alias("ord"), F.col("term_name").alias("entity"), none, F.coalesce("evidence", F.lit(0.0)).alias("evidence"))
    short = terms.select(F.lit("synonym").alias("kind"), F.col("term_id").alias("ord"), F.explode("short_forms").alias("entity"), F.col("term_name").alias("parent"), zero)
    last = F.element_at(F.split("term_name", " "), -1)
    families = (
        terms.filter("kind = 'category'").groupBy(last.alias("entity")).agg(F.min("term_id").alias("ord"), F.min_by("term_name", "term_id").alias("parent"))
        .select(F.lit("family").alias("kind"), "ord", "entity", "parent", zero)
    )
    products = (
        aliases.filter("length(alias) > 3 and base is not null").groupBy(F.col("alias").alias("entity")).agg(F.min("alias_id").alias("ord"), F.min_by("base", "alias_id").alias("parent"))
        .select(F.lit("product").alias("kind"), "ord", "entity", "parent", zero)
    )
    tech = s.createDataFrame([("technology", i, t, None, 0.0) for i, t in enumerate(TECHNOLOGIES, 1)], "kind string, ord long, entity string, parent string, evidence double")
    return named.unionByName(short).unionByName(families).unionByName(products).unionByName(tech)


def resolver_scores(s, d):
    return match.resolve(_kw(s, d), _resolved(s, d))


def rule_engine(s, d):
    return match.rule_context(_kw(s, d), _resolved(s, d), "Snorandoq")


def match_cascade(s, d):
    kinds = _resolved(s, d).select(F.when(F.col("kind") == "synonym", "alias").otherwise(F.col("kind")).alias("kind"), "ord", "entity", "evidence")
    companies = table(s, d, "companies")
    own = companies.filter("company_id = 17").select(F.lit("company").alias("kind"), F.col("company_id").alias("ord"), F.split("company_name", " ")[0].alias("entity"), F.lit(0.0).alias("evidence"))
    segments = companies.select("company_id", F.explode("customer_segments").alias("entity")).groupBy("entity").agg(F.min("company_id").alias("ord"))
    segments = segments.select(F.lit("segment").alias("kind"), "ord", "entity", F.lit(0.0).alias("evidence"))
    return match.cascade(_kw(s, d), kinds.unionByName(own.filter("entity is not null")).unionByName(segments))


# --- look-ups


def lookup_volume(s, d):
    return lookup.mock_volume(_kw(s, d))


def lookup_classes(s, d):
    return lookup.mock_classes(_kw(s, d))


def lookup_cache_split(s, d):
    cache = table(s, d, "keyword_context").select("keyword").distinct()
    return lookup.cache_split(_kw(s, d), cache)[1]


def lookup_batches(s, d):
    return lookup.batches(_kw(s, d), 2000, 1000).groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"))


def lookup_merge(s, d):
    results = table(s, d, "keyword_context").select("keyword", F.col("context_id").alias("ord"), F.col("search_intent").alias("intent"))
    return lookup.merge_results(_kw(s, d).select("row_id", "keyword", "intent"), results.filter("intent is not null"), ["intent"]).select("row_id", "intent")


def lookup_stats(s, d):
    return lookup.lookup_statistics(_kw(s, d), table(s, d, "keyword_context"))


def answers_parsed(s, d):
    """The JSON payloads of the feeds as answers: one object an answer."""
    answers = table(s, d, "feed_rows").select(F.struct("file_id", "line_no").alias("answer_id"), F.concat(F.lit("["), "payload", F.lit("]")).alias("answer"))
    return lookup.parse_answers(answers).groupBy("answer_id").agg(F.count(F.lit(1)).alias("n")).select("answer_id.*", "n")


def answers_repaired(s, d):
    """The same payloads as a talkative provider sends them, so that each answer must be repaired."""
    talk = F.concat(F.lit("Here you are: "), F.col("payload"), F.lit(" and {no json} besides"))
    answers = table(s, d, "feed_rows").select(F.struct("file_id", "line_no").alias("answer_id"), talk.alias("answer"))
    return lookup.parse_answers(answers).groupBy("answer_id").agg(F.count(F.lit(1)).alias("n")).select("answer_id.*", "n")


# --- analytics


def dataset_stats(s, d):
    return analytics.dataset_stats(_kw(s, d))


def intent_distribution(s, d):
    return analytics.fixed_buckets(_kw(s, d), "intent", analytics.INTENTS)


def category_distribution(s, d):
    return analytics.distribution(table(s, d, "keyword_context"), "category")


def reconciliation(s, d):
    return analytics.distribution(table(s, d, "keyword_context"), "deterministic_reason", "requires_ai")


def volume_stats(s, d):
    return analytics.number_stats(_kw(s, d), "search_volume")


def top_keywords(s, d):
    return analytics.top_rows(_kw(s, d), "search_volume")


def top_category(s, d):
    return analytics.top_value(table(s, d, "keyword_context"), "category")


def dominant_intent(s, d):
    return analytics.dominant(_kw(s, d), "intent")


def mean_confidence(s, d):
    return analytics.mean_number(table(s, d, "keyword_context"), "business_confidence")


def run_summary(s, d):
    k = table(s, d, "keyword_context")
    return analytics.summary(k, {"with_brand": F.col("brand").isNotNull(), "with_category": F.col("category").isNotNull(), "needs_ai": F.col("requires_ai")})


def health_report(s, d):
    return analytics.percentages(run_summary(s, d), "total", ("with_brand", "with_category", "needs_ai"))


def quality_gates(s, d):
    return analytics.quality_gates(table(s, d, "keyword_context"), "business_confidence", ("keyword", "brand"))


def out_of_range(s, d):
    return analytics.out_of_range(table(s, d, "keyword_context"), "business_confidence", 0.5, 0.95).select("context_id")


def event_timers(s, d):
    return analytics.timer_snapshot(table(s, d, "events"), "event_type", "value")


def export_view(s, d):
    k = table(s, d, "keyword_context")
    view = k.select("context_id", "keyword", F.col("brand").isNotNull().alias("relevant"), F.round("business_confidence", 2).alias("confidence"))
    return analytics.export_order(view, "relevant", "confidence", "context_id")


def relevance_distribution(s, d):
    return analytics.relevance_distribution(table(s, d, "keyword_context"), F.col("brand").isNotNull(), F.col("requires_ai"))


def quality_distribution(s, d):
    return analytics.quality_distribution(table(s, d, "keyword_context"), "business_confidence")


def accounting_check(s, d):
    with_brand, with_category = F.col("brand").isNotNull(), F.col("category").isNotNull()
    return analytics.accounting(table(s, d, "keyword_context"), {"by_brand": with_brand, "by_category_alone": ~with_brand & with_category, "by_none": ~with_brand & ~with_category})


def key_figures(s, d):
    return analytics.key_figures(table(s, d, "keyword_context"), "company_id", {"needs_review": F.col("requires_ai"), "settled": ~F.col("requires_ai"), "with_brand": F.col("brand").isNotNull()})


def queries() -> dict:
    own = (
        "p5_found p5_unified p5_union p7_found p7_clean"
        " norm_case_whitespace norm_unicode_fold norm_punctuation norm_dictionary norm_company_dictionary norm_units norm_lemmas norm_numeric"
        " norm_stop_words norm_token_sort norm_engine norm_metrics string_functions profile_keys schema_projection column_resolution"
        " drop_empty_and_repeats dedup_exact dedup_normalized dedup_fuzzy_edges dedup_groups dedup_status dedup_stats"
        " keyword_fuzzy_edges keyword_groups keyword_status keyword_stats keyword_components"
        " blocking_prefix blocking_length extract_navigation extract_headings extract_url_segments extract_links page_text url_filter"
        " crawl_budget entity_evidence taxonomy_edges entity_split family_mining alias_mining synonym_mining brand_canonical fact_warnings"
        " profile_quality match_all match_first match_profile match_counts resolver_scores rule_engine match_cascade lookup_volume lookup_classes lookup_cache_split"
        " lookup_batches lookup_merge lookup_stats answers_parsed answers_repaired dataset_stats intent_distribution category_distribution reconciliation"
        " volume_stats top_keywords top_category dominant_intent mean_confidence run_summary health_report quality_gates out_of_range"
        " event_timers export_view relevance_distribution quality_distribution accounting_check key_figures"
    )
    return {name: globals()[name] for name in own.split()}
