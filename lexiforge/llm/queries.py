"""Queries of this subpackage, by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.llm import canonical_terms, dupes, leakage, lookalikes, mainbody, mixing, residue, splitting
from lexiforge.runtime import table


def _mapped(s, d):
    cases = canonical_terms.free_values(table(s, d, "keyword_context"), table(s, d, "fact_aliases"), table(s, d, "canon_terms"))
    return canonical_terms.map_values(cases, table(s, d, "canon_terms"))


def p1_found(s, d):
    return _mapped(s, d).select("field", "record_id", "term_id")


def p1_unmatched(s, d):
    return canonical_terms.unmatched_report(_mapped(s, d))


def _keywords(s, d):
    a = table(s, d, "demo_keywords").select(F.lit("demo_keywords").alias("src"), "row_id", "keyword")
    b = table(s, d, "unicode_keywords").select(F.lit("unicode_keywords").alias("src"), "row_id", F.col("search_keyword").alias("keyword"))
    return a.unionByName(b)


def p2_found(s, d):
    return lookalikes.disguised(_keywords(s, d)).select("src", "row_id")


def p2_unified(s, d):
    return lookalikes.unify(_keywords(s, d)).select("src", "row_id", "unified", "disguised")


def _records(s, d):
    return dupes.keyword_records(table(s, d, "demo_keywords"), table(s, d, "duplicate_rows"))


def p3_found(s, d):
    return dupes.copies(_records(s, d))


def p3_collapsed(s, d):
    return dupes.collapsed(_records(s, d)).select("src", "row_id", "n_copies")


def p4_found(s, d):
    return residue.residue_pages(table(s, d, "collected_content")).select("page_id").distinct()


def p4_clean(s, d):
    return residue.clean_pages(table(s, d, "collected_content")).select("page_id", "title", F.length("clean_text").alias("n_chars"))


def _clean_blocks(s, d):
    pages = table(s, d, "collected_content")
    bad = residue.residue_pages(pages).select("page_id")
    return mainbody.main_blocks(pages).join(bad, "page_id", "left_anti")


def p6_found(s, d):
    return _clean_blocks(s, d)


def p6_text(s, d):
    return mainbody.main_text(table(s, d, "collected_content"), _clean_blocks(s, d))


def p8_found(s, d):
    return leakage.leaked_runs(table(s, d, "documents"), table(s, d, "eval_items"))


def p8_report(s, d):
    found = leakage.search(table(s, d, "documents"), table(s, d, "eval_items"))
    kind = F.when(F.col("longest_run") >= leakage.RUN, "verbatim").otherwise("paraphrase")
    return found.select("doc_id", "item_id", kind.alias("kind"), F.round("cosine", 2).alias("cosine"), "longest_run")


def p8_runs(s, d):
    """The longest run of each leak, of any length."""
    found = leakage.search(table(s, d, "documents"), table(s, d, "eval_items"))
    return found.filter(F.col("longest_run") >= leakage.RUN).select("doc_id", "item_id", "longest_run")


def p9_found(s, d):
    return mixing.shares(table(s, d, "documents"), table(s, d, "source_plan")).filter("not reachable").select("source")


def p9_shares(s, d):
    return mixing.shares(table(s, d, "documents"), table(s, d, "source_plan"))


def p9_mix(s, d):
    return mixing.mix(table(s, d, "documents"), table(s, d, "source_plan"))


def p10_found(s, d):
    return splitting.oversized(table(s, d, "documents"), table(s, d, "source_plan")).select("doc_id")


def p10_pieces(s, d):
    return splitting.split(table(s, d, "documents"), table(s, d, "source_plan"))


def queries() -> dict:
    own = (
        p1_found, p1_unmatched, p2_found, p2_unified, p3_found, p3_collapsed, p4_found, p4_clean, p6_found, p6_text,
        p8_found, p8_report, p8_runs, p9_found, p9_shares, p9_mix, p10_found, p10_pieces,
    )
    return {f.__name__: f for f in own}
