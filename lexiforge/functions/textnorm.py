"""Text normalisation as column expressions.

Rules run in a fixed order; each maps a Column to a Column inside whole-stage code generation (no Python). The engine keeps the text
after each rule, so which rules changed a row (the trace) and how often each did (the metrics) come out of one projection.
Null text counts as empty. After the Unicode fold the text is ASCII, so word boundaries mean the same in all engines.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The standard replacements, units, irregular plurals and filler words of the domain.
DICTIONARY = {"ergo": "ergonomic", "tv": "television", "pc": "personal computer", "ssd drive": "ssd", "usb stick": "usb flash drive"}
UNITS = ("tb", "gb", "mb", "kb", "hz", "mhz", "ghz", "w", "v", "mah")
IRREGULAR = {"mice": "mouse", "batteries": "battery", "monitors": "monitor"}
STOP_WORDS = ("best", "cheap", "buy", "sale", "online")
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0  -     　]"

Rule = Callable[[Column], Column]


@lru_cache(1)
def ascii_fold_table() -> dict[str, str]:
    """Characters whose compatibility decomposition holds ASCII, by rule from the Unicode data."""
    table = {}
    for cp in [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if c < "\x80")
        if plain:
            table[chr(cp)] = plain
    return table


def lower_case(c: Column) -> Column:
    return F.lower(c)


def squeeze_blanks(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), "^ | $", "")


def fold_unicode(c: Column) -> Column:
    """NFKD, then ASCII only; pure ASCII rows skip the table."""
    table = ascii_fold_table()
    single = {k: v for k, v in table.items() if len(v) == 1 and len(k.encode("utf-16-le")) == 2}
    other = {k: v for k, v in table.items() if k not in single}
    swapped = F.translate(c, "".join(single), "".join(single.values()))
    pairs = F.from_json(F.lit(json.dumps(other)), "map<string,string>")  # one literal, folded to a map by the optimizer
    expanded = F.array_join(F.transform(F.split(swapped, ""), lambda ch: F.coalesce(F.try_element_at(pairs, ch), ch)), "")
    has_rare = F.translate(swapped, "".join(other), "") != swapped  # a class of so many characters is slow in a pattern
    folded = F.when(has_rare, expanded).otherwise(swapped)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"[^\x00-\x7F]", "")).otherwise(c)


def open_punctuation(c: Column) -> Column:
    return F.translate(c, "-/_.", "    ")


def replace_words(mapping: dict[str, str]) -> Rule:
    """Whole words or phrases, longest first, whatever their case."""
    ordered = sorted(mapping.items(), key=lambda kv: len(kv[0]), reverse=True)

    def rule(c: Column) -> Column:
        for key, value in ordered:
            c = F.regexp_replace(c, rf"(?i)\b\Q{key}\E\b", value.replace("\\", r"\\").replace("$", r"\$"))
        return c

    return rule


def join_units(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?i)(\d+)\s+({'|'.join(UNITS)})\b", "$1$2")


def lemmatise(c: Column) -> Column:
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])

    def one(t: Column) -> Column:
        low, n = F.lower(t), F.length(t)
        return (
            F.when(F.try_element_at(irregular, low).isNotNull(), F.try_element_at(irregular, low))
            .when(low.endswith("ies") & (n > 4), F.regexp_replace(low, "ies$", "y"))
            .when(low.endswith("ing") & (n > 4), F.regexp_replace(low, "ing$", ""))
            .when(low.endswith("s") & ~low.endswith("ss") & (n > 3), F.regexp_replace(low, "s$", ""))
            .otherwise(t)
        )

    words = F.filter(F.split(c, f"{SPACE}+"), lambda t: t != "")
    return F.array_join(F.transform(words, one), " ")


def strip_zeros(c: Column) -> Column:
    return F.regexp_replace(c, r"\b0+(?=\d)", "")


def drop_stop_words(c: Column) -> Column:
    return squeeze_blanks(F.regexp_replace(c, rf"(?i)\b(?:{'|'.join(STOP_WORDS)})\b", ""))


def sort_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, f"{SPACE}+"), lambda t: t != "")), " ")


@dataclass(frozen=True)
class NormalizerConfig:
    """Which rules run; ``extra`` rules run last, in their order."""

    case: bool = True
    whitespace: bool = True
    unicode: bool = True
    punctuation: bool = True
    dictionary: bool = True
    company_dictionary: dict[str, str] = field(default_factory=dict)
    units: bool = True
    lemmas: bool = False
    numeric: bool = True
    stop_words: bool = False
    token_sort: bool = False
    extra: tuple[tuple[str, Rule], ...] = ()

    def rules(self) -> list[tuple[str, Rule]]:
        table: Sequence[tuple[bool, str, Rule]] = (
            (self.case, "case", lower_case),
            (self.whitespace, "whitespace", squeeze_blanks),
            (self.unicode, "unicode", fold_unicode),
            (self.punctuation, "punctuation", open_punctuation),
            (self.dictionary, "dictionary", replace_words(DICTIONARY)),
            (bool(self.company_dictionary), "company_dictionary", replace_words(self.company_dictionary)),
            (self.units, "units", join_units),
            (self.lemmas, "lemmas", lemmatise),
            (self.numeric, "numeric", strip_zeros),
            (self.stop_words, "stop_words", drop_stop_words),
            (self.token_sort, "token_sort", sort_tokens),
        )
        return [(n, r) for on, n, r in table if on] + list(self.extra)


def normalised(c: Column, config: NormalizerConfig = NormalizerConfig()) -> Column:
    c = F.coalesce(c, F.lit(""))
    for _, rule in config.rules():
        c = rule(c)
    return c


def normalise(df: DataFrame, column: str = "keyword", config: NormalizerConfig = NormalizerConfig()) -> DataFrame:
    """Adds ``normalized_keyword`` and ``normalization_trace`` (names of the rules that changed the row)."""
    steps = ["_s0"]
    out = df.withColumn("_s0", F.coalesce(F.col(column), F.lit("")))
    rules = config.rules()
    for k, (_, rule) in enumerate(rules, 1):
        out = out.withColumn(f"_s{k}", rule(F.col(f"_s{k - 1}")))
        steps.append(f"_s{k}")
    trace = F.concat_ws(" -> ", *[F.when(F.col(f"_s{k}") != F.col(f"_s{k - 1}"), n) for k, (n, _) in enumerate(rules, 1)])
    return out.withColumn("normalized_keyword", F.col(steps[-1])).withColumn("normalization_trace", trace).drop(*steps)


def normalisation_metrics(traced: DataFrame) -> DataFrame:
    """(metric, n): rows, rows changed, and rows changed by each rule."""
    rules = traced.select(F.explode(F.split("normalization_trace", " -> ")).alias("metric")).filter("metric <> ''").groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    totals = traced.agg(
        F.count(F.lit(1)).alias("total_processed"), F.count_if(F.col("normalization_trace") != "").alias("total_modified")
    ).select(F.expr("stack(2, 'total_processed', total_processed, 'total_modified', total_modified) as (metric, n)"))
    return totals.unionByName(rules)


# --- smaller string functions


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def profile_key(company: Column, website: Column) -> Column:
    return F.concat_ws(":", F.lower(F.trim(company)), F.lower(F.trim(website)))


def truncated(c: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, max(0, most - len(suffix))), F.lit(suffix)))


def is_semver(c: Column) -> Column:
    return c.rlike(r"^\d+\.\d+\.\d+$")


def acronym(c: Column) -> Column:
    """Initials of the alphabetic words of a name of several words."""
    words = F.filter(F.split(c, " +"), lambda w: w != "")
    initials = F.transform(F.filter(words, lambda w: w.rlike(r"^\p{L}+$")), lambda w: F.upper(F.substring(w, 1, 1)))
    return F.when(F.size(words) > 1, F.array_join(initials, ""))


def title_case(c: Column) -> Column:
    """Upper case after anything that isn't a letter, lower case elsewhere."""
    letters = F.split(F.lower(c), r"(?<=\P{L})(?=\p{L})|(?<=\p{L})(?=\P{L})")
    return F.array_join(F.transform(letters, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
