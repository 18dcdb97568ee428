"""License detection by ordered signature rules, in column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.llm.common import lower_ascii

# What separates words in lower-cased text.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that are found word by word, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache",
                "cc by": "cc-by", "mit license": "mit"}

# One license a line: label, keyword that must occur, name as a pattern over words,
# and the versions in which it is known ('' alone: unversioned).
FAMILIES = [
    ("gpl", "general public", "(?:gnu )?general public licen[sc]e", "1.0 2.0 3.0"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public licen[sc]e", "2.1 3.0"),
    ("lgpl", "library general", "(?:gnu )?library general public licen[sc]e", "2.0"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", "1.0 3.0"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[sc]e", "1.1 1.2 1.3"),
    ("apache", "apache", "apache (?:software )?licen[sc]e", "1.0 1.1 2.0"),
    ("cc-by", "cc by", "cc by", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "cc by sa", "cc by sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "cc by nc", "cc by nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "cc by nd", "cc by nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", "commons attribution", "creative commons attribution", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "commons attribution", "creative commons attribution share ?alike",
     "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "commons attribution", "creative commons attribution non ?commercial",
     "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "commons attribution", "creative commons attribution no ?derivatives",
     "1.0 2.0 2.5 3.0 4.0"),
    ("cc0", "cc0", "cc0", "1.0"),
    ("mit", "mit", "(?:mit|expat) licen[sc]e", ""),
    ("mit-0", "mit", "mit no attribution licen[sc]e", ""),
    ("bsd", "bsd", "bsd licen[sc]e", ""),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd) licen[sc]e", ""),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd) licen[sc]e", ""),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd) licen[sc]e", ""),
    ("0bsd", "0bsd", "0bsd licen[sc]e", ""),
    ("isc", "isc", "isc licen[sc]e", ""),
    ("mpl", "mozilla", "mozilla public licen[sc]e", "1.0 1.1 2.0"),
    ("epl", "eclipse", "eclipse public licen[sc]e", "1.0 2.0"),
    ("eupl", "european union", "european union public licen[sc]e", "1.0 1.1 1.2"),
    ("cpl", "common public", "common public licen[sc]e", "1.0"),
    ("cddl", "distribution licen", "common development and distribution licen[sc]e", "1.0 1.1"),
    ("cecill", "cecill", "cecill (?:free software )?licen[sc]e", "1.0 2.0 2.1"),
    ("artistic", "artistic", "(?:perl )?artistic licen[sc]e", "1.0 2.0"),
    ("osl", "open software", "open software licen[sc]e", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free", "academic free licen[sc]e", "1.1 1.2 2.0 2.1 3.0"),
    ("ofl", "open font", "(?:sil )?open font licen[sc]e", "1.0 1.1"),
    ("odbl", "open database", "open database licen[sc]e", "1.0"),
    ("odc-by", "open data commons", "open data commons attribution licen[sc]e", "1.0"),
    ("bsl", "boost", "boost software licen[sc]e", "1.0"),
    ("busl", "business source", "business source licen[sc]e", "1.1"),
    ("elastic", "elastic", "elastic licen[sc]e", "2.0"),
    ("sspl", "server side", "server side public licen[sc]e", "1.0"),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e", ""),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e", ""),
    ("python", "python", "python software foundation licen[sc]e", "2.0"),
    ("php", "php", "php licen[sc]e", "3.0 3.1"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", ""),
    ("openssl", "openssl", "openssl licen[sc]e", ""),
    ("zlib", "zlib", "zlib licen[sc]e", ""),
    ("libpng", "libpng", "libpng licen[sc]e", "2.0"),
    ("zpl", "zope", "zope public licen[sc]e", "1.1 2.0 2.1"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[sc]e", ""),
    ("upl", "universal permissive", "universal permissive licen[sc]e", "1.0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", "1.0 2.0"),
    ("public-domain", "public domain", "(?:dedicated to|released (?:in)?to|in) the public domain", ""),
    ("proprietary", "all rights", "all rights reserved", ""),
]

# How a license is named: priority, confidence, words before and after its name.
FORMS = [
    (3, 0.95, "(?:is |are )?(?:licen[sc]ed|released|distributed|available|provided|published|covered) "
              "under (?:the terms of )?(?:the |an? )?", ""),
    (2, 0.8, "see (?:the )?", " for (?:more )?details"),
    (1, 0.7, "", ""),
]


def signature_rules() -> list[tuple[int, float, str, str, str]]:
    """(priority, confidence, label, keyword, pattern over words), in order of priority.

    Built from families, their versions and the forms in which they are named; a
    version that is named outranks the bare family.
    """
    rules = []
    for label, keyword, name, versions in FAMILIES:
        for priority, confidence, before, after in FORMS:
            rules.append((priority, confidence - 0.1, label, keyword, before + name + after))
            for version in versions.split():
                digits = version.removesuffix(".0").split(".")
                written = "(?: version| v|) ?v?" + " ".join(digits) + ("(?: 0)?" if version.endswith(".0") else "")
                rules.append((priority + 10, confidence, f"{label}-{version}", keyword,
                              before + name + written + after))
    return sorted(rules, key=lambda r: (-r[0], -len(r[4]), r[2], r[4]))


def words_text(text: Column) -> Column:
    """The words with one blank before, between and after; one blank if there is none."""
    return F.regexp_replace(
        F.concat(F.lit(" "), lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" ")), BETWEEN_WORDS, " ")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def _rule_table() -> Column:
    entries = ", ".join(
        f"named_struct('priority', {p}, 'confidence', {c:.2f}D, 'label', {_quoted(label)}, "
        f"'keyword', {_quoted(keyword)}, 'pattern', {_quoted(f'(?<= ){pattern}(?= )')})"
        for p, c, label, keyword, pattern in signature_rules())
    return F.expr(f"array({entries})")


def _places(words: Column, pattern: Column) -> Column:
    """(first word, word after the last) of every match of a pattern in spaced words."""
    pieces = F.split(words, pattern, -1)
    found = F.regexp_extract_all(words, pattern, F.lit(0))
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found,
                       lambda piece, match: F.struct(_blanks(piece).alias("skip"),
                                                     (_blanks(match) + 1).alias("size")))
    start = F.struct(F.lit(-1).alias("at"),
                     F.array().cast("array<struct<first:int,end:int>>").alias("places"))

    def step(state, s):
        first = state["at"] + s["skip"]
        return F.struct((first + s["size"] - 1).alias("at"), F.concat(
            state["places"], F.array(F.struct(first.alias("first"), (first + s["size"]).alias("end")))
        ).alias("places"))

    return F.aggregate(steps, start, step, lambda state: state["places"])


def _detections(words: Column) -> Column:
    """Matches of all rules whose keyword occurs, containers before what they contain."""
    due = F.filter(_rule_table(), lambda r: F.contains(words, r["keyword"]))
    found = F.flatten(F.transform(due, lambda r: F.transform(
        _places(words, r["pattern"]), lambda p: F.struct(
            p["first"].alias("first"), (-p["end"]).alias("minus_end"),
            (-r["priority"]).alias("minus_priority"), r["label"].alias("label"),
            (-r["confidence"]).alias("minus_confidence")))))
    return F.array_sort(found)


def _unsuppressed(found: Column) -> Column:
    """Drops what lies inside a match of the same or a higher priority.

    One sweep over matches sorted by start, longer and more important ones first:
    whatever can contain a match has come before it, and only matches that are
    still open are compared.
    """
    kind = "array<struct<first:int,end:int,label:string,priority:int,confidence:double>>"
    start = F.struct(F.array().cast(kind).alias("open"), F.array().cast(kind).alias("kept"))

    def step(state, d):
        end, priority = -d["minus_end"], -d["minus_priority"]
        still = F.filter(state["open"], lambda o: o["end"] > d["first"])
        inside = F.exists(still, lambda o: (o["end"] >= end) & (o["priority"] >= priority))
        entry = F.array(F.struct(
            d["first"].alias("first"), end.alias("end"), d["label"].alias("label"),
            priority.alias("priority"), (-d["minus_confidence"]).alias("confidence")))
        return F.struct(
            F.when(inside, still).otherwise(F.concat(still, entry)).alias("open"),
            F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], entry)).alias("kept"))

    return F.aggregate(found, start, step, lambda state: state["kept"])


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Licenses named in every whole text.

    Returns id, n_words, ``base`` (places of the base phrases: first, end, label),
    ``detections`` (first, end, label, priority, confidence of the rules that hold
    their ground), both in words from 0. A null or wordless text has no words and
    empty arrays. Rows are independent: one narrow pass, no shuffle; repeated rows
    give repeated results; other columns are ignored.

    Few texts pass the first gate, one search for any word that every rule needs;
    of the rules only those whose keyword occurs are run.
    """
    gate = "licen[sc]e|cc by|cc0|public domain|all rights reserved|creative commons|wtfpl"
    empty_base = F.array().cast("array<struct<first:int,end:int,label:string>>")
    empty_found = F.array().cast("array<struct<first:int,end:int,label:string,priority:int,confidence:double>>")

    def places_of(phrase, label):
        found = _places(F.col("_words"), F.lit(f"(?<= ){phrase}(?= )"))
        labelled = F.transform(found, lambda p: F.struct(
            p["first"].alias("first"), p["end"].alias("end"), F.lit(label).alias("label")))
        return F.when(F.contains(F.col("_words"), F.lit(f" {phrase} ")), labelled).otherwise(empty_base)

    base = F.flatten(F.array(*[places_of(*item) for item in BASE_PHRASES.items()]))
    return (
        docs.select(F.col(id_column), words_text(F.col(text_column)).alias("_words"))
        .withColumn("_due", F.col("_words").rlike(gate))
        .select(
            id_column, F.greatest(_blanks(F.col("_words")) - 1, F.lit(0)).cast("long").alias("n_words"),
            F.when(F.col("_due"), F.array_sort(base)).otherwise(empty_base).alias("base"),
            F.when(F.col("_due"), _detections(F.col("_words"))).alias("_found"))
        .select(id_column, "n_words", "base",
                F.when(F.size("_found") > 0, _unsuppressed(F.col("_found")))
                .otherwise(empty_found).alias("detections")))
