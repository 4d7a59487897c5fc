"""License scans by ordered signature rules, as DataFrame functions only: one narrow pass, no shuffle.

A text becomes its words in lower case, each after one space, and every rule is a regular expression over that. Rules
are a table written by hand (license_rules): each has a keyword, a word that none of its matches lacks, and runs only
where that stands in the text. Matches are intervals of words. Overlaps are resolved in order of priority: a match that
overlaps one of a higher priority is suppressed, and so is one that lies within another of its own priority.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.llm.common import read
from quietfield.llm.license_rules import SECTIONS, Rule, rules
from quietfield.llm.scans import let, most_before, sums_before

# Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
MARK = "\u0001"  # stands in no line of words


def word_line(text: Column) -> Column:
    """The text's words in lower case, each after one space, and a last space.

    Only A-Z count as capitals: the two other letters that have an ASCII lower case are put out of the way.
    """
    low = F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ø")), F.lit("İ"), F.lit("ø")))
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def spaces(line: Column) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))).cast("long")


_FOUND = f"{MARK}found"
_INTERVAL = "struct<priority:int,start:bigint,back:bigint,label:string,confidence:double>"


def _intervals(hit: Column) -> Column:
    """Intervals of words of one rule's matches, from a line cut at both ends of each; ``back`` is the end negated, so
    that of those with one start the longest sorts first."""
    sizes = F.transform(hit["parts"], spaces)
    places = let(sizes, lambda n: F.zip_with(sums_before(n), n, lambda at, k: F.struct(at.alias("start"), (-at - k).alias("back"))))
    inside = F.filter(places, lambda _, i: i % 2 == 1)
    return F.transform(inside, lambda x: F.struct(hit["priority"].alias("priority"), x["start"].alias("start"), x["back"].alias("back"), hit["label"].alias("label"), hit["confidence"].alias("confidence")))


def _alternatives(words: list[str]) -> str:
    """One expression for any of some words, by their first letters."""
    return "|".join(f"{first}(?:{'|'.join(w[1:] for w in group)})" for first, group in groupby(sorted(words), key=lambda w: w[0]))


def matches(line: Column, table: list[Rule] | None = None) -> Column:
    """All rules' matches as intervals of words, sorted by priority, start and falling length."""
    table = rules() if table is None else table
    cut = "array<struct<priority:int,label:string,confidence:double,parts:array<string>>>"
    one = lambda r: F.struct(F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence"), F.split(F.regexp_replace(line, F.lit(r.regex), F.lit(f"{MARK}$0{MARK}")), MARK, -1).alias("parts"))
    by_keyword: dict[str, list[Rule]] = {}
    for r in table:
        by_keyword.setdefault(r.keyword, []).append(r)
    cuts = [F.when(F.contains(line, F.lit(f" {k} ")), F.array(*map(one, rs))).otherwise(F.array().cast(cut)) for k, rs in sorted(by_keyword.items())]
    hits = F.filter(F.concat(*cuts), lambda h: F.size(h["parts"]) > 1)
    return F.array_sort(F.flatten(F.transform(hits, _intervals)))


def suppress(kept: Column, found: Column, priority: int) -> Column:
    """``kept``, of higher priorities, and what neither it nor the other intervals of ``priority`` suppress of these.

    Sorted by where kept intervals start and where new ones end, the farthest end of the kept ones
    before a new one says whether any overlaps it; sorted by start, the farthest end before it whether one holds it.
    """

    def clear(kept: Column, own: Column) -> Column:
        event = lambda at, new: lambda x: F.struct(at(x).alias("at"), F.lit(new).alias("order"), x.alias("x"))
        events = F.array_sort(F.concat(F.transform(kept, event(lambda x: x["start"], 1)), F.transform(own, event(lambda x: -x["back"], 0))))

        def free(es: Column) -> Column:
            reach = most_before(F.transform(es, lambda e: F.when(e["order"] == 1, -e["x"]["back"]).otherwise(-1)))
            judged = F.zip_with(es, reach, lambda e, far: F.struct(e["x"].alias("x"), ((e["order"] == 0) & (far <= e["x"]["start"])).alias("free")))
            return F.array_sort(F.transform(F.filter(judged, lambda j: j["free"]), lambda j: j["x"]))

        return let(events, free)

    def outer(own: Column) -> Column:
        reach = most_before(F.transform(own, lambda x: -x["back"]))
        judged = F.zip_with(own, reach, lambda x, far: F.struct(x.alias("x"), (-x["back"] > far).alias("outer")))
        return F.transform(F.filter(judged, lambda j: j["outer"]), lambda j: j["x"])

    return let(F.filter(found, lambda x: x["priority"] == priority), lambda own: F.when(F.size(own) == 0, kept).otherwise(F.concat(kept, let(clear(kept, own), outer))))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row of ``docs`` with line, n_words, base (array of label, count, first, last) and detections.

    A null or empty text has no words and no detections. Columns of these names are replaced.
    """
    lined = docs.drop("line", "n_words", "base", "detections").withColumn("line", word_line(F.col(text)))
    base = []
    for phrase, label in BASE.items():
        parts = F.split("line", f" {phrase}(?= )", -1)
        first, last = spaces(F.element_at(parts, 1)), spaces(F.col("line")) - spaces(F.element_at(parts, -1)) - len(phrase.split())
        empty = F.lit(None).cast("struct<label:string,n:bigint,first:bigint,last:bigint>")
        base.append(F.when(F.contains("line", F.lit(f" {phrase} ")), F.struct(F.lit(label).alias("label"), (F.size(parts) - 1).cast("long").alias("n"), first.alias("first"), last.alias("last"))).otherwise(empty))
    keywords = sorted({r.keyword for r in rules()})
    gate = F.col("line").rlike(f" (?:{_alternatives(keywords)}) ")
    none = F.array().cast(f"array<{_INTERVAL}>")
    found = lined.withColumns({"n_words": spaces(F.col("line")) - 1, "base": F.filter(F.array(*base), lambda x: x.isNotNull()), _FOUND: F.when(gate, matches(F.col("line"))).otherwise(none), "detections": none})
    for priority in range(len(SECTIONS)):
        found = found.withColumn("detections", suppress(F.col("detections"), F.col(_FOUND), priority))
    shown = F.transform("detections", lambda x: F.struct(x["start"], (-x["back"]).alias("end"), x["priority"], x["label"], x["confidence"]))
    return found.withColumn("detections", shown).drop(_FOUND)


def digest(scanned: DataFrame) -> DataFrame:
    labels = lambda x: F.array_sort(F.array_distinct(x))
    base = F.transform("base", lambda x: x["label"])
    return scanned.select(
        "doc_id", "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["last"])).alias("last_word"),
        F.array_join(labels(base), ",").alias("base_labels"),
        F.array_join(labels(F.concat(base, F.transform("detections", lambda x: x["label"]))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0))).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licenses; its columns are those of the contract. Null and empty texts have no words, no labels and
    score 0; repeated rows give repeated results."""
    return digest(scan(read(spark, sf_dir, "documents").select("doc_id", "text")))
