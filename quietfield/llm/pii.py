"""Personal data: fixed kinds by pattern, and bootstrapped contextual extraction, as DataFrame functions only.

Fixed kinds are email, ip, card and phone. Beside them, values with a numeral or an @ and what stands before them form a
graph of instances and lexical patterns: a label (``password=…``, ``token = "…"``) or two words (``account number …``).
Seeds (entities of the fixed kinds, and strings shaped as keys) score 1; a pattern scores the mean of its instances,
damped; an instance scores as its patterns together; and so on for a few rounds. Patterns of high confidence then mark
every value that follows them, seen before or not, to its end.

A null text is empty. Positions are in code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.llm.common import Scratch, read
from quietfield.llm.scans import let, most_before, sums_before

# Kinds in order, and their patterns. What stands before each (start of a run, or the end of the last
# match) and the possessive quantifiers change no match: they keep the search linear in long runs.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Strings shaped as keys are seeds wherever they stand.
KEY = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64})(?![A-Za-z0-9])"
#: As values after a label, so are runs of hexadecimal digits, letters and numerals mixed.
KEY_VALUE = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64}|(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]{16,})$"
_VALUE = r"(?=[A-Za-z+/_.-]*[0-9@])[A-Za-z0-9+][A-Za-z0-9@+/_.-]{%d,}[A-Za-z0-9=]"
LABELLED = rf"(?<![A-Za-z0-9_])([A-Za-z_]{{2,30}}\x20?[:=]{{1,2}}\x20?[\x22']?)({_VALUE % 6})"
AFTER_WORDS = rf"(?<![\p{{L}}0-9_])(\p{{L}}{{2,30}}\x20\p{{L}}{{2,30}}[.#]?\x20)({_VALUE % 4})"
MOST = 4096  # contexts that go into the plan; more are joined
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

SPAN = "struct<start:bigint,end:bigint,kind:int>"
_EMPTY = f"array<{SPAN}>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _size(x: Column) -> Column:
    return F.length(x).cast("long")


def _walk(text: Column, regex: str, accept, make) -> Column:
    """make(match, start) of each accepted match, in order; positions by the lengths of what lies between."""
    gaps, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    both = F.zip_with(gaps, found, lambda g, m: F.struct(_size(g).alias("gap"), m.alias("m")))

    def placed(v: Column) -> Column:
        before = sums_before(F.transform(v, lambda x: x["gap"] + F.coalesce(_size(x["m"]), F.lit(0))))
        return F.zip_with(v, before, lambda x, at: F.struct(x["m"].alias("m"), (at + x["gap"]).alias("start")))

    kept = F.filter(let(both, placed), lambda x: x["m"].isNotNull() & F.coalesce(accept(x["m"]), F.lit(False)))
    return F.transform(kept, lambda x: make(x["m"], x["start"]))


def _span(kind: str):
    return lambda m, start: F.struct(start.alias("start"), (start + _size(m)).alias("end"), F.lit(KINDS.index(kind)).alias("kind"))


def base_spans(text: Column) -> Column:
    """Spans of the four fixed kinds, by start and then kind."""
    always = lambda m: m.isNotNull()
    card = lambda m: _digits(m).rlike("^[0-9]{14,19}$") & F.when(_digits(m).rlike("^[0-9]{14,19}$"), F.call_function("luhn_check", _digits(m)))
    has_digit = text.rlike("[0-9]")
    none = F.array().cast(_EMPTY)
    found = [
        F.when(F.contains(text, F.lit("@")), _walk(text, EMAIL, always, _span("email"))).otherwise(none),
        F.when(has_digit & F.contains(text, F.lit(".")), _walk(text, IP, lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), _span("ip"))).otherwise(none),
        F.when(text.rlike("[0-9][0-9 -]{12}"), _walk(text, CARD, card, _span("card"))).otherwise(none),
        F.when(has_digit & F.contains(text, F.lit("+")), _walk(text, PHONE, lambda m: F.length(_digits(m)).between(10, 15), _span("phone"))).otherwise(none),
    ]
    return F.array_sort(F.concat(*found))


def key_spans(text: Column) -> Column:
    return F.when(text.rlike(KEY), _walk(text, KEY, lambda m: m.isNotNull(), _span("secret"))).otherwise(F.array().cast(_EMPTY))


_VALUES = "array<struct<context:string,value:string,start:bigint,end:bigint>>"


def in_context(text: Column) -> Column:
    """Values with what stands before them, a label or two words: array of (context, value, start, end of the value)."""

    def make(regex: str, tidy):
        def one(m: Column, start: Column) -> Column:
            before, value = F.regexp_extract(m, regex, 1), F.regexp_extract(m, regex, 2)
            return F.struct(tidy(F.lower(before)).alias("context"), value.alias("value"), (start + _size(before)).alias("start"), (start + _size(m)).alias("end"))

        return one

    none, always = F.array().cast(_VALUES), lambda m: m.isNotNull()
    by_label = F.when(text.rlike("[:=]"), _walk(text, LABELLED, always, make(LABELLED, lambda x: F.replace(x, F.lit(" "), F.lit(""))))).otherwise(none)
    by_words = F.when(text.rlike("[0-9@]"), _walk(text, AFTER_WORDS, always, make(AFTER_WORDS, lambda x: x))).otherwise(none)
    return F.concat(by_label, by_words)


def _seed_kind(value: Column) -> Column:
    """Kind of a value that is a seed, else null."""
    whole = lambda regex: value.rlike(f"^(?:{regex})$")
    return (
        F.when(whole(EMAIL), KINDS.index("email"))
        .when(whole(rf"{_OCTET}(?:\.{_OCTET}){{3}}"), KINDS.index("ip"))
        .when(whole("[0-9]{14,19}") & F.when(whole("[0-9]{14,19}"), F.call_function("luhn_check", value)), KINDS.index("card"))
        .when(value.rlike(r"^\+[0-9]{10,15}$"), KINDS.index("phone"))
        .when(value.rlike(KEY_VALUE), KINDS.index("secret"))
    )


def learn_contexts(docs: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.7) -> DataFrame:
    """(context, kind) of high confidence, from the values of all texts of docs(text).

    A context needs ``support`` distinct values and a score of ``confidence``. Null and empty texts teach nothing, and
    repeated rows no more than one.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    pairs = docs.select(F.explode(in_context(F.coalesce("text", F.lit("")))).alias("x")).select("x.context", "x.value").groupBy("context", "value").count()
    edges = scratch.write(pairs.select("context", "value", _seed_kind(F.col("value")).alias("kind")), "edges")
    scores = edges.select("context", "value", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0).alias("s"))
    for k in range(rounds):
        contexts = scores.groupBy("context").agg((F.sum("s") / (F.count("*") + 0.5)).alias("p"))
        again = edges.join(contexts, "context").groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("p"))
        # Only what contexts say of values that aren't seeds is carried on.
        scores = edges.join(again, "value").select("context", "value", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.col("p") * 0.5).alias("s"))
        if k + 1 < rounds:
            scores = scratch.write(scores, f"scores-{k}")
    last = scores.join(edges.select("context", "value", "kind"), ["context", "value"]).groupBy("context").agg(
        (F.sum("s") / (F.count("*") + 0.5)).alias("p"), F.count("*").alias("n"), F.mode("kind", deterministic=True).alias("kind")
    )
    good = last.where((F.col("n") >= support) & (F.col("p") >= confidence) & F.col("kind").isNotNull()).select("context", "kind")
    kept = scratch.write(good, "contexts", compact=True)
    scratch.drop("edges", *(f"scores-{k}" for k in range(rounds - 1)))
    return kept


def _kinds(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """``rows`` with known: a map of contexts to kinds that has those of each row's values (others too, if they are few)."""
    few = contexts.limit(MOST + 1).collect()
    if len(few) <= MOST:
        pairs = [F.lit(x) for r in sorted(few) for x in (r.context, r.kind)]
        return rows.withColumn("known", F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,int>"))
    keyed = rows.withColumn("version", F.xxhash64("text"))
    met = keyed.select("doc_id", "version", F.explode(F.array_distinct(F.transform("values", lambda x: x["context"]))).alias("context")).distinct()
    known = met.join(contexts, "context").groupBy("doc_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("context", "kind"))).alias("known"))
    known = known.select(F.col("doc_id").alias("known_id"), F.col("version").alias("known_version"), "known")
    return keyed.join(known, F.col("doc_id").eqNullSafe(F.col("known_id")) & (F.col("version") == F.col("known_version")), "left").drop("version", "known_id", "known_version")


def find(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """``docs`` with base and spans (arrays of (start, end, kind number)); columns of these names, of ``values`` and of
    ``known`` are replaced.

    A span of the method that touches one of the fixed kinds gives way to it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.drop("base", "spans", "values", "known", "version").withColumn("values", in_context(text))
    out = _kinds(out, contexts).withColumn("base", base_spans(text))
    clear = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    by_context = F.transform("values", lambda x: F.struct(x["start"], x["end"], F.try_element_at("known", x["context"]).alias("kind")))
    found = F.concat(key_spans(text), F.coalesce(F.filter(by_context, lambda x: x["kind"].isNotNull()), F.array().cast(_EMPTY)))
    return out.withColumn("spans", F.array_sort(F.array_distinct(F.concat("base", F.filter(found, clear))))).drop("values", "known")


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


_PIECE, _PIECES = 4096, "\u0001pieces"


def redact(found: DataFrame) -> DataFrame:
    """The text with every span replaced by its kind in brackets; spans that overlap an earlier one are skipped.

    What lies between is cut from pieces of the text, as a place in a long text is only found by walking to it.
    """
    names, zero = F.array(*map(F.lit, KINDS)), F.lit(0).cast("long")
    out = found.withColumn(_PIECES, F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))

    def cut(a: Column, b: Column) -> Column:
        first = F.floor(a / _PIECE)
        some = F.array_join(F.slice(F.col(_PIECES), (first + 1).cast("int"), (F.floor((b - 1) / _PIECE) - first + 1).cast("int")), "")
        return F.when(b > a, F.substring(some, (a - first * _PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    reach = most_before(F.transform("spans", lambda x: x["end"]), 0)
    parts = F.zip_with("spans", reach, lambda x, at: F.when(x["start"] < at, "").otherwise(F.concat(cut(at, x["start"]), F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]"))))
    last = F.greatest(F.array_max(F.transform("spans", lambda x: x["end"])), zero)
    whole = F.concat(F.array_join(parts, ""), cut(last, _size(F.col("text"))))
    return out.withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text"))).drop(_PIECES)


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data; its columns are those of the contract. Null and empty texts have none; repeated rows
    give repeated results."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(find(docs, learn_contexts(docs)))
