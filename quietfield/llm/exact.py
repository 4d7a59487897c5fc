"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A text, white space deleted, is cut into blocks of a fixed number of bytes. Equal blocks get one integer: blocks are dealt
to buckets by hash, each bucket is sorted by content, and a block's name is its bucket and its rank there. Then adjacent
names are paired and pairs are named alike, until a text has one name. Names stand for contents, never for hashes of them,
so two texts have the same (rounds, name) if and only if they are equal; and they depend on the contents alone, so a task
that runs again on another executor gives the same ones.

Blocks travel once. A block that is frequent (the many copies of a text) is dealt to several buckets in proportion to its
count; its names there are told to be one by a table of at most ``LARGE`` contents, twice as many rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quietfield.llm.common import LARGE, LEAST, Scratch, parallelism, read, with_groups

BLANK = " \t\n\x0b\x0c\r"
BLOCK = 1024

def stripped(text: Column) -> Column:
    """The text without white space, null as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANK:
        out = F.replace(out, F.lit(c))
    return out


def blocks(data: Column, size: int) -> Column:
    """Binary data in consecutive blocks of ``size`` bytes, the last shorter; one empty block if there is nothing."""
    last = F.floor(F.greatest(F.octet_length(data) - 1, F.lit(0)) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _frequent(facts: DataFrame) -> DataFrame:
    """(h, parts): hashes that have 1/LARGE of all rows or more, and in how many parts to deal them; bounded by that."""
    seen = Observation()
    counts = facts.groupBy("h").agg(F.count("*").alias("c")).observe(seen, F.sum("c").alias("all"))
    top = counts.where(F.col("c") >= LEAST).orderBy(F.desc("c"), "h").limit(LARGE).collect()
    share = max((seen.get["all"] or 0) / LARGE, LEAST)
    rows = [{"h": r.h, "parts": int(r.c // share) + 1} for r in top if r.c >= share]
    listed = F.from_json(F.lit(json.dumps(rows)), "array<struct<h: bigint, parts: int>>")
    return facts.sparkSession.range(1).select(F.inline(listed))


def named(scratch: Scratch, facts: DataFrame, content: list[str], sizing: DataFrame, keep: list[str], table: str) -> DataFrame:
    """``keep`` and ``name`` for facts (rid, pos, h, content, ...): one integer for each content.

    ``sizing`` has the same ``h`` in as many rows. The table written holds each frequent content once for each bucket.
    """
    spread = 16 * parallelism(facts.sparkSession)
    dealt = facts.join(F.broadcast(_frequent(sizing)), "h", "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("rid", "pos"), F.col("parts")))
    dealt = dealt.withColumn("bucket", F.pmod(F.pmod(F.col("h"), F.lit(spread)) + part, F.lit(spread)))
    order = Window.partitionBy("bucket").orderBy(*content)
    ranked = dealt.withColumn("name", F.shiftleft(F.col("bucket"), 40) + F.dense_rank().over(order))
    first = F.col("parts").isNotNull() & ~F.lag("name", 1).over(order).eqNullSafe(F.col("name"))
    ranked = ranked.withColumn("first", first)
    out = scratch.write(ranked.select(*keep, "name", *[F.when(F.col("first"), F.col(c)).alias(f"at_{c}") for c in content]), table)
    told = out.where(F.col(f"at_{content[0]}").isNotNull()).select("name", *[f"at_{c}" for c in content])
    least = told.groupBy(*[f"at_{c}" for c in content]).agg(F.min("name").alias("least"))
    same = told.join(least, [f"at_{c}" for c in content]).where("name != least").select("name", "least").distinct()
    return out.join(F.broadcast(same), "name", "left").select(*keep, F.coalesce("least", "name").alias("name"))


def identities(docs: DataFrame, scratch: Scratch, text: str = "text", size: int = BLOCK) -> DataFrame:
    """(rid, doc_id, n_chars, sha, level, name), a row for each row of docs: equal (level, name) if and only if equal texts.

    Only doc_id and the text are read. A null text is an empty one; rows of one id are texts of their own.
    """
    data = docs.select("doc_id", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), stripped(F.col(text)).cast("binary").alias("data"))
    whole = data.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_chars", F.sha2("data", 256).alias("sha"), blocks(F.col("data"), size).alias("parts"))
    cut = whole.select("rid", "doc_id", "n_chars", "sha", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "block"))
    own = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("doc_id", "n_chars", "sha")]  # once for each text
    facts = cut.select("rid", "n", "pos", *own, "block", F.xxhash64("block").alias("h"))
    sizing = data.select(F.explode(blocks(F.col("data"), size)).alias("block")).select(F.xxhash64("block").alias("h"))
    now = named(scratch, facts, ["block"], sizing, ["rid", "n", "pos", "doc_id", "n_chars", "sha"], "blocks")
    about = now.where("n > 1 AND pos = 0").select("rid", "doc_id", "n_chars", "sha")
    done = now.where("n = 1").select("rid", "doc_id", "n_chars", "sha", F.lit(0).alias("level"), "name")
    most, level, later = now.agg(F.max("n")).first()[0] or 1, 0, []
    while most > 1:
        most, level = (most + 1) // 2, level + 1
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = now.where("n > 1").groupBy("rid", "n", F.floor(F.col("pos") / 2).cast("int").alias("half")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        pairs = pairs.select("rid", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("pos"), "a", "b", F.xxhash64("a", "b").alias("h"))
        now = named(scratch, pairs, ["a", "b"], pairs, ["rid", "n", "pos"], f"pairs-{level}")
        later.append(now.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    if later:
        long = later[0]
        for x in later[1:]:
            long = long.unionByName(x)
        done = done.unionByName(about.join(long, "rid"))
    return done


def groups(docs: DataFrame, scratch: Scratch, text: str = "text", size: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs.

    Of equal texts the row with the most code points of the original stays, then that of smallest doc_id (null last); of
    rows that tie in both, one. Null, empty and blank texts are equal to each other.
    """
    ids = scratch.write(identities(docs, scratch, text, size), "identities")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    found = ids.groupBy("level", "name").agg(F.count("*").alias("group_size"), best.alias("best")).select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("best"))
    found = scratch.write(found, "groups")
    return with_groups(ids, found, ["level", "name"], "group_size").select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("best")).alias("kept"), F.col("sha").alias("text_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts, as groups() gives them, over the whole table."""
    return groups(read(spark, sf_dir, "documents"), Scratch(spark, "exact"))
