"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix has as many words as the corpus.  Every source gets a target by its
weight, stopped at ``max_repeat`` times its size with the excess reshared.  The
mix is cut into equal blocks of ``block_words`` words which go to the sources by
highest quotients ``target / (2k + 1)``, cumulatively over the output shards, so
that every shard has an integer quota of each source.  A source's documents lie
in a seeded order; its seats take whole passes over that stream of blocks and
then its first blocks, so at most one document of a source is cut.  The seats are dealt
to the shards by the quotas: a document goes, in each pass, to the shard of its first block.

All of it is DataFrame operations.  Positions in a stream come from a prefix
sum in three levels (coarse bucket, fine bucket, row), hence no task ever holds a
whole source.  Per-source tables have one row per source and shard; about four
quotients a source and shard are ranked, whatever the number of sources.

Defined cases: null text or no words is size 0 and is never taken; a null source
is a source of its own, sorted last; null or repeated ``doc_id`` rows stay rows of
their own and ties in the seeded order are broken by id, then size; rows that repeat id,
source and text are emitted as often together as the plan takes them; an empty table
gives an empty result; ``mix`` ignores other columns and ``mixed`` returns them as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .shared import WORD, as_given, discard, free_names, release, row_hash, text_or_empty, written

#: Rows that one window task gets at most, about.
ROWS_PER_BUCKET = 256
HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sized(docs: DataFrame, seed: int, key: Column | None = None) -> DataFrame:
    """doc_id, source, size, seeded position and ``key`` (if given) of every document, written once."""
    text = text_or_empty()
    return written(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("skey"),
            word_count(text).alias("size"),
            row_hash(str(seed), F.col("doc_id"), F.md5(text)).alias("h"),
            *([] if key is None else [key.alias("key")]),
        ),
        "mix-sizes",
    )


def targets(sizes: DataFrame, weights=(1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """skey, source_size, weight, target of each source.

    With sources in order of the size limit per unit of weight, the level
    ``(total - limits before) / (weights from here on)`` rises while sources are
    above it and falls afterwards: its maximum is the level of the fill.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    every = W.orderBy("skey")
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("n", F.row_number().over(every)).withColumn(
        "weight", F.element_at(cycle, (F.col("n") - 1) % len(weights) + 1)
    )
    limit = F.col("source_size") * max_repeat
    fill = W.orderBy(limit / F.col("weight"), "skey").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    per = per.withColumns(
        {
            "spent": F.coalesce(F.sum(limit).over(fill), F.lit(0)),
            "used": F.coalesce(F.sum("weight").over(fill), F.lit(0)),
            "total": F.sum("source_size").over(whole),
            "all_weight": F.sum("weight").over(whole),
        }
    )
    level = (F.col("total") - F.col("spent")).cast("double") / (F.col("all_weight") - F.col("used"))
    per = per.withColumn("level", F.max(level).over(whole))
    return per.select(
        "skey", "n", "source_size", "weight", "total",
        F.least(limit.cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def quotas(goal: DataFrame, block_words: int, shards: int, max_repeat: int = 3) -> DataFrame:
    """shard (1..shards), skey, seats: Sainte-Laguë seats of the shards up to this one.

    With n sources and a house of h seats the winning divisor is total / (h + n) at least and
    total / (h - n) at most, which bounds a source's seats from both sides.  Only the
    quotients between the bounds are contested, about 4 n of a shard: the highest win.
    """
    house = goal.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn(
        "house", F.floor(F.floor(F.col("total") / block_words + 0.5) * F.col("shard") / shards)
    )
    by_shard = W.partitionBy("shard")
    share = F.when(F.col("house") > 0, F.col("target") * F.col("house") / F.col("total")).otherwise(0.0)
    slack = F.when(F.col("house") > 0, F.count(F.lit(1)).over(by_shard) / F.col("house")).otherwise(0.0)
    house = (
        house.withColumn("low", F.floor(share * F.greatest(1 - slack, F.lit(0.0)) + 0.5))
        .withColumn("high", F.when(F.col("house") > 0, F.floor(share * (1 + slack) + 0.5) + 1).otherwise(F.col("low")))
        .withColumn("open", F.col("house") - F.sum("low").over(by_shard))
        .withColumn("k", F.explode_outer(F.when(F.col("high") > F.col("low"), F.sequence("low", F.col("high") - 1))))
        .withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    )
    best = W.partitionBy("shard").orderBy(F.desc_nulls_last("quotient"), "n", "k")
    won = F.col("k").isNotNull() & (F.row_number().over(best) <= F.col("open"))
    blocks = F.ceil(F.col("source_size") / block_words)
    return (
        house.withColumn("won", won.cast("int"))
        .groupBy("shard", "skey", "source_size", "target")
        .agg((F.first("low") + F.sum("won")).alias("seats"))
        .withColumn("blocks", blocks)
        .withColumn("seats", F.least("seats", F.col("blocks") * max_repeat))
    )


def positions(sizes: DataFrame) -> DataFrame:
    """sizes with pos: words before the document in its source's seeded stream.  Rows that repeat in
    everything are one row until they have their places, so no task holds many of them."""
    rows = sizes.agg(F.count(F.lit(1))).first()[0]
    bits = min(40, max(0, math.ceil(math.log2(max(1, rows / ROWS_PER_BUCKET)))))
    coarse_bits = min(12, bits)
    sizes = sizes.groupBy(*sizes.columns).agg(F.count(F.lit(1)).alias("equal")).withColumn("all", F.col("size") * F.col("equal"))
    sizes = sizes.withColumn("fine", F.shiftright("h", HASH_BITS - bits))

    def before(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))

    fine = sizes.groupBy("skey", "fine").agg(F.sum("all").alias("words"))
    fine = fine.withColumn("coarse", F.shiftright("fine", bits - coarse_bits))
    coarse = fine.groupBy("skey", "coarse").agg(F.sum("words").alias("words"))
    coarse = before(coarse, ["skey"], ["coarse"], "words", "coarse_before").drop("words")
    fine = before(fine, ["skey", "coarse"], ["fine"], "words", "fine_before").drop("words")
    fine = fine.join(coarse, ["skey", "coarse"]).select(
        "skey", "fine", (F.col("coarse_before") + F.col("fine_before")).alias("start")
    )
    rows = before(sizes, ["skey", "fine"], ["h", "doc_id", "size"], "all", "within").join(fine, ["skey", "fine"])
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("equal") - 1)))
    return rows.withColumn("pos", F.col("start") + F.col("within") + F.col("number") * F.col("size"))


def mix(docs: DataFrame, weights=(1, 2, 3), max_repeat: int = 3, block_words: int = 16, shards: int = 8, seed: int = 7, key: Column | None = None):
    """(per document, per shard) frames of the mix.

    Per document: doc_id, source, size, source_size, target, copies (whole passes), part (words
    of the last pass that it adds), taken, first_shard (of its first copy; null if none is taken),
    and ``block``, ``blocks``, ``ends`` (its first block, its source's blocks, and the source's
    seats up to each shard) for ``shard_of``; ``key`` if given.
    Per shard: shard, skey, blocks, seats (cumulative over shards).
    """
    sizes = sized(docs, seed, key)
    release(docs.sparkSession)
    seats = written(quotas(targets(sizes, weights, max_repeat), block_words, shards, max_repeat), "mix-seats")
    per = seats.groupBy("skey", "source_size", "target", "blocks").agg(F.sort_array(F.collect_list("seats")).alias("ends"))
    last = F.element_at("ends", -1)
    per = per.select(
        "skey", "source_size", "target", "blocks", "ends",
        F.when(F.col("blocks") > 0, F.floor(last / F.col("blocks"))).otherwise(0).alias("copies"),
        (F.when(F.col("blocks") > 0, last % F.col("blocks")).otherwise(0) * block_words).alias("run"),
    )
    none = F.lit(0).cast("long")
    out = positions(sizes).join(per, "skey").withColumn("part", F.greatest(none, F.least("size", F.col("run") - F.col("pos"))))
    out = out.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
    out = out.withColumn("block", F.floor(F.col("pos") / block_words))
    first = F.when(F.col("taken") > 0, shard_of(F.lit(0), F.col("block"), F.col("blocks"), F.col("ends")))
    more = [] if key is None else ["key"]
    out = out.select("doc_id", "source", "size", "source_size", "target", "copies", "part", "taken", first.alias("first_shard"), "block", "blocks", "ends", *more)
    release(docs.sparkSession)
    out.shoal_parts = [sizes, seats]
    return out, seats


def shard_of(number: Column, block: Column, blocks: Column, ends: Column) -> Column:
    """The shard that holds a source's block in its pass of this number: the first one whose seats
    go beyond it."""
    seat = number * blocks + block
    return (F.size(F.filter(ends, lambda e: e <= seat)) + 1).cast("int")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as written."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix_key() -> Column:
    """32 bytes that name a row by id, source and text."""
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat_ws(":", number, F.length(source), source, text_or_empty()), 256))


def mixed(docs: DataFrame, shard: str | None = None, **options) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, columns as given, and
    the copy's shard in a column named ``shard`` if one is asked for.

    The document at the end of a source's last pass contributes its first words, up
    to the block's end.  Rows of equal id, source and text lie side by side in the stream; the last
    pass takes all of them, or none, or ends among them, which happens once a source.  Those few
    groups give what their last pass takes from one row.
    """
    plan, _ = mix(docs, key=mix_key(), **options)
    parts = plan.shoal_parts
    plan = plan.groupBy("key", "copies", "blocks", "ends").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("part").alias("part"), F.max("size").alias("size"), F.min("block").alias("block"),
        F.first("doc_id").alias("id"), F.first("source").alias("from"),
    )
    whole = F.col("part") == F.col("rows") * F.col("size")
    plan = written(plan.withColumn("whole", whole).filter("part > 0 or copies > 0").filter("size > 0"), "mix-plan")
    discard(*parts)
    key, p, take, here, number = free_names([*docs.columns, *([shard] if shard else [])], "key", "plan", "take", "here", "number")
    known = F.struct(*[F.col(c) for c in ("copies", "blocks", "ends", "part", "size", "block", "whole")]).alias(p)

    def emitted(rows: DataFrame, takes: Column) -> DataFrame:
        """rows with their plan, each as often as the array ``takes`` says: (pass, words or -1 for all)."""
        rows = rows.withColumn(take, F.explode(takes))
        words, x = F.col(take)["words"], F.col(p)
        cut = words >= 0
        out = []
        for c in docs.columns:
            value = as_given([c])[0]
            if c == "text":
                value = F.when(cut, first_words(value, words)).otherwise(value)
            elif c == "n_chars":
                value = F.when(cut, F.length(first_words(as_given(["text"])[0], words)).cast(docs.schema[c].dataType)).otherwise(value)
            out.append(value.alias(c))
        if shard:
            out.append(shard_of(F.col(take)["pass"], x["block"], x["blocks"], x["ends"]).alias(shard))
        return rows.select(*out)

    def one_take(number: Column, words: Column) -> Column:
        return F.struct(number.cast("long").alias("pass"), words.cast("long").alias("words"))

    x = F.col(p)
    none = F.array().cast("array<struct<pass:bigint,words:bigint>>")
    passes = x["copies"] + F.when(x["whole"] & (x["part"] > 0), 1).otherwise(0)
    each = F.when(passes > 0, F.transform(F.sequence(F.lit(0).cast("long"), passes - 1), lambda i: one_take(i, F.lit(-1)))).otherwise(none)
    rows = docs.withColumn(key, mix_key()).join(plan.select(F.col("key").alias(key), known), key)
    out = emitted(rows, each)
    # Groups in which a source's last pass ends: one a source.  Their rows are met by id and source first.
    ends = plan.filter("part > 0 and not whole").select(F.col("key").alias(key), known, F.col("id").alias(here), F.col("from").alias(number))
    met = docs.join(ends, docs["doc_id"].eqNullSafe(ends[here]) & docs["source"].eqNullSafe(ends[number]))
    met = met.drop(here, number).filter(F.col(key) == mix_key())
    order = F.row_number().over(W.partitionBy(key).orderBy(key))
    met = met.withColumn(number, order).filter(F.col(number) == 1).drop(number)
    full, rest = F.floor(x["part"] / x["size"]), x["part"] % x["size"]
    again = F.when(full > 0, F.array_repeat(one_take(x["copies"], F.lit(-1)), full.cast("int"))).otherwise(none)
    again = F.concat(again, F.when(rest > 0, F.array(one_take(x["copies"], rest))).otherwise(none))
    return out.unionByName(emitted(met, again))
