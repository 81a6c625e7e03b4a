"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import WORD, let, materialize

#: Rows that a numbering task has at once, about, and buckets of a source whose sums one task adds up.
BUCKET_ROWS, GROUP = 512, 1024
#: Words of a shard, about, where the number of shards isn't given; and the most levels, for 1,024 shards.
SHARD_WORDS, MOST_LEVELS = 4_000_000, 10
#: Standard deviations on either side within which a split is drawn; beyond, the probability is under 1e-15.
REACH = 9
#: Runs of turns that a shard is dealt to tasks in.
SLICES = 64


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series on x + 8, less the factors added: exact to about 3e-10, with no table."""

    def series(x: Column) -> Column:
        product = F.lit(1.0)
        for i in range(1, 9):
            product = product * (x + float(i))
        y = x + 8.0
        return y * F.log(y) - y + 0.5 * F.log(2 * math.pi * y) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(product)

    return let(x.cast("double"), series)


def _uniform(*parts) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) + F.lit(0.5)) / float(1 << 53)


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``total`` items are among the ``good``: the inverse of the distribution at ``u``."""

    def bounds(p: Column) -> Column:
        mean = p.d * p.g / F.greatest(p.n, F.lit(1))
        return let(mean, lambda m: let(REACH * F.sqrt(F.greatest(m * (1 - p.g / F.greatest(p.n, F.lit(1))) * (p.n - p.d) / F.greatest(p.n - 1, F.lit(1)), F.lit(0.0))), lambda sd: F.struct(
            p.g.alias("g"), p.n.alias("n"), p.d.alias("d"), p.u.alias("u"),
            F.greatest(F.lit(0), p.d - (p.n - p.g), F.floor(m - sd) - 2).cast("long").alias("low"), F.least(p.d, p.g, F.ceil(m + sd) + 2).cast("long").alias("high"),
        )))

    def draw(p: Column) -> Column:
        lf = _log_factorial
        first = lf(p.g) + lf(p.n - p.g) - lf(p.low) - lf(p.g - p.low) - lf(p.d - p.low) - lf(p.n - p.g - p.d + p.low) - lf(p.n) + lf(p.d) + lf(p.n - p.d)

        def step(a: Column, k: Column) -> Column:
            term = a.term + F.log((p.g - k + 1) / k * (p.d - k + 1) / (p.n - p.g - p.d + k))
            return let(term, lambda t: F.struct(t.alias("term"), (a.below + F.exp(t)).alias("below"), F.when(a.below < p.u, k).otherwise(a.at).alias("at")))

        start = let(first, lambda t: F.struct(t.alias("term"), F.exp(t).alias("below"), p.low.alias("at")))
        more = F.when(p.high > p.low, F.sequence(p.low + 1, p.high)).otherwise(F.array().cast("array<long>"))
        return F.aggregate(more, start, step, lambda a: a.at)

    parts = F.struct(good.cast("long").alias("g"), total.cast("long").alias("n"), draws.cast("long").alias("d"), u.alias("u"))
    return let(let(parts, bounds), draw)


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(source, shard, first, n): ``quotas`` (k, source, n) dealt to 2**levels shards whose sizes differ by one slot at most.

    The root has the quota of every source. Each node draws from a multivariate hypergeometric
    distribution, source by source, how its half of the slots falls on the sources; the rest goes to
    the other half. So a shard is as it would be if all slots were shuffled, and quotas stay exact.
    first: the source's slots in earlier shards.
    """
    root = quotas.agg(F.sort_array(F.collect_list(F.struct("k", "source", "n"))).alias("q"))  # one entry a source
    nodes = root.select(F.lit(0).cast("long").alias("shard"), F.transform("q", lambda x: x.source).alias("sources"), F.transform("q", lambda x: x.n).alias("q"))

    def step(a: Column, e: Column) -> Column:
        taken = hypergeometric(e.n, a.rest, a.draws, _uniform(F.lit(seed), F.col("level"), F.col("shard"), e.i))
        return let(taken, lambda t: F.struct((a.rest - e.n).alias("rest"), (a.draws - t).alias("draws"), F.concat(a.out, F.array(t)).alias("out")))

    for level in range(levels):
        nodes = nodes.withColumn("total", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("level", F.lit(level))
        start = F.struct(F.col("total").alias("rest"), F.expr("total div 2").alias("draws"), F.array().cast("array<bigint>").alias("out"))
        items = F.transform("q", lambda n, i: F.struct(n.alias("n"), i.alias("i")))
        nodes = nodes.withColumn("left", F.aggregate(items, start, step, lambda a: a.out))
        right = F.zip_with("q", "left", lambda n, x: n - x)
        halves = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("q")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("q")))
        nodes = nodes.select("sources", F.explode(halves).alias("h")).select("h.shard", "sources", "h.q")
    leaves = nodes.select("shard", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("q").alias("n"))).alias("x")).select("shard", "x.source", "x.n")
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return leaves.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def target_words(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """(k, source, source_size, target) from (source, source_size): sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all words.

    Targets stop at ``limit`` times a source's size; the excess is shared again by weight among the others
    until none is above. So a target is weight times a common level, or the limit. Sources that reach
    their limit are first in the order of limit over weight; running sums give the level at which
    the others share what those leave.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source
    known = sizes.withColumn("k", F.row_number().over(order) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("k", F.lit(len(weights))))
    known = known.withColumn("w", weight).withColumn("top", F.col("source_size") * float(limit)).withColumn("fills", F.col("top") / F.col("w"))
    by_level = Window.orderBy("fills", "k")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    known = known.select("*", F.row_number().over(by_level).alias("i"), F.coalesce(F.sum("top").over(before), F.lit(0.0)).alias("top_before"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"))
    every = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = known.withColumn("level", (F.sum("source_size").over(every) * float(share) - F.col("top_before")) / (F.sum("w").over(every) - F.col("w_before")))
    known = known.withColumn("level", F.when(F.col("level") <= F.col("fills"), F.col("level")))
    known = known.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("i"))).over(every))
    return known.select("k", "source", "source_size", F.coalesce(F.least("top", F.col("w") * F.col("level")), "top").alias("target"))


def _laid_out(docs: DataFrame, seed: int) -> DataFrame:
    """Adds at, the words of the source before the row, rows being in the order of a keyed hash: a prefix sum in three steps.

    Rows are dealt into buckets by the hash, of about BUCKET_ROWS rows however large a source is; buckets
    are summed, groups of GROUP buckets are summed, and rows are ordered within buckets only.
    """
    buckets = max(1, math.ceil(docs.count() / BUCKET_ROWS))
    docs = docs.withColumn("place", F.xxhash64("doc_id", "text_hash", F.lit(seed))).withColumn("bucket", F.pmod("place", F.lit(buckets)))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = docs.groupBy(F.col("source").alias("_s"), F.col("bucket").alias("_b")).agg(F.sum("size").alias("_n")).withColumn("_g", F.expr(f"_b div {GROUP}"))
    groups = sums.groupBy(F.col("_s").alias("_t"), F.col("_g").alias("_h")).agg(F.sum("_n").alias("_n"))
    groups = groups.select("_t", "_h", earlier(Window.partitionBy("_t").orderBy("_h")).alias("first"))  # a row for GROUP * BUCKET_ROWS rows
    sums = sums.withColumn("inner", earlier(Window.partitionBy("_s", "_g").orderBy("_b")))
    sums = sums.join(groups, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_g") == F.col("_h"))).select("_s", "_b", (F.col("first") + F.col("inner")).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    docs = docs.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    return docs.withColumn("at", F.col("base") + F.col("within")).drop("_s", "_b", "base", "within", "place", "bucket")


def _coprime(n: Column) -> Column:
    """The first number from 0.618 n on that has no factor in common with n (n from 1 to 2**39): of 128 in a row there always is one."""

    def gcd(k: Column) -> Column:  # Euclid's steps; a pair shrinks by more than half in two
        start = F.struct(n.cast("long").alias("a"), k.alias("b"))
        step = lambda x, _: F.when(x.b > 0, F.struct(x.b.alias("a"), (x.a % F.greatest(x.b, F.lit(1))).alias("b"))).otherwise(x)
        return F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda x: x.a)

    first = F.greatest(F.floor(n * 0.6180339887498949), F.lit(1)).cast("long")
    return F.get(F.filter(F.sequence(first, first + 127), lambda k: gcd(k) == 1), F.lit(0))


def _times(b: Column, step: Column, n: Column) -> Column:
    """b * step modulo n without overflow, for b, step and n up to 2**39: the upper bits of the step first."""
    upper, lower = F.shiftright(step, 16), step.bitwiseAND(F.lit(0xFFFF))
    return ((b * upper) % n * 65536 + b * lower) % n


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, block: int = 256, levels: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_hash, source, size (words), source_size, target, and pieces, what the mix takes of it.

    A source's documents, in the order of a keyed hash, are one stream of words, cut into blocks of
    ``block`` words. Its target is as many whole passes of the stream as fit, then a share of the
    blocks of one more pass, drawn without repeats in the order of a keyed affine permutation, the
    last of them cut to the word: so the words taken are the target, rounded. The blocks drawn are
    the source's slots; split_quotas deals the slots to 2**levels shards, of about SHARD_WORDS words if ``levels`` is
    None, and each shard gets its own stretch of each source's permuted slots. A piece is (shard, turn, pass, start, n): ``turn`` is the hashed
    order within the shard, start and n are words of the document, from 0. shuffled() and mixed_documents() lay the mix out.

    Null texts have size 0; a null source is a source, last in the order; repeated rows are rows of
    their own; an empty table gives no rows. Nothing else of ``docs`` is read. Reruns agree: where
    rows are equal in doc_id, source and size, as sets. All of it is columns: hot sources are never gathered.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    rows = materialize(rows, "sizes")
    plan = target_words(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    n, words = F.col("source_size"), F.floor(F.col("target") + 0.5)
    plan = plan.withColumn("passes", F.when(n > 0, F.floor(words / n)).otherwise(0)).withColumn("rest", F.when(n > 0, words - F.col("passes") * n).otherwise(0))
    plan = plan.withColumn("full", F.expr(f"source_size div {block}")).withColumn("per_pass", F.ceil(n / block)).withColumn("drawn", F.expr(f"rest div {block}"))
    plan = plan.withColumn("last", F.col("rest") - F.col("drawn") * block)
    plan = plan.withColumn("slots", F.col("passes") * F.col("per_pass") + F.col("drawn") + F.when(F.col("last") > 0, 1).otherwise(0))
    plan = materialize(plan, "plan", 0)  # a row for each source
    if levels is None:
        total = plan.agg(F.sum("target")).first()[0] or 0
        levels = min(MOST_LEVELS, max(2, math.ceil(math.log2(max(1, total / SHARD_WORDS)))))
    shards = split_quotas(plan.select("k", "source", F.col("slots").alias("n")), levels, seed)
    shards = shards.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "first"))).alias("shards"))  # one entry a shard
    plan = plan.join(shards.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), "source_size", "target", "passes", "full", "per_pass", "drawn", "last", _coprime(F.greatest("full", F.lit(1))).alias("step"), F.transform("shards", lambda x: x.first).alias("firsts"))
    rows = _laid_out(rows, seed).join(plan, F.col("source").eqNullSafe(F.col("_s")))
    shift = lambda p: F.pmod(F.xxhash64("source", p, F.lit(seed)), F.greatest("full", F.lit(1)))
    first, last = F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}")
    rows = rows.select("*", F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), shift).alias("shifts"), F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")).alias("blocks"))

    def piece(b: Column, p: Column) -> Column:
        rank = F.when(b < F.col("full"), (_times(b, F.col("step"), F.greatest("full", F.lit(1))) + F.get("shifts", p.cast("int"))) % F.greatest("full", F.lit(1))).otherwise(F.col("full"))
        size = F.when(p < F.col("passes"), block).when(rank < F.least("drawn", "full"), block).when(rank == F.col("drawn"), F.col("last")).otherwise(0)

        def made(x: Column) -> Column:
            start, stop = F.greatest(b * block, F.col("at")), F.least(b * block + x.size, F.col("at") + F.col("size"))
            slot = p * F.col("per_pass") + x["rank"]
            shard = F.size(F.filter("firsts", lambda f: f <= slot)) - 1
            return F.struct(shard.alias("shard"), F.xxhash64("source", slot, F.lit(seed)).alias("turn"), p.alias("pass"), (start - F.col("at")).alias("start"), F.greatest(stop - start, F.lit(0)).cast("long").alias("n"))

        return let(F.struct(rank.alias("rank"), size.cast("long").alias("size")), made)

    pieces = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda p: F.transform("blocks", lambda b: piece(b, p))))
    return rows.select("doc_id", "text_hash", "source", "size", "source_size", "target", F.filter(pieces, lambda x: x.n > 0).alias("pieces"))


def lay_out(rows: DataFrame, shard: str, turn: str, *ties: str) -> DataFrame:
    """``rows`` in the order of shard and turn in each partition; a shard is cut into SLICES by turn, each whole in one partition."""
    return rows.repartition(F.col(shard), F.shiftrightunsigned(turn, 64 - SLICES.bit_length() + 1)).sortWithinPartitions(shard, turn, *ties)


def shuffled(mixed: DataFrame) -> DataFrame:
    """The pieces of mix(), a row each, shards side by side and in random order within."""
    pieces = mixed.select("doc_id", "text_hash", "source", F.explode("pieces").alias("p")).select("doc_id", "text_hash", "source", "p.*")
    return lay_out(pieces, "shard", "turn", "doc_id", "start")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """The columns of ``docs``, a row for each document and pass that the mix takes words of, text cut to what is taken.

    Whole documents keep their text; of others the stretches taken are joined by line feeds. n_chars
    follows the text. Documents without words, which can't add any, go. Rows are laid out by shard and
    turn: a row has those of its piece with the least turn, so a random one of its pieces decides. Null texts have
    no words, so they go; equal rows are rows of their own, of which the same number comes out at every run.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, **options)
    taken = materialize(taken.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("size").alias("_size"), F.col("pieces").alias("_pieces")), "taken", docs.count())
    others, text = [c for c in docs.columns if c != text_col], F.col(text_col).cast("string")
    rows = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("_row"), text.alias("_text"), F.col(id_col).cast("long").alias("_di"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hi"))
    match = "_di <=> _d and _hi = _h"
    if not taken.groupBy("_d", "_h").count().where("count > 1").isEmpty():  # equal rows are numbered on both sides; else the texts needn't move for it
        taken = taken.withColumn("_copy", F.row_number().over(Window.partitionBy("_d", "_h").orderBy(F.lit(0))))
        rows = rows.withColumn("_copy_i", F.row_number().over(Window.partitionBy("_di", "_hi").orderBy(F.lit(0))))
        match += " and _copy_i = _copy"
    rows = rows.join(taken.where("size(_pieces) > 0"), F.expr(match))
    passes = F.array_distinct(F.transform("_pieces", lambda x: x["pass"]))
    rows = rows.withColumn("_pass", F.explode(passes)).withColumn("_own", F.filter("_pieces", lambda x: x["pass"] == F.col("_pass"))).drop("_pieces")
    rows = rows.withColumn("_place", F.array_min(F.transform("_own", lambda x: F.struct(x.turn.alias("turn"), x.shard.alias("shard")))))
    mine = F.sort_array(F.transform("_own", lambda x: F.struct(x.start.alias("start"), x.n.alias("n"))))
    rows = rows.withColumn("_mine", mine).withColumn("_words", F.when(F.aggregate("_mine", F.lit(0).cast("long"), lambda a, x: a + x.n) < F.col("_size"), F.regexp_extract_all("_text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))))
    follows = lambda x, i: (i > 0) & (F.get("_mine", i - 1).start + F.get("_mine", i - 1).n == x.start)
    stretch = lambda x, i: F.concat(F.when(follows(x, i), F.lit("")).when(i > 0, F.lit("\n")).otherwise(F.lit("")), F.when(follows(x, i), F.array_join(F.slice("_words", x.start + 1, x.n), "")).otherwise(F.ltrim(F.array_join(F.slice("_words", x.start + 1, x.n), ""), F.lit(" \t\n\x0b\x0c\r"))))
    text = F.when(F.col("_words").isNull(), F.col("_text")).otherwise(F.array_join(F.transform("_mine", stretch), ""))
    rows = rows.withColumn("_text", text).select("_row", "_text", F.col("_place.shard").alias("_shard"), F.col("_place.turn").alias("_turn"), "_di", "_pass")
    rows = lay_out(rows, "_shard", "_turn", "_di", "_pass")
    made = {text_col: F.col("_text")} | ({chars_col: F.length("_text").cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {})
    return rows.select(*[made.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
