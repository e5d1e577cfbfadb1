"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemill.functions.numbers import quoted
from tablemill.llm.base import attach, prepared, slim
from tablemill.operators.joins import small_side
from tablemill.session import checkpointed, materialised

#: Rows that one task puts in their final order.
RUN_ROWS = 100_000
#: A draw looks this many standard deviations to each side; what lies beyond has less weight than the
#: last bit of a double.
REACH = 9


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0 ** -53)


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL text for the number of marked balls among ``drawn`` out of ``total`` with ``marked`` marked ones.

    The distribution is inverted at ``u``. Its weights follow from each other by their quotients, so no
    factorials are needed, and a fold walks over the values that can occur. An empty urn gives 0. All
    inner values are bound by a transform of one element: the optimizer would else compute them anew for
    every step of the walk. It is SQL text because so deep an expression takes seconds to build call by call.
    """
    more = "a.w * (t.k - x) * (t.m - x) / ((x + 1) * greatest(t.n - t.k - t.m + x + 1, 1D))"
    step = f"'w', {more}, 'sum', a.sum + a.w"
    begin = "'w', 1D, 'sum', 0D"
    urn = (f"named_struct('n', double({total}), 'k', double({marked}), 'm', double({drawn}), 'u', {u})")
    reach = (f"{REACH} * sqrt(r.m * r.k / greatest(r.n, 1D) * (1 - r.k / greatest(r.n, 1D)) * (r.n - r.m)"
             f" / greatest(r.n - 1, 1D)) + {2 * REACH}")
    mean = "r.m * r.k / greatest(r.n, 1D)"
    ends = (f"named_struct('n', r.n, 'k', r.k, 'm', r.m, 'u', r.u,"
            f" 'low', bigint(greatest(0D, r.m - (r.n - r.k), floor({mean} - ({reach})))),"
            f" 'high', bigint(least(r.k, r.m, ceil({mean} + ({reach})))))")
    weight = (f"aggregate(sequence(t.low, greatest(t.low, t.high)), named_struct({begin}),"
              f" (a, x) -> named_struct({step}), a -> a.sum) * t.u")
    walk = (f"aggregate(sequence(t.low, greatest(t.low, t.high)), named_struct({begin}, 'at', t.low),"
            f" (a, x) -> named_struct({step}, 'at', if(a.sum + a.w <= goal, least(x + 1, t.high), a.at)), a -> a.at)")
    return (f"transform(transform(array({urn}), r -> {ends}), t -> transform(array({weight}), goal -> {walk})[0])[0]")


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, shard, sent): how many rows of a part go to a shard, drawn as a uniform permutation of all rows
    would have it, with shard sizes at most one apart.

    ``counts`` is (part, rows), one line per part. Shards are halved again and again. For each halving the parts
    are halved again and again too, and each step is one hypergeometric draw: how many of the rows that the
    first half of the shards takes come from the first half of the parts. All draws of a level run side by side.
    """
    rows, parts = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    base, rest = divmod(rows, shards)
    level = counts.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("part"), F.col("rows"))
    for _ in range((shards - 1).bit_length()):
        level = checkpointed(_halve_shards(level, base, rest, parts, seed))
    return level.select("part", F.col("lo").alias("shard"), F.col("rows").alias("sent"))


def _halve_shards(level: DataFrame, base: int, rest: int, parts: int, seed: int) -> DataFrame:
    """Split the rows of every node (lo, hi, part) between the two halves of its shards."""
    lo, hi = F.col("lo"), F.col("hi")
    middle = ((lo + hi + 1) / 2).cast("int")
    quota = (middle - lo) * F.lit(base) + F.greatest(F.least(middle, F.lit(rest)) - lo, F.lit(0))
    whole = hi - lo == 1
    nodes = (level.where(~whole).groupBy("lo", "hi")
             .agg(F.sort_array(F.collect_list(F.struct("part", "rows"))).alias("parts"))
             .withColumn("taken", quota.cast("long")))
    members, taken = F.col("parts"), F.col("taken")
    half = "int(ceil(size(parts) / 2))"
    total = lambda a: f"aggregate({a}, 0L, (s, x) -> s + x.rows)"
    first = f"slice(parts, 1, {half})"
    second = f"slice(parts, {half} + 1, size(parts) - {half})"
    chance = f"double(shiftrightunsigned(xxhash64({seed}, lo, hi, parts[0].part, size(parts)), 11)) * pow(2D, -53)"
    pair = (f"transform(array({hypergeometric(total('parts'), total(first), 'taken', chance)}), d -> filter(array("
            f"named_struct('parts', {first}, 'taken', d), named_struct('parts', {second}, 'taken', taken - d)),"
            f" p -> size(p.parts) > 0))[0]")
    for depth in range(max(parts - 1, 0).bit_length()):
        if depth % 4 == 3:  # many nodes by now
            nodes = nodes.repartition("lo", members[0]["part"])
        nodes = nodes.selectExpr("lo", "hi", f"explode({pair}) AS x").select("lo", "hi", "x.parts", "x.taken")
    one = members[0]
    split = nodes.select(F.explode(F.array(
        F.struct(lo.alias("lo"), middle.alias("hi"), one["part"].alias("part"), taken.alias("rows")),
        F.struct(middle.alias("lo"), hi.alias("hi"), one["part"].alias("part"), (one["rows"] - taken).alias("rows")),
    )).alias("x")).select("x.*")
    return split.unionByName(level.where(whole))


def uniform_shards(df: DataFrame, shards: int, keys: list[str], seed: int = 0, run_rows: int = RUN_ROWS) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to ``shards`` - 1, sizes at most one apart) and ``slot`` (gapless from 0).

    1. Rows are put into a random order inside the partition that holds them, and written to the shared folder,
       so that neither a lost executor nor another split of the input can change what was counted.
    2. The matrix of the rows that each partition sends to each shard is drawn from the partition sizes.
    3. The first rows of a partition go to shard 0, the next to shard 1 and so on: the exchange.
    4. A shard is put into a random order once more, in runs of about ``run_rows`` rows.

    ``keys`` seed the order; rows that agree in all of them, such as repeated rows, take neighbouring
    turns in no set order, and which of them stands where makes no difference. NULLs are values like any
    other. An empty table gives an empty result. Input columns called ``shard`` or ``slot`` are replaced.
    """
    prepared(df.sparkSession)
    key = [quoted(k) for k in keys]
    local = df.withColumn("__llm_first", F.xxhash64(F.lit(seed), F.lit("local"), *key)).sortWithinPartitions("__llm_first", *key)
    local = local.withColumn("__llm_at", F.monotonically_increasing_id()).drop("__llm_first")
    local = materialised(local, "sharding")
    part, place = F.shiftright("__llm_at", 33), F.col("__llm_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = checkpointed(local.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")))
    matrix = communication_matrix(counts, shards, seed)
    ends = matrix.withColumn("end", F.sum("sent").over(Window.partitionBy("part").orderBy("shard")))
    ends = ends.groupBy(F.col("part").alias("__llm_part")).agg(F.sort_array(F.collect_list("end")).alias("__llm_ends"))
    sent = local.withColumn("__llm_part", part).join(small_side(ends), "__llm_part")
    rows = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    runs = max(1, -(-rows // (shards * run_rows)))
    last = unit(F.lit(seed), F.lit("last"), *key, part, place)
    sent = attach(sent, {"shard": F.size(F.filter("__llm_ends", lambda e: e <= place)), "__llm_last": last})
    sent = sent.withColumn("__llm_run", F.floor(F.col("__llm_last") * runs).cast("int"))
    before = sent.groupBy("shard", "__llm_run").agg(F.count(F.lit(1)).alias("__llm_n"))
    before = before.withColumn("__llm_before", F.sum("__llm_n").over(Window.partitionBy("shard").orderBy("__llm_run")) - F.col("__llm_n"))
    placed = sent.join(small_side(before.drop("__llm_n")), ["shard", "__llm_run"])
    turn = F.row_number().over(Window.partitionBy("shard", "__llm_run").orderBy("__llm_last", "__llm_at"))
    out = attach(placed, {"slot": F.col("__llm_before") + turn - 1})
    return out.drop("__llm_at", "__llm_part", "__llm_ends", "__llm_last", "__llm_run", "__llm_before")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; see ``uniform_shards``.

    Only the digest columns travel. A NULL text has size 1 and checksum 0, as an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = slim(docs, doc_id="doc_id", text="text").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = uniform_shards(light, shards, ["doc_id", "size", "text_crc32"], seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
