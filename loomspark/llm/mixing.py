"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words.  Sources get targets by weight with a cap of ``most`` times
their size (the excess is shared again).  Sources, and then the shards of each
source, get integer quotas of equal-token blocks by the highest quotients
w / (2 a + 1).  A shard is a bounded random part of a source, so a source with
a third of all rows is as many shards as it needs.  Within a shard documents
lie in a seeded order, cut into blocks; a quota of q blocks of n takes every
block q // n times and the q % n blocks from a seeded block on once more, so
each document's words come from two interval overlaps without a row per block.

Defined cases: null text has size 0; a null source is a source of its own and
comes last; a source or table of size 0 takes nothing; a null id is ordered
like any other value; rows that repeat an id are separate documents, ties between
them broken by size; an empty table gives no rows; a very long text is taken
in parts of 16 words like any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import cut_lineage

#: Words of a block; a source's words come within a block or so per shard of its target.
BLOCK = 16
#: Words of a shard, and the most shards of one mix: their sizes go to the driver.
SHARD, SHARDS = 65_536, 100_000


def capped_targets(sizes: list[int], weights: list[int], most: int = 3) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size."""
    left, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] > most * sizes[i] * total}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            return out
        for i in full:
            out[i] = float(most * sizes[i])
            left -= most * sizes[i]
        open_ -= full
    return out


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Integer quotas by highest quotients; equal quotients go to the earlier entry."""
    total, n = sum(weights), len(weights)
    if not total or seats <= 0:
        return [0] * n
    # round(w / divisor) of a divisor that seats too few is a start below the result, from which few seats are left
    start = max(0, seats - n)
    quota = [int(w * start / total + 0.5) if start else 0 for w in weights]
    quota = [max(0, q - 1) for q in quota] if sum(quota) > seats else quota
    queue = [(-w / (2 * q + 1), i) for i, (w, q) in enumerate(zip(weights, quota)) if w > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(quota)):
        _, i = queue[0]
        quota[i] += 1
        heapq.heapreplace(queue, (-weights[i] / (2 * quota[i] + 1), i))
    return quota


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words that the mix takes of every document, repeats counted."""
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = cut_lineage(docs.select("doc_id", "source", words.alias("size")))
    # one row per source: what is known of a mix beforehand, as long as a list of sources
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in rows]
    target = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
    blocks = sainte_lague(target, (round(sum(target)) + BLOCK // 2) // BLOCK)
    shard = max(SHARD, -(-sum(sizes) // SHARDS))
    sources = spark.createDataFrame(
        [(i, r.source, n, t, max(1, -(-n // shard))) for i, (r, n, t) in enumerate(zip(rows, sizes, target))],
        "src int, of string, source_size long, target double, shards int",
    )
    keyed = sized.join(sources, sized.source.eqNullSafe(sources.of)).drop("of")
    keyed = keyed.withColumn("ord", seeded(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), seed)).withColumn("shard", F.col("ord") % F.col("shards"))
    lengths = keyed.groupBy("src", "shard").agg(F.sum("size").alias("n")).collect()  # SHARDS and the sources at most
    by: dict[int, list] = {}
    for r in sorted(lengths, key=lambda r: (r.src, r.shard)):
        by.setdefault(r.src, []).append(r)
    plan = []
    for src, parts in by.items():
        for r, q in zip(parts, sainte_lague([p.n for p in parts], blocks[src])):
            n = -(-r.n // BLOCK)
            q = min(q, most * n)
            plan.append((src, r.shard, r.n, q // n if n else 0, q % n if n else 0, (first_block(seed, src, r.shard) % n) if n else 0))
    quotas = spark.createDataFrame(plan, "src int, shard long, length long, whole long, more long, first long")
    w = Window.partitionBy("src", "shard").orderBy("ord", "doc_id", "size")
    placed = keyed.withColumn("end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    one = placed.join(quotas, ["src", "shard"])
    a, b = F.col("first") * BLOCK, (F.col("first") + F.col("more")) * BLOCK  # [a, b) of the shard, going round behind its last block
    edge = F.ceil(F.col("length") / BLOCK) * BLOCK

    def overlap(low, high):
        return F.greatest(F.lit(0), F.least("end", high) - F.greatest("start", low))

    taken = F.col("whole") * F.col("size") + overlap(a, F.least(b, edge)) + overlap(F.lit(0), b - edge)
    return one.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def seeded(key: Column, seed: int) -> Column:
    """60 bits of a hash that SQL has too."""
    return F.conv(F.left(F.md5(F.concat(key, F.lit(f":{seed}"))), F.lit(15)), 16, 10).cast("long")


def first_block(seed: int, source: int, shard: int) -> int:
    return int(hashlib.md5(f"{source}:{shard}:{seed}".encode()).hexdigest()[:15], 16)


def query(weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> str:
    """The same in SQL: capped shares by one ordered pass, quotas as ranks of all quotients."""
    n = len(weights)
    cycle = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    return f"""with s as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size from documents),
g as (select source, cast(sum(size) as bigint) as n from s group by source),
o as (select *, cast(row_number() over (order by source nulls last) - 1 as int) as src, (select cast(sum(n) as bigint) from g) as total from g),
w as (select *, case src % {n} {cycle} end as w, {most} * n as cap from o),
r as (select *, total - coalesce(sum(cap) over (order by cap::double / w, src rows between unbounded preceding and 1 preceding), 0) as remaining, sum(w) over (order by cap::double / w, src rows between current row and unbounded following) as weight from w),
c as (select *, bool_and(remaining * w > cap * weight) over (order by cap::double / w, src rows between unbounded preceding and current row) as capped from r),
f as (select total - coalesce(sum(cap) filter (capped), 0) as remaining, sum(w) filter (not capped) as weight from c group by total),
t as (select c.source, src, n, case when capped then cap::double else cast(f.remaining * w as double) / f.weight end as target, total from c, f),
q as (select src, row_number() over (order by target / (2 * a + 1) desc, src, a) as k, total from (select src, target, total, unnest(range(0, (total + {BLOCK // 2}) // {BLOCK})) as a from t where target > 0)),
blocks as (select src, count(*) as blocks from q where k <= (total + {BLOCK // 2}) // {BLOCK} group by src),
p as (select t.*, coalesce(blocks, 0) as blocks, greatest(1, ceil(n / greatest({SHARD}, ceil(total / {SHARDS}))))::bigint as shards from t left join blocks using (src)),
k as (select doc_id, s.source, size, src, n as source_size, target, blocks, cast('0x' || left(md5(coalesce(doc_id::varchar, '-') || ':{seed}'), 15) as bigint) as ord, shards from s join p on s.source is not distinct from p.source),
d as (select *, ord % shards as shard from k),
l as (select src, shard, any_value(blocks) as blocks, cast(sum(size) as bigint) as length, cast(ceil(sum(size) / {BLOCK}) as bigint) as own from d group by src, shard),
u as (select src, shard, row_number() over (partition by src order by length::double / (2 * a + 1) desc, shard, a) as k, blocks from (select src, shard, length, blocks, unnest(range(0, blocks)) as a from l where length > 0)),
v as (select src, shard, count(*) as seats from u where k <= blocks group by src, shard),
x as (select l.src, l.shard, length, own, least(coalesce(seats, 0), {most} * own) as seats, case when own > 0 then cast('0x' || left(md5(l.src || ':' || l.shard || ':{seed}'), 15) as bigint) % own else 0 end as first from l left join v using (src, shard)),
y as (select *, case when own > 0 then seats // own else 0 end as whole, case when own > 0 then seats % own else 0 end as more from x),
z as (select d.*, sum(size) over (partition by src, shard order by ord, doc_id, size rows unbounded preceding) as high from d)
select doc_id, size, source_size, target, cast(whole * size
  + greatest(0, least(high, (first + more) * {BLOCK}, own * {BLOCK}) - greatest(high - size, first * {BLOCK}))
  + greatest(0, least(high, (first + more - own) * {BLOCK}) - greatest(high - size, 0)) as bigint) as taken
from z join y using (src, shard)"""
