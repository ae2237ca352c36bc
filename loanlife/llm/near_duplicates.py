"""Near duplicates: an inverted join of MinHash coordinates, confirmed on full shingle sets.

Every distinct shingle set is posted under each of its coordinate-value pairs. Two sets that agree
in at least ``matches`` of ``size`` coordinates are candidates. Values that one set alone has are
skipped; of the rest, only the rarest ``shared - matches + 1`` of a set (its prefix, by list length)
can be the first that a candidate pair has in common, so only these are merged. With 32 coordinates
and 13 matches a pair of similarity 0.75 is missed with a chance of about one in 100,000, and
closer pairs far more rarely.

A list is never expanded into all its pairs:

1. Each list has one leader, the member with the fewest values of its own. Member-leader pairs with
   enough equal coordinates are confirmed exactly, and their components are labelled.
2. Lists with one leader form a pool. Pools whose members have one label are done. In the others,
   members of *different* labels are compared exactly, block against block: blocks are bounded, two
   blocks of one label are never compared, and a block pair returns at most one link for each label.

So work beyond the first step is (members not yet joined) x (members of their pools).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlife.llm.components import components
from loanlife.llm.words import Powers, coordinates, shingles, slices, words
from loanlife.support import materialize

SIZE, MATCHES, PERCENT, WORDS = 32, 13, 75, 5
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 400_000

_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature array<int>"
_SETS = "doc_id long, n_shingles long, values array<long>"


def signatures(docs: DataFrame, length: int = WORDS, size: int = SIZE) -> DataFrame:
    """Set size, a 128-bit hash of the set and its MinHash signature, for every row of
    ``(doc_id, text)``. A row without words has size 0 and an empty signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                values, offsets = shingles(words(batch.column(1).slice(a, b - a), powers, True),
                                           length)
                n = np.diff(offsets)
                full = n > 0
                out = np.zeros((2, len(n)), dtype=np.uint64)
                if full.any():
                    at = offsets[:-1][full]
                    spread = values * np.uint64(0xC2B2AE3D27D4EB4F)
                    spread ^= spread >> np.uint64(32)
                    out[0, full] = np.add.reduceat(values, at)
                    out[1, full] = np.add.reduceat(spread * spread, at)
                ends = np.concatenate([[0], np.cumsum(full * size)]).astype(np.int32)
                flat = coordinates(values, offsets, size).view(np.int32).ravel()
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)),
                     pa.array(out[0].view(np.int64)), pa.array(out[1].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, _SIGNED)


def shingle_sets(docs: DataFrame, length: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, values)``: the distinct shingle hashes of each row, ascending."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                values, offsets = shingles(words(batch.column(1).slice(a, b - a), powers, True),
                                           length)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                              pa.array(values.view(np.int64)))],
                    names=["doc_id", "n_shingles", "values"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, _SETS)


def prefixes(signed: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Coordinate postings ``(key, doc_id, shared)`` that can start a candidate pair.

    ``shared`` counts the coordinates of a document that another one has too.
    """
    posts = signed.select("doc_id", F.posexplode("signature").alias("k", "v")).select(
        "doc_id", (F.shiftleft(F.col("k").cast("long"), 32)
                   .bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    mine = Window.partitionBy("doc_id")
    return (posts.join(lists, "key")
            .withColumn("shared", F.count("*").over(mine))
            .withColumn("at", F.row_number().over(mine.orderBy("n", "key")))
            .where((F.col("shared") >= matches) & (F.col("at") <= F.col("shared") - matches + 1))
            .select("key", "doc_id", "shared"))


def led_pairs(prefix: DataFrame) -> DataFrame:
    """Distinct ``(leader, doc_id)`` of the lists; the leader has most shared values, then the
    least id."""
    led = (prefix.groupBy("key")
           .agg(F.min(F.struct((-F.col("shared")).alias("s"), "doc_id")).alias("first"),
                F.count("*").alias("n")).where("n > 1")
           .select("key", F.col("first.doc_id").alias("leader")))
    return (prefix.join(led, "key").where("doc_id <> leader")
            .select("leader", "doc_id").distinct())


def confirm(pairs: DataFrame, signed: DataFrame, sets: DataFrame, matches: int = MATCHES,
            percent: int = PERCENT) -> DataFrame:
    """Pairs ``(leader, doc_id)`` with enough equal coordinates and, exactly, enough shingles."""
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda e: e))
    close = (pairs.join(signed.select("doc_id", F.col("signature").alias("sig_a")), "doc_id")
             .join(signed.select(F.col("doc_id").alias("leader"),
                                 F.col("signature").alias("sig_b")), "leader")
             .where(agree >= matches).select("leader", "doc_id").distinct())
    common = F.size(F.array_intersect("values", "led")).cast("long")
    return (close.join(sets, "doc_id")
            .join(sets.select(F.col("doc_id").alias("leader"), F.col("values").alias("led"),
                              F.col("n_shingles").alias("n_led")), "leader")
            .withColumn("common", common)
            .where(F.col("common") * 100
                   >= (F.col("n_shingles") + F.col("n_led") - F.col("common")) * percent)
            .select(F.col("leader").alias("a"), F.col("doc_id").alias("b")))


def _compare_blocks(percent: int):
    """Links between labels of one block pair, at most one fewer than there are labels."""
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        label = table.column("label").to_numpy()
        column = table.column("values").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy()
        _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        useful = seen[code] > 1
        owner, code = owner[useful], np.unique(code[useful], return_inverse=True)[1]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        common = np.zeros((len(left), len(right)), dtype=np.float32)
        step = 4096
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        for start in range(0, int(code[-1]) + 1 if len(code) else 0, step):
            a, b = np.searchsorted(code, [start, start + step])
            has = np.zeros((len(sizes), step), dtype=np.float32)
            has[owner[a:b], code[a:b] - start] = 1
            common += has[left] @ has[right].T
        common = common.astype(np.int64)
        union = sizes[left][:, None] + sizes[right][None, :] - common
        i, j = np.nonzero((common * 100 >= union * percent)
                          & (label[left][:, None] != label[right][None, :]))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x
        a_out, b_out = [], []
        for x, y in zip(label[left[i]].tolist(), label[right[j]].tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                a_out.append(x)
                b_out.append(y)
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})
    return run


def pool_links(pairs: DataFrame, labels: DataFrame, sets: DataFrame,
               percent: int = PERCENT) -> DataFrame:
    """Links ``(a, b)`` between labels that share a pool and hold a pair of similar sets."""
    ids = pairs.select("leader", F.col("doc_id").alias("id")).union(
        pairs.select("leader", F.col("leader").alias("id")).distinct())
    named = ids.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    open_pools = (named.groupBy("leader")
                  .agg(F.min("label").alias("x"), F.max("label").alias("y"),
                       F.count("*").alias("n")).where("x <> y and n > 2").select("leader"))
    members = materialize(
        named.join(open_pools, "leader", "left_semi")
        .join(sets.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n")), "id")
        .select("leader", "id", "label", "n"), "pools")

    def parts(count, total):
        return F.ceil(F.greatest(count / BLOCK_MEMBERS, total / BLOCK_SHINGLES)).cast("long")
    by_label = members.groupBy("leader", "label").agg(
        F.count("*").alias("c"), F.sum("n").alias("s")).withColumn("own", parts(F.col("c"),
                                                                                F.col("s")))
    rest = by_label.where("own = 1").groupBy("leader").agg(
        parts(F.sum("c"), F.sum("s")).alias("slots"))
    spread = by_label.join(rest, "leader", "left").select("leader", "label", "own", "slots")
    blocks = materialize(
        members.join(spread, ["leader", "label"])
        .withColumn("big", F.when(F.col("own") > 1, F.col("label")))
        .withColumn("slot", F.when(F.col("own") > 1, F.pmod(F.xxhash64("id"), "own"))
                    .otherwise(F.pmod(F.xxhash64("label"), "slots")))
        .select("leader", "id", "label", F.concat_ws(":", "big", "slot").alias("block"), "big"),
        "blocks")
    each = blocks.select("leader", "block", "big").distinct()
    other = each.select("leader", F.col("block").alias("other"), F.col("big").alias("big_b"))
    todo = each.join(other, "leader").where(
        "block <= other and not coalesce(big = big_b, false)").select("leader", "block", "other")
    first = blocks.join(todo, ["leader", "block"]).select(
        "leader", "block", "other", F.lit(0).alias("side"), "id", "label")
    second = blocks.withColumnRenamed("block", "other").join(
        todo.where("block <> other"), ["leader", "other"]).select(
        "leader", "block", "other", F.lit(1).alias("side"), "id", "label")
    return (first.union(second)
            .join(sets.select(F.col("doc_id").alias("id"), "values"), "id")
            .groupBy("leader", "block", "other")
            .applyInArrow(_compare_blocks(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, length: int = WORDS, percent: int = PERCENT,
                    size: int = SIZE, matches: int = MATCHES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Texts are linked when 100 * intersection >= ``percent`` * union of their sets of distinct
    ``length``-word shingles (A-Z lower-cased; a shorter text is one shingle). ``component_id`` is
    the least id reachable by links, ``kept`` marks the row whose id that is.

    Null and empty texts, and texts without words, have size 0 and are linked with nothing. A null
    id gets a null component and is kept. Rows that repeat an id are judged by their own texts, but
    two texts first seen under one id share its component. Other columns are ignored. An empty table
    gives an empty result.
    """
    signed = materialize(signatures(docs, length, size), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    key = ["set_a", "set_b", "n_shingles"]
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    reps = materialize(full.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *key],
                                 "left_semi").select("doc_id", "signature").distinct(), "reps")
    pairs = materialize(led_pairs(materialize(prefixes(reps, matches), "prefixes")), "pairs")
    wanted = pairs.select("doc_id").union(pairs.select("leader")).distinct()
    sets = materialize(shingle_sets(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), length)
        .where("n_shingles > 0"), "sets")
    labels = components(confirm(pairs, reps, sets, matches, percent))
    merged = components(pool_links(pairs, labels, sets, percent)).select(
        F.col("id").alias("label"), F.col("label").alias("final"))
    named = (classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
             .withColumn("label", F.coalesce("label", "rep"))
             .join(merged, "label", "left")
             .select(*key, F.coalesce("final", "label").alias("component")))
    return (signed.drop("signature").join(named, key, "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.col("component"))
                    .otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
