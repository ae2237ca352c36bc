"""Repeated passages: relative Lempel-Ziv parsing of every document against the whole corpus.

The reference is the corpus itself, cut into blocks by content: of the 24 twelve-word grams inside a
window of 35 words, the least by hash is the window's anchor, and all consecutive windows with one
anchor make a phrase (their words from the first to the last, at most 58). Equal text is cut alike
wherever it stands, so equal windows always lie in phrases with equal anchors, and the index of the
reference blocks is an inverted table of anchors and phrases.

A document is parsed greedily in three steps, each a counted join on hashes that merges before the
shuffle, so a passage found in a third of all rows costs no more than another:

1. an anchor found nowhere else: no window of the phrase is repeated (literals);
2. a phrase found elsewhere as a whole: all its windows are repeated, and it joins the factor;
3. other phrases lie at a factor's boundary: their windows are checked one by one, against the
   boundary windows of all documents and one copy of each repeated phrase with the same anchor.

Factors that touch are joined. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlife.llm.words import RUN_POWERS, Powers, Words, fresh, mix, runs, slices, words
from loanlife.support import materialize

WINDOW, GRAM = 35, 12

_PARSED = ("doc_id long, row long, n_words long, whole_sha256 string,"
           " phrases array<struct<anchor: long, phrase: long, first: int, n: int>>")


def _joined(w: Words, i: int, keep: np.ndarray | None = None) -> bytes:
    """Words of row ``i`` joined by one blank."""
    a, b = w.offsets[i], w.offsets[i + 1]
    starts, ends = w.starts[a:b], w.ends[a:b]
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    if len(starts) == 0:
        return b""
    lengths = ends - starts + 1
    total = int(lengths.sum())
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
    out = w.data[at + np.arange(total)]
    out[np.cumsum(lengths) - 1] = 32
    return out[:-1].tobytes()


def _phrases(w: Words, window: int, gram: int):
    """Anchor hash, phrase hash, first window and number of windows of all phrases of a slice, and
    how many phrases each row has."""
    counts = w.counts
    rows = len(counts)
    n = len(w.hashes)
    span = window - gram + 1
    if n < window:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, none.astype(np.int32), none.astype(np.int32), np.zeros(rows, np.int64)
    grams = runs(w.hashes, gram)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    each = np.maximum(counts - window + 1, 0)
    begin = np.repeat(w.offsets[:-1] - np.concatenate([[0], np.cumsum(each)])[:-1], each)
    start = begin + np.arange(len(begin))
    row = np.repeat(np.arange(rows), each)
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(start)))
    up, down = RUN_POWERS.upto(n + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(w.hashes * up[:n])])
    a = start[at]
    b = a + size + window - 1
    phrase = mix((sums[b] - sums[a]) * down[a] ^ mix(size.astype(np.uint64)))
    first = (a - w.offsets[:-1][row[at]]).astype(np.int32)
    return (grams[anchor[at]], phrase, first, size.astype(np.int32),
            np.bincount(row[at], minlength=rows))


def parse(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Phrases of every row, its key, number of words and the hash of its words joined by blanks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i, j in slices(batch.column(1)):
                ids = batch.column(0).slice(i, j - i)
                w = words(batch.column(1).slice(i, j - i), powers)
                anchor, phrase, first, n, each = _phrases(w, window, gram)
                items = pa.StructArray.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(phrase.view(np.int64)),
                     pa.array(first), pa.array(n)], names=["anchor", "phrase", "first", "n"])
                ends = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
                yield pa.record_batch(
                    [ids, batch.column(2).slice(i, j - i), pa.array(w.counts),
                     pa.array([hashlib.sha256(_joined(w, k)).hexdigest() for k in range(j - i)]),
                     pa.ListArray.from_arrays(pa.array(ends), items)],
                    names=["doc_id", "row", "n_words", "whole_sha256", "phrases"])
    return _texts(docs).mapInArrow(run, _PARSED)


def _row_key() -> Column:
    """A key of a row by its id and text; rows equal in both share it, and lose the same words."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       _row_key().alias("row"))


def _with_text(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``(doc_id, text, row, items)`` for the rows named in ``lists(doc_id, row, items)``."""
    other = lists.select(F.col("doc_id").alias("own_id"), "row", "items").hint("shuffle_hash")
    return (_texts(docs).join(other, "row").where(F.col("doc_id").eqNullSafe(F.col("own_id")))
            .select("doc_id", "text", "row", "items"))


def _rows_with_words(batches: Iterator[pa.RecordBatch]):
    """Slices with their words."""
    powers = Powers()
    for batch in batches:
        for i, j in slices(batch.column(1)):
            part = batch.slice(i, j - i)
            yield part, words(part.column(1), powers)


def boundary_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, row, first, hash)`` of each window in the listed phrases ``items(first, n)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in _rows_with_words(batches):
            items = part.column(3)
            begins, sizes = items.offsets.to_numpy(), np.diff(items.offsets.to_numpy())
            flat = items.values.slice(begins[0], begins[-1] - begins[0])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            first, n = flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64)
            owner = np.repeat(owner, n)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(first.astype(np.int64), n) + step
            hashes = runs(w.hashes, window)[w.offsets[:-1][owner] + start]
            take = pa.array(owner)
            yield pa.record_batch(
                [part.column(0).take(take), part.column(2).take(take),
                 pa.array(start.astype(np.int32)), pa.array(hashes.view(np.int64))],
                names=["doc_id", "row", "first", "hash"])
    return texts.mapInArrow(run, "doc_id long, row long, first int, hash long")


def factors(docs: DataFrame, parsed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, row, items)``: the runs ``(first, n)`` of repeated windows of each row that has
    any."""
    phrases = parsed.select("doc_id", "row", F.inline("phrases"))
    # Written first, so that the joins below are plain ones whose hot keys can be split.
    again = materialize(phrases.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1")
                        .select("anchor"), "again")
    shared = materialize(phrases.join(again, "anchor"), "shared")
    whole = materialize(shared.groupBy("phrase").agg(
        F.count("*").alias("c"), F.min("row").alias("copy")).where("c > 1").drop("c"), "whole")
    marked = materialize(shared.join(whole, "phrase", "left"), "marked")
    border = marked.where("copy is null")
    copies = marked.where("row = copy").join(border.select("anchor").distinct(), "anchor",
                                             "left_semi")

    def listed(df):    # a set, as equal rows name the same places
        return df.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "n")).alias("items"))
    todo = listed(border.select("doc_id", "row", "first", "n").union(
        copies.select("doc_id", "row", "first", "n")))
    single = materialize(boundary_windows(_with_text(docs, todo), window), "windows")
    found = materialize(single.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1")
                        .select("hash"), "found")
    return listed(marked.where("copy is not null").select("doc_id", "row", "first", "n").union(
        single.join(found, "hash").select("doc_id", "row", "first", F.lit(1).alias("n"))))


def _covered(n_words: int, first: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    steps = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + n + window - 1, -1)
    return np.cumsum(steps[:-1]) > 0


def spans(found: DataFrame, parsed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, row, n_words, n_removed, spans)``: joined factors as word ranges
    ``(start, length)``, ascending."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, out = [], []
            for n_words, items in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                cover = _covered(n_words, items.values.field(0).to_numpy(),
                                 items.values.field(1).to_numpy(), window)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]])
                                              .view(np.int8)))
                removed.append(int(cover.sum()))
                out.append([{"start": int(a), "length": int(b - a)}
                            for a, b in zip(edge[0::2], edge[1::2], strict=True)])
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(removed, pa.int64()),
                 pa.array(out, pa.list_(pa.struct([("start", pa.int32()),
                                                   ("length", pa.int32())])))],
                names=["doc_id", "row", "n_words", "n_removed", "spans"])
    sized = found.join(parsed.select("row", "n_words").distinct(), "row")
    return sized.select("doc_id", "row", "n_words", "items").mapInArrow(
        run, "doc_id long, row long, n_words long, n_removed long,"
             " spans array<struct<start: int, length: int>>")


def _keep(items, count: int) -> np.ndarray:
    keep = np.ones(count, dtype=bool)
    for a, n in zip(items.values.field(0).to_numpy(), items.values.field(1).to_numpy(),
                    strict=True):
        keep[a:a + n] = False
    return keep


def kept_digests(texts: DataFrame) -> DataFrame:
    """``(row, kept_sha256)``: hash of the words outside the spans, joined by one blank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in _rows_with_words(batches):
            kept = [hashlib.sha256(_joined(w, i, _keep(part.column(3)[i], w.counts[i]))).hexdigest()
                    for i in range(part.num_rows)]
            yield pa.record_batch([part.column(2), pa.array(kept, pa.string())],
                                  names=["row", "kept_sha256"])
    return texts.mapInArrow(run, "row long, kept_sha256 string")


def repeat_report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_words, n_removed, kept_sha256,
    spans``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word is removed when a window of ``window``
    words of its text covers it whose words also start anywhere else, in the same text or another;
    all copies go. Null, empty and shorter texts lose nothing. Repeated rows are copies of each
    other. Null ids are kept as such; many rows of one id or of none cost no more than others. Other
    columns are ignored.
    """
    parsed = materialize(parse(docs, window, gram), "parsed")
    cut = materialize(spans(factors(docs, parsed, window), parsed, window), "spans")
    partly = cut.where("n_removed < n_words").select("doc_id", "row", F.col("spans").alias("items"))
    digests = kept_digests(_with_text(docs, partly)).distinct()
    empty = hashlib.sha256(b"").hexdigest()
    return (parsed.select("doc_id", "row", "n_words", "whole_sha256")
            .join(cut.select("row", "n_removed", "spans"), "row", "left")
            .join(digests, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                    F.when(F.col("n_removed").isNull(), F.col("whole_sha256"))
                    .when(F.col("n_removed") == F.col("n_words"), F.lit(empty))
                    .otherwise(F.col("kept_sha256")).alias("kept_sha256"),
                    F.coalesce("spans", F.array()).alias("spans")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; all other columns stay as they are.

    The text between a removed word and the next kept word goes with it, so line ends inside kept
    parts stay. Texts without repeats, null ones included, are unchanged; a text of which nothing
    is left becomes empty.
    """
    parsed = materialize(parse(docs, window, gram), "parsed")
    cut = spans(factors(docs, parsed, window), parsed, window)
    names, schema = docs.columns, docs.schema
    own, cuts_of = fresh("own_row", names), fresh("cuts", names)
    hits = cut.select(F.col("row").alias(own), F.col("spans").alias(cuts_of))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            column, cuts = batch.column(at), batch.column(len(names))
            texts = column.to_pylist()
            for i, j in slices(column):
                w = words(column.slice(i, j - i), powers)
                for k in range(i, j):
                    if cuts[k].is_valid:
                        texts[k] = _cut_text(w, k - i, cuts[k].as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, column.type) if c == at else batch.column(c)
                 for c in range(len(names))], names=names)
    return (docs.withColumn(own, _row_key()).join(hits.hint("shuffle_hash"), own, "left").drop(own)
            .mapInArrow(run, schema))


def _cut_text(w: Words, i: int, found: list[dict]) -> str:
    a, b = int(w.offsets[i]), int(w.offsets[i + 1])
    keep = np.ones(b - a, dtype=bool)
    for s in found:
        keep[s["start"]:s["start"] + s["length"]] = False
    flips = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).view(np.int8)))
    parts = []
    for s, e in zip(flips[0::2] + a, flips[1::2] + a, strict=True):
        stop = w.starts[e] if e < b else w.ends[e - 1]
        parts.append(w.data[w.starts[s]:stop].tobytes())
    return b"".join(parts).decode("utf-8", "replace").strip(" \t\n\v\f\r")
