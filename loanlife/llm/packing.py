"""Best-fit packing of token sequences, improved by swap-based local search.

Texts become token ids; only documents longer than a sequence are cut. Where a piece goes depends on its
length alone, so the search works on the histogram of lengths (at most as many numbers as a sequence has
tokens): bins with equal content are one class with a count. Best fit by decreasing length fills the
classes, then underfull classes exchange one document for one, two for one, or move one, as long as the
sum of squared fills grows; emptied bins go. Classes trade all their bins at a time, so the search costs
the same for a thousand documents and for a billion. The plan says which ranks of each length go to
which bins; Spark ranks the pieces of a length, in salted groups, and each row looks its place up.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanlife.support import bounded_collect, materialize

CAPACITY = 1024
END = 2
SALTS = 256
GROUP_ROWS = 1_000_000
STEPS = 20_000

# Fixed value: how the tokenizer cuts a text.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long")
_PLACED = "sequence_id long, `offset` long"
Content = tuple[tuple[int, int], ...]    # (length, how many), longest first


# ---- tokens ----------------------------------------------------------------------------------

def byte_ranks(vocabulary: Mapping[str, int]) -> dict[bytes, int]:
    """Bytes of each token of a byte-level vocabulary, whose text stands for bytes by visible signs."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(code[c] for c in token): rank for token, rank in vocabulary.items()}


class Encoder:
    """Ids of a text from the tokenizer's own file.

    Merges of the file rank as their ids do, so a library that ranks merges by id gives the same ids
    several times faster. A file whose merges rank otherwise is refused. Strings of added tokens are one
    id wherever a text holds them.
    """

    def __init__(self, file: str):
        import tiktoken
        given = json.loads(file)
        special = {t["content"]: t["id"] for t in given["added_tokens"]}
        vocabulary = {t: i for t, i in given["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in given["model"]["merges"]]
        ids = [vocabulary[a + b] for a, b in merges]
        if any(a >= b for a, b in zip(ids, ids[1:])):
            raise ValueError("merges do not rank in the order of their ids")
        self.encoding = tiktoken.Encoding("given", pat_str=CUTS, special_tokens=special,
                                          mergeable_ranks=byte_ranks(vocabulary))

    def __call__(self, text: str | None, end: int) -> np.ndarray:
        ids = self.encoding.encode_to_numpy(text, allowed_special="all") if text else ()
        return np.append(np.asarray(ids, dtype=np.uint32), np.uint32(end))


def _cut(sent, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = sent.value
        if "encoder" not in state:    # one for all tasks of a worker
            state["encoder"] = Encoder(state["file"])
        encode = state["encoder"]
        for batch in batches:
            rows = ([], [], [], [], [])
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py(), end)
                raw = memoryview(ids.astype("<u4").tobytes())
                first = (len(ids) - 1) % capacity + 1
                begins = [0, *range(first, len(ids), capacity)]
                for i, (a, b) in enumerate(zip(begins, [*begins[1:], len(ids)], strict=True)):
                    for column, value in zip(rows, (own, i, a, b - a, zlib.crc32(raw[4 * a:4 * b])),
                                             strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()),
                                   *(pa.array(c, pa.int64()) for c in rows[2:])],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids, ``end`` appended.

    ``tokenizer`` is the content of the tokenizer's file. A longer document is cut into full pieces;
    its first piece takes what is left over.
    """
    sent = docs.sparkSession.sparkContext.broadcast({"file": tokenizer})
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _cut(sent, capacity, end), _PIECES)


# ---- the plan --------------------------------------------------------------------------------

def fill(content: Content) -> int:
    return sum(n * k for n, k in content)


def _with(content: Content, change: Mapping[int, int]) -> Content:
    kept = dict(content)
    for n, k in change.items():
        kept[n] = kept.get(n, 0) + k
    return tuple(sorted(((n, k) for n, k in kept.items() if k), reverse=True))


def best_fit(counts: Mapping[int, int], capacity: int) -> dict[Content, int]:
    """Best fit by decreasing length on counts: ``{content: bins}``.

    A piece goes to the fullest bin that takes it. Equal pieces go on filling that bin, so a class of
    equal bins is filled at once; at most one bin of it ends with fewer pieces than the others.
    """
    room = [defaultdict(int) for _ in range(capacity + 1)]

    def put(content: Content, bins: int) -> None:
        if bins:
            room[capacity - fill(content)][content] += bins

    for size in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[size]
        for r in range(size, capacity):
            if not left:
                break
            each, waiting = r // size, room[r]
            room[r] = defaultdict(int)
            for content, bins in waiting.items():
                whole = min(bins, left // each)
                part = left - whole * each if whole < bins and left - whole * each < each else 0
                left -= whole * each + part
                put(_with(content, {size: each}), whole)
                if part:
                    put(_with(content, {size: part}), 1)
                rest = bins - whole - (part > 0)
                if rest:
                    room[r][content] += rest
        each = capacity // size
        put(((size, each),), left // each)
        if left % each:
            put(((size, left % each),), 1)
    return {content: bins for classes in room for content, bins in classes.items() if bins}


def least_bins(counts: Mapping[int, int], capacity: int) -> int:
    """A number of bins no packing can go below.

    For each bound t, pieces longer than ``capacity - t`` share a bin with none of at least t, pieces
    longer than half need a bin each, and those from t up must fit beside the latter.
    """
    sizes = np.arange(capacity + 1, dtype=object)
    number = np.array([int(counts.get(int(n), 0)) for n in sizes], dtype=object)
    mass = sizes * number
    best = -(-int(mass.sum()) // capacity)
    for t in range(1, capacity // 2 + 1):
        alone = int(number[capacity - t + 1:].sum())
        large = number[capacity // 2 + 1:capacity - t + 1]
        beside = int((large * (capacity - sizes[capacity // 2 + 1:capacity - t + 1])).sum())
        middle = int(mass[t:capacity // 2 + 1].sum())
        best = max(best, alone + int(large.sum()) + max(0, -(-(middle - beside) // capacity)))
    return best


class _Offers:
    """What classes of bins could hand over in a trade: nothing, one piece, or two."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.known: dict[Content, tuple] = {}

    def of(self, content: Content) -> tuple[np.ndarray, list[dict[int, int]]]:
        """Tokens of each offer, and the pieces it consists of."""
        if content not in self.known:
            found = {(): 0}
            for i, (a, k) in enumerate(content):
                found[(a,)] = a
                if k > 1:
                    found[(a, a)] = 2 * a
                for b, _ in content[i + 1:]:
                    found[(a, b)] = a + b
            pieces = list(found)
            self.known[content] = (np.array([found[p] for p in pieces]),
                                   np.array([len(p) for p in pieces]), pieces)
        return self.known[content]


def improve(bins: Mapping[Content, int], capacity: int, goal: int, steps: int = STEPS
            ) -> dict[Content, int]:
    """Trades between underfull bins until ``goal`` bins are left or no trade helps.

    The least filled class gives, fuller ones take: a piece moves, or one or two pieces are exchanged
    for one or two (three pieces at most in all). The taker must gain tokens and have room for them; of
    all trades of a giver the one that adds most to the sum of squared fills is made, for as many bins
    as both classes have. As that sum grows with every trade, the search ends; ``steps`` only bounds its
    effort.
    """
    state, offers = dict(bins), _Offers(capacity)
    for _ in range(steps):
        if sum(state.values()) <= goal:
            break
        trade = _best_trade(state, offers, capacity)
        if trade is None:
            break
        giver, taker, down, up = trade
        moved = min(state[giver], state[taker]) if giver != taker else state[giver] // 2
        change = {n: down.count(n) - up.count(n) for n in {*down, *up}}
        for content, sign in ((giver, -1), (taker, 1)):
            state[content] -= moved
            new = _with(content, {n: sign * k for n, k in change.items()})
            if new:
                state[new] = state.get(new, 0) + moved
        for content in {giver, taker}:
            if not state[content]:
                del state[content]
    return state


def _best_trade(state: Mapping[Content, int], offers: _Offers, capacity: int):
    underfull = sorted((fill(c), c) for c in state if fill(c) < capacity)
    if not underfull:
        return None
    all_of = [offers.of(c) for _, c in underfull]
    tokens = np.concatenate([t for t, _, _ in all_of])
    number = np.concatenate([k for _, k, _ in all_of])
    lengths = np.array([len(t) for t, _, _ in all_of])
    owner = np.repeat(np.arange(len(underfull)), lengths)
    first = np.cumsum(lengths) - lengths
    fills = np.array([f for f, _ in underfull])
    room = (capacity - fills)[owner]
    for g, (own_fill, giver) in enumerate(underfull):
        others = (owner > g) | ((owner == g) & (state[giver] > 1))
        best = None
        given, pieces_given, sets_given = all_of[g]
        for j in range(1, len(given)):
            gain = given[j] - tokens
            ok = others & (gain > 0) & (gain <= room) & (number + pieces_given[j] <= 3)
            if not ok.any():
                continue
            value = np.where(ok, gain * (fills[owner] - own_fill + gain), -1)
            at = int(value.argmax())
            if best is None or value[at] > best[0]:
                best = (int(value[at]), at, j)
        if best is not None:
            _, at, j = best
            t = int(owner[at])
            return giver, underfull[t][1], sets_given[j], all_of[t][2][at - int(first[t])]
    return None


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows ``(length, from, base, each, offset)``, ordered: pieces of a length from rank ``from`` on go,
    ``each`` to a bin, to the bins from ``base`` on and start at ``offset`` there."""
    packed = improve(best_fit(counts, capacity), capacity, least_bins(counts, capacity))
    rows, used, base = [], defaultdict(int), 0
    for content, bins in sorted(packed.items(), reverse=True):
        place = 0
        for size, each in content:
            rows.append((size, used[size], base, each, place))
            used[size] += each * bins
            place += size * each
        base += bins
    if any(used[n] != c for n, c in counts.items()):
        raise AssertionError("the plan does not hold every piece once")
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# ---- places ----------------------------------------------------------------------------------

def _place(table: np.ndarray, capacity: int, fields: list[str]):
    shift = np.int64(62 - capacity.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << shift) | table[:, 1]
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            _, begin, base, each, place = table[
                np.searchsorted(keys, (size << shift) | rank, side="right") - 1].T
            inner = rank - begin
            yield pa.record_batch(
                [*(batch.column(batch.schema.get_field_index(f)) for f in fields),
                 pa.array(base + inner // each), pa.array(place + inner % each * size)],
                names=[*fields, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null or empty text is the end
    id alone. Null and repeated ids and repeated rows are documents like others, each packed once per
    row; other columns are ignored. No documents, no rows. Which of several pieces of one length goes
    where is of no account and may differ between runs. The CRC is that of the piece's ids as
    little-endian unsigned 32-bit numbers.
    """
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = materialize(cut_pieces(docs, tokenizer, capacity, end)
                         .withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {int(r.length): int(r["count"]) for r in bounded_collect(
        pieces.groupBy("length").count(), capacity, "lengths")}
    salts = max(SALTS, -(-sum(counts.values()) // GROUP_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").count().select(
        "length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt"))
                           - F.col("count")).alias("before"))
    ranked = salted.withColumn("inner", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("row")) - 1)
    placed = ranked.join(before, ["length", "salt"]).select(
        *fields, (F.col("before") + F.col("inner")).alias("rank"))
    return placed.mapInArrow(_place(plan(counts, capacity), capacity, fields),
                             f"{_PIECES}, {_PLACED}")
