"""Best-fit packing of token sequences by bin completion.

Documents are tokenized, cut into pieces of at most ``capacity`` tokens, and the
pieces packed into as few sequences of that capacity as the search finds. What
the search sees is the histogram of piece lengths, at most ``capacity`` rows
whatever the corpus; its result is a list of fillings (lengths of one sequence)
with the number of sequences filled like that. Each piece then finds its place
from its rank among the pieces of its length.

Search: bin completion branch-and-bound. The largest remaining piece must be in
some sequence; its undominated fillings are enumerated in the order of waste,
and each is a branch. A branch whose waste so far exceeds what the incumbent
allows is cut. Best-fit decreasing completes every node to a whole solution,
the first incumbent and each better one. A filling is used for as many
sequences as the remaining counts allow, so a node is a run of equal sequences
and the depth is bounded by the number of lengths. The search ends at the lower
bound (total length over capacity, rounded up) or after ``node_budget`` nodes,
with the best packing found.

Defined cases: a null text packs like an empty one (its end id alone); equal
rows are packed each; an empty table gives an empty result. No other column of
the documents is read."""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amity.llm.common import documents, written

CAPACITY = 2048
END_ID = 0
NODE_BUDGET = 400
FILLINGS_PER_NODE = 8
#: Fillings looked at for each that a node may branch into; the first is never dominated.
SEEN_PER_FILLING = 16
#: Words whose ids a Python worker remembers before it forgets them all.
CACHE_WORDS = 3 << 17
#: Words of letters encoded as one text.
WORDS_AT_ONCE = 2_000

Filling = tuple[tuple[int, int], ...]  # ((length, copies), ...) of one sequence
Plan = list[tuple[Filling, int]]  # fillings and how many sequences have them


# --- tokens -----------------------------------------------------------------

_TOKENIZERS: dict[str, tuple] = {}


class _Numbers(dict):
    """Word -> number in the order of first lookup; ``new`` are those to be learnt."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class _Words:
    """The ids of words by their number, one after another in an array."""

    def __init__(self) -> None:
        self.number = _Numbers()
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.number[_NEXT] = 0    # no ids

    def learn(self, ids: list[bytes]) -> None:
        """The ids of the words ``number.new``."""
        first, n = len(self.number) - len(ids), np.array([len(i) // 4 for i in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.number) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used:self.used + len(flat)] = flat
        self.start[first:first + len(ids)] = self.used + np.cumsum(n) - n
        self.length[first:first + len(ids)] = n
        self.used += len(flat)
        self.number.new = []

    def joined(self, flat: np.ndarray) -> list[bytes]:
        """The ids of texts that are given as the numbers of their words."""
        n = self.length[flat]
        end = np.cumsum(n)
        ids = self.ids[np.repeat(self.start[flat] - (end - n), n) + np.arange(end[-1])]
        cut = end[flat == 0].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *cut], cut)]


#: Byte classes: a full stop or comma between a plain letter or digit and a space is
#: a token of its own whatever stands around it.
_PLAIN, _STOP, _BLANK = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = _PLAIN
_CLASS[[0x2C, 0x2E]] = _STOP
_CLASS[0x20] = _BLANK
#: Stands between the texts of a batch; no byte of UTF-8.
_NEXT = b"\xff"


def _tokenizer(path: str) -> tuple:
    """The tokenizer of a file, the words met before (a list of one), and which ids
    end a word; kept for the life of the Python worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core only
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        _TOKENIZERS[path] = tokenizer, [_Words()], ends
    return _TOKENIZERS[path]


def _apart(raw: bytes) -> list[bytes]:
    """Words of lower-cased text, stops set apart."""
    at = np.frombuffer(raw, np.uint8)
    kind = _CLASS[at]
    stops = np.flatnonzero((kind[:-2] == _PLAIN) & (kind[1:-1] == _STOP) & (kind[2:] == _BLANK)) + 1
    return (np.insert(at, stops, 0x20).tobytes() if len(stops) else raw).split()


def _parts(texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(numbers of texts, their parts with ``_NEXT`` after each): parts that the
    tokenizer encodes the same alone as in the text, as it lowers case, drops
    white space and never merges across it. Texts that may hold one of its
    special tokens keep their case and come one by one."""
    raws = [t.encode().replace(b"\n", b" ") for t in texts]
    plain = [i for i, r in enumerate(raws) if b"<|" not in r]
    if plain:
        yield plain, _apart(b"".join([raws[i] + b" \xff " for i in plain]).lower())
    for i, r in enumerate(raws):
        if b"<|" in r:
            yield [i], [*r.split(), _NEXT]


def _encode_words(words: list[str], tokenizer, ends: np.ndarray) -> list[bytes]:
    """Ids of each word. Words of letters only are one token group each, whose
    last token carries the end-of-word mark: they are encoded as a few texts and
    cut at these marks, unless the marks are not as many as the words."""
    letters = [w.isalpha() for w in words]
    plain = [w for w, ok in zip(words, letters) if ok]
    other = iter(tokenizer.encode_batch_fast([w for w, ok in zip(words, letters) if not ok], add_special_tokens=False))
    some = [" ".join(plain[i:i + WORDS_AT_ONCE]) for i in range(0, len(plain), WORDS_AT_ONCE)]
    ids = np.concatenate([np.zeros(0, "<u4"), *[np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]])
    cuts = 4 * (np.flatnonzero(ends[ids]) + 1)
    if len(cuts) == len(plain):
        raw, cuts = ids.tobytes(), [0, *cuts.tolist()]
        one = iter([raw[a:b] for a, b in zip(cuts, cuts[1:])])
    else:
        one = iter([array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(plain, add_special_tokens=False)])
    return [next(one) if ok else array("I", next(other).ids).tobytes() for ok in letters]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text. Each different word is
    encoded once while it is remembered."""
    tokenizer, held, ends = _tokenizer(path)
    if len(held[0].number) > CACHE_WORDS:
        held[0] = _Words()
    words, out = held[0], [b""] * len(texts)
    for which, parts in _parts(texts):
        flat = np.fromiter(map(words.number.__getitem__, parts), np.int64, len(parts))
        if words.number.new:
            words.learn(_encode_words([w.decode() for w in words.number.new], tokenizer, ends))
        for i, ids in zip(which, words.joined(flat)):
            out[i] = ids
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece: the ids
    of a document and ``end_id``, cut every ``capacity`` ids."""
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows, cut = [], []
                for i, ids in enumerate(encode([t or "" for t in part.column("text").to_pylist()], tokenizer)):
                    ids += end
                    for k in range(0, len(ids), 4 * capacity):
                        piece = ids[k:k + 4 * capacity]
                        rows.append((i, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece)))
                        if with_ids:
                            cut.append(np.frombuffer(piece, "<u4").astype(np.int32))
                i, piece, start, length, crc = zip(*rows)
                cols = [part.column("doc_id").take(pa.array(i)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(cut, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(pieces, schema + (", ids array<int>" if with_ids else ""))


# --- the plan, from the histogram of lengths -------------------------------------

def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing. Sequences with equal fillings are kept as one run,
    so the work follows the number of lengths, not of pieces."""
    rest: list[int] = []  # free lengths, ascending
    runs: dict[int, list[tuple[Filling, int]]] = {}

    def put(free: int, filling: Filling, n: int) -> None:
        if free not in runs:
            rest.insert(bisect_left(rest, free), free)
            runs[free] = []
        runs[free].append((filling, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rest, size)
            if at < len(rest):
                free = rest[at]
                filling, m = runs[free].pop()
                if not runs[free]:
                    del runs[free], rest[at]
            else:
                free, filling, m = capacity, (), n
            each = free // size
            whole = min(m, n // each)
            if whole:
                put(free - each * size, filling + ((size, each),), whole)
                n -= whole * each
            if n and whole < m:
                each = min(n, each)
                put(free - each * size, filling + ((size, each),), 1)
                n -= each
                whole += 1
            if whole < m and filling:
                put(free, filling, m - whole)
    return [run for free in rest for run in runs[free]]


def _dominated(items: tuple[int, ...], by: tuple[int, ...]) -> bool:
    """Whether ``items`` can be laid into bins of the sizes ``by`` (the
    Martello-Toth test, first fit decreasing): swapping them in never hurts."""
    free = list(by)
    for x in items:
        for i, f in enumerate(free):
            if x <= f:
                free[i] -= x
                break
        else:
            return False
    return True


def _reachable(sizes: list[int], copies: list[int], free: int) -> list[int]:
    """For every i the sums up to ``free`` that pieces of sizes[i:] can make, as the
    bits of a number."""
    sums, mask = [1] * (len(sizes) + 1), (1 << (free + 1)) - 1
    for i in reversed(range(len(sizes))):
        bits, n, k = sums[i + 1], min(copies[i], free // sizes[i]), 1
        while n:
            k = min(k, n)
            bits |= bits << (k * sizes[i])
            n, k = n - k, 2 * k
        sums[i] = bits & mask
    return sums


def fillings(counts: dict[int, int], largest: int, capacity: int, most_waste: int, limit: int) -> list[tuple[int, ...]]:
    """Undominated fillings around one piece of length ``largest`` that waste at
    most ``most_waste``, least waste first, at most ``limit`` of them.

    They are enumerated by waste: the sums that the remaining pieces can make are
    known, so every step leads to a filling, and none is returned only if there is
    none within the waste. Of one waste, fillings of large pieces come first."""
    free = capacity - largest
    sizes = sorted((s for s in counts if s <= free and counts[s] > (s == largest)), reverse=True)
    copies = [counts[s] - (s == largest) for s in sizes]
    sums = _reachable(sizes, copies, free)

    def exactly(at: int, left: int, items: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not left:
            yield items
            return
        for i in range(at, len(sizes)):
            if not sums[i] >> left & 1:
                return
            for k in range(min(copies[i], left // sizes[i]), 0, -1):
                if sums[i + 1] >> (left - k * sizes[i]) & 1:
                    yield from exactly(i + 1, left - k * sizes[i], items + (sizes[i],) * k)

    out: list[tuple[int, ...]] = []
    seen = 0
    for waste in range(min(most_waste, free) + 1):
        if not sums[0] >> (free - waste) & 1:
            continue
        for items in exactly(0, free - waste, ()):
            seen += 1
            if not any(len(o) <= len(items) and _dominated(items, o) for o in out):
                out.append(items)
            if len(out) == limit or seen == SEEN_PER_FILLING * limit:
                return out
    return out


def complete_bins(counts: dict[int, int], capacity: int, node_budget: int = NODE_BUDGET,
                  width: int = FILLINGS_PER_NODE) -> Plan:
    """Bin completion, see the module's text. Lengths 1 to ``capacity``."""
    counts = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in counts.items())
    bound = -(-total // capacity)
    best = best_fit(counts, capacity)
    size = lambda plan: sum(n for _, n in plan)
    least, nodes = size(best), 0
    # depth-first with an explicit stack: (counts, plan so far, waste so far)
    stack: list[tuple[dict[int, int], Plan, int]] = [(counts, [], 0)]
    while stack and least > bound and nodes < node_budget:
        left, plan, waste = stack.pop()
        if waste > (least - 1) * capacity - total:
            continue
        nodes += 1
        done = plan + best_fit(left, capacity)
        if size(done) < least:
            best, least = done, size(done)
        if not left:
            continue
        largest = max(left)
        most = (least - 1) * capacity - total - waste
        branches = []
        for items in fillings(left, largest, capacity, most, width):
            copies: dict[int, int] = {largest: 1}
            for x in items:
                copies[x] = copies.get(x, 0) + 1
            free = capacity - largest - sum(items)
            times = min(left[s] // k for s, k in copies.items())
            if free:
                times = max(1, min(times, most // free))
            rest = {s: n - times * copies.get(s, 0) for s, n in left.items()}
            branches.append(({s: n for s, n in rest.items() if n}, [*plan, (tuple(sorted(copies.items(), reverse=True)), times)],
                             waste + times * free))
        stack.extend(reversed(branches))
    return best


def slots(plan: Plan) -> dict[str, np.ndarray]:
    """Where the pieces of a length go: for each stretch of ranks the first
    sequence, the copies in each sequence and the offset of the first copy.
    Sorted by (length, first rank)."""
    rows, used, first = [], {}, 0
    for filling, times in plan:
        offset = 0
        for length, copies in filling:
            rank = used.get(length, 0)
            rows.append((length, rank, copies, first, offset))
            used[length] = rank + copies * times
            offset += copies * length
        first += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), cols))


# --- placing the pieces ---------------------------------------------------------------

def _bucket(total: Column) -> Column:
    """Pieces of one length are dealt into about sqrt(n) buckets, so that neither
    a bucket nor the list of buckets is large."""
    return F.ceil(F.sqrt(total)).cast("long")


def place(pieces: DataFrame, capacity: int = CAPACITY, node_budget: int = NODE_BUDGET) -> DataFrame:
    """``pieces`` (a written table) plus sequence_id and offset. A piece of the
    full capacity is a sequence by itself and is not ranked."""
    short = pieces.where(F.col("length") < capacity)
    histogram = short.groupBy("length").agg(F.count("*").alias("n"))  # at most capacity rows
    counts = {r["length"]: r["n"] for r in histogram.collect()}
    plan = complete_bins(counts, capacity, node_budget)
    at = slots(plan)
    n_short = sum(n for _, n in plan)

    sizes = histogram.select("length", _bucket(F.col("n")).alias("buckets"))
    dealt = short.join(F.broadcast(sizes), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))).drop("buckets")
    dealt = written(dealt, "packing-dealt")
    order = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (dealt.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "bucket"])
              .withColumn("rank", F.col("rank") + F.col("before")))
    names = [c for c in pieces.columns]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.int64(1) << 40
        starts = at["length"] * span + at["rank"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(starts, length * span + rank, "right") - 1
            past = rank - at["rank"][i]
            sequence = at["sequence"][i] + past // at["copies"][i]
            offset = at["offset"][i] + past % at["copies"][i] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    seated = ranked.select(*names, F.col("rank").cast("long")).mapInArrow(seat, f"{schema}, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).select(
        *names, (F.lit(n_short) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return seated.union(full)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         node_budget: int = NODE_BUDGET, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id,
    offset."""
    return place(written(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "packing-pieces"),
                 capacity, node_budget)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer())
