"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens: its documents, each cut freely. Its target proportion is what the caller asks for, or its share
of all tokens; when queues run dry, the others' proportions grow alike, so that every token is packed. A
window of SEQUENCE tokens is filled in rounds over the queues: each queue's deficit grows by its share of a window, whole
tokens of the deficit are taken, and what is left of it is carried to the next window. Windows come in regions of REGION;
a region's slice of every queue follows from the totals alone, and its deficits at the start are those carried over from
the region before. So any task can replay the schedule of the regions its documents fall in, and documents are
placed where they are: no queue is gathered anywhere and no tokens are shuffled. As queues drift apart in a large corpus, a task
takes its documents by region and replays their regions side by side, each of them once. What a region has beyond full windows goes to sequences
whose lengths are powers of two, which take no padding.

Defined results: a null or empty text is its end token alone; a null source is the source ''. Of more than MAX_QUEUES sources
the largest, and those with a target, have queues of their own, the others share SHARED queues by a hash. Rows with equal doc_id are documents of their own. Documents of any length are cut, never dropped.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SLICE_BYTES, sliced, texts_of, written

SEQUENCE = 2048
REGION = 256
SPARE = 12
#: Queues that any task can hold the schedule of.
MAX_QUEUES, SHARED = 1024, 64
END_ID = 1
#: Offsets of blocks in queues are broadcast up to so many rows, about 50 bytes each; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
CACHED_STRETCHES = 1_200_000
#: Letters below this are their own NFC and have one lower case.
LATIN = 0x250
#: Regions times queues that a task replays at once and keeps; lists of cuts of a queue in a region that it keeps.
KEPT_CELLS = 1 << 13
KEPT_CUTS = 256
#: Bytes of tokens, and documents, that a task places at once, by region.
PLACED_BYTES, PLACED_ROWS = 16 << 20, 8192

_state: dict = {}


class Encoder:
    """Token ids by a cache of stretches without white space. The tokenizer drops white space, ignores case and never joins
    letters or digits to a run of punctuation behind them. So Arrow lower-cases the texts, parts what ends in ASCII
    punctuation from it, splits the texts and numbers their distinct stretches: one entry stands for a word in all its
    forms. Texts with characters beyond LATIN keep their case, as lower case and Unicode's NFC may not go together there.
    New words of LATIN letters are encoded many at a time, told apart by the tokens that end a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix
        size = self.tokenizer.get_vocab_size()
        self.ending = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.known: dict[str, bytes] = {}

    def _one(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        """Ids of new words of LATIN letters, of which each is one token sequence up to a token that ends a word."""
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u2")
            ends = (2 * np.flatnonzero(self.ending[ids]) + 2).tolist()
            if len(ends) != len(part):
                self._learn_others(part)
                continue
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def _learn_others(self, stretches: list[str]) -> None:
        """Ids of new stretches of any kind: many at a time, told apart by the offsets of their tokens."""
        for at in range(0, len(stretches), 2000):
            part = stretches[at : at + 2000]
            encoding = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            raw = np.asarray(encoding.ids, dtype="<u2").tobytes()
            first = np.cumsum([0] + [len(w) + 1 for w in part])
            cuts = np.searchsorted(np.array([x for x, _ in encoding.offsets], dtype=np.int64), first).tolist()
            for w, start, stop in zip(part, cuts, cuts[1:], strict=False):
                self.known[w] = raw[2 * start : 2 * stop]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 16-bit integers. Python sees each distinct stretch once."""
        known = self.known
        if len(known) > CACHED_STRETCHES:
            known.clear()
        odd = {i for i, t in enumerate(texts) if _SEPARATORS.search(t)}
        wide = [bool(_WIDE.search(t)) for t in texts]
        whole = pa.array([t if i not in odd else "" for i, t in enumerate(texts)], pa.large_string())
        lower = pc.utf8_lower(whole)
        if any(wide):
            lower = pc.if_else(pa.array(wide), whole, lower)
        cut = pc.utf8_split_whitespace(pc.replace_substring_regex(lower, _MARKS, r"\1 \2"))
        coded = cut.flatten().dictionary_encode()
        stretches = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known[""] = b""
        words, others = [], []
        for w in stretches:
            if w not in known:
                (words if w.isalpha() and len(w) < 100 and (w.isascii() or not _WIDE.search(w)) else others).append(w)
        self._learn_words(words)
        self._learn_others(others)
        ids = pa.array([known[w] for w in stretches], pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], "<i8")[ids.offset :] if len(ids) else np.zeros(1, "<i8")
        bounds = ends[np.asarray(cut.offsets) - cut.offsets[0].as_py()].tolist()
        raw = memoryview(ids.buffers()[2] or b"") if len(ids) else memoryview(b"")
        out = [self._one(texts[i]) if i in odd else bytes(raw[a:b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
        for w in others:
            if len(w) > 100:
                del known[w]
        return out


#: Python takes these for white space, Unicode's White_Space property doesn't; and what the tokenizer's special tokens begin
#: with, as they are found by case and with punctuation. Such texts are encoded whole.
_SEPARATORS = re.compile(r"[\x1c-\x1f]|<\|")
#: Beyond LATIN, and the one letter below whose lower case is two characters.
_WIDE = re.compile(f"[\u0130{chr(LATIN)}-\U0010ffff]")
#: ASCII punctuation behind a LATIN letter or digit, up to white space or the end. Beyond, NFC and lower case may end letters in marks.
_MARKS = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([[:punct:]]+(?:\s|$))"


class Schedule:
    """The windows of a corpus whose queues hold totals tokens. targets: weights of the queues, their totals if None; a
    queue of weight 0 follows when the others are dry."""

    def __init__(self, totals: list[int], targets: list[float] | None = None):
        self.totals = totals
        self.tokens = sum(totals)
        self.windows = -(-self.tokens // SEQUENCE)
        self.regions = -(-self.windows // REGION)
        self._kept: OrderedDict = OrderedDict()
        self._cuts: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        self.at_once = max(1, KEPT_CELLS // max(1, len(totals)))
        # Spans between which the same queues have tokens: (tokens before, tokens of each queue before, shares).
        self.spans: list[tuple[float, list[float], list[float]]] = []
        weights = [float(t) for t in (targets or totals)]
        at, taken = 0.0, [0.0] * len(totals)
        while True:
            alive = [q for q, t in enumerate(totals) if t > taken[q]]
            if not alive:
                break
            if not sum(weights[q] for q in alive):
                weights = [float(t) for t in totals]
            whole = sum(weights[q] for q in alive)
            share = [weights[q] / whole if t > taken[q] else 0.0 for q, t in enumerate(totals)]
            self.spans.append((at, list(taken), share))
            # Until the first of them is dry; those within a token of it are dry too.
            length = min((totals[q] - taken[q]) / share[q] for q in alive if share[q])
            at += length
            taken = [float(t) if t - x - length * s < 0.5 else x + length * s for t, x, s in zip(totals, taken, share, strict=True)]
        self._starts = [x[0] for x in self.spans]

    def span(self, region: int) -> tuple[float, list[float], list[float]]:
        return self.spans[bisect_right(self._starts, region * REGION * SEQUENCE) - 1]

    def ideal(self, queue: int, region: int) -> float:
        """Tokens of the queue before the region, fractions included."""
        at, taken, share = self.span(region)
        return min(float(self.totals[queue]), taken[queue] + (region * REGION * SEQUENCE - at) * share[queue])

    def bound(self, queue: int, region: int) -> int:
        """Tokens of the queue before the region."""
        return self.totals[queue] if region >= self.regions else int(self.ideal(queue, region))

    def region_of(self, queue: int, position: int) -> int:
        if len(self.spans) > 1:
            return bisect_right(range(1, self.regions), position, key=lambda r: self.bound(queue, r))
        # With one span bounds are multiples of a share, but for fractions of tokens.
        region = min(self.regions - 1, int(position / self.spans[0][2][queue]) // (REGION * SEQUENCE))
        while region and self.bound(queue, region) > position:
            region -= 1
        while region < self.regions - 1 and self.bound(queue, region + 1) <= position:
            region += 1
        return region

    def prepare(self, numbers: list[int]) -> None:
        """Replays the regions that aren't kept, all of them side by side: window by window, in arrays of regions and queues."""
        todo = [r for r in numbers if r not in self._kept]
        for r in numbers:
            if r in self._kept:
                self._kept.move_to_end(r)
        if not todo:
            return
        queues = range(len(self.totals))
        at = np.array([[self.bound(q, r) for q in queues] for r in todo], dtype=np.int64)
        left = np.array([[self.bound(q, r + 1) for q in queues] for r in todo], dtype=np.int64) - at
        share = np.array([self.span(r)[2] for r in todo])
        deficit = np.array([[self.ideal(q, r) for q in queues] for r in todo]) - at
        sizes = [[SEQUENCE] * (n // SEQUENCE) + [1 << b for b in range(SEQUENCE.bit_length() - 1, -1, -1) if (n % SEQUENCE) >> b & 1] for n in left.sum(axis=1).tolist()]
        windows = max(map(len, sizes))
        lengths = np.array([x + [0] * (windows - len(x)) for x in sizes], dtype=np.int64)
        rows = np.arange(len(todo))
        # Queues take turns from another one in each region.
        turn = np.array(todo) % len(self.totals)
        behind = np.arange(len(self.totals)) < turn[:, None]

        def before(x: np.ndarray) -> np.ndarray:
            """Sums over the queues whose turn is earlier."""
            run = np.cumsum(x, axis=1)
            first = run - x
            return first - first[rows, turn][:, None] + behind * run[:, -1:]

        takes = np.zeros((len(todo), windows, len(self.totals)), dtype=np.int16)
        offsets = np.zeros_like(takes)
        for k in range(windows):
            deficit += share * lengths[:, k : k + 1]
            want = np.minimum(np.maximum(deficit, 0.0).astype(np.int64), left)
            take = np.minimum(want, np.maximum(lengths[:, k : k + 1] - before(want), 0))
            room = lengths[:, k] - take.sum(axis=1)
            if room.any():
                # Fractions of tokens: the queues that are owed most give one more; if queues run dry, others give all that is missing.
                owed = np.where(left > take, take - deficit, np.inf)
                rank = np.empty_like(take)
                np.put_along_axis(rank, np.argsort(owed, axis=1, kind="stable"), np.arange(len(self.totals))[None, :], axis=1)
                take += (rank < room[:, None]) & (left > take)
                room = lengths[:, k] - take.sum(axis=1)
                if room.any():
                    more = left - take
                    take += np.minimum(more, np.maximum(room[:, None] - before(more), 0))
            takes[:, k], offsets[:, k] = take, before(take)
            left -= take
            deficit -= take
        for i, r in enumerate(todo):
            self._kept[r] = (at[i], takes[i].copy(), offsets[i].copy())
        while len(self._kept) > max(len(numbers), self.at_once):
            self._kept.popitem(last=False)

    def cuts(self, queue: int, region: int) -> list[tuple[int, int, int, int]]:
        """The queue's cuts in the region: (position, length, sequence, offset)."""
        if (queue, region) not in self._cuts:
            self.prepare([region])
            at, takes, offsets = self._kept[region]
            some = np.flatnonzero(takes[:, queue])
            n = takes[some, queue].astype(np.int64)
            sequences = region * (REGION + SPARE + len(self.totals)) + some
            if len(self._cuts) >= KEPT_CUTS:
                self._cuts.clear()
            self._cuts[queue, region] = list(zip((at[queue] + np.cumsum(n) - n).tolist(), n.tolist(), sequences.tolist(), offsets[some, queue].tolist(), strict=True))
        return self._cuts[queue, region]

    def pieces(self, queue: int, position: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) of a document at a queue's position."""
        at, end = position, position + length
        while at < end:
            cuts = self.cuts(queue, self.region_of(queue, at))
            k = bisect_right(cuts, at, key=lambda c: c[0]) - 1
            while k < len(cuts) and at < end:
                start, size, sequence, offset = cuts[k]
                n = min(start + size, end) - at
                yield at - position, n, sequence, offset + at - start
                at += n
                k += 1

    def in_order(self, rows: list[tuple[int, int, int]]) -> Iterator[int]:
        """Numbers of the rows (queue, position, length) by region, so that each region is replayed once for them, wherever
        the queues are. Regions are prepared, as many as fit at once, before the first row that needs them."""
        first = [self.region_of(q, p) for q, p, _ in rows]
        some: list[int] = []
        wanted: set[int] = set()

        def ready() -> Iterator[int]:
            self.prepare(sorted(wanted))
            yield from some
            some.clear()
            wanted.clear()

        for i in sorted(range(len(rows)), key=lambda i: (first[i], rows[i])):
            queue, position, n = rows[i]
            last = min(first[i] + self.at_once - 1, self.region_of(queue, position + n - 1))
            if some and len(wanted.union(range(first[i], last + 1))) > self.at_once:
                yield from ready()
            wanted.update(range(first[i], last + 1))
            some.append(i)
        yield from ready()


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """A written table: doc_id, queue, block, at (tokens of the queue before, in this block), n, ids (16-bit, with the end id)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"), F.spark_partition_id().cast("long").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _state:
            _state[path] = Encoder(path)
        at: dict[str, int] = {}
        for batch in sliced(batches, 2000, 2 * SLICE_BYTES):
            ids = [x + END_ID.to_bytes(2, "little") for x in _state[path](texts_of(batch))]
            places = []
            for queue, x in zip(batch.column("queue").to_pylist(), ids, strict=True):
                places.append(at.get(queue, 0))
                at[queue] = places[-1] + len(x) // 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("queue"), batch.column("block"), pa.array(places, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "queue", "block", "at", "n", "ids"])

    return written(rows.mapInArrow(run, "doc_id long, queue string, block long, at long, n long, ids binary"), "tokens")


def pack(docs: DataFrame, path: str, keep_ids: bool = False, targets: dict[str, float] | None = None) -> DataFrame:
    """targets: weights of sources in each window; sources that aren't named have none and come last. doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids: a row for each piece."""
    tokens = tokenized(docs, path)
    sizes = written(tokens.groupBy("queue", "block").agg(F.sum("n").alias("size")), "queue-sizes")
    largest = sizes.groupBy("queue").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "queue").limit(MAX_QUEUES + 1).collect()
    lane = F.concat(F.lit("own "), "queue")
    if len(largest) > MAX_QUEUES:
        own = sorted({r["queue"] for r in largest[: MAX_QUEUES - SHARED]} | set(targets or ()))
        lane = F.when(F.col("queue").isin(own), lane).otherwise(F.concat(F.lit("shared "), F.pmod(F.xxhash64("queue"), F.lit(SHARED)).cast("string")))
    before = F.sum("size").over(W.partitionBy("lane").orderBy("block", "queue").rowsBetween(W.unboundedPreceding, -1))
    offsets = written(sizes.withColumn("lane", lane).withColumn("before", F.coalesce(before, F.lit(0))).select("lane", "queue", "block", "before"), "queue-offsets")
    # At most MAX_QUEUES rows, and as many as there are targets.
    lanes = sorted((r["lane"], r["size"]) for r in sizes.groupBy(lane.alias("lane")).agg(F.sum("size").alias("size")).collect())
    names, totals = {name: i for i, (name, _) in enumerate(lanes)}, [size for _, size in lanes]
    weights = [(targets.get(name[4:], 0.0) if name.startswith("own ") else 0.0) for name, _ in lanes] if targets else None
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, ["queue", "block"]).select("doc_id", "lane", (F.col("before") + F.col("at")).alias("position"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(totals, weights)

        def place(docs: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for i in schedule.in_order([(names[lane], position, n) for _, lane, position, n, _ in docs]):
                doc_id, lane, position, n, raw = docs[i]
                ids = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                for start, size, sequence, offset in schedule.pieces(names[lane], position, n):
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append((doc_id, start, size, zlib.crc32(part), n, sequence, offset, *([np.frombuffer(part, "<i4")] * keep_ids)))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        held: list[tuple] = []
        size = 0
        for batch in sliced(batches):
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            size += batch.nbytes
            if size >= PLACED_BYTES or len(held) >= PLACED_ROWS:
                yield from place(held)
                held, size = [], 0
        yield from place(held)

    names_out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = pa.schema([(c, pa.int64()) for c in names_out] + [("ids", pa.list_(pa.int32()))] * keep_ids)
    return placed.mapInArrow(run, ", ".join(f"{c} long" for c in names_out) + ", ids array<int>" * keep_ids)
