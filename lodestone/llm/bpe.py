"""Byte-level BPE by Spark's higher-order functions.

Texts stay where they are read. Python cuts a chunk of them into pre-tokens and numbers the chunk's distinct words; Spark
folds the ranked merges once for each distinct word that is no token itself: `aggregate` over an array that starts as the word's
bytes, with a literal rank map from pairs to merged ids. The ids go back to the chunks that asked for them, whose texts, by now lists
of word numbers, become ids by lookup, and bytes again by concatenating the vocabulary's binary pieces. No
task holds more than one chunk and its words; nothing is broadcast but the rank map, whose size the vocabulary fixes. The
chunks that ask for one word are listed LISTED at most to a row: a word of more chunks is folded once for each list.

Defined results: null and empty texts have no ids. Texts of any length are encoded whole; a long word is folded in parts, cut
where two bytes meet that no token holds side by side, so that no merge can cross. A fold over an array takes quadratic time: only
parts of more than FOLD_BYTES bytes without such a place are merged by a heap, with the same ranks. Repeated rows are
encoded alike; ties between equal ranks go to the leftmost pair. An empty table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, sliced, texts_of

#: Bytes of text whose words are numbered together.
CHUNK_BYTES = 64 << 20
#: Bytes of text split at once.
SLICE = 12 << 20
#: Chunks listed in one row for a word, about.
LISTED = 1024
FOLD_BYTES = 8192
#: Words up to so many characters aren't looked at for places to cut.
SHORT = 64
#: More than any id, and more than any number of words in a chunk; powers of two.
WIDE, WORDS = 1 << 20, 1 << 26
#: A rank beyond all others.
NONE = WIDE
POSITIVE = (1 << 63) - 1
_BITS = WIDE.bit_length() - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Ids of two adjacent tokens: the id of what they make."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                pairs[a, b] = rank
    return pairs


def merge(word: bytes, ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The word's ids: the lowest rank first, the leftmost of equal ones. A heap, for very long words."""
    ids = [ranks[bytes([b])] for b in word]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    alive = [True] * len(ids)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else len(ids)
        if j >= len(ids) or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = rank, False, after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < len(ids) and (r := pairs.get((ids[left], ids[right]))) is not None:
                heapq.heappush(heap, (r, left, ids[left], ids[right]))
    return [x for x, ok in zip(ids, alive, strict=True) if ok]


#: Where no two white-space characters meet, the pre-tokens of what lies between line ends and single spaces, each
#: space with what follows it, don't depend on each other.
_MEETING = regex.compile(r"\s\s")


def two_choices(pairs: dict[tuple[int, int], int]) -> list[int]:
    """A table in which each pair's entry, a * WIDE^2 + b * WIDE + rank, lies in one of its two slots; -1 where there is none."""
    size = 1 << max(4, (2 * len(pairs)).bit_length())
    table, spins = [-1] * size, 0
    for (a, b), rank in pairs.items():
        entry, slot = (a * WIDE + b) * WIDE + rank, slots(a, b, size)[0]
        while entry >= 0:
            entry, table[slot] = table[slot], entry
            if entry >= 0:
                # The one that lay there goes to its other slot.
                slot = sum(slots(entry // WIDE // WIDE, entry // WIDE % WIDE, size)) - slot
                spins += 1
                if spins > 20 * size:
                    raise ValueError("ranks can't be laid out")
    return table


def slots(a: int, b: int, size: int) -> tuple[int, int]:
    return (a * 40503 + b * 30103) % size, (a * 2654435761 + b * 2246822519) // 4096 % size


def fold(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a binary column's words, by ranked merges over arrays."""
    table = two_choices(pair_ranks(ranks))
    # Foldable, so that Catalyst makes one literal of it; looked up by position, as a map's lookup in Spark is linear.
    rank_map = F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<bigint>")
    of_byte = F.from_json(F.lit(json.dumps([ranks[bytes([b])] for b in range(256)])), "array<bigint>")

    # Bound to a lambda's variable, so that the plan holds the literal once.
    return bound(rank_map, lambda m: _folded(word, of_byte, m, len(table)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _folded(word: Column, of_byte: Column, rank_map: Column, size: int) -> Column:
    """The fold's state is one number for each token: the rank of the pair that it makes with the next one, and its id."""

    def entry(a: Column, b: Column) -> Column:
        """a's number before b, which may be null. A slot less its pair, in the upper bits, is the rank, and large for any other pair."""
        pair = F.shiftleft(a, _BITS) + b
        first = F.get(rank_map, (a * 40503 + b * 30103).bitwiseAND(size - 1).cast("int"))
        second = F.get(rank_map, F.shiftright(a * 2654435761 + b * 2246822519, 12).bitwiseAND(size - 1).cast("int"))
        ranked = [x.bitwiseXOR(F.shiftleft(pair, _BITS)).bitwiseAND(POSITIVE) for x in (first, second)]
        return F.shiftleft(F.least(*ranked, F.lit(NONE)), _BITS) + a

    def id_at(state: Column, at: Column) -> Column:
        return F.get(state, at).bitwiseAND(WIDE - 1)

    ids = F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), lambda c: F.get(of_byte, F.ascii(c)))
    start = bound(ids, lambda x: F.transform(x, lambda a, i: entry(a, F.get(x, i + 1))))

    def step(state: Column, _: Column) -> Column:
        # The least rank and its first place in one number, as array_position costs more than all else.
        least = F.array_min(F.transform(state, lambda x, i: x.bitwiseAND(-WIDE) + i))
        return bound(least, lambda x: F.when(x >= NONE * WIDE, state).otherwise(merged(state, F.shiftright(x, _BITS), x.bitwiseAND(WIDE - 1).cast("int"))))

    def merged(state: Column, low: Column, at: Column) -> Column:
        # The second token of the pair goes, the first becomes both, and the one before gets another neighbour.
        made = lambda i: F.when(i == at, entry(low, id_at(state, at + 2))).otherwise(entry(id_at(state, at - 1), low))
        return F.transform(F.filter(state, lambda _, i: i != at + 1), lambda x, i: F.when((i > at) | (i < at - 1), x).otherwise(made(i)))

    done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1))), start, step)
    return F.transform(done, lambda x: x.bitwiseAND(WIDE - 1).cast("int"))


def inner_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256: whether two bytes stand side by side in some token."""
    held = np.zeros((256, 256), dtype=bool)
    for token in ranks:
        raw = np.frombuffer(token, np.uint8)
        held[raw[:-1], raw[1:]] = True
    return held


def parts_of(word: bytes, held: np.ndarray) -> list[bytes]:
    """The word cut wherever no token can lie on both sides."""
    raw = np.frombuffer(word, np.uint8)
    cuts = [0, *(np.flatnonzero(~held[raw[:-1], raw[1:]]) + 1).tolist(), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _packed(columns: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


class _Chunk:
    """Texts as numbers of distinct words."""

    def __init__(self, number: int, held: np.ndarray, rx: "regex.Pattern"):
        self.number, self.held, self.rx = number, held, rx
        self.words: dict[str | bytes, int] = {}
        self.known: dict[str, list[int]] = {}
        self.doc_ids: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.texts: list[np.ndarray] = []
        self.size = 0

    def numbers(self, text: str) -> list[int]:
        """The words of a text, or of a stretch of one."""
        words = self.words
        found = self.rx.findall(text)
        if len(text) <= SHORT:
            return [words.setdefault(w, len(words)) for w in found]
        out = []
        for w in found:
            if len(w) <= SHORT:
                out.append(words.setdefault(w, len(words)))
            else:
                out += [words.setdefault(x, len(words)) for x in parts_of(w.encode(), self.held)]
        return out

    def add(self, doc_ids: list[int | None], texts: list[str]) -> None:
        """Arrow splits the texts into stretches and numbers the distinct ones, so that Python sees each of these once."""
        odd = [i for i, t in enumerate(texts) if _MEETING.search(t) or "\0" in t]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        marked = pc.replace_substring(pc.replace_substring(pa.array(plain, pa.large_string()), " ", "\0 "), "\n", "\0\n\0")
        cut = pc.split_pattern(marked, "\0")
        coded = cut.flatten().dictionary_encode()
        known, found = self.known, []
        for s in coded.dictionary.to_pylist():
            own = known.get(s)
            if own is None:
                own = self.numbers(s)
                if len(s) < SHORT:
                    known[s] = own
            found.append(own)
        places = np.asarray(cut.offsets) - cut.offsets[0].as_py()
        indices = np.asarray(coded.indices)
        for i in odd:
            found.append(self.numbers(texts[i]))
        if odd:
            # A text that isn't split is a stretch of its own, in the place of its empty one.
            indices = indices.copy()
            indices[places[np.array(odd)]] = len(coded.dictionary) + np.arange(len(odd))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum()))
        numbers = flat[_ranges((np.cumsum(sizes) - sizes)[indices], sizes[indices])]
        ends = np.concatenate([[0], np.cumsum(sizes[indices])])[places]
        self.counts.append(np.diff(ends))
        self.texts.append(numbers)
        self.doc_ids += doc_ids
        self.size += sum(map(len, texts))
        if len(known) > 300_000:
            known.clear()

    def row(self) -> pa.RecordBatch:
        numbers = np.concatenate(self.texts)
        # Bytes of like weight together: the upper ones are few.
        planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
        raw = [w if isinstance(w, bytes) else w.encode() for w in self.words]
        lengths = np.fromiter(map(len, raw), "<u4", len(raw))
        words = _packed([np.array([len(lengths)], "<u4"), lengths, np.frombuffer(b"".join(raw), np.uint8)])
        columns = [pa.array([self.number]), pa.array([self.doc_ids], pa.list_(pa.int64())), pa.array([np.concatenate(self.counts)], pa.list_(pa.int64())), pa.array([_packed([planes])]), pa.array([words])]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_ids", "counts", "numbers", "words"])


def _words(packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def joined(planes: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Numbers start to stop of those whose bytes lie in four planes; never all at once, as a chunk's take as much as its texts."""
    return np.ascontiguousarray(planes[:, start:stop].T).view("<u4").ravel()


def chunks_of(docs: DataFrame, pattern: str, held: np.ndarray, size: int = CHUNK_BYTES) -> DataFrame:
    """chunk, doc_ids, counts, numbers, words: a row for about every size characters of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 16
        rx = regex.compile(pattern)
        chunk = _Chunk(first, held, rx)
        for batch in sliced(batches, 4000, SLICE):
            chunk.add(batch.column("doc_id").to_pylist(), texts_of(batch))
            if chunk.size >= size:
                yield chunk.row()
                chunk = _Chunk(chunk.number + 1, held, rx)
        if chunk.doc_ids:
            yield chunk.row()

    return documents(docs).mapInArrow(run, "chunk long, doc_ids array<long>, counts array<long>, numbers binary, words binary")


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep_ids: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids array<int>."""
    spark = docs.sparkSession
    pairs = pair_ranks(ranks)
    # Tokens that their own merges lead to: such a word needs no fold.
    whole = {t for t, r in ranks.items() if merge(t, ranks, pairs) == [r]}
    total = documents(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Partitions are joined where they are, so that words are numbered over a whole chunk.
    few = max(-(-total // chunk_bytes), spark.sparkContext.defaultParallelism)
    chunks = chunks_of(docs.coalesce(few), pattern, inner_pairs(ranks), chunk_bytes)
    dealt = chunks.repartition(max(few, int(spark.conf.get("spark.sql.shuffle.partitions"))), "chunk")
    lists = 1 + few // LISTED

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            chunk = batch.column("chunk")[0].as_py()
            wanted = [(w, n) for n, w in enumerate(_words(batch.column("words")[0].as_py())) if w not in whole and len(w) <= FOLD_BYTES]
            for at in range(0, len(wanted), 20_000):
                part = wanted[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([chunk * WORDS + n for _, n in part], pa.int64())], names=["word", "place"])

    words = dealt.mapInArrow(list_words, "word binary, place long")
    salt = F.pmod(F.xxhash64(F.floor(F.col("place") / WORDS)), F.lit(lists)) if lists > 1 else F.lit(0)
    merged = words.groupBy("word", salt.alias("list")).agg(F.collect_list("place").alias("places")).select("places", fold(F.col("word"), ranks).alias("ids"))
    answers = merged.select(F.explode("places").alias("place"), "ids").select(F.shiftright("place", WORDS.bit_length() - 1).alias("chunk"), F.col("place").bitwiseAND(WORDS - 1).cast("int").alias("n"), "ids")
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    by_rank = sorted(ranks, key=ranks.__getitem__)

    def encode(rows: pa.Table, found: pa.Table) -> Iterator[pa.RecordBatch]:
        pieces, begins = np.frombuffer(b"".join(by_rank), np.uint8), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        found = found.combine_chunks()
        own = found.column("ids").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int32()))
        asked, ends = found.column("n").to_numpy(), np.asarray(own.offsets, dtype=np.int64)
        for chunk, doc_ids, counts, numbers, packed in zip(*(rows.column(c).to_pylist() for c in ("chunk", "doc_ids", "counts", "numbers", "words")), strict=True):
            names = _words(packed)
            single = np.fromiter((ranks[w] if w in whole else -1 for w in names), np.int64, len(names))
            start, size = np.zeros(len(names), np.int64), np.full(len(names), -1, np.int64)
            tokens = [np.asarray(own.values).astype("<u4")]
            at = len(tokens[0])
            start[asked], size[asked] = ends[:-1], np.diff(ends)
            mine = np.flatnonzero(single >= 0)
            start[mine], size[mine] = at + np.arange(len(mine)), 1
            tokens.append(single[mine].astype("<u4"))
            at += len(mine)
            for n in np.flatnonzero(size < 0).tolist():
                if len(names[n]) <= FOLD_BYTES:
                    raise KeyError(f"a word of chunk {chunk} is missing: {names[n]!r}")
                tokens.append(np.array(merge(names[n], ranks, pairs), dtype="<u4"))
                start[n], size[n] = at, len(tokens[-1])
                at += size[n]
            book = np.concatenate(tokens)
            del names, tokens, single, mine
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(numbers), np.uint8).reshape(4, -1)
            bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tolist()
            out: list[tuple] = []
            for doc_id, a, b in zip(doc_ids, bounds, bounds[1:], strict=False):
                ids, decoded, text = hashlib.sha256(), hashlib.sha256(), []
                n = 0
                # A long text goes piece by piece.
                for i in range(a, b, 1 << 18):
                    part = joined(planes, i, min(b, i + (1 << 18)))
                    these = book[_ranges(start[part], size[part])]
                    n += len(these)
                    ids.update(these.tobytes())
                    decoded.update(pieces[_ranges(begins[these], lengths[these])].tobytes())
                    if keep_ids:
                        text.append(these.astype(np.int32))
                out.append((doc_id, n, ids.hexdigest(), decoded.hexdigest(), *([np.concatenate([*text, np.empty(0, np.int32)])] * keep_ids)))
                if len(out) == 500:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)
    encoded = lambda rows, found: pa.Table.from_batches(list(encode(rows, found)), schema=schema)
    types = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(encoded, types)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
