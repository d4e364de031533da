"""Removal of repeated passages by suffix arrays.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. Strings are dealt by their minimizer, the
GRAM bytes of least hash inside them: equal strings have equal minimizers at equal places, so all starts of a string meet
under one key. Starts whose minimizer lies at one place form a stretch of a text; only stretches with a minimizer that
occurs at least twice are kept, equal stretches are one with a count, and stretches of one minimizer, but for those that another
one holds whole, are sorted by a suffix array: neighbours that agree over `length` bytes are repeats.

The suffix array comes by linear grouping: suffixes are grouped by their longest Lyndon prefix, groups are processed in
descending order, previous-smaller pointers carry each group's refinement to the suffixes before it, and the order inside the groups
is then emitted in one ascending pass, without renaming ranks or recursion.

A minimizer whose stretches exceed GROUP_BYTES isn't sorted in one task: its strings are compared by 128-bit hashes,
counted by Spark, whatever their number. Nothing is sampled or capped.

Defined results: a null or empty text has no bytes and keeps none; texts shorter than `length` stay whole; repeated rows are each
other's repeats, whether doc_ids are equal, null or not; an empty table gives an empty result.

The pipeline's length is in words: `without_passages` cuts passages of WORDS words that occur elsewhere too, whatever white
space is between the words, and `length` bytes in fewer words. A text's words become codes of CODE bytes, over which the
same search runs with a code as its symbol; strings of bytes with more words inside them are left to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, sliced, written

LENGTH = 400
#: The words of a passage that the pipeline cuts: over 50.
WORDS = 51
#: Bytes of a word's hash: two words with one code would have to stand in passages that are equal otherwise.
CODE = 6
GRAM = 64
#: Codes of a minimizer over words.
WORD_GRAM = 8
GROUP_BYTES = 4 << 20
SORT_BYTES = 64 << 10
#: Clips that may hold another one whole, of those of a minimizer.
NEIGHBOURS = 256
#: Bytes of stretches of which a task keeps one for its copies, before it passes them on.
KEPT_BYTES = 4 << 20
#: Bytes of text whose minimizers are computed at once; places in it take 24 bits.
PIECE = 2 << 20
_PLACE = 24
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Scripts without spaces, from Thai to Han: a character of theirs is a word.
_SCRIPTS = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
_LETTER, _SPACE, _WHOLE = 0, 1, 2
#: Longest text whose powers are kept.
KEPT_POWERS = 1 << 17
_made: dict[str, np.ndarray] = {}
_NONE = (np.zeros(0, dtype=np.int64),) * 2


def _kinds() -> np.ndarray:
    """What each code point is; the last entry stands for all beyond."""
    out = np.zeros(0x40001, dtype=np.uint8)
    out[[c for c in range(0x4000) if chr(c).isspace()]] = _SPACE
    for low, high in _SCRIPTS:
        out[low : high + 1] = _WHOLE
    return out


_KINDS = _kinds()
_BYTE_KINDS = np.where(np.arange(256) < 0x80, _KINDS[:256], _LETTER).astype(np.uint8)


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order. Values: integers of 0 or more; any number of them."""
    size = len(text) + 1
    symbols = sorted(set(text))
    number = {c: g + 1 for g, c in enumerate(symbols)}
    # Groups by first symbol, the end mark's lowest; below and over link them in order, members ascend by place.
    group = [number[c] for c in text]
    group.append(0)
    members: list[list[int]] = [[] for _ in range(len(symbols) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    below, over = list(range(-1, len(symbols))), list(range(1, len(symbols) + 2))
    previous, done = [-1] * size, bytearray(size)
    groups: list[list[int]] = []
    top = len(symbols)
    while top >= 0:
        own = [i for i in members[top] if group[i] == top]
        for i in own:
            done[i] = 1
        count: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if len(count) == 1:
            split = {(group[p], k): [p] for p, k in count.items()}
        else:
            split = {}
            for p, k in count.items():
                split.setdefault((group[p], k), []).append(p)
        # Of a group's suffixes those that this group follows are the greater ones, the more so the more often it does.
        for g, k in sorted(split, reverse=True) if len(split) > 1 else split:
            found = split[g, k]
            new = len(members)
            for p in found:
                group[p] = new
            members.append(sorted(found) if len(found) > 1 else found)
            up = over[g]
            below.append(g)
            over.append(up)
            over[g] = new
            if up < len(below) - 1:
                below[up] = new
        groups.append(own)
        top = below[top]
    # Suffixes of one Lyndon prefix are ordered as what follows it: whoever a suffix ends comes next in its group.
    at, first = [0] * size, 0
    for own in reversed(groups):
        for i in own:
            at[i] = first
        first += len(own)
    order = [-1] * size
    order[0] = size - 1
    placed = bytearray(size)
    placed[size - 1] = 1
    filled = [0] * size
    for r in range(size):
        p = order[r] - 1
        while p >= 0 and not placed[p]:
            g = at[p]
            order[g + filled[g]] = p
            filled[g] += 1
            placed[p] = 1
            p = previous[p]
    return order[1:]


def repeats(strings: list[bytes], length: int, width: int = 1) -> list[np.ndarray]:
    """For each string, whether the `length` symbols from each of its places occur elsewhere in the strings (places near the
    end, with fewer symbols, never do). A symbol is `width` bytes."""
    text: list[int] = []
    starts, sizes = [], [len(x) // width for x in strings]
    number: dict[bytes, int] = {}
    for x in strings:
        starts.append(len(text))
        text += [b + 1 for b in x] if width == 1 else [number.setdefault(x[i : i + width], len(number) + 1) for i in range(0, len(x), width)]
        text.append(0)
    stop = bytes(width)
    raw = stop.join(strings) + stop
    order = suffix_array(text)
    ends = np.repeat(np.array(starts) + sizes, [n + 1 for n in sizes])
    order = [i for i in order if i + length <= ends[i]]
    found = np.zeros(len(text), dtype=bool)
    # Only suffixes with `length` symbols are left; those between two with equal beginnings begin alike.
    for a, b in zip(order, order[1:], strict=False):
        if raw[a * width : (a + length) * width] == raw[b * width : (b + length) * width]:
            found[a] = found[b] = True
    return [found[a : a + n] for a, n in zip(starts, sizes, strict=True)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def _symbols(data: bytes, width: int) -> np.ndarray:
    """A number for each symbol of width bytes."""
    if width == 1:
        return _BYTES[np.frombuffer(data, np.uint8)]
    padded = np.zeros((len(data) // width, 8), dtype=np.uint8)
    padded[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return _mixed(padded.view(np.uint64).ravel())


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of _BASE and of its inverse; those for texts of usual length are kept."""
    if size <= len(_made.get("powers", ())):
        return _made["powers"], _made["inverses"]
    both = []
    for base in (_BASE, _INVERSE):
        powers = np.full(max(size, 1 << 13) + size // 8, _U(base))
        powers[0] = 1
        both.append(np.multiply.accumulate(powers, out=powers))
    if size <= KEPT_POWERS:
        _made["powers"], _made["inverses"] = both
    return both[0], both[1]


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial over the symbols, from 0; data is overwritten."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    data *= _powers(len(data))[0][: len(data)]
    np.cumsum(data, out=out[1:])
    return out


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width symbols from each place: differences of running sums, taken back to the first power. data is overwritten."""
    sums = _sums(data)
    out = sums[width:] - sums[:-width]
    out *= _powers(len(out))[1][: len(out)]
    # Low bits of the sums depend on low bits alone: the high ones, by which minima are found, get more of them.
    out ^= out >> _U(32)
    out *= _U(0xD6E8FEB86659FD93)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima over width neighbours, by doubling."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last. A word is a run of characters that are neither white space nor of
    a script without spaces, or one character of such a script."""
    raw = text.encode()
    # Below U+0800 are no scripts without spaces, and beyond ASCII two white spaces: words are runs of bytes.
    if text.isascii() or (np.frombuffer(raw, np.uint8).max() < 0xE0 and b"\xc2\x85" not in raw and b"\xc2\xa0" not in raw):
        space = np.ones(len(raw) + 2, dtype=bool)
        np.equal(_BYTE_KINDS[np.frombuffer(raw, np.uint8)], _SPACE, out=space[1:-1])
        edges = np.flatnonzero(space[1:] != space[:-1])
        return edges[::2], edges[1::2]
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _KINDS[np.minimum(points, len(_KINDS) - 1)]
    # A word starts, or ends, at either side of a letter run's edge, and around each whole word.
    edge, whole = kind[1:] != kind[:-1], kind == _WHOLE
    after = np.concatenate([[True], edge | whole[1:]])
    before = np.concatenate([edge | whole[1:], [True]])
    word = kind != _SPACE
    firsts, ends = np.flatnonzero(word & after[: len(kind)]), np.flatnonzero(word & before[len(before) - len(kind) :]) + 1
    at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
    return at[firsts], at[ends]


def word_codes(text: str) -> bytes:
    """The text's words as codes of CODE bytes each: of a polynomial over the word's bytes, from differences of running sums."""
    raw = text.encode()
    firsts, ends = word_places(text)
    out, i = [], 0
    while i < len(firsts):
        low = firsts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        sums = _sums(_BYTES[np.frombuffer(raw, np.uint8, ends[j - 1] - low, low)])
        a, b = firsts[i:j] - low, ends[i:j] - low
        codes = _mixed((sums[b] - sums[a]) * _powers(len(sums))[1][a])
        out.append(np.ascontiguousarray(codes).view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes())
        i = j
    return b"".join(out)


def few_words(text: str, length: int) -> np.ndarray:
    """For each start of a string, whether it has fewer than WORDS words between its first and its last byte. Equal strings
    have equally many of them, so that either all starts of a string count or none."""
    firsts, ends = word_places(text)
    size = len(text.encode())
    n = max(0, size - length + 1)
    # Words that end before a string's end, less those that start up to its first byte.
    ended = np.cumsum(np.bincount(ends, minlength=size + 1), dtype=np.int32)
    started = np.cumsum(np.bincount(firsts, minlength=size + 1), dtype=np.int32)
    return ended[length - 1 : length - 1 + n] - started[:n] < WORDS


def stretches(text: bytes, length: int, wanted: np.ndarray | None = None, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer hash, place of the minimizer, first and last start of each stretch of the text's strings; of the starts that
    are wanted, if not of all. Lengths and places are in bytes, at whole symbols of `width` bytes."""
    grams, places, firsts, lasts = [], [], [], []
    own_gram, length = GRAM if width == 1 else WORD_GRAM, length // width
    for at in range(0, len(text) // width - length + 1, PIECE):
        h = _hashes(_symbols(text[at * width : (at + PIECE + length - 1) * width], width), own_gram)
        ranked = h & _U(~((1 << _PLACE) - 1) & (1 << 64) - 1)
        ranked |= np.arange(len(h), dtype=np.uint64)
        q = (_least(ranked, length - own_gram + 1) & _U((1 << _PLACE) - 1)).astype(np.int64)
        edge = q[1:] != q[:-1]
        if wanted is not None:
            own = wanted[at : at + len(q)]
            edge |= own[1:] != own[:-1]
        first = np.concatenate([[0], np.flatnonzero(edge) + 1])
        last = np.concatenate([first[1:] - 1, [len(q) - 1]])
        if wanted is not None:
            first, last = first[own[first]], last[own[first]]
        grams.append(h[q[first]].view(np.int64))
        places.append((q[first] + at) * width)
        firsts.append((first + at) * width)
        lasts.append((last + at) * width)
    return tuple(np.concatenate(x) for x in (grams, places, firsts, lasts)) if grams else (np.zeros(0, np.int64),) * 4


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _agreement(parts: list[bytes]) -> list[int]:
    """Of each part, the longest beginning that another part shares: with a neighbour in sorted order."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        n = _common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def _containers(clips: list[tuple[int, bytes]]) -> list[int]:
    """For each clip (bytes before the minimizer, bytes), different from the others, the number of one that holds it whole with
    the minimizer at its place, or -1. Only clips that nothing is found to hold, at most NEIGHBOURS of the last ones by length, are looked at."""
    out = [-1] * len(clips)
    outer: list[int] = []
    for i in sorted(range(len(clips)), key=lambda i: -len(clips[i][1])):
        before, data = clips[i]
        for j in outer[-NEIGHBOURS:]:
            own, other = clips[j]
            if own >= before and other.startswith(data, own - before):
                out[i] = j
                break
        else:
            outer.append(i)
    return out


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int, width: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows (gram, key, copies, off, data), those of a gram one after another and among them those of a key:
    (gram, key, a, b) of starts a to b that repeat.

    Equal strings are equal to both sides of their minimizer. So what lies beyond the longest agreement to the left and to the
    right with any other stretch of the minimizer can't be in a repeat: stretches are clipped to it, and equal clips are
    one, before they are sorted. A clip that another one holds whole repeats, and so does its place in the other; it is
    not sorted again. Symbols have `width` bytes; clips end with whole ones."""
    rows: list[tuple] = []
    count = length // width
    names: list[bytes] = []
    times: list[int] = []
    # Clips to sort; of held ones, that they are; of their holders, the starts that are theirs.
    alone: list[int] = []
    held: set[int] = set()
    inner: dict[int, list[tuple[int, int]]] = {}
    size = 0

    def solve() -> pa.RecordBatch:
        # A clip without another one of its minimizer repeats as often as it occurs; it holds a string once at most.
        # Clips by their bytes alone: another minimizer's clips can't hold the same strings.
        marks = dict(zip(alone, repeats([names[k] for k in alone], count, width) if alone else (), strict=True))
        out: tuple[list, ...] = ([], [], [], [])
        for gram, key, copies, n, low, clip in rows:
            if copies > 1:
                runs = [(0, n - count + 1)]
            else:
                size = len(names[clip]) // width - count + 1
                if times[clip] > 1 or clip in held:
                    runs = [(low, low + size)]
                elif clip in marks or clip in inner:
                    mark = marks[clip][:size] if clip in marks else np.zeros(size, dtype=bool)
                    for a, b in inner.get(clip, ()):
                        mark[a:b] = True
                    runs = [(low + a, low + b) for a, b in zip(*(x.tolist() for x in _runs(mark)), strict=True)]
                else:
                    continue
            for a, b in runs:
                for column, value in zip(out, (gram, key, a * width, b * width), strict=True):
                    column.append(value)
        for x in (rows, names, times, alone, held, inner):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["gram", "key", "a", "b"])

    def settle(group: list[list]) -> int:
        if len(group) == 1:
            gram, key, copies, off, data = group[0]
            if copies > 1:
                rows.append((gram, key, copies, len(data) // width, 0, -1))
            return 0
        right = _agreement([data[off:] for *_, off, data in group])
        left = _agreement([data[:off][::-1] for *_, off, data in group])
        clips: dict[tuple[int, bytes], int] = {}
        first = len(names)
        for (gram, key, copies, off, data), r, l in zip(group, right, left, strict=True):
            clip = -1
            l, r = l - l % width, r - r % width
            if l + r >= length:
                name = (l, data[off - l : off + r])
                clip = clips.get(name, -1)
                if clip < 0:
                    clip = clips[name] = len(times)
                    times.append(0)
                    names.append(name[1])
                times[clip] += 1
            if clip >= 0 or copies > 1:
                rows.append((gram, key, copies, len(data) // width, (off - l) // width, clip))
        if len(clips) < 2:
            return 0
        every = list(clips)
        outer = []
        for i, j in enumerate(_containers(every)):
            if j < 0:
                outer.append(first + i)
                continue
            held.add(first + i)
            at = (every[j][0] - every[i][0]) // width
            inner.setdefault(first + j, []).append((at, at + len(every[i][1]) // width - count + 1))
        if len(outer) < 2:
            return 0
        alone.extend(outer)
        return sum(len(names[k]) for k in outer)

    group: list[list] = []
    for batch in sliced(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[0][0] != row[0]:
                size += settle(group)
                group = []
                if size >= SORT_BYTES or len(rows) >= 20_000:
                    yield solve()
                    size = 0
            if group and group[-1][1] == row[1]:
                group[-1][2] += row[2]
            else:
                group.append(list(row))
    if group:
        settle(group)
    yield solve()


def _by_hash(strings: DataFrame, length: int, width: int = 1) -> DataFrame:
    """The same for strings whose minimizer's group is too large for one task: every start's string is counted by a hash."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for gram, key, copies, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = range(0, len(data) - length + 1, width)
                n = len(at)
                marks = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([gram] * n, pa.int64()), pa.array([key] * n, pa.binary()), pa.array([copies] * n, pa.int64()), pa.array(at, pa.int32()), pa.array(marks, pa.binary())], names=["gram", "key", "copies", "a", "mark"])

    starts = written(strings.mapInArrow(hashed, "gram long, key binary, copies long, a int, mark binary"), "starts")
    twice = starts.groupBy("mark").agg(F.sum("copies").alias("n")).where("n > 1").select("mark")
    return starts.join(twice, "mark").select("gram", "key", "a", (F.col("a") + width).alias("b"))


class Search(NamedTuple):
    """Strings of `length` bytes of what `encoded` makes of a text, at whole symbols of `width` bytes; `wanted` tells which of
    its starts count."""

    length: int
    encoded: Callable[[str], bytes] = str.encode
    wanted: Callable[[str, int], np.ndarray] | None = None
    width: int = 1


BY_WORDS = Search(CODE * WORDS, encoded=word_codes, width=CODE)


def _keyed(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, text: rows with equal row_id are copies."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.withColumn("row_id", F.unhex(F.substring(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), "text"), 256), 1, 40)))


def find_repeats(docs: DataFrame, searches: list[Search]) -> tuple[DataFrame, DataFrame]:
    """Two written tables: rows (row_id, doc_id, n_bytes, sha256) and spans (row_id, text and, for each search, starts0, starts1,
    ... array<struct<a, b>> or null) for the rows with repeats. docs: doc_id, text. Starts are places in what `encoded` makes of a
    text. Texts are read and joined once for all searches; what is cut out of them is sorted for one search after another."""
    keyed = _keyed(docs)
    # Minimizers of different searches differ in their lowest bits.
    low = (1 << (len(searches) - 1).bit_length()) - 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                found = []
                for k, x in enumerate(searches):
                    gram, *rest = stretches(raw if x.encoded is str.encode else x.encoded(text), x.length, x.wanted and x.wanted(text, x.length), x.width)
                    found.append((gram & ~np.int64(low) | np.int64(k), *rest))
                for column, values in zip(columns, zip(*found, strict=True), strict=False):
                    column.append(np.concatenate(values))
                columns[4].append(len(raw))
                columns[5].append(hashlib.sha256(raw).hexdigest())
            lists = [pa.array(c, pa.list_(pa.int64() if i == 0 else pa.int32())) for i, c in enumerate(columns[:4])]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.string()), *lists], names=["row_id", "doc_id", "n_bytes", "sha256", "gram", "at", "first", "last"])

    scanned = written(keyed.select("row_id", "doc_id", "text").mapInArrow(scan, "row_id binary, doc_id long, n_bytes long, sha256 string, gram array<long>, at array<int>, first array<int>, last array<int>"), "scanned")
    places = scanned.select("row_id", F.explode(F.arrays_zip("gram", "at", "first", "last")).alias("x")).select("row_id", "x.*")
    common = written(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    held = places.join(common.hint("shuffle_hash"), "gram").groupBy("row_id").agg(F.collect_list(F.struct("gram", "at", "first", "last")).alias("places"))
    held = written(held, "held")
    rows = written(scanned.select("row_id", "doc_id", "n_bytes", "sha256"), "rows")
    forget(common, scanned)
    # Rows with equal row_id are copies: as many rows take part as there are.
    texts = written(keyed.join(held, "row_id").select("row_id", "text", "places"), "texts")
    forget(held)
    found = [_starts(texts, x, k, low) for k, x in enumerate(searches)]
    names = [f"starts{k}" for k in range(len(found))]
    every = [x.select("row_id", *((F.col("starts") if i == k else F.lit(None).cast(x.schema["starts"].dataType)).alias(c) for i, c in enumerate(names))) for k, x in enumerate(found)]
    merged = every[0] if len(every) == 1 else reduce(DataFrame.unionByName, every).groupBy("row_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in names))
    spans = written(texts.select("row_id", "text").join(merged, "row_id").dropDuplicates(["row_id"]), "spans")
    forget(texts, *found)
    return rows, spans


def _starts(texts: DataFrame, search: Search, number: int, low: int) -> DataFrame:
    """A written table: row_id, starts array<struct<a, b>> of the search's strings that repeat. texts: row_id, text, places."""
    length, encoded, _, width = search
    spark = texts.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row for each stretch's place in a text, and for each distinct stretch of the task one with its bytes and copies.
        kept: dict[bytes, list] = {}
        done: set[bytes] = set()
        size = 0

        def made(columns: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, piece, strict=True)], schema=piece)

        def distinct() -> pa.RecordBatch:
            columns: list[list] = [list(c) for c in zip(*kept.values(), strict=True)] or [[], [], [], []]
            out = made([columns[0], list(kept), [None] * len(kept), [None] * len(kept), *columns[1:]])
            kept.clear()
            return out

        for batch in sliced(batches):
            grams, keys, ids, starts = [], [], [], []
            places = batch.column("places")
            fields = [np.asarray(c) for c in places.flatten().flatten()]
            own = (fields[0] & low) == number
            ends = np.concatenate([[0], np.cumsum(own)])[np.cumsum(pc.list_value_length(places))].tolist()
            fields = [f[own].tolist() for f in fields]
            stop = 0
            for row_id, text, end in zip(batch.column("row_id").to_pylist(), batch.column("text").to_pylist(), ends, strict=True):
                start, stop = stop, end
                if start == stop:
                    continue
                # Copies add to the stretches' copies only.
                again = row_id in done
                done.add(row_id)
                raw = encoded(text)
                for gram, at, first, last in set(zip(*(f[start:stop] for f in fields), strict=True)):
                    data = raw[first : last + length]
                    key = hashlib.blake2b(b"%d:" % (at - first) + data, digest_size=16).digest()
                    if key in kept:
                        kept[key][3] += 1
                    else:
                        kept[key] = [gram, at - first, data, 1]
                        size += len(data)
                    if not again:
                        grams.append(gram)
                        keys.append(key)
                        ids.append(row_id)
                        starts.append(first)
            none = [None] * len(grams)
            yield made([grams, keys, ids, starts, none, none, none])
            if size >= KEPT_BYTES:
                yield distinct()
                size = 0
        yield distinct()

    piece = pa.schema([("gram", pa.int64()), ("key", pa.binary()), ("row_id", pa.binary()), ("first", pa.int32()), ("off", pa.int32()), ("data", pa.binary()), ("copies", pa.int64())])
    pieces = written(texts.select("row_id", "text", "places").mapInArrow(cut, "gram long, key binary, row_id binary, first int, off int, data binary, copies long"), "pieces")
    # A stretch has a row for each task that found it.
    strings = pieces.where("data is not null").select("gram", "key", "copies", "off", "data")
    each = strings.select("gram", "key", "copies", F.octet_length("data").alias("size")).groupBy("gram", "key").agg(F.sum("copies").alias("copies"), F.max("size").alias("size"))
    sizes = each.groupBy("gram").agg(F.sum("size").alias("size"), F.sum("copies").alias("n")).where("n > 1")
    large = written(sizes.where(F.col("size") > GROUP_BYTES).select("gram"), "large-grams")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some_large = bool(large.limit(1).count())
    small = strings.join(large, "gram", "left_anti") if some_large else strings
    ordered = small.select("gram", "key", "copies", "off", "data").repartition(parts, "gram").sortWithinPartitions("gram", "key")
    found = ordered.mapInArrow(lambda batches: _sorted_groups(batches, length, width), "gram long, key binary, a int, b int")
    if some_large:
        whole = strings.join(large, "gram").groupBy("gram", "key").agg(F.sum("copies").alias("copies"), F.first("data").alias("data"))
        found = found.unionByName(_by_hash(whole, length, width))
    # A copy's places may be there for each task that found it; covered() takes them as one.
    members = pieces.where("row_id is not null").select("gram", "key", "row_id", "first")
    repeated = written(found, "repeats")
    starts = members.join(repeated, ["gram", "key"]).groupBy("row_id").agg(F.collect_list(F.struct((F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))).alias("starts"))
    starts = written(starts, "starts")
    forget(pieces, large, repeated)
    return starts


def _ranges(starts: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's starts as arrays a and b; null is none."""
    a, b = (np.asarray(c, dtype=np.int64) for c in starts.flatten().flatten())
    cuts = np.cumsum([0, *pc.list_value_length(starts).fill_null(0).to_pylist()]).tolist()
    return [(a[i:j], b[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def covered(starts: tuple[np.ndarray, np.ndarray], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings from the starts (ranges a to b) cover."""
    order = np.argsort(starts[0], kind="stable")
    if not len(order):
        return []
    a, stops = starts[0][order], np.maximum.accumulate(starts[1][order] - 1 + length)
    first = np.concatenate([[0], np.flatnonzero(a[1:] > stops[:-1]) + 1])
    return list(zip(a[first].tolist(), stops[np.append(first[1:], len(a)) - 1].tolist(), strict=True))


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join(out) + raw[at:]


def removal_and_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """removal()'s columns, and n_passages and passage_bytes: maximal runs of passages of WORDS words that occur elsewhere too,
    which aren't removed."""
    return removal(docs, length, passages_too=True).drop("row_id", "kept")


def removal(docs: DataFrame, length: int = LENGTH, keep_text: bool = False, passages_too: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, n_passages and passage_bytes, row_id and kept (binary,
    null: nothing removed)."""
    rows, spans = find_repeats(docs, [Search(length), *([BY_WORDS] * passages_too)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns: list[list] = [[] for _ in range(6)]
            words = _ranges(batch.column("starts1")) if passages_too else [_NONE] * batch.num_rows
            for text, starts, coded in zip(batch.column("text").to_pylist(), _ranges(batch.column("starts0")), words, strict=True):
                runs = covered(starts, length)
                kept = _kept(text.encode(), runs)
                found = passages(text, coded, _NONE, 0) if len(coded[0]) else []
                for column, value in zip(columns, (sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), len(found), sum(b - a for a, b in found), kept if runs else None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), *(pa.array(c, f.type) for c, f in zip(columns, out, strict=False))][: 1 + len(out)], names=["row_id", *out.names])

    out = pa.schema([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("passage_bytes", pa.int64()), *([("kept", pa.binary())] * keep_text)])
    cuts = spans.mapInArrow(cut, "row_id binary, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long" + ", kept binary" * keep_text)
    joined = rows.join(cuts, "row_id", "left")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(c, zero).alias(c) for c in ("n_removed", "n_spans", "n_passages", "passage_bytes")]
    return joined.select("doc_id", "n_bytes", *counts[:2], F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), *(counts[2:] * passages_too), *(["row_id", "kept"] * keep_text))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs with repeated passages cut out of text. Where a cut splits a character, what is left of it is
    replaced by U+FFFD. A text of which nothing is left stays, empty."""
    return _replaced(docs, removal(docs, length, keep_text=True).where("kept is not null").select("row_id", "kept").dropDuplicates(["row_id"]))


def passages(text: str, words: tuple[np.ndarray, np.ndarray], strings: tuple[np.ndarray, np.ndarray], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes in repeated passages: starts among the codes of the words, and starts of strings of bytes."""
    firsts, ends = word_places(text)
    # Only codes' own beginnings are words.
    a, b = (-(-x // CODE) for x in words)
    a, b = a[a < b], b[a < b]
    runs = np.array(covered(strings, length), dtype=np.int64).reshape(-1, 2)
    return covered((np.concatenate([runs[:, 0], firsts[a]]), np.concatenate([runs[:, 1], ends[b - 2 + WORDS]]) + 1 - length), length)


def without_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs without passages of WORDS words, or of `length` bytes, that occur elsewhere too; else as
    without_repeats."""
    rows, spans = find_repeats(docs, [BY_WORDS, Search(length, wanted=few_words)])
    forget(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kept = [_kept(text.encode(), passages(text, w, s, length)) for text, w, s in zip(batch.column("text").to_pylist(), *(_ranges(batch.column(c)) for c in ("starts0", "starts1")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(kept, pa.binary())], names=["row_id", "kept"])

    return _replaced(docs, spans.mapInArrow(cut, "row_id binary, kept binary"))


def _replaced(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with what is kept of the texts found (row_id, kept), each named once."""
    row, kept = free_name(docs, "row_id"), free_name(docs, "kept")
    key = F.unhex(F.substring(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col("text").cast("string"), F.lit(""))), 256), 1, 40))
    joined = docs.withColumn(row, key).join(found.select(F.col("row_id").alias(row), F.col("kept").alias(kept)), row, "left")
    clean = F.when(F.col(kept).isNotNull(), F.try_validate_utf8(F.col(kept).cast("string"))).otherwise(F.col("text"))
    repaired = F.coalesce(clean, F.when(F.col(kept).isNotNull(), F.make_valid_utf8(F.col(kept).cast("string"))))
    return joined.withColumn("text", repaired).select(*docs.columns)
