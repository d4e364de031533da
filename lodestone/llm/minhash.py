"""Near-duplicates by circulant MinHash.

A document's shingles are 64-bit hashes. One permutation (sigma) places them in a universe of 2^20; a second one (pi),
shifted circularly by 0, 1, 2, ..., gives every coordinate of the signature: coordinate k is the least
pi[(sigma(s) + k) mod D] over the shingles s. As shifts are neighbours in pi, a shingle's coordinates are one slice of it.
The coordinates are banded; documents that share a band are candidates, and links are confirmed on full shingle sets.
Equal shingle sets are one node from the start, so that copies cost one row each.

Within a band's bucket nobody pairs all members. Every member is compared with the bucket's leader, the member whose buckets
are largest: that of a group of near copies with the fewest changes. While links are found, those outside the leaders'
components get a leader of their own. What is then left in several components is compared by differences:
a member x of the group of a leader L is L without R elements and with A others. As |x and y| is |L| - R_x - R_y plus what the
differences of x and y share, x and y are linked just if they share at least t = (W_x + W_y - (100 - p) |L|) / (100 + p)
differences, W = 100 R + p A. Members of different components need t > 0, so that rare differences first, as in a prefix filter,
pairs meet only where the first few differences of both have one in common, and positions bound what else they can share. So the rows
made follow the number of changes that members share, not the square of a group. No link between candidates is lost.
Hot keys are equality joins that adaptive execution can split.

With 32 bands of 6, a pair at similarity 0.8 shares no band with probability 6e-5, at 0.9 with 4e-11.

Defined results: null and empty texts, and those without words, have no shingles and are linked with nothing. Texts of any
length are hashed whole, in pieces of bounded size. Rows with words that share a doc_id are linked with each other, whatever their texts;
rows with a null doc_id are linked with nothing. Other columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents, forget, sliced, texts_of, written

BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
UNIVERSE = 1 << 20
#: Bytes of text whose words are hashed at once.
PIECE = 512 << 10
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15

_made: dict = {}


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """sigma, and pi as a view whose row i is pi[i : i + COORDINATES], circularly."""
    if "pi" not in _made:
        rng = np.random.default_rng(20240229)
        _made["sigma"] = rng.permutation(UNIVERSE).astype(np.uint32)
        pi = rng.permutation(UNIVERSE).astype(np.uint32)
        _made["pi"] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: COORDINATES - 1]]), COORDINATES)
        _made["bytes"] = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        _made["fold"] = rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | _U(1)
    return _made["sigma"], _made["pi"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of data, which begins and ends with white space."""
    _permutations()
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    size = len(raw)
    if len(_made.get("power", ())) < size:
        for name, base in (("power", _ODD), ("inverse", pow(_ODD, -1, 1 << 64))):
            powers = np.full(max(size, PIECE + 2), _U(base))
            powers[0] = 1
            _made[name] = np.multiply.accumulate(powers, out=powers)
    sums = _made["bytes"][raw]
    sums *= _made["power"][:size]
    np.cumsum(sums, out=sums)
    words = mix((sums[ends - 1] - sums[starts - 1]) * _made["inverse"][starts])
    if size > PIECE + 2:
        del _made["power"], _made["inverse"]
    return starts, words


def _pieces(data: bytes) -> Iterator[bytes]:
    """data cut at white space into pieces of about PIECE bytes; a longer word stays whole."""
    at = 0
    while len(data) - at > PIECE:
        cut = _BLANK.search(data, at + PIECE)
        if cut is None:
            break
        yield data[at : cut.start()]
        at = cut.start()
    yield data[at:]


def words_of(texts: list[str]) -> Iterator[np.ndarray]:
    """Each text's words, lower-cased (A-Z) runs without white space, as hashes; many short texts at once."""
    todo: list[bytes] = []

    def several() -> Iterator[np.ndarray]:
        starts, words = _word_hashes(b" ".join([b"", *todo, b""]))
        at = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in todo)]))
        yield from (words[a:b] for a, b in zip(at, at[1:], strict=False))
        todo.clear()

    size = 0
    for t in texts:
        raw = t.encode().lower()
        if size + len(raw) > PIECE and todo:
            yield from several()
            size = 0
        if len(raw) > PIECE:
            yield np.concatenate([_word_hashes(b" " + p + b" ")[1] for p in _pieces(raw)])
        else:
            todo.append(raw)
            size += len(raw) + 1
    if todo:
        yield from several()


def shingle_sets(texts: list[str], size: int = 2) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of size words, as sorted hashes."""
    for w in words_of(texts):
        n = min(size, len(w))
        if not n:
            yield w
            continue
        h = np.full(len(w) - n + 1, _U(n))
        for j in range(n):
            h = mix(h * _U(_ODD) + w[j : len(w) - n + 1 + j])
        yield np.unique(h)


def node_of(shingles: np.ndarray) -> bytes:
    """A name of the set: two sums of hashes, and its size in the last four bytes."""
    sums = np.array([shingles.sum(dtype=np.uint64), mix(shingles ^ _U(_ODD)).sum(dtype=np.uint64)], dtype="<u8")
    return sums.tobytes() + len(shingles).to_bytes(4, "big")


def size_of(node: Column) -> Column:
    return F.conv(F.hex(F.substring(node, 17, 4)), 16, 10).cast("long")


def signature(shingles: np.ndarray) -> np.ndarray:
    sigma, pi = _permutations()
    places = sigma[(shingles & _U(UNIVERSE - 1)).astype(np.int64)]
    least = np.full(COORDINATES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(places), 1024):
        np.minimum(least, pi[places[at : at + 1024]].min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """BANDS keys for each signature; the band's number is part of a key."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    return mix((mix(parts) * _made["fold"]).sum(axis=2) + np.arange(1, BANDS + 1, dtype=np.uint64) * _U(_ODD)).view(np.int64)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (null: no shingles), bands."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, nodes, bands = [], [], []
        for s in shingle_sets(texts_of(batch), size):
            sizes.append(len(s))
            nodes.append(node_of(s) if len(s) else None)
            bands.append(band_keys(signature(s)[None, :])[0] if len(s) else None)
        columns = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], names=["doc_id", "text_key", "n_shingles", "node", "bands"])

    return arrow_map(documents(docs, text_key().alias("text_key")), make, "doc_id long, text_key long, n_shingles long, node binary, bands array<long>")


def text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s for s in shingle_sets(texts_of(batch), size) if len(s)]
        return pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return arrow_map(documents(docs), make, "node binary, shingles binary")


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the shingles sa and sb of their columns a and b."""
    left = pairs.join(sets.select(F.col("node").alias(a), F.col("shingles").alias("sa")), a)
    return left.join(sets.select(F.col("node").alias(b), F.col("shingles").alias("sb")), b)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have 100 * intersection >= percent * union."""
    fit = 100 * F.least(size_of(F.col("a")), size_of(F.col("b"))) >= percent * F.greatest(size_of(F.col("a")), size_of(F.col("b")))
    both = _with_sets(pairs.where(fit), sets, "a", "b")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
            s, t = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            at = np.minimum(np.searchsorted(s, t), len(s) - 1)
            common = int(np.count_nonzero(s[at] == t))
            if 100 * common >= percent * (len(s) + len(t) - common):
                keep.append(i)
        return batch.select(["a", "b"]).take(pa.array(keep, pa.int64())) if keep else None

    return arrow_map(both.select("a", "b", "sa", "sb"), make, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """id, component for every end of a link (a, b): the smallest id reachable. Labels spread along links and jump to
    their own label's label each round, so that rounds grow with the logarithm of a chain; each round is a written table."""
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u <> v").distinct(), "links")
    labels = written(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("v"), F.col("component").alias("c")), "v").groupBy(F.col("u").alias("id")).agg(F.min("c").alias("c"))
        spread = labels.join(near, "id").select("id", F.least("component", "c").alias("next"), "component")
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        step = written(spread.join(jump, "next").select("id", F.least("next", "far").alias("component"), (F.least("next", "far") < F.col("component")).alias("moved")), "labels")
        forget(labels)
        labels = step
        if not step.where("moved").limit(1).count():
            forget(edges)
            out = step.select("id", "component")
            out.written_at = step.written_at
            return out


def _merged(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """labels (node, component) with the components at both ends of links (a, b) made one, and whether there were any."""
    name = labels.select("node", "component")
    joint = links.join(name.toDF("a", "ca"), "a").join(name.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
    joint = written(joint, "joint")
    if not joint.limit(1).count():
        forget(joint)
        return labels, False
    into = components(joint)
    out = written(labels.join(into.toDF("component", "into"), "component", "left").select("node", F.coalesce("into", "component").alias("component")), "labels")
    forget(joint, into, labels)
    return out, True


def _differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For members (leader, node, component): size of the leader, weight W, differences z, their number n; added ones come first."""
    both = _with_sets(members, sets, "leader", "node")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [])
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            of_leader, own = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
            added, removed = np.setdiff1d(own, of_leader, assume_unique=True), np.setdiff1d(of_leader, own, assume_unique=True)
            for column, value in zip(out, (len(of_leader), 100 * len(removed) + percent * len(added), np.concatenate([added, removed]), len(added)), strict=True):
                column.append(value)
        columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32()), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.select(["leader", "node", "component"]).columns, *columns], names=["leader", "node", "component", "size", "weight", "z", "n_added"])

    return arrow_map(both.select("leader", "node", "component", "sa", "sb"), make, "leader binary, node binary, component binary, size long, weight long, z array<long>, n_added int")


def _close_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among the members (leader, node, component) of each leader: no pair that
    is linked is missing."""
    whole = 100 + percent
    found = written(_differences(members, sets, percent), "differences")
    each = found.select("leader", "node", F.posexplode("z").alias("at", "z"), (F.col("at") < F.col("n_added")).alias("added"))
    counts = each.groupBy("leader", "z").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = each.join(counts, ["leader", "z"]).groupBy("leader", "node").agg(F.sort_array(F.collect_list(F.struct("c", "z", "added"))).alias("zs"))
    excess = F.col("weight") - (100 - percent) * F.col("size")
    rows = found.select("leader", "node", "component", "size", "weight", F.size("z").alias("n"), excess.alias("excess")).join(shared, ["leader", "node"])
    rows = rows.withColumn("n_zs", F.size("zs")).withColumn("n_a", F.size(F.filter("zs", lambda x: x["added"]))).withColumn("n_r", F.col("n_zs") - F.col("n_a"))
    # Who is linked to the leader meets only those who aren't, and these share more than weight / whole with it, or with each other.
    half = F.col("n") - F.floor(F.col("weight") / whole)
    far = F.when(F.col("excess") > 0, F.col("n") - F.floor(F.col("excess") / whole)).otherwise(half)
    least = F.when(F.col("excess") > 0, F.col("excess")).otherwise(F.col("weight"))
    # Differences that nobody shares come first and take places without a row.
    first = F.greatest(F.least(far - F.col("n") + F.col("n_zs"), F.col("n_zs")), F.lit(0)).cast("int")
    firsts = rows.where(whole * F.col("n_zs") > least).withColumn("half", half).withColumn("zs", F.slice("zs", F.lit(1), first))
    firsts = firsts.select("leader", "node", "component", "size", "weight", "excess", "n", "n_a", "n_r", "half", (F.col("n") - F.col("n_zs")).alias("alone"), F.posexplode("zs").alias("at", "x"))
    firsts = firsts.select("leader", F.col("x.z").alias("z"), "node", "component", "size", "weight", "excess", "n_a", "n_r", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"), (F.col("alone") + F.col("at") < F.col("half")).alias("near"))
    firsts = written(firsts, "first-differences")
    x = firsts.where("excess > 0").select("leader", "z", *(F.col(c).alias(f"{c}_x") for c in ("node", "component", "weight", "n_a", "n_r", "rest", "near")))
    enough = F.col("weight") + F.col("weight_x") - (100 - percent) * F.col("size")
    fit = (F.col("component") != F.col("component_x")) & (whole * F.least("rest", "rest_x") >= enough)
    fit &= whole * (F.least("n_a", "n_a_x") + F.least("n_r", "n_r_x")) >= enough
    fit &= (F.col("excess") <= 0) | (F.col("near") & F.col("near_x") & (F.col("node") < F.col("node_x")))
    met = firsts.join(x, ["leader", "z"]).where(fit)
    out = written(met.select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct(), "close-pairs")
    forget(found, firsts)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept: a row for each row of docs. kept: doc_id is component_id."""
    signed = written(_signed(docs, size), "signed")
    named = signed.where("node is not null and doc_id is not null")
    groups = written(named.groupBy("node").agg(F.min("doc_id").alias("id"), F.min("bands").alias("bands")), "groups")
    entries = groups.select("node", F.explode("bands").alias("key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(entries.join(sizes, "key"), "buckets")
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    best = F.max(F.struct("weight", F.xxhash64("node"), "node")).getField("node").alias("leader")
    # Each bucket's members with its leader.
    led = written(shared.join(shared.join(weights, "node").groupBy("key").agg(best), "key").select("key", "node", "leader"), "led")
    unlike = F.col("node") != F.col("leader")
    pair = (F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    pairs = written(led.where(unlike).select(*pair).distinct(), "pairs")
    ends = led.select("node").distinct()
    ids = groups.join(ends, "node").select(F.col("id").alias("doc_id")).distinct()
    sets = written(_sets(documents(docs).join(ids, "doc_id", "left_semi"), size).join(ends, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    # Rows of one doc_id with different texts are linked by it.
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    same = named.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    found = components(_confirmed(pairs, sets, percent).unionByName(same))
    every = led.select("node").union(found.select("id")).distinct()
    labels = written(every.join(found.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")
    forget(pairs, found, shared)
    leaders = written(led.select("key", "leader").distinct(), "leaders")
    merging = True
    while merging:
        taken = leaders.join(labels.toDF("leader", "component"), "leader").select("key", "component").distinct()
        outside = led.select("key", "node").join(labels, "node").join(taken, ["key", "component"], "left_anti")
        mixed = outside.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct(F.xxhash64("node"), "node", "component")).alias("new")).where("low < high")
        rest = written(outside.join(mixed.select("key", F.col("new.node").alias("leader"), F.col("new.component").alias("own")), "key"), "outside")
        links = _confirmed(rest.where(F.col("component") != F.col("own")).select(*pair).distinct(), sets, percent)
        labels, merging = _merged(labels, links)
        if merging:
            more = written(leaders.union(rest.select("key", "leader").distinct()), "leaders")
            forget(leaders)
            leaders = more
        forget(rest)
    members = led.where(unlike).join(labels, "node")
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    loose = members.join(mixed, "key").select("leader", "node", "component").distinct()
    close = _close_pairs(loose, sets, percent)
    labels, _ = _merged(labels, _confirmed(close, sets, percent))
    forget(close, leaders, led)
    into = groups.select("node", "id").join(labels, "node")
    smallest = into.groupBy("component").agg(F.min("id").alias("component_id"))
    labelled = groups.select("node", "id").join(labels, "node", "left").join(smallest, "component", "left")
    component = written(labelled.select("node", F.coalesce("component_id", "id").alias("component_id")), "components")
    forget(sets, labels, groups)
    out = signed.select("doc_id", "text_key", "n_shingles", "node")
    joined = out.where("node is not null").join(component, "node", "left").select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    bare = out.where("node is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
