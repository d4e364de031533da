"""Near-duplicates against brute force: loose groups, sub-families, repeated doc_ids, odd texts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodestone.llm import minhash


def _words(text: str) -> set[tuple[str, ...]]:
    w = text.lower().split()
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()


def _components(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = [(i, _words(t or "")) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in parent}


def _found(spark, rows) -> dict[int, int]:
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(docs, size=2, percent=80).collect()
    assert len(out) == len(rows)
    return {r["doc_id"]: r["component_id"] for r in out}


@pytest.mark.parametrize("seed", [1, 2])
def test_loose_group(spark, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows: list[tuple[int, str | None]] = [(1000, None), (1001, ""), (1002, "one"), (1003, "one"), (1004, "w0 w1")]
    for i in range(220):
        text = list(base)
        for _ in range(rng.randrange(9)):
            text[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(text)))
    assert _found(spark, rows) == _components(rows)


def test_families_within_a_group(spark):
    """Copies of copies: families that are near each other, but linked only within."""
    rng = random.Random(5)
    rows = []
    base = [f"w{i}" for i in range(80)]
    for family in range(12):
        own = [f"f{family}_{i}" if rng.random() < 0.09 else w for i, w in enumerate(base)]
        for k in range(12):
            text = [f"y{rng.randrange(60)}" if rng.random() < 0.02 * (k % 4) else w for w in own]
            rows.append((100 * k + family, " ".join(text)))
    expected = _components(rows)
    assert 3 < len(set(expected.values())) < len(rows)
    assert _found(spark, rows) == expected


def test_group_of_5000_loose_copies(spark):
    """Most copies are linked to the base, some only to each other, some to nobody; brute force by a matrix of shared shingles."""
    rng = random.Random(11)
    rows = []
    for i in range(5000):
        text = [f"w{k}" for k in range(100)]
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7])):
            text[rng.randrange(100)] = f"x{rng.randrange(300)}"
        rows.append((i, " ".join(text)))
    sets = [_words(t) for _, t in rows]
    number = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(rows), len(number)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [number[g] for g in s]] = 1
    common, sizes = held @ held.T, held.sum(axis=1)
    linked = 5 * common >= 4 * (sizes[:, None] + sizes[None, :] - common)
    label, before = np.arange(len(rows)), None
    while before is None or (before != label).any():
        before = label
        label = np.array([label[linked[i]].min() for i in range(len(rows))])
    assert 20 < len(set(label.tolist()))
    assert _found(spark, rows) == dict(enumerate(label.tolist()))


def test_repeated_doc_ids_lose_no_link(spark):
    """A doc_id with two texts links what is near either of them; null ids are linked with nothing."""
    x = " ".join(f"a{i}" for i in range(40))
    z = " ".join(f"b{i}" for i in range(40))
    rows = [(9, z), (1, x), (1, z), (5, x + " end"), (6, z + " end"), (7, "else where"), (8, None), (8, "")]
    docs = spark.createDataFrame([*rows, (None, x), (None, None)], "doc_id long, text string")
    for _ in range(2):
        found = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, size=2, percent=80).collect()}
        assert found == {(9, 1, False), (1, 1, True), (5, 1, False), (6, 1, False), (7, 7, True), (8, 8, True), (None, None, True)}
        docs = docs.orderBy("text")


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty, size=2).collect() == []
    odd = spark.createDataFrame([(1, "a b c", 1, 2), (2, "a b c", 3, 4)], "doc_id int, text string, node int, kept int")
    assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(odd, size=2).collect()) == [(1, 1), (2, 1)]


def test_words_of_long_texts(monkeypatch):
    rng = random.Random(7)
    texts = ["", "  ", "One two", " ".join(str(rng.randrange(500)) for _ in range(3000)), "x" * 9000, "a\tB\nc d" * 700, "é ü z"]
    whole = [set(x.tolist()) for x in minhash.shingle_sets(texts, 2)]
    monkeypatch.setattr(minhash, "PIECE", 1000)
    minhash._made.pop("power", None), minhash._made.pop("inverse", None)
    assert [set(x.tolist()) for x in minhash.shingle_sets(texts, 2)] == whole
    assert [len(x) for x in whole] == [len(_words(t)) if " " not in t else 1 for t in texts]
