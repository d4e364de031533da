import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import suffixes


def test_suffix_array_is_sorted_order():
    r = random.Random(1)
    for _ in range(1500):
        t = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randint(0, 40))]
        assert suffixes.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(mark)) if mark[i] and not (i and mark[i - 1]))
        out.append((len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()))
    return out


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 9)))
    passages = [" ".join(word() for _ in range(r.randint(60, 120))) for _ in range(6)]
    out = [None, "", "short", "x" * 1500, "x" * 1200, " ".join(passages[:2]) * 2]
    for _ in range(60):
        parts = [r.choice(passages)[r.randint(0, 80) :] if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 150))) for _ in range(r.randint(1, 4))]
        out.append(" ".join(parts))
    return out + out[10:14]


def test_removal_against_brute_force(spark, monkeypatch):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gram", F.lit(1)).withColumn("row_id", F.lit("clash"))
    want = Counter((d, *x) for (d, _), x in zip(rows, brute([t for _, t in rows], 400), strict=True))
    for size in (suffixes.GROUP_BYTES, 2000):
        monkeypatch.setattr(suffixes, "GROUP_BYTES", size)
        got = suffixes.removal(docs, 400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert Counter(map(tuple, got)) == want


def test_empty_table_and_kept_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert suffixes.removal(empty).count() == 0 and suffixes.without_repeats(empty).count() == 0
    docs = spark.createDataFrame([(1, "a" * 500 + "keep", "s"), (2, "b" + "a" * 450, "s"), (3, None, None)], "doc_id long, text string, source string")
    assert {r.doc_id: r.text for r in suffixes.without_repeats(docs).collect()} == {1: "keep", 2: "b", 3: None}


def test_passages_are_counted_beside_removal(spark):
    r = random.Random(8)
    some = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(4)) for _ in range(n))
    passage, long = some(55), some(120)
    rows = [(0, f"{some(30)} {passage}"), (1, f"{passage} {some(9)}"), (2, some(200)), (3, f"{long} x"), (4, long), (5, None), (6, passage[: len(passage) // 2])]
    out = {x.doc_id: x for x in suffixes.removal_and_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].n_removed for i in range(7)] == [0, 0, 0, len(long), len(long), 0, 0]
    assert [out[i].n_passages for i in range(7)] == [1, 1, 0, 1, 1, 0, 0]
    assert [out[i].passage_bytes for i in range(7)] == [len(passage)] * 2 + [0] + [len(long)] * 2 + [0, 0]


def test_words_against_a_pattern():
    single = "".join(f"{chr(a)}-{chr(b)}" for a, b in suffixes._SCRIPTS)
    pattern = re.compile(rf"[{single}]|[^\s{single}]+")
    r = random.Random(9)
    letters = ["a", "bc", " ", "\n", "　", "ก", "中", "é", "\U0001f600", "\U00020001", "\x1c", "\u0085", "\U000e0001"]
    texts = ["", " ", "a", "中", "  a", "a  ", "x" * 3000, *("".join(r.choices(letters, k=r.randrange(900))) for _ in range(80))]
    codes: dict[str, bytes] = {}
    for text in texts:
        spans = [(len(text[: m.start()].encode()), len(text[: m.end()].encode())) for m in pattern.finditer(text)]
        firsts, ends = suffixes.word_places(text)
        assert list(zip(firsts.tolist(), ends.tolist(), strict=True)) == spans
        found = suffixes.word_codes(text)
        for i, word in enumerate(pattern.findall(text)):
            code = found[i * suffixes.CODE : (i + 1) * suffixes.CODE]
            assert codes.setdefault(word, code) == code
        for length in (1, 40, 400):
            want = [sum(a > i and b < i + length for a, b in spans) < suffixes.WORDS for i in range(max(0, len(text.encode()) - length + 1))]
            assert suffixes.few_words(text, length).tolist() == want
    assert len(set(codes.values())) == len(codes)


def test_repeats_of_wide_symbols():
    r = random.Random(3)
    strings = [bytes(r.choices(b"ab", k=3 * r.randrange(1, 60))) for _ in range(12)]
    seen: dict[bytes, int] = {}
    for x in strings:
        for i in range(0, len(x) - 11, 3):
            seen[x[i : i + 12]] = seen.get(x[i : i + 12], 0) + 1
    for x, found in zip(strings, suffixes.repeats(strings, 4, 3), strict=True):
        assert found.tolist() == [len(x[i : i + 12]) == 12 and seen[x[i : i + 12]] > 1 for i in range(0, len(x), 3)]


def test_clips_that_another_one_holds_are_not_sorted(monkeypatch):
    # Stretches of one minimizer: shorter and shorter parts of two texts that differ at one side, in other surroundings.
    r = random.Random(12)
    some = lambda n: bytes(r.choices(b"abcdefgh", k=n))
    middle, sides = some(100), [(some(300), some(300)), (some(300), some(300))]
    sides[1] = (sides[0][0][-150:], sides[1][1])
    rows = []
    for k in range(40):
        left, right = sides[k % 2]
        a, b = left[max(0, len(left) - 290 + 6 * k) :], right[: 290 - 5 * k]
        off = some(3) + a
        rows.append((7, b"%02d" % k, 1, len(off), off + middle + b + some(3)))
    seen = Counter(x[4][i : i + 200] for x in rows for i in range(len(x[4]) - 199))
    sorted_bytes = []
    repeats = suffixes.repeats
    monkeypatch.setattr(suffixes, "repeats", lambda strings, *more: (sorted_bytes.extend(map(len, strings)), repeats(strings, *more))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["gram", "key", "copies", "off", "data"])
    found = defaultdict(set)
    for out in suffixes._sorted_groups(iter([batch]), 200):
        for x in out.to_pylist():
            found[x["key"]] |= set(range(x["a"], x["b"]))
    for _, key, _, _, data in rows:
        assert found[key] == {i for i in range(len(data) - 199) if seen[data[i : i + 200]] > 1}
    assert sum(sorted_bytes) < sum(len(x[4]) for x in rows) / 4


def test_a_stretch_found_by_several_tasks_is_one(monkeypatch):
    r = random.Random(13)
    data = bytes(r.choices(b"abcdefgh", k=500))
    rows = [(1, b"x", 2, 100, data), (1, b"x", 3, 100, data), (2, b"y", 1, 50, data[:450]), (2, b"z", 1, 50, data[:450][::-1])]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["gram", "key", "copies", "off", "data"])
    assert [x for out in suffixes._sorted_groups(iter([batch]), 400) for x in out.to_pylist()] == [{"gram": 1, "key": b"x", "a": 0, "b": 101}]


def test_repeated_rows_are_copies_for_both_searches(spark):
    r = random.Random(14)
    text = " ".join("".join(r.choices("abcdefg", k=4)) for _ in range(100))
    docs = spark.createDataFrame([(1, text), (1, text), (None, None), (2, "x" * 399)], "doc_id long, text string")
    out = sorted((x.doc_id or 0, x.n_removed, x.n_passages, x.passage_bytes) for x in suffixes.removal_and_passages(docs.repartition(3)).collect())
    assert out == [(0, 0, 0, 0), (1, len(text), 1, len(text)), (1, len(text), 1, len(text)), (2, 0, 0, 0)]
