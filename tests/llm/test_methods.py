"""Thresholds, exact scores, mixtures and the queries' SQL."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException

from lodestone.llm import packing, queries, topk

D = "/root/testdata/sf0.001"


def _brute(rows, queries_, k):
    out = set()
    for q, v in queries_:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("size", [300, 10**8, 10**9])
def test_top_k_exact_at_any_size(spark, size):
    r = random.Random(size)
    rows = [(i, [r.randrange(-size, size) for _ in range(r.choice((7, 8)))]) for i in range(300)] + [(300, []), (301, [size] * 8)]
    rows.append((302, rows[5][1]))
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    found = {tuple(x) for x in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()}
    assert found == _brute(rows, [x for x in rows if x[0] % 50 == 0], 5)


def test_top_k_refuses_overflow(spark):
    df = spark.createDataFrame([(0, [4 * 10**9] * 2), (1, [4 * 10**9] * 2)], "vec_id long, v array<long>")
    with pytest.raises(PySparkException):
        topk.top_k(df, df, 1).collect()
    with pytest.raises(PySparkException):
        topk.integer_vectors(spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_threshold_saves_work():
    r = np.random.default_rng(1)
    c = r.integers(-50, 50, (200, 16))
    c[:4] *= 20
    data = lambda x: x.astype("<i8").tobytes()
    row = {"q_ids": [1000], "q_dims": [16], "q_data": data(c[:1]), "ids": list(range(200)), "dims": [16] * 200, "data": data(c)}
    pair = topk._Pair(row)
    scores = np.sort(c @ c[0])[::-1]
    collected = pair.sufficient([int(scores[1])])[0]
    assert set(np.flatnonzero(c @ c[0] >= scores[1])) <= set(collected) and len(collected) < 20


def _mixture(totals, targets):
    """Tokens of each queue in each window."""
    schedule = packing.Schedule(totals, targets)
    windows: dict[int, list[int]] = {}
    placed: dict[int, list[tuple[int, int]]] = {}
    for q, total in enumerate(totals):
        end = 0
        for start, n, sequence, offset in schedule.pieces(q, 0, total):
            assert start == end and n > 0
            end = start + n
            windows.setdefault(sequence, [0] * len(totals))[q] += n
            placed.setdefault(sequence, []).append((offset, n))
        assert end == total
    for pieces in placed.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.SEQUENCE and (at == packing.SEQUENCE or at & (at - 1) == 0)
    return [windows[s] for s in sorted(windows)]


def test_targets_and_carried_deficits():
    totals = [2_000_000, 900_000, 400_000]
    windows = _mixture(totals, [0.5, 0.3, 0.2])
    full = [w for w in windows if sum(w) == packing.SEQUENCE]
    early = full[: 1_900_000 // packing.SEQUENCE]
    run = np.cumsum(early, axis=0)
    ideal = np.outer(np.arange(1, len(early) + 1) * packing.SEQUENCE, [0.5, 0.3, 0.2])
    # Fractions are carried: over any number of windows, regions included, a queue is off by a few tokens.
    assert np.abs(run - ideal).max() < 16
    assert np.abs(np.array(early) - ideal[0]).max() < 8


@pytest.mark.parametrize("totals, targets", [([5], None), ([3, 4000, 70_000], None), ([10_000, 1, 600_000], [1.0, 0.0, 0.0]), ([7] * 40, None), ([0, 5000], [1.0, 1.0]), ([999_999, 1, 2, 3], [0.0001, 1, 1, 1])])
def test_every_token_once(totals, targets):
    _mixture(totals, targets)


def test_each_region_is_replayed_once_for_a_tasks_documents(monkeypatch):
    # Rows in turn from 150 queues, each at another place: their regions are far apart.
    r = random.Random(4)
    totals = [r.randrange(3, 9) * 400_000 for _ in range(150)]
    rows = [(q, k * 1000 + totals[q] * q // 300, 1000) for k in range(4) for q in range(150)]
    schedule, replayed = packing.Schedule(totals), []
    prepare = packing.Schedule.prepare
    monkeypatch.setattr(packing.Schedule, "prepare", lambda self, numbers: (replayed.extend(n for n in numbers if n not in self._kept), prepare(self, numbers)))
    found = {i: list(schedule.pieces(*rows[i])) for i in schedule.in_order(rows)}
    needed = {n for q, at, size in rows for n in range(schedule.region_of(q, at), schedule.region_of(q, at + size - 1) + 1)}
    assert sorted(found) == list(range(len(rows))) and sorted(replayed) == sorted(needed) and len(needed) > 96
    assert all(sum(n for _, n, _, _ in found[i]) == 1000 for i in found)
    assert all(found[i] == list(packing.Schedule(totals).pieces(*rows[i])) for i in range(0, len(rows), 40))


def test_targets_by_name(spark):
    docs = spark.createDataFrame([(i, "word " * 300, "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    path = queries.public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack(docs, path, targets={"a": 0.75, "b": 0.25}).collect()
    first = [r for r in found if r.sequence_id == min(x.sequence_id for x in found)]
    share = sum(r.length for r in first if r.doc_id % 2 == 0) / sum(r.length for r in first)
    assert abs(share - 0.75) < 0.01 and sum(r.length for r in found) == sum({r.doc_id: r.doc_tokens for r in found}.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_of_queries(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    found = queries.queries()[name](spark, D)
    columns = sorted(found.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(repr, expected))


def test_one_entry_for_a_word_in_all_its_forms():
    path = queries.public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.Encoder(path)
    texts = ["Été été, ÉTÉ. (Été", "été?!", "Don't don't; DON'T", "İ, İ", "क़, क़_", "é, ẖ. H̱.", "²», ½.", "ȺȾ: ⱥⱦ", "a\x1cb, c", "", "…, x…, x'S. 's", "a <|ENDOFTEXT|>, b<|endoftext|>, c"]
    assert encoder(texts) == [encoder._one(t) for t in texts]
    assert sum("été" in w.lower() for w in encoder.known) <= 2


def test_top_k_over_several_groups(spark, monkeypatch):
    """Queries aren't joined with candidates: nothing is broadcast or buffered for a key, and a group gives a list for each query."""
    for name, value in (("CANDIDATE_BLOCK", 64), ("QUERY_BLOCK", 8), ("GROUP_BYTES", 4 << 10)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(5)
    v = r.integers(-300, 300, (1500, 8)).tolist()
    v[700:760] = [v[3]] * 60
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, v array<long>").repartition(7)
    found = topk.top_k(df, df.where("vec_id % 50 = 0"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("q_data" in x for x in plan.split("\n") if "Join" in x) and plan.count("Join") <= 1
    a = np.array(v)
    expected = [(q, n + 1, int(c), int((a @ a[q])[c])) for q in range(0, 1500, 50) for n, c in enumerate(sorted((i for i in range(1500) if i != q), key=lambda i: (-int(a[i] @ a[q]), i))[:5])]
    assert sorted(map(tuple, found.collect())) == expected
