import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from lodestone.llm import bpe, chat, minhash, ogg, packing, pii, topk, toxicity, warc

HARD = [None, "", " ", "word", "a b", "\n\n  \t x", "é " * 3000, "same text here", "same text here", "x" * 5000, "I'll don't  stop\r\n　ok"]


def frame(spark, texts=HARD):
    return spark.createDataFrame([(i, t, None if i % 4 == 0 else f"s{i % 3}", i) for i, t in enumerate(texts)], "doc_id long, text string, source string, block int")


def test_minhash_against_brute_force(spark):
    r = random.Random(4)
    base = [[f"w{r.randrange(400)}" for _ in range(80)] for _ in range(6)]
    texts = list(HARD)
    for _ in range(120):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(lambda x: (x,), w)))
    parent = list(range(len(texts)))
    for a, s in enumerate(sets):
        for b in range(a):
            k = len(s & sets[b])
            if k and 100 * k >= 80 * (len(s) + len(sets[b]) - k):
                old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                parent = [new if p == old else p for p in parent]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, texts), size=2).collect()}
    assert got == {i: (len(s), parent[i], parent[i] == i) for i, s in enumerate(sets)}
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_pii_base_kinds_against_regular_expressions():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def base(t):
        for kind, p in kinds.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                    yield m.start(), m.end(), kind

    r = random.Random(3)
    for i in range(20000):
        t = "".join(r.choice("0123456789.. --@@+()ab_%é\n" if i % 2 else "0123456789 -.+") for _ in range(r.randint(0, 50)))
        assert [s for s in pii.find(t) if s[2] in pii.BASE_KINDS] == sorted(base(t), key=lambda s: (s[0], pii.KINDS.index(s[2])))
    assert pii.redact("mail a@b.co, see https://x.y/z.", pii.find("mail a@b.co, see https://x.y/z.")) == "mail [EMAIL], see [URL]."
    assert pii.find("IBAN: DE44500105175407324931")[0][2] in pii.KINDS


def test_bpe_against_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, list(r.ids), r.decoded_sha256) for r in bpe.encode_documents(frame(spark), ranks, P.PATTERN).collect()}
    for i, t in enumerate(HARD):
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (len(ids), ids, hashlib.sha256((t or "").encode()).hexdigest())


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (None, [1.0] * 8)]
    df = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    vectors = {x.vec_id: x.v for x in df.collect()}
    asked = [i for i in vectors if i % 50 == 0]
    want = set()
    for q in asked:
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)}
    assert set(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())) == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_ogg_round_trip_and_damage(spark):
    for t in HARD:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = ogg.mux(payload, len(raw))
        assert ogg.read_back(stored)[:2] == (payload, len(raw))
        with pytest.raises(ValueError):
            ogg.demux(stored[:-1] + bytes([stored[-1] ^ 1]))
    long = [(bytes([i]) * n, i) for i, n in enumerate((0, 255, 254, 510, 200_000))]
    assert [p for p, _ in ogg.demux(b"".join(ogg.pages_of(long, 5)))[5]] == [p for p, _ in long]
    head, *rest = ogg.demux(ogg.mux(b"a" * 576 * 1000, 5))[ogg.SAMPLES]
    assert ogg.ends_of(rest, 576) == [576 * (i + 1) for i in range(1000)] and 0 < sum(g is not None for _, g in rest) < 1000
    rows = {r.doc_id: r for r in ogg.read_media(ogg.store_media(frame(spark))).collect()}
    assert len(rows) == len(HARD)
    for i, t in enumerate(HARD):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        x = [b - 128 for b in payload]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
        feature = f"ms={round(len(payload) / 8)};sum={sum(x)};range={max(x) - min(x)};energy={sum(v * v for v in x)};crossings={crossings}"
        expected = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(ogg.mux(payload, len(raw))).hexdigest(), feature)
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32, rows[i].media_sha256, rows[i].feature) == expected


def test_packing_covers_every_token_once(spark):
    docs = frame(spark, [t and t * 40 for t in HARD] * 5)
    ids = packing.Encoder(P.path("word_bpe_49k.json"))
    want = {i: np.frombuffer(x + b"\1\0", "<u2").astype("<u4") for i, x in enumerate(ids([t and t * 40 or "" for t in HARD] * 5))}
    places, sizes = {}, Counter()
    for r in packing.pack(docs, P.path("word_bpe_49k.json")).collect():
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        for k in range(r.length):
            assert places.setdefault((r.doc_id, r.start + k), (r.sequence_id, r.offset + k)) == (r.sequence_id, r.offset + k)
        sizes[r.sequence_id] += r.length
    assert len(places) == sum(map(len, want.values())) == len(set(places.values()))
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())
    assert packing.pack(frame(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a</s>[INST] [/INST]<s>"), (1, 1, "user", None), (1, 2, "assistant", r"<\s>[\/INST]<\\/s>"), (1, 3, None, "x"), (2, 0, "assistant", ""), (None, 1, "user", "[")]
    df = chat.with_hard_case(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    assert got == {1: [(r or "", t or "") for _, _, r, t in rows[:4]], 2: [("assistant", "")], None: [("user", "[")], -7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}


def test_warc_round_trip(spark):
    pages = [(3, "http://a/", "same"), (1, None, "same"), (2, "http://b/ \r\n c", None), (5, "", ""), (9, "http://c/", "é" * 9000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    bundles = warc.write_bundles(df)
    got = {r.page_id: r for r in warc.read_bundles(bundles, keep_payload=True).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2), 9: ("response", None)}
    assert bytes(got[9].payload).decode() == "é" * 9000 and got[3].payload_bytes == 4 and got[3].payload_digest == got[1].payload_digest
    one = bundles.first()
    places = list(zip(one.page_ids, one.frames, one.offsets, one.lengths, strict=True))
    assert len({f for _, f, _, _ in places}) == 1 and [warc.read_record(bytes(one.data), *p[1:])["page_id"] for p in places] == [p[0] for p in places]
    many = spark.createDataFrame([(i, "u", f"{i} " * 4000) for i in range(40)] + [(40, "u", "x" * 300_000)], "page_id long, url string, html string").coalesce(1)
    one = warc.write_bundles(many).first()
    assert len(set(one.frames)) == 9 and max(one.offsets) > 0 and len(warc.seek_table(bytes(one.data))) == len(set(one.frames))
    assert warc.read_record(bytes(one.data), one.frames[-1], one.offsets[-1], one.lengths[-1])["payload"] == b"x" * 300_000
    assert {r.record_type for r in warc.read_bundles(warc.write_bundles(df, min_bytes=99)).collect()} == {"response"}


def test_levenshtein_lexicon():
    lexicon = toxicity.Lexicon(["moron", "disgusting", "low*"])
    kinds = {"moron": 1, "morin": 2, "mroon": 0, "mor": 0, "moronn": 2, "disgsutng": 0, "disgustng": 2, "disgutnig": 0, "lowest": 1, "lo": 0, "": 0}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(1)
    words = list(kinds) + ["".join(r.choice("moranx") for _ in range(r.randint(3, 7))) for _ in range(3000)]
    for w in words:
        fits = distance(w, "moron") <= 1 or distance(w, "disgusting") <= 2
        assert lexicon.kind(w) == (1 if w in ("moron", "disgusting") or w.startswith("low") else 2 if fits else 0), w
    assert lexicon.features('he said "moron" to me')[2] > 0 and lexicon.features("you moron")[0] > 0


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{r.randrange(300)}" for _ in range(30)]
        if toxic := i % 4 == 0:
            words[r.randrange(30)] = r.choice(["nastyword", "awfulterm"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic * 1))
    docs = spark.createDataFrame(rows + [(None, None)], "doc_id long, text string")
    got = toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) >= 0.95 * len(held)
    none = toxicity.scored(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in none)


def test_packing_encoder_against_the_tokenizer():
    encoder = packing.Encoder(P.path("word_bpe_49k.json"))
    texts = ["", "  ", " lead", "a\x1cb c", "x" * 300 + " y", "a\u0085b c  d", "é́ ﬁ ＡＢ", "a​b  \x00c", "İstanbul ǅ ß ẞ ŉ ΑΣ. ʼn", "it's dogs' <|endoftext|> x<|endoftext|>, ''s. a.'s 12. _ __ a_", "ªº µ Å Å"]
    assert encoder(texts) == [encoder._one(t) for t in texts] == encoder(texts)
    assert encoder([]) == []


def test_learned_long_words_may_be_misspelt(spark):
    rows = [(f"quite a disgusting remark {i}", 1) for i in range(40)] + [(f"quite a friendly remark {i}", 0) for i in range(40)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    lexicon = toxicity.Lexicon(terms)
    assert [lexicon.kind(w) for w in ("disgusting", "disgustingly", "disgustng", "digusting", "dsgusting", "friendly")] == [1, 1, 2, 2, 2, 0]
