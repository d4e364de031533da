import random

import corpus_pipeline
from lodestone.llm import suffixes


def test_stages_keep_columns_and_every_token(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d).cache()
        assert out.columns == docs.columns and 0 < out.count() <= n, name
        docs, n = out, out.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, d).count() == pieces.count()


def without(texts):
    """By brute force: no bytes in a window of 51 words, or in a string of 400 bytes, that occurs twice."""
    n, size = suffixes.WORDS, suffixes.LENGTH
    seen = {}
    for k, t in enumerate(texts):
        firsts, ends = suffixes.word_places(t)
        words, raw = [t.encode()[a:b] for a, b in zip(firsts, ends, strict=True)], t.encode()
        for i in range(len(words) - n + 1):
            seen.setdefault(tuple(words[i : i + n]), []).append((k, firsts[i], ends[i + n - 1]))
        inside = suffixes.few_words(t, size)
        for i in range(len(raw) - size + 1):
            if inside[i]:
                seen.setdefault(raw[i : i + size], []).append((k, i, i + size))
    marks = [bytearray(len(t.encode())) for t in texts]
    for found in seen.values():
        for k, a, b in found if len(found) > 1 else ():
            marks[k][a:b] = b"\1" * (b - a)
    return [bytes(x for x, m in zip(t.encode(), mark, strict=True) if not m).decode(errors="replace") for t, mark in zip(texts, marks, strict=True)]


def test_passages_of_over_50_words_are_cut(spark):
    r = random.Random(9)
    some = lambda n: " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(2, 6))) for _ in range(n))
    rows = []
    for n in (50, 51, 55, 60):
        passage = some(n)
        assert len(passage.encode()) < suffixes.LENGTH
        rows += [f"{some(70)} {passage} {some(40)}", f"{some(30)}\n{passage.replace(' ', chr(10))} {some(50)}"]
    long = " ".join("".join(r.choice("xyzß") for _ in range(40)) for _ in range(12))
    han = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(51))
    rows += [f"{some(5)} {long}", f"{long} {some(60)}", f"{some(3)}{han}", f"{han} {some(4)}", "one " * 60, "", some(51)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {x.doc_id: x for x in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert [out[i].text for i in range(len(rows))] == without(rows)
    assert [out[i].n_chars for i in range(len(rows))] == [len(out[i].text) for i in range(len(rows))]
    assert all(out[i].text == rows[i] for i in (0, 1)) and all(len(out[i].text.split()) < len(rows[i].split()) - 50 for i in range(2, 8))
