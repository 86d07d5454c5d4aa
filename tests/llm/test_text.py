import os
import random

import numpy as np
import pytest

from tidegrid.llm import bpe, packing, reading, tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZERS), reason="no tokenizer files")
DOCS = "doc_id bigint, text string, ids string, n_tokens int, part int"

ODD = [None, "", " ", "\n", "  a", "a\n\n  b", "it's DON'T 'S", "x 1 22 333", "<|endoftext|> <s>", "état naïve ✓ 中文　字", "a\x1cb\x85c", "ab\r\n\tq", "aaaa" * 300, "é" * 400, "a" * 3000 + " b", "😀😀 👍🏽", "﻿x​y"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    pools = ["ab", "ab' \n\ts.", "aé   \x1c1²", "中文 \n字", "<|endoftext|> ", "def f(x):\n    return x_1\n"]
    return ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 300))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_against_a_reference(spark, reference):
    texts = ODD + random_texts(200)
    df = spark.createDataFrame([(i, t, "clash", 0, 0) for i, t in enumerate(texts)] * 2, DOCS)
    got = bpe.encode_corpus(df).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        assert r.ids == reference.encode_ordinary(texts[r.doc_id] or ""), repr(texts[r.doc_id])
    assert bpe.encode_corpus(df.where("false")).count() == 0


def test_round_trip_and_long_words(reference):
    ranks = bpe.read_ranks(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")
    b = bpe.ByteBpe(ranks)
    back = {v: k for k, v in ranks.items()}
    words = [("ab" * n).encode() for n in (1, 2, 3, 100, 127, 128, 129, 400)] + ["é中".encode() * 90]
    ids, counts = b.encode_words(words)
    at = 0
    for w, n in zip(words, counts, strict=True):
        assert b"".join(back[i] for i in ids[at : at + n].tolist()) == w
        assert b._heap(w).tolist() == ids[at : at + n].tolist()
        at += n


def test_very_long_text_is_cut_without_effect(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 500)
    text = " ".join(random_texts(60, 3))
    assert "".join(p for p, _ in bpe.pieces(text)) == text
    assert [t for p in [bpe.pre_tokens(text)] for t in p] == [t for t in bpe._ANY.findall(text)]


def test_sizes_against_libraries():
    names = ["byte_bpe_50k", "word_bpe_49k", "piece_bpe_32k"]
    texts = ODD + random_texts(300, 2)
    got = tokens._all_counts(names, texts, bpe.TOKENIZERS)
    lib = pytest.importorskip("tokenizers")
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=f"{bpe.TOKENIZERS}/piece_bpe_32k.model")
    for n, sizes in zip(names, got, strict=True):
        if n == "piece_bpe_32k":
            want = [len(x) for x in sp.encode([t or "" for t in texts], num_threads=1)]
        else:
            t = lib.Tokenizer.from_file(f"{bpe.TOKENIZERS}/{n}.json")
            t.encode_special_tokens = True
            want = [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        assert sizes.tolist() == want, n


def check_plan(hist, capacity):
    p = packing.make_plan(hist, capacity)
    load = np.zeros(p.containers, np.int64)
    for size in np.flatnonzero(hist):
        at = np.flatnonzero(p.size == size)
        numbers = np.arange(hist[size])
        i = at[np.searchsorted(p.start[at], numbers, "right") - 1]
        np.add.at(load, p.base[i] + (numbers - p.start[i]) // p.per[i], size)
    assert load.max(initial=0) <= capacity
    assert load.sum() == (hist * np.arange(capacity + 1)).sum()
    assert (load > 0).all()
    return load.sum() / max(1, p.containers * capacity)


def test_plans_hold_and_fill():
    rng = np.random.default_rng(3)
    for capacity in (1, 2, 7, 50, 512, 2048):
        for n in (0, 1, 5, 300, 20000):
            sizes = np.clip(rng.lognormal(np.log(max(1, capacity) / 4), 0.8, n).astype(int), 1, capacity)
            hist = np.bincount(sizes, minlength=capacity + 1) if n else np.zeros(capacity + 1, np.int64)
            fill = check_plan(hist, capacity)
            if n == 20000:
                assert fill > 0.97, (capacity, fill)
    worst = np.zeros(101, np.int64)
    worst[51] = 1000  # no two fit together
    assert check_plan(worst, 100) == pytest.approx(0.51)


def test_nnls():
    rng = np.random.default_rng(0)
    a = rng.random((8, 20))
    x = np.where(rng.random(20) < 0.3, rng.random(20), 0)
    assert np.linalg.norm(a @ packing.nnls(a, a @ x) - a @ x) < 1e-6


def test_pack(spark):
    texts = ODD + ["word " * n for n in (1, 5, 50, 63, 64, 65, 500)] * 3
    df = spark.createDataFrame([(i, t, "x", 9, 9) for i, t in enumerate(texts)], DOCS)
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "word_bpe_49k", 100), (3, "piece_bpe_32k", 0), (4, None, 5)], "spec_id int, tokenizer string, capacity int")
    got = packing.pack(df, specs).collect()
    for spec, name, cap in ((1, "byte_bpe_50k", 64), (2, "word_bpe_49k", 100)):
        sizes = tokens.counter(name).count(texts)
        mine = [r for r in got if r.spec_id == spec]
        load, pieces = {}, {}
        for r in mine:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.part, r.first_token, r.n_tokens))
        assert max(load.values()) <= cap
        for i, n in enumerate(sizes):
            ps = sorted(pieces.get(i, []))
            assert sum(p[2] for p in ps) == n
            assert len(ps) == -(-n // cap)
            assert [p[1] for p in ps] == [cap * j for j in range(len(ps))]
    assert {r.spec_id for r in got} == {1, 2}
    assert packing.pack(df.where("false"), specs).count() == 0
    assert packing.pack(df, specs.where("false")).count() == 0


EASY = ["The cat sees the dog.", "We run to the big tree.", "It is a red ball.", "She has a small hat.", "Do not eat the cake."]
HARD = ["Notwithstanding the aforementioned considerations, the epistemological implications of the investigation substantiate the hypothesis.", "Insofar as the computational characterization presupposes the decomposition, the methodology necessitates a comprehensive reconciliation.", "The multidimensional interpretation of the phenomenon invalidates the parameterization of every independent approximation."]


@pytest.fixture(scope="module")
def model():
    r = random.Random(0)
    data = [(1, " ".join(r.sample(EASY, 3))) for _ in range(12)] + [(5, " ".join(r.sample(HARD, 2))) for _ in range(12)]
    return reading.train(data, folds=3)


def code(marks, body):
    return "\n".join(marks + line for line in body)


def test_prose_is_taken_from_comments_and_text(model):
    want = [reading.tokens(s) for s in EASY]
    text = " ".join(EASY)
    assert reading.prose_sentences(text, model) == want
    assert reading.prose_sentences("import os\n\n" + code("# ", EASY) + "\nx = 1\n", model) == want
    assert reading.prose_sentences("/*\n" + code(" * ", EASY) + "\n */\nint x;\n", model) == want
    assert reading.prose_sentences('def f():\n    """' + EASY[0] + " The\n    end is a near one.\n    \"\"\"\n", model)[1] == ["the", "end", "is", "a", "near", "one"]
    assert reading.prose_sentences("# Title\n\n- " + "\n- ".join(EASY) + "\n\n| a | b |\n|---|---|\n| The cat is here. | x |\n", model) == want


def test_what_is_not_prose(model):
    for t in (
        None,
        "",
        " \r\n",
        "x = f(1);\n// y = g(2);\n",
        "# Copyright (c) 2020 The makers of it. All rights reserved.\n# Permission is granted to copy the work.\nx = 1\n",
        "Plain Terms\n\nThe work is supplied as it is, and the makers accept no liability for it.\n\nPermission to copy the work is granted.\n",
        "// Code generated by a tool. Do not edit this file.\n",
        '{"note": "This is the text of a value."}',
        "Это предложение на другом языке. Оно не считается.",
        "a,b\n1,2\n",
    ):
        assert reading.prose_sentences(t, model) == [], t


ORDINARY = [
    "The nightly report is generated by the server.",
    "An image is generated for each page of the book.",
    "The story says that the copyright belongs to an old friend.",
    "Under these conditions the damage to the roof was small.",
    "He keeps a todo list for the house.",
    "The album was produced by a friend of the band.",
    "The rights of the child are written on the wall.",
    "Every licence was checked by the officer at the gate.",
]


@pytest.mark.parametrize("filler", [0, 1, 10, 100])
@pytest.mark.parametrize("sentence", ORDINARY)
def test_ordinary_sentences_with_words_of_licences_and_banners_count(model, sentence, filler):
    text = " ".join([sentence, *(EASY[i % 5] for i in range(filler))])
    assert reading.prose_sentences(text, model)[:1] == [reading.tokens(sentence)]
    assert len(reading.prose_sentences(text, model)) == filler + 1


@pytest.mark.parametrize("filler", [0, 10])
def test_banners_and_notices_beside_prose_do_not_count(model, filler):
    prose = [EASY[i % 5] for i in range(filler)]
    for line in ("This file was produced by the exporter. Changes will be lost.", "Licensed under the Open Licence; see the licence file.", "Permission is hereby granted to anyone to copy this software without any warranty."):
        text = code("// ", [line]) + "\n\n" + code("// ", prose) + "\nint x;\n"
        assert reading.prose_sentences(text, model) == [reading.tokens(s) for s in prose]


def test_markup_and_names_do_not_end_a_stretch(model):
    text = "\ufeffSee `open_file()` and the [guide](http://x.y/z) for the *whole* story of the parser. It calls open_file when the\nuser has asked for it to be read.\n"
    got = [" ".join(s) for s in reading.prose_sentences(text, model)]
    assert got == ["see open file and the guide for the whole story of the parser", "it calls open file when the user has asked for it to be read"]
    assert reading.prose_sentences("# for x in y.items():\n#     print(x.name, y[0])\n", model) == []


def test_licence_files_are_found(spark):
    from tidegrid.llm import kinds

    rows = [(2, "LICENSE", "LICENSE", "b"), (1, "docs/terms.md", "docs/terms.md", "a"), (3, "src/a.py", "LICENSE", "c"), (4, "x/COPYING.txt", None, "d"), (5, None, None, "e"), (None, "LICENSE", "LICENSE", "f"), (6, "LICENCE", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, license_path string, text string")
    assert kinds.licence_texts(df) == ["a", "b", "d"]
    assert kinds.licence_texts(df, limit=1) == ["a"]
    assert kinds.licence_texts(df.where("false")) == []


def test_training_is_done_once():
    data = [(1, EASY[0]), (2, HARD[0])]
    assert reading.train(data) is reading.train(list(data))


def test_levels(spark, model):
    docs = [(1, " ".join(EASY)), (2, " ".join(HARD)), (3, EASY[0] + " " + HARD[0]), (4, None), (5, ""), (6, "x = 1"), (7, " ".join(HARD[:2] * 2 + EASY[:1])), (8, " ".join(HARD * 3000))]
    df = spark.createDataFrame([(i, t, "x", 0, 0) for i, t in docs], DOCS)
    got = {r.doc_id: r for r in reading.reading_levels(df, model, hard=(5,)).collect()}
    assert (got[1].level, got[2].level) == (1, 5)
    assert got[1].difficulty < 2 < 4 < got[2].difficulty
    assert [got[i].level for i in (3, 4, 5, 6)] == [None] * 4
    assert got[4].difficulty is None
    assert got[8].n_sentences == 9000
    assert sorted(r.doc_id for r in reading.mostly_hard(reading.reading_levels(df, model, hard=(5,))).collect()) == [2, 7, 8]
    assert reading.reading_levels(df.where("false"), model).count() == 0
    with pytest.raises(ValueError, match="passages"):
        reading.train([])


def test_held_out_accuracy():
    path = "/root/testdata/sf0.001/level_items.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    import pyarrow.parquet as pq

    items = [(r["reading_level"], r["passage"]) for r in pq.read_table(path).to_pylist()]
    right = total = 0
    for f in range(3):
        m = reading.train([x for i, x in enumerate(items) if i % 3 != f], folds=2)
        for level, passage in (x for i, x in enumerate(items) if i % 3 == f):
            p = m.sentence_probs([t for t in map(reading.tokens, reading._END.split(passage)) if t]).mean(axis=0)
            right += (p @ np.isin(m.levels, (4, 5)) > 0.5) == (level >= 4)
            total += 1
    assert right / total > 0.95


def test_queries_name_columns(spark):
    from tidegrid.llm import queries

    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("mark", ["\x1c", "\x1d", "\x1e", "\x1f"])
def test_long_texts_are_cut_at_white_space_of_the_pattern_only(mark):
    text = ("ab " * (bpe.CHUNK_CHARS // 3 + 1))[-bpe.CHUNK_CHARS :] + "!!!!!!" + mark + "! end"
    assert bpe.pre_tokens(text) == bpe._ASCII.findall(text)
