import hashlib
import itertools
import json
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridweave.llm import bpe, bytecnn, chat, licenses, mixing
from gridweave.llm.template import Const, Out, TemplateError, compile_template, fold, parse

from .odd import TEXTS, documents

# -- chat ---------------------------------------------------------------------------


def test_template_language():
    t = compile_template(
        "{% set s = 'x' + \"y\" %}{# no #}{% for m in ms %}{% if m.a == 'q' and not m.b %}Q{{ s }}"
        "{% elif 'z' in m.a or m.b %}{% generation %}{{ m.a | up }}{% endgeneration %}{% else %}-{% endif %}{% endfor %}{{ 1 + 2 }}",
        {"up": str.upper},
    )
    pieces = list(t(ms=iter([{"a": "q"}, {"a": "zz"}, {"a": "w", "b": 1}, {"a": ""}])))
    assert "".join(p for p, _ in pieces) == "QxyZZW-3"
    assert [p for p, g in pieces if g] == ["ZZ", "W"]


def test_template_folds_constants():
    tree = fold(parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}no{% else %}c{{ 'd' | up }}{% endif %}"), {"up": str.upper})
    assert tree == (Out(Const("ab1cD")),)


@pytest.mark.parametrize(
    "bad", ["{% if x %}", "{{ f(1) }}", "{{ a[0] }}", "{% import os %}", "{{ a | nope }}", "{{ (a }}", "{% for x %}{% endfor %}"]
)
def test_template_refuses(bad):
    with pytest.raises(TemplateError):
        compile_template(bad, {})


def test_template_sandbox():
    with pytest.raises(TemplateError):
        list(compile_template("{{ a.__class__ }}", {})(a="text"))
    with pytest.raises(TemplateError):
        list(compile_template("{{ secret }}", {})(a=1))


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice('\\<>"#lgqh\n/turn é') for _ in range(rng.randrange(30)))
        assert chat.unescape(chat.escape(t)) == t
        assert not set(chat.escape(t)) & set('<>"#')


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b</turn>\n"), (1, 0, "user", chat.EXTRA_TEXT), (1, 1, "assistant", None), (2, None, None, None)]
    rows += [(None, 0, "assistant", "é\n\n"), (None, 0, "assistant", "é\n\n"), (3, 5, 'sys"\n', "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", chat.F.lit(1))
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    for key in (1, 2, None, 3):
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == key))
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        r = got[key]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for *_, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    out = chat.formatted_turns(df).where("conv_id = 1").orderBy("piece").collect()
    assert sum(len(r.text) for r in out) == got[1].formatted_chars
    assert chat.conversation_digests(df.limit(0)).count() == 0


# -- bpe ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


ODD = [
    "a<|endoftext|>B <|startoftext|><|endoftext|", "aaaa aaaaaaa AAAAA'll don't '", "ΣΑΣ ΟΔΟΣ İstanbul ǅ", "é ́x", "a\x85b\x1cc　d\x0be",
    "１２３ ½ ² ª", "\U0001f600 \U0001f468‍\U0001f469", "KKÅÅ", "ﬁ ß ẞ Ǆ", "한국어 각", "'S 'LL", "ab" * 5000, "´¨ × ÷ ¼µ ñÑ",
]


def test_bpe_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 3000)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    ours = bpe.WordBpe(bpe.vocabulary_path())
    for t in [*(x or "" for x in TEXTS), *ODD]:
        want = library.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == want
        assert ours.decode(want) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("piece", [1 << 20, 2000])
def test_token_digests(spark, library, monkeypatch, piece):
    monkeypatch.setattr(bpe, "PIECE", piece)
    texts = [*TEXTS, *ODD]
    df = documents(spark, texts)
    for r in bpe.token_digests(df).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r.doc_id: len(r.ids) for r in bpe.token_ids(df.where("doc_id < 9")).collect()}[5] == 4
    assert bpe.token_digests(df.limit(0)).count() == 0


def test_every_code_point_as_the_library_has_it(library):
    ours = bpe.WordBpe(bpe.vocabulary_path())
    points = [c for c in [*range(0x20000), *range(0x20000, sys.maxunicode + 1, 41)] if not 0xD800 <= c <= 0xDFFF]
    for a in range(0, len(points), 4000):
        t = "".join(f"a{chr(c)}b{chr(c)}1" for c in points[a : a + 4000])
        assert ours.encode(t) == library.encode(t, add_special_tokens=False).ids, hex(points[a])


def test_pieces_end_where_words_do(library, monkeypatch):
    """Texts without white space are cut too; null and repeated ids have rows of their own."""
    rng = random.Random(13)
    ours = bpe.WordBpe(bpe.vocabulary_path())
    for size in (1, 7, 40):
        monkeypatch.setattr(bpe, "PIECE", size)
        for _ in range(60):
            t = "".join(rng.choice(["a", "B7", "9", "'s", "!", "é", "<|endoftext|>", "1́", "don't", "3", "x" * 30]) for _ in range(40))
            assert ours.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_tokens_of_rows_without_an_id(spark, library):
    rows = [(None, "one 1"), (None, "two"), (None, None), (3, "one 1"), (3, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", chat.F.lit("x"))
    got = sorted(str((r.doc_id, r.n_tokens)) for r in bpe.token_digests(df).collect())
    assert got == sorted(str((i, len(library.encode(t or "", add_special_tokens=False).ids))) for i, t in rows)


# -- networks ---------------------------------------------------------------------------------


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_gradients():
    rng = np.random.default_rng(0)
    net = bytecnn.ByteConv((2, 4), 3, 20, 20, 2)
    net.start(rng)
    for name in ("weights",):
        net.weights = [w.astype(np.float64) for w in net.weights]
    net.out = net.out.astype(np.float64) * 5
    x, y = rng.integers(0, 4, (6, 24)).astype(np.uint8), rng.integers(0, 2, 6)

    def loss():
        net.prepare()
        tops = []
        for w, weight in zip(net.widths, net.weights):
            tops.append(sum(weight[j][x[:, j : j + 20]] for j in range(w)).max(1))
        z = np.maximum(np.concatenate(tops, 1) + net.bias, 0) @ net.out + net.out_bias
        return -np.log(bytecnn.softmax(z)[np.arange(6), y]).mean()

    grads = net._gradients(x, y)
    for p, g in zip([*net.weights, net.out], [*grads[:2], grads[3]]):
        for at in list(np.argwhere(np.abs(g) > 1e-4))[:5]:
            old, at = p[tuple(at)], tuple(at)
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            assert abs((up - loss()) / 2e-5 - g[at]) < 1e-3
            p[at] = old


def test_chunks_cover_every_byte():
    net = bytecnn.ByteConv((2, 6), 1, 50, 40, 2)
    net.start(np.random.default_rng(0))
    net.weights = [np.zeros_like(w) for w in net.weights]
    net.weights[0][0, ord("!")] = 7  # fires where a '!' stands
    net.out = np.array([[0.0, 1.0], [0, 0]], np.float32)
    net.prepare()
    for n in (1, 39, 40, 41, 49, 50, 51, 90, 91, 200):
        for at in range(n):
            text = b"." * at + b"!" + b"." * (n - at - 1)
            logits, counts = net.chunk_logits([b"", b"...", text, b""])
            own = logits[sum(counts[:2]) : sum(counts[:3]), 1]
            assert own.max() == 7 and logits[:, 1].sum() == own.sum()


def plain_logits(net, text):
    """Every chunk's logits, filter by filter and place by place."""
    out = []
    for a, z in zip(*net.windows(len(text))):
        tops = []
        for w, weight in zip(net.widths, net.weights):
            for f in range(net.filters):
                at = [sum(float(weight[j, text[p + j] if p + j < len(text) else 0, f]) for j in range(w)) for p in range(a, z)]
                tops.append(max(at) + float(net.bias[len(tops)]))
        out.append([sum(max(0, t) * float(net.out[i, c]) for i, t in enumerate(tops)) + float(net.out_bias[c]) for c in range(net.classes)])
    return out


@pytest.mark.parametrize("block", [1 << 16, 60])
def test_chunk_logits_against_plain_loops(monkeypatch, block):
    monkeypatch.setattr(bytecnn, "BLOCK", block)
    rng = np.random.default_rng(5)
    net = bytecnn.ByteConv((2, 4, 6), 3, 50, 40, 3)
    net.start(rng)
    net.bias = rng.normal(size=9).astype(np.float32)
    net.prepare()
    texts = [b"", b"a", bytes(rng.integers(0, 256, 49)), bytes(rng.integers(0, 256, 51)), b"", bytes(rng.integers(0, 256, 333)), "é ü".encode() * 20]
    logits, counts = net.chunk_logits(texts)
    want = [plain_logits(net, t) for t in texts]
    assert counts.tolist() == list(map(len, want))
    assert np.allclose(logits, np.concatenate(want), atol=1e-4)


def test_scores_against_plain_loops(spark):
    """What the queries say of whole tables, computed by itself from the same models."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).cache()
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    y = labels.select("doc_id", chat.F.col("quality").alias("y"))
    model = bytecnn.fit_quality(bytecnn.fitting_sample(docs, y, bytecnn.FIT_ROWS, bytecnn.FIT_BYTES))
    net, langs = bytecnn.fit_language(bytecnn.fitting_sample(docs, docs.select("doc_id", chat.F.col("lang").alias("y")), bytecnn.FIT_ROWS, bytecnn.FIT_BYTES))
    texts = {r.doc_id: r.text for r in docs.collect() if len(r.text or "") < 1500}
    assert len(texts) > 20
    for r in bytecnn.quality_scores(docs, labels).where(chat.F.col("doc_id").isin(list(texts))).collect():
        z = np.clip([b - a for a, b in plain_logits(model.net, (texts[r.doc_id] or "").encode())], -12, 12)
        want = 1 / (1 + np.exp(-(np.array([z.mean(), z.min(), z.max(), 1]) @ model.mix)))
        assert abs(r.score - want) < 1e-3
    for r in bytecnn.language_ids(docs).where(chat.F.col("doc_id").isin(list(texts))).collect():
        if r.lang_pred != "und":
            z = np.mean(plain_logits(net, texts[r.doc_id].encode()), 0)
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert r.lang_pred == langs[p.argmax()] and abs(r.score - p.max()) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    q = bytecnn.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert len(q) > 100 and np.mean([r.predicted == r.quality for r in q]) > 0.97
    lang = bytecnn.language_ids(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(lang) > 200 and np.mean([r.lang_pred == r.lang for r in lang]) > 0.97


def test_sample_of_long_and_repeated_texts(spark):
    """A long text is learned from too, by pieces from all of it; an id gives one text."""
    long = "".join(f"{n:07d}" for n in range(30_000))
    rows = [(0, long), (2, "short"), (2, "other"), (3, None), (None, "x"), (5, "é" * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, 1) for i in (0, 2, 3, 5, None)] + [(2, 0)], "doc_id long, y int")
    kept = [i for i in (0, 2, 5) if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    got = bytecnn.fitting_sample(df, y, 100, 4096)
    assert len(got) == len(kept) > 0 and all(len(t) <= 4096 for t, _ in got)
    by = dict(zip(kept, got))
    if 0 in by:
        t = by[0][0].decode()
        assert t[:64] == long[:64] and t[-64:] == long[-64:] and len(t) == 16 * 64 and long[105_000 // 15 * 7 :][:40]
    if 2 in by:
        assert by[2] == (b"other", 0)


def test_quality_and_language(spark):
    rng = random.Random(4)
    texts, langs, good = [], [], []
    for i in range(500):
        lang = "xy"[i % 2]
        t = prose(rng, "abcdef" if lang == "x" else "uvwxyz", rng.randrange(5, 300))
        ok = i % 5 != 0
        texts.append(t if ok else t.replace(" ", " %%% "))
        langs.append(lang)
        good.append(int(ok))
    rows = [(i, t, a, None) for i, (t, a) in enumerate(zip(texts, langs))]
    rows += [(500, None, "x", "s"), (501, "", None, "s"), (502, "123 ...", "y", "s"), (503, "é", None, "s"), (None, "abc", "x", "s"), (7, texts[7], "x", "s")]
    rows += [(504, prose(rng, "abcdef", 60_000), "x", "s"), (506, prose(rng, "uvwxyz", 60_000).replace(" ", " %%% "), "y", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([*enumerate(good), (None, 1), (3, None)], "doc_id long, quality int")
    got = bytecnn.quality_scores(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert all((__import__("zlib").crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == good[r.doc_id] for r in held]) > 0.95
    assert [r.predicted for r in got if r.doc_id in (504, 506)] == [1, 0]  # very long ones
    kept = bytecnn.keep_good(df, labels)
    assert kept.columns == df.columns
    assert bytecnn.quality_scores(df.limit(0), labels).count() == 0
    assert {r.score for r in bytecnn.quality_scores(df, labels.limit(0)).collect()} == {0.5}

    told = bytecnn.language_ids(df).collect()
    assert len(told) == len(rows)
    by = {r.doc_id: r for r in told}
    assert np.mean([by[i].lang_pred == langs[i] for i in range(500) if by[i].held_out]) > 0.95
    assert [(by[i].lang_pred, by[i].score) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[503].lang_pred in "xy" and (by[504].lang_pred, by[506].lang_pred) == ("x", "y")
    assert bytecnn.language_ids(df.limit(0)).count() == 0


def test_letters():
    assert bytecnn.has_letter("1 é") and bytecnn.has_letter("x") and not bytecnn.has_letter("½ ² 1 ́ _")


# -- licenses --------------------------------------------------------------------------------------


def slow_scan(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places, labels = [], set()
    for p, name in licenses.BASE.items():
        own = [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places += own
        labels |= {name} if own else set()
    joined, found = " " + " ".join(w) + " ", []
    for n, p, s, label, _, _, regex in licenses.rules():
        found += [(m.start(), m.end(), p, n, label, s) for m in re.finditer(regex, joined)]
    left = [
        d for d in found
        if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[0], -e[1], *e[2:4]) < (d[0], -d[1], *d[2:4]) for e in found)
    ]
    score = max([d[5] for d in left] + [0.5 if places else 0.0])
    ends = (min(places), max(places)) if places else (None, None)
    return len(w), len(places), *ends, ",".join(sorted(labels)), ",".join(sorted(labels | {d[4] for d in left})), score


LICENSES = [
    "CC-BY 4.0 cc  by\x00CC BY. All rights\nreserved", "allrights reserved éall rights reserved K cc by",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. MIT License',
    "SPDX-License-Identifier: GPL-2.0 and GNU General Public License v3 or GNU Lesser General Public License version 2.1",
    "released into the public domain; Copyright (c) 2020 X. All rights reserved. proprietary and confidential", "mit license " * 500,
]


def test_licenses(spark):
    texts = [*TEXTS, *LICENSES]
    df = documents(spark, texts)
    df = df.union(df.where("doc_id = 14"))
    got = sorted(str(tuple(r)) for r in licenses.scan_licenses(df).collect())
    assert got == sorted(str((i, *slow_scan(t))) for i, t in [*enumerate(texts), (14, texts[14])])
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    assert len(licenses.rules()) > 300


def spellings(regex):
    """All strings that a regex without unbounded repeats matches; of a range of characters the first."""

    def write(parsed):
        out = [""]
        for op, arg in parsed:
            op = str(op)
            if op == "LITERAL":
                more = [chr(arg)]
            elif op == "IN":
                more = [chr(x if str(kind) == "LITERAL" else x[0]) for kind, x in arg]
            elif op == "MAX_REPEAT":
                one = write(arg[2])
                more = [x for n in range(arg[0], arg[1] + 1) for x in (["".join(t) for t in itertools.product(one, repeat=n)])]
            elif op == "SUBPATTERN":
                more = write(arg[3])
            elif op == "BRANCH":
                more = [x for part in arg[1] for x in write(part)]
            else:
                assert op in ("ASSERT",), op  # the spaces around
                more = [""]
            out = [a + b for a in out for b in dict.fromkeys(more)]
        return out

    return write(re._parser.parse(regex))


def test_every_match_of_a_rule_holds_its_keywords():
    n = 0
    for *_, word, more, regex in licenses.rules():
        for t in spellings(regex):
            assert f" {word}" in f" {t} " and more in f" {t} ", (regex, t)
            n += 1
    assert n > 10_000


def held_against_every_rule(spark, texts):
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    want = {i: slow_scan(t)[-2:] for i, t in enumerate(texts)}
    assert {texts[i]: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    return [want[i] for i in range(len(texts))]


def test_no_match_is_lost_to_the_keywords(spark):
    """Some spellings of every rule, among them versions glued to the name and notices of one phrase."""
    rng = random.Random(7)
    texts = ["This program is licensed under GPLv3.", "License: GPLv3", "License: LGPLv2.1", "licensed under the AGPL3", "Released under the MIT", "Distributed under Apache 2.0", "available   under GPL 3", "published\nunder zlib."]
    for r in licenses.rules():
        own = spellings(r[-1])
        texts += {own[0], own[-1], rng.choice(own)}
    told = held_against_every_rule(spark, texts)
    assert [t[0] for t in told[:8]] == ["gpl-3.0", "gpl-3.0", "lgpl-2.1", "agpl-3.0", "mit", "apache-2.0", "gpl-3.0", "zlib"]
    assert all(t[0] for t in told)


def test_licenses_without_an_id(spark):
    """Rows without an id keep their own labels; very long texts and repeated rows too."""
    long = "plain words here, " * 60_000 + "Released under the MIT license. " + "and more of them " * 60_000
    rows = [(None, "License: MIT"), (None, "GPLv3 license, all rights reserved"), (None, None), (4, long), (4, long), (4, "cc by")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", chat.F.lit(1))
    got = sorted(str(tuple(r)) for r in licenses.scan_licenses(df).collect())
    assert got == sorted(str((i, *slow_scan(t))) for i, t in rows)


# -- mixing ----------------------------------------------------------------------------------------------


def pfair(weights):
    """Earliest deadline first, in plain Python."""
    total, k, out = sum(weights), [0] * len(weights), []
    for t in range(total):
        ready = [(-(-(k[i] + 1) * total // w), i) for i, w in enumerate(weights) if k[i] < w and k[i] * total // w <= t]
        i = min(ready)[1]
        k[i] += 1
        out.append(i)
    return out


def test_mixing(spark):
    weights = {"a": 5, "b": 3, "z": 2, "*": 4}
    rng = random.Random(6)
    rows = [(i, rng.choice("aaaabbz") if i % 9 else None if i % 2 else "other", 1, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, w int, mix_slot long")
    out = mixing.mix_sources(df, weights, block=4, digits=1)
    got = out.orderBy("mix_slot", "mix_pos").collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    blocks = Counter()
    order = []
    for r in got:
        if r.mix_pos == 0:
            order.append(r.mix_queue)
            assert r.mix_block == blocks[r.mix_queue]
            blocks[r.mix_queue] += 1
    queues = sorted(weights)
    # the first period is the schedule itself, and prefixes stay within one block while all queues last
    assert order[:14] == [queues[i] for i in pfair([weights[q] for q in queues])]
    lasting = min(blocks[q] // weights[q] for q in queues) * 14
    seen = Counter()
    for n, q in enumerate(order[:lasting], 1):
        seen[q] += 1
        assert all(abs(seen[x] - weights[x] * n / 14) < 1 for x in queues)
    again = mixing.mix_sources(df.repartition(7), weights, block=4, digits=1).collect()
    assert {(r.doc_id, r.mix_slot, r.mix_pos) for r in again} == {(r.doc_id, r.mix_slot, r.mix_pos) for r in got}
    assert mixing.mix_sources(df.limit(0), weights).count() == 0
    assert mixing.mixed(df, weights).columns == df.columns


def test_mixing_twice_the_same_row(spark):
    df = documents(spark)
    assert mixing.mix_sources(df.union(df)).count() == 2 * len(TEXTS)


def test_mixing_rows_without_an_id(spark):
    """They are spread like any other, and places don't depend on how rows are dealt."""
    rows = [(None if i % 3 else i, "a" if i % 2 else None, f"t{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    places = lambda d: sorted((r.mix_queue, r.mix_slot, r.mix_pos, r.text) for r in mixing.mix_sources(d, {"a": 2, "*": 1}, block=4, digits=1).collect())
    got = places(df)
    assert got == places(df.repartition(5)) and len({r[:3] for r in got}) == 900
    assert sorted(r[3] for r in got) == sorted(r[2] for r in rows)


def test_vocabulary_is_read_in_place():
    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        assert json.load(f)["model"]["type"] == "BPE"
