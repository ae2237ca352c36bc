"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing
column names."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Row

from loanlife.llm import (contamination, fixity, licenses, near_duplicates, pieces, quality,
                          quotations, repeats, syncmers, wordpieces)
from loanlife.llm.components import components
from loanlife.llm.wordpieces import Automaton, greedy

EMPTY = hashlib.sha256(b"").hexdigest()


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(20)]
    star = [(100, i) for i in range(101, 140)]
    edges = spark.createDataFrame(path + star + [(50, 50)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 140)}}


def test_near_duplicates(spark, edges, no_rows):
    rows = near_duplicates.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    by = {(r.doc_id, r.n_shingles): r for r in rows}
    assert by[2, 0].component_id == 2 and by[3, 0].kept and by[4, 0].component_id == 4
    assert by[5, 1].component_id == by[6, 1].component_id == 5 and not by[6, 1].kept
    assert by[7, 4].component_id == 1 and not by[7, 4].kept and by[7, 2].component_id == 7
    assert by[9, 29_997].component_id == by[8, 29_996].component_id == 8
    assert by[11, 1].component_id == 11 and by[12, 1].component_id == 12
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert near_duplicates.near_duplicates(no_rows).collect() == []


def test_near_duplicates_inside_open_pools(spark):
    """A group in which few members reach the leader: blocks must find every other link."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(700):
        words = list(base)
        for p in rng.choice(120, rng.integers(0, 7), replace=False):
            words[p] = f"x{rng.integers(1_000_000)}"
        texts.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(
        spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[j:j + 5]) for j in range(116)} for _, t in texts]
    root = list(range(700))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(700):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: top(i) for i in range(700)}


def test_repeats(spark, edges, no_rows):
    rows = repeats.repeat_report(edges).collect()
    assert len(rows) == edges.count()
    for r in rows:
        if r.doc_id in (8, 9):
            assert r.n_removed == 30_000
            assert r.kept_sha256 == (EMPTY if r.doc_id == 8 else hashlib.sha256(b"end").hexdigest())
        else:
            assert r.n_removed == 0 and r.spans == []
    assert repeats.repeat_report(no_rows).collect() == []
    cut = repeats.remove_repeats(edges)
    assert cut.schema == edges.schema
    kept = {(r.doc_id, r.text) for r in cut.collect()}
    assert (8, "") in kept and (9, "end") in kept and (2, None) in kept and (None, None) in kept
    assert repeats.remove_repeats(no_rows).collect() == []


def test_repeats_of_many_rows_under_one_id(spark):
    """Null and equal ids: every row is judged by its own text, copies lose the same words."""
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(None if k % 2 else 5, f"own{k} {shared} end{k}") for k in range(300)]
    rows += [(None, "same " * 20 + shared)] * 50 + [(None, None)] * 20 + [(5, "few words")] * 20
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = repeats.repeat_report(frame).collect()
    assert len(got) == len(rows)
    assert sorted(r.n_removed for r in got) == [0] * 40 + [40] * 300 + [60] * 50
    kept = repeats.remove_repeats(frame).collect()
    assert sorted(str(r.text) for r in kept) == sorted(
        [f"own{k} end{k}" for k in range(300)] + [""] * 50 + ["None"] * 20 + ["few words"] * 20)


def test_repeats_against_brute_force(spark):
    rng = np.random.default_rng(5)
    passages = [[f"p{k}_{i}" for i in range(n)] for k, n in enumerate((34, 35, 36, 50, 80, 120))]
    docs = []
    for d in range(60):
        words = []
        for _ in range(rng.integers(1, 5)):
            words += [f"u{d}_{rng.integers(10**9)}" for _ in range(rng.integers(0, 20))]
            p = passages[rng.integers(len(passages))]
            a = rng.integers(0, 10)
            words += p[a:len(p) - rng.integers(0, 10)]
        docs.append((d, " ".join(words) + " tick" * int(rng.integers(0, 60))))
    where = {}
    for d, t in docs:
        w = t.split()
        for i in range(len(w) - 34):
            where.setdefault(tuple(w[i:i + 35]), []).append((d, i))
    gone = {d: set() for d, _ in docs}
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + 35))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for r in repeats.repeat_report(frame).collect():
        w = dict(docs)[r.doc_id].split()
        kept = [x for i, x in enumerate(w) if i not in gone[r.doc_id]]
        assert r.n_removed == len(gone[r.doc_id])
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    for r in repeats.remove_repeats(frame).collect():
        assert r.text.split() == [x for i, x in enumerate(dict(docs)[r.doc_id].split())
                                  if i not in gone[r.doc_id]]


def test_contamination(spark, edges, no_rows):
    items = spark.createDataFrame(
        [(1, "ONE two three four five six seven eight"), (2, "word"), (3, None), (4, ""), (5, "a b c d"),
         (6, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 nothing"), (1, "ONE two three four five six seven "
          "eight"), (None, "no id at all here")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id or -1, r.n_common, r.n_item)
                 for r in contamination.find_items(edges, items).collect())
    assert got == sorted([(1, 1, 4, 4), (7, 1, 4, 4), (7, 1, 4, 4), (5, 2, 1, 1), (6, 2, 1, 1),
                          (11, 5, 1, 1), (8, 6, 7, 8), (9, 6, 7, 8), (-1, -1, 1, 1)])
    clean = contamination.without_items(edges, items)
    assert clean.schema == edges.schema
    assert sorted((r.doc_id or -1 for r in clean.collect())) == [-1, 2, 3, 4, 7, 10, 12]
    none = no_rows.withColumnRenamed("doc_id", "item_id")
    assert contamination.find_items(edges, none).collect() == []
    assert contamination.without_items(edges, none).count() == edges.count()
    assert contamination.find_items(no_rows, items).collect() == []


def test_contamination_in_blocks_and_long_documents(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", 3)
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"i{i}_{j}" for j in range(n)))
             for i, n in enumerate((5, 6, 9, 13, 20, 37, 70, 150, 400))]
    docs, want = [], set()
    for d in range(40):
        words = [f"d{d}_{k}" for k in range(rng.integers(0, 6_000))]
        i = int(rng.integers(len(items)))
        part = items[i][1].split()
        cut = int(rng.integers(0, max(1, len(part) // 3)))
        at = int(rng.integers(0, len(words) + 1))
        kept = part[cut:]
        docs.append((d, " ".join(words[:at] + kept + words[at:])))
        if 100 * max(len(kept) - 4, 0) >= 75 * (len(part) - 4):
            want.add((d, i))
    got = contamination.find_items(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces(spark, edges, no_rows, model):
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = pieces.encode(edges, model).collect()
    digests = pieces.encoding_digests(edges, model).collect()
    assert len(rows) == len(digests) == edges.count()
    source = {r.doc_id: r.text for r in edges.where("doc_id <> 7 and doc_id is not null").collect()}
    for r in rows:
        text = source.get(r.doc_id, "skip")
        if text == "skip":
            continue
        assert r.ids == lib.encode(text or "")
        data = (text or "").encode()
        joined = b"".join(data[a:b] for a, b in zip(r.begins, r.ends, strict=True))
        assert joined == data  # spans in order, without gaps
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(edges, model), model).collect()}
    assert back[1] == source[1] and back[2] == "" and back[10] == source[10].replace("▁", " ")
    assert pieces.encode(no_rows, model).collect() == []
    assert pieces.encoding_digests(no_rows, model).collect() == []


def test_pieces_of_odd_texts(model):
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    own = pieces.Encoder(model)
    rng = np.random.default_rng(1)
    parts = ["a", "b", "the", " ", "  ", "▁", "\n", "é", "日", "𠮷", "%", "1", "ing", "\t", "<unk>", "�",
             "x" * 60, "\u0000"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(800)]
    rows = own.encode_rows(texts)
    for text, (got, first, last), data in zip(texts, rows, own.decode_rows([r[0] for r in rows])):
        ids = lib.encode(text)
        assert got.tolist() == ids
        assert (first.tolist(), last.tolist()) == own.encode_spans(text)[1:]
        assert own.model.decode(ids) == lib.decode(ids) == data.decode()


def test_character_map_and_offsets():
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", escape_whitespaces=False,
                                                add_dummy_prefix=False,
                                                remove_extra_whitespaces=False)
    spec = next(v for n, v in pieces._fields(lib.serialized_model_proto()) if n == 3)
    charsmap = next(v for n, v in pieces._fields(spec) if n == 2)
    own = pieces.Normaliser(charsmap, False, False, False)
    for text in ("ﬁne ①② ｶﾞ", "Ａ　Ｂ", "é ㍿", "plain", "a​b"):
        chars, begins, ends = own(text)
        assert chars == lib.normalize(text)
        assert len(begins) == len(ends) == len(chars)
        data = text.encode()
        for c, a, b in zip(chars, begins, ends, strict=True):
            if data[a:b].isascii():
                assert data[a:b].decode() == c
    single = pieces.Normaliser(b"", True, True)
    assert single("  a   b ")[0] == "▁a▁b"


def test_wordpieces(spark, edges, no_rows):
    rng = np.random.default_rng(4)

    def some(n):
        return sorted({"".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(n)})
    for _ in range(30):
        begin, go_on = some(12), some(12)
        automaton = Automaton(begin, go_on)
        for _ in range(300):
            word = "".join(rng.choice(list("abc"), rng.integers(1, 12)))
            assert automaton.count(word) == len(greedy(word, set(begin), set(go_on)) or [])
    got = {r.doc_id: r for r in wordpieces.token_counts(edges, ["w", "word"], ["o", "1"]).collect()}
    assert (got[2].n_words, got[2].n_tokens, got[4].n_tokens) == (0, 0, 0)
    assert (got[5].n_tokens, got[5].n_unknown) == (1, 0)
    assert (got[6].n_tokens, got[6].n_unknown) == (1, 1)
    assert got[8].n_words == 30_000
    assert wordpieces.token_counts(no_rows, ["a"], ["b"]).collect() == []


def test_syncmers(spark, edges, no_rows):
    rows = syncmers.fingerprints(edges).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows if r.doc_id != 7}
    assert by[2].n_chars == 0 and by[2].fingerprint == "" and by[2].edited_sha256 == EMPTY
    assert by[8].n_chars == len(" ".join(f"w{i}" for i in range(30_000)))
    assert by[1].fingerprint == next(r.fingerprint for r in rows if r.doc_id == 7 and r.n_chars == 39)
    assert syncmers.fingerprints(no_rows).collect() == []
    alone = syncmers.fingerprints(edges.where("doc_id = 8")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    found = syncmers.anchors(edges.where("doc_id in (1, 2)")).collect()
    assert found and all(r.doc_id == 1 for r in found)


def test_anchors_are_free_of_context():
    inner = "the passage that stands in both of the documents"
    a = syncmers._points("something before it " + inner + " and after")
    b = syncmers._points("x" + inner + "y")
    at_a, hash_a = syncmers.closed_syncmers(a)
    at_b, hash_b = syncmers.closed_syncmers(b)
    mine = {(p - 20, h) for p, h in zip(at_a.tolist(), hash_a.tolist()) if 20 <= p <= 20 + len(inner) - 8}
    other = {(p - 1, h) for p, h in zip(at_b.tolist(), hash_b.tolist()) if 1 <= p <= 1 + len(inner) - 8}
    assert mine == other and mine


def test_quality(spark, edges, no_rows):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (5, 0, 1), (8, 1, 0), (99, 1, 0),
                                    (None, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(edges, labels)
    rows = quality.score_rows(edges, model).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (2, 3)}.__len__() == 1
    assert all(not r.held_out for r in rows if r.doc_id is None)
    with pytest.raises(ValueError):
        quality.score(edges, model)     # has a column "score"
    scored = quality.score(edges, model, out="chance", verdict="good")
    assert scored.columns.count("score") == 1 and scored.count() == edges.count()
    nothing = quality.train(edges, labels.where("false"))
    assert {r.score for r in quality.score_rows(edges, nothing).collect()} == {0.5}
    assert quality.score_rows(no_rows, model).collect() == []


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4_000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3_000], y[:3_000], rounds=10, pairs=2)
    p = model.score(x[3_000:])
    assert (0, 1) in model.pairs and ((p > 0.5) == (y[3_000:] > 0.5)).mean() > 0.95


NOTICES = {
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     https://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": "// SPDX-License-Identifier: AGPL-3.0-or-later\nint x;",
    "BSD-3-Clause": "# SPDX-License-Identifier: BSD-3-Clause",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def test_licenses_of_common_notices(spark):
    rows = [(i, f"Some words before.\n{text}\n\nAnd after.", name)
            for i, (name, text) in enumerate(NOTICES.items())]
    docs = spark.createDataFrame(rows, "doc_id int, text string, license string")
    got = sorted((r.doc_id, r.license) for r in licenses.find_licenses(docs).collect())
    assert got == [(i, name) for i, name in enumerate(NOTICES)]


def test_licenses(spark, no_rows):
    rows = [(1, "x\n * Permission is hereby granted, free of charge\n" * 2), (2, None), (3, ""),
            (4, "\n".join("# " + line for name in ("apache2_notice", "apache2_copy", "apache2_see")
                          for line in licenses.SENTENCES[name][1 if name != "apache2_see" else 0]
                          .replace(", ", ",\n").split("\n"))),
            (5, "Released under the MIT License.\nReleased under the MIT License."),
            (5, "Released under the MIT License.\nReleased under the MIT License."),
            (None, "text before\nLicensed under CC BY-NC 4.0.\nand after"),
            (6, "You should have received a copy of the GNU General Public License along with this "
                "program."), (7, "the " * 20_000 + "\n" + "Licensed under CC BY 4.0.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.ordinal, r.license)
                 for r in licenses.find_licenses(docs).collect())
    assert got == [(-1, 0, "CC-BY-NC-4.0"), (4, 0, "Apache-2.0"), (5, 0, "MIT"), (5, 0, "MIT"),
                   (5, 1, "MIT"), (5, 1, "MIT"), (6, 0, "unmatched"), (7, 0, "CC-BY-4.0")]
    assert licenses.find_licenses(no_rows).collect() == []


def test_fixity(spark):
    rows = [(a, o, f"d{a}_{o}") for a in range(3) for o in range(0, 300_000, 700)]
    primary = spark.createDataFrame(rows + [(None, 5, "x"), (1, None, "y")],
                                    "archive long, offset long, digest string")
    changed = {(0, 700): "bad", (2, 299_600): None}
    other = [(a, o, changed.get((a, o), d)) for a, o, d in rows if (a, o) != (1, 1_400)]
    replica = spark.createDataFrame(other + [(1, 1_401, "new"), (7, 0, "more")], primary.schema)
    got = {(r.archive, r.offset): r.status for r in fixity.audit(primary, replica, 4_096, 4).collect()}
    assert got == {(0, 700): "altered", (2, 299_600): "altered", (1, 1_400): "missing",
                   (1, 1_401): "extra", (7, 0): "extra"}
    assert fixity.audit(primary, primary).collect() == []
    assert fixity.audit(primary.limit(0), primary.limit(0)).collect() == []
    twice = primary.union(primary)
    assert fixity.audit(twice, twice).collect() == []
    assert fixity.audit(twice.where("archive = 0"), primary.where("archive = 0")).count() == 429


def test_page_layout(spark):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame([(1, "u", "é"), (2, None, None), (None, "v", "x"), (1, "u", "é"),
                                   (2_500, "w", "y" * 200_000)], "page_id long, url string, html string")
    got = fixity.layout(pages, {"a": F.col("html"), "b": F.lit("z")}).collect()
    first = sorted((r.offset, r.n_bytes) for r in got if r.archive == 0)
    assert [o for o, _ in first] == [0, first[0][1], first[0][1] + first[1][1]]
    assert {r.archive for r in got} == {-1, 0, 2}
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: u\r\nContent-Length: 2\r\n\r\n\xc3\xa9\r\n\r\n"
    assert sum(r.a == hashlib.sha256(record).hexdigest() for r in got) == 2


def test_quotations(spark):
    rows = [(1, 0, "First message.\nTwo lines."), (1, 1, "On Monday A wrote:\n> First  MESSAGE.\n> Two lines."
             "\nAnswer one."), (1, 2, "> Answer one.\n>> First message.\n> > Two lines.\nDeeper"),
            (1, 3, "> Two lines.\nTo the first"), (2, 0, "> First message.\n> Two lines.\nfrom afar"),
            (2, 1, "> never said\nlost"), (2, 2, ">\n> \nblank quote"), (2, 3, None), (None, 0, "x"),
            (3, None, "> x"), (2, 1, "> never said\nlost")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr(
        "*", "1 AS level", "2 AS ordinal", "3 AS root_turn")
    got = quotations.conversations(messages).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].body == "Answer one." and by[1, 1].parent_turn == 0
    assert (by[1, 2].parent_turn, by[1, 2].root_turn, by[1, 2].depth) == (1, 0, 2)
    assert (by[1, 2].n_quotes, by[1, 2].n_linked, by[1, 2].body) == (2, 2, "Deeper")
    assert (by[1, 3].parent_turn, by[1, 3].depth) == (0, 1)
    assert (by[2, 0].parent_turn, by[2, 0].n_quotes, by[2, 0].n_linked) == (None, 1, 1)
    assert (by[2, 1].n_quotes, by[2, 1].n_linked) == (1, 0) and by[2, 2].n_quotes == 0
    assert by[2, 3].body == "" and by[None, 0].depth == 0 and by[3, None].parent_turn is None
    links = {(r.conv_id, r.turn, r.level, r.to_conv, r.to_turn)
             for r in quotations.quote_links(quotations.parse(messages)).collect()}
    assert (1, 2, 2, 1, 0) in links and (2, 0, 1, 1, 0) in links and (2, 1, 1, None, None) in links
    assert quotations.conversations(messages.limit(0)).collect() == []


def test_quotation_of_another_conversation_when_the_first_origin_is_ones_own(spark):
    rows = [(1, 1, "> shared words\nreply"), (1, 5, "shared words"), (2, 3, "shared words"),
            (2, 0, "shared words"), (3, 0, "> shared words\nyes"), (4, 0, "> only later\nno"),
            (4, 1, "only later")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    links = {(r.conv_id, r.turn, r.to_conv, r.to_turn)
             for r in quotations.quote_links(quotations.parse(messages)).collect()}
    assert links == {(1, 1, 2, 0), (3, 0, 1, 5), (4, 0, None, None)}
    counts = {(r.conv_id, r.turn): r.n_linked for r in quotations.conversations(messages).collect()}
    assert counts[1, 1] == counts[3, 0] == 1 and counts[4, 0] == 0


def test_long_threads(spark):
    rows = [(1, i, f"message {i}" + (f"\n> message {i - 1}" if i else "")) for i in range(40)]
    got = quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    assert [(r.turn, r.root_turn, r.depth) for r in got.collect()] == [(i, 0, i) for i in range(40)]
    assert isinstance(got.first(), Row)
