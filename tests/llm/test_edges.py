"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns, for every operator and pipeline stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sentier.llm import (ann_index, chat_format, decontam, license_scan, mixing, near_dedup, quality, sharding,
                         substring_dedup, token_counts)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"
LONG = " ".join(f"w{i % 977}x{i % 613}" for i in range(60_000))
WORDS = " ".join(f"word{i}" for i in range(40))
ROWS = [
    (1, WORDS, "en", "a", 1, "s", "t"), (2, WORDS, "en", "a", 1, None, None), (2, WORDS, "en", "a", 1, None, None),
    (3, None, None, None, None, None, None), (None, None, None, "b", None, None, None),
    (None, "a text of its own that nobody else has", "en", None, 3, None, None),
    (4, "", "en", "b", 0, None, None), (5, " \n\t ", "en", "b", 3, None, None), (6, LONG, "de", "a", 9, None, None),
    (7, "x" * 70_000, "de", "c", 9, None, None), (8, "short one", "fr", "c", 9, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_substring_dedup(docs, none):
    out = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.kept_digest(docs).collect()),
                 key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 40, 0, sha(WORDS)), (2, 40, 40, sha("")), (2, 40, 40, sha("")), (3, 0, 0, sha("")), (None, 0, 0, sha("")),
            (None, 9, 0, sha(ROWS[5][1])), (4, 0, 0, sha("")), (5, 0, 0, sha("")), (7, 1, 0, sha("x" * 70_000)),
            (8, 2, 0, sha("short one"))]
    assert sorted([r for r in out if r[0] != 6], key=repr) == sorted(want, key=repr)
    assert [r[1:3] for r in out if r[0] == 6] == [(60_000, 0)]  # repeats within a document stay
    assert substring_dedup.kept_digest(none).collect() == []


def test_substring_factors_meet_at_boundaries(spark):
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    # doc 3: 15 words of doc 1 right before 15 of doc 2, then a 12-word piece (too short)
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join([*a[:15], *b[5:20], "z", *a[:12]]))]
    got = {r.row.doc_id: [(s.start, s.length) for s in r.spans]
           for r in substring_dedup.duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == []
    assert got[3] == [(0, 15), (15, 15)]


def test_near_dedup(docs, none):
    out = sorted(((r.doc_id, r.class_id, r.class_size) for r in near_dedup.similar_classes(docs).collect()), key=repr)
    assert out.count((2, 1, 3)) == 2 and (1, 1, 3) in out
    assert (3, 3, 1) in out and (None, None, 1) in out and len(out) == len(ROWS)
    assert near_dedup.similar_classes(none).collect() == []
    assert near_dedup.one_per_class(docs).columns == docs.columns
    kept = [r.doc_id for r in near_dedup.one_per_class(docs).collect()]
    assert kept.count(1) == 1 and 2 not in kept and len(kept) == len(ROWS) - 2


def test_quality(spark, docs, none):
    grades = spark.createDataFrame([(1, 2), (8, 0), (8, 1), (None, 1), (6, None), (3, 2)], "doc_id long, grade int")
    model = quality.fit(docs, grades)
    out = quality.score(docs, model)
    assert out.columns[:len(docs.columns)] == docs.columns and out.count() == len(ROWS)
    assert out.where("expected_grade is null or p_top is null").count() == 0
    nobody = quality.fit(docs, grades.where("false"))
    assert quality.select_top(docs, nobody).count() == len(ROWS)
    assert quality.select_top(none, model).columns == none.columns


def test_token_counts(docs, none):
    lengths = token_counts.token_lengths(docs, ["doc_id"])
    n = {r.doc_id: r.n_tokens for r in lengths.collect() if r.doc_id is not None}
    assert n[3] == n[4] == 0 and n[6] > 60_000 and n[7] > 0
    sums = token_counts.suffix_sums(token_counts.histogram(lengths))
    total = sum(r.n_tokens for r in lengths.collect())
    by = {r.n_tokens: r for r in sums.collect()}
    assert by[0].tokens_at_least == total and by[0].docs_at_least == len(ROWS) and by[0].truncated_total == 0
    top = max(by)
    assert by[top].truncated_total == total and by[top].docs_at_least == by[top].n_docs
    lens = [r.n_tokens for r in lengths.collect()]
    for r in token_counts.at_limits(sums, [0, 5, 100, 10**6]).collect():
        assert r.kept_tokens == sum(min(x, r.context_limit) for x in lens)
    assert token_counts.quantile(sums, 0.5).first()[0] == sorted(lens)[(len(lens) + 1) // 2 - 1]
    grouped = token_counts.token_lengths(docs, ["lang"])
    per = token_counts.suffix_sums(token_counts.histogram(grouped, ["lang"]), ["lang"])
    assert per.where("lang is null").agg(F.sum("n_docs")).first()[0] == 2
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(none))).collect() == []


def test_licenses(spark, docs, none):
    mit, gpl = license_scan.NOTICES["MIT"], license_scan.NOTICES["GPL-3.0"]
    rows = [(1, "/p/LICENSE", f"{mit}\n" + WORDS, 0), (2, "/p/a/b/x.py", "no header here " * 9, 0),
            (3, "/p/a/y.py", f"first line\n  {gpl.upper()}  \n" + WORDS, 0), (4, "/q/z.py", None, 0), (5, None, "", 0),
            (6, "/p/a/COPYING", gpl, 0), (6, "/p/a/COPYING", gpl, 0), (7, "/p/c/d.py", LONG, 0), (None, "/r/s.py", gpl, 0)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string, license int")
    model = license_scan.templates(spark)
    got = {(r.file_id, r.license, r.how, r.from_dir) for r in license_scan.scan_licenses(files, model).collect()}
    assert got == {(1, "MIT", "header", None), (2, "GPL-3.0", "inherited", "/p/a/"), (3, "GPL-3.0", "header", None),
                   (4, None, "none", None), (5, None, "none", None), (6, "GPL-3.0", "file", None),
                   (7, "MIT", "inherited", "/p/"), (None, "GPL-3.0", "file", None)}
    assert license_scan.scan_licenses(files, model).count() == len(rows)
    assert license_scan.scan_licenses(files.where("false"), model).collect() == []


def test_license_wordings(spark):
    from sentier.llm.license_texts import HEADERS, OPENINGS, TEXTS
    texts = {k: v for k, v in TEXTS}  # the longest of each licence stands last
    gpl = dict(HEADERS)["GPL-3.0"].split()
    wrapped = "\n".join(" * " + " ".join(gpl[i:i + 9]) for i in range(0, len(gpl), 9))
    code = "\n" + "\n".join(f"x{i} = compute_{i}(y{i})" for i in range(60))
    cases = [
        ("// Released under the MIT License. See LICENSE in the project root for details." + code, "MIT", "header"),
        ("All rights reserved. Released under the MIT License." + code, "MIT", "header"),
        (WORDS + " Released under\n# the MIT License. " + WORDS, "MIT", "header"),
        ("# MIT License" + code, "MIT", "header"),
        ("# SPDX-License-Identifier: MIT" + code, "MIT", "header"),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later */" + code, "GPL-2.0", "header"),
        ("// SPDX-License-Identifier: Zlib" + code, "Zlib", "header"),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0)" + code, "(MIT OR Apache-2.0)", "header"),
        ("# Permission is hereby granted, free of charge, to any person obtaining a copy" + code, "MIT", "header"),
        ("/*\n" + wrapped + "\n */" + code, "GPL-3.0", "header"),
        ("/* " + texts["MIT"] + " */" + code, "MIT", "header"),
        ("Copyright (c) 2020 A. Person\n\n" + texts["BSD-3-Clause"], "BSD-3-Clause", "file"),
        ("Copyright (c) 2020 A. Person\n\n" + texts["BSD-2-Clause"], "BSD-2-Clause", "file"),
        ("MIT License\n\nCopyright (c) 2020 A. Person\n\n" + texts["MIT"], "MIT", "file"),
        (dict(OPENINGS)["GPL-3.0"] + "\n" + LONG, "GPL-3.0", "file"),
        ("nothing is licensed here, the version is 2.0" + code, None, "none"),
        ("Released under the license." + WORDS, None, "none"),
    ]
    rows = [(i, f"/d{i}/x.py", t) for i, (t, _, _) in enumerate(cases)] + [
        (1000 + i, f"/e{i}/y.py", f"the text of a file {i} under no terms is copy number {i}") for i in range(100)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    out = license_scan.scan_licenses(files, license_scan.templates(spark)).where("file_id < 1000").collect()
    # a file found both ways reports its header's cosine and states its directory's licence
    got = {r.file_id: (r.license, r.how) for r in out}
    assert {i: got[i] for i in got} == {i: (k, how) for i, (_, k, how) in enumerate(cases)}


def test_vectors(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(30)] + [
        (100, None, 0), (101, [], 0), (102, [0.0, 0.0], 0), (103, [1.0, None], 0), (104, [float("nan"), 1.0], 0),
        (105, [float("inf"), 1.0], 0), (106, [1.0], 0), (None, [1.0, 1.0], 0), (3, [3.0, 1.0], 0)]
    rows += [(200 + i, [50.0, 50.0], 0) for i in range(50)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    out = ann_index.nearest(v, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == [0, 200]
    assert got[0] == [(i, float(i)) for i in range(1, 11)]
    assert got[200] == [(200 + i, 0.0) for i in range(1, 11)]
    few = ann_index.nearest(v.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in few] == [(1, 1), (2, 2)]
    assert ann_index.nearest(v.where("false"), F.col("vec_id") == 0).collect() == []


def test_sharding(docs, none):
    tree = sharding.Tree.even()
    out = sharding.place(docs, tree, tree.grown()).collect()
    assert len(out) == len(ROWS)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
        assert r["size"] == (len(r["text"].encode()) if r["text"] is not None else 0) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in out if r["doc_id"] == 2}) == 1
    assert sharding.place(none, tree).collect() == []


def test_weight_changes_stay_in_their_subtree(spark):
    tree = sharding.Tree.even()
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    key = F.col("doc_id")
    both = rows.select(sharding.shard_of(key, tree).alias("a"), sharding.shard_of(key, tree.reweighted(5, 3.0)).alias("b"),
                       sharding.shard_of(key, tree.grown()).alias("c")).collect()
    # shard 5 gained weight: rows move only into its region (4-7), and within that region only to rack k2
    assert all(r.a == r.b or 4 <= r.b <= 7 for r in both) and any(r.a != r.b for r in both)
    assert all(r.b in (4, 5) for r in both if r.a != r.b and 4 <= r.a <= 7)
    assert all(r.c in (r.a, 16) for r in both) and any(r.c == 16 for r in both)
    counts = [sum(r.a == s for r in both) for s in range(16)]
    assert min(counts) > 150 and max(counts) < 350


def test_mixing(spark, docs, none):
    planned = mixing.plan(docs)
    got = planned.collect()
    assert len(got) == len(ROWS) and mixing.plan(none).collect() == []
    assert all(len(r.placements) <= 3 for r in got)
    rows = [(i, f"s{i % 3}", " ".join(["w"] * (1 + i % 7))) for i in range(3000)] + [(9000 + i, None, "a b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.plan(df)
    per = out.groupBy("source").agg(F.first("target").alias("t"), F.first("source_size").alias("s"),
                                    F.sum(F.col("size") * F.size("placements")).alias("taken")).collect()
    assert abs(sum(r.t for r in per) - sum(r.s for r in per)) < 1e-6
    assert all(abs(r.taken - r.t) <= r.s / 256 + 7 for r in per) and all(r.t <= 3 * r.s + 1e-9 for r in per)
    mixed = mixing.mix(out)
    assert mixed.agg(F.sum("size")).first()[0] == sum(r.taken for r in per)
    sizes = [r["count"] for r in mixing.split(mixing.quotas(mixing.targets(
        df.select(mixing.source_key(F.col("source")).alias("_key"), mixing.n_words(F.col("text")).alias("size"))))
    ).groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame(
        [(10, " ".join(f"WORD{i}," for i in range(20, 32)), 0), (11, "Short One!", 0), (11, "Short One!", 0), (12, None, 0),
         (13, "...", 0), (None, "own that nobody", 0)], "item_id long, text string, n_words int")
    out = {}
    for r in decontam.report(decontam.scan(docs, bench)).collect():
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.n_items, r.contaminated))
    assert out[1] == [(40, 12, 1, True)] and out[2] == [(40, 12, 1, True)] * 2 and out[8] == [(2, 2, 1, True)]
    assert sorted(out[None]) == [(0, 0, 0, False), (9, 3, 0, True)] and out[3] == out[4] == out[5] == [(0, 0, 0, False)]
    assert out[6] == [(60_000, 0, 0, False)]
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["3", "4", "5", "6", "7", "None"]
    spans = {r.doc_id: r.text for r in decontam.clean_spans(docs, bench).collect() if r.doc_id}
    assert spans[8] == "" and spans[1].split()[19:21] == ["word19", "word32"]
    assert decontam.scan(none, bench).collect() == []
    assert decontam.clean_documents(docs, bench.where("false")).count() == len(ROWS)


def test_large_benchmark_is_joined_by_shuffle(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(11, "short one")], "item_id long, text string")
    small = decontam.report(decontam.scan(docs, bench)).collect()
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert sorted(map(str, decontam.report(decontam.scan(docs, bench)).collect())) == sorted(map(str, small))


def test_chat(spark):
    rows = [(1, 0, "system", "be <s>kind</s>", 0), (1, 1, "user", "a\\b [INST] \\[/INST]", 0), (1, 2, "assistant", "[\\OUT] é\U0001F600", 0),
            (2, 1, "assistant", "first", 0), (2, 1, "assistant", "first", 0), (3, None, None, None, 0),
            (None, 0, "tool[ROLE]", "[/TURN]\n", 0), (4, 0, "user", LONG, 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid int")
    chats = chat_format.format_chats(turns)
    back = {r.conv_id: r for r in chats.withColumn("f", chat_format.formatted(F.col("segments")))
            .withColumn("turns", chat_format.read_back(F.col("f"))).withColumn("loss", chat_format.loss_text(F.col("segments"))).collect()}
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    for c, spoken in want.items():
        assert [(t.role, t.text) for t in back[c].turns] == spoken
        assert back[c].loss == "".join(t for r, t in spoken if r == "assistant")
    assert back[1].valid and not back[2].valid and back[2].bad_turn == 0 and not back[3].valid
    body = back[1].f
    for mark in ("<s>", "</s>", "[INST]", "[/INST]"):
        assert body.count(mark) == 1
    assert chat_format.chat_digest(chat_format.format_chats(turns.where("false"))).collect() == []


def test_pipeline_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for df in (docs, none):
            out = stage(spark, df, str(tmp_path))
            rows = out.collect()
            assert len(rows) >= 0 and (df is docs or rows == [])
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name


CLASH = ["_range", "_v", "_t", "_before", "_h", "_tag", "_node", "_n", "node", "tag", "copies", "_spans"]


def test_columns_named_like_working_columns_pass_through(spark):
    rows = [(i, f"text number {i % 3} of some words", "a", *[f"{c}{i}" for c in CLASH]) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH))
    bench = spark.createDataFrame([(1, "number 2 of")], "item_id long, text string")
    own = {r.doc_id: tuple(r[c] for c in CLASH) for r in df.collect()}
    tree = sharding.Tree.even(4, 2, 2)
    for out, n in ((near_dedup.one_per_class(df), 3), (decontam.clean_documents(df, bench), 6),
                   (decontam.clean_spans(df, bench), 9), (sharding.place(df, tree, tree.grown()), 9)):
        got = out.collect()
        assert len(got) == n and all(tuple(r[c] for c in CLASH) == own[r.doc_id] for r in got)


def test_cut_spans_leave_the_rest_as_it_was(spark):
    df = spark.createDataFrame([(1, "Hello, World! X Y. Stay; Hère? x y", 7), (2, "x, y", 8), (3, None, 9), (4, "No hit: X.\n", 1)],
                               "doc_id long, text string, spans int")
    bench = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    got = {r.doc_id: (r.text, r.spans) for r in decontam.clean_spans(df, bench).collect()}
    assert got == {1: ("Hello, World. Stay; Hère", 7), 2: ("", 8), 3: (None, 9), 4: ("No hit: X.\n", 1)}
