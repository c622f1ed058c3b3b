import random
import re

import numpy as np
import pytest

from stratoloom.llm.leakage import find_leaks
from stratoloom.llm.mixing import TOKENIZER_FOLDER, count_tokens, encoding, mix, source_plan, token_count
from stratoloom.llm.origin import classify, flag_not_handwritten, is_minified, literal_share, merkle_trees, opening_comments, shared_subtrees


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([10, 13, 30])))) for i in range(12)]
    docs = []
    for i in range(60):
        t = [rnd.choice(words) for _ in range(50)]
        if i % 3 == 0:
            src = rnd.choice(items)[1].split()
            n = rnd.choice([12, 13, 20])
            t[5:5] = src[:n]
        docs.append((i, ", ".join(t).upper(), "x"))
    docs += [(100, None, ""), (101, "", ""), (0, docs[0][1], "x"), (None, items[0][1], "")]
    grams = lambda t: {tuple(w[i : i + 13]) for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 12)}
    want = {(d, i) for d, t, _ in docs if t and d is not None for i, u in items if grams(t) & grams(u)}
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string, token string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    empty = spark.createDataFrame([], "item_id int, text string")
    assert find_leaks(spark.createDataFrame(docs, "doc_id long, text string, token string"), empty).count() == 0


SIZED = "doc_id long, source string, tokens long"
TARGETS = "source string, weight double, max_repeats int"


def test_mix_reaches_its_shares(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "big" if i < 4000 else "mid" if i < 5000 else "small", int(rng.integers(5, 60))) for i in range(5100)] + [(9000, None, 500), (9001, "none", 700), (9002, "mid", 0)]
    df = spark.createDataFrame(rows, SIZED)
    t = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.4, 3), ("small", 0.25, 4), ("absent", 0.05, 2), (None, 0.1, 1)], TARGETS)
    plan = {r.source: r for r in source_plan(df, t).collect()}
    assert {s for s, r in plan.items() if r.capped} == {"small", "absent"} or {s for s, r in plan.items() if r.capped} == {"small", "absent", "none"}
    used, shares = mix(df, t)
    u = used.collect()
    assert max(r.copies for r in u if r.source == "small") == 4 and {r.copies for r in u if r.source == "big"} == {1}
    assert max(r.copies for r in u if r.source == "mid") <= 3
    s = {r.source: r for r in shares.collect()}
    for name in ("big", "mid"):
        assert abs(s[name].tokens_used - s[name].wanted) <= 60
    assert {n for n, r in s.items() if r.exhausted} == {"small", "absent"} and abs(sum(r.share_after_caps for r in s.values()) - 1) < 1e-9
    assert abs(s["big"].share - s["big"].share_after_caps) < 0.002 and s["big"].share_after_caps > 0.3
    assert s["absent"].share == 0 and abs(sum(r.share for r in s.values()) - 1) < 1e-9
    assert {(r.doc_id, r.copies) for r in mix(df, t)[0].collect()} == {(r.doc_id, r.copies) for r in u}


def test_weighted_sampling_prefers_heavy_documents(spark):
    df = spark.createDataFrame([(i, "s", 10, 9.0 if i % 2 else 1.0) for i in range(2000)] + [(5000, "r", 20000, 1.0)], SIZED + ", w double")
    used = mix(df, spark.createDataFrame([("s", 0.125, 1)], TARGETS), weight_col="w")[0].collect()
    heavy = sum(r.doc_id % 2 for r in used if r.source == "s")
    assert len(used) == 500 and heavy > 400


def test_mix_of_nothing(spark):
    used, shares = mix(spark.createDataFrame([], SIZED), spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert used.count() == 0 and shares.first().share == 0


@pytest.mark.skipif(not __import__("os").path.exists(f"{TOKENIZER_FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "x" * 250_000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in count_tokens(df, ("doc_id",)).collect()}
    enc = encoding(TOKENIZER_FOLDER)
    assert got[1] == len(enc.encode_ordinary("hello world")) and got[2] == got[3] == 0 and got[4] == len(enc.encode_ordinary("x" * 250_000))


@pytest.mark.skipif(not __import__("os").path.exists(f"{TOKENIZER_FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
def test_token_counts_have_no_switch():
    enc = encoding(TOKENIZER_FOLDER)
    for text in ["one word more " * 8000, "some/text, it's here\n" * 20_000, "a" * 4000 + " " * 5000 + "b", " " * 6000, "\n" * 4095 + "x", "x" + "\n \t" * 3000 + "'s y", "it" + " " * 4096 + "'s 12", "a" + "\u3000" * 5000 + "\u4e2d"]:
        assert token_count(enc, text) == len(enc.encode_ordinary(text)), text[:40]
    # a run of white space for which the word pattern runs out of stack
    assert token_count(enc, "a" + " " * 2_000_000 + "b") > token_count(enc, "a" + " " * 1000 + "b")


def test_inclusion_follows_the_wanted_probabilities(spark):
    n, want = 400, 100
    df = spark.createDataFrame([(i, "s", 10, 3.0 if i < 100 else 1.0) for i in range(n)] + [(9999, "rest", 6000, 1.0)], SIZED + ", w double").coalesce(1)
    t = spark.createDataFrame([("s", want * 10 / (n * 10 + 6000), 1)], TARGETS)
    hits, rounds = np.zeros(n), 8
    for seed in range(rounds):
        for r in mix(df, t, seed=seed, weight_col="w")[0].collect():
            hits[r.doc_id] += 1
    # 100 of weight 3 and 300 of weight 1: the chances are 1/2 and 1/6
    assert abs(hits.sum() / rounds - want) < 1.5
    assert abs(hits[:100].mean() / rounds - 0.5) < 0.06 and abs(hits[100:].mean() / rounds - 1 / 6) < 0.03


def test_origin_rules():
    assert classify("a/b_pb2.py", "python", None) == "generated" and classify("x/package-lock.json", "json", "{}") == "generated"
    assert classify("src/a.py", "python", "#!/usr/bin/python\n# Code generated by foo. DO NOT EDIT.\nx = 1\n") == "generated"
    assert classify("src/a.rs", "rust", "/*\n * machine written, source: x.tmpl\n */\nfn a() {}\n") == "generated"
    for text in ("// Reads the auto-generated file of x.\nfn a() {}\n", "# Replaces the old generated code of y, now kept by hand.\n", "// ids are generated by the slot service\n", "// Licensed to the x group.\n", "x = 1\n# Code generated by foo. DO NOT EDIT.\n"):
        assert classify("src/a.x", "rust", text) is None, text
    assert classify("web/app.min.js", "javascript", None) == "minified"
    assert classify("web/app.js", "javascript", "function a(b){return b&&c.d(e)}" * 60) == "minified"
    assert not is_minified("let a = 1;\n" * 100) and not is_minified("")
    assert classify("web/node_modules/x/y.js", "javascript", None) == "vendored" and classify("vendor/p/y.go", "go", None) == "vendored"
    assert classify("app/billing/vendor/x/y.go", "go", "package x\n") is None
    assert classify("lib/util/a.py", "python", "# Imported from p release 1.2; send fixes upstream.\nx = 1\n") == "vendored"
    assert classify("src/t.py", "python", "T = [\n" + "  1.5, 2.25, -3.125,\n" * 50 + "]\n") == "data"
    assert classify("src/t.py", "python", "def f(a):\n  return a\n" * 20 + "T = [1, 2, 3, 4, 5]\n") is None
    assert classify(None, None, None) is None and classify("c/a.json", "json", '{"a": [1, 2, 3]}') is None
    assert opening_comments("\n// a\n/* b\n * c */\nx // d") == ["a", "b", "c"] and literal_share("", "python") == 0


def test_merkle_and_flags(spark):
    files = [
        (1, 1, "core/thing/pkg/a.py", "python", "# x\nprint(1)\n", 1), (2, 1, "core/thing/pkg/s/b.py", "python", "print(2)\n", 1), (3, 2, "util/pkg/z.py", "python", "# y\nprint(1)\n", 1), (4, 2, "util/pkg/s/q.py", "python", "print(2)\n", 1),
        (5, 3, "own/pkg/z.py", "python", "print(1)\n", 1), (6, 3, "src/own.py", "python", "print(3)\n", 1), (6, 3, "src/own.py", "python", "# Code generated by x. DO NOT EDIT.\n", 0), (7, 4, None, None, None, None), (8, None, "a/b.py", "python", "", 2),
    ]
    df = spark.createDataFrame(files, "file_id long, project_id int, relative_path string, language string, content string, indexed_at int")
    pr = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r2"), (4, None)], "project_id int, git_root_commits string")
    got = {r.file_id: (r.origin, r.shared_by) for r in flag_not_handwritten(df, pr).collect()}
    # packages in directories of neutral names; file 5 is a copy of one file of the package only
    assert got == {**dict.fromkeys((1, 2, 3, 4), ("vendored", 2)), **dict.fromkeys((5, 6, 7, 8), (None, 0))}
    assert flag_not_handwritten(df.where("false"), pr).count() == 0


def test_what_many_have_without_copying_is_not_vendored(spark):
    schema = "file_id long, project_id int, relative_path string, language string, content string, indexed_at int, duplicate_of_file_id long"
    rows = [(1, 1, "legal/LICENSE", "text", "free for all", 1, None), (2, 2, "legal/LICENSE", "text", "free for all", 1, None)]
    rows += [(3, 1, "a/__init__.py", "python", "", 1, None), (4, 2, "b/__init__.py", "python", "# b\n", 1, None)]
    rows += [(5, 1, "c/x.go", "go", "package x\n", 1, None), (6, 2, "copy/x.go", "go", "package x\n", 1, 5)]
    rows += [(7, 1, "d/y.go", "go", None, 1, None), (8, 2, "d/y.go", "go", None, 1, None), (9, 1, "top.go", "go", "package t\n", 1, None), (10, 2, "top.go", "go", "package t\n", 1, None)]
    pr = spark.createDataFrame([(1, "r1"), (2, "r2")], "project_id int, git_root_commits string")
    assert {r.origin for r in flag_not_handwritten(spark.createDataFrame(rows, schema), pr).collect()} == {None}
    # the same file without the index's word that it is a copy
    assert {r.file_id for r in flag_not_handwritten(spark.createDataFrame([(*r[:6], None) for r in rows], schema), pr).collect() if r.origin} == {5, 6}


def test_merkle_hash_depends_on_the_tree_only(spark):
    rows = [(1, "a/x/f", 5), (1, "a/x/g", 6), (2, "b/x/g2", 6), (2, "b/x/f2", 5), (3, "c/y/f", 5), (3, "c/y/g", 7)]
    t = merkle_trees(spark.createDataFrame(rows, "project_id int, relative_path string, fingerprint long"))
    h = {(r.project_id, r.dir): r.hash for r in t.collect()}
    assert h[1, "a/x"] == h[2, "b/x"] != h[3, "c/y"] and h[1, "a"] == h[2, "b"] != h[3, "c"]
    pr = spark.createDataFrame([(1, None), (2, None), (3, None)], "project_id int, git_root_commits string")
    assert {(r.project_id, r.dir) for r in shared_subtrees(t, pr).collect()} == {(1, "a"), (1, "a/x"), (2, "b"), (2, "b/x")}


def test_opening_comments_of_long_lines():
    pad = "x " * 2000
    assert opening_comments(f"/* {pad}*/\nlet code\n// generated by a\n") == [pad.strip()]
    assert opening_comments(f"/*\n{pad}do */\n// b\ncode") == ["", f"{pad}do", "b"]
    assert classify("a/b.js", "javascript", f"/* {pad}; upstream release 3 */\nlet a = 1\n") == "vendored"
    assert classify("a/b.js", "javascript", f"/* {pad}*/ let a = 1\n// generated by hand\n") is None
