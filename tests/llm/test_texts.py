import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing as mx
from quillon.llm import tokens as tk
from quillon.llm import truncation as tr
from quillon.llm.queries import TOKENIZERS, vocabulary

TEXTS = ["", None, " ", "Hello  world's \n\n 123abc", "naïve Übergrößenträger 这部电影的配乐非常动人 👍🏽", "a" * 900, "x y z\t\r\n", "<|endoftext|> don't WE'LL", "Hello  world's \n\n 123abc", "ﷺ‍﻿", "!!!???...---" * 40]


def test_encode_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(i if i != 3 else None, x, "c") for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id bigint, text string, ids string")
    got = {r.id: list(r.ids) for r in tk.encode(df, "id", "text", vocabulary()).collect()}
    assert len(got) == len(TEXTS)
    for i, x, _ in rows:
        assert got[i] == t.encode(x or "", add_special_tokens=False).ids
    back = {r.id: r.t for r in tk.encode(df, "id", "text", vocabulary()).select("id", tk.decode(F.col("ids"), vocabulary()).alias("t")).collect()}
    assert all(back[i] == (x or "") for i, x, _ in rows)
    assert tk.encode(df.limit(0), "id", "text", vocabulary()).count() == 0


def test_heap_merges_like_one_at_a_time():
    ranks = vocabulary().ranks
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40, 300):
        w = bytes(rng.choice([97, 98, 101, 110, 116, 32, 195, 169], n).tolist())
        parts = [w[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            r = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:], strict=False)]
            i = int(np.argmin(r))
            if r[i] == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert tk.merge_with_heap(w, ranks) == [ranks[p] for p in parts]


def test_mixing(spark):
    rng = np.random.default_rng(2)
    docs = [(i, ["Big", "big ", "small", None][int(rng.choice(4, p=[0.6, 0.2, 0.15, 0.05]))], int(rng.integers(0, 50)), float(rng.random())) for i in range(2000)]
    df = spark.createDataFrame(docs + [(None, "big", 5, 1.0)], "doc_id bigint, source string, tokens int, weight double")
    total = sum(d[2] for d in docs) + 5
    t = spark.createDataFrame([(1, "big", 0.5, 1, 0.4), (1, "small", 0.5, 3, 0.4), (2, "small", 1.0, 2, 5.0), (3, "none", 1.0, 2, 1.0), (4, None, 1.0, 1, 1.0)], "plan_id int, source string, target_share double, max_repeats int, size_ratio double")
    cap = {(1, "big"): 1, (1, "small"): 3, (2, "small"): 2}
    used = mx.mix(df, t).collect()
    assert len({(r.plan_id, r.doc_id) for r in used}) == len(used) and all(1 <= r.copies <= cap[r.plan_id, r.source] for r in used)
    rep = {(r.plan_id, r.source): r for r in mx.report(df, t).collect()}
    for s in ("big", "small"):
        assert abs(rep[1, s].reached_tokens - 0.2 * total) <= 25 and abs(rep[1, s].reached_share - 0.5) < 0.01
    own = sum(d[2] for d in docs if d[1] == "small")
    assert rep[2, "small"].reached_tokens == 2 * own and rep[2, "small"].open_tokens > 0 and rep[3, "none"].reached_tokens == 0
    assert sorted(map(tuple, mx.mix(df.repartition(7), t).collect())) == sorted(map(tuple, used))  # repeatable
    weights = {d[0]: d[3] for d in docs}
    taken = np.mean([weights[r.doc_id] for r in used if r.source == "big"])
    assert taken > np.mean([d[3] for d in docs if d[1] in ("Big", "big ")]) + 0.03  # weights tell
    assert mx.mix(df.limit(0), t).count() == 0 and mx.mix(df, t.limit(0)).count() == 0


SENTENCES = ["The quiet harbor town slowly turned against the old captain.", "A hidden ledger was found beneath the northern railway station.", "Nobody believed the young apprentice until the bridge collapsed.", "Honestly, the second act is what makes this story memorable."]


def corpus():
    rng = np.random.default_rng(3)
    words = ["amber", "silver", "broken", "forgotten", "reckless", "tender", "distant"]
    docs = []
    for i in range(400):
        s = [SENTENCES[j].replace("old", words[int(rng.integers(7))]).replace("young", words[int(rng.integers(7))]) for j in rng.integers(0, 4, rng.integers(2, 5))]
        docs.append(" ".join(s))
    return docs


def test_truncation(spark):
    docs = corpus()
    rows = [(i, t, "Tale" if i % 2 else "tale ") for i, t in enumerate(docs)]
    cut = {}
    for i in range(0, 400, 10):
        t = docs[i]
        n = len(t) - 5 - i % 13
        if t[n - 1] in ".," or t[n - 1 : n + 1].strip() == "" or t[:n].rstrip().endswith("."):
            n -= 3
        cut[i] = t[:n] + ["", "", "…", " (more)"][i // 10 % 4]
    rows = [(i, cut.get(i, t), s) for i, t, s in rows]
    rows += [(1000, None, "tale"), (1001, "", "tale"), (1002, " \n", None), (None, docs[1], "tale"), (1003, docs[3], None), (1003, docs[3], None)]
    rows += [(2000 + i, f"label {w} box {i}", "tag") for i, w in enumerate(["red", "blue", "green", "gray"] * 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("id", F.lit("x"))
    found = {r.doc_id for r in tr.truncated(df, "doc_id", "text", "source").collect()}
    assert found <= set(cut) and len(found & set(cut)) >= 0.95 * len(cut)
    rep = {r.source: r for r in tr.truncation_report(df, "doc_id", "text", "source").collect()}
    assert rep["tale"].truncated == len(found) and rep["tag"].truncated == 0 and rep["tag"].texts == 40
    assert tr.truncated(df.limit(0), "doc_id", "text", "source").count() == 0


def test_cuts_that_repeat_are_no_habit(spark):
    rng = np.random.default_rng(9)
    vocabulary = [a + b for a in ("bar", "len", "mok", "sil", "tor") for b in ("dan", "fel", "gim", "nus", "pry", "vot")]
    begin = lambda: " ".join(["Then", *rng.choice(vocabulary, 30)]) + ". "  # noqa: E731  no copies
    rows = [(i, begin() + docs) for i, docs in enumerate(corpus())]
    cut, words = {}, SENTENCES[0].split(" ")
    for i in range(40):  # a few spots, each of them often
        cut[1000 + i] = begin() + [" ".join(words[: 2 + i % 5]) + " because", SENTENCES[1][:26] + ["", "", "", " (more)", "… Read more"][i // 2 % 5]][i % 2]
    df = spark.createDataFrame([(i, t, "tale") for i, t in [*rows, *cut.items()]], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in tr.truncated(df, "doc_id", "text", "source").collect()} == set(cut)


def test_marks_are_no_words():
    for mark in ("", "...", " (more)", "… Read more", "[...]", "&#82"):
        assert tr.read("A hidden led" + mark)[0] == ["a", "hidden", "led"]
    assert tr.read("Read more")[0] == ["read", "more"]


def test_copies_that_go_on(spark):
    long = " ".join(SENTENCES[:3])
    texts = [(1, long), (2, long[:-20]), (3, SENTENCES[0] + " " + SENTENCES[1]), (4, "short"), (5, long.upper())]
    texts += [(6, long[:50]), (7, SENTENCES[0] + " " + SENTENCES[1] + " And then")]  # little left; no copy
    assert cut_ids(spark, texts) == {2, 6}


def cut_ids(spark, texts):
    df = spark.createDataFrame([(str(i).encode(), "s", t) for i, t in texts], "id binary, source string, text string")
    return {int(bytes(r.id)) for r in tr.cut_copies(tr.read_all(df)).collect()}


def test_beginnings_are_hashed_in_one_pass():
    rng = np.random.default_rng(4)
    low = rng.permutation(40) + 1  # texts that begin alike have equal hashes
    start = np.repeat([0, 15, 16], [15, 1, 24])
    h = tr._beginnings(low, start)
    same = tr._beginnings(low[16:30], np.zeros(14, int))
    assert (h[16:30] == same).all() and len(set(h.tolist())) == 40


def test_edited_copies_that_go_on(spark):
    long = " ".join(SENTENCES[:4])
    cut = long[:-20]
    words = cut.split(" ")
    swapped, less, more = (" ".join(words[:3] + new + words[4:]) for new in (["Zebra"], [], [words[3], "indeed"]))
    late = " ".join(words[:-3] + ["zebra"] + words[-2:])
    other = " ".join(reversed(words))
    rows = list(enumerate([long, swapped, less, more, late, other]))
    assert cut_ids(spark, rows) == {1, 2, 3, 4}


def test_every_copy_of_a_bucket_is_aligned(spark):
    rng = np.random.default_rng(7)
    body = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(100)]
    end = ["and", "then", "the", "bridge", "collapsed", "without", "any", "warning."]
    asked = (500, " ".join(["changed", *body[1:], *end[:4], "coll"]))  # no exact beginning
    turned = [(100 + k + m, " ".join(body[k:m] + body[:k] + body[m:] + end)) for k in (20, 30, 40, 50) for m in (78, 84, 91, 97)]  # nearly the same shingles, ids less than the copy's
    assert 500 in cut_ids(spark, [asked, *turned, (900, " ".join(body + end))])
    assert 500 not in cut_ids(spark, [asked, *turned])


def test_edits():
    assert tr.edits(list("abcdef"), list("abcdef"), 0) == 0 and tr.edits(list("abcdef"), list("abxdef"), 4) == 2
    assert tr.edits(list("abcdef"), list("bcdefg"), 4) == 2 and tr.edits(list("abc"), list("xyz"), 3) == 4
