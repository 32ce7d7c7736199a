import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.llm import spelling as s

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(n):
    """Near words by trying every edit."""
    letters = {c for w in n for c in w}
    rows, forms, near_of = [], {}, {}
    for w in n:
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near_of[w] = near = [v for v in near if v in n and v != w]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, n[w], len(near_of[w]), forms[w], n.get(forms[w]), root))
    return sorted(rows)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def edited(rng, word, alphabet):
    at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    return word[:at] + ("" if kind == 0 else rng.choice(alphabet)) + word[at + (kind != 1) :]


@pytest.mark.parametrize("limit", [16_384, 40, 5])
@pytest.mark.parametrize("alphabet", ["ab", "abcdeé", LETTERS], ids=len)
def test_equals_all_edits(spark, monkeypatch, limit, alphabet):
    """Small limits make keys hot: they are split until no window is wider than a place."""
    monkeypatch.setattr(s, "LIMIT", limit)
    monkeypatch.setattr(s, "DEALT", 200)
    rng = random.Random(limit + len(alphabet))
    n, seeds = {}, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(7, 12))) for _ in range(12)]
    for _ in range(500):
        w = rng.choice(seeds)
        for _ in range(rng.randrange(4)):
            w = edited(rng, w, alphabet)
        if len(w) >= 7:
            n[w] = 2 * 10 ** rng.randrange(5) + rng.randrange(3)
    n |= {"a" * k: 10**k for k in range(7, 15)}
    made = got(s.variants(spark.createDataFrame([*n.items()], "word string, n long").repartition(3)))
    assert made == plain_variants(n)


def test_limit_is_above_what_a_window_of_one_place_holds():
    assert len(LETTERS) ** 2 + len(LETTERS) < s.LIMIT


def test_words_and_whole_query_by_hand(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice(LETTERS[:40]) for _ in range(rng.randrange(3, 14))) for _ in range(150)]
    docs = [(i, " ".join(w.upper() if rng.random() < 0.1 else w + rng.choice(["", ",", "1", "\n", "ž", "×"]) for w in rng.choices(vocabulary, [1 / (k + 1) for k in range(150)], k=80))) for i in range(200)]
    docs += [(None, "nothing nothing"), (5, None), (5, "Repeated repeated"), (5, "Repeated repeated"), (900, "long" * 50_000), (901, "long" * 50_000), (902, "words in a long text " * 20_000), (903, "")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    made = s.op12_spelling(spark, str(tmp_path))
    words = plain_words(docs)
    long = [w for w in words if len(w) > 100]
    assert [r for r in got(made) if len(r[0]) < 100] == plain_variants({w: n for w, n in words.items() if w not in long})
    assert {r[0]: r[1:] for r in got(made) if len(r[0]) > 100} == {w: (words[w], 0, None, None, w) for w in long}


def test_long_words_meet(spark):
    n = {"x" * 5000: 50, "x" * 5001: 5, "x" * 2500 + "y" + "x" * 2499: 2, "x" * 4999 + "y": 2, "y" + "x" * 5000: 2}
    made = {r[0]: r[2] for r in got(s.variants(spark.createDataFrame([*n.items()], "word string, n long")))}
    assert [made[w] for w in n] == [4, 2, 1, 1, 2]


def test_empty_tables_and_further_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert s.variants(s.words_of(empty)).collect() == []
    docs = spark.createDataFrame([(i, "spelling speling spellings spelling") for i in range(30)], "doc_id long, text string")
    wide = docs.select(*[F.lit(i).alias(c) for i, c in enumerate("word n key length low high bucket best minus_n n_near root form moved further __size".split())], "*")
    assert got(s.variants(s.words_of(wide))) == got(s.variants(s.words_of(docs)))


def test_automaton_numbers_its_words():
    words = sorted({"", "a", "ab", "abc", "bbc", "bc", "c"})
    a = s.Automaton(words)
    assert [a.number(a.root, 0, w) for w in words] == [*range(len(words))]
    assert a.number(a.root, 0, "abcd") is a.number(a.root, 0, "b") is None
    assert len(a.steps) == 6  # of 11 in a tree
