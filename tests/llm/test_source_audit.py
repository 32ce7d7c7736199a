import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import source_audit as a

SCHEMA = "lang string, source string, text string"


def plain(docs, least=3):
    """Dense, in Python's integers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang or "", source or ""].update(found)
        in_docs[lang or ""].update(set(found))
    rows = []
    for lang in in_docs:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least)
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        everywhere = Counter()
        for c in groups.values():
            everywhere.update(c)
        v = len(kept)
        of = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + v) for t in kept}
        p, q = {s: of(c) for s, c in groups.items()}, of(everywhere)
        f = lambda x, y: (x - y) ** 2 // y
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:200]
            for part, ranked in (("pair", pairs), ("term", terms)):
                rows += [(lang, s, part, item.decode(), -value, r) for r, (value, item) in enumerate(ranked, 1)]
    return sorted(rows)


def got(docs):
    return sorted(tuple(r) for r in a.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("block", [8, 32_768])
def test_equals_dense_arithmetic(spark, monkeypatch, block):
    monkeypatch.setattr(a, "BLOCK", block)
    monkeypatch.setattr(a, "ROUNDS", 3)
    rng = random.Random(block)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["ÄPFEL", "äpfel", "日本", "a😀b", "Éa"]
    docs = []
    for i in range(400):
        lang = "de" if i % 3 else "en"
        source = f"s{min(int(rng.expovariate(0.5)), 9 if lang == 'en' else 8)}"
        docs.append((lang, source, " ".join(rng.choice(words[: 60 + 20 * int(source[1:])]).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randrange(60)))))
    docs += [("fr", "only", "un deux"), ("it", "a", "uno"), ("it", "b", "12 345"), (None, None, None), ("", "x", "a1b_c a b c"), ("de", None, "x" * 300_000 + " wort" * 50_000), ("de", "empty", "")]
    docs += [("", "y", "a b c")] * 3
    made = got(spark.createDataFrame(docs, SCHEMA).repartition(5))
    assert made == plain(docs)
    assert {r[4] for r in made if r[0] == "it"} == {0}


def test_shares_are_exact():
    rng = random.Random(5)
    for whole in (1, 7, 10**6 + 3, 8 * 10**15 + 1, 10**16 + 7):
        counts = np.array([rng.randrange(whole) for _ in range(50)] + [0, whole - 1], np.int64)
        assert a.share(counts, whole).tolist() == [1 + 10**9 * (int(c) + 1) // whole for c in counts]


@pytest.mark.parametrize("slots", range(1, 12))
def test_every_pair_meets_once(spark, slots):
    rounds = range(slots + slots % 2)
    rows = spark.createDataFrame([(s, r) for s in range(slots) for r in rounds], "s int, r int").select("s", "r", a.partner(F.col("s"), F.lit(slots), F.col("r")).alias("o")).collect()
    met = Counter(frozenset((r.s, r.o)) for r in rows if r.o is not None)
    assert all(n == 2 for n in met.values()) and len(met) == slots * (slots - 1) // 2
    assert all((x.o, x.r, x.s) in {(y.s, y.r, y.o) for y in rows} for x in rows if x.o is not None)


def test_empty_table_and_further_columns(spark):
    assert a.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([("en", f"s{i % 3}", "some words here" + " more" * i) for i in range(9)], SCHEMA)
    names = "term n docs total n_terms occurrences all_occurrences blocks block number size slot slots home round counts numbers totals terms value rank part item other".split()
    wide = docs.select(*[F.lit(i).alias(c) for i, c in enumerate(names)], "*")
    assert got(wide) == got(docs)


def test_vectors_stay_where_they_are(spark, monkeypatch):
    """A round's plan deals only the vectors that travel."""
    plans = []
    kept = a.written
    monkeypatch.setattr(a, "written", lambda df, tag, keep=False: (plans.append((tag, df._jdf.queryExecution().executedPlan().toString())), kept(df, tag, keep))[1])
    a.audit(spark.createDataFrame([("en", f"s{i % 3}", "some words here") for i in range(9)], SCHEMA))
    plan = next(p for tag, p in plans if tag == "met")
    assert 0 < plan.index("InMemoryTableScan") < plan.index("ENSURE_REQUIREMENTS") and plan.count("ENSURE_REQUIREMENTS") == 1
