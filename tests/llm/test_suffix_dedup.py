import hashlib
import random

from tracewell.llm import suffix_dedup as sd


def brute(docs):
    """doc_id -> (n_bytes, n_removed, n_spans, digest): every window of 100 bytes looked up among all earlier ones."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - sd.LENGTH + 1):
            w = data[s : s + sd.LENGTH]
            if w in seen:
                gone[s : s + sd.LENGTH] = b"\1" * sd.LENGTH
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def fixture(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(rng.randint(15, 80)) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [prose(rng.randint(0, 60)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(1, rng.choice(passages))
        docs.append(" ".join(parts))
    long = prose(26_000)  # read in several parts
    docs += [long, long[60_000:90_000] + "!" + long[100:140_000], "é" + long, prose(3)]
    docs += [docs[3], docs[3][:400] + "X" + docs[3][401:], "ab" * 300, "a" * 1000, passages[0] * 5, "", None, "short", docs[5][7:]]
    return list(enumerate(docs))


def test_matches_brute_force(spark, monkeypatch):
    for few in (64, 0):
        monkeypatch.setattr(sd, "FEW", few)
        docs = fixture(few)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in sd.suffix_dedup(df).collect()}
        assert got == brute(docs)


def test_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(sd, "STRETCH", 256)
    rng = random.Random(1)
    part = "".join(rng.choice("abcdefgh ") for _ in range(700))
    docs = [(1, "".join(rng.choice("abcdefgh ") for _ in range(3000)) + part), (2, "x" + part + "".join(rng.choice("abc") for _ in range(500)) + part)]
    want = brute(docs)
    for doc_id, text in docs:
        import numpy as np

        data = np.frombuffer(text.encode(), np.uint8)
        covered = sum(int((last - first + 1).sum()) for _, _, _, first, last in sd.anchor_rows(data))
        assert covered == len(data) - sd.LENGTH + 1
    assert want[2][1] > 1000


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.suffix_dedup(df).collect() == []


def test_anchors_at_the_border_of_stretches(spark):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choices("ijklmnopqrst ", k=n))
    phrase, text = letters(90), ""  # shorter than a window, never the same around it
    for k in range(1, 7):  # workers read their own STRETCH, so the text is as long as it needs
        text += letters(k * sd.STRETCH - 20 - len(text)) + phrase
    docs = [(1, text + letters(500)), (2, text[70_000:71_000] + letters(300))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in sd.suffix_dedup(df).collect()}
    assert got == brute(docs)
