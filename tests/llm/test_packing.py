import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tracewell.llm import packing as p


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


TEXTS = ["", None, " ", "a", "Hello, wörld!\n\n\t x", "<|endoftext|> is a token", "a <|endoftext|> b<|endoftext|><|endoftext|>\n", "<|endoftext", "\x00\x85​　é", "word " * 3000, "x" * 5000, "1234567 " * 99, "😀👩‍👩‍👧 ñandú"]


def test_ids_are_those_of_tokenizers(reference_ids):
    rng = random.Random(3)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), 10, 32, 0x4E2D])) for _ in range(rng.randrange(400))) for _ in range(200)]
    encode = p.encoder(*(public_tokenizers.path(f"byte_bpe_50k.{end}") for end in ("tiktoken", "json")))
    assert 50256 in encode(TEXTS[6])
    for t in texts:
        assert [*encode(t or ""), 0] == reference_ids(t)


def test_pieces_lie_once_in_gapless_sequences(spark, reference_ids):
    docs = list(enumerate(TEXTS)) + [(None, "no id"), (3, "again"), (3, "again")]
    rows = p.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    sequences, of_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        of_doc[r.doc_id].append(r)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= p.SIZE
    for doc_id, text in enumerate(TEXTS):
        if doc_id == 3:
            assert len(of_doc[3]) == 3
            continue
        ids, at = reference_ids(text), 0
        for r in sorted(of_doc[doc_id], key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids)


def test_patterns_keep_the_histogram():
    rng = random.Random(5)
    for _ in range(50):
        histogram = {rng.randint(1, 1024): rng.randint(1, 500) for _ in range(rng.randint(1, 200))}
        got = defaultdict(int)
        for count, lengths in p.shortest_pack_first(histogram):
            assert sum(lengths) <= 1024
            for length in lengths:
                got[length] += count
        assert got == histogram


def packs_one_by_one(histogram):
    """Pieces placed singly, longest first, each into the shortest pack that can take it; if none can, into new
    ones, which the pieces of this length fill up."""
    packs = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = [k for k, pack in enumerate(packs) if 1024 - sum(pack) >= length]
            roomy = max((1024 - sum(packs[k]) for k in fits), default=0)
            if not fits:
                packs += [[length] * min(1024 // length, left - s) for s in range(0, left, 1024 // length)]
                break
            chosen = next(k for k in fits if 1024 - sum(packs[k]) == roomy)
            packs[chosen].append(length)
            left -= 1
    return packs


def test_patterns_are_those_of_single_placing():
    rng = random.Random(11)
    for _ in range(40):
        histogram = {rng.randint(1, 1024): rng.randint(1, 12) for _ in range(rng.randint(1, 25))}
        want = packs_one_by_one(histogram)
        got = p.shortest_pack_first(histogram)
        assert sum(c for c, _ in got) == len(want)
        assert sorted(sum(x) for x in want) == sorted(s for c, x in got for s in [sum(x)] * c)


def test_little_padding_and_empty(spark):
    rng = random.Random(7)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[rng.randint(1, 1024)] += 1
    patterns = p.shortest_pack_first(histogram)
    used, room = sum(k * v for k, v in histogram.items()), 1024 * sum(c for c, _ in patterns)
    assert used / room > 0.98
    assert p.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
