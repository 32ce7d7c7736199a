"""Long runs and many lines in one document, and operators that run beside one another."""

import time
from concurrent.futures import ThreadPoolExecutor

import public_tokenizers
import pytest

from tracewell.llm import line_dedup, near_dedup, packing, suffix_dedup


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a " + "\t \n" * 50_000 + "b", "x" + " " * 99_999 + "y"], ids=["blanks", "lines", "mixed", "shorter"])
def test_long_white_space_has_the_ids_of_tokenizers(text):
    from tokenizers import Tokenizer

    files = tuple(public_tokenizers.path(f"byte_bpe_50k.{end}") for end in ("tiktoken", "json"))
    assert packing.encoder(*files)(text) == Tokenizer.from_file(files[1]).encode(text, add_special_tokens=False).ids


def test_long_white_space_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "some words")], "doc_id long, text string")
    assert sum(r.length for r in packing.pack(docs).where("doc_id = 1").collect()) == 1_000_001


def test_documents_of_many_common_lines(spark):
    lines = [f"common line {i}" for i in range(20_000)]
    rows = [(k, "\n".join([f"own {k}", *lines, f"own {k}", "", "\tCommon line 5 "])) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    line_dedup.line_dedup(docs.limit(1)).collect()
    began = time.time()
    made = line_dedup.line_dedup(docs).collect()
    assert time.time() - began < 15
    assert {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in made} == {(k, f"own {k}\nown {k}\n", 20_004, 20_001) for k in range(10)}


def test_rows_of_one_id_drop_their_own_lines(spark):
    rows = [(k, "shared\nown") for k in range(9)] + [(9, "a\nshared"), (9, "shared\nb\nshared"), (9, "shared\nb\nshared"), (None, "shared"), (9, None)]
    made = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as N_Lines")).collect()
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in made if r.doc_id == 9) == [(9, "", 0), (9, "a", 1), (9, "b", 2), (9, "b", 2)]
    assert [(r.text, r.n_lines, r.n_dropped) for r in made if r.doc_id is None] == [("", 1, 1)]


def test_operators_in_threads_keep_their_tables(spark):
    docs = spark.createDataFrame([(i, f"a text that some share, and number {i % 7} of it " * 9) for i in range(60)], "doc_id long, text string")
    operators = (suffix_dedup.suffix_dedup, packing.pack, near_dedup.near_groups)
    rows = lambda how: sorted(map(repr, how(docs).collect()))
    alone = [rows(how) for how in operators]
    with ThreadPoolExecutor(3) as threads:
        assert [*threads.map(rows, operators)] == alone


def test_clear_empties_the_shared_folder(spark, tmp_path, monkeypatch):
    from tracewell.llm import common, exact_dedup, mixing

    docs = spark.createDataFrame([(i, f"text {i % 5}", f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    made = [how(docs).count() for how in (exact_dedup.exact_groups, mixing.mix)]
    assert made == [30, 30] and packing.pack(docs).count() == 30 and any(tmp_path.iterdir())
    common.clear(spark)
    assert list(tmp_path.iterdir()) == []
