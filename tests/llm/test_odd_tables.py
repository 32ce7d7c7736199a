"""Further columns with clashing names, repeated identifiers, null and very long texts, for every operator."""

import pytest
from pyspark.sql import functions as F

from tracewell.llm import exact_dedup, html_text, line_dedup, mixing, near_dedup, packing, quality, spotsigs, suffix_dedup, warc
from tracewell.llm.common import new_path

NAMES = """n a b x m u v rep root label labels tree block blocks node depth prefix low high copies component size length rank row place page digest first
bytes html2 h one two k half trusted features score kept keep_id group_size recipe id chunk salt n_points base bucket start offset sequence_id links
class_id n_links gram around doc is_first few many __id __key __size __name __none __range __taken __copy __dropped __lines __stay __hash __c __r
n_lines n_dropped fingerprint next value leaf content parent noise run seq url_key captured usable named""".split()

TEXT = "one two three four five six seven eight nine ten\nA line that many share\n"


def table(spark, rows, schema):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df, df.select(*[F.lit(i).alias(c) for i, c in enumerate(NAMES)], "*")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXT + f"and something of its own {i * 7919} in it", f"s{i % 3}") for i in range(14)]
    rows += [(3, TEXT + "again", None), (3, TEXT + "again", None), (None, "no id", "s1"), (20, None, "s1"), (21, "", None), (22, "long line of words " * 20_000, "s2"), (23, "y" * 400_000, "s2")]
    return table(spark, rows, "doc_id long, text string, source string")


def rows_of(df):
    return sorted(map(repr, df.collect()))


OPERATORS = {
    "exact": exact_dedup.exact_groups,
    "fingerprints": spotsigs.fingerprints,
    "suffix": suffix_dedup.suffix_dedup,
    "packing": packing.pack,
    "near": near_dedup.near_groups,
    "quality": lambda d: quality.scored(d, d.sparkSession.createDataFrame([(i, 1) for i in range(14)], "doc_id long, quality int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_further_columns_are_not_read(docs, name):
    plain, wide = docs
    assert rows_of(OPERATORS[name](wide)) == rows_of(OPERATORS[name](plain))


@pytest.mark.parametrize("how", [line_dedup.line_dedup, mixing.mix, mixing.mixed_documents, near_dedup.one_of_each], ids=["lines", "mix", "mixed", "one"])
def test_further_columns_pass_through(docs, how):
    plain, wide = docs
    made, want = how(wide), how(plain)
    assert [c for c in made.columns if c not in want.columns] == [c for c in NAMES if c not in want.columns]
    assert len(set(made.columns)) == len(made.columns)
    assert rows_of(made.select(*want.columns)) == rows_of(want)
    assert all(r[c] == i for r in made.select(*NAMES).collect() for i, c in enumerate(NAMES) if c not in want.columns)


def test_pages(spark, tmp_path):
    rows = [(i, f"http://a.example/{i % 4}", f"<p>page {i % 5} of some</p>" * 9) for i in range(12)]
    rows += [(3, None, "again"), (3, None, "again"), (None, "http://a.example/", None), (40, "odd", "<p>" + "long " * 200_000), (41, "odd", "")]
    plain, wide = table(spark, rows, "page_id long, url string, html string")
    assert rows_of(html_text.main_text(wide)) == rows_of(html_text.main_text(plain))
    indexes = []
    for k, df in enumerate((plain, wide)):
        path = new_path(spark, "odd-warc")
        warc.write_warc(df, path)
        indexes.append(rows_of(warc.capture_index(spark, path).select("page_id", "url", "payload_digest", "record_type", "refers_to")))
    assert indexes[0] == indexes[1] and len(indexes[0]) == len(rows)


def test_empty_tables(spark):
    docs, wide = table(spark, [], "doc_id long, text string, source string")
    for how in (*OPERATORS.values(), line_dedup.line_dedup, mixing.mix, mixing.mixed_documents, near_dedup.one_of_each):
        assert how(wide).collect() == []
