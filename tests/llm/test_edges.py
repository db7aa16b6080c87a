"""Every operator and stage on nulls, empty and long texts, repeats, clashing names and empty tables."""

import public_tokenizers
import pytest

import corpus_pipeline
from siftspark.llm import audio, bloomlm, chat, fingerprint, mixing, neardup, packing, pagediff, quality, queries, urlfilter

OPERATORS = {
    "audio": audio.text_digests,
    "fingerprint": fingerprint.edited_fingerprints,
    "mixing": mixing.mix,
    "neardup": neardup.components,
    "bloomlm": bloomlm.scores,
    "packing": lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.tiktoken")),
}


LONG = "<p>" + "word " * 200_000 + "<b>x</i>" * 20_000
PAGES = [(1, "http://a.org/1", "<article><p>one</p></article>"), (1, "http://a.org/1", "<article><p>one</p></article>"), (2, "http://a.org/2", LONG), (3, None, None), (None, "http://a.org/3", ""), (4, "no url", "x"), (5, "http://İ.com/de/" + "x" * 100_000, "<p>" * 1000)]
TURNS = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "x" * 300_000 + "</turn>"), (2, None, None, None), (None, 3, "assistant", ""), (3, 0, "a:b", "### ")]
OTHERS = {
    "pagediff": (pagediff.extracted, PAGES, "page_id bigint, url string, html string", len(PAGES)),
    "urlfilter": (lambda d: urlfilter.verdicts(d, queries.RULES), PAGES, "page_id bigint, url string, html string", len(PAGES)),
    "chat": (chat.conversation_digests, TURNS, "conv_id bigint, turn bigint, role string, text string", 4),
}
EXTRA = "kind string, host string, path string, part int, copy boolean, rule string, verdict string, turns string, formatted string, mask string, buckets string, score double"


@pytest.mark.parametrize("name", OTHERS)
def test_pages_and_turns(spark, name):
    """Nulls, repeats, long texts; clashing names change nothing; an empty table gives no rows."""
    operator, rows, schema, n = OTHERS[name]
    plain = spark.createDataFrame(rows, schema)
    extra = ("k", "h", "p", 1, True, "r", "v", "t", "f", "m", "b", 0.5)
    clashing = spark.createDataFrame([(*r, *extra) for r in rows], f"{schema}, {EXTRA}")
    out, same = (sorted(map(str, operator(d).collect())) for d in (plain, clashing))
    assert out == same and len(out) == n
    assert operator(clashing.limit(0)).count() == 0


#: Which of the equal rows that repeat an id gets which place is not fixed.
PLACES = {"packing": ("sequence_id", "offset")}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(name, documents, clashing):
    plain, same = (sorted(map(str, OPERATORS[name](d).drop(*PLACES.get(name, ())).collect())) for d in (documents, clashing))
    assert plain == same
    if name != "packing":
        assert len(plain) == documents.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty):
    assert OPERATORS[name](empty).count() == 0


def test_quality_edges(documents, clashing, empty, labels):
    assert quality.quality_scores(clashing, labels).count() == documents.count()
    assert quality.quality_scores(empty, labels).count() == 0
    assert not any(r["held_out"] is None for r in quality.quality_scores(documents, labels).collect())
    neutral = quality.quality_scores(clashing, labels.limit(0)).collect()
    assert {r["score"] for r in neutral} == {0.5}
    assert quality.accepted(clashing, labels).columns == clashing.columns


def test_stages_keep_the_columns(spark, clashing, empty, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (clashing, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == clashing.columns
            out.collect()
        corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "pipeline"])
def test_queries_over_tables_of_nulls(spark, name, tmp_path):
    schemas = {
        "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "labels": "doc_id bigint, quality int, toxic int",
        "pages": "page_id bigint, url string, html string", "conversations": "conv_id bigint, turn bigint, role string, text string",
    }
    for table, schema in schemas.items():
        spark.createDataFrame([(None,) * len(schema.split(", "))] * 3, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    n = queries.queries()[name](spark, str(tmp_path)).count()
    assert n == (2 if name.startswith("op10") else 3)
