"""Every operator on nulls, empty and very long texts, repeated rows, no rows, and clashing column names."""
import public_tokenizers as P
import pytest

from cohortlab.llm import bpe, decontaminate, dedup, language, licenses, quality, secrets, substring, tokens, toxicity

RANKS = P.path("byte_bpe_50k.tiktoken")


def _items(df):
    return df.sparkSession.createDataFrame([(1, None), (2, ""), (3, "kurz"), (4, "wort1x wort2x wort3x wort4x wort5x wort6x")],
                                           "item_id long, text string")


def _language(df):
    return language.languages(df, language.train(["der und das", "the of and", "der das", "of the"], ["de", "en", "de", "en"], language.Params()))


OPERATORS = {
    "substring": lambda df: substring.remove_repeats(df),
    "bpe": lambda df: bpe.bpe_digests(df, RANKS, P.PATTERN, with_ids=True),
    "dedup": lambda df: dedup.near_duplicates(df),
    "licenses": lambda df: licenses.license_scan(df),
    "secrets": lambda df: secrets.secret_digest(df),
    "quality": lambda df: quality.quality_rules(df),
    "tokens": lambda df: tokens.token_files(df, P.path("word_bpe_49k.json"), 2),
    "language": _language,
    "toxicity": lambda df: toxicity.toxicity_scores(df, toxicity.Model.initial()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(name, awkward, clashing, nothing):
    op = OPERATORS[name]
    rows = sorted(op(awkward).collect(), key=str)
    if name == "dedup":         # repeated rows of one id count once
        assert sorted(r["doc_id"] for r in rows) == list(range(1, 15))
    else:
        assert sorted(r["doc_id"] for r in rows) == sorted([*range(1, 15), 4])
    assert sorted(op(clashing).collect(), key=str) == rows
    empty = op(nothing)
    assert empty.collect() == [] and empty.columns == op(awkward).columns


def test_decontamination_of_awkward_tables(awkward, clashing, nothing):
    items = _items(awkward)
    assert decontaminate.contaminated(awkward, items).collect() == []
    assert decontaminate.contaminated(nothing, items).collect() == []
    assert decontaminate.contaminated(clashing, items.limit(0)).collect() == []
    kept = decontaminate.drop_contaminated(clashing, items)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()


def test_long_and_empty_texts_have_defined_results(awkward):
    q = {r["doc_id"]: r for r in quality.quality_rules(awkward).collect()}
    assert q[1]["n_words"] == q[2]["n_words"] == q[3]["n_words"] == 0 and q[1]["base_failed"] and not q[1]["kept"]
    assert q[8]["n_words"] == 30_000 and q[13]["n_dup_lines"] == 39
    lang = {r["doc_id"]: r for r in _language(awkward).collect()}
    assert lang[1]["lang_pred"] == lang[2]["lang_pred"] == "und" and lang[1]["score"] == 0
    d = {r["doc_id"]: r for r in dedup.near_duplicates(awkward).collect()}
    assert d[5]["component_id"] == d[6]["component_id"] == d[7]["component_id"] == 5
    assert d[4]["component_id"] == 4 and d[14]["component_id"] == 4 and d[4]["n_shingles"] == 1
    assert [d[i]["component_id"] for i in (1, 2, 3)] == [1, 2, 3] and d[2]["n_shingles"] == 0
