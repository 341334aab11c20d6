"""Columns of any name come back as they were from every operator that gives rows of documents."""

import pytest
from pyspark.sql import functions as F

from corvia.llm import language, mixing, quality, secrets, simhash

STAGES = {
    "emit": (mixing.emit, []), "mix": (mixing.mix, mixing.RESULTS), "judge": (quality.judge, [*quality.RESULTS, *quality.STATS]), "keep_one": (simhash.keep_one, []),
    "keep_identified": (language.keep_identified, []), "redact": (lambda d: secrets.redact(d, secrets.train(d)), ["text", "n_chars"]),
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_other_columns_are_carried(odd_docs, name):
    stage, made = STAGES[name]
    tagged = odd_docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in odd_docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars", "a.b")})
    found = stage(tagged)
    carried = [c for c in tagged.columns if c not in made]
    assert set(carried) <= set(found.columns)
    own = {tuple(r) for r in tagged.select(*[f"`{c}`" for c in carried]).collect()}
    back = [tuple(r) for r in found.select(*[f"`{c}`" for c in carried]).collect()]
    assert back and set(back) <= own
