"""Extractors' answers hold every measurement of a document, not its first few."""

import pytest
from pyspark.sql import functions as F

from biolab.plans import registry
from biolab.sources.measurements import measurements

from .test_queries import SF


@pytest.mark.parametrize("name", ["llm_json", "llm_coerce", "verify_proximity"])
def test_every_measurement_is_answered(spark, name):
    keys = lambda df: sorted((r.doc_id, r.ord) for r in df.select("doc_id", "ord").collect())
    want = keys(measurements(spark, SF))
    assert keys(registry.QUERIES[name](spark, SF)) == want and max(o for _, o in want) > 3


def test_proximity_equals_brute_force(spark):
    from biolab.functions import columns
    from biolab.operators import answers
    from biolab.sources.measurements import reports

    page = {r.doc_id: r.content for r in reports(measurements(spark, SF)).collect()}
    items = registry._items(spark, SF).select("doc_id", "ord", answers.coerced(F.col("value"), F.col("comparator"))["written"].alias("w"), columns.name_token(F.col("name")).alias("t"))
    rows = items.select("doc_id", "ord", columns.value_variants(F.col("w")).alias("variants"), "t").collect()

    def near(text, variants, token):
        for v in filter(None, variants or []):
            at = text.find(v)
            while at >= 0:
                if token in text[max(at - 200, 0) : at + len(v) + 200].lower():
                    return True
                at = text.find(v, at + len(v))
        return False

    got = {(r.doc_id, r.ord): r.verified for r in registry.QUERIES["verify_proximity"](spark, SF).collect()}
    assert got == {(r.doc_id, r.ord): near(page[r.doc_id], r.variants, r.t) for r in rows}
