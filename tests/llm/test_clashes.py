"""Columns called like an operator's own are an error everywhere; other names, whatever operators use inside, are carried."""

import pytest
from boxloom.llm import decontaminate, exact, language, licenses, mixing, quality, secrets, simhash, substrings, urls
from pyspark.sql import functions as F

from . import cases

CASES = [
    ("sd_kept", lambda d: substrings.remove_repeats(d)), ("SD_other", lambda d: substrings.remove_repeats(d)), ("nd_node", simhash.keep_one), ("ND_SUM", simhash.keep_one), ("q_kept", quality.judge), ("Q_n_words", quality.judge),
    ("ss_findings", secrets.scan_secrets), ("SS_Redacted", secrets.scan_secrets), ("li_pred", lambda d: language.predict(d, MODEL)), ("shuffle_key", mixing.mix), ("COPY", mixing.mix), ("sx_spans", lambda d: exact.remove_repeats(d)), ("SX_any", lambda d: exact.remove_repeats(d)),
    ("dc_items", lambda d: decontaminate.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text"))), ("ls_base", licenses.scan_licenses), ("LS_FOUND", licenses.scan_licenses), ("u_verdict", lambda d: urls.judge_urls(d, d.select("url"))),
]
MODEL = language.Model([], None, None, 1.0)


@pytest.mark.parametrize("name,apply", CASES, ids=[c[0] for c in CASES])
def test_a_clashing_column_is_refused(spark, name, apply):
    d = cases.docs(spark, cases.ROWS[:3]).withColumn("url", F.lit("http://a.b/"))
    with pytest.raises(ValueError):
        apply(d.withColumn(name, F.lit(1)))


def test_keep_one_of_repeated_rows(spark, monkeypatch):
    """Repeated rows among kept and dropped ones, with keys broadcast or shuffled."""
    rows = cases.ROWS * 2 + [(100, "one two three four " * 9, "en", "a", 1), (101, "one two three four " * 9, "en", "a", 1), (101, "one two three four " * 9, "en", "b", 1), (None, "another text without a key " * 5, "en", "a", 1)]
    d = cases.odd(cases.docs(spark, rows))
    want = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.keep_one(d).collect())
    assert len(want) == len(set(want)) and (False, 100, "one two three four " * 9) in want and not any(k == 101 for _, k, _ in want)
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", 0)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.keep_one(d).collect()) == want
    assert simhash.keep_one(d.limit(0)).count() == 0
