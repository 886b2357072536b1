from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import url_filter

SCHEMA = "page_id long, url string, host string, rule string, b string"


def test_parts_and_rules(spark):
    cases = {
        "https://Www.Example.NET/en/1?q=/": ("www.example.net", "/en/1", "example.net/en/"),
        "http://example.net/de/": ("example.net", "/de/", "net/"),
        "http://example.net": ("example.net", "", None),
        "http://notexample.com/de/1": ("notexample.com", "/de/1", None),
        "ftp://a.example.com/de/x#f": ("a.example.com", "/de/x", "example.com/de/"),
        "x://y://z/p": ("y:", "//z/p", None),
        "http://ÀB.ORG/fr/ü": ("Àb.org", "/fr/ü", "org/fr/"),
        "http://?q://net/": ("", "", None),
        "no scheme": ("", "", None),
        "": ("", "", None),
        "http://net/": ("net", "/", "net/"),
        "http://a.b/" + "x" * 20_000: ("a.b", "/" + "x" * 20_000, None),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(None, None), (0, next(iter(cases)))]
    got = url_filter.judge_urls(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        url = dict(rows)[r.page_id] if r.page_id is not None else None
        assert (r.host, r.path, r.rule) == cases.get(url, ("", "", None))
        says = {rule: verdict for verdict, rule in url_filter.RULES}
        assert r.verdict == says[r.rule] if r.rule else r.verdict in ("block", "allow")
    assert url_filter.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0


def test_training_against_numpy(spark):
    labelled = url_filter.labelled_table(spark)
    rows = labelled.select("url", "verdict", url_filter.buckets(*url_filter.url_parts(F.col("url"))).alias("b")).orderBy("url").collect()
    kernel = np.array([[len({*x.b} & {*z.b}) / np.sqrt(len(x.b) * len(z.b)) + url_filter.OFFSET for z in rows] for x in rows])
    y, a = np.array([r.verdict == "block" for r in rows], float), np.zeros(len(rows))
    for _ in range(url_filter.STEPS):
        a = a + url_filter.RATE * (y - 1 / (1 + np.exp(-kernel @ a)) - url_filter.DECAY * a)
    weights = np.zeros(url_filter.BUCKETS)
    for c, r in zip(a, rows, strict=True):
        weights[r.b] += c / np.sqrt(len(r.b))
    got, offset = url_filter.train(labelled)
    assert np.allclose(got, weights) and np.isclose(offset, a.sum() * url_filter.OFFSET)
    assert (((kernel @ a) > 0) == (y == 1)).all()
    assert url_filter.train(labelled.limit(0)) == ([0.0] * url_filter.BUCKETS, 0.0)
