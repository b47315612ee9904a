"""Texts with very many secrets: right spans, in time that follows their number."""

import time

import brute
from pyspark.sql import functions as F

from coursegrid.llm import secret_ledger


def key_dump(n):
    return "\n".join(f"{'é' * (k % 3)}token = {k:032x}{'!' if k % 7 else ''} AKIA{'A' * 16}" for k in range(n))


def scanned(spark, texts):
    frame = spark.createDataFrame(enumerate(texts), "path long, text string")
    ledger = secret_ledger.scan(frame)
    base = F.filter("spans", lambda s: s["rank"] < 3)
    rows = secret_ledger.findings(frame, ledger).select("path", secret_ledger.joined(base).alias("spans")).collect()
    return [r.spans for r in sorted(rows, key=lambda r: r.path)]


def test_spans_of_every_number_of_matches(spark):
    texts = [key_dump(n) for n in (0, 1, 2, 3, 5, 10, 17, 100, 401)]
    assert scanned(spark, texts) == [",".join(brute.secrets(t)) for t in texts]


def test_redaction_of_every_number_of_spans(spark):
    texts = [key_dump(n) + tail for n in (0, 1, 2, 4, 7, 50, 300) for tail in ("", " end é")]
    got = secret_ledger.redact(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    want = []
    for t in texts:
        out, at = [], 0
        for kind, start, end in (s.split(":") for s in brute.secrets(t)):
            if int(start) >= at:
                out += [t[at : int(start)], secret_ledger.MARK]
            at = max(at, int(end))
        want.append("".join(out) + t[at:])
    assert sorted(r.text for r in got) == sorted(want)


def test_time_follows_the_number_of_secrets(spark):
    def seconds(n):
        frame = spark.createDataFrame([(key_dump(n),)], "text string")
        start = time.perf_counter()
        assert secret_ledger.redact(frame).select(F.length("text")).first()
        return time.perf_counter() - start

    seconds(1000)
    few, many = seconds(5_000), seconds(50_000)
    assert many < 25 * few + 5, (few, many)
