"""Column expressions against tables of cases."""

import hashlib
import hmac

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.functions import expr as X


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@pytest.mark.parametrize("pattern, name, hit", [
    ("logs-*", "logs-a", True), ("logs-*", "xlogs-a", False), ("a.b*", "axbc", False), ("*", "", True), ("*-1", "a-1", True), ("a*c*e", "abcde", True), ("a*c*e", "abcd", False),
    ("a", "A", False), ("a?", "ab", False), ("a\\Eb*", "a\\Ebc", True), ("**", "x\ny", True), ("", "", True), ("", "a", False)])
def test_wildcard(spark, pattern, name, hit):
    assert values(spark, [(pattern, name)], "p string, n string", X.wildcard_match("p", "n")) == [(hit,)]


def test_match_any_of_none(spark):
    assert values(spark, [(None, "a"), ([], "a"), (["x", "a*"], "ab")], "p array<string>, n string", X.match_any("p", "n")) == [(False,), (False,), (True,)]


def test_durations(spark):
    rows = [("5m", 300), ("2H", 7200), ("1d", 86400), ("1w", 604800), ("1M", 2592000), ("1y", 31536000), ("", 0), ("m", 0), ("-5m", 0), ("5 m", 0), ("5x", 0), (None, 0)]
    assert values(spark, [(a,) for a, _ in rows], "t string", X.parse_interval("t")) == [(b,) for _, b in rows]
    rows = [("now-6m", 360), ("now-1h/h", 3600), ("now", 0), ("6m", 0), (None, 0)]
    assert values(spark, [(a,) for a, _ in rows], "t string", X.parse_lookback("t")) == [(b,) for _, b in rows]
    rows = [("P1D", 86400.0), ("PT5M", 300.0), ("PT1H30M", 5400.0), ("P1DT1.5S", 86401.5), ("P1W", None), ("P1Y", None), ("P", None), ("PT", None), ("P1DT", None), ("x", None), (None, None)]
    assert values(spark, [(a,) for a, _ in rows], "t string", X.parse_iso_duration("t")) == [(b,) for _, b in rows]


def test_severity(spark):
    rows = [("High", "high"), (" critical ", "critical"), ("1", "low"), ("4.0", "high"), ("5", "critical"), ("info", "low"), ("6", ""), ("2.5", ""), ("x", ""), (None, "")]
    assert values(spark, [(a,) for a, _ in rows], "t string", X.normalize_severity("t")) == [(b,) for _, b in rows]
    rows = [(["low", "high"], "high"), ([], "medium"), (["x"], "medium"), (None, "medium"), (["5"], "critical")]
    assert values(spark, [(a,) for a, _ in rows], "t array<string>", X.detector_severity("t")) == [(b,) for _, b in rows]


def test_times_and_errors(spark):
    rows = [("1700000000000", 1700000000000), ("1.7e12", 1700000000000), ("2024-01-31T00:00:00Z", 1706659200000), ("soon", None), ("", None), (None, None)]
    assert values(spark, [(a,) for a, _ in rows], "t string", X.epoch_or_rfc3339("t")) == [(b,) for _, b in rows]
    rows = [("context deadline exceeded", "timeout"), ("403", "authorization"), ("Unauthorized", "authentication"), ("x509", "TLS"), ("no such host", "connection"), ("?", "other"), (None, "other")]
    assert values(spark, [(a,) for a, _ in rows], "t string", X.error_category("t")) == [(b,) for _, b in rows]


def test_clean_message(spark):
    [(a, b)] = values(spark, [("\x1b[31mred\x1b[0m\n​ x", "y" * 600)], "a string, b string", X.clean_message("a"), X.clean_message("b"))
    assert a == "red x" and len(b) == 512 and b.endswith("...")


def test_catch_rate(spark):
    assert values(spark, [(360, 180, 300), (360, 0, 300), (360, 400, 300)], "p int, l int, i int", F.round(X.catch_rate("p", "l", "i"), 6)) == [(0.6,), (1.0,), (0.0,)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=8), st.binary(min_size=32, max_size=100))
def test_pseudonyms_are_hmacs(spark, names, key):
    rows = values(spark, [(n,) for n in names], "n string", X.pseudonym("src", key, "n"))
    for n, (p,) in zip(names, rows):
        assert p == ("src-" + hmac.new(key, b"src\0" + n.encode(), hashlib.sha256).hexdigest()[:12] if n else n)


def test_redact_twice_and_short_keys(spark):
    df = spark.createDataFrame([("a", ["b", None]), (None, None)], "x string, y array<string>")
    once = X.redact(df, {"x": "src", "y": "rule"}, b"k" * 32)
    assert once.collect() == X.redact(once, {"x": "src", "y": "rule"}, b"k" * 32).collect()
    with pytest.raises(ValueError):
        X.redact(df, {"x": "src"}, b"short")


def test_finding_id(spark):
    parts = ["t", "", "b", "dead-detection", "r1", "starved", "", ""]
    [(got,)] = values(spark, [tuple(parts)], ", ".join(f"c{i} string" for i in range(8)), X.finding_id(*[f"c{i}" for i in range(8)]))
    assert got == "finding-" + hashlib.sha256("\0".join(parts).encode()).hexdigest()[:20]
