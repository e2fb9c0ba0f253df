"""Scalar expressions against known values."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import classify, dates, numbers, stats, text, urls


def values(spark, rows, schema, *columns):
    frame = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_rounding_and_number_parsing(spark):
    got = values(spark, [(-0.5, "1,234%"), (2.5, "n/a"), (float("nan"), "-"), (1.005, "1d")], "x DOUBLE, t STRING", numbers.round_half_up(F.col("x"), 0), numbers.parse_number(F.col("t")))
    assert got == [(0.0, 1234.0), (3.0, None), (None, None), (1.0, None)]


@pytest.mark.parametrize("raw, want", [("1.1%", 0.011), ("2", 0.02), ("0.5", 0.5), ("", None)])
def test_click_rates(spark, raw, want):
    ((got,),) = values(spark, [(raw,)], "t STRING", numbers.ctr_fraction(F.col("t")))
    assert got == pytest.approx(want) if want is not None else got is None


def test_positions_flags_and_lists(spark):
    got = values(spark, [(">100", "yes", "a| b;"), ("7", "", None), ("not found", "no", "")], "p STRING, f STRING, l STRING", numbers.position_or_null(F.col("p")), numbers.parse_flag(F.col("f")), numbers.split_list(F.col("l")))
    assert got == [(None, True, ["a", "b"]), (7.0, None, []), (None, False, [])]


def test_page_keys(spark):
    cases = {
        "https://www.example.test/a/b/?x=1#y": "/a/b", "HTTP://Example.test": "/", "/": "/", "a/": "/a", "": None,
        "/caf%C3%A9": "/café", "/a%2Fb+c": "/a%2Fb+c", "/bad%zz": "/bad%zz", "/x//": "/x",
    }
    got = values(spark, [(k,) for k in cases], "u STRING", F.col("u"), urls.page_key(F.col("u")))
    assert dict(got) == cases


def test_markets(spark):
    rows = [("/pl/a",), ("/en-gb",), ("/blog/x",), ("/plx/a",)]
    assert [m for (m,) in values(spark, rows, "p STRING", urls.market(F.col("p")))] == ["/pl", "/en-gb", "/", "/"]
    assert [m for (m,) in values(spark, rows, "p STRING", urls.market(F.col("p"), ["/pl", "/pl/a"]))] == ["/pl/a", "/", "/", "/"]


def test_periods_and_thresholds(spark):
    ((period,),) = values(spark, [("2026-08-29T00:00Z to 2026-09-25",)], "t STRING", dates.parse_period(F.col("t")))
    assert (str(period["start"]), str(period["end"])) == ("2026-08-29", "2026-09-25")
    rows = [(">= 1.8 percent", 1.8), ("< 2", 2.0), ("about 3", 3.0)]
    assert [m for (m,) in values(spark, rows, "t STRING, v DOUBLE", stats.meets_threshold(F.col("v"), stats.parse_threshold(F.col("t"))))] == [True, False, False]


def test_normal_distribution(spark):
    got = values(spark, [(1.96,), (-1.96,), (None,)], "z DOUBLE", stats.normal_cdf(F.col("z")), stats.p_two_sided(F.col("z")))
    assert got[0][0] == pytest.approx(0.975, abs=1e-4) and got[1][0] == pytest.approx(0.025, abs=1e-4) and got[2][1] == 1


def test_movement_classes(spark):
    cases = [
        (-5.0, 0, 0, None, "big_win"), (-0.2, 10, 20, None, "big_win"), (-2.0, 0, 0, None, "improved"), (0.2, 10, 10, 1.5, "improved"),
        (0.4, 10, 11, 0.2, "stable"), (3.0, 0, 0, None, "slipping"), (6.0, 0, 0, None, "dropped"), (0.1, 10, 5, None, "dropped"),
    ]
    got = values(spark, cases, "d DOUBLE, b INT, a INT, c DOUBLE, w STRING", classify.movement(F.col("d"), F.col("b"), F.col("a"), F.col("c")), "w")
    assert all(a == b for a, b in got)


def test_index_states_and_change_types(spark):
    states = ["Submitted and indexed", "Crawled - currently not indexed", "Soft 404", "URL is unknown to Google", ""]
    assert [v for (v,) in values(spark, [(s,) for s in states], "t STRING", classify.index_verdict(F.col("t")))] == ["indexed", "crawled_not_indexed", "not_found", "other", "unknown"]
    kinds = ["GA4 setup", "fix canonical", "new pricing", "new post", "meta title", "release 2", "misc"]
    assert [v for (v,) in values(spark, [(s,) for s in kinds], "t STRING", classify.change_type(F.col("t")))] == [
        "tracking_change", "technical_seo_fix", "pricing_change", "content_publish", "seo_content_update", "deployment", "other"
    ]


def test_redaction(spark):
    # assembled here, so that no real-looking key stands in the source
    stripe = "sk_" + "live_" + "a1B2" * 5
    cases = {
        f"pay {stripe} now": ("pay [REDACTED] now", ["stripe_key"], 1),
        'x "password": "hunter2hunter2", y': ('x "password": "[REDACTED]", y', ["key_value:password"], 1),
        "password=short api_key: ${API_KEY}": ("password=short api_key: ${API_KEY}", [], 0),
        "mail ana@firm.ro, a@example.com, hero@2x.png": ("mail [REDACTED_EMAIL], a@example.com, hero@2x.png", ["email"], 1),
        "Authorization: Bearer abcdefghijkl0mn=": ("Authorization: Bearer [REDACTED]", ["bearer_token"], 1),
        "https://u:p@host/x?token=abc&y=1": ("https://[REDACTED]@host/x?token=[REDACTED]&y=1", ["url_credential", "url_userinfo"], 2),
        "plain text": ("plain text", [], 0),
    }
    got = values(spark, [(k,) for k in cases], "t STRING", F.col("t"), text.redacted(F.col("t")), text.found_secrets(F.col("t")), text.redaction_count(F.col("t")))
    assert {k: rest for k, *rest in got} == {k: list(v) for k, v in cases.items()}


def test_definition_fingerprint_ignores_line_ends(spark):
    body = "# x\n## Hypothesis\nA  \nB\n## Criteria lock\nrest"
    got = values(spark, [(body,), (body.replace("\n", "\r\n"),), ("no markers",)], "t STRING", text.definition_fingerprint(F.col("t")))
    assert got[0] == got[1] and got[0][0] is not None and got[2][0] is None
