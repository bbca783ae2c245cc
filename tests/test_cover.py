"""Segments that tile their units give no finding; each kind of fault is found."""

import hashlib

from tarnwick.operators import cover

SEGMENTS = "unit long, name string, start_char int, end_char int, text_digest string"


def _seg(unit, text, name, a, b):
    return (unit, name, a, b, "sha256:" + hashlib.sha256(text[a:b].encode()).hexdigest())


def _found(spark, units, segments):
    got = cover.cover_findings(spark.createDataFrame(units, "unit long, text string"), spark.createDataFrame(segments, SEGMENTS))
    return sorted((r.code, r.subject, r.detail) for r in got.collect())


def test_whole_covers_have_no_findings(spark):
    t = " ein Wört \n\n𝔘nd noch eins\t"
    assert _found(spark, [(1, t), (2, None), (3, " \n")], [_seg(1, t, "a", 1, 9), _seg(1, t, "b", 12, 25)]) == []
    assert _found(spark, [], []) == []


def test_faults(spark):
    t = "one two three four"
    units = [(k, t) for k in range(7)] + [(1, t)]
    whole = lambda k: _seg(k, t, "all", 0, len(t))
    segments = [whole(0), whole(1), whole(1), _seg(2, t, "a", 0, 7), _seg(2, t, "b", 4, len(t)), _seg(3, t, "a", 4, 7), whole(4)[:4] + (None,), whole(5), (5, "null", None, 3, "x"), (5, "out", 10, 99, "x"), (5, "none", 3, 3, "x"), whole(99)]
    assert _found(spark, units, segments) == sorted(
        [("segment-overlap", "1", "all"), ("segment-overlap", "2", "b"), ("segment-gap", "3", "0-3"), ("segment-gap", "3", "8-18"), ("segment-digest", "4", "all")]
        + [("segment-bounds", "5", n) for n in ("null", "out", "none")] + [("segment-gap", "6", "0-18"), ("segment-orphan", "99", "all")]
    )
