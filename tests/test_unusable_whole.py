"""Unusable subjects over the whole fact of both sites."""

import __spark_entry__ as entry
from framewise.sources import bindings as b

FOLDER = "/root/testdata/sf0.001"


def test_usable_rows_of_both_sites_count(spark, values):
    frames, free = {}, set()
    for r in b.events_fact(spark, FOLDER, "day").collect():
        frames.setdefault(r.subject, set()).add(r.frame)
        if r.reason is None and r.subject % 7:
            free.add((r.subject, r.frame))
    got = {r.subject: r.n_frames for r in entry.queries()["unusable_subjects"](spark, FOLDER).collect()}
    assert all(got[s] == len(f) for s, f in frames.items() if s % 7 == 0)
    assert {s % 2 for s in got if s % 7 == 0} == {0, 1}
    assert all(n == len(frames[s]) for s, n in got.items())
