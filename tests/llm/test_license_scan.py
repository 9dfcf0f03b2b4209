from __future__ import annotations

from lodestone.llm import license_scan
from lodestone.llm.license_scan import TEMPLATES, Matcher

SCHEMA = "path string, text string, dir string"


def test_every_notice_is_its_own_best_match():
    matcher = Matcher()
    for name, notices in TEMPLATES.items():
        for notice in notices:
            assert matcher.best(notice)[1] == name
            assert abs(matcher.best(notice)[0] - 1) < 1e-9


def test_cosine_equals_the_dense_form():
    matcher, sentence = Matcher(), "Released under the MIT License by nobody at all, version 3."
    x = matcher.vector(license_scan.terms(sentence))
    names = sorted({t for _, y in matcher.vectors for t in y} | set(x))
    dense = max(sum(x.get(t, 0) * y.get(t, 0) for t in names) for _, y in matcher.vectors)
    assert abs(matcher.best(sentence)[0] - dense) < 1e-12


def test_notices_are_found_anywhere_and_prose_is_not():
    matcher = Matcher()
    long = "word " * 30_000
    assert matcher.scan(f"{long}. Licensed under CC BY-NC 4.0. More prose", 0.7) == ("CC-BY-NC-4.0", 1.0)
    assert matcher.scan("Driving needs a licence, and a licensed dealer.", 0.7) == (None, 0.0)
    assert matcher.scan(None, 0.7) == (None, 0.0) and matcher.scan("", 0.7) == (None, 0.0)
    assert matcher.scan("released under the mit license.", 0.7)[0] == "MIT"


def plain(rows, matcher):
    own = {p: matcher.scan(t, 0.7) for p, t, _ in rows if p is not None}
    speaks = {}
    for p in sorted(own):
        folder, _, name = p.rpartition("/")
        if own[p][0] and name.split("-")[0].split(".")[0].upper() in ("LICENSE", "LICENCE", "COPYING"):
            if folder not in speaks or own[p][1] > own[speaks[folder]][1]:
                speaks[folder] = p
    for p, t, _ in rows:
        mine = matcher.scan(t, 0.7)[0]
        above, found = (p or "").rpartition("/")[0] if p is not None else None, None
        while above is not None and found is None:
            found = above if above in speaks else None
            above = above.rpartition("/")[0] if above else None
        inherited = own[speaks[found]][0] if found is not None else None
        yield p, mine, inherited, found, mine or inherited


def test_inheritance_equals_brute_force(spark):
    mit, gpl, apache = "Released under the MIT License.", TEMPLATES["GPL-3.0"][0], TEMPLATES["Apache-2.0"][0]
    rows = [
        ("LICENSE", apache, "x"), ("a.txt", "none", "x"), ("p/LICENSE", mit, "x"), ("p/COPYING.txt", gpl, "x"), ("p/q/r/f.py", "x", None),
        ("p/q/LICENSE-2", gpl + " And so on", "x"), ("p/q/r/s/own.py", mit, "x"), ("z/f", "", "x"), (None, mit, "x"), ("z/LICENSE", "no words", "x"),
        ("p/q/r/f.py", "x", None), ("", "x", "y"), ("//odd", None, "y"),
    ]
    found = license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple(str(x) for x in r)
    got = [(r.path, r.license, r.inherited, r.inherited_from, r.effective) for r in found]
    assert sorted(got, key=key) == sorted(plain(rows, Matcher()), key=key)


def test_no_files(spark):
    assert license_scan.scan(spark.createDataFrame([], SCHEMA)).count() == 0
