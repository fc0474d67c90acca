"""Cycles of frames against reachability, deep chains, and fetch histories against a walk in order of time."""

import datetime as dt
import random

from pyspark.sql import functions as F

from snapweave.operators import resources, rewrite

FRAMES = "capture_id long, key string, url string, html string"


def tag(key):
    return f'<iframe data-snapweave-frame-key="{key}" src="old">'


def reaches(edges):
    out = {a: {b for x, b in edges if x == a} for a, _ in edges}
    while True:
        more = {a: bs | {c for b in bs for c in out.get(b, ())} for a, bs in out.items()}
        if more == out:
            return out
        out = more


def test_edges_on_cycles_of_random_graphs():
    rnd = random.Random(4)
    for _ in range(300):
        n = rnd.randrange(1, 9)
        edges = [(str(rnd.randrange(n)), str(rnd.randrange(n))) for _ in range(rnd.randrange(0, 2 * n))]
        far = reaches(edges)
        assert rewrite.circular(edges) == [a == b or a in far.get(b, ()) for a, b in edges]


def test_frame_trees_of_random_captures_and_a_deep_chain(spark):
    rnd, rows = random.Random(9), []
    for c in range(20):
        rows += [(c, str(k), f"u{k}", "".join(tag(rnd.randrange(8)) for _ in range(rnd.randrange(0, 4)))) for k in range(6)]
    rows += [(99, str(k), f"u{k}", tag(k + 1)) for k in range(10_000)] + [(98, None, "u", tag("0")), (97, "0", "u", None), (None, "0", "u", tag("0"))]
    got = {(r.capture_id, r.key): r.html for r in rewrite.resolve_frame_tree(spark.createDataFrame(rows, FRAMES), F.lit("/a/")).collect()}
    assert len(got) == len(rows)
    for c in range(20):
        own = {k: html for i, k, _, html in rows if i == c}
        edges = [(k, to) for k, html in own.items() for to in own if tag(to) in html]
        far = reaches(edges)
        for k, html in own.items():
            for to in own:
                if tag(to) in html and to != k and k not in far.get(to, ()):
                    html = html.replace(tag(to), f'<iframe data-snapweave-frame-key="{to}" src="/a/u{to}">')
            assert got[c, k] == html
    assert sum('src="/a/' in got[99, str(k)] for k in range(10_000)) == 9_999


def test_fetches_of_long_histories(spark):
    rnd, t0 = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(k, rnd.choice(["a", "b", None]) if k % 3 else "hot", None if k % 97 == 0 else t0 + dt.timedelta(minutes=rnd.randrange(0, 900)), rnd.choice([200, 200, 304, 500]), rnd.choice("xyz")) for k in range(600)]
    df = spark.createDataFrame(rows, "fetch_id long, url string, fetched_at timestamp_ntz, status int, content_hash string")
    got = {r.fetch_id: (r.action, r.source_fetch) for r in resources.resolve_fetches(df).collect()}
    last, by_row, by_file, want = {}, {}, {}, {}
    for k, url, at, status, h in sorted(rows, key=lambda r: (r[2] is not None, r[2] or t0, r[0])):
        if status == 200:
            known = url is not None and (url, h) in by_row  # a null url has no rows to share
            want[k] = ("reuse", by_row[url, h]) if known else ("share", by_file[h]) if h in by_file else ("create", k)
            by_row.setdefault((url, h), k)
            by_file.setdefault(h, k)
            last[url] = k
        else:
            want[k] = ("error", None) if url not in last else ("cached" if status == 304 else "fallback", last[url])
    assert got == want
