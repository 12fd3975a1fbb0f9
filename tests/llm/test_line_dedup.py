import random
from collections import Counter

from pyspark.sql import functions as F

from meterlight.llm import line_dedup as ld


def brute(rows, ratio=ld.RATIO, least=ld.MIN_PAGES):
    """rows: id, host, lines. Per row: id, host, n_lines, n_dropped, text."""
    pages = Counter(h for _, h, _ in rows)
    on = Counter((h, line) for _, h, lines in rows for line in set(lines))
    out = []
    for i, h, lines in rows:
        stay = [x for x in lines if not (on[h, x] >= least and on[h, x] > ratio * pages[h])]
        out.append((i, h, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows, plain = [], []
    for i in range(120):
        host = rng.choice(["a.org", "b.org", "c.org", None])
        lines = ["Home | About"] * (rng.random() < 0.8) + [f"story {rng.randint(0, 40)}" for _ in range(rng.randint(0, 6))] + ["(c) all rights"] * rng.choice([0, 1, 2])
        rows.append((i, None if host is None else f"https://u@{host.upper()}:8080/p/{i}?x=1", "\n".join(lines) or None, "n"))
        plain.append((i, host or "", lines))
    rows += [(7, "https://a.org/", "same\nsame", "n")] * 2 + [(None, "not a url", "  spaced \t out  \n\n x ", "n")]
    plain += [(7, "a.org", ["same", "same"])] * 2 + [(None, "", ["spaced out", "x"])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, key string")
    got = sorted(((r.id, r.host, r.n_lines, r.n_dropped, r.text) for r in ld.drop_boilerplate(pages, html=False).collect()), key=str)
    assert got == brute(plain)
    assert any(r[3] for r in got)
    assert any(r[2] > r[3] for r in got)


def test_html_lines(spark):
    cases = {
        None: [],
        "": [],
        "a<br>b<b>c</b>\td": ["a", "bc d"],
        "<head><title>t</title></head><p>x</p><!-- <p>no</p> --><script>if (a<b) {}</script><P class='y'>z</P>": ["x", "z"],
        "<li>1<li>2\n\n 3": ["1", "2", "3"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", ld.lines_of(F.col("t")).alias("lines")).collect():
        assert r.lines == cases[r.t]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert ld.drop_boilerplate(pages).count() == 0
