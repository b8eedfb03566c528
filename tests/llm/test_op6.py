import pytest

from trailmark.llm.op6_html import extract_text, scan


def text(page):
    return "\n".join(t for m, t in scan(page) if m)


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a>Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div><div id='cookie-banner'>Ok?</div>
    <article><header><h1>Head &amp; tail</h1></header><p><b>Lead&nbsp;in <br>line<p>Two
       words &#233; <i>in</i>line</p><div class="share">Tweet</div><form><p>Mail</p></form><aside>Side</aside>
    <table><tr><td>a</td><td>b</td></tr></table><section id="comments"><article><p>First!</p></article></section></article>
    <div class="comments"><article class="comment">Reader</article></div><footer>&copy; me</footer></body></html>"""
    assert text(page) == "Head & tail\nLead in line\nTwo words é inline\na\nb"


def test_broken_markup():
    assert text("<article>a < b <p>x<script>if (a<b) '</p>'</script>y</article") == "a < b\nxy"
    assert text("<nav>m<article><p>in</article>out") == "in"
    assert text("<article>one<!-- open <p>two</article>") == "one"
    assert text("") == ""


def test_against_the_pages_own_articles(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_host_runs_and_odd_rows(spark):
    foot = "all rights of this site are reserved by its owner"
    rows = [(i, "http://a.example/x", f"<div>story number {i} tells its own tale of {i * 7}</div><div>{foot}</div>", "x") for i in range(4)]
    rows += [(9, "http://b.example/", f"<div>{foot}</div>", "x"), (None, None, None, "x"), (10, "http://b.example/", "", "x"), (11, "u", "<article>q</article>", "x"), (11, "u", "<article>q</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id if r.page_id is not None else -1, r.text) for r in extract_text(df).collect()))
    assert got == [(-1, "")] + [(i, f"story number {i} tells its own tale of {i * 7}") for i in range(4)] + [(9, foot), (10, ""), (11, "q"), (11, "q")]
    assert extract_text(df.limit(0)).count() == 0


def test_runs_of_all_pages(spark):
    foot = "all rights of this site are reserved by its owner"
    body = lambda i: f"body number {i} stands in its own plain block {i * 7}"
    rows = [(i, f"http://a.example/{i}", f"<article>teaser {i}</article><div>{body(i)}</div><div>{foot}</div>") for i in range(3)]  # text beside a card
    rows += [(10 + i, "http://b.example/", f"<main><p>{body(i)}</p><div class='zz'>{foot}</div></main>") for i in range(3)]  # boilerplate inside
    rows += [(20, "http://c.example/1", f"<div>{body(1)}</div>"), (20, "http://c.example/1", f"<div>{body(1)}</div>"), (21, "http://c.example/mirror", f"<div>{body(1)}</div>")]
    rows += [(30 + i, "http://d.example/", f"<article>{body(i)} <p>{foot if i < 2 else i}</p></article>") for i in range(5)]  # a quote of two stays
    got = sorted((r.page_id, r.text) for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[:3] == [(i, f"teaser {i}\n{body(i)}") for i in range(3)]
    assert got[3:6] == [(10 + i, body(i)) for i in range(3)]
    assert got[6:9] == [(20, body(1)), (20, body(1)), (21, body(1))]
    assert got[9:] == [(30 + i, f"{body(i)}\n{foot if i < 2 else i}") for i in range(5)]


@pytest.mark.parametrize("shard_bytes, rows_sent", [(4 << 20, 1_000_000), (700, 1_000_000), (700, -1)])
def test_against_plain_counts(spark, monkeypatch, shard_bytes, rows_sent):
    """Every run of every page counted by a dictionary, whatever the shards of its host."""
    import collections
    import random

    import trailmark.llm.op6_html as op

    monkeypatch.setattr(op, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(op, "BROADCAST_ROWS", rows_sent)
    rng, run, rows = random.Random(6), 8, []
    for i in range(120):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        cut = rng.randint(0, len(words))
        html = f"<div>{' '.join(words[:cut])}</div><article>{' '.join(words[cut:])}</article>"
        rows += [(i, f"http://h{rng.randint(0, 1)}.example/{i}", html)] * rng.choice((1, 1, 2))
    streams = {(r[1][:9], tuple(" ".join(t for _, t in scan(r[2])).split())) for r in rows}
    n, count = collections.Counter(h for h, w in streams if w), collections.Counter()
    for h, w in streams:
        count.update({(h, w[k : k + run]) for k in range(len(w) - run + 1)})
    want = []
    for page_id, url, html in rows:
        blocks, h = scan(html), url[:9]
        tokens = [(t, m, b) for b, (m, text_) in enumerate(blocks) for t in text_.split()]
        gone = set()
        for k in range(len(tokens) - run + 1):
            c = count[h, tuple(t for t, _, _ in tokens[k : k + run])]
            gone |= {j for j in range(k, k + run) if (c >= 3 and 2 * c > n[h] if tokens[j][1] else c >= 2)}
        lines = [" ".join(t for j, (t, _, at) in enumerate(tokens) if at == b and j not in gone) for b in range(len(blocks))]
        want.append((page_id, "\n".join(x for x in lines if x)))
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted(want)
    assert any(c >= 2 for c in count.values())


def test_suffix_array_against_sorted_suffixes():
    import numpy as np

    from trailmark.llm.op6_html import suffix_array

    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 5, 60, 300):
        ids = np.append(rng.integers(0, 3, n), 9)
        order, common = suffix_array(ids)
        want = sorted(range(n + 1), key=lambda k: ids[k:].tolist())
        assert order.tolist() == want
        for k in range(1, n + 1):
            x, y = ids[want[k - 1] :].tolist(), ids[want[k] :].tolist()
            assert common[k] == next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def test_many_shards_and_no_broadcast(spark, monkeypatch):
    """Hosts dealt over shards give the counts of whole hosts, and runs that go with the pages those of a broadcast."""
    import random

    import trailmark.llm.op6_html as op

    rng, rows = random.Random(8), []
    for i in range(150):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        rows.append((i, f"http://h{i % 2}.example/{i}", f"<div>{' '.join(words)}</div>"))
    rows += [(500 + i, "http://h1.example/", "<div>" + " ".join(f"w{i}x{k}" for k in range(40_000)) + "</div>") for i in range(2)]  # long pages
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(tuple(r) for r in extract_text(df).collect())
    assert sum(len(w[2]) < len(r[2]) - 11 for w, r in zip(want, sorted(rows))) > 20
    monkeypatch.setattr(op, "SHARD_BYTES", 900)
    assert sorted(tuple(r) for r in extract_text(df).collect()) == want
    monkeypatch.setattr(op, "BROADCAST_ROWS", -1)
    assert sorted(tuple(r) for r in extract_text(df).collect()) == want


def test_the_answer_does_not_depend_on_the_size_of_the_host(spark):
    """A line in 55 % of a host's articles goes from short and from long ones."""
    line = "this line stands in most articles of the host and is no text"
    for words in (50, 12_000):
        rows = [(i, "http://one.example/", f"<article><p>{' '.join(f'w{i}x{k}' for k in range(words))}</p>{f'<p>{line}</p>' if i < 33 else ''}</article>") for i in range(60)]
        got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6))
        assert [r.page_id for r in got.collect() if line in r.text] == []


def test_names_alone_delete_no_prose():
    body = "".join(f"<p>Sentence {i} of the story has a good number of words in it.</p>" for i in range(12))
    all_ = "\n".join(f"Sentence {i} of the story has a good number of words in it." for i in range(12))
    said = lambda page: "\n".join(t for _, t in scan(page))
    assert said(f'<body><form id="aspnetForm"><nav><a>Home</a></nav><article>{body}</article></form></body>') == all_
    assert said(f'<body><form id="aspnetForm"><nav><a>Home</a></nav><div>{body}</div><form><p>Mail us</p></form></form></body>') == all_
    assert said(f'<body><div class="ad-free-story">{body}</div><div class="ad-slot">Buy now</div></body>') == all_
    assert said(f'<body><section class="comment-analysis">{body}</section></body>') == all_
    assert said(f'<article><h2 class="menu">What is on the table</h2>{body}</article>') == "What is on the table\n" + all_
    assert said(f"<body><nav><a>Home</a><div>{body}</div></body>").endswith(all_)
    assert said(f"<body><nav><a>Home</a></nav><div>{body}</div></body>") == all_
    # Furniture as meant stays furniture, however long it is.
    assert said(f"<body><p>Short.</p><nav>{body}</nav></body>") == "Short."
    assert said(f'<body><p>Short.</p><div class="comments">{body}</div><aside>{body}</aside></body>') == "Short."
    assert said(f'<body><p>{"Long enough. " * 60}</p><div class="ad-slot">{body[:60]}</p></div></body>') == ("Long enough. " * 60).strip()
