"""Importance resampling, main text of pages and periodic runs: brute force on small fixtures, odd rows, ties, hot hosts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import importance, page_text, periodic


def brute_runs(words):
    """Every run, lag by lag, its smallest period by trying all smaller ones."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept))


def odd_words(rng):
    """Texts with nested, overlapping, near and no runs."""
    block = [str(rng.randrange(3)) for _ in range(rng.randint(1, 14))]
    unit = block * rng.randint(1, 9) + [rng.choice("ab")] * rng.randint(0, 3)
    out = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
    for _ in range(rng.randint(1, 3)):
        out += unit * rng.randint(1, 5) + unit[: rng.randint(0, len(unit))] + [rng.choice("abcd") for _ in range(rng.randint(0, 4))]
    return out[:400]


def test_runs_are_those_of_brute_force():
    rng, met = random.Random(3), 0
    for _ in range(400):
        words = odd_words(rng)
        got = periodic.find_runs(words)
        assert got == brute_runs(words), words
        met += len(got)
    assert met > 300


@pytest.mark.parametrize("n", [0, 1, 23, 24, 25, 60])
def test_one_word_again_and_again(n):
    assert periodic.find_runs(["a"] * n) == brute_runs(["a"] * n) == ([(0, n, 1)] if n >= 24 else [])


def test_long_texts_of_runs():
    """Long texts stay quick: one word 200,000 times, a long period, and prose without runs."""
    rng = random.Random(4)
    prose = [str(rng.randrange(50_000)) for _ in range(100_000)]
    assert periodic.find_runs(["a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic.find_runs(prose) == []
    period = prose[:30_000]
    assert periodic.find_runs(["x", *period * 3, period[0], "y"]) == [(1, 90_001, 30_000)]


def test_fibonacci_words():
    """The strings with the most overlapping repeats for their length."""
    a, b = ["a"], ["a", "b"]
    while len(b) < 380:
        a, b = b, b + a
    assert periodic.find_runs(b) == brute_runs(b)


def test_collapse_and_spans(spark):
    rows = [(1, "go " + "la li " * 14 + "end", "x"), (2, None, "y"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {r["doc_id"]: r["text"] for r in periodic.collapse(docs).collect()}
    assert got == {1: "go la li end", 2: None, 3: ""}
    spans = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in periodic.with_runs(docs, out="spans").collect()}
    assert spans == {1: [(1, 28, 2)], 2: [], 3: []}


def test_features_stay_within_their_texts():
    words, runs = importance.features([b"one two", b"", b"\xc3\xa9t\xc3\xa9-3 one"], 10_000, 3)
    assert words.tolist() == [2, 0, 3]
    named = [(x, k) for k, t in ((0, [b"one", b"two"]), (2, ["été".encode(), b"3", b"one"])) for n in (1, 2, 3) for x in (b" ".join(t[i : i + n]) for i in range(len(t) - n + 1))]
    assert Counter((c, o) for codes, owner in runs for c, o in zip(codes.tolist(), owner.tolist(), strict=True)) == Counter((zlib.crc32(x) % 10_000, k) for x, k in named)


def test_lots_do_not_change_counts(spark, odd, monkeypatch):
    whole = importance.bucket_counts(odd)
    monkeypatch.setattr(importance, "LOT_BYTES", 50)
    assert np.array_equal(whole, importance.bucket_counts(odd.repartition(3))) and whole.sum() > 100_000
    assert importance.bucket_counts(odd, buckets=37).sum() == whole.sum()


def test_ranks_do_not_depend_on_partitions(odd):
    target = odd.filter("doc_id < 5")
    results = [Counter(tuple(r) for r in importance.ranked(odd.repartition(n), target).collect()) for n in (1, 6)]
    assert results[0] == results[1]
    ranks = sorted(r[4] for r in results[0].elements() if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_resampling_returns_whole_rows(odd, odd_rows, empty):
    target = odd.filter("doc_id < 5")
    drawn = Counter(r["doc_id"] for r in importance.ranked(odd, target).filter("rank IS NOT NULL").collect())
    got = importance.resample(odd, target)
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == odd.columns and Counter(r[0] for r in rows) == drawn and not Counter(rows) - Counter(odd_rows)
    assert importance.ranked(odd, empty).count() == len(odd_rows) and importance.resample(empty, odd).count() == 0


ARTICLE = "<h1>Over the hills</h1><p>One &amp; two,<br>three&nbsp;four.<p>An <a href=x>inner</a> lin<b>k</b> and\n more; words, to weigh.</p>"
SAID = "Over the hills One & two, three four. An inner link and more; words, to weigh."
AROUND = [
    "<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style></head><body class='has-sidebar'><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav>{}<footer>&copy; us</footer></body></html>",
    "<body><div id=page><div class='site-header'>Brand</div><script>var t='</p>';</script>{}<aside>Also read this</aside><div class=\"cookie-notice\">We use cookies, a great many of them, for reasons.</div></div>",
    "<html><body><!-- a <p>comment</p> --><form><p>Your mail</p><input name=q><button>Go</button></form>{}<section class='comments'><article class='comment'><p>" + "First! " * 90 + "</p></article></section>",
    "<div class='adBox'>Buy</div>{}<div hidden>unseen</div><div style='display: none'>unseen</div><ul><li><a href=a>A</a><li><a href=b>B</a><li><a href=c>C</a></ul>",
]
HOLDERS = ["<article>{}</article>", "<div class='post-17 entry-content'>{}</div>", "<main><div><section>{}</section></div></main>"]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("holder", HOLDERS)
def test_the_article_alone(around, holder):
    page = page_text.Page(around.replace("{}", holder.format(ARTICLE)))
    assert page.text(page.best(page.scores())) == SAID


@pytest.mark.parametrize("html", ["", "<", "<p", "<!-- never closed", "<script>x", "</p></div>", "<div class='a", "a < b & c &amp", "<a <a <a", "&#0;&#xD800;&bogus;"])
def test_broken_pages(html):
    page = page_text.Page(html)
    scores = page.scores()
    assert isinstance(page.text(page.best(scores)) if scores else "", str)


def page(k, body, side):
    return f"<body><div class=a{k}b{k}><div class='text-{k}'>{body}</div><div class=col>{side}</div></div>"


def test_hosts_decide(spark):
    """Short articles beside long columns: the page alone would take the column, its host doesn't."""
    long, short = "".join(f"<p>Paragraph {i} tells of things, at length.</p>" for i in range(9)), "<p>Brief news.</p>"
    column = "<p>" + "All about this place and its people. " * 4 + "</p>"
    rows = [(k, f"http://Hills.example:80/{k}", page(k, long, column), "x") for k in range(300)] + [(900, "https://hills.example/short", page(7, short, column), "x")]
    rows += [(1000 + k, f"http://h{k}.example/", page(k, long, column), "x") for k in range(40)]
    rows += [(2000, "nowhere", page(7, short, column), "x"), (2001, None, page(7, long, column), "x"), (2002, "http://hills.example", None, "x"), (2003, "http://hills.example", "", "x"), (2003, "http://hills.example", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(7)
    got = page_text.main_text(pages)
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    want = " ".join(f"Paragraph {i} tells of things, at length." for i in range(9))
    texts = Counter((r["page_id"], r["text"]) for r in got.collect())
    alone = " ".join(("All about this place and its people. " * 4).split())
    brief = {900: "Brief news.", 2000: alone, 2002: "", 2003: ""}
    assert texts == Counter((r[0], brief.get(r[0], want)) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    hosts = {r["host"]: r for r in page_text.host_paths(pages).collect()}
    assert len(hosts) == 41 and hosts["hills.example"]["pages"] == 301 and all(len(r["keys"]) <= page_text.FIRST_SHARE + 1 for r in hosts.values())


def test_pages_of_the_template(spark):
    """Every given page: what lies in its article, by a pattern."""
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = Counter()
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want[r["page_id"], " ".join(unescape(re.sub(r"<[^<>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())] += 1
    assert Counter((r["page_id"], r["text"]) for r in page_text.main_text(pages).collect()) == want
