"""Spelling variants, periodic runs and main text against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
from collections import Counter

import pytest

from saldo.llm import density, queries, runs, variants


def brute_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if brute_near(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (n, len(near), form, counts[form] if form else None)
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] += (root,)
    return out


def texts_of(seed, size):
    r = random.Random(seed)
    stems = ["".join(r.choice("abceéz") for _ in range(r.randrange(4, 9))) for _ in range(size)]
    out = []
    for i in range(60):
        words = []
        for _ in range(r.randrange(80)):
            w = list(r.choice(stems))
            if r.random() < 0.4:
                k = r.randrange(len(w))
                w[k : k + r.randrange(2)] = r.choice(["", "a", "É", "x"])
            words.append("".join(w))
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("shard", [1, 7, 20_000])
def test_variants(documents, shard):
    long_word = "q" * 300
    rows = [*texts_of(3, 40), (None, "Größe größe GRÖSSE grösse"), (70, None), (71, ""), (72, "1 2 3 !"), (73, f"{long_word} {long_word} {long_word}A{'b' * 5}, {long_word}"), (74, " ".join([long_word[1:]] * 3)), (0, texts_of(3, 40)[0][1])]
    counts = Counter()
    for i, t in rows:
        for w in variants.RUN.findall((t or "").encode().lower().decode()):
            counts[queries.slipped(i, w)] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    assert long_word in counts and long_word[1:] in counts
    words = variants.counted(documents(rows), change=queries.slipped)
    got = variants.variants(words, shard=shard, queries=11).collect()
    assert len(got) == len(counts)
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == brute_variants(counts)


def test_chains_ties_and_empty_tables(documents, spark):
    rows = [("aaaaa", 100), ("aaaab", 40), ("aaabb", 20), ("aabbb", 9), ("aaaac", 100), ("zzzzz", 3), ("aaaa", 50), ("abbbb", 5)]
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in variants.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["aaaab"] == ("aaaaa", "aaaaa", 4)  # two near words of 100: the first
    assert got["aabbb"] == ("aaabb", "aaaaa", 2) and got["abbbb"] == (None, "abbbb", 1) and got["zzzzz"] == (None, "zzzzz", 0)
    assert got["aaaa"] == ("aaaaa", "aaaaa", 3) and got["aaaaa"] == (None, "aaaaa", 3)
    assert variants.variants(variants.counted(documents([]))).count() == 0
    assert variants.variants(variants.counted(documents([(1, None), (2, "")]))).count() == 0


def test_anagrams_of_one_leaf_are_split(spark):
    r = random.Random(8)
    words = list({"".join(r.sample("aabbccddee", 10)) for _ in range(150)} | {"".join(r.sample("aabbccdde", 9)) for _ in range(60)})
    counts = {w: 3 + k % 5 for k, w in enumerate(words)}
    got = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), shard=10, queries=20).collect()
    assert {x["word"]: (x["n"], x["n_near"], x["form"], x["form_n"], x["root"]) for x in got} == brute_variants(counts)


def brute_lyndon(x):
    return [next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x)) - i for i in range(len(x))]


def test_groups_are_lyndon_prefixes():
    r = random.Random(1)
    for _ in range(400):
        x = [r.randrange(r.randrange(1, 5)) for _ in range(r.randrange(1, 24))]
        x = [sorted(set(x)).index(v) for v in x]
        width, group = runs.lyndon(x)
        assert width.tolist() == brute_lyndon(x), x
        for i in range(len(x)):
            for j in range(i):
                assert (group[i] == group[j]) == (x[i : i + width[i]] == x[j : j + width[j]])


def brute_runs(x, least, times):
    out = []
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, times * q) and not any(a <= s and e <= a + n for a, n, _ in out):
                out.append((s, e - s, q))
    return sorted(out, key=lambda v: (v[0], v[2]))


def periodic_texts():
    r = random.Random(2)
    for i in range(120):
        words = []
        for _ in range(r.randrange(1, 7)):
            unit = [f"w{r.randrange(r.choice([2, 3, 30]))}" for _ in range(r.randrange(1, 13))]
            words += (unit * r.randrange(1, 9))[: r.randrange(1, 80)]
        yield i, " \n".join(words)


def test_periodic_runs(documents, spark):
    rows = [*periodic_texts(), (500, None), (501, ""), (502, " \t\n"), (503, "tick " * 30000), (504, "a b " * 11 + "a"), (505, "x y z " * 12), (None, "tick " * 30), (503, "one two"), (506, "a b c d " * 6)]
    got = runs.periodic(documents(rows)).collect()
    assert len(got) == len(rows)
    have = Counter((r["doc_id"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), tuple(r["top"]) if r["top"] else None, r["collapsed"]) for r in got)
    want = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        found = brute_runs(w, 24, 3) if len(w) < 10000 else [(0, len(w), 1)]
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        top = max(found, key=lambda v: (v[1] / v[2], -v[0], -v[2]), default=None)
        want[i, tuple(found), top, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    assert have == want
    assert runs.periodic(documents([])).count() == 0


def test_looped_texts_and_digests(documents, spark, tmp_path):
    rows = [(i, t) for i, t in periodic_texts()] + [(900, None), (901, "")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert any(queries.looped(i, t) != runs.split(i, t) for i, t in rows)
    for i, t in rows:
        w = queries.looped(i, t)
        found = brute_runs(w, 24, 3)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        top = max(found, key=lambda v: (v[1] / v[2], -v[0], -v[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert (got[i]["n_runs"], got[i]["start"], got[i]["length"], got[i]["period"]) == (len(found), *top)
        assert got[i]["exponent_milli"] == (1000 * top[1] // top[2] if found else None)
        assert got[i]["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert got[i]["collapsed_sha256"] == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()


P1, P2, P3 = "The first paragraph tells what happened, at some length, to all who were there.", "A second one &amp; more, with <b>bold</b> and <a href='x'>a link</a> in it.", "To end."
TEXT = "The first paragraph tells what happened, at some length, to all who were there. A second one & more, with bold and a link in it. To end."
MENU = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Entry {k}</a></li>" for k in range(9)) + "</ul></nav>"
PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{MENU}<div class='ad'>Buy now, it is cheap and good and long enough to be a text of its own.</div>"
     f"<article><h1>Head</h1><p><b>{P1}<br><p>{P2}</p><p>{P3}</p></article><footer>&copy; us</footer>", "Head " + TEXT),
    (f"<body><header><h1>Site</h1></header><div id=content><h2>Head</h2><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div class='post-comments'><p>{'So nice! ' * 40}</p></div><aside><p>{P1}</p></aside></body>", "Head " + TEXT),
    (f"<main><header><h1>Head</h1></header><section><p>{P1}<p>{P2}<form><input>Name <button>Go</button></form><p>{P3}</section><div class='cookie-notice'>We use cookies</div></main>{MENU}", "Head " + TEXT),
    (f"<article class='has-sidebar'><ul><li>{P1}<li>{P2}</ul><table><tr><td>{P3}<td>x</table></article><div role='contentinfo'>Imprint</div>", TEXT + " x"),
    (f"<div>{MENU}</div><div><div><p>{P1}</p></div><p>{P2}</p><p>{P3}</p></div><ul>" + "<li><a href=x>Read more</a></li>" * 20 + "</ul>", TEXT),
    ("just text &lt;b&gt; &#233;&nbsp;x", "just text <b> é x"),
    ("<article>x</article>", "x"),
    ("<article></article>", ""), (None, ""), ("", ""), ("   ", ""), ("<nav><a href=x>y</a></nav>", ""), ("<article><p>cut of</p><p>here <a hre", "cut of here"), ("<!-- open <p>x</p>", ""),
    ("<article><p>a<span>b</span>c</p>d<br>e&amp;amp;</article>", "abc d e&amp;"),
    ("<p>" + "<div>" * 30000 + "deep" + "</b></div>" * 30000, "deep"),
    ("<article>" + "<p>word</p>" * 20000 + "</article>", " ".join(["word"] * 20000)),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_main_text(k):
    assert density.main_text(PAGES[k][0]) == PAGES[k][1]


def test_hostile_pages_are_linear():
    for part in ("<a ", "<a \"", "<a '", "<!--", "<b", "</p>", "<p><b>", "&", "<ul><li>", "<table><td>", "<script>", "<a href='x' class=\""):
        density.main_text(part * 40000)


def test_extracted_table(spark):
    rows = [(i % 4 or None, None if i == 3 else f"http://x/{i}", p, "x", "y") for i, (p, _) in enumerate(PAGES)]
    got = density.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")).collect()
    assert Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got) == Counter((r[0], r[1], w, len(w)) for r, (_, w) in zip(rows, PAGES))
    assert density.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
