"""Centroids, page extraction and ranked search against brute force."""

import html
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import centroids, common, extraction, queries, ranked

# ---- centroids ----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_lloyd(x, first, rounds):
    c = [list(map(int, r)) for r in first]
    for number in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, m)) for m in c] for v in x]
        owner = [min(range(len(c)), key=lambda i: (row[i], i)) for row in d]
        if number < rounds:
            for i in range(len(c)):
                own = [v for v, o in zip(x, owner) if o == i]
                if own:
                    c[i] = [sum(v[j] for v in own) // len(own) for j in range(len(c[i]))]
    return owner, [row[o] for row, o in zip(d, owner)], c


def test_clusters_equal_plain_rounds(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 0.01, (40, 4)), r.normal(3, 0.5, (50, 4)), r.normal(-2, 0.7, (30, 4)), np.ones((5, 4)), np.ones((5, 4))]).astype(np.float32)
    odd = [(900, None, 1), (901, [1.0, 2.0], 1), (902, [1.0, None, 0.0, 0.0], 1), (903, [math.nan] * 4, 1), (904, [math.inf, 0.0, 0.0, 0.0], 1), (None, [0.5] * 4, 1)]
    rows = [(i % 128, v.tolist(), 0) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame(rows, VECTORS).withColumns({"owner": F.lit("x"), "q": F.lit(1), "distance": F.lit(2)})
    got = centroids.cluster(df, k=7, dims=4).collect()
    assert len(got) == len(x) + 1
    import hashlib

    kept = [(i, [math.floor(256 * v) for v in vec]) for i, vec, _ in rows[: len(x)]] + [(None, [128] * 4)]
    key = lambda v: (v[0] is None, hashlib.sha256(f"2:{v[0]}".encode()).hexdigest(), v[1])
    owner, distance, means = plain_lloyd([v for _, v in kept], [v for _, v in sorted(kept, key=key)[:7]], 5)
    want = Counter((i, tuple(v), o, d) for (i, v), o, d in zip(kept, owner, distance))
    assert Counter((g.vec_id, tuple(g.q), g.cluster, g.distance) for g in got) == want
    for g in got:
        assert list(g.centroid) == means[g.cluster]
        assert g.cluster_inertia == sum(d for o, d in zip(owner, distance) if o == g.cluster) and g.inertia == sum(distance)


def test_rounds_compare_changed_centroids_only():
    r = np.random.default_rng(1)
    x, c = r.integers(-900, 900, (500, 8)), r.integers(-900, 900, (20, 8))
    owner, d, done = centroids.reassign(x, np.full(500, -1), np.zeros(500, np.int64), c, np.ones(20, bool))
    assert done == 500 * 20
    new = c.copy()
    new[3] += 40
    new[7] = c[2]  # a tie with a smaller number
    changed = (new != c).any(1)
    again, d2, done = centroids.reassign(x, owner, d, new, changed)
    full = centroids.distances(x, new)
    assert (again == full.argmin(1)).all() and (d2 == full.min(1)).all()
    assert done < 500 * 2 + 20 * (np.isin(owner, [3, 7]).sum()) + 500
    assert centroids.reassign(x, again, d2, new, np.zeros(20, bool))[2] == 0


def test_large_components_are_exact():
    x, c = np.array([[1 << 26, -(1 << 26)]]), np.array([[-(1 << 26), (1 << 26) - 1]])
    assert centroids.distances(x, c)[0, 0] == (1 << 27) ** 2 + ((1 << 27) - 1) ** 2


def test_clusters_of_nothing_and_of_too_large_a_component(spark):
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    few = spark.createDataFrame([(1, [0.0] * 64, 0), (2, [1.0] * 64, 0)], VECTORS)
    assert sorted((r.vec_id, r.distance) for r in centroids.cluster(few).collect()) == [(1, 0), (2, 0)]
    with pytest.raises(Exception, match="out of range"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64, 0)], VECTORS))


# ---- page extraction ----------------------------------------------------------------------------


def cut_cost(gain, edges, label):
    return sum(-min(g, 0) if x else max(g, 0) for g, x in zip(gain, label)) + sum(c for u, v, c in edges if label[u] != label[v])


def test_min_cut_is_the_cheapest_labelling():
    r = random.Random(3)
    for _ in range(150):
        n = r.randint(1, 9)
        gain = [r.randint(-6, 6) for _ in range(n)]
        edges = [(u, v, r.randint(1, 6)) for u, v in itertools.combinations(range(n), 2) if r.random() < 0.5]
        best = min(cut_cost(gain, edges, x) for x in itertools.product([False, True], repeat=n))
        assert cut_cost(gain, edges, extraction.min_cut(gain, edges)) == best
        assert cut_cost(gain, edges, extraction.max_flow(gain, edges)) == best


P1, P2 = "The first paragraph tells, at some length, what happened on the day before.", "A second one follows it; it is no shorter than the first was, nor longer."
PAGES = {
    f"<html><body><header><h1>Site</h1><nav><a href='/'>Home</a></nav></header><main><h1>Title</h1><p>{P1}</p><p>{P2}</p></main><footer>All rights</footer></body></html>": f"Title\n{P1}\n{P2}",
    f"<body class='has-sidebar'><div id='cookie-notice'>We use cookies, as everyone does; please accept them all.</div><article><header><h1>T &amp; u</h1></header><p>{P1}<div class='ad-box'>Buy these shoes now, they are the best of shoes.</div><p>{P2}</article><aside>{P1} Other</aside>": f"T & u\n{P1}\n{P2}",
    f"<article><p>{P1}</p><p>Yes.</p><p>{P2}</p><section id='comments'><article class='comment'><p>I do not agree with what was said here, not at all.</p></article></section></article>": f"{P1}\nYes.\n{P2}",
    f"<form id=f><article><p>{P1}<br>{P2}</p><form><label>Name</label><input name=n><button>Send it</button></form></article></form>": f"{P1} {P2}",
    f"<div class='navbar'><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div class='content'><p>{P1}</p><ul><li>First thing, with a comma.<li>Second thing.</ul><p>{P2}</p></div><div class='footer'><p>{P2} Legal</p></div>": f"{P1}\nFirst thing, with a comma.\nSecond thing.\n{P2}",
    f"<p>{P1}</p><script>var x='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p>{P2}</p>": f"{P1}\n{P2}",
    f"<main><p>a &lt;b&gt; c, {P1}</p><table><tr><td>x, y.<td>z, w.</table><p title='>'>{P2}</p><noscript>{P1}</noscript></main>": f"a <b> c, {P1}\nx, y.\nz, w.\n{P2}",
    f"<div><div><p>{P1}</p>\n\n<p>{P2}</p></div><div><a href=1>More</a> <a href=2>News</a> <a href=3>Sport</a></div></div>": f"{P1}\n{P2}",
    "": "",
    "<script>never ends": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text_of_written_pages(page):
    assert extraction.main_text(page) == PAGES[page]


@pytest.mark.parametrize(
    "hard",
    ["<div>" * 60_000 + "x", "<p " * 100_000, "<a b='" * 50_000, "</p>" * 100_000, "<!--" * 100_000, "<b><li>" * 40_000 + "x", "<b>" * 40_000 + "<li>a</li>" * 20_000, "<span>" * 40_000 + "</i>" * 40_000, "<script>" * 50_000, "<p>so so" * 50_000, "&" * 300_000, "<a title=\"'>" * 40_000, "x " * 500_000, "<p>" + "<a>y</a>" * 60_000],
    ids=range(14),
)
def test_hard_pages_take_linear_time(hard):
    began = time.time()
    extraction.main_text(hard)
    assert time.time() - began < 20


def article_of(page):
    """The text of the test tables' pages, read by their template."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_extraction_of_the_tables_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op12_html_extraction(spark, sf).collect()
    assert len(got) == len(pages) > 0
    for r in got:
        assert r.text == article_of(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_extraction_odd_rows(spark):
    good = next(iter(PAGES))
    rows = [(1, "u", None), (2, None, ""), (None, "v", good), (3, "w", good), (3, "w", good), (4, "x", "no markup here, only text that is long enough to be read.")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("z"), "label": F.lit(0)})
    got = Counter((r.page_id, r.text) for r in extraction.extract(df).collect())
    assert got == Counter({(1, ""): 1, (2, ""): 1, (None, PAGES[good]): 1, (3, PAGES[good]): 2, (4, rows[-1][2]): 1})
    assert extraction.extract(df.limit(0)).count() == 0


def test_fitted_weights_prefer_prose(spark, sf):
    weights = extraction.fit(spark.read.parquet(f"{sf}/pages.parquet"))
    assert weights != extraction.PLAIN_WEIGHTS
    page = extraction.read_page(f"<div><ul><li><a href=x>One</a></li></ul><p>{P1} {P2}</p></div>")
    link, prose = extraction.log_odds(page.blocks, weights)
    assert prose > link


# ---- ranked search ------------------------------------------------------------------------------

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERMS.findall((text or "").translate(LOWER))


def brute_ranking(docs, items, most):
    tf = [Counter(words(t)) for _, t in docs]
    n = [c.total() for c in tf]
    count, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c, size in zip(docs, tf, n):
            m = size and 75 + (25 * size * count) // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:most])]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "日本", "x9"]
    pick = lambda n: " ".join(vocabulary[min(int(r.expovariate(0.08)), 62)] + r.choice(["", ".", ", ", "-"]) for _ in range(n))
    docs = [(i, pick(r.randint(0, 60))) for i in range(300)]
    docs += [(7, pick(10)), (None, docs[3][1]), (1000, None), (1001, ""), (1002, "!!"), (1003, "w1 " * 5000), *[(2000 + i, "w50 w51 w52 copy") for i in range(120)]]
    items = [(i, pick(r.randint(1, 40))) for i in range(25)] + [(3, "W50 w51 copy copy"), (None, "w1"), (90, None), (91, "unknownterm"), (92, "日本 über Über")]
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", 700)
    monkeypatch.setattr(ranked, "ITEM_BLOCK", 10)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"shard": F.lit(1), "term": F.lit("q"), "ids": F.lit(0)}).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("s"))
    got = ranked.search(ranked.build_index(df, common.scratch_path(spark, "index")), q, most=20).collect()
    assert Counter(map(tuple, got)) == Counter(brute_ranking(docs, items, 20))


def test_search_of_nothing(spark):
    empty, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(ranked.build_index(empty, common.scratch_path(spark, "index")), one).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ranked.search(ranked.build_index(docs, common.scratch_path(spark, "index")), one.limit(0)).count() == 0


def test_block_borders_are_the_cheapest():
    def cheapest(x, cost):
        best = [0.0]
        for j in range(1, len(x) + 1):
            best.append(min(best[i] + (j - i) * max(x[i:j]) - sum(x[i:j]) + cost for i in range(max(0, j - ranked.MAX_BLOCK), j)))
        return best[-1]

    r = np.random.default_rng(2)
    lists = [r.integers(1, 1000, n) for n in (1, 2, 3, 64, 65, 200, 512, 1, 900, 0, 5)]
    offsets = np.cumsum([0, *map(len, lists)])
    score = np.concatenate(lists)
    ends = ranked.block_ends(score, offsets, 1500.0)
    for x, a, b in zip(lists, offsets, offsets[1:]):
        cuts = [a, *ends[(ends > a) & (ends <= b)]]
        assert cuts[-1] == b
        spent = sum((j - i) * score[i:j].max() - score[i:j].sum() + 1500 for i, j in zip(cuts, cuts[1:]))
        want = sum(cheapest(x[k : k + ranked.SEGMENT], 1500) for k in range(0, len(x), ranked.SEGMENT))
        assert spent == want


def test_light_lists_are_read_for_few_documents():
    """A rare term and a common one: the common one's list is not walked."""
    common_docs = np.arange(20_000)
    rare = np.array([5, 70, 400, 9000])
    lists = {
        "list": np.array([0, 20_000, 20_004]), "docs": np.concatenate([common_docs, rare]), "impacts": np.full(20_004, 400_000), "block": np.array([0, 1, 2]),
        "top": np.array([400_000, 400_000]), "first": np.array([0, 5]), "last": np.array([19_999, 9000]), "max": np.array([400_000, 400_000]),
    }
    docs, scores, read = ranked.best_of_shard([(0, 10), (1, 9000)], lists, 3, np.arange(20_000), np.ones(20_000, bool))
    assert docs.tolist() == [5, 70, 400] and set(scores.tolist()) == {9010 * 400_000} and read < 100


# ---- hard texts of the toxicity features ----------------------------------------------------------


def test_hidden_words_in_linear_time():
    from quillspark.llm.toxicity import hidden_words

    told = re.compile(r"(?<!\w)(?=[A-Za-z@$])(?:[A-Za-z]*[0-9@$*!_-]+[A-Za-z]+)+[A-Za-z]*(?!\w)")  # the rule itself; exponential
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice("abZ1@-_!é *.") for _ in range(r.randint(1, 14)))
        assert [m.group().lower() for m in told.finditer(text)] == hidden_words(text), text
    began = time.time()
    for hard in ("a" + "1bb" * 22 + "1", "a" + "1bb" * 4000 + "1", "a9_-" * 2500 + "0", "a" * 10_000, "@" * 10_000, "ab1" * 200_000):
        hidden_words(hard)
    assert time.time() - began < 2


# ---- near-duplicates by similarity ------------------------------------------------------------------


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


BANDS = (0.8, 0.85, 0.9, 0.95)


def planted_pairs(each, seed=4):
    """(band, text, edited text) with the similarity in the band, by random replaced words."""
    r, out, have = random.Random(seed), [], Counter()
    while min(have[b] for b in BANDS) < each:
        w = [f"{r.choice('abcdefgh')}{r.randrange(9000)}" for _ in range(r.randint(60, 500))]
        e = list(w)
        for _ in range(r.randint(1, max(1, len(w) // 35))):
            e[r.randrange(len(e))] = f"z{r.randrange(9000)}"
        a, b = " ".join(w), " ".join(e)
        j = jaccard(a, b)
        band = max((x for x in BANDS if x <= j), default=None)
        if band and j < 1 and have[band] < each:
            have[band] += 1
            out.append((band, a, b))
    return out


@pytest.mark.parametrize("hot", [200_000, 50])
def test_recall_of_planted_pairs_by_band(spark, hot):
    from quillspark.llm import simhash

    pairs = planted_pairs(500)  # 2,000 pairs
    rows = [(2 * i + k, (a, b)[k]) for i, (_, a, b) in enumerate(pairs) for k in (0, 1)]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), hot_anchor=hot).collect()}
    for band in BANDS:
        own = [i for i, p in enumerate(pairs) if p[0] == band]
        found = sum(got[2 * i + 1] == 2 * i for i in own) / len(own)
        print(band, found)
        assert found >= 0.9, (band, found)
    assert all(c in (d, d - d % 2) for d, c in got.items())  # nothing else links


def test_equal_fingerprints_of_unlike_texts_do_not_link(spark):
    from quillspark.llm import simhash

    loop = " ".join("one two three four five six seven".split() * 400)
    a, b = (loop + " " + " ".join(f"{k}{i}" for i in range(20)) for k in "ab")
    assert jaccard(a, b) < 0.2
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (4, "X y"), (5, "x  Y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_next_neighbours_stand_in():
    from quillspark.llm import simhash

    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, (1, simhash.WIDE)).astype(np.uint64)
    fp = np.repeat(base, 6, 0)
    fp[:, 0] ^= (np.uint64(1) << np.arange(6, dtype=np.uint64)) - np.uint64(1)
    a, b = simhash._forests(np.arange(6), fp, np.full(6, 100), 40, 0.8)
    assert len(set(zip(a.tolist(), b.tolist()))) == len(a) == 15  # three forests are all pairs of six
    assert len(simhash._forests(np.arange(2), fp[:2], np.array([100, 79]), 40, 0.8)[0]) == 0


@pytest.mark.parametrize("block", [128, 3])
def test_links_beyond_the_forests_are_found(spark, block, monkeypatch):
    """Families whose texts are all candidates of each other and of which few link: the links that
    no forest holds must be found all the same."""
    from quillspark.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    r = random.Random(5)
    rows = []
    for family in range(12):
        base = [f"{r.choice('abcdefgh')}{r.randrange(9000)}" for _ in range(300)]
        for k in range(40):  # the last two have a similarity of about 0.82, the others at most 0.79
            e = list(base)
            for at in r.sample(range(300), 4 if k < 38 else 3):
                e[at] = f"z{r.randrange(9000)}"
            rows.append((len(rows), " ".join(e)))
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    want = {}
    for i, _ in rows:
        if i in want:
            continue
        want[i], queue = i, [i]
        while queue:
            x = queue.pop()
            for y in range(x - x % 40, x - x % 40 + 40):
                both = len(sets[x] & sets[y])
                if y not in want and both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                    want[y] = i
                    queue.append(y)
    assert 12 < len(set(want.values())) < len(rows)
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
