"""Operators of the llm subpackage against brute force, SQL and round trips."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import common, embeddings, language, mixing, packing, pii, queries, secrets, simhash, sketches, toxicity, warc
from quillspark.llm.components import components

from ..compare import same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    # columns whose names the operators use themselves
    return df.withColumn("key", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("kept", F.lit(False)) if extra else df


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], sf)


# ---- WARC ---------------------------------------------------------------------------------------

INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_warc_round_trip(spark):
    big = "x" * 200_000
    pages = [(1, "u", "a" * 150), (2, "u 2", "a" * 150), (3, None, None), (4, "v", "short"), (5, "v", "short"), (6, "w", "pre" + INNER * 3 + "post"), (7, "w", "WARC/1.1\r\n")]
    pages += [(8, "w", big + "WARC/1.1\r\n" + big + INNER + "é" * 1000), (9, "x", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\nq"), (None, "n", "b" * 200), (10, "n", "b" * 200), (11, "z", INNER + big + INNER)]
    pages += [(100 + i, "r", "WARC/1.1\r\nfoo\r\n\r\n" * (i % 4) + str(i) * i) for i in range(120)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        path = common.scratch_path(spark, "t")
        warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), path)
        got = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(pages)
    same_payload = {}
    for i, _, h in pages:
        same_payload.setdefault(h or "", []).append(i)
    for i, _, h in pages:
        body = (h or "").encode()
        first = min(x for x in same_payload[h or ""] if x is not None)
        revisit = len(body) >= 100 and i != first
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
        assert r.verified != revisit


def test_warc_empty(spark):
    path = common.scratch_path(spark, "t")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0


# ---- toxicity -----------------------------------------------------------------------------------


def test_toxicity_held_out_accuracy(spark):
    r = random.Random(3)
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(i, 60).split()
        if bad:
            for _ in range(4):
                words.insert(r.randrange(60), r.choice(["idiot", "gremlok" + r.choice("abcd"), "you pathetic"]))
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    texts[7], texts[9] = None, ""
    d, lab = docs(spark, texts, extra=True), spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(d, lab).collect()}
    assert len(got) == 400 and all(0 <= x.score <= 1 for x in got.values())
    for i, x in got.items():
        assert x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert x.predicted == int(x.score >= 0.5)
    held = [i for i, x in got.items() if x.held_out]
    assert sum(got[i].predicted == int(i % 4 == 0) for i in held) / len(held) > 0.93
    assert got[7].predicted == got[9].predicted == 0


def test_toxicity_without_labels(spark):
    d = docs(spark, ["you idiot", "fine words here", None])
    got = {x.doc_id: x.predicted for x in toxicity.score(d, spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert got == {0: 1, 1: 0, 2: 0}
    assert toxicity.score(d.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


# ---- secrets ------------------------------------------------------------------------------------


def base_spans(text):
    """The base rules straight from their definition."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(secrets.BASE_RULES):
        for m in re.compile(pattern, re.ASCII).finditer(text):
            if len(m.group(group)) >= least:
                found.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def test_secrets_match_brute_force(spark):
    r = random.Random(5)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789XY", "deadbeef" * 3, "é", "abc", "x", "\n", "ghp_" + "a" * 40, "ſecret=abcdefgh"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 60))) for _ in range(400)]
    texts += [None, "", "password=short", 'token = "69760a67bd64a3aa"', "AKIA" + "A" * 15, "AKIA" + "A" * 16, "x" * 100_000 + " secret:abcdefg"]
    got = {x.doc_id: x.findings for x in secrets.scan_secrets(docs(spark, texts, extra=True)).collect()}
    base = {rule.kind for rule in secrets.BASE_RULES}
    for i, t in enumerate(texts):
        assert [f"{f.kind}:{f.start}:{f.end}" for f in got[i] if f.kind in base] == base_spans(t or "")
        assert all((t or "")[f.start : f.end] == f.value for f in got[i])


def test_trigram_queries():
    q = secrets.trigram_query("AKIA[A-Z0-9]+")
    assert q == [[frozenset({b"aki", b"kia"})]]
    assert secrets.trigram_query("[0-9a-f]{24,}") == []
    assert secrets.trigram_query("ab|xyz") == []
    for rule in secrets.RULES:
        for clause in secrets.trigram_query(rule.pattern):
            assert clause and all(clause)


# ---- languages ----------------------------------------------------------------------------------


def plain_bucket(t):
    a, b, c = ((ord(x) * k) & 0xFFFFFFFF for x, k in zip(t, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)))
    h = a ^ b ^ c
    h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
    return (h ^ h >> 13) & 16383


def plain_trigrams(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    line = f" {' '.join(words)} " if words else ""
    return [plain_bucket(line[i : i + 3]) for i in range(len(line) - 2)]


def test_languages_match_brute_force(spark):
    vocabulary = {"de": "der die und nicht straße über auch für".split(), "en": "the and with this house over also for".split(), "fr": "le la et être maison déjà aussi pour".split()}
    r = random.Random(3)

    def text(lang, n):
        return " ".join(r.choice(vocabulary[lang]) for _ in range(n))

    train = [(i, text(x, 40), y) for i, (x, y) in enumerate([("de", "de"), ("en", "EN-us"), ("fr", "fr"), ("de", "de"), ("en", "en")] * 4)] + [(90, None, "de"), (91, "x", None), (92, "x", "")]
    pages, shown = [], []
    for i in range(60):
        lang, site = r.choice(sorted(vocabulary)), r.choice(["a.example.com", "b.example.de", "C.example.fr:80", "d.ch", None])
        said, body = r.choice([lang, lang, "en", None, "xx"]), text(lang, r.choice([0, 1, 3, 30]))
        tag = f'<html class="x" lang="{said}-X">' if said else "<html>"
        pages.append((i // 2, f"https://{site}/p{i}" if site else "no address", f"{tag}<script>the and</script><nav>{text('en', 9)}</nav><!-- the --><p>{body} &amp; </p>"))
        own = body if len(re.findall(r"[^\W\d_]", body)) >= 20 else None
        shown.append((site.lower().split(":")[0] if site else None, said, own if own is not None else f"{pages[-1][2].split('<nav>')[1].split('</nav>')[0]} {body}"))
    pages += [(None, None, None), (70, "http://d.ch/", ""), (71, "//u@d.ch", "<p>12")]
    shown += [(None, None, ""), ("d.ch", None, ""), ("d.ch", None, "")]

    langs = ["de", "en", "fr"]
    count = {x: [0.5] * 16384 for x in langs}
    for _, t, lang in train:
        if t and lang:
            for b in plain_trigrams(t):
                count[lang.lower()[:2]][b] += 1
    country = {"de": ["de"], "fr": ["fr"], "ch": ["de", "fr"]}

    def told(named, right):
        named = [x for x in named if x in langs]
        return [np.log(right / len(named)) if x in named else np.log((1 - right) / (3 - len(named))) for x in langs] if named else [0.0] * 3

    evidence = []
    for site, said, t in shown:
        grams = plain_trigrams(t)
        weight = min(len(grams) / 3, 100) / len(grams) if grams else 0
        e = np.array([weight * sum(np.log(count[x][b] / sum(count[x])) for b in grams) for x in langs])
        evidence.append(e + told([said], 0.9) + told(country.get((site or "").split(".")[-1], []), 0.7))
    shares = [np.exp(e - e.max()) / np.exp(e - e.max()).sum() for e in evidence]
    want = []
    for i, (site, said, _) in enumerate(shown):
        whole = (sum(s for j, s in enumerate(shares) if j != i) + 1) / (len(shares) - 1 + 3)
        ending = [s for j, s in enumerate(shares) if site and (shown[j][0] or "").split(".")[-1] == site.split(".")[-1] and j != i]
        near = (sum(ending) + 32 * whole) / (len(ending) + 32)
        others = [s for j, s in enumerate(shares) if site and shown[j][0] == site and j != i]
        score = evidence[i] + np.log((sum(others) + 8 * near) / (len(others) + 8))
        p = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        want.append((str(pages[i][0]), str(site), str(said), langs[int(p.argmax())], round(float(p.max()), 5)))

    d = spark.createDataFrame(train, "doc_id long, text string, lang string")
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(str(x.page_id), str(x.host), str(x.declared), x.lang, round(x.probability, 5)) for x in language.identify(p, d).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-4
    assert language.identify(p.limit(0), d).count() == 0
    assert {x.lang for x in language.identify(p, d.limit(0)).collect()} == {None} and language.identify(p, d.limit(0)).count() == len(pages)


# ---- embeddings ---------------------------------------------------------------------------------


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((600, 32)).astype(np.float32)
    base[100:160] = base[0] + 0.1 * rng.standard_normal((60, 32)).astype(np.float32)
    base[160:170] = base[5]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    odd = [(900, None), (901, [0.0] * 32), (902, [1.0, None] + [0.0] * 30), (903, [float("nan")] + [1.0] * 31), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    u = base.astype(float) / np.linalg.norm(base.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    found = total = 0
    for cell in (4096, 64):  # one cell, and many with blocks
        got = {x.vec_id: x for x in embeddings.near_duplicates(df, cell=cell).collect()}
        assert len(got) == len(rows) + len(odd)
        for i in range(600):
            true = near[i].sum() - 1
            assert got[i].n_links <= true
            found, total = found + got[i].n_links, total + true
        assert {got[i].component_id for i in range(160, 170)} == {5} and got[120].component_id == 0
        assert all(got[i].n_links == 0 and got[i].component_id == i for i, _ in odd)
    assert found >= 0.95 * total
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_on_shifted_and_clustered_vectors(spark):
    rng = np.random.default_rng(6)
    shifted = rng.standard_normal((1500, 24)) + 1.5  # far from the origin, all on one side
    centres = rng.standard_normal((12, 24))
    clustered = centres[rng.integers(0, 12, 1500)] + 0.45 * rng.standard_normal((1500, 24))
    for base in (shifted, clustered):
        u = base / np.linalg.norm(base, axis=1, keepdims=True)
        near = u @ u.T >= 0.9
        np.fill_diagonal(near, False)
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
        got = np.array([r.n_links for r in embeddings.near_duplicates(rows, cell=128).orderBy("vec_id").collect()])
        assert near.sum() > 500 and (got <= near.sum(1)).all() and got.sum() >= 0.95 * near.sum()
    with pytest.raises(ValueError):
        embeddings.Plan(u, 1 << 40, recall=0.9999, cell=1)


def test_embedding_links_of_every_length(spark):
    rng = np.random.default_rng(4)
    rows = []
    for dims, n in ((16, 60), (24, 40), (8, 1)):
        v = rng.standard_normal((n, dims)).astype(np.float32)
        v[1::4] = v[::4][: len(v[1::4])] * 2  # links of cosine 1
        v[3::4] = v[2::4][: len(v[3::4])]  # equal vectors
        rows += [(len(rows) + i, [float(x) for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {x.vec_id: (x.n_links, x.component_id) for x in embeddings.near_duplicates(df).collect()}
    assert got == {i: (1, i - i % 2) for i in range(100)} | {100: (0, 100)}


# ---- SimHash ------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def reachable(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_simhash_components_match_brute_force(spark):
    texts = [None, "", "  \n", "one", "One", "two words"]
    for k in range(12):
        t = prose(k, 150)
        texts += [t, t.upper(), t + " tail", t.replace("alpha", "alphas", 1), prose(k + 100, 40)]
    for k in range(30):  # a family of near copies
        w = prose(999, 200).split()
        w[k * 5] = f"edit{k}"
        texts.append(" ".join(w))
    prints = [plain_fingerprint(t) for t in texts]
    want = reachable(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    for hot in (200_000, 2):  # whole anchors, and all of them split
        got = {x.doc_id: x for x in simhash.near_duplicates(docs(spark, texts, extra=True), hot_anchor=hot).collect()}
        assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == prints
        assert [got[i].component_id for i in range(len(texts))] == want
    assert simhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_similar_documents_match_brute_force(spark):
    texts = [None, "", "  \n", "one", "One", "two words", "two words three"]
    for k in range(40):
        w = prose(k, 120 + k).split()
        texts.append(" ".join(w))
        for edits in (1, 2, 3, 5, 8):  # similarities from about 0.92 to 0.5
            v = list(w)
            for at in range(edits):
                v[10 + at * 13] = f"edit{at}"
            texts.append(" ".join(v))
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]

    def alike(i, j):
        both = len(sets[i] & sets[j])
        return sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) > 0

    want = reachable(len(texts), alike)
    for hot in (200_000, 3):
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(spark, texts, extra=True), hot_anchor=hot).collect()}
        same = sum(got[i] == want[i] for i in range(len(texts)))
        assert same >= 0.97 * len(texts) and all(got[i] >= want[i] for i in range(len(texts)))
    twice = docs(spark, texts[:8]).union(docs(spark, texts[:8])).withColumn("doc_id", F.nullif("doc_id", F.lit(3)))
    got = simhash.similar_documents(twice).collect()
    assert len(got) == 16 and {r.component_id for r in got if r.doc_id is None} == {4}
    assert simhash.similar_documents(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("n, spread", [(3000, 1.0), (900, 0.0), (700, 5.0)])
def test_size_windows_lose_no_candidate(n, spread):
    rng = np.random.default_rng(n)
    fp = rng.integers(0, 1 << 63, (n, simhash.WIDE)).astype(np.uint64)
    fp[1::3] = fp[: len(fp[1::3])] ^ (np.uint64(1) << rng.integers(0, 64, (len(fp[1::3]), 1)).astype(np.uint64))
    size = np.exp(rng.normal(4, spread, n)).astype(np.int64) * (rng.random(n) > 0.1)
    want = np.zeros(n, bool)
    for i in range(n):
        near = np.bitwise_count(fp ^ fp[i]).sum(1) <= 45
        near &= np.minimum(size, size[i]) >= 0.8 * np.maximum(size, size[i])
        near[i] = False
        want[i] = near.any()
    assert (simhash._near_any(fp, size, 45, 0.8) == want).all() and 0 < want.sum() < n


@pytest.mark.parametrize("length, radius_words", [(31, 16), (15, 8)])
def test_anchors_cover(length, radius_words):
    x = np.random.default_rng(0).integers(0, 1 << length, 200)
    rows, words = simhash.anchors(x, length)
    assert (simhash._syndrome(words, length) == 0).all()
    assert (np.bitwise_count(words ^ x[rows]) <= 2).all()
    assert np.bincount(rows).max() == radius_words
    for v in x[:50]:  # every neighbour meets at an anchor
        for bit in range(length):
            a, b = (set(simhash.anchors(np.array([y]), length)[1].tolist()) for y in (v, v ^ (1 << bit)))
            assert a & b


def test_components(spark):
    e = [(i, i + 1) for i in range(50)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 200 for i in range(200, 260))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- packing ------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = [None, "", "Hello, World! it's 42", "ÀÉ naïve Σίσυφος İstanbul é x y z", "\x01 odd \x01chunk", prose(1, 5000), "a\tb\r\nc", "don't we'll", "<|endoftext|> tail", "🙂🙂 ok"]
    got = {}
    ids_seen = set()
    for p in packing.pack_documents(docs(spark, texts, extra=True), path).collect():
        assert p.length & (p.length - 1) == 0 and p.length <= 2048 and p.length == 1 << p.bucket
        assert p.offset == 0 and p.sequence_id not in ids_seen
        ids_seen.add(p.sequence_id)
        ids = struct.unpack(f"<{p.length}I", p.ids)
        got.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
    for i, t in enumerate(texts):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(got[i])
        assert [x for _, ids, _ in pieces for x in ids] == want
        at = 0
        for start, ids, total in pieces:
            assert start == at and total == len(want)
            at += len(ids)
    assert packing.pack_documents(docs(spark, texts).limit(0), path).count() == 0


def test_words_meet_the_model_once():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, own, rng = Tokenizer.from_file(path), packing.ChunkTokenizer(path), random.Random(7)
    own.ids([b"Word### word%%% WORD, word,### &&&"])
    assert sorted(own.words) == ["###", "%%%", "&&&", ",", ",###", "word"]
    chars = [chr(c) for c in range(256)] + list("'srtvmdleLDS") * 20
    texts = ["".join(rng.choices(chars, k=rng.randrange(13))) + rng.choice(["", "", "é", "<|endoftext|>", "İx", "Σς"]) for _ in range(3000)]
    for text, ids in zip(texts, own.ids([t.encode() for t in texts])):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == tok.encode(text, add_special_tokens=False).ids, text


def test_piece_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        assert sum(packing.piece_lengths(n)) == n


# ---- PII ----------------------------------------------------------------------------------------


KEY = b"a key"


def test_detection_of_planted_entities(spark):
    # entities of every kind at known places of prose: found as they are, and nothing else
    r = random.Random(9)
    forms = {
        "email": lambda: f"{r.choice('abc')}.{r.choice('xyz')}{r.randrange(99)}@mail{r.randrange(9)}.example.org", "phone": lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", "ip": lambda: f"{r.randrange(11, 99)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(1, 255)}",
        "card": lambda: "4" + "".join(str(r.randrange(10)) for _ in range(15)), "ssn": lambda: f"{r.randrange(100, 600)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}", "iban": lambda: "DE89370400440532013000",
        "passport": lambda: f"C{r.randrange(1000000, 9999999)}", "address": lambda: f"{r.randrange(1, 999)} {r.choice(['Baker', 'Old Mill', 'Oak'])} {r.choice(['Street', 'Road', 'Lane'])}", "name": lambda: f"{r.choice(['Anna', 'Iwan', 'Zoë'])} {r.choice(['Muster', 'O', 'Wang'])}{r.choice('abc')}",
    }
    before = {"passport": "Passport No. ", "name": "Frau "}
    seen = set()
    for k in range(300):
        text, want = prose(k, 12), []
        for _ in range(r.randrange(4)):
            kind = r.choice(sorted(forms))
            value = forms[kind]()
            text += " " + before.get(kind, "")
            want.append((len(text), len(text) + len(value), kind))
            text += value + " , " + prose(k + 1000, 6)
            seen.add(kind)
        assert [e[:3] for e in pii.detect(text)] == want, text
    assert seen == set(pii.KINDS)


def test_coreference_and_distinctness(spark):
    texts = ["Mr. John Smith came. Dr. Smith left, SMITH said; John Smith slept.", "Mrs. Smith and Mr. Jane Doe-Smith", "call 464-555-9887", "call +1 464 555 9887", "my name is Ana Gil. Ana Gil!", "Passport No. AB1234567 and 12 Baker Street", "12 baker Street"]
    rows = {r.doc_id: r for r in pii.pseudonymized(docs(spark, texts).withColumn("entities", F.lit("clash")), KEY).collect()}
    given, family = re.match(r"Mr\. (\w+) (\w+) came", rows[0].text).groups()
    assert rows[0].text == f"Mr. {given} {family} came. Dr. {family} left, {family.upper()} said; {given} {family} slept." and "Smith" != family
    assert rows[1].text.startswith(f"Mrs. {family} and Mr. ") and rows[1].text.endswith(f"-{family}")
    assert re.sub(r"\D", "", rows[3].text) == "1" + re.sub(r"\D", "", rows[2].text) and rows[2].text[5] in "23456789"
    assert re.fullmatch(r"my name is (\w+ \w+)\. \1!", rows[4].text) and "Gil" not in rows[4].text
    assert not any(x in rows[5].text for x in ("AB1234567", "Baker")) and rows[5].text.endswith("Street")
    # many entities of every kind: as many surrogates, none of them a real one
    r = random.Random(4)
    many = {
        "phone": [f"{a}5550{b:03}" for a in (212, 313) for b in range(300)], "ssn": [f"123-45-{i:04}" for i in range(1, 400)], "ip": [f"10.0.{a}.{b}" for a in range(4) for b in range(1, 90)], "card": [f"4{i:015}" for i in range(400)],
        "passport": [f"X{i:06}" for i in range(400)], "email": [f"{a}{b}@x.org" for a in "abcd" for b in range(100)], "name": [f"s:{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnr"], "address": [f"{i} oak street" for i in range(400)],
    }
    entities = [(k, x.replace("-", "") if k == "ssn" else x) for k, xs in many.items() for x in xs]
    table = common.staged(spark.createDataFrame(entities, "kind string, norm string"), "entities")
    draws = {(x.kind, x.norm): x.draw for x in pii.redrawn(table, KEY).collect()}
    for kind in many:
        own = [n for k, n in entities if k == kind]
        new = [pii.surrogate(KEY, kind, n, draws.get((kind, n), 0)) for n in own]
        assert len(set(new)) == len(own) and not set(new) & set(own), kind
        assert all(re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) for a, b in zip(new, own) if kind in ("phone", "ssn", "card"))
    assert r


def test_repeated_rows_null_ids_and_long_texts(spark):
    long = " ".join([prose(1, 200)] * 150 + ["mail a1@x.org", "Frau Anna Muster", prose(2, 20)])
    rows = [(None, long, "en", "a", 1), (None, long, "en", "a", 1), (3, "x", None, None, None), (3, "x", None, None, None), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    new = pii.pseudonymized(d, KEY).collect()
    assert len(new) == 5 and len({r.text for r in new if r.doc_id is None}) == 2 and all("a1@x.org" not in r.text for r in new)
    assert len(secrets.scan_secrets(d).collect()) == 5
    near = simhash.near_duplicates(d).collect()
    assert len(near) == 5 and {r.component_id for r in near if r.doc_id == 3} == {3}
    assert {r.component_id for r in simhash.similar_documents(d).collect()} == {None, 3}
    pieces = packing.pack_documents(d, queries.tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in pieces} == {None, 3}
    mixed = mixing.decisions(d).collect()
    assert len(mixed) == 5 and all(0 <= r.probability <= 1 for r in mixed)
    sketch = sketches.compare_versions(d).collect()
    assert len(sketch) == 5 and all(0 <= r.near_next <= 1 for r in sketch)
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(toxicity.score(d, labels).collect()) == 5
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [1.0, 0.1]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id) for r in embeddings.near_duplicates(vectors).collect()))
    assert got == [(0, 2, 4), (0, 2, 4), (4, 0, 4), (4, 2, 4)]


def test_warc_rows_that_repeat_a_page(spark, tmp_path):
    body = "<p>" + "word " * 40
    rows = [(1, "http://b/", body), (1, "http://a/", body), (1, "http://a/", body), (2, "http://c/", body), (None, "http://d/", body), (5, "http://e/", "short"), (5, "http://e/", "short")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("first", F.lit(1))
    warc.write_archive(d, f"file://{tmp_path}/w")
    got = sorted(((str(r.page_id), r.url, r.record_type, r.refers_to) for r in warc.read_archive(spark, f"file://{tmp_path}/w").collect()), key=str)
    assert got == sorted([("1", "http://a/", "response", None), ("1", "http://a/", "revisit", 1), ("1", "http://b/", "revisit", 1), ("2", "http://c/", "revisit", 1), ("None", "http://d/", "revisit", 1)] + [("5", "http://e/", "response", None)] * 2, key=str)


def test_surrogates_keep_kind_and_distinctness(spark):
    mails = [f"{a}{b}@x.com" for a in "abcdefgh" for b in "0123456789"]
    texts = [f"write to {m} or {m.upper()}" for m in mails]
    texts += ["call +1 (464) 555-9887, card 4041894974608795, ip 42.144.35.254.", "again +1 464 555 9887", "Mr. John Smith and Frau Erika Muster", None, "", "nothing here: v1.2.3.4.5 and deadbeef12345678"]
    d = docs(spark, texts, extra=True)
    rows = {r.doc_id: r for r in pii.pseudonymized(d, KEY).collect()}
    assert len(rows) == len(texts)
    seen = set()
    for i, m in enumerate(mails):
        a, b = re.findall(r"\S+@\S+", rows[i].text)
        assert a == b.lower() and m not in rows[i].text and re.fullmatch(r"[a-z]\d+@[a-z]\.example", a)
        seen.add(a)
    assert len(seen) == len(mails)
    one, two = rows[len(mails)], rows[len(mails) + 1]
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one.text).group()
    assert re.sub(r"\D", "", phone) == re.sub(r"\D", "", two.text)
    assert not any(x in one.text for x in ("555-9887", "4041894974608795", "42.144.35.254"))
    assert [e.kind for e in one.entities] == ["phone", "card", "ip"]
    assert "Smith" not in rows[len(mails) + 2].text and rows[len(mails) + 2].text.startswith("Mr. ")
    assert rows[len(mails) + 3].text == rows[len(mails) + 4].text == ""
    assert rows[len(mails) + 5].text == texts[-1]
    assert pii.pseudonymized(d.limit(0), KEY).count() == 0


def test_numbers_within_other_text():
    # what the patterns of numbers match by themselves is found whatever surrounds it
    forms = {
        "+1 (743) 555-3824x12": ("phone", "+1 (743) 555-3824"), "555-123-4567ext": ("phone", "555-123-4567"), "Tel.+49 30 1234567": ("phone", "+49 30 1234567"),
        "No.4111 1111 1111 1111": ("card", "4111 1111 1111 1111"), "card_4111111111111111": ("card", "4111111111111111"),
        "ssn123-45-6789": ("ssn", "123-45-6789"), "ip-10.1.2.3": ("ip", "10.1.2.3"), "10.0.0.1-": ("ip", "10.0.0.1"),
    }
    for text, (kind, part) in forms.items():
        assert [(e.kind, text[e.start : e.end]) for e in pii.detect(text)] == [(kind, part)]
    r = random.Random(5)
    seen = 0
    for _ in range(3000):
        text = "".join(r.choice([*forms.values(), *(("", c) for c in "12 .-+()_x:")])[1] for _ in range(r.randrange(1, 12)))
        inside = bytearray(len(text))
        for run in pii._DIGITS.finditer(text):
            inside[run.start() : run.end()] = b"\1" * len(run.group())
            for pattern in (pii._IP, pii._SSN, pii._CARD, pii._PHONE):
                lo, hi = run.span()
                assert [m.span() for m in pattern.finditer(text, lo, hi)] == [m.span() for m in pattern.finditer(text) if lo <= m.start() < hi]
        for pattern in (pii._IP, pii._SSN, pii._CARD, pii._PHONE):
            for m in pattern.finditer(text):
                if pattern is not pii._PHONE or len(re.sub(r"\D", "", m.group())) >= 7:
                    seen += 1
                    assert all(inside[m.start() : m.end()]), text
    assert seen > 1000


def test_surrogate_formats():
    for norm in ("4111111111111111", "378282246310005"):
        new = pii.surrogate(KEY, "card", norm)
        assert len(new) == len(norm) and new[0] == norm[0] and pii._luhn(new[:-1]) == int(new[-1])
    assert pii._is_iban(pii.surrogate(KEY, "iban", "DE89370400440532013000"))
    assert pii.script_of(pii.surrogate(KEY, "name", "s:иванова").partition(":")[2]) == "cyrillic"
    assert pii.surrogate(KEY, "name", "f:anna").endswith("a")
    assert pii.surrogate(b"other", "ip", "8.8.8.8") != pii.surrogate(KEY, "ip", "8.8.8.8")


# ---- mixing -------------------------------------------------------------------------------------


def test_raking_meets_the_marginals(spark):
    r = random.Random(1)
    rows = [(i, prose(i, r.randrange(5, 80)), r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "c"]), 0) for i in range(300)]
    d = spark.createDataFrame([*rows, (None, None, "en", "a", 0)], DOCS)
    target = spark.createDataFrame([("a", 0.2), ("b", 0.3), ("c", 0.5)], "value string, share double")
    topic = F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")
    got = mixing.decisions(d, {"source": target}, rounds=30, topic=topic).toPandas()
    assert len(got) == 301 and got["probability"].between(0, 1).all()
    share = got.assign(w=got.tokens * got.weight).groupby("source").w.sum()
    share /= share.sum()
    assert share["a"] == pytest.approx(0.2, abs=1e-3) and share["c"] == pytest.approx(0.5, abs=1e-3)
    again = mixing.mix(d, {"source": target}, rounds=30, topic=topic).toPandas()
    assert sorted(again[again.kept].doc_id.dropna()) == sorted(got[got.kept].doc_id.dropna())
    assert mixing.decisions(d.limit(0)).count() == 0


def test_mixing_to_a_token_budget(spark):
    r = random.Random(2)
    rows = [(i, prose(i, r.randrange(5, 80)), "en", "rare" if i < 5 else r.choice("ab"), 0) for i in range(600)]
    d = spark.createDataFrame(rows, DOCS)
    target = spark.createDataFrame([("a", 0.3), ("b", 0.3), ("rare", 0.4)], "value string, share double")
    one = F.lit("one")
    thinned = mixing.decisions(d, {"source": target}, topic=one).toPandas()
    assert thinned.kept.sum() < 30  # the rare source's weight thins out the others
    budget = float(thinned.tokens.sum())
    got = mixing.decisions(d, {"source": target}, topic=one, budget=budget).toPandas()
    assert (got.tokens * got.probability).sum() == pytest.approx(budget)
    assert (got.copies - got.probability).abs().max() < 1 and (got.kept == (got.copies > 0)).all()
    taken = got.assign(t=got.tokens * got.copies).groupby("source").t.sum() / (got.tokens * got.copies).sum()
    assert taken["rare"] == pytest.approx(0.4, abs=0.05) and taken["a"] == pytest.approx(0.3, abs=0.05)
    again = mixing.mix(d, {"source": target}, topic=one, budget=budget).toPandas()
    assert dict(zip(again.doc_id, again.copies)) == dict(zip(got.doc_id, got.copies))
    with pytest.raises(ValueError):
        mixing.decisions(d, budget=0)


# ---- sketches -----------------------------------------------------------------------------------


def paragraphs(t):
    return {p for p in (x.strip(" \t\r\n") for x in re.split(r"(?<=[.!?\n])", t)) if p}


def test_sketches_match_set_differences(spark):
    r = random.Random(4)
    texts = [". ".join(prose(r.randrange(40), r.randrange(1, 9)) for _ in range(r.randrange(0, 40))) for _ in range(40)]
    texts += [None, "", "one line", "é" * 10, "\n".join(prose(i, 3) for i in range(1500))]
    texts.append(texts[0])
    rows = docs(spark, texts, extra=True)
    got = {x.doc_id: x for x in sketches.compare_versions(rows).collect()}
    n = len(texts)
    for i in range(n):
        t, nxt = texts[i] or "", texts[i - 1 if i else n - 1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        assert got[i].edited == edited and got[i].next_text == nxt
        for other, near, differs in ((edited, got[i].near_edited, got[i].edited_differs), (nxt, got[i].near_next, got[i].next_differs)):
            a, b = paragraphs(t), paragraphs(other)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
            assert len(set(differs)) == len(differs) == len(a ^ b)
    assert got[0].cells == got[n - 1].cells
    assert sketches.compare_versions(rows.limit(0)).count() == 0


def test_next_document_order(spark):
    ids = [5, 900_000, 17, 3, None, 2_000_000_000_000, 16, 16]
    rows = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    for width in (1, 2, 1024):
        got = {r.text: r.next_text for r in sketches.with_next(rows, bucket_rows=width).collect()}
        at = "t5"
        order = [at]
        while got[at] != "t5":
            at = got[at]
            order.append(at)
        assert len(order) == 8 and order[:3] == ["t5", "t1", "t2"] and set(order[3:5]) == {"t6", "t7"} and order[5:] == ["t0", "t3", "t4"]
