"""HTML, secrets, licenses, contamination and toxicity."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from scorelake.llm import decontaminate, html_blocks, licenses, queries, secrets, toxicity
from scorelake.llm.decontaminate import CHUNK, _powers

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
P = "<p>" + "Lorem ipsum dolor sit amet. " * 8 + "</p>"
L = ("Lorem ipsum dolor sit amet. " * 8).strip()


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("just text", "just text"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; x</h1>{P}<p>a\n b&nbsp;c</p></article><footer>(c)</footer>", f"T & x {L} a b c"),
    (f'<body class="has-sidebar"><div class="menu"><a>Home</a></div><div><h1>T</h1>{P}<p>ok</p></div><div class="comments"><p>{"bla " * 90}</p></div>', f"T {L} ok"),
    (f'<nav>left open<article>{P}<aside>no</aside><div class="ad">Buy</div><p>x</p><section class="comments"><article>{P}</article></section></article>', f"{L} x"),
    (f"<script>var t='<p>no</p>';</script><style>p{{}}</style><!-- no --><form>no</form><main>{P}<br>y</main>", f"{L} y"),
])
def test_main_text(html, text):
    assert html_blocks.main_text(html) == text


@pytest.mark.parametrize("html, text", [
    (f"<div><h1>T</h1>{P}{P}</div><article>{P}</article>", f"T {L} {L} {L}"),
    (f"<article>{P}<p>a</p></article><article>{P}<p>b</p></article><article>{P}</article>", f"{L} a {L} b {L}"),
    (f'<div class="has-sidebar"><p>T</p>{P}<div class="sidebar">{P[:60]}</p></div></div>', f"T {L}"),
    (f'<div class="no-nav">{P}</div>', L), (f'<div id="content-search">{P}</div>', L),
    (f'<form action="x"><div>{P}</div></form>', L),
])
def test_line_sums_decide(html, text):
    assert html_blocks.main_text(html) == text


C = "<div class='comment'><p>" + "I do not agree with this at all, sorry. " * 6 + "</p></div>"


@pytest.mark.parametrize("html, text", [
    (f"<div><h1>T</h1>{P * 3}</div><div id=comments>{C * 9}</div>", f"T {L} {L} {L}"),
    (f"<article><h1>T</h1>{P * 3}</article><section class=comments>{C * 9}</section>", f"T {L} {L} {L}"),
    (f"<div>{P * 3}</div><div class='comment-list'>{P * 3}</div>", f"{L} {L} {L}"),
    (f"<article>{P * 3}<div class='comment-list'>{P * 3}</div></article>", f"{L} {L} {L}"),
    (f"<article>{P * 3}</article><article class=comment>{P}<article class=comment>{P}</article></article><article class=comment>{P}</article>", f"{L} {L} {L}"),
    (f"<div>{P * 3}</div><div class='reader-opinions'>{P * 4}</div>", f"{L} {L} {L}"),
    (f"<div>{P * 2}</div><div class=newsletter>{P * 5}</div>", f"{L} {L}"),
    (f"<div class='cookie-consent'>{P * 5}</div><div>{P * 2}</div>", f"{L} {L}"),
    (f"<div class='content-search'><div id=comments>{P * 5}</div><h1>T</h1>{P}</div><div class=cookies>{P * 5}</div>", f"T {L}"),
    (f"<nav><a href=x>Home</a><div>{P}</div><div>{P}</div>", f"{L} {L}"),
    (f"<header><p>a<header><p>b</p></header><nav><li>x<div>{P}</div>", f"x {L}"),
    (f"{P}<p><a href=x>one link</a></p><p><a href=y>another</a></p><p><a href=z>third</a></p>{P}", f"{L} one link another third {L}"),
    (f"{P}<ul><li><a href=x>one link</a></li><li><a href=y>another</a></li><li><a>third</a></li></ul>{P}", f"{L} {L}"),
    (f"<div>{P}<!-- open <p>The end of it.</p></div>", f"{L} open The end of it."),
    (f"<article><header><h1>T</h1><p>by me</p></header>{P}</article>", f"T {L}"),
])
def test_measured_pages(html, text):
    assert html_blocks.main_text(html) == text


def test_nesting_costs_no_more_than_its_length():
    started = time.process_time()
    assert html_blocks.main_text("<div class=ad>" * 20_000 + "x" + "</div>" * 20_000 + P) == L
    assert html_blocks.main_text("<nav>" * 5000 + P) == L
    assert time.process_time() - started < 10


def test_generated_pages_with_known_articles():
    """Random pages around a known article, in any order and nesting that keeps it apart."""
    rnd = random.Random(12)

    def prose(n):
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(n))

    for _ in range(300):
        blocks = [prose(rnd.randint(20, 60)) for _ in range(rnd.randint(1, 5))]
        inner = "".join(rnd.choice([f"<p>{b}</p>", f"<div>{b}<br></div>", f"<p><b>{b[:5]}</b>{b[5:]}</p>"]) for b in blocks)
        tag = rnd.choice(["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<div class='post-body'>{}</div>", "<section class='no-sidebar'>{}</section>"])
        before = ["<nav><ul><li><a href=x>Home</a></li></ul></nav>", f"<header><p>{prose(30)}</p></header>", f"<div class='cookie-notice'><p>{prose(40)}</p></div>",
                  f"<script>{prose(50)}</script>", f"<form><p>{prose(30)}</p></form>", "<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>"]
        after = [f"<footer>{prose(30)}</footer>", f"<div id=comments>{C * rnd.randint(1, 9)}</div>", f"<aside class=related>{prose(30)}</aside>",
                 f"<div class='ad'>{prose(30)}</div>", f"<div role=complementary><p>{prose(60)}</p></div>", f"<section class=newsletter><p>{prose(40)}</p></section>"]
        html = "".join(rnd.sample(before, rnd.randint(0, 6))) + tag.format(inner) + "".join(rnd.sample(after, rnd.randint(0, 6)))
        assert html_blocks.main_text(rnd.choice(["{}", "<html><body class='no-nav'>{}</body></html>"]).format(html)) == " ".join(blocks)


def test_pages(spark):
    rows = [(1, "u", f"<article>{P}</article>", 5), (None, None, None, 6), (2, "v", "<p>" + "w " * 100_000 + "</p>", 7)]
    got = {r.page_id: (r.text, r.n_chars) for r in html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert got == {1: (L, len(L)), None: ("", 0), 2: (("w " * 100_000).strip(), 199_999)}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert queries.QUERIES["op2_html_blocks"](spark, SMALL).where("n_chars > 0").count() == pages.count()


def base(text):
    name = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    kinds = [
        [m for m in re.finditer(name + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6],
        [m for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20], [m for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]]
    spans = sorted((m.start(), k, m.end()) for k, found in enumerate(kinds) for m in found)
    return [len(x) for x in kinds], hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_secrets(spark):
    rnd, texts = random.Random(4), [None, "", "é" * 100_000 + " token: abcdefgh"]
    parts = ["Password", "token", "API_KEY", "apikey", "=", ":", " ", '"', "'", "abcdef", "AKIA", "0123456789ABCDEFX", "0af9" * 7, "é𝒳", "\n", "secret"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    for i, t in enumerate(texts):
        counts, digest = base(t or "")
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == counts and got[i].base_sha256 == digest
    assert secrets.secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_efficiency():
    def found(text):
        return [text[s:e] for s, _, e in secrets.random_spans(text, secrets.base_spans(text))]

    assert found("key zQ8xV2pL9mK4wR7tY1uB6nC3 end") == ["zQ8xV2pL9mK4wR7tY1uB6nC3"]
    digest = hashlib.md5(b"x").hexdigest().upper()
    assert found(f"commit {digest} id 123e4567-e89b-12d3-a456-426614174000 http://h/zQ8xV2pL9mK4wR7tY1uB6nC3 internationalization2024version") == []
    assert secrets.efficiency("internationalization") > secrets.EFFICIENCY > secrets.efficiency("zQ8xV2pL9mK4wR7tY1uB")


def test_random_strings_near_addresses():
    def found(text):
        return [text[s:e] for s, _, e in secrets.random_spans(text, secrets.base_spans(text))]

    key = "zQ8xV2pL9mK4wR7tY1uB6nC3"
    assert found(f"postgres://app:{key}@db/x") == [key] and found(f"https://{key}@host/x") == [key]
    assert found(f'{{"url":"https://a/x","note":"{key}"}}') == [key] and found(f"fetch('https://a/b'),k='{key}'") == [key]
    assert found(f"https://a/b?{key}") == [key] and found(f"https://hooks.chat.com/services/{key}") != []
    assert found(f"https://host:8080/a/{key}") == found(f"git@host.org:a/{key}") == found(f"https://a/b/{key}?x=1") == []
    assert found("DE89370400440532013000 x") == [] and found("qZ47kXvR9mT2wLpB6sYdH x") == ["qZ47kXvR9mT2wLpB6sYdH"]
    assert found("key zQxVpLmKwRtYuBnCjHgF end") == ["zQxVpLmKwRtYuBnCjHgF"] and found("a-b-c-d-e-f-g-h-i-j internationalization") == []


def test_long_texts_take_time_in_proportion():
    rnd = random.Random(2)
    key = lambda: "".join(rnd.choice("abcdefghijkLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    log = " ".join(key() + " " + hashlib.md5(str(i).encode()).hexdigest() for i in range(7000))
    started = time.process_time()
    assert len(secrets.random_spans(log, secrets.base_spans(log))) > 6500
    assert time.process_time() - started < 5
    for length in (30, 900, 9000, 90_000):  # however far back the address begins
        path = "https://a.example/" + "segment/" * (length // 8)
        text = f"see {path}x.{key()}.html and {key()}"
        assert [s for s, _, _ in secrets.random_spans(text, [])] == [len(text) - 24]


def test_recall_and_false_alarms():
    rnd = random.Random(11)
    words = [r for r in "the quick brown fox jumps over lazy dogs while international organisations reconsider sustainability".split()]
    alphabets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    caught = planted = 0
    for _ in range(1500):
        secret = "".join(rnd.choice(alphabets[planted % 4]) for _ in range(rnd.randint(20, 40)))
        text = " ".join(rnd.choices(words, k=8)) + f" {secret} " + " ".join(rnd.choices(words, k=8))
        planted += 1
        caught += any(text[s:e] == secret for s, _, e in secrets.random_spans(text, secrets.base_spans(text)))
    assert caught >= 0.97 * planted
    plain = ["xkcd-2024-01-05-some-long-file-name-v2", "ACGTACGTTTGACCATGACGT", "acgtacgtttgaccatgacgt", "Some-Title_Of-A_Page-2023", "internationalization_of_everything",
             "src/main/java/com/example/Application", "2024-01-05T10:11:12Z", hashlib.sha1(b"x").hexdigest().upper(), "very-long-hyphenated-adjective-like-this-one"]
    for text in plain + [" ".join(rnd.choices(words, k=40)) for _ in range(50)]:
        assert secrets.random_spans(text, secrets.base_spans(text)) == [], text


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "at no charge whatsoever").replace("merge, ", "")
    rows = [(1, f"é foo. {changed} baz", "n"), (2, "Released under the MIT License. x Released under the MIT license", "n"), (3, "no license at all", "n"), (4, None, "n"), (5, "", "n"),
            (6, "word " * 100_000 + licenses.TEMPLATES["CC-BY-NC-4.0-line"], "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((r.doc_id, r.license, r.start, r.end, r.coverage > 0.9) for r in licenses.licenses(docs).collect())
    assert [(g[0], g[1]) for g in got] == [(1, "MIT"), (2, "MIT-line"), (2, "MIT-line"), (6, "CC-BY-NC-4.0-line")] and all(g[4] for g in got)
    assert rows[0][1][got[0][2]:got[0][3]] == changed.rstrip(".") and rows[1][1][got[1][2]:got[1][3]] == "Released under the MIT License"
    assert licenses.licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_in_any_surroundings():
    rnd, index = random.Random(6), licenses.Index(licenses.TEMPLATES)

    def found(text):
        return [r[2] for r in licenses.scan(index, [text.encode()], _powers(CHUNK))[0]]

    for _ in range(60):
        before, after = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(5)) for _ in range(2))
        for line in ("distributed under the MIT License", "Released under MIT License"):
            assert found(f"{before} {line} {after}") == ["MIT-line"]
    mit = licenses.TEMPLATES["MIT"].split()
    assert found(" ".join(mit[:35] + [f"x{i}" for i in range(20)] + mit[35:])) == ["MIT"]
    assert found(" ".join("rem " + w if i % 6 == 0 else w for i, w in enumerate(mit))) == ["MIT"]
    assert found("# " + licenses.TEMPLATES["MIT"] + " " + licenses.TEMPLATES["MIT"]) == ["MIT", "MIT"]
    for name, text in licenses.TEMPLATES.items():
        assert found(text) == [name]


def test_licenses_against_plain_search(spark):
    lines = {n: t.rstrip(".").lower() for n, t in licenses.TEMPLATES.items() if n.endswith("line")}
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    expected = {(r.doc_id, n) for r in docs.collect() for n, t in lines.items() if t in r.text.lower()}
    assert {(r.doc_id, r.license) for r in queries.QUERIES["op6_licenses"](spark, LARGER).collect()} == expected and len(expected) > 100


def plain_alignment(template, words):
    """Longest common subsequence without a band."""
    row = [0] * (len(words) + 1)
    for t in template:
        new = [0]
        for j, w in enumerate(words):
            new.append(max(row[j + 1], new[j], row[j] + (t == w)))
        row = new
    return row[-1]


def test_long_notices_against_unbanded_alignment():
    """Notices of many words, changed here and there in prose: found where an alignment over all templates says so."""
    rnd, index = random.Random(3), licenses.Index(licenses.TEMPLATES)
    long = {n: re.findall("[a-z0-9]+", t.lower()) for n, t in licenses.TEMPLATES.items() if len(t.split()) >= 20}
    for case in range(60):
        name = rnd.choice(sorted(long))
        share = rnd.choice([0.02, 0.1, 0.4])
        changed = [w for w in long[name] for w in ([w] if rnd.random() > share else rnd.choice([[], [w, f"x{case}"], [f"y{case}"]]))]
        prose = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
        text = " ".join(prose[:30] + changed + prose[30:])
        best = {n: plain_alignment(t, text.split()) / len(t) for n, t in long.items()}
        got = {r[2]: r[4] for r in licenses.scan(index, [text.encode()], _powers(CHUNK))[0] if r[2] in long}
        if best[name] >= 0.85:
            assert name in got or max(best, key=best.get) in got, (name, share, best[name])
        for n, coverage in got.items():
            assert 0.8 <= coverage <= best[n] + 1e-9
        if max(best.values()) < 0.75:
            assert not got


def test_tags_and_templates_from_a_table(spark):
    index = licenses.Index(licenses.TEMPLATES)
    found = lambda text: [r[2] for r in licenses.scan(index, [text.encode()], _powers(CHUNK))[0]]
    assert found("// SPDX-License-Identifier: MIT\n x = 1") == ["SPDX-MIT"] and found("# SPDX-License-Identifier: GPL-2.0-or-later") == ["SPDX-GPL-2.0-or-later"]
    assert found("SPDX-License-Identifier: Unknown-9.9") == [] and found("SPDX-License-Name: MIT") == []
    table = spark.createDataFrame([("own", "alpha beta gamma delta epsilon zeta"), (None, "x"), ("none", None)], "license string, text string")
    docs = spark.createDataFrame([(1, "see alpha beta gamma delta epsilon zeta here"), (2, "Released under the MIT License")], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.coverage) for r in licenses.licenses(docs, table).collect()] == [(1, "own", 1.0)]
    twins = {"a": "one two three four five six", "b": "one two three four five six"}  # equal templates: the first by name
    assert [r[2] for r in licenses.scan(licenses.Index(twins), [b"x one two three four five six y"], _powers(CHUNK))[0]] == ["a"]


def test_repeated_license_words_take_time_in_proportion():
    rnd, index = random.Random(5), licenses.Index(licenses.TEMPLATES)
    words = " ".join(licenses.TEMPLATES.values()).split()
    for text in (" ".join(rnd.choice(words) for _ in range(45_000)), (licenses.TEMPLATES["MIT"] + " ") * 500):
        started = time.process_time()
        licenses.scan(index, [text.encode()], _powers(CHUNK))
        assert time.process_time() - started < 8, len(text)


def test_alignment():
    def words(text):
        return np.array([hash(w) for w in text.split()])

    assert licenses.align(words("a b c d"), words("x a b z c d y"), 8) == (4, 1, 6)
    assert licenses.align(words("a b c d"), words("a b a b c d"), 8) == (4, 2, 6)
    assert licenses.align(words("a b"), words("x y"), 8)[0] == 0


def contaminated(docs, items):
    def words(text):
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = {}
    for item, text in items:
        found = words(text)
        n = min(13, len(found))
        for k in range(len(found) - n + 1 if n else 0):
            windows.setdefault(tuple(found[k:k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        found, hit, own = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(found) - n + 1):
                if (w := windows.get(tuple(found[k:k + n]))):
                    hit.update(range(k, k + n))
                    own |= w
        digest = hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
        out.append((doc, len(found), len(hit), len(own), digest, bool(hit) and 20 * len(hit) >= len(found)))
    return sorted(out, key=repr)


def test_contamination_with_short_items(spark):
    rnd = random.Random(1)

    def text(n):
        return " ".join(rnd.choice(["a", "b", "É", "c1", "Dd"]) for _ in range(n))

    docs = [(i, text(rnd.randint(0, 60))) for i in range(120)] + [(200, None), (201, ""), (5, text(40)), (202, "q " * 300_000 + text(13))]
    items = [(i, text(n)) for i, n in enumerate([3, 4, 5, 6, 7, 9, 12, 13, 14, 20, 30, 0])] + [(99, None), (3, text(9))]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int").repartition(3)
    b = spark.createDataFrame([(*x, "h") for x in items], "item_id long, text string, hits string")
    got = sorted((tuple(r)[:6] for r in decontaminate.contamination(d, b).collect()), key=repr)
    expected = contaminated(docs, items)
    assert got == expected and sum(x[5] for x in expected) > 10
    clean = decontaminate.drop_contaminated(d, b)
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in expected if not x[5])
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(d, nothing).where("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.contamination(spark.createDataFrame([], "doc_id long, text string"), b).count() == 0


def test_contamination_of_documents(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = sorted((tuple(r)[:6] for r in queries.QUERIES["op4_decontaminate"](spark, SMALL).collect()), key=repr)
    assert got == contaminated([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])


def test_winnowing_keeps_a_gram_of_every_window():
    rng = np.random.default_rng(2)
    h, valid = rng.integers(0, 50, 400).astype(np.uint64), np.ones(400, bool)
    at = decontaminate.winnowed(h, valid, 9)
    assert all(((at >= k) & (at < k + 9)).any() for k in range(400 - 8)) and len(at) < 200
    words = decontaminate.Words(["Éa 1b?C".encode(), b"", b"c"], _powers(CHUNK))
    assert [words.words(i, i + 1)[0] for i in range(4)] == ["Éa", "1b", "c", "c"] and words.text.tolist() == [0, 0, 0, 2] and words.hash[2] == words.hash[3]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_levenshtein_automaton():
    rnd = random.Random(2)
    terms = {"".join(rnd.choice("abc") for _ in range(rnd.randint(4, 12))): rnd.uniform(4.5, 7) for _ in range(400)}
    trie = toxicity.Trie(terms)
    for _ in range(1500):
        word = list(rnd.choice(list(terms)))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(word) + 1)
            word[i:i + rnd.randint(0, 1)] = rnd.choice([[], ["d"], ["a"]])
        word = "".join(word)
        near = [w for t, w in terms.items() if len(t) >= 5 and 0 < edits(word, t) <= (1 if len(t) < 10 else 2)]
        if word not in terms:
            assert trie.loose.close(word) == max(near, default=0)
    stems = toxicity.Trie({"run*": 2.0, "running": 5.0})
    assert (stems.exact("run"), stems.exact("runs"), stems.exact("running"), stems.exact("ru")) == (0, 2, 5, 0)


def test_misspellings_of_every_term_count():
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 14))): rnd.uniform(2, 7) for _ in range(600)}
    stems = {"".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 8))) + "*": rnd.uniform(2, 7) for _ in range(200)}
    trie, tried = toxicity.Trie({**words, **stems}), 0
    for term in list(words) + list(stems):
        i = rnd.randrange(len(term.rstrip("*")))
        word = term.rstrip("*")[:i] + rnd.choice(["", "x", "xa"]) + term.rstrip("*")[i + 1:] + ("ed" if term[-1] == "*" else "")
        if trie.exact(word):
            continue
        tried += 1
        near = [(len(t) >= 5, w) for t, w in words.items() if 0 < edits(word, t) <= (1 if len(t) < 10 else 2)]
        begun = [w for t, w in stems.items() for n in range(1, len(word)) if word[n - 1] == t[-2] and edits(word[:n - 1], t[:-2]) == 1]
        assert trie.loose.near(word) == (max((w for long, w in near if long), default=0), max((w for long, w in near if not long), default=0), max(begun, default=0))
    assert tried > 600


def test_many_words_at_once_lose_no_candidate():
    rnd = random.Random(6)
    words = {"".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(3, 14))): 3.0 for _ in range(300)}
    stems = {"".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 8))) + "*": 3.0 for _ in range(100)}
    trie = toxicity.Trie({**words, **stems}).loose
    tried = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 16))) for _ in range(3000)]
    for term in [*words, *stems]:
        i = rnd.randrange(len(term.rstrip("*")))
        tried += [term.rstrip("*")[:i] + rnd.choice(["", "x", "xa"]) + term.rstrip("*")[i + 1:] + rnd.choice(["", "ed"])]
    got = toxicity.Neighbours(trie).candidates(tried)
    for i, word in enumerate(tried):
        if len(word) >= toxicity.SHORT - 1:
            assert trie.candidates(word) <= got.get(i, set()), word
            assert trie.near(word) == trie.near(word, got.get(i, set()))
    lone = toxicity.Neighbours(toxicity.Trie({"idiot": 3.0}).loose)
    assert lone.candidates(["idoit", "idiots", "weather", "x" * 30]).keys() == {0, 1}
    assert toxicity.Neighbours(toxicity.Trie({}).loose).candidates(["a"]) == {} and lone.candidates([]) == {}


def plain_features(terms, text):
    """The features, word by word and without any memory, index or trie."""
    text = (text or "").lower()
    found = [(m.group(), m.start()) for m in re.finditer(r"[^\W_]+", text)]
    if not found:
        return [0.0] * toxicity.FEATURES
    spans = []
    for line in re.finditer(r"[^\n]+", text):
        marks = [line.start() + m.start() for m in re.finditer("[\"«»“”„]", line.group())]
        spans += list(zip(marks[::2], marks[1::2]))
    rows = []
    for word, at in found:
        word = toxicity._folded(word)
        exact = max([w for t, w in terms.items() if t == word or t[-1] == "*" and len(t) <= len(word) and word.startswith(t[:-1])], default=0)
        close = short = stem = 0
        if not exact:
            for t, w in terms.items():
                if t[-1] != "*" and 0 < edits(word, t) <= (2 if len(t) >= 10 else 1):
                    close, short = (max(close, w), short) if len(t) >= 5 else (close, max(short, w) if len(t) >= 3 else short)
                if t[-1] == "*" and len(t) > 5 and any(word[n - 1] == t[-2] and edits(word[:n - 1], t[:-2]) == 1 for n in range(1, len(word))):
                    stem = max(stem, w)
        rows.append((exact, close, short, stem, any(a < at < b for a, b in spans)))
    said = [0 if q else e for e, _, _, _, q in rows]
    window = lambda x: max(sum(x[i:i + 25]) for i in range(max(1, len(x) - 24)))
    apart = lambda k: [0 if r[4] else r[k] for r in rows]
    log = np.log1p
    return [log(sum(x > 0 for x in said)), max(said), log(sum(said)), window(said), sum(said) / len(said), log(sum(x > 3 for x in said)),
            log(sum(r[0] for r in rows if r[4])), window(apart(1)), np.log(len(rows)), log(sum(apart(2))), log(sum(apart(3))), log(sum(sum(r[1:4]) for r in rows if r[4]))]


def test_features_equal_plain_ones(monkeypatch):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 12))) for _ in range(60)]
    terms = {w: rnd.uniform(2, 7) for w in words[:25]} | {w[:6] + "*": rnd.uniform(2, 7) for w in words[25:40] if len(w) > 6}
    monkeypatch.setattr(toxicity, "MEMORY", 50)
    monkeypatch.setattr(toxicity, "TOGETHER", 300)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(0, 40)):
            w = rnd.choice(words)
            if rnd.random() < 0.5:
                i = rnd.randrange(len(w))
                w = w[:i] + rnd.choice(["", "x", "a"]) + w[i + 1:] + rnd.choice(["", "e"])
            parts.append(w + rnd.choice([" ", " ", '"', "\n", ", "]))
        texts.append("".join(parts))
    got = toxicity.Scorer(terms).all_features([*texts, None, ""])
    assert np.allclose(got, [plain_features(terms, t) for t in [*texts, None, ""]])


def test_ties_at_the_bound_of_terms(spark, monkeypatch):
    """Terms of equal odds beyond the bound: the first by name stay, in every run."""
    monkeypatch.setattr(toxicity, "TERMS", 3)
    docs = spark.createDataFrame([(i, f"{'zed yam xen wok' if i % 2 else 'fine'} w{i % 3}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert list(toxicity.fit(docs, labels).terms) == ["wok", "xen", "yam"]


def test_quotation_is_apart():
    scorer = toxicity.Scorer({"idiot": 6.0})
    said, cited = scorer.features("you idiot here"), scorer.features('the word "idiot" here')
    assert said[0] > 0 and said[6] == 0 and cited[0] == 0 and cited[6] > 0
    said, cited = scorer.features("you idiott here"), scorer.features('the word "idiott" here')
    assert said[7] > 0 and said[11] == 0 and cited[7] == 0 and cited[11] > 0
    assert scorer.features("you id1ot here")[1] == 6.0 and scorer.features("you idoit idiott")[7] == 6.0


def test_toxicity_accuracy(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{LARGER}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for h, i in zip(got.held_out, got.doc_id))
    held = got[got.held_out]
    assert held.score.between(0, 1).all()
    assert (held.predicted[held.toxic == 1]).mean() > 0.85 and (held.predicted[held.toxic == 0]).mean() < 0.01


def test_toxicity_edges(spark):
    rows = [(i, ("you total moron " if i % 3 == 0 else "a fine day ") + f"w{i % 5}", 1) for i in range(90)]
    rows += [(200, None, 1), (201, "", 1), (202, "word " * 100_000, 1), (None, "you moron", 1), (0, rows[0][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and {r.doc_id: r.predicted for r in got if r.doc_id == 1 or r.doc_id == 3} == {1: 0, 3: 1}
    assert all(r.score is not None and 0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and not {r.doc_id for r in kept.collect()} & {0, 3, 6}
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_scan_hands_on_each_chunk(spark):
    """Pipeline, decontamination: hits of a chunk go on before the next is read, whatever the rows of a batch."""
    texts = ["one two three four five six " * (1 + i % 40) for i in range(3000)] + [None, "", "x" * 400_000]
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")

    class Frame:
        columns, schema = frame.columns, frame.schema

        def mapInArrow(self, run, kinds):
            return run

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    out = list(decontaminate._scanned(Frame(), ())(iter([batch])))
    rows = [r for b in out for r in b.to_pylist()]
    assert len(out) >= 12 and max(b.num_rows for b in out) <= 256
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    assert [r["n_words"] for r in rows] == [len((t or "").split()) for t in texts]
    assert all(h["words"][h["reach"]:h["reach"] + 5] == texts[r["doc_id"]].split()[h["place"]:h["place"] + 5] for r in rows for h in r["hits"])
