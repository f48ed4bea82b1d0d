"""Each corpus operator against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, exactdedup, htmlwrap, langid, minhash, substring, toxicity, urlrules, wordpiece
from graphloom.llm.components import components
from graphloom.llm.queries import oracle_sql, queries, vocabulary_path
from tests.compare import check

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def docs(spark, *rows):
    return spark.createDataFrame([*rows], DOCS)


def odd_texts():
    """Null, empty, blank, short, repeated, non-ASCII and long texts, with repeated rows."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéñ ") for _ in range(rng.randint(1, 6))).strip() or "x" for _ in range(60)]
    base = " ".join(rng.choice(words) for _ in range(300))
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a b"), (6, "123 !!!"), (7, base), (8, base.replace(" ", "  ")), (9, base + " end"), (9, base + " end"), (None, base), (None, None)]
    out += [(10, "lone " * 2000), (11, "x" * 100_000), (12, "p q r " * 40), (13, base[:700] + " Z " + base[700:]), (14, "Übung macht den Meister"), (15, "the " + base)]
    return out


# 1


def brute_repeats(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = collections.Counter(tuple(w[j : j + window]) for _, w in words for j in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {p for j in range(len(w) - window + 1) if seen[tuple(w[j : j + window])] > 1 for p in range(j, j + window)}
        left = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "gram"), [(35, 8), (6, 3), (4, 4)])
def test_repeats_equal_brute_force(spark, window, gram):
    rows = odd_texts()
    got = substring.remove_repeats(docs(spark, *rows), window=window, gram=gram, texts=False).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_repeats(rows, window)


def test_repeats_of_random_words_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    got = substring.remove_repeats(docs(spark, *rows), window=9, gram=4).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_repeats(rows, 9)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


# 2

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy {0}</div><div id="content"><h2>Title {0}</h2><p>First <b>bold</b>&amp;  text {0}<br>more<p>Second &lt;{0}&gt; para that is long enough to hold most of the text.
<div class="notice">Cookies!</div></div><div class="comments"><p>Reader {0} says a lot of things that are not the article at all</p></div><form><p>Subscribe</p></form><footer>&copy; {0}</footer>
<script>var t="</p>";</script></body></html>"""


def test_articles_without_surroundings(spark):
    rows = [(i, f"http://h.example.com/{i}", PAGE.format(f"no{i}")) for i in range(6)] + [(10, None, None), (11, "bad", ""), (12, "http://x.y/", "plain text only"), (13, "http://x.y/", "<p>" * 5000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in htmlwrap.main_texts(pages).collect()}
    assert got[3]["text"] == "Title no3\n\nFirst bold& text no3 more\n\nSecond <no3> para that is long enough to hold most of the text."
    assert got[10]["text"] == got[11]["text"] == "" and got[12]["text"] == "plain text only" and got[13]["text"] == "deep" and got[12]["host"] == "clash"
    assert htmlwrap.main_texts(pages.limit(0)).count() == 0


def test_wrapper_has_groups_and_slots():
    made = htmlwrap.Wrapper.of(htmlwrap.parse("<article><h1>a</h1><p>x</p></article>"))
    made.align(htmlwrap.Wrapper.of(htmlwrap.parse("<article><h1>b</h1><p>x</p><p>y</p><ul><li>z</li></ul></article>")))
    h1, p, ul = made.children[0].children
    assert h1.children[0].constant is None and p.repeated and ul.optional and not h1.optional


def test_wrapper_takes_in_all_distinct_pages(spark):
    tags = "ul ol dl table pre blockquote figure section address h3 h4 details".split()
    html = "<body><div><h2>Title {0}</h2><p>Text {0} of the article</p><{1}>some {0}</{1}></div></body>"
    rows = [(f"http://h.example/{i}", html.format(i, t)) for i, t in enumerate(tags)] + [(f"http://h.example/c{i}", html.format("copy", "ul")) for i in range(20)]
    pages = spark.createDataFrame(rows, "url string, html string")
    (one,), (two,) = htmlwrap.wrappers(pages.repartition(1)).collect(), htmlwrap.wrappers(pages.repartition(5)).collect()
    assert one == two and all(f'["{t}",' in one["wrapper"] for t in tags)


def test_nothing_inside_an_article_is_lost():
    page = lambda n, more: f"<body><nav><a href=x>Home</a></nav><p>Outside text of page {n} that is far longer than the article is, and says nothing that matters to it</p><article><h1>No {n}</h1>{more}</article><footer>f {n}</footer></body>"
    inside = {
        "deep": "<div>" * 300 + "<nav>menu</nav><p>deep</p>" + "</div>" * 300 + "<p>after</p>",
        "same": "<p>Same quoted paragraph.</p>",
        "links": '<ul><li><a href="x">a link</a></li><li>none</li></ul>',
        "words": "".join(f'<div class="{w}">{w} of the article</div>' for w in "warning tags search related reader alert".split()),
    }
    want = {"deep": ["deep", "after"], "same": ["Same quoted paragraph."], "links": ["a link", "none"], "words": [f"{w} of the article" for w in "warning tags search related reader alert".split()]}
    for name, more in inside.items():
        pages = [page(i, more.replace("article<", f"article {i}<")) for i in range(5)]
        whole = htmlwrap.merged([htmlwrap.Wrapper.of(htmlwrap.parse(p)) for p in pages])
        whole.choose(5)
        for made in (None, htmlwrap._json(whole.packed(5))):
            for i, p in enumerate(pages):
                assert htmlwrap.extract(p, made).split("\n\n") == [f"No {i}"] + [t.replace("of the article", f"of the article {i}") for t in want[name]]


def test_long_pages_are_aligned_in_linear_time():
    import time

    began = time.perf_counter()
    made = [htmlwrap.parse("<article>" + "".join(f"<h2>{i}</h2><p>{k} {i}</p>" + ("<ul><li>x</li></ul>" if i % 7 == k else "") for i in range(20_000 - k)) + "</article>") for k in range(3)]
    whole = htmlwrap.merged([*map(htmlwrap.Wrapper.of, made)])
    assert len(whole.children[0].children) < 60_000 and time.perf_counter() - began < 60
    assert htmlwrap.extract("<div>" * 100_000 + "x" + "</section>" * 1000, None) == "x"


def test_wrappers_accept_the_pages_they_were_inferred_from():
    rng = random.Random(12)

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["x", "y", "a longer text that stays the same everywhere", f"n{rng.randint(0, 99)}"])
        tags = [rng.choice(["div", "ul", "section", 'div class="ad"', "h2"]) for _ in range(rng.randint(0, 5))]
        return "".join(f"<{t}>{some(depth - 1)}</{t.split()[0]}>" for t in tags)

    for _ in range(150):
        trees = [htmlwrap.parse(f"<body>{some(3)}</body>") for _ in range(rng.randint(1, 6))]
        whole = htmlwrap.merged([*map(htmlwrap.Wrapper.of, trees)])
        assert all(map(whole.accepts, trees))
    assert not whole.accepts(htmlwrap.parse("<main>no such tag</main>"))


def test_repeated_and_odd_pages(spark):
    same = PAGE.format("one")
    rows = [(1, "http://h.example/1", same)] * 4 + [(2, "http://h.example/2", PAGE.format("two")), (None, None, same), (3, "http://h.example/3", "<article>" + "<p>long words</p>" * 30_000 + "</article>")]
    got = htmlwrap.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 7 and len({r["text"] for r in got if r["page_id"] == 1}) == 1 and next(r for r in got if r["page_id"] == 3)["text"].count("long words") == 30_000


# 3


def brute_pieces(word, first, rest):
    n, at, pool = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None:
            return 1 + wordpiece.UNKNOWN
        n, at, pool = n + 1, end, rest
    return n


def test_piece_counts_equal_greedy_matching():
    rng = random.Random(5)
    for _ in range(200):
        first = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))}
        rest = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 8))}
        counter = wordpiece.PieceCounter(first, rest)
        for _ in range(40):
            w = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(0, 12)))
            assert counter.count(w) == brute_pieces(w, first, rest), (first, rest, w)


def test_bare_space_begins_words_without_another_first_piece():
    counter = wordpiece.PieceCounter(*wordpiece.pieces_of(vocabulary_path()))
    assert all(1 < counter.count(w.encode()) < wordpiece.UNKNOWN for w in "что это стол 한국 中文文本".split()) and counter.count(b"the") == 1
    rng = random.Random(6)
    for _ in range(100):
        first = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 4))}
        rest = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 8))}
        counter = wordpiece.PieceCounter([b"", *first], rest)
        for _ in range(40):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 10)))
            begun = any(w.startswith(f) for f in first)
            want = brute_pieces(w, first, rest) if begun else brute_pieces(w, rest, rest) + 1
            assert counter.count(w) == (want if want < wordpiece.UNKNOWN else 1 + wordpiece.UNKNOWN), (first, rest, w)


def test_token_counts(spark):
    first, rest = wordpiece.pieces_of(vocabulary_path())
    rows = odd_texts()
    got = wordpiece.token_counts(docs(spark, *rows).withColumn("n_words", F.lit("clash")), first, rest).collect()
    one, more = set(first), set(rest)
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        n = [brute_pieces(w, one, more) for w in words if len(w) < 1000]
        want.append((str(i), len(words), sum(x % wordpiece.UNKNOWN for x in n)) if len(n) == len(words) else (str(i), len(words), None))
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in got) == sorted(w[:2] for w in want)
    by = collections.Counter((str(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in got)
    assert all(by[w] for w in want if w[2] is not None)
    assert wordpiece.token_counts(docs(spark, *rows).limit(0), first, rest).count() == 0


# 4


def test_toxicity_catches_unseen_spellings(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rude = ["grumfle", "grumflest", "grumfled", "grumflish", "blorkhead", "blorkheads", "blorky"]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        if bad := i % 3 == 0:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        rows.append((i, " ".join(words), int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn_toxicity(table, table.drop("text"))
    made = docs(spark, (1, " ".join(plain[:80])), (2, " ".join(plain[:80]) + " you grumfles"), (3, None), (4, "")).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(made, model).collect()}
    assert got[2]["score"] > got[1]["score"] and got[2]["predicted"] == 1 and got[1]["predicted"] == 0
    assert 0 <= got[3]["score"] <= 1 and got[3]["score"] == got[4]["score"]
    empty = toxicity.learn_toxicity(table, table.limit(0))
    assert empty.score(b"anything") == toxicity.learn_toxicity(table.limit(0), table).score(b"") == 0.5
    assert toxicity.toxicity_scores(made.limit(0), model).count() == 0
    long = toxicity.toxicity_scores(docs(spark, (1, " ".join(plain) * 500), (2, "x" * 300_000), (3, "grumfle"), (3, "grumfle")), model).collect()
    assert len(long) == 4 and all(0 <= r["score"] <= 1 for r in long) and long[2] == long[3]


def test_toxicity_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity._Trainer, "train", lambda self: seen.append(self.labels.tolist()))
    rows = [(1, "one hot text")] * 500 + [(i, f"text {i}") for i in range(2, 60)] + [(60, "long " * 5000), (61, None), (None, "no id")]
    labels = [(i, i % 2) for i in range(1, 62)] + [(1, 0), (2, None), (None, 1), (3, 7)]
    toxicity.learn_toxicity(docs(spark, *rows).withColumn("label", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, toxic int"), rows_per_class=40)
    assert len(seen[0]) == 59 and sum(seen[0]) == 30
    toxicity.learn_toxicity(docs(spark, *rows), spark.createDataFrame(labels, "doc_id long, toxic int"), rows_per_class=5)
    assert len(seen[1]) <= 10


def test_toxicity_of_held_out_rows(spark):
    got = queries()["op4_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out and toxic is not null").select("score", "predicted", "toxic").collect()
    score, toxic = np.array([r["score"] for r in got]), np.array([r["toxic"] for r in got])
    auc = (score[toxic == 1][:, None] > score[toxic == 0]).mean()
    assert auc > 0.9 and np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.93


# 5


def brute_groups(rows, width, percent):
    sets, seen = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) or frozenset([tuple(w)] if w else [])
        seen.setdefault(i, []).append(s)
    up = {i: i for i in seen if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in up:
        for j in up:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in seen[i] for b in seen[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in up}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_groups_equal_brute_force(spark, width, percent):
    rng = random.Random(7)
    rows = odd_texts()
    text = [str(rng.randint(0, 500)) for _ in range(120)]
    for i in range(40):  # a chain of ever more edits, and edits of one text
        if i % 2:
            text = [*text]
            text[rng.randrange(120)] = f"e{i}"
            rows.append((100 + i, " ".join(text)))
        else:
            rows.append((100 + i, " ".join(f"q{i}" if j == i else str(j) for j in range(200))))
    made = docs(spark, *rows).withColumn("k", F.lit("clash")).withColumn("bands", F.lit(1))
    got = minhash.near_groups(made, width=width, percent=percent).collect()
    want = brute_groups(rows, width, percent)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
    kept = minhash.drop_near_copies(made, width=width, percent=percent)
    assert kept.columns == made.columns and kept.where("doc_id is not null").select("doc_id").distinct().count() == len(set(want.values()))


def open_rows(spark, texts, width=3):
    """Rows and sets as ``prefix_pairs`` takes them, each row a label of its own."""
    shingler = minhash.Shingler(width)
    rows = [(i, i, i, bytearray(shingler.shingles(t.encode()).tobytes())) for i, t in enumerate(texts)]
    made = spark.createDataFrame(rows, "k long, th long, label long, shingles binary")
    return made.drop("shingles"), made.drop("label")


def test_prefix_pairs_hold_every_link(spark):
    rng = random.Random(10)
    base = [[f"w{i}_{rng.randint(0, 3)}" for i in range(rng.randint(3, 90))] for _ in range(12)]
    texts = [" ".join(f"e{rng.random()}" if rng.random() < 0.03 else w for w in b[rng.randint(0, 2) : len(b) - rng.randint(0, 3)]) for b in base for _ in range(9)]
    for percent in (85, 50):
        got = {tuple(sorted(r)) for r in minhash.prefix_pairs(*open_rows(spark, texts), percent).select("a", "b").collect()}
        sets = [set(minhash.Shingler(3).shingles(t.encode()).tolist()) for t in texts]
        want = {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
        assert want and {(j, i) for i, j in want} <= got


def test_boilerplate_does_not_bring_all_pairs(spark):
    rng = random.Random(11)
    shared = " ".join(f"b{i}" for i in range(200))
    n = {}
    for size in (1000, 4000):
        texts = [shared + " " + " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(100)) + (" x" if i % 9 else "") for i in range(size)]
        n[size] = minhash.prefix_pairs(*open_rows(spark, texts), 85).count()
    assert n[4000] <= 4.5 * n[1000] + 10
    pages = docs(spark, *enumerate([*texts[:500], texts[3] + " y"]))
    got = minhash.near_groups(pages, width=3, percent=85).where("not kept").collect()
    assert [(r["doc_id"], r["component_id"]) for r in got] == [(500, 3)]


def test_near_groups_of_nothing(spark):
    assert minhash.near_groups(docs(spark, (1, None)).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5), (None, 3)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in up if find(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6


def brute_copies(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\v\f\r")].append((-len(t or ""), i is None, i or 0, i))
    return sorted((str(x[3]), str(min(g)[3]), len(g)) for g in groups.values() for x in g)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_groups_equal_brute_force(spark, digest_bytes):
    rows = odd_texts() + [(200 + i, f"t {i % 70}") for i in range(150)]
    made = docs(spark, *rows)
    got = exactdedup.exact_groups(made, digest_bytes=digest_bytes).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == brute_copies(rows)
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})


def test_dropping_exact_copies_keeps_columns(spark):
    made = docs(spark, *odd_texts()).withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1))
    kept = exactdedup.drop_exact_copies(made)
    assert kept.columns == made.columns and kept.count() == len({k[1:] for k in map(lambda r: ("", "".join((r[1] or "").split())), odd_texts())})
    assert exactdedup.exact_groups(made.limit(0)).count() == 0


def test_exact_groups_of_rows_that_share_a_file_row(spark, tmp_path):
    docs(spark, (1, "a b"), (2, "c d")).write.parquet(path := f"file://{tmp_path}/docs")
    made = spark.read.parquet(path).select(F.explode(F.array("doc_id", F.col("doc_id") + 10)).alias("doc_id"), F.lit("same").alias("text"), F.lit(0).alias("size"))
    got = exactdedup.exact_groups(made).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(1, 1, 4, True), (2, 1, 4, False), (11, 1, 4, False), (12, 1, 4, False)]
    assert [r["doc_id"] for r in exactdedup.drop_exact_copies(made).collect()] == [1]
    assert exactdedup.is_plain_scan(spark.read.parquet(path).where("doc_id > 1").select("text")) and not exactdedup.is_plain_scan(made)


# 7


def test_nested_rules(spark):
    rules = [urlrules.Rule("allow", "com", "/"), urlrules.Rule("block", "a.com", "/x/"), urlrules.Rule("allow", "b.a.com", "/x/y"), urlrules.Rule("block", "a.com", "/x/y/z/"), urlrules.Rule("block", "ab.com", "/")]
    urls = ["http://A.com/x/1", "https://b.a.com/x/y1?q", "http://c.b.a.com/x/y/z/1#f", "ftp://ab.com/", "http://xa.com/x/", "a.com/x/", None, "http://a.com", "http://com/", "http://é.a.com/x/", ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower() if rest.isascii() else rest[:cut], rest[cut:].split("?")[0].split("#")[0]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
        return host, path, best and best.text, best.verdict if best else "allow"

    for table in (rules, spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge_urls(pages, table).collect()}
        assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert urlrules.judge_urls(pages.limit(0), rules).count() == 0


def test_rules_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "ROWS_PER_RANGE", 20)
    rng = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org"]
    rules = [urlrules.Rule("block", h, p) for h in hosts for p in ("/", "/p/") if rng.random() < 0.7]
    rows = [(i, f"http://{'a.com' if i % 3 else rng.choice(hosts)}/{rng.choice(['', 'p/', 'q'])}{i % 5}") for i in range(400)]
    got = {r["page_id"]: r["rule"] for r in urlrules.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    for i, u in rows:
        host, path = u[7:].split("/", 1)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        assert got[i] == max(((len(r.text), len(r.host), r.text) for r in fits), default=(0, 0, None))[2]


def test_repeated_urls_and_rules_of_equal_length(spark):
    rules = [urlrules.Rule("allow", "a.com", "/b/"), urlrules.Rule("block", "a.com", "/b/"), urlrules.Rule("block", "a.com", "/b/")]
    got = urlrules.judge_urls(spark.createDataFrame([(1, "http://a.com/b/c")] * 3, "page_id long, url string"), rules).collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("a.com/b/", "block")] * 3


# 8


def test_languages_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", langid.crc_mod(F.col("doc_id"), 4) == 2)
    filters = langid.learn_filters(d.where("not held"))
    got = langid.identify(d.where("held and length(text) > 50"), filters)
    assert got.where("lang = lang_pred").count() / got.count() > 0.98 and got.where("score < 0 or score > 1").count() == 0


def test_languages_of_odd_texts(spark):
    filters = langid.learn_filters(spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("x", None)], "text string, lang string"))
    made = docs(spark, *odd_texts()).withColumn("score", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in langid.identify(made, filters).collect():
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert got[1] == got[2] == got[3] == got[6] == [("und", 0.0)] and {x for x, _ in got[7]} <= {"en", "fr"}
    nothing = langid.learn_filters(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(made, nothing).collect()} == {"und"}
    assert langid.identify(made.limit(0), filters).count() == 0


def test_filters_hold_all_their_grams():
    grams = {"a": np.arange(1, 5000) * 7919, "b": np.arange(1, 5000) * 104729}
    filters = langid.LanguageFilters.build({k: v % 2**32 for k, v in grams.items()})
    (found,) = filters.masks((grams["b"] % 2**32).astype(np.uint32))
    assert (found & 2).all() and (found & 1).mean() < 0.02


def test_more_languages_than_bits(spark):
    grams = {f"l{i:03}": np.arange(1, 200) * (7919 + 2 * i) % 2**32 for i in range(130)}
    filters = langid.LanguageFilters.build(grams)
    assert len(filters.tables) == 3
    for i in (0, 63, 64, 129):
        found = filters.masks(grams[f"l{i:03}"].astype(np.uint32))
        assert ((found[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all() and filters.wrong[i] < 1e-6
    rows = [(f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}{chr(0x6E00 + i)} wort{i}", f"x{i:03}") for i in range(80)]
    learnt = langid.learn_filters(spark.createDataFrame(rows, "text string, lang string"))
    got = langid.identify(docs(spark, *enumerate(t for t, _ in rows)), learnt).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])] == [x for _, x in rows]


def test_languages_with_equal_evidence(spark):
    learnt = langid.learn_filters(spark.createDataFrame([("same text", "b"), ("same text", "a")], "text string, lang string"))
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(docs(spark, (1, "same"), (1, "same")), learnt).collect()] == [("a", 0.5)] * 2


# 9


def brute_hits(rows, items, window):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for j in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[j : j + n])].add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wins:
                    hit |= {*range(j, j + n)}
                    found |= wins[tuple(w[j : j + n])]
        out.append((str(i), len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out)


@pytest.mark.parametrize(("window", "gram"), [(10, 5), (4, 2)])
def test_benchmark_hits_equal_brute_force(spark, window, gram):
    rows = odd_texts()
    base = rows[6][1].split()
    items = [(1, " ".join(base[20:45])), (2, "a b"), (3, None), (4, "!!"), (5, " ".join(base[100:104])), (2, " ".join(base[30:60])), (None, "übung MACHT"), (7, "p q r " * 8)]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash"))
    made = docs(spark, *rows).withColumn("k", F.lit("clash"))
    got = decontaminate.benchmark_hits(made, table, window=window, gram=gram).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], sorted(r["items"])) for r in got) == brute_hits(rows, items, window)
    clean = decontaminate.drop_contaminated(made, table, window=window, gram=gram)
    assert clean.columns == made.columns and clean.count() == sum(not x[2] for x in brute_hits(rows, items, window))
    assert decontaminate.drop_contaminated(made, table.limit(0)).count() == len(rows)
    assert decontaminate.benchmark_hits(made.limit(0), table).count() == 0


def test_benchmark_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 10)
    items = [(i, "one two three four five six seven eight nine ten " + "x" * i) for i in range(30)]
    got = decontaminate.benchmark_hits(docs(spark, (1, "zero one two three four five six seven eight nine ten")), spark.createDataFrame(items, "item_id long, text string")).first()
    assert (got["n_words"], got["n_hit"], got["items"]) == (11, 10, list(range(30)))


# 10


@pytest.fixture(scope="module")
def model():
    return bpe.BpeModel(open(vocabulary_path(), encoding="utf-8").read())


def test_tokens_equal_the_library(model):
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(vocabulary_path()), bpe.BpeCoder(model, 500)
    rng = random.Random(2)
    letters = [chr(i) for a, b in ((9, 14), (28, 127), (128, 600), (0x300, 0x310), (0x660, 0x66A), (0x2000, 0x2030), (0x3040, 0x3060), (0x1F600, 0x1F610)) for i in range(a, b)]
    texts = [t or "" for _, t in odd_texts()] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|>a<|endoftext|><|endoftext|>", "don't I'LL we'll", "\n\n  \n x", "a" * 3000, "ab" * 3000, " " * 999]
    ids = coder.encode_many(texts)
    assert ids == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [coder.decode(x) for x in ids] == [library.decode(x, skip_special_tokens=False) for x in ids]
    packed = bpe.PackedCoder(model, 500)
    lists = packed.id_lists(texts)
    assert lists.to_pylist() == ids and packed.texts_of(lists).to_pylist() == [coder.decode(x) for x in ids]
    assert packed.id_lists(["", ""]).to_pylist() == [[], []] and packed.id_lists([]).to_pylist() == []


def test_proposals_are_verified(model):
    rng = random.Random(1)
    words = [bytes(rng.choice(b" theaonigrsd\xc3\xa9") for _ in range(rng.randint(1, 90))) for _ in range(3000)]
    assert model.encode_words(words) == [model._merge_long([model.byte_id[b] for b in w]) for w in words]


def test_long_texts_in_runs(model, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    coder = bpe.BpeCoder(model)
    text = "the thing " * 50_000
    assert coder.decode(coder.encode_many([text])[0]) == text


def test_round_trip(spark):
    made = docs(spark, *odd_texts()).withColumn("token_ids", F.lit("clash"))
    back = bpe.decode(bpe.encode(made, vocabulary_path()), vocabulary_path()).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back) and len(back) == len(odd_texts())
    digests = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in bpe.round_trip_digests(made, vocabulary_path()).collect()}
    assert digests == {(r["doc_id"], len(r["token_ids"]), hashlib.sha256(",".join(map(str, r["token_ids"])).encode()).hexdigest()) for r in back}
    both = bpe.round_trip(made, vocabulary_path()).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["token_ids"], r["decoded"]) for r in both) == sorted((r["doc_id"] is None, r["doc_id"], r["token_ids"], r["decoded"]) for r in back)
    assert bpe.encode(made.limit(0), vocabulary_path()).count() == 0
    assert bpe.round_trip(made.limit(0), vocabulary_path()).count() == 0


# queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    check(spark, queries(), oracle_sql(), name, SF)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 11)}
