"""URL rules, wrapper texts, toxicity, vectors and the pipeline against brute force and on odd rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from backflow.llm import extract, queries, toxicity, urlrules, vectors
from backflow.llm.dom import Page, shapes, tree_match, ways

SMALL = "/root/testdata/sf0.001"


def key(row):
    return tuple((v is not None, v) for v in row)


# --- URL rules

URLS = [
    "http://a.com/x", "https://blog.example.com/en/1?p=1", "https://www.example.com/en/2#top", "http://b.net/es/", "http://c.B.NET/fr/9.html", "http://d.org/en/4", "ftp://UPPER.Com", "no scheme", None, "://", "http://", "http://e.com?x=1/2",
    "http://example.com/en", "http://notexample.com/en/", "http://x.org/a://b.com/", "http://a.com/x",
]


def plain_judgement(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(r, v) for r, v in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=lambda x: len(x[0]), default=None)


def test_listed_rules_and_parts_of_urls(spark):
    frame = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(URLS)] + [(None, None, None, None)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in urlrules.url_verdicts(frame, queries.URL_RULES).collect()}
    assert len(got) == len(URLS) + 1
    for k, url in enumerate(URLS):
        host, path, rule = plain_judgement(url)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule and rule[0])
        assert got[k].verdict == rule[1] if rule else got[k].verdict in ("allow", "block")
    assert urlrules.url_verdicts(frame.limit(0), queries.URL_RULES).collect() == []


def test_mined_rules_are_those_of_all_subsets(spark):
    r = random.Random(5)
    rows = []
    for _ in range(300):
        tokens = [t for t in "abcdef" if r.random() < 0.5]
        bad = ("a" in tokens and "b" in tokens) or r.random() < 0.05
        rows.append((tokens, "block" if bad else "allow"))
    got = urlrules.mined_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), support=0.05, confidence=0.8, width=3)
    expected = []
    for n in (1, 2, 3):
        level = []
        for left in itertools.combinations("abcdef", n):
            having = [label for tokens, label in rows if set(left) <= set(tokens)]
            for label in ("allow", "block"):
                hits = having.count(label)
                if having and hits >= 0.05 * 300 and hits / len(having) >= 0.8:
                    level.append((left, label, hits / len(having), hits))
        expected += level
    minimal = [x for x in expected if not any(set(y[0]) < set(x[0]) and y[1] == x[1] and y[2] >= x[2] for y in expected)]
    assert sorted(got) == sorted(minimal) and any(x[0] == ("a", "b") and x[1] == "block" for x in got)


def plain_rules(rows, least, confidence):
    sets = {}
    for tokens, label in rows:
        for n in range(1, len(tokens) + 1):
            for left in itertools.combinations(sorted(tokens), n):
                sets.setdefault(left, {"allow": 0, "block": 0})[label] += 1
    rules = {label: {left: (n[label] / sum(n.values()), n[label]) for left, n in sets.items() if n[label] >= least and n[label] / sum(n.values()) >= confidence} for label in ("allow", "block")}
    parts = lambda left: (p for n in range(1, len(left)) for p in itertools.combinations(left, n))
    return sorted((left, label, *sure) for label, found in rules.items() for left, sure in found.items() if not any(found.get(p, (0,))[0] >= sure[0] for p in parts(left)))


def test_all_frequent_tokens_and_wide_rules_are_mined(spark):
    r, rows = random.Random(6), []
    for k in range(600):  # 60 tokens and more, twins, one that all have, and a label that needs five tokens at once
        tokens = {"all", f"x{k % 60}", f"X{k % 60}"} | {t for t in "abcde" if r.random() < 0.85}
        rows.append((sorted(tokens), "block" if set("abcde") <= tokens or r.random() < 0.03 else "allow"))
    frame = spark.createDataFrame(rows, "tokens array<string>, label string")
    expected = plain_rules(rows, 5, 0.9)
    got = urlrules.mined_rules(frame, support=0.001, confidence=0.9)
    assert sorted(got) == expected and len(expected) > 48 and any(x[0] == tuple("abcde") for x in expected)


def test_a_joined_index_judges_like_a_literal_one(spark, monkeypatch):
    urls = [f"http://{a}.{b}/{c}?{d}=1" for a in ("m", "n", "www") for b in ("com", "net") for c in ("es/a", "fr/b", "en/c") for d in "pqr"] * 3 + [f"http://z.org/{c}?{d}" for c in ("es/a", "en/c", "none") for d in "pqz"] + [None, "x"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = lambda: sorted(urlrules.url_verdicts(frame, queries.URL_RULES, confidence=0.5).collect())
    literal = judged()
    monkeypatch.setattr(urlrules, "LITERAL", 0)
    assert judged() == literal and len({r.mined for r in literal}) > 2


def test_index_finds_the_surest_rule(spark):
    rules = [(("a", "b"), "block", 1.0, 9), (("c",), "allow", 0.9, 9), (("a",), "block", 0.85, 9)]
    frame = spark.createDataFrame([(["a", "b", "c"],), (["c", "a"],), (["a"],), (["b"],), ([],)], "tokens array<string>")
    verdict, rule = urlrules.mined_verdict(urlrules.F.col("tokens"), rules, "allow")
    assert [tuple(x) for x in frame.select(verdict, rule).collect()] == [("block", "a b"), ("allow", "c"), ("block", "a"), ("allow", None), ("allow", None)]


# --- wrapper texts

ARTICLE = "<article><h1>T&eacute;st  &amp;\n title</h1><p><b>One<br>two<p>Three <a href='/x'>link</a>&nbsp;end<div class='ad'>Buy</div><ul><li>i<li>j</ul></article>"
PAGE = f"<html><head><title>x</title><style>p{{}}</style></head><body><nav><ul><li>menu</ul></nav><!-- <p>no --><script>var t='</p>';</script><header>Head</header>{ARTICLE}<aside>side</aside><div id='comments'>c</div><form>f</form><footer>foot</footer>"
TEXT = "Tést & title\n\nOne two\n\nThree link end\n\ni\n\nj"


def test_blocks_of_an_article():
    assert "\n\n".join(b.text for b in Page(PAGE).blocks) == TEXT
    for odd in ("", "<", "<p", "a < b > c", "</div></p>", "<p title='a>b'>x", "<script>never closed <p>y", "<div" * 50, "<!-- open"):
        Page(odd)
    assert [b.text for b in Page("a < b > c").blocks] == ["a < b > c"]
    assert [b.text for b in Page("<p title='a>b'>x</p>").blocks] == ["x"]
    assert len(Page("<div>" * 3000 + "deep").blocks) == 1


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "content-with-sidebar", "post comments-open", "post category-social", "content legal", "sidebar"])
def test_names_of_layouts_drop_no_article(name):
    text = lambda html: [b.text for b in Page(html).blocks]
    for tag in ("html", "body", "main", "article"):
        assert text(f"<{tag} class='{name}'><p>One</p><div class='ad'>Buy</div></{tag}>") == ["One"]
    for held in ("<article><p>One</p></article>", "<main><p>One</p></main>", "<div role='main'><p>One</p></div>"):
        assert text(f"<body><div id='wrap' class='{name}'><section>{held}</section></div></body>") == ["One"]
    # Only a whole name without a word for content beside it makes a plain element part of the frame.
    assert text(f"<article><p>One</p><div class='{name}'>Two</div></article>") == (["One"] if name == "sidebar" else ["One", "Two"])


def test_tree_match_counts_the_largest_alignment():
    a, b = shapes("r(a(x()y())b(x()))").children[0], shapes("r(b(x())a(y()))").children[0]
    assert tree_match(a, b)[0] == 3
    size, pairs = tree_match(a, a)
    assert size == 6 and sorted(pairs) == [(k, k) for k in range(6)]
    assert tree_match(shapes("a()").children[0], shapes("b()").children[0]) == (0, [])


def test_template_goes_and_copies_stay(spark):
    page = lambda body: f"<body><div><p>Follow us for more</p>{body}<p>Printed by host</p></div></body>"
    rows = [(k, f"http://h.org/{k}", page(f"<p>body {k}</p><p>second {k * k}</p>"), "t", 1) for k in range(12)]
    rows += [(100 + k, f"http://h.org/c{k}", page("<p>copied article</p><p>its end</p>"), "t", 1) for k in range(40)]
    rows += [(200, "http://lone.org/", page("<p>alone</p>"), "t", 1), (201, None, PAGE, "t", 1), (202, "http://h.org/e", None, "t", 1), (None, "http://h.org/f", "", "t", 1), (203, "http://h.org/long", f"<article><p>{'word ' * 60_000}</p></article>", "t", 1)]
    rows.append(rows[0])
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, page long")
    got = {}
    for r in extract.main_texts(frame).collect():
        assert r.n_chars == len(r.text) and got.setdefault(r.page_id, r.text) == r.text
    assert got[3] == "body 3\n\nsecond 9" and got[105] == "copied article\n\nits end"
    assert got[200] == "Follow us for more\n\nalone\n\nPrinted by host" and got[201] == TEXT and got[202] == got[None] == "" and got[203] == ("word " * 60_000).strip()
    assert extract.main_texts(frame.limit(0)).collect() == []


def test_slots_of_nodes_that_the_reference_lacks():
    page = lambda html: Page(html).skeleton
    a, b, c = page("<body><p>x</p><ul><li><p>1<li><p>2</ul>"), page("<body><p>x</p><div class='b'><h2>y</h2></div>"), page("<body><p>x</p><div class='c'><h2>y</h2></div>")
    for skeleton in (a, b, c):
        assert len(ways(skeleton)) == len(extract.slots_of(skeleton, a)) == skeleton.count("(") - skeleton.count("*(")
    at = {name: extract.slots_of(x, a) for name, x in zip("abc", (a, b, c))}
    assert at["b"][:-2] == at["c"][:-2] == at["a"][: len(at["b"]) - 2] and not set(at["b"][-2:]) & set(at["c"][-2:])


def test_template_of_each_layout_slot_and_host(spark):
    layouts = ("<div class='a'><h2>Stay tuned</h2>{}</div>", "<section><h3>Stay tuned b</h3>{}</section>", "<table><tr><td>Stay tuned c<td>{}</table>")
    rows = [(10 * k + n, f"http://h.org/{n}/{k}", f"<body><p>Printed by {n}</p>{layout.format(f'<div><p>text {n} {k}</p></div>')}</body>") for n, layout in enumerate(layouts) for k in range(6)]
    # A text that is template at one place is content at another.
    rows.append((100, "http://h.org/q", "<body><p>Printed by 0</p><div class='a'><h2>Stay tuned</h2><div><p>Stay tuned</p></div></div></body>"))
    # One html on two hosts, where only one has the text on its other pages.
    page = "<body><p>Welcome</p><div>{}</div></body>"
    rows += [(200 + k, f"http://one.org/{k}", page.format(f"story {k}")) for k in range(5)] + [(300 + k, f"http://two.org/{k}", page.replace("Welcome", f"Day {k}").format(f"tale {k}")) for k in range(5)]
    rows += [(400, "http://two.org/x", page.format("story 0"))]
    got = {r.page_id: r.text for r in extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[10 * k + n] == f"text {n} {k}" for n in range(3) for k in range(6))
    assert got[100] == "Stay tuned" and got[200] == "story 0" and got[400] == "Welcome\n\nstory 0"


# --- toxicity


@pytest.fixture(scope="module")
def spoken(spark):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(5, 120))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["zworst", "nasty", "Vile"]) + r.choice("abc"))
        rows.append((k, " ".join(words), 0.5, 1))
        labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(None, None, None, None), (1000, "", None, 1), (1001, "zworsta nastyb vilec " * 20_000, 1.0, 0)], "doc_id long, text string, score double, label int")
    frame = spark.createDataFrame(labels + [(None, 1, 1), (1001, 1, None), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, frame, {k: t for k, _, t in labels}


def test_toxicity_of_held_out_rows(spoken):
    docs, labels, truth = spoken
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 603
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95 and len(held) > 100
    assert {r.predicted for r in rows if r.doc_id == 1001} == {1} and {r.predicted for r in rows if r.doc_id in (None, 1000)} == {0}


def test_held_out_labels_are_not_learned_from(spark, spoken):
    docs, labels, _ = spoken
    other = labels.withColumn("toxic", toxicity.F.when(toxicity.F.crc32(toxicity.F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert one.bias == two.bias and (one.bins == two.bins).all() and (one.weights == two.weights).all()


def test_grams_are_chosen_in_tasks_and_partitions_are_put_together(spark, spoken):
    docs, labels, _ = spoken
    rows = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 20_000).collect()
    counts, seen = np.zeros((2, toxicity.BINS)), np.bincount([r.label for r in rows], minlength=2)
    for r in rows:
        counts[r.label, next(toxicity.held_bins([r.text or ""], np.ones(toxicity.BINS, dtype=bool)))] += 1
    q, p = counts + 0.5
    ratio = np.log(p / (seen[1] + 1)) - np.log(q / (seen[0] + 1))
    certain = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
    least = np.sort(certain)[-50]
    frame = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 20_000)
    clean, toxic, bins, ratios = toxicity._telling_grams(frame, 50)
    assert [clean, toxic] == seen.tolist() and len(bins) == 50 and (np.diff(bins) > 0).all()
    assert np.allclose(ratios, ratio[bins]) and set(np.flatnonzero(certain > least * 1.000001)) <= set(bins) and (certain[bins] >= least * 0.999999).all()
    context = spark.sparkContext
    context.setJobGroup("many parts", "")
    many = toxicity.fit(docs.repartition(300), labels)
    context.setLocalProperty("spark.jobGroup.id", None)
    # The driver fetches the rows of a partition by a job each; there were more than 300.
    assert len(context.statusTracker().getJobIdsForGroup("many parts")) <= 8 * context.defaultParallelism + 10
    few = toxicity.fit(docs, labels)
    assert (many.bins == few.bins).all() and np.allclose(many.weights, few.weights)


def test_accepted_keeps_columns_and_empty_tables_work(spark, spoken):
    docs, labels, _ = spoken
    model = toxicity.fit(docs, labels)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == toxicity.scored(docs, model).filter("predicted = 0").count()
    bare = toxicity.fit(docs.limit(0), labels.limit(0))
    assert {r.score for r in toxicity.scored(docs.limit(3), bare).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), model).collect() == []


def test_gram_bins_do_not_join_texts():
    everything = np.ones(toxicity.BINS, dtype=bool)
    alone = [set(b) for t in ("ab", "cd", "") for b in toxicity.held_bins([t], everything)]
    assert [set(b) for b in toxicity.held_bins(["ab", "cd", ""], everything)] == alone and len(alone[0]) == 3


# --- vectors


def test_vectors_and_odd_rows(spark):
    r = np.random.default_rng(2)
    rows = []
    for k in range(120):
        v = r.normal(size=16)
        rows.append((k, v.tolist(), k % 3))
        if k % 4 == 0:
            rows += [(1000 + 10 * k + i, (v * (i + 1) + r.normal(size=16) * 0.02 * (i + 1)).tolist(), k % 3) for i in range(3)]
    rows += [(5000 + k, rows[0][1], 0) for k in range(50)] + [(6000, rows[0][1], None), (6001, None, 1), (6002, [], 1), (6003, [0.0] * 16, 1), (6004, [float("nan")] * 16, 1), (6005, [None] * 16, 1), (6006, [1e300] * 16, 1), (6007, [1e300] * 15, 1), (None, [1.0, None], 1), (6008, [1e-300] * 16, 1)]
    frame = spark.createDataFrame([(*x, "k", 1) for x in rows], "vec_id long, embedding array<double>, label int, key string, copies int")
    usable = {k: (np.array(v) / max(abs(x) for x in v), y) for k, v, y in rows if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {k: [o for o, (w, z) in usable.items() if o != k and z == y and len(w) == len(v) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98] for k, (v, y) in usable.items()}
    component = {k: k for k, *_ in rows if k is not None}
    for _ in range(200):
        new = {k: min([component[k], *(component[o] for o in links.get(k, []))]) for k in component}
        if new == component:
            break
        component = new
    got = vectors.near_vectors(frame, n_pivots=32).collect()
    found = sum(r.n_links for r in got) / sum(map(len, links.values()))
    assert found >= 0.9 and len(got) == len(rows)
    assert sorted(map(tuple, got), key=key) == sorted([(k, len(links.get(k, [])), component.get(k), k is None or component[k] == k) for k, *_ in rows], key=key)
    assert vectors.near_vectors(frame.limit(0)).collect() == []


def test_blocks_of_a_list_find_the_same_pairs(spark, monkeypatch):
    r = np.random.default_rng(3)
    centre = r.normal(size=8)
    rows = [(k, (centre + r.normal(size=8) * 0.1).tolist(), 1) for k in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, vectors.near_vectors(frame, n_pivots=16).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 20)
    assert sorted(map(tuple, vectors.near_vectors(frame, n_pivots=16).collect())) == whole and whole[0][1] > 0


def test_spread_pivots_avoid_a_crowd():
    r = np.random.default_rng(1)
    rows = np.concatenate([np.eye(6), np.eye(6)[[0] * 500] + r.normal(size=(500, 6)) * 0.01])
    picked = vectors.spread_out(rows / np.linalg.norm(rows, axis=1, keepdims=True), 6)
    assert (np.abs(picked @ picked.T - np.eye(6)) < 0.1).all()


# --- pipeline


def test_stages_and_their_decisions(spark):
    from backflow.llm import decontam, neardup, secrets
    from backflow.llm.common import read, stored

    docs = read(spark, SMALL, "documents")
    extra = docs.limit(3).union(spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (9_000_000, "password=abcdefgh1 " + "tail " * 9, "en", "s", 5)], docs.schema))
    docs = docs.union(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SMALL))
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name == "toxicity":
            model = toxicity.fit(docs, read(spark, SMALL, "labels"))
            assert ids(out) == ids(toxicity.scored(docs, model).filter("predicted = 0"))
        if name == "near_duplicates":
            assert out.count() == out.select("doc_id", "text").distinct().count()
            assert ids(out) - {None} == ids(neardup.near_duplicates(docs.filter("doc_id is not null")).filter("kept"))
        if name == "decontamination":
            assert ids(out) == ids(decontam.contamination(docs, read(spark, SMALL, "benchmark")).filter("not contaminated"))
        if name == "secrets":
            assert out.count() == docs.count() and secrets.secret_report(out).filter("n_access + n_hex > 0").count() == 0
            assert "[secret]" in out.filter("doc_id = 9000000").first().text and out.filter("n_chars <> char_length(text) and text like '%[secret]%'").count() == 0
        if name == "packing":
            assert out.agg({"length": "sum"}).first()[0] == out.select("doc_id", "doc_tokens").distinct().agg({"doc_tokens": "sum"}).first()[0]
        docs = out


def test_texts_that_share_an_id_stay(spark):
    rows = [(1, "one text here", "en", "b", 13), (1, "one text here", "en", "a", 13), (1, "quite another text", "en", "a", 18), (2, "one text here", "de", "a", 13), (None, None, None, "z", None), (None, None, None, "y", None), (None, "", None, "z", 0)]
    out = corpus_pipeline.without_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SMALL)
    assert sorted(map(tuple, out.collect()), key=key) == sorted([rows[1], rows[2], rows[5]], key=key)


@pytest.mark.parametrize("name", ["op1_url_rules", "op2_wrapper_texts", "op5_toxicity", "op9_pivot_permutations"])
def test_registered_queries_answer_every_row(spark, name):
    table, column = {"op1": ("pages", "page_id"), "op2": ("pages", "page_id"), "op5": ("documents", "doc_id"), "op9": ("embeddings", "vec_id")}[name[:3]]
    got = queries.QUERIES[name](spark, SMALL).select(column).collect()
    assert sorted(got) == sorted(spark.read.parquet(f"{SMALL}/{table}.parquet").select(column).collect())


def test_vector_recall_on_the_given_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r.label for r in rows])
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    assert sum(r.n_links for r in queries.op9_pivot_permutations(spark, SMALL).collect()) >= 0.9 * (near.sum() - len(rows))
