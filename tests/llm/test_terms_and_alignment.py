"""Terms derived from regexes, places of many matches, and tree alignment on unlike and wide pages."""

import random
import re
import time
from functools import lru_cache
from re import _constants as sre, _parser

import pytest

from backflow.llm import extract, secrets
from backflow.llm.dom import Page, shapes, tree_match
from backflow.llm.regexterms import mandatory


def some_regex(r, depth):
    kind = r.randrange(8)
    if depth == 0 or kind < 3:
        return "".join(r.choice("abcAB-") for _ in range(r.randrange(1, 5)))
    if kind == 3:
        return "[" + "".join(r.sample("abcxyz", r.randrange(1, 4))) + "]"
    if kind == 4:
        return f"(?:{some_regex(r, depth - 1)}|{some_regex(r, depth - 1)})"
    if kind == 5:
        return f"(?:{some_regex(r, depth - 1)})" + r.choice(["?", "*", "+", "{2}", "{1,3}", "{2,}"])
    if kind == 6:
        return f"(?i:{some_regex(r, depth - 1)})"
    return some_regex(r, depth - 1) + some_regex(r, depth - 1)


def some_match(r, items):
    out = ""
    for op, value in items:
        if op is sre.LITERAL:
            out += chr(value)
        elif op is sre.IN:
            out += chr(r.choice(value)[1])
        elif op is sre.BRANCH:
            out += some_match(r, r.choice(value[1]))
        elif op is sre.SUBPATTERN:
            out += some_match(r, value[3])
        else:
            least, most, inner = value
            out += "".join(some_match(r, inner) for _ in range(r.randint(least, min(most, least + 2))))
    return out


def test_no_match_lacks_the_mandatory_trigrams():
    r, asked = random.Random(1), 0
    for _ in range(2000):
        pattern = some_regex(r, 4)
        terms = mandatory(pattern)
        for _ in range(4):
            text = some_match(r, _parser.parse(pattern))
            assert re.fullmatch(pattern, text)
            asked += bool(terms)
            assert not terms or any(all(g in text.lower() for g in grams) for grams in terms), (pattern, text, terms)
    assert asked > 2000


def test_terms_of_some_regexes():
    assert mandatory("abcd") == [("abc", "bcd")] and mandatory("(?:abc|xyz)+q") == [("abc",), ("xyz",)]
    assert mandatory("[0-9a-f]{32,}") == mandatory("ab") == mandatory("(?:abc)?") == mandatory("abc|[a-z]+") == mandatory("") == []
    assert mandatory("ab[cd]e") == [("abc", "bce"), ("abd", "bde")] and mandatory("^abc$") == [("abc",)] and mandatory("abc[^x]def") == [("abc", "def")]
    assert mandatory("ÄBCD") == [("bcd",)] and mandatory("x(?:ab){2}") == [("aba", "bab", "xab")] and mandatory("ab_?cd") == [("_cd", "ab_", "b_c"), ("abc", "bcd")]


def test_many_matches_in_one_text(spark):
    many, r = 30_000, random.Random(3)
    parts = [r.choice(["token=abcdefgh%d", "é AKIAABCDEFGHIJKLM%04d", "secret: short", "😀 api_key='%032x'"]) for _ in range(many)]
    text = " ".join(p % k if "%" in p else p for k, p in enumerate(parts)) + " end"
    frame = spark.createDataFrame([(1, text), (2, "token=abcdefgh1" + "x" * 70_000 + " token=abcdefgh2"), (3, "plain " * 30_000)], "doc_id long, text string")
    started = time.time()
    got = {x.doc_id: x for x in secrets.secret_report(frame).collect()}
    left = {x.doc_id: x.text for x in secrets.redacted(frame).collect()}
    assert time.time() - started < 120
    for k, whole in frame.collect():
        found = sorted((m.start(), order, m.end()) for order, rule in enumerate(secrets.RULES) for m in re.finditer(rule.pattern, whole, re.A) if len(m[rule.group]) >= rule.least)
        assert got[k].spans == ",".join(f"{secrets.RULES[o].kind}:{s}:{e}" for s, o, e in found)
        out, at = [], 0
        for start, _, end in found:
            if start >= at:
                out += [whole[at:start], "[secret]"]
            at = max(at, end)
        assert left[k] == "".join(out) + whole[at:]
    assert got[1].n_access > 5000 < got[1].n_assign


def plain_match(a, b):
    """Simple tree matching as its definition has it."""
    tag = lambda x: x.label.partition(".")[0]
    if tag(a) != tag(b):
        return 0

    @lru_cache(None)
    def best(i, j):
        if i == 0 or j == 0:
            return 0
        return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + plain_match(a.children[i - 1], b.children[j - 1]))

    return (1 if a.label == b.label else 0.5) + best(len(a.children), len(b.children))


def some_tree(r, depth):
    label = r.choice(["a", "a.x", "a.y", "b", "b.x"])
    return f"{label}({''.join(some_tree(r, depth - 1) for _ in range(r.randrange(4) if depth else 0))})"


def test_tree_match_is_the_heaviest_alignment():
    r = random.Random(8)
    for _ in range(400):
        a, b = (shapes(f"r({some_tree(r, 3)}{some_tree(r, 2)}{some_tree(r, 3)})").children[0] for _ in "ab")
        weight, pairs = tree_match(a, b)
        assert weight == plain_match(a, b)
        nodes = lambda top: {n.number: (n, p) for n, p in walk(top, None)}
        left, right = nodes(a), nodes(b)
        # Matched nodes have matched parents, keep their order, and weigh what the match weighs.
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) and sorted(pairs) == sorted(pairs, key=lambda x: x[1])
        assert all((left[i][1], right[j][1]) in {*pairs, (None, None)} for i, j in pairs)
        assert weight == sum(1 if left[i][0].label == right[j][0].label else 0.5 for i, j in pairs)


def walk(node, parent):
    yield node, parent
    for child in node.children:
        yield from walk(child, node.number)


@pytest.mark.parametrize("form", ["<article id='post-{k}'>{body}</article>", "<div id='post-{k}'>{body}</div>", "<div class='post post-{k}'>{body}</div>", "<section class='entry {word}'>{body}</section>"])
def test_names_of_single_pages_do_not_hide_the_template(spark, form):
    words = ["".join("abcdefghij"[int(c)] for c in str(k + 100)) for k in range(30)]
    rows = [(k, f"http://h.org/{k}", f"<body>{form.format(k=k, word=words[k], body=f'<p>Always the same</p><div><p>story {k}</p><h2>part {k}</h2></div>')}</body>") for k in range(30)]
    got = {r.page_id: r.text for r in extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"story {k}\n\npart {k}" for k in range(30)}


def test_pages_without_any_name_lose_their_menus(spark):
    page = "<html><body><div><ul><li>Home<li>News<li>Contact</ul></div><div><h1>Title {k}</h1>{body}</div><div><div>Read this too</div><div>Copyright by us</div></div></body></html>"
    rows = [(k, f"http://bare.org/{k}", page.format(k=k, body="".join(f"<p>text {k} {n}</p>" for n in range(1 + k % 5)))) for k in range(25)]
    got = {r.page_id: r.text for r in extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "\n\n".join([f"Title {k}", *[f"text {k} {n}" for n in range(1 + k % 5)]]) for k in range(25)}
    # A plain induction: of one skeleton's pages, blocks of one node whose text half of the pages have there.
    for some in ([k for k in range(25) if k % 5 == n] for n in range(5)):
        pages = {k: Page(rows[k][2]) for k in some}
        held = [{(b.node, b.text) for b in p.blocks} for p in pages.values()]
        for k, p in pages.items():
            assert got[k] == "\n\n".join(b.text for b in p.blocks if 2 * sum((b.node, b.text) in h for h in held) < len(some))


def test_wide_pages_end_in_time():
    r = random.Random(5)
    wide = lambda n: "<body>" + "".join(f"<{t} id='i{k}' class='{r.choice('uvw')}'>x</{t}>" for k, t in enumerate(r.choice(["p", "h2", "div", "ul"]) for _ in range(n))) + "</body>"
    a, b = Page(wide(8_000)).skeleton, Page(wide(8_000)).skeleton
    started = time.time()
    assert len(extract.slots_of(a, b)) == a.count("(") - a.count("*(")
    same = Page(wide(20_000)).skeleton
    assert extract.slots_of(same, same)[-1] == same.count("(") - same.count("*(") - 1
    assert time.time() - started < 30
