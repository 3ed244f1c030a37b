"""Licences, main text, personal data: against plain patterns and hand-made cases."""

import random
import re

import pyarrow as pa

from tests.llm.data import awkward, words
from wattloom.llm import html, licences, pii
from wattloom.llm.words import ALNUM, runs


def test_matching_statistics_are_the_longest_template_runs():
    a = licences.automaton()
    rng = random.Random(3)
    pool = [w for _, t in licences.TEMPLATES for w in words(t)]
    templates = [f" {' '.join(words(t))} " for t in [t for _, t in licences.TEMPLATES] + list(licences.PHRASES)]
    docs = []
    for _ in range(25):
        out: list[str] = []
        for _ in range(20):
            at = rng.randrange(len(pool) - 8)
            out += pool[at : at + rng.randint(1, 8)] if rng.random() < 0.5 else [rng.choice(["zzz", "the", "license"])]
        docs.append(out)
    for i, j, _, w in runs(pa.array([" ".join(d) for d in docs]), ALNUM):
        _, length = licences.matching_statistics(w, a)
        for k in range(i, j):
            for p in range(len(docs[k])):
                m = 0
                while m <= p and any(f" {' '.join(docs[k][p - m : p + 1])} " in t for t in templates):
                    m += 1
                assert length[w.first[k - i] + p] == m


def test_licence_rows(spark):
    more = [
        (20, "Released under the MIT License. mit license; GNU General Public License", "en", "s", 1),
        (21, licences.TEMPLATES[0][1] + " and then " + licences.TEMPLATES[2][1], "en", "s", 1),
        (22, "apache  LICENSE, cc-by. Apache license", "en", "s", 1),
    ]
    rows = {r.doc_id: r for r in licences.scan(awkward(spark, more)).collect()}
    assert len(rows) == 12 and rows[1].n_words == 0 and rows[1].labels == "" and rows[1].first_word is None and rows[1].score == 0
    assert (rows[20].n_base, rows[20].first_word, rows[20].last_word, rows[20].base_labels) == (3, 3, 7, "gpl,mit")
    assert rows[21].labels == "bsd,mit" and rows[21].base_labels == "" and rows[21].score == 1
    assert (rows[22].n_base, rows[22].base_labels) == (3, "apache,cc-by")


def test_neighbouring_licences_are_told_apart():
    texts = [(label, f"Some words before. {t} Some words after.") for label, t in licences.TEMPLATES]
    texts += [("agpl", licences.TEMPLATES[9][1].replace("you can redistribute it", "you may well redistribute it"))]
    texts += [("gpl", licences.TEMPLATES[6][1].split("This program is distributed")[0])]
    texts += [("cc-by,cc-by-nd", "Notes: CC BY. Licensed by a Creative Commons Attribution-NoDerivatives 4.0 International licence")]
    got = licences.scan_texts(pa.array([t for _, t in texts]))
    for (label, text), found, base in zip(texts, got["labels"], got["base_labels"]):
        assert set(found.split(",")) == set(label.split(",")) | set(filter(None, base.split(","))), text
    many = licences.scan_texts(pa.array([licences.TEMPLATES[1][1] * 20_000 + " permission is hereby granted free of charge" * 5000]))
    assert many["labels"] == ["mit"] and len(many["spans"][0]) == 20_000


def test_main_text_of_hand_made_pages(spark):
    pages = {
        1: ("<html><body><nav><a href=/>home</a></nav><div class=ad>buy, now, this</div><article><h1>T &amp; U</h1><p><b>One,  two<br>three<p>four</p></article><footer>x</footer>", "T & U\n\nOne, two three\n\nfour"),
        2: (None, ""),
        3: ("", ""),
        4: ("<div id=main><p>Some text, here.</p><ul><li>a<li>b</ul></div><div class='comments'><p>I, for one, agree, fully.</p></div>", "Some text, here.\n\na\n\nb"),
        5: ("<script>var a='<p>no</p>'</script><p>yes &lt;b&gt; &eacute;&#65;</p><form><p>mail</p></form>", "yes <b> éA"),
        6: ("plain", "plain"),
        7: ("<p>cut off <a hre", "cut off"),
    }
    df = spark.createDataFrame([(k, None, h, "x") for k, (h, _) in pages.items()], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {k: t for k, (_, t) in pages.items()}
    assert html.extract(df.limit(0)).count() == 0


def brute_spans(text):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.ORDER[s[2]], s[1]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("a.@-+19 ()9%é\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute_spans(text)


def test_field_learns_its_table_and_adds_spans():
    found = pii.find(["call (555) 010-4477 or bob (at) example.org", 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', "in 1999 we sold 300 units", None, ""])
    assert [s[2] for s in found[0][1]] == ["phone", "email"] and found[0][0] == []
    assert [s[2] for s in found[1][1]] == ["secret"]
    assert found[2:] == [([], []), ([], []), ([], [])]


def test_long_stretches_are_decoded_whole():
    filler = "room 101 on floor 3 ".split()
    for phrase, span, kind in (("call (555) 010-4477 now", "(555) 010-4477", "phone"), ("address bob [at] mail [dot] example [dot] com is new", "bob [at] mail [dot] example [dot] com", "email")):
        for n in (*range(190, 203), 4090, 4091, 4092, 4093, 4094, 4095):
            text = " ".join([*(filler[k % 5] for k in range(n)), phrase, *filler * 60])
            s = text.index(span)
            assert (s, s + len(span), kind) in pii.find([text])[0][1], (n, phrase)


def test_secrets_of_letters_alone_are_found_where_announced():
    texts = ["the new password = correcthorse was set", "api_key = mellonfriend here", "he kept the secret of the old garden", "a token of thanks to all"]
    got = [[(t[s:e], kind) for s, e, kind in spans] for t, (_, spans) in zip(texts, pii.find(texts))]
    assert got == [[("correcthorse", "secret")], [("mellonfriend", "secret")], [], []]


def test_viterbi_equals_enumeration():
    import itertools

    import numpy as np

    field = pii.train()
    rng = np.random.default_rng(0)
    e = rng.normal(size=(3, 3, pii.N_LABELS))
    got = pii.viterbi(e, np.array([3, 2, 1]), field)
    for k, n in enumerate((3, 2, 1)):
        value = lambda p: field.start[p[0]] + sum(e[k, t, p[t]] for t in range(n)) + sum(field.move[p[t - 1], p[t]] for t in range(1, n))  # noqa: B023, E731
        assert tuple(got[k, :n]) == max(itertools.product(range(pii.N_LABELS), repeat=n), key=value)


def test_personal_data_rows_and_masks(spark):
    docs = awkward(spark, [(9, "mail a.b@c.org and 4111 1111 1111 1111", "en", "s", 38)])
    rows = {r.doc_id: r for r in pii.detect(docs).collect()}
    assert len(rows) == 10 and rows[1].spans == "" and rows[9].base == "email:5:14,card:19:38"
    new = pii.redact(docs)
    assert new.columns == docs.columns and new.count() == docs.count()
    row = new.where("doc_id = 9").first()
    assert row.text == "mail [EMAIL] and [CARD]" and row.n_chars == len(row.text)
    assert new.where("doc_id = 1").first().text is None


LONG = "".join(f"<p>Paragraph {k} of the article, which has commas, words, and a good length, as articles do, in every part.</p>" for k in range(5))


def test_articles_are_kept_whatever_state_their_class_tells():
    for wrapper in ("content has-sidebar", "post comments-open", "entry with-share no-comments", "page sidebar-enabled"):
        text = html.main_text(f"<body><div class='{wrapper}'>{LONG}</div><div class='footer'>Imprint</div></body>")
        assert text.count("Paragraph") == 5 and "Imprint" not in text, wrapper
    inside = f"<body><div class='layout-sidebar'><article>{LONG}</article><div class='post-comments'>{LONG}</div></div></body>"
    assert html.main_text(inside).count("Paragraph") == 5
    for furniture in ("sidebar", "site-sidebar", "post-comments", "main-nav", "ad-slot"):
        page = f"<body><div class='main'>{LONG}</div><div class='{furniture}'><p>Not this, please, and not that, either.</p></div></body>"
        assert "Not this" not in html.main_text(page), furniture


def test_nested_containers_without_an_article():
    page = f"<body><div><div><ul><li><a href=/>one</a></li></ul></div><div><div><h1>Title</h1>{LONG}</div></div></div></body>"
    assert html.main_text(page).startswith("Title\n\nParagraph 0") and html.main_text(page).count("Paragraph") == 5


def test_deep_and_unmatched_pages_take_linear_time():
    import time

    pages = ["<span>" * 20000 + "<div>x</div>" * 2000, "</b>" * 40000 + "<i>" * 20000 + "</b>" * 4000, "<div>" * 30000 + "text" + "</p>" * 5000, "<p>" * 20000, "<li><b>" * 20000, "<table>" * 3000 + "<tr><td>" * 3000]
    for page in pages:
        begun = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - begun < 2, page[:12]


def naive_tree(page):
    """The reader's rules with plain searches among the open elements."""
    root = html.Node("#root", None)
    at, place = root, 0
    while (m := html.TAG.search(page, place)) is not None:
        at.children += [page[place : m.start()]] if m.start() > place else []
        place, name = m.end(), (m[2] or m[5]).lower()

        def around(names, stop=()):
            here = at
            while here is not root and here.name not in stop:
                if here.name in names:
                    return here
                here = here.parent
            return None

        if m[1] or m[4]:
            if (open_ := around({name})) is not None:
                at = open_.parent
            continue
        if name in html.CLOSES_P and (p := around({"p"}, html.P_BOUNDS - {"p"})) is not None:
            at = p.parent
        if name in html.IMPLIED:
            ends, bounds = html.IMPLIED[name]
            while (p := around(ends, bounds)) is not None:
                at = p.parent
        node = html.Node(name, at)
        at.children.append(node)
        at = at if name in html.VOID else node
    if page[place:]:
        at.children.append(page[place:])
    return root


def shape(node):
    return [c if isinstance(c, str) else (c.name, shape(c)) for c in node.children]


def test_trees_equal_those_of_plain_searches():
    rng = random.Random(12)
    names = ["p", "div", "span", "li", "ul", "table", "tr", "td", "dl", "dt", "dd", "br", "article", "b", "select", "option", "tbody"]
    for _ in range(400):
        page = "".join(rng.choice(["<%s>", "<%s>", "</%s>"]) % rng.choice(names) + rng.choice(["", "x", " y,"]) for _ in range(rng.randrange(1, 40)))
        assert shape(html.parse(page)) == shape(naive_tree(page)), page


def test_workers_hold_few_strings_at_once():
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import types as T

    from wattloom.llm import packing, pii

    tracemalloc.start()
    table = packing.char_classes.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
    assert [table[ord(c)] for c in "a7 ,\u00e9\u3000"] == [packing.LETTER, packing.NUMBER, packing.SPACE, packing.OTHER, packing.LETTER, packing.SPACE]

    class Documents:
        columns, schema = ["text"], T.StructType([T.StructField("text", T.StringType())])
        mapInArrow = lambda self, work, schema: work  # noqa: E731, N815

    texts = ["write to a.b@example.org", None] * 1500
    got = list(pii.redact(Documents())(iter([pa.RecordBatch.from_pydict({"text": texts})])))
    assert len(got) > 1 and max(b.num_rows for b in got) <= pii.REDACT_ROWS
    new = [x for b in got for x in b.column("text").to_pylist()]
    assert len(new) == 3000 and new[1] is None and "example.org" not in new[0] and new[0] == new[2998]


def test_packing_workers_keep_little_of_a_batch():
    import subprocess
    import sys

    # a process of its own, as memory is that of the whole worker
    code = """
import random, re, ctypes
from pathlib import Path
import pyarrow as pa
from pyspark.sql import types as T
from wattloom.llm import packing

class Documents:
    select = lambda self, *names: self
    mapInArrow = lambda self, work, schema: work

def resident():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()).group(1)) / 1024

rng = random.Random(3)
known = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(2000)]
run = packing.tokenise(Documents())
few = pa.RecordBatch.from_pydict({"doc_id": [0], "text": [" ".join(known)]})
sum(b.num_rows for b in run(iter([few])))
start = resident()
made = lambda: pa.RecordBatch.from_pydict({"doc_id": range(6000), "text": [None] + [" ".join(rng.choices(known, k=600)) for _ in range(5999)]})
docs, largest = set(), 0
for b in run(made() for _ in range(2)):
    docs.update(b.column("doc_id").to_pylist())
    largest = max(largest, b.column("ids").nbytes)
assert docs == set(range(6000)), len(docs)
del b
print(round(resident() - start), largest)
"""
    grown, largest = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert grown < 40 and largest < 1 << 20, (grown, largest)
