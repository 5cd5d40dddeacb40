import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction
from math import ceil, floor, log

import pytest
from helpers import WORDS, corpus, documents, prose
from oracle import same

from lexitrace.llm import html_text, language_id, licences, mixing, pii, quality_rules
from lexitrace.llm.sentencepiece_codec import Codec, decode_column, encode_and_check, encode_column, read_model

# -- personal data ----------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def accepted(kind, v):
    d = [int(c) for c in v if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def spans(text):
    return [(k, m.start(), m.end(), m.group()) for k in BASE for m in re.finditer(BASE[k], text or "") if accepted(k, m.group())]


PII = [
    "mail a.b+c@x-y.example.com, twice q@z.co.uk_r@s.de and x@y",
    "é😀 ip 1.2.3.4.5.6.7.8 bad 256.1.1.1 and 010.0.0.255; 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004",
    "+1 (743) 555-3824 +49.30.123456 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "a@b.c" * 50,
    "a." * 3000 + "@" + "b." * 3000 + "c",
    "1" * 3000,
    "1 " * 500,
    "@ + 1.1 none",
    "a@b@c.de %@a.b -@-.-",
    None,
    "",
]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(2)
    alphabet = "ab1209 .@+-()%_\né4"
    texts = [*PII, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(150))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, PII[0]), (0, PII[0])]
    got = pii.find_personal_data(documents(spark, rows, extra=True)).collect()
    assert Counter((r.doc_id, tuple((s.kind, s.start, s.end, s.value) for s in r.base)) for r in got) == Counter((i, tuple(spans(t))) for i, t in rows)
    assert sum(len(r.base) for r in got) > 40


SECRET = r"""(?i)(?:key|token|secret|password|passwd|pwd)["']?\s?[:=]\s?["']([A-Za-z0-9_+/=.-]{12,})"""


def secrets(text):
    return [("secret", m.start(1), m.end(1), m.group(1)) for m in re.finditer(SECRET, text or "")]


def blanked(text):
    out = list(text or "")
    for _, a, b, _ in spans(text) + secrets(text):
        out[a:b] = " " * (b - a)
    return "".join(out)


def disclosed(rows, threshold, support=1, radius=60, m=0.1):
    """The places of disclosing terms in each row, by the definition."""
    word = r"[\w'-]+"
    texts = {t or "" for _, t in rows}
    near, df_c, df_t = {}, Counter(), Counter()
    for t in texts:
        free = blanked(t)
        df_t.update({w.lower() for w in re.findall(word, free)})
        df_c.update({s[3] for s in spans(t) + secrets(t)})
        for _, start, end, value in spans(t) + secrets(t):
            for x in re.finditer(word, free):
                inside = start - radius <= x.start() and x.end() <= start or end <= x.start() and x.end() <= end + radius
                if inside and x.end() - x.start() > 1 and "\n" not in t[min(x.start(), start) : max(x.end(), end)]:
                    near.setdefault((value, x.group().lower()), set()).add(t)
    told, n = set(), len(texts)
    for (c, t), held in near.items():
        p = df_c[c] / n
        if len(held) >= support and p < 1 and log((len(held) + m * p) / (df_t[t] + m) / p) >= -threshold * log(p):
            told.add(t)
    return Counter((i, tuple(x.span() for x in re.finditer(word, blanked(t)) if x.group().lower() in told)) for i, t in rows)


def test_disclosing_terms_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        who = f"p{k % 4}@mail.com"
        name = ["Zorro", "Agent77", "Xena", "Yoda"][k % 4]
        line = f"{prose(rng, 6, 40)} {name} wrote {who}, {prose(rng, 4, 40)}" if k % 3 else prose(rng, 20, 40)
        rows.append((k, f"{prose(rng, 30, 40)}\n{line}\n{prose(rng, 30, 40)}"))
    rows += [(100, None), (101, ""), (102, 'nine1.2.3.4ten token = "abcdef0123456789" eleven\n5.6.7.8\ntwelve'), (103, "+1 4111 1111 1111 1111 x@y.zz" * 3), (7, rows[7][1]), (7, rows[8][1]), (None, rows[5][1])]
    for threshold, support in ((0.8, 3), (0.9, 1)):
        found = pii.find_personal_data(documents(spark, rows, extra=True), threshold, support).collect()
        want = disclosed(rows, threshold, support)
        assert Counter((r.doc_id, tuple((s.start, s.end) for s in r.added if s.kind == "term")) for r in found) == want
        assert sum(len(p) for _, p in want) > 20
    assert Counter((r.doc_id, tuple((s.start, s.end) for s in r.added if s.kind == "secret")) for r in found) == Counter((i, tuple(s[1:3] for s in secrets(t))) for i, t in rows)
    clean = {r.doc_id: r.text for r in pii.sanitise(pii.find_personal_data(documents(spark, rows), 0.8, 3)).collect()}
    assert "[email]" in clean[1] and "@" not in clean[1] and "Agent77" not in clean[1] and "agent00" in clean[1]
    assert clean[102].startswith("nine[ip]ten token = \"[secret]\" eleven\n[ip]")


def test_rows_that_repeat_an_identifier_are_judged_by_their_texts(spark):
    rows = [(1, "zorro wrote a@mail.com today"), (1, "zorro wrote a@mail.com again"), (1, "zorro wrote a@mail.com"), (2, "other words"), (3, "zorro")] + [(k, f"w{k} x y") for k in range(10, 40)]
    got = pii.find_personal_data(documents(spark, rows)).collect()
    assert Counter((r.doc_id, tuple((s.start, s.end) for s in r.added)) for r in got) == disclosed(rows, pii.DISCLOSURE)


@pytest.mark.parametrize("n", [500, 100_000])
def test_a_text_full_of_matches_takes_linear_time(spark, n):
    """At most five minutes and the memory of a test session for 100,000 matches."""
    import time

    text = " ".join(f"{k % 256}.{k // 256 % 256}.7.1 w{k % 97}," for k in range(n))
    began = time.time()
    found = pii.find_personal_data(documents(spark, [(1, text), (2, "plain words")]))
    got = {r.doc_id: r for r in found.select("doc_id", "base", "added", pii.sanitised(found.body, pii.F.concat("base", "added")).alias("clean")).collect()}
    assert time.time() - began < 300
    assert [(s.start, s.end) for s in got[1].base] == [x.span() for x in re.finditer(r"[0-9.]{7,}", text)]
    assert len(got[1].added) == sum(1 for _ in re.finditer(r"w[0-9]+", text)) and got[1].clean.startswith("[ip] w0, [ip]")


def test_rare_values_are_disclosed_wherever_the_term_occurs(spark):
    rng = random.Random(11)
    far = f"{prose(rng, 40, 40)}\nQuillon again, 100 % Quillon"
    rows = [(k, prose(rng, 60, 40)) for k in range(50)]
    rows += [(60, f"{prose(rng, 5, 40)} Quillon: only.one@mail.com {prose(rng, 5, 40)}\n{far}"), (61, None)]
    got = {r.doc_id: r for r in pii.find_personal_data(documents(spark, rows)).collect()}
    assert {i for i, r in got.items() if r.added} == {60}
    assert [(s.start, s.end) for s in got[60].added] == [m.span() for m in re.finditer("Quillon", rows[50][1])] and len(got[60].added) == 3

    # Copies of a text are one text; a term counts in texts without the value, too.
    often = [(k, f"{prose(rng, 8, 40)} Quillon wrote q@mail.com {prose(rng, 8, 40)}") for k in range(30)]
    rows = often + [(100 + k, prose(rng, 60, 40)) for k in range(300)] + [(500, f"{prose(rng, 9, 40)}\nask Quillon")]
    rows += [(600 + k, "w1 w2 other@mail.com w3") for k in range(3)]
    got = {r.doc_id: r for r in pii.find_personal_data(documents(spark, rows)).collect()}
    assert [s.value for s in got[500].added] == ["quillon"] and got[500].body == rows[330][1] and got[101].body is None
    assert not any(got[600 + k].added for k in range(3))
    clean = {r.doc_id: r.text for r in pii.sanitise(pii.find_personal_data(documents(spark, rows))).collect()}
    assert "Quillon" not in clean[500] and 101 not in clean


def test_personal_data_of_nothing(spark):
    assert pii.find_personal_data(documents(spark, [])).count() == 0


# -- quality rules ----------------------------------------------------------------------


def statistics(text):
    w = WORDS(text or "")
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(6)
    rows = corpus() + [(500 + k, "\n".join(prose(rng, rng.randint(0, 6), 4) + rng.choice(["", " ", "#|", "\r"]) for _ in range(rng.randint(1, 30)))) for k in range(40)]
    rules = [(quality_rules.Test("symbol_rate", True, 0.3), quality_rules.Test("word_length", False, 3.0))]
    got = quality_rules.quality_verdicts(documents(spark, rows, extra=True), rules).collect()
    want = Counter()
    for i, t in rows:
        s = statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        hit = s[2] / max(1, s[0]) >= 0.3 and s[1] / max(1, s[0]) <= 3
        want[(i, *s, failed, not failed and not hit)] += 1
    assert Counter(tuple(r)[:8] for r in got) == want
    kept = quality_rules.keep_good(documents(spark, rows, extra=True), rules)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k, n in want.items() if k[-1] for _ in range(n))
    assert kept.columns == documents(spark, rows, extra=True).columns


def test_rules_are_learned_in_order():
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        row = {f: rng.random() for f in quality_rules.RATIOS}
        rows.append((row, row["symbol_rate"] > 0.8 or row["upper_rate"] > 0.7 and row["mark_rate"] < 0.3))
    rules = quality_rules.learn_rules(rows)
    held = [({f: rng.random() for f in quality_rules.RATIOS}) for _ in range(1000)]
    right = sum(any(all(t.holds(r) for t in rule) for rule in rules) == (r["symbol_rate"] > 0.8 or r["upper_rate"] > 0.7 and r["mark_rate"] < 0.3) for r in held)
    assert right > 950 and len(rules) >= 2
    assert quality_rules.learn_rules([]) == [] and quality_rules.learn_rules([(rows[0][0], True)] * 4) == []


def test_learning_without_labels(spark):
    docs = documents(spark, corpus())
    none = spark.createDataFrame([(None, 0), (7, None)], "doc_id long, quality int")
    assert quality_rules.fit_rules(docs, none) == []
    assert quality_rules.quality_verdicts(documents(spark, []), []).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.fit_rules(docs, labels.where("doc_id % 2 = 0"))
    got = quality_rules.quality_verdicts(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.97
    assert sum(not r.kept and r.quality == 1 for r in got) <= 1


# -- HTML -------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>Big  title</h1></header><p>First &amp; <b>bold</b>&nbsp;words of a paragraph<br>go on
here.<p>Unclosed second one with more of the text.<script>var a = "<p>no</p>";</script><ul><li>item<li>other item</ul><form>mail <input></form>
<div class="ad">Buy</div><section id="comments"><p>Great post!</p></section></article></main><aside>links</aside><footer>&copy; 1</footer></body></html>"""


def test_main_text(spark):
    assert html_text.content_blocks(PAGE) == ["Big title", "First & bold words of a paragraph go on here.", "Unclosed second one with more of the text.", "item", "other item"]
    assert html_text.content_blocks("<p>plain words</p></div><p>and more</p><p>") == ["plain words", "and more"]
    for odd in (None, "", "   ", "<", "<div", "<!-- x", "<script>x", "&#0;&bogus;", "<a" * 50, "</p>" * 50, "<div>" * 3000):
        assert isinstance(html_text.content_blocks(odd), list)
    assert html_text.content_blocks("<div><p>long enough text of a page</p><p>b</p><p>another long text of the page</p></div>") == ["long enough text of a page", "b", "another long text of the page"]
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract_main_text(pages).collect()
    assert [(r.page_id, r.n_chars) for r in got[1:]] == [(2, 0), (2, 0)] and got[0].n_chars == len(got[0].text) and "\n\n" in got[0].text
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


def test_content_region_is_kept_whole():
    long, blocks = "many words of a long paragraph " * 20, html_text.content_blocks
    p = lambda *texts: "".join(f"<p>{t}</p>" for t in texts)
    for texts in ([long] * 3 + ["b1", "b2", "b3"], ["Title", "b1", "b2", *[long] * 3], [long, "b1", long]):
        texts = [" ".join(t.split()) for t in texts]
        for page in (f"<body><nav>menu</nav><div>{p(*texts)}</div></body>", f"<div><div>{p(*texts)}"):
            assert blocks(page) == texts
        assert blocks(p(*texts)) == blocks("".join(f"<div>{t}</div>" for t in texts)) == texts
    inner = "<h1>T</h1><h2>a</h2><h3>b</h3><h2>c</h2><h3>d</h3><table><tr><td>1<td>2<td>3<tr><td>4<td>5</table>"
    line = " ".join(long.split())
    assert blocks(f"<div>{p(long, long)}{inner}{p(long)}{inner}<div class=share>x</div></div>") == [line, line, *"Tabcd12345", line, *"Tabcd12345"]
    assert blocks(f"<article>{p(*[long] * 4)}</article><article><p>a</p><p>b</p><p>c</p><p>d</p></article>") == [line] * 4 + list("abcd")


def test_words_of_classes():
    long, blocks = " ".join(["many words of a long paragraph"] * 20), html_text.content_blocks
    body = f"<p>{long}</p><p>short</p>"
    assert blocks(f'<div class="siteNav"><a>Home</a></div><div>{body}</div>') == [long, "short"]
    assert blocks(f'<div id="main-SideBar2"><p>Other</p></div><div>{body}</div>') == [long, "short"]
    assert blocks(f'<article>{body}</article><article class="teaser"><p>Read this other story now</p></article>') == [long, "short"]
    for wrap in ('<div class="search-results-story share">{}</div>', '<article class="promoted">{}</article>', '<div class="related"><main>{}</main></div>', '<div class="withSidebar"><article>{}</article></div>', '<form><article>{}</article><input></form>', '<body class="has-menu">{}'):
        assert blocks(f"<nav>menu</nav>{wrap.format(body)}<footer>x</footer>") == [long, "short"]
    assert blocks(f'<div>{body}</div><div class="share"><p>Share this</p></div><div class="Comments">{"<p>a reader comment</p>" * 90}</div>') == [long, "short"]
    assert blocks(f'<article>{body}<div class="relatedLinks"><p>More</p></div><form><p>Mail</p></form></article>') == [long, "short"]
    assert blocks(f'<section class="comments"><article class="comment"><p>{long} {long}</p></article></section><div>{body}</div>') == [long, "short"]


def test_odd_markup_never_ends_the_job(spark):
    rng = random.Random(9)
    parts = ["<", ">", "![", "<![foo[bar]]>", "<![CDATA[x]]>", "<![if !IE]>", "<![", "]]>", "<!--", "-->", "<!doctype", "<?php", "?>", "</", "<p", "<p>", "</div>", "&", "&#x", "&#99999999;", "&amp", "'", '"', "=", "text ", "\x00", "\n", "<script>", "</script", "<a href=", "<!ELEMENT", "<title>", "</title>", "<textarea>", "<plaintext>", "😀", "<svg/>", "<br/>", "<article>", "<div class=nav>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    rows = [(k, "u", t) for k, t in enumerate(["<p>before</p><![foo[bar]]><p>after</p>", *pages])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract_main_text(df).collect()}
    assert len(got) == len(rows) and "before" in got[0].text and "after" in got[0].text


def test_region_equals_brute_force():
    """Nested divs of paragraphs, a line each: the region by its definition over the tree."""
    rng = random.Random(13)
    for _ in range(300):
        lines, spans, out = [], [], []

        def grow(depth):
            first = len(lines)
            out.append("<div>")
            grow.tags += 1
            for _ in range(rng.randint(1, 4)):
                if depth and rng.random() < 0.5:
                    grow(depth - 1)
                else:
                    text = "w" * rng.choice([1, 3, 10, 80, 300])
                    out.append(f"<p>{text}</p>")
                    lines.append((text, grow.tags + 1))
                    grow.tags = 0
            out.append("</div>")
            spans.append((first, len(lines)))

        grow.tags = 0
        grow(3)
        ratio = [len(t) / g for t, g in lines]
        bell = lambda d: math.exp(-d * d / 2)
        near = [[k for k in range(i - 2, i + 3) if 0 <= k < len(ratio)] for i in range(len(ratio))]
        flat = [sum(bell(k - i) * ratio[k] for k in ks) / sum(bell(k - i) for k in ks) for i, ks in enumerate(near)]
        mean = sum(flat) / len(flat)
        cut = min(mean, math.sqrt(sum((x - mean) ** 2 for x in flat) / len(flat)) / 2)
        chosen = [k for k, x in enumerate(flat) if x >= cut]
        fits = [(b - a, a, b) for a, b in spans if b - a > 1 and a <= chosen[0] and chosen[-1] < b]
        _, a, b = min(fits, default=(0, 0, len(lines)))
        assert html_text.content_blocks("".join(out)) == [t for t, _ in lines[a:b]]


def test_smoothing_keeps_the_sum_of_flat_lines():
    assert all(abs(x - 5) < 1e-9 for x in html_text.smoothed([5.0] * 7)) and html_text.smoothed([]) == []


def test_articles_of_the_table(spark):
    import html as entities

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        want = [b for b in (" ".join(entities.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)) if b]
        assert html_text.content_blocks(r.html) == want


# -- licences ---------------------------------------------------------------------------


def licence_truth(text):
    """The best window of each template among all windows, then the best of those that
    overlap."""
    w = re.findall("[a-z0-9]+", (text or "").lower())
    g = [f"{a} {b}" for a, b in zip(w, w[1:])]
    found = []
    for name, template in licences.TEMPLATES:
        b = set(licences._bigrams(template))
        at = [k for k, x in enumerate(g) if x in b]
        best = (0.0, 0, 0)
        for i in at:
            seen = set()
            for j in range(i, len(g)):
                seen.add(g[j])
                if g[j] in b:
                    best = max(best, (2 * len(seen & b) / (len(seen) + len(b)), -i, -j))
        if best[0] >= licences.THRESHOLD:
            found.append((best[0], -best[1], -best[2], name))
    better = lambda x, y: x[3] != y[3] and x[1] <= y[2] and y[1] <= x[2] and (y[0] > x[0] or y[0] == x[0] and y[3] < x[3])
    alone = [x for x in found if not any(better(x, y) for y in found)]
    top = max((x[0] for x in alone), default=0.0)
    return ",".join(sorted({x[3] for x in alone})), min((x[3] for x in alone if x[0] == top), default=""), round(top, 6), len(alone)


def test_licences_equal_brute_force(spark):
    rng = random.Random(12)
    texts = [
        "x y z\nLicensed under the Apache License, Version 2.0.\nmore",
        "Released under the MIT License. Then words.",
        "licensed under cc by-nc 4.0",
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under a license of ours which says nothing at all about anything",
        licences.TEMPLATES[4][1],
        licences.TEMPLATES[4][1].upper().replace(" ", "\t"),
        "by by by " * 300,
        "Licensed under the MIT License " * 60,
        "Licensed",
        None,
        "",
    ]
    pool = [x for _, t in licences.TEMPLATES for x in (t, t.replace(" the ", " any "), " ".join(t.split()[: len(t.split()) * 3 // 4]))]
    texts += [f"{prose(rng, 9)}\n{rng.choice(pool)}\n{prose(rng, 5)} {rng.choice(pool)}" for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])] + corpus()
    got = licences.scan_licences(documents(spark, rows, extra=True)).collect()
    assert Counter(map(tuple, got)) == Counter((i, *licence_truth(t)) for i, t in rows)
    assert licences.scan_licences(documents(spark, [])).count() == 0


def test_notices_over_several_lines(spark):
    import textwrap

    rng = random.Random(5)
    apache, mit, gpl = licences.TEMPLATES[1][1], licences.TEMPLATES[4][1], licences.TEMPLATES[8][1]
    wrap = lambda t, n: "\n".join(f" * {x}" for x in textwrap.wrap(t, n))
    around = lambda t: f"{prose(rng, 300)}\n{t}\n{prose(rng, 300)}"
    texts = [around(wrap(mit, 76)), around(wrap(gpl, 40)), around(f"Copyright us. {wrap(apache, 25)}"), around(wrap(mit.replace("charge", "any charge whatever"), 60) + "\n\n" + wrap(gpl, 76)), around("released of the software under a licensed copy"), wrap(mit, 76)[:250] + around("")]
    texts += [around(t) for _, t in licences.TEMPLATES]
    got = {r.doc_id: r for r in licences.scan_licences(documents(spark, list(enumerate(texts)))).collect()}
    assert [got[k].licences for k in range(6)] == ["MIT", "GPL-3.0", "Apache-2.0", "GPL-3.0,MIT", "", ""]
    assert got[0].best_dice == got[1].best_dice == got[2].best_dice == 1
    # Similar licences are told apart; the first paragraph of two BSD licences is the same.
    names = [n for n, _ in licences.TEMPLATES]
    assert [(n, got[6 + k].licences) for k, n in enumerate(names)] == [(n, n) for n in names]


def test_long_texts_that_repeat_a_notice(spark):
    notice = "licensed under the mit license"
    texts = [" ".join([notice] * n) for n in (60, 450)] + ["\n".join([notice] * 450)]
    got = {r.doc_id: r for r in licences.scan_licences(documents(spark, list(enumerate(texts)))).collect()}
    assert [(got[k].licences, got[k].best_dice, got[k].n_matches) for k in range(3)] == [("MIT", 1.0, 2)] * 3


def test_long_texts_of_notices_take_linear_time(spark):
    import time

    long = licences.TEMPLATES[24][1]
    text = f"{long} and some more " * (100_000 // (len(long.split()) + 3) + 1)
    assert len(text.split()) >= 100_000
    began = time.time()
    got = {r.doc_id: r for r in licences.scan_licences(documents(spark, [(1, text), (2, "no " * 100_000 + licences.TEMPLATES[4][1])])).collect()}
    assert time.time() - began < 100
    assert (got[1].licences, got[1].best_dice, got[2].licences, got[2].best_dice) == ("MIT", 1.0, "MIT", 1.0)


def test_licences_equal_their_sql(spark):
    same(spark, licences.op6_licence_scan, licences.SQL)


# -- language ---------------------------------------------------------------------------


def test_languages_of_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.doc_id: r.lang for r in docs.collect()}
    blind = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN lang END AS lang", "source", "1 AS p0", "'x' AS declared")
    got = language_id.identify_languages(blind, pages).collect()
    of_docs = [r for r in got if r.doc_id is not None]
    assert len(of_docs) == len(want) and sum(r.lang == want[r.doc_id] for r in of_docs) > 0.97 * len(want)
    tag = {r.page_id: re.search('lang="(..)"', r.html).group(1) for r in pages.collect()}
    assert sum(r.lang == tag[r.page_id] for r in got if r.page_id is not None) > 0.97 * len(tag)


def test_other_evidence_decides_without_text(spark):
    rng = random.Random(1)
    texts = [("the cat and the dog of the house " * 5, "en"), ("der hund und die katze das haus nicht " * 5, "de")]
    docs = spark.createDataFrame([(k, *texts[k % 2], f"s{k % 2}") for k in range(40)] + [(100, None, None, "s1"), (101, "", None, None), (None, "the cat", "en", "s0")], "doc_id long, text string, lang string, source string")
    page = lambda k, lang, text: (k, f"http://a{rng.randrange(3)}.example.{'de' if lang == 'de' else 'com'}/x", f"<html lang='{lang}'><p>{text}</p>")
    pages = spark.createDataFrame([page(k, *reversed(texts[k % 2])) for k in range(40)] + [(200, "http://b.other.de", "<html lang=de><p></p>"), (201, None, None)], "page_id long, url string, html string")
    got = {(r.doc_id, r.page_id): r for r in language_id.identify_languages(docs, pages).collect()}
    assert len(got) == 85
    assert got[(100, None)].lang == "de" and got[(None, 200)].lang == "de" and got[(None, 200)].confidence > 0.9
    assert got[(101, None)].lang in ("de", "en") and got[(None, 201)].lang in ("de", "en")
    bare = language_id.identify_languages(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source"), pages.limit(1)).collect()
    assert len(bare) == 44 and {r.lang for r in bare} == {None}


def test_fusion_equals_brute_force(spark):
    """The formula row by row: declared, suffix, host and domain, itself left out."""
    rng, langs = random.Random(2), ["de", "en", "fr"]
    rows = []
    for k in range(60):
        p = [rng.random() ** 3 + 1e-9 for _ in langs]
        host = rng.choice(["a.x.de", "b.x.de", "c.y.fr", "", "x.de"])
        rows.append((k, [v / sum(p) for v in p], rng.choice([*langs, "other", "none"]), host.rpartition(".")[2], host, ".".join(host.split(".")[-2:])))
    rows += [(3, rows[3][1], *rows[3][2:])]
    df = spark.createDataFrame(rows, "key long, text_p array<double>, declared string, suffix string, host string, domain string")
    got = Counter((r.key, r.lang, round(r.confidence, 9), r.text_lang) for r in language_id.fuse(df, langs).collect())
    n, strength, pseudo = range(3), language_id.STRENGTH, language_id.PSEUDO
    mass = [sum(r[1][k] for r in rows) for k in n]
    base = [(m + pseudo) / (sum(mass) + 3 * pseudo) for m in mass]
    want = Counter()
    for key, p, declared, suffix, host, domain in rows:
        of = lambda c, v: [sum(r[1][k] for r in rows if r[c] == v) for k in n]
        without = lambda c, v: [max(0.0, x - y) for x, y in zip(of(c, v), p)]
        said = [(x + pseudo) / (mass[k] + pseudo * 5) for k, x in enumerate(of(2, declared))]
        ends = [(x + pseudo) / (mass[k] + pseudo * len({r[3] for r in rows})) for k, x in enumerate(of(3, suffix))]
        d, h = without(5, domain), without(4, host)
        of_domain = [(d[k] + strength * base[k]) / (sum(d) + strength) for k in n]
        of_host = [(h[k] + strength * of_domain[k]) / (sum(h) + strength) for k in n]
        score = [p[k] * said[k] * ends[k] * of_host[k] for k in n]
        want[(key, langs[score.index(max(score))], round(max(score) / sum(score), 9), langs[p.index(max(p))])] += 1
    assert got == want


def test_only_the_attribute_itself_declares(spark):
    told = lambda html: spark.range(1).select(pii.F.regexp_extract(pii.F.lit(html), language_id.MARKUP, 1)).first()[0]
    assert told('<html data-lang="de" lang="en">') == "en" and told("<HTML xml:lang=de\n LANG = 'fr-CA'>") == "fr-CA"
    assert told("<html class='x'lang=es>") == "es" and told("<html data-lang=de><p lang=en>") == "" and told("<html lang>") == ""


def test_languages_of_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog of the house", "en", "s"), (1, "the cat and the dog of the house", "en", "s"), (2, "der hund und die katze", "de", None)], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(1, "http://h.de/x", "<p>der hund <![foo[bar]]> und die katze"), (1, "http://h.de/x", "<p>der hund <![foo[bar]]> und die katze")], "page_id long, url string, html string")
    extra = lambda df: df.selectExpr("*", *[f"'x' AS {n}" for n in ("declared", "host", "suffix", "domain", "text_p", "score", "top", "confidence")])
    got = language_id.identify_languages(extra(docs), extra(pages)).collect()
    assert len(got) == 5 and len({(r.lang, r.confidence) for r in got if r.doc_id == 1}) == 1 and len({(r.lang, r.confidence) for r in got if r.page_id == 1}) == 1


def test_chunks_of_long_texts_count_every_trigram(monkeypatch):
    text = "abc déf ghi " * 50
    whole = Counter(x for p in language_id._pieces(text) for x in language_id._trigrams(p).tolist())
    assert sum(whole.values()) == len(text.encode())


# -- SentencePiece ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return read_model()


def test_best_path_equals_brute_force(model):
    codec, rng = Codec(model), random.Random(4)
    score = {p: codec.trie.get(p)[1] for p in codec.text.values()}

    def truth(s):
        best = [(0.0, 0)] + [None] * len(s)
        for e in range(1, len(s) + 1):
            pieces = [(best[b][0] + score[s[b:e]], best[b][1] - 1) for b in range(max(0, e - 16), e) if s[b:e] in score]
            if s[e - 1] not in score:
                pieces.append((best[e - 1][0] + codec.unknown, best[e - 1][1] - 1))
            best[e] = max(pieces)
        return best[-1]

    def worth(ids):
        total, count, k, whole = 0.0, 0, 0, ids
        while k < len(whole):
            if whole[k] in codec.byte:
                lead = codec.byte[whole[k]]
                k += 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                total += codec.unknown
            else:
                total += score[codec.text[whole[k]]]
                k += 1
            count -= 1
        return total, count

    for _ in range(150):
        s = "".join(rng.choice(["the", "ing", " ", "  ", "\n", "é", "日", "▁", "😀", "q", "zz", "tion"]) for _ in range(rng.randint(1, 25)))
        ids = codec.encode(s)
        assert worth(ids) == pytest.approx(truth(f" {s}")) and codec.decode(ids) == s


def test_round_trip(spark, model):
    rows = corpus() + [(900, "▁▁ a"), (901, "  two  spaces "), (902, "\n\n"), (903, "日本語 " * 50)]
    got = encode_and_check(documents(spark, rows, extra=True), model).collect()
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == want and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
    assert encode_and_check(documents(spark, []), model).count() == 0
    for few in (1, 7):
        assert sorted(encode_and_check(documents(spark, rows, extra=True), model, slice_ids=few).collect(), key=str) == sorted(got, key=str)
    ids = documents(spark, rows).select("text", encode_column(model).alias("token_ids"))
    assert all((r.text or "") == r.back for r in ids.select("text", decode_column(model).alias("back")).collect())


def test_kept_stretches_dont_change_results(model, monkeypatch):
    from lexitrace.llm import sentencepiece_codec as s

    text = " ".join(t for _, t in corpus() if t)
    want = Codec(model).encode(text)
    monkeypatch.setattr(s, "KEPT", 3)
    assert Codec(model).encode(text) == want


# -- mixing -----------------------------------------------------------------------------


def mixing_truth(rows, block, weights=None):
    """Earliest deadline first over all blocks, by search, with fractions."""
    sources = {}
    for i, s in rows:
        sources.setdefault("null" if s is None else f"s{s}", []).append(i)
    queue = {k: sorted(v, key=lambda i: (hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest(), i is not None, i or 0)) for k, v in sources.items()}
    natural = {k: len(v) ** 0.5 for k, v in sources.items()}
    first = natural if weights is None else {k: w for k, w in weights.items() if w > 0 and k in sources}
    out, slot = [], 0
    for part in (first, {k: w for k, w in natural.items() if k not in first}):
        whole = mixing.whole_weights(part)
        share = {k: Fraction(w, sum(whole.values())) for k, w in whole.items()}
        start, done = slot, Counter()
        while any(queue[k] for k in part):
            left = [(ceil((done[k] + 1) / share[k]), k) for k in part if queue[k] and floor(done[k] / share[k]) <= slot - start]
            if left:
                k = min(left)[1]
                out += [(i, slot) for i in queue[k][:block]]
                queue[k] = queue[k][block:]
                done[k] += 1
            slot += 1
        slot = out[-1][1] + 1 if out else 0
    return Counter((i, s, p) for p, (i, s) in enumerate(out))


def test_names_that_mislead_and_comments_that_go():
    blocks, story, reply = html_text.content_blocks, "words of the story itself " * 30, "somebody says something " * 60
    text = [story.strip()]
    assert blocks(f'<div class="post comments-open"><article><p>{story}</p></article></div>') == text
    assert blocks(f'<div class="reply-allowed"><p>{story}</p></div>') == text
    assert blocks(f'<div class="ad-free-story"><p>{story}</p></div>') == text
    assert blocks(f'<div id="post-with-comments"><p>{story}</p></div>') == text
    assert blocks(f'<p>a short text</p><article class="comment"><p>{reply}</p></article>') == ["a short text"]
    assert blocks(f'<article><p>{story}</p></article><div class="comments-area"><article><p>{reply}</p></article></div>') == text
    assert blocks(f'<div id="comments-page"><article><p>{story}</p></article></div>') == text
    assert blocks(f'<div class="no-comments"><p>{story}</p></div><section id="comments"><article><p>{reply}</p></article></section>') == text
    assert blocks(f'<article class="post has-comments"><p>{story}</p><div class="commentlist"><p>{reply}</p></div></article>') == text


@pytest.mark.parametrize("inner", ['<div class="share">', '<div class="menu">', "<span>", '<p class="ad">', "<b></i><p>"])
def test_deep_pages_take_memory_in_proportion(inner):
    import time
    import tracemalloc

    page = inner * (300_000 // len(inner)) + "<article><p>" + "text of the page " * 50
    began = time.time()
    tracemalloc.start()
    found = html_text.content_blocks(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and time.time() - began < 30 and isinstance(found, list)


def test_mixture_equals_simulation(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", None])) for k in range(400)] + [(None, "b")]
    df = spark.createDataFrame([(i, s, "x", "y") for i, s in rows], "doc_id long, source string, n string, key string")
    told = lambda mixed: Counter((r.doc_id, r.mix_slot, r.mix_position) for r in mixed.collect())
    got = mixing.mix_sources(df, block_size=3)
    assert told(got) == mixing_truth(rows, 3) and got.columns == [*df.columns, "mix_slot", "mix_position"]
    for given in ({"a": 0.7, "b": 0.2, "c": 0.1, None: 1e-3}, {"a": 0.0, "b": 5, "z": 1}, {}, {"a": 0}):
        want = mixing_truth(rows, 2, {"null" if k is None else f"s{k}": w for k, w in given.items()})
        assert told(mixing.mix_sources(df, given, block_size=2)) == want
    assert told(mixing.mix_sources(df, slice_blocks=7)) == mixing_truth(rows, mixing.BLOCK_SIZE)
    clash = df.withColumn("mix_slot", pii.F.lit("a")).withColumn("mix_position", pii.F.lit("b"))
    assert told(mixing.mix_sources(clash, block_size=3)) == mixing_truth(rows, 3)
    kept = mixing.in_mixed_order(clash).collect()
    assert {(r.mix_slot, r.mix_position) for r in kept} == {("a", "b")} and len(kept) == 401
    for wrong in ({"a": -1.0}, {"a": float("nan")}, {"a": float("inf")}):
        with pytest.raises(ValueError, match="weights"):
            mixing.mix_sources(df, wrong)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    twice = mixing.mix_sources(df.unionByName(df.withColumn("n", pii.F.lit("z"))), block_size=3)
    assert sorted(r.mix_position for r in twice.collect()) == list(range(802))
    again = mixing.mix_sources(df.withColumn("n", pii.F.lit("z")).unionByName(df).repartition(7), block_size=3)
    assert Counter(map(tuple, twice.collect())) == Counter(map(tuple, again.collect()))
    assert mixing.in_mixed_order(df).columns == df.columns and mixing.in_mixed_order(df).count() == 401


def test_no_source_strays_a_block_from_its_weight():
    cases = ({"a": 5.0, "b": 3.0, "c": 2.0}, {"a": 97.0, "b": 1.0, "c": 1.0, "d": 1.0}, {str(k): k + 1.0 for k in range(17)}, {"hot": 0.5, **{str(k): 0.5 / 19 for k in range(19)}}, {str(k): (k + 1) ** 0.5 for k in range(30)})
    for weights in cases:
        slots, whole = 20_000, mixing.whole_weights(weights)
        total = sum(whole.values())
        assert all(Fraction(whole[k], total) == Fraction(w) / sum(map(Fraction, weights.values())) for k, w in weights.items())
        plan, done = mixing.pfair_schedule({k: slots for k in weights}, whole), Counter()
        for t, (slot, k) in enumerate(plan[:slots], 1):
            assert slot == t - 1
            done[k] += 1
            if t % 7 < 2:
                assert all(abs(done[s] * total - t * w) < total for s, w in whole.items())


def test_many_sources(spark):
    rows = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id < 15000 THEN 'hot' ELSE concat('s', id % 10000) END AS source")
    got = mixing.mix_sources(rows, block_size=2).collect()
    assert sorted(r.mix_position for r in got) == list(range(40_000)) and len({r.source for r in got}) == 10_001


def test_blocks_keep_their_size(spark):
    """The first rows of the schedule are the same in a table ten times as large."""
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    of = lambda n: spark.range(n).selectExpr("id AS doc_id", "substring('aaaaabbbcc', CAST(id % 10 AS INT) + 1, 1) AS source")
    order = lambda n: [r.source for r in mixing.mix_sources(of(n), weights).where("mix_position < 80000").orderBy("mix_position").collect()]
    small, large = order(100_000), order(1_000_000)
    assert small == large
    done = Counter()
    for at, source in enumerate(large, 1):
        done[source] += 1
        if at % mixing.BLOCK_SIZE == 0:
            assert all(abs(done[k] - w * at) < mixing.BLOCK_SIZE for k, w in weights.items())


def test_mixture_equals_its_sql(spark):
    same(spark, mixing.op10_mix_sources, mixing.SQL)
