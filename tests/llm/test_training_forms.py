"""Benchmark decontamination and fill-in-the-middle against brute force and their SQL."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import corpus, documents, prose
from oracle import same

from lexitrace.llm import decontamination, fill_in_middle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# -- decontamination --------------------------------------------------------------------

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def plain(text):
    return PLAIN("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def leaks(rows, items, length):
    wanted = {}
    for i, t in items:
        w = plain(t)
        size = min(length, len(w))
        for p in range(len(w) - size + 1 if w else 0):
            wanted.setdefault(tuple(w[p : p + size]), set()).add("null" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = plain(t), set(), set()
        for size in {len(k) for k in wanted}:
            for p in range(len(w) - size + 1):
                if names := wanted.get(tuple(w[p : p + size])):
                    hit |= set(range(p, p + size))
                    found |= names
        spans = [(p, next(q for q in range(p, len(w) + 1) if q + 1 not in hit)) for p in sorted(hit) if p - 1 not in hit]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit), tuple(spans)))
    return Counter(out)


def bench(rng, rows):
    texts = [t for _, t in rows if t]
    items = [(k, prose(rng, rng.choice([4, 12, 40]))) for k in range(8)]
    for k in range(8, 24):
        words = rng.choice(texts).split()
        at = rng.randrange(max(1, len(words) - 15))
        items.append((k, f"{prose(rng, 6)} {' '.join(words[at : at + rng.choice([9, 10, 11, 30])]).upper()}, {prose(rng, 3)}"))
    items += [(100, "one"), (100, "tie tie"), (101, "la " * 30), (None, prose(rng, 12)), (102, None), (103, "..!"), (2, items[9][1]), (104, "A b C d e")]
    return items


@pytest.mark.parametrize("length", [10, 3, 1, 7])
def test_leaks_equal_brute_force(spark, length):
    rng = random.Random(5)
    rows = corpus(seed=4, n=24)
    items = bench(rng, rows)
    docs = documents(spark, rows, extra=True).repartition(5)
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, window string, key string")
    got = decontamination.contamination(docs, table, length=length).collect()
    want = leaks(rows, items, length)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, tuple((s.first, s.last) for s in r.spans)) for r in got) == want
    assert sum(x[5] for x in want) > 5


def test_leaks_equal_their_sql(spark):
    same(spark, decontamination.op12_benchmark_decontamination, decontamination.SQL)


def test_no_documents_or_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(documents(spark, []), none).count() == 0
    clean = decontamination.contamination(documents(spark, [(1, "a b c"), (None, None)]), none).collect()
    assert sorted((r.n_words, r.n_hit, r.contaminated, r.items_sha256) for r in clean) == [(0, 0, False, sha("")), (3, 0, False, sha(""))]


def test_windows_with_one_fingerprint_stay_found(spark):
    """A long run of one word has a single fingerprint; its windows are all compared."""
    rows = [(1, "no " * 3000 + "yes"), (2, "no " * 9), (3, "no " * 10)]
    items = spark.createDataFrame([(1, "no " * 9 + "yes"), (2, "no " * 11)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontamination.contamination(documents(spark, rows), items).collect()}
    assert got == {1: (3001, 2), 2: (0, 0), 3: (10, 1)}


# -- fill in the middle -----------------------------------------------------------------


def forms(rows, fim=100, spm=50):
    out = []
    for i, t in rows:
        t = t or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        h = hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
            out.append((i, n, "plain", None, None, t))
        elif h4 % 100 < spm:
            out.append((i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"))
        else:
            out.append((i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))
    return Counter(out)


def lines(rng):
    return "".join(rng.choice(["\n", "a", "é", "漢字", "😀", "word ", "\r\n", "line\n", "<", "P>"]) for _ in range(rng.randrange(120)))


@pytest.mark.parametrize("options", [{}, {"batch_bytes": 64}, {"batch_bytes": 1}, {"fim_percent": 60, "spm_percent": 20}])
def test_forms_equal_brute_force_and_go_back(spark, options):
    rng = random.Random(2)
    rows = [(k, lines(rng)) for k in range(200)] + [(None, "a\nb"), (1, "x"), (2, None), (3, ""), (4, "\n" * 700), (5, "é" * 5000 + "\n" + "z" * 999), (6, "a <M> b\n"), (7, "\n"), (8, "no end")]
    made = fill_in_middle.fill_in_middle(documents(spark, rows, extra=True).repartition(3), **options)
    got = made.withColumn("back", fill_in_middle.restored(made["output"], made["form"])).collect()
    want = forms(rows, options.get("fim_percent", 100), options.get("spm_percent", 50))
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert Counter(r.back for r in got) == Counter(t or "" for _, t in rows)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}


def test_forms_equal_their_sql(spark):
    same(spark, fill_in_middle.op13_fill_in_middle, fill_in_middle.SQL)


def test_no_texts(spark):
    assert fill_in_middle.fill_in_middle(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n,share", [(0, 0.5), (1, 1.0), (512, 0.5), (513, 0.01), (5000, 0.3), (4096, 1.0), (3000, 0.0)])
def test_rank_and_select(n, share):
    flags = np.random.default_rng(n).random(n) < share
    bits, ones = fill_in_middle.Bits(flags), np.flatnonzero(flags)
    assert (bits.rank(np.arange(n + 1)) == np.concatenate([[0], np.cumsum(flags)])).all()
    assert (bits.select(np.arange(1, len(ones) + 1)) == ones).all()
