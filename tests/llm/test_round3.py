"""Periodic runs, URL filter and conversation trie: brute force, both ways of each path, and edge cases."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tickloom.llm import periodic_runs as P
from tickloom.llm import prefix_trie as C
from tickloom.llm import url_filter as W

DOCS = "doc_id bigint, text string, start string, period int"


def runs_of(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = runs_of(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return {
        "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    }


def periodic_texts(seed=1, n=60):
    rnd = random.Random(seed)
    out = [None, "", " \t\n", "a", "a a a a a a", "a a a a a", "ab " * 40, "x y " * 3 + "x", "x y " * 4, "一 二 " * 9 + "😀 " * 7]
    while len(out) < n:
        words = []
        for _ in range(rnd.randint(1, 6)):
            unit = [rnd.choice("abcdef") for _ in range(rnd.choice([1, 1, 2, 3, 8, 13, 21, 50]))]
            words += (unit * rnd.randint(1, 8))[: rnd.randint(1, len(unit) * 8)]
        out.append(rnd.choice([" ", "\n", " \t "]).join(words))
    return out


def test_periodic_runs_brute_force(spark):
    texts = periodic_texts()
    rows = [(i // 2 if i % 7 else None, t, "clash", 1) for i, t in enumerate(texts)] + [(1, texts[6], "again", 2)] * 3
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    want = sorted(repr((k, sorted(expected(t).items(), key=str))) for k, t, _, _ in rows)
    names = list(expected(""))
    lags, P.LAGS = P.LAGS, 3  # long texts in ranges of few lags
    try:
        for limit in (P.LONG_BYTES, 30):
            got = P.periodic_runs(df, long_bytes=limit, with_text=False).collect()
            assert sorted(repr((r["doc_id"], sorted({c: r[c] for c in names}.items(), key=str))) for r in got) == want
    finally:
        P.LAGS = lags
    assert P.periodic_runs(df.where("false")).count() == 0
    one = P.periodic_runs(spark.createDataFrame([(5, "go " + "la li " * 4 + "end")], "doc_id int, text string")).first()
    assert one["collapsed_text"] == "go la li end" and [tuple(r) for r in one["runs"]] == [(1, 8, 2)]


def test_periodic_runs_kernel_ranges():
    rnd = random.Random(8)
    for _ in range(40):
        docs = sorted(([rnd.randint(0, 2) for _ in range(rnd.randint(0, 30))] + [rnd.randint(0, 9) for _ in range(rnd.randint(1, 40))] * rnd.randint(1, 9) for _ in range(rnd.randint(1, 3))), key=len, reverse=True)
        sizes = np.array([len(d) for d in docs])
        first = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.array([1000 * i + v for i, d in enumerate(docs) for v in d], np.int32)
        want = sorted((s + first[i], s + n + first[i], q) for i, d in enumerate(docs) for s, n, q in runs_of(d))
        assert sorted(P.find_runs(ids, sizes)) == want
        merged = {}
        for low in range(1, 120, 11):
            for s, e, q in P.find_runs(ids, sizes, low, low + 10):
                merged[s, e] = min(q, merged.get((s, e), q))
        assert sorted((s, e, q) for (s, e), q in merged.items()) == want


def test_rebuilt_texts(spark):
    rows = [(i, " ".join(f"w{j % 37}" for j in range(i % 50))) for i in range(120)] + [(None, "a b"), (3, None)]
    got = P.with_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    texts = {k: t for k, t in rows if k is not None and t is not None}
    changed = 0
    for r in got:
        h = zlib.crc32(str(r["doc_id"]).encode())
        words = (texts.get(r["doc_id"]) or "").split()
        if r["doc_id"] is None or r["text"] is None or h % 10 or not words:
            assert r["text"] in (None, "a b", texts.get(r["doc_id"]))
            continue
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r["text"].split() == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        changed += 1
    assert changed and len(got) == len(rows)


# URL filter

URLS = [
    "http://Shop.Example.COM/de/1?x#y", "https://a.example.net/en/5", "https://example.net/en/", "http://x.net", "http://x.net?/", "http://badexample.net/en/1", "https://news.org/fr/a", "http://org/fr/", "no scheme", "", None,
    "://host/p", "http://casino-win.example.org/en/1", "ftp://ü.org/Ü?q", "http://", "https://m.Host.example.org/en/77#top", "http://a://b/c",
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path, rules=W.RULES):
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


def score_all(urls, rules=W.RULES):
    """(units, threshold) of each distinct URL with its count, in plain Python."""
    rows = []
    for u in urls:
        h, p = parts(u)
        said = rule_of(h, p, rules)[1]
        marked = bool(set(re.split("[.-]", h)) & set(W.REJECT_WORDS))
        label = "r" if said == "block" or said is None and marked else "a" if said == "allow" and not marked else None
        held = u is not None and int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % W.HELD == 0
        t = re.sub("[0-9]", "0", re.sub(r"[^\x20-\x7E]", "~", re.sub("[A-Z]", lambda m: m[0].lower(), h + p)))
        rows.append((t, label, held))
    counts = {c: {} for c in "ar"}
    for t, label, held in rows:
        s = "\x02" * W.ORDER + t + "\x03"
        if label and not held:
            for i in range(W.ORDER, len(s)):
                for k in range(W.ORDER + 1):
                    f = counts[label].setdefault(s[i - k : i], {})
                    f[s[i]] = f.get(s[i], 0) + 1

    def chance(c, context, x):
        if context is None:
            return 1 / W.ALPHABET
        shorter = chance(c, context[1:] if context else None, x)
        f = counts[c].get(context)
        return (f.get(x, 0) + len(f) * shorter) / (sum(f.values()) + len(f)) if f else shorter

    units = []
    for t, _, _ in rows:
        s = "\x02" * W.ORDER + t + "\x03"
        u = sum(round((math.log(chance("r", s[i - W.ORDER : i], s[i])) - math.log(chance("a", s[i - W.ORDER : i], s[i]))) * 1e6) for i in range(W.ORDER, len(s)))
        units.append(u // (len(t) + 1))
    return units


def test_url_parts_and_rules(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(1, URLS[1], "x", "y"), (None, URLS[0], "x", "y")]
    got = W.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string, verdict string")).collect()
    assert len(got) == len(rows)
    urls = {k: u for k, u, _, _ in rows}
    for r in got:
        h, p = parts(urls[r["page_id"]])
        rule, said = rule_of(h, p)
        assert (r["host"], r["path"], r["rule"]) == (h, p, rule)
        assert r["verdict"] == said if said else r["verdict"] in ("allow", "block")


def test_url_models_equal_plain_scores(spark):
    rnd = random.Random(6)
    urls = [f"http{'s' * rnd.randint(0, 1)}://{rnd.choice(['www.', 'm.', ''])}{rnd.choice(['thing', 'other', 'casino-x', 'spam-farm', 'news'])}.example.{rnd.choice(['com', 'net', 'org'])}/{rnd.choice(['en', 'fr', 'de', 'es'])}/{rnd.randint(1, 99)}" for _ in range(250)] + URLS
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").repartition(3)
    got = sorted(W.judge_urls(df).collect(), key=lambda r: r["page_id"])
    assert [round(r["score"] * 1e6) for r in got] == score_all(urls)
    edge = got[0]["threshold"]
    for r in got:
        assert r["verdict"] == (rule_of(r["host"], r["path"])[1] or ("block" if r["score"] >= edge else "allow"))
    free = [r for r in got if r["rule"] is None]
    assert {r["verdict"] for r in free} == {"allow", "block"}
    assert all(r["verdict"] == "block" for r in W.judge_urls(df, threshold=-99.0).where("rule IS NULL").collect())


def test_url_filter_edges(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert W.judge_urls(none).count() == 0
    one_sided = spark.createDataFrame([(1, "http://a.com/en/"), (2, "http://b.net/x")], "page_id int, url string")
    assert {r["page_id"]: r["verdict"] for r in W.judge_urls(one_sided).collect()} == {1: "allow", 2: "block"}
    clash = W.judge_urls(spark.createDataFrame([("k", "http://b.net/x" + "/long" * 20_000)], "host string, url string"), key="host").first()
    assert clash["host"] == "k" and clash["host_"] == "b.net"


# Conversations


def trie_of(convs):
    """Rows of the trie of {conv: [(role, text), ...]}."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)

    def under(k):
        yield k
        for x in children.get(k, []):
            yield from under(x)

    out = []
    for k, members in nodes.items():
        ends = sorted(c for c in members if len(convs[c]) == len(k))
        below = list(under(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children.get(k, [])), sum(x not in children for x in below), sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed=2):
    rnd = random.Random(seed)
    convs = {}
    for c in range(40):
        turns = list(rnd.choice(list(convs.values()))) if convs and rnd.random() < 0.7 else []
        turns = turns[: rnd.randint(0, len(turns))] + [(rnd.choice(["user", "assistant", ""]), rnd.choice(["hi", "é 😀", "", "yes " * 5])) for _ in range(rnd.randint(0, 4))]
        convs[c * 3 - 20] = turns
    convs[900] = [("user", "x")] * 60
    convs[901] = [("user", "x")] * 60
    return convs


@pytest.mark.parametrize("moduli", [C.MODULI, (2, 2)])
def test_trie_brute_force(spark, moduli):
    """Also with moduli of 2, so that fingerprints collide everywhere and groups have to be split."""
    convs = conversations()
    rows = [(c, i, r or None, t or None, "clash") for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, depth string").repartition(5)
    every = spark.createDataFrame([(c,) for c in convs] + [(None,)], "conv bigint")
    got = C.prefix_trie(C.turn_digests(df), every, moduli).collect()
    assert sorted((tuple(r) for r in got), key=repr) == trie_of(convs)


def test_trie_conversation_over_many_ranges(spark):
    """One conversation holds most turns, so that it lies in several ranges; a second one shares its first half."""
    long = [("user", f"t{i % 5}") for i in range(900)]
    convs = {7: long, 8: long[:450] + [("user", "else")], 9: [("user", "t0")]}
    rows = [(c, i, r, t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(6)
    digests = C.turn_digests(df)
    numbered = C.number_turns(digests)
    assert numbered.where("conv = 7").select("piece").distinct().count() > 1
    assert sorted((tuple(r) for r in C.prefix_trie(digests).collect()), key=repr) == trie_of(convs)
    # and over many batches of a range: the same fingerprints
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        again = C.number_turns(digests)
        columns = ["conv", "depth", "f0", "f1", "g0", "g1"]
        assert sorted(again.select(*columns).collect()) == sorted(numbered.select(*columns).collect())
    finally:
        spark.conf.set(name, was)


def test_trie_edges(spark):
    schema = "conv_id bigint, turn int, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert C.prefix_trie(C.turn_digests(empty)).count() == 0
    only = C.prefix_trie(C.turn_digests(empty), spark.createDataFrame([(4,), (2,), (4,)], "conv bigint")).collect()
    assert [tuple(r) for r in only] == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]
    # null order first, null role and text as empty, equal turns twice, no conversation
    df = spark.createDataFrame([(1, 0, "u", "b"), (1, None, None, None), (2, 5, "", ""), (2, 6, "u", "b"), (None, 0, "u", "b"), (3, 1, "u", "z"), (3, 1, "u", "z")], schema)
    got = sorted((tuple(r) for r in C.prefix_trie(C.turn_digests(df)).collect()), key=repr)
    assert got == trie_of({1: [("", ""), ("u", "b")], 2: [("", ""), ("u", "b")], 3: [("u", "z"), ("u", "z")]})


def test_shared_heads(spark):
    rows = [(c, i, "u", f"{c}-{i}") for c in (0, 1, 5, 42, 99, 100, 207, 305) for i in range(c % 7 + 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    digests = C.turn_digests(df)
    text = {bytes(r["digest"]): t for r, t in zip(C.turn_digests(df).orderBy("conv", "turn").collect(), [t for *_, t in sorted(rows, key=lambda r: r[:2])], strict=True)}
    got = {}
    for r in C.with_shared_heads(digests).orderBy("conv", "turn").collect():
        got.setdefault(r["conv"], []).append(text[bytes(r["digest"])])
    own = {}
    for c, _, _, t in rows:
        own.setdefault(c, []).append(t)
    want = {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + own[c][h:] for c in own}
    assert got == {c: t for c, t in want.items() if t}


# Mended operators


def test_decontamination_blocks_give_the_same_rows(spark):
    """Repeated and null keys keep their rows, whatever the number of blocks of the benchmark."""
    from tickloom.llm import decontamination as D

    q, z = " ".join(f"q{i}" for i in range(10)), "zzz yyy"
    rows = [(1, f"some words {q} and more", "c"), (1, "zzz yyy", "c"), (1, "zzz yyy", "c"), (2, None, "c"), (None, f"{q} {z}", "c"), (None, "nothing", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string").repartition(3)
    items = spark.createDataFrame([("q", q), ("z", z), ("z", "other words here"), ("e", ""), ("n", None), ("long", q + " tail")], "item_id string, text string")
    got = [sorted((repr((r["doc_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"])) for r in D.find_contamination(docs, items, block_bytes=b).collect())) for b in (1 << 20, 30)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert repr((1, 2, 2, [(0, 2)], ["z"])) in got[0] and repr((None, 12, 12, [(0, 12)], ["long", "q", "z"])) in got[0]
    assert D.find_contamination(docs.where("false"), items, block_bytes=30).count() == 0
    assert D.drop_contaminated(docs, items, block_bytes=30).count() == 2


def test_pairs_left_in_a_group_are_open(spark):
    """A group that all but two nodes have left is still compared."""
    from tickloom.llm import ngram_join as N

    groups = spark.createDataFrame([(7, 2), (7, 3), (8, 4)], "sig bigint, node bigint")
    labels = spark.createDataFrame([], "node bigint, label bigint")
    assert sorted((r["node"], r["m"]) for r in N._open_groups(groups, labels).collect()) == [(2, 2), (3, 2)]


def test_novelty_tells_words_from_random_strings():
    from tickloom.llm import secret_scan as S

    novelty = S.Novelty()
    plain = ["Donaudampfschifffahrtsgesellschaft", "counterrevolutionaries", "src/main/resources/application", "550e8400-e29b-41d4-a716-446655440000", "internationalization", "2024-01-15T12-30-45", "com.example.project.service.UserAccountManager", "/usr/local/share/applications/terminal.desktop", "Rindfleischetikettierung"]
    rnd = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = ["".join(rnd.choice(letters) for _ in range(n)) for n in (16, 20, 24, 32, 40, 64) for _ in range(20)]
    for frame in ("the token {} was set in the file", "secret {}", "please never share the password {} with anyone else on the team"):
        assert [x for x in plain if novelty.spans(frame.format(x), [])] == []
        found = sum(any(text[s:e] == x for s, _, e, _ in novelty.spans(text, [])) for x in secrets for text in [frame.format(x)])
        assert found >= 0.97 * len(secrets)


def test_html_regions():
    from tickloom.llm import html_extraction as H

    long = "A long paragraph of text that goes on with many words so that its ratio of text to tags is high. " * 3
    long = long.strip()
    for page, want in (
        (f"<div class=post><p>{long}</p><div><p>Short closing paragraph</p></div></div>", [long, "Short closing paragraph"]),
        (f"<div class=post><p>{long}</p><blockquote>Short quote</blockquote><p>{long}</p></div>", [long, "Short quote", long]),
        (f"<div class=post><p>{long}</p><table><tr><td>cell</td></tr></table></div>", [long, "cell"]),
        (f"<main><section><p>{long}</p></section><section><p>Short one</p></section></main>", [long, "Short one"]),
        (f"<article><p>{long}</p><h3>More from us</h3><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></article>", [long]),
        (f"<article><p>{long} <a href=x>a link</a> in it</p><p>{long}</p></article>", [f"{long} a link in it", long]),
        (f"<div><ul><li><a href=1>home</a><li><a href=2>about</a></ul></div><div><p>{long}</p></div>", [long]),
    ):
        assert H.blocks(page) == want, page


def test_html_unclosed_tags_are_linear_and_edges(spark):
    import time

    from tickloom.llm import html_extraction as H

    began = time.time()
    H.extract("<div>a</i>" * 100_000)
    assert time.time() - began < 30
    rows = [(1, "u", None, 1), (1, "u", "", 1), (None, None, "<p>text</p>", 1), (2, "u", "<p>x</p>" * 30_000, 1), (2, "u", "<p>text</p>", 1), (2, "u", "<p>text</p>", 1)]
    df = spark.createDataFrame(rows, "page_id int, url string, `my.html` string, n_chars int")
    got = H.extract_pages(df, html="my.html").collect()
    assert len(got) == len(rows) and sorted(r["text"] for r in got)[:2] == ["", ""] and sum(r["text"] == "text" for r in got) == 3
    assert all(r["n_chars"] == len(r["text"]) for r in got) and H.extract_pages(df.where("false"), html="my.html").count() == 0


def test_packing_keys_and_ties(spark):
    from tickloom.llm import packing

    d = spark.createDataFrame([(1, "hello world"), (2, None), (1, "hello world"), (None, "x"), (1, "other text")], "length bigint, text string").repartition(3)
    out = packing.pack(d, key="length")
    assert out.columns == ["length", "piece", "start", "length_", "ids_crc32", "sequence_id", "offset"]
    rows = sorted(out.collect(), key=lambda r: r["offset"])
    assert len(rows) == 5 and [r["offset"] for r in rows] == [sum(x["length_"] for x in rows[:i]) for i in range(5)]
    assert sorted(map(repr, rows)) == sorted(map(repr, packing.pack(d.repartition(1), key="length").collect()))


def test_chance_of_a_feature():
    from tickloom.llm import toxicity

    for least, trials, p in ((5, 20, 0.1), (12, 40, 0.05), (900, 5000, 0.1), (1, 3, 0.9)):
        exact = sum(math.comb(trials, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (trials - i) for i in range(least, trials + 1)) if trials < 100 else None
        got = toxicity._tail(least, trials, p)
        assert got == 1.0 if least <= trials * p else exact is None or got == pytest.approx(float(exact))
    # far more terms than any fixed number of them: half of the mass above the mean
    assert 0.4 < toxicity._tail(500_001, 1_000_000, 0.5) < 0.51
