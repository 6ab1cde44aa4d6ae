"""Operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import textwrap
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat, common, embeddings, licences, minhash, mixing, pieces, quality, token_counts, url_filter, warc
from tidewell.llm.common import perhaps_in, words
from tidewell.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997} the x{i % 13}" for i in range(9000))
TEXTS = [None, "", "  \n\t ", "one", "one two", "a b c d e f g h a b c d e f g h z", "x\ny\nx\n \n\nx", "UP low ÄÖ 😀 # $ <tag> | %", "café \u00a0 nbsp", LONG, "a\x0bb\x0cc\rd", "the the the the the the the the the the the the"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None, "xx")[i % 4], ("s1", None, "s2")[i % 3], 7) for i, t in enumerate(TEXTS)]
    rows += [(1, "", "en", "s1", 7), (9, LONG, "en", "s1", 7), (None, "one two three four", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")


def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_words int")


def base(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_words(spark, docs):
    for row in docs.select("text", words(F.col("text")).alias("w")).collect():
        assert row["w"] == WORD.findall(row["text"] or "")


def test_quality(spark, docs):
    found = quality.quality(docs).collect()
    assert len(found) == docs.count()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], r)
    for i, t in enumerate(TEXTS):
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(t), t
        n, _, _, _, again = base(t)
        assert r["base_failed"] == (n < 20 or 100 * again > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(none(spark)).count() == 0
    assert quality.filtered(docs).columns == docs.columns


def test_distance_is_jensen_shannon(spark):
    p, q = np.array([0.2, 0.3, 0.5, 0]), np.array([0.1, 0, 0.4, 0.5])
    m = (p + q) / 2
    kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    got = spark.range(1).select(quality.distance(F.array(*map(F.lit, p.tolist())), F.array(*map(F.lit, q.tolist())))).first()[0]
    assert got == pytest.approx(((kl(p, m) + kl(q, m)) / 2) ** 0.5)


def test_quality_tells_junk(spark):
    clean = "The cat was on the mat and it was happy to be there with all of its friends from the town, for that is what they like. " * 3
    rng = np.random.default_rng(1)
    vocabulary = clean.split()
    rows = [(i, " ".join(rng.permutation(vocabulary * 2).tolist()), "en") for i in range(40)]
    rows += [(100, " ".join(f"{w}###" for w in vocabulary * 2), "en"), (101, " ".join(f"| {i}" for i in range(300)), "en")]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i in range(40) if base(rows[i][1])[4] * 100 <= 30 * base(rows[i][1])[0])
    assert not kept[100] and not kept[101]


def test_quality_limits_follow_the_length(spark):
    """Short junk is found among documents of its length, longer junk by what shorter ones tell; without a reference nothing is judged."""
    rng = np.random.default_rng(11)
    common, rare = "the of and to in is it that for on by as was are with".split(), [f"stone{i}" for i in range(400)]
    text = lambda n, share: " ".join(rng.choice(common if rng.random() < share else rare) for _ in range(n))
    good = [(i, text(int(rng.integers(62, 120)), 0.4), "en") for i in range(120)]
    junk = [(1000 + i, text(70, 0.0), "en") for i in range(5)] + [(1100 + i, " ".join(f"${i}%{k}$#{k}" for k in range(60)), "en") for i in range(5)] + [(1200, text(4000, 0.0), "en")]
    spared = [(2000, text(70, 0.0), "fi"), (2001, text(70, 0.0), None), (2002, text(20, 0.1), "en"), (2003, text(3000, 0.4), "en")]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(good + junk + spared, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i, _, _ in good + spared) and not any(kept[i] for i, _, _ in junk)


def test_quality_finds_labelled_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality(docs).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in found}
    assert kept[1] >= 0.995 and kept[0] <= 0.3


def test_licences(spark):
    rows = [(k, t) for k, ts in enumerate(licences.TEMPLATES.values()) for t in ts]
    found = licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = list(licences.TEMPLATES)
    assert all(r["families"] == names[r["doc_id"]] for r in found)
    other = licences.scanned(spark.createDataFrame([(0, t) for t in [*licences.OTHER, *(t for t in TEXTS if t != LONG)]], "doc_id long, text string")).collect()
    assert not any(r["families"] for r in other)
    held = ["Prose before it. This code is released under the MIT License and nothing else.\nNext line", "copyright of the book is disputed by heirs", "x\n\nLicensed under the Apache License, Version 2.0. Some more words follow here."]
    found = licences.scanned(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["families"] for r in found] == ["MIT", "", "Apache-2.0"] and found[2]["found"][0]["line"] == 2
    assert licences.model()["accuracy"] > 0.95


def test_licence_lines_without_a_key_word(spark):
    lines = ["All rights reserved.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."]
    found = licences.scanned(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["families"] for r in found] == ["Proprietary", "MIT", "CC-BY-NC", "Apache-2.0", "GPL-3.0"]


def test_licence_gate_passes_what_can_be_confirmed():
    m, rng = licences.model(), np.random.default_rng(3)
    gate = re.compile(licences.gate().replace(r"\p{L}\p{N}", "a-z0-9"))
    for ids in m["pairs"]:
        least = next(n for n in range(len(ids) + 1) if n >= licences.CONFIRMED * len(ids))
        for _ in range(200):
            assert gate.search(" -- ".join(m["names"][i] for i in rng.permutation(ids)[:least]))


def test_licences_by_hand(spark):
    """Lines made of templates and other prose, scored anew with numpy from the model's weights."""
    import random

    m, rng = licences.model(), random.Random(9)
    noise = [w for t in licences.OTHER for w in t.split()]
    lines = []
    for t in [t for ts in licences.TEMPLATES.values() for t in ts] * 3 + licences.OTHER:
        kept = [w if rng.random() > 0.1 else rng.choice(noise) for w in t.split() if rng.random() > 0.1]
        lines.append(" ".join(rng.choices(noise, k=rng.choice((0, 4, 20))) + kept))
    place = {f: i for i, f in enumerate(m["names"])}
    weights, intercepts = np.array(m["weights"]) / licences.SCALE, np.array(m["intercepts"]) / licences.SCALE
    want = []
    for line in lines:
        w = re.findall(r"[^\W_]+", line.lower())
        ids = {place[f] for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))] if f in place}
        score = intercepts + weights[:, sorted(ids)].sum(1)
        p = np.exp(score - score.max())
        k = int(p.argmax())
        sure = k < len(m["families"]) and p[k] / p.sum() >= m["limit"]
        held = any(len(ids & set(t)) >= licences.CONFIRMED * len(t) for t, owner in zip(m["pairs"], m["owners"], strict=True) if owner == k)
        want.append(m["families"][k] if sure and held else "")
    found = licences.scanned(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["families"] for r in found] == want and 50 < sum(map(bool, want)) < len(want)


def test_wrapped_licences(spark):
    long = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts if len(t) > 90]
    cases = [(f, "Some prose stands here\n\n" + "\n".join(mark + x for x in textwrap.wrap(t, width)) + "\n\nand more of it") for f, t in long for width in (72, 30) for mark in ("", " * ", "# ")]
    cases += [("BSD", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"), ("", "Released under\n\nthe MIT\n\nLicense"), ("", "use in source\n#\nand binary")]
    found = licences.scanned(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["families"] for r in found] == [f for f, _ in cases]
    assert found[-3]["n_licences"] == 1 and found[-3]["found"][0]["line"] == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://COM/en/x", "https://a.b.com/en/1?q#f", "http://example.com/en/77", "http://wexample.com/en/7", "http://x.example.com/en/7", "http://x.net/de/8", "http://example.net/de/8/", "http://y.example.net/de/80", "http://org/es/", "http://com", "ftp://u.com?x=/en/", "http://a.com/EN/", "x://a://b.com/en/"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] * 2

    def brute(u):
        if not u or "://" not in u:
            return "", "", None
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
        host, path = m[1].lower(), m[2]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1:] if fits else None

    found = url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path, rule = brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[0] if rule else None)
        assert r["verdict"] == rule[1] if rule else r["verdict"] in ("allow", "block")
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_models_generalise(spark):
    rng = np.random.default_rng(2)
    good = [f"http://w{rng.integers(50)}.net/de/garten{rng.integers(900)}" for _ in range(300)]
    bad = [f"http://w{rng.integers(50)}.com/en/casino-win{rng.integers(900)}" for _ in range(300)]
    new = [f"http://q{i}.info/x/garten{i}" for i in range(30)] + [f"http://q{i}.info/x/casino-win{i}" for i in range(30)]
    found = url_filter.url_verdicts(spark.createDataFrame(list(enumerate(good + bad + new)), "page_id long, url string")).where("rule IS NULL").orderBy("page_id").collect()
    right = [r["verdict"] == ("allow" if i < 30 else "block") for i, r in enumerate(found)]
    assert sum(right) >= 57


def verdicts_by_hand(urls):
    """Allow or block of every URL that no rule fits, from plain Witten-Bell models."""
    import math

    def rule(u):
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]) if "://" in u else None
        fits = [(len(h + p), v) for v, h, p in url_filter.RULES if m and ("." + m[1].lower()).endswith("." + h) and m[2].startswith(p)]
        return max(fits)[1] if fits else None

    plain = [re.sub("[A-Z]", lambda c: c[0].lower(), u or "") for u in urls]
    said = [rule(u or "") for u in urls]
    held = [hashlib.md5(p.encode()).hexdigest()[0] < url_filter.HELD_OUT for p in plain]
    most, seen = url_filter.ORDER, {"allow": Counter(), "block": Counter()}
    mark = lambda p: "\x02" + p + "\x03"
    for p, v, h in zip(plain, said, held, strict=True):
        if v and not h:
            s = mark(p)
            seen[v].update(s[i - k : i + 1] for i in range(1, len(s)) for k in range(min(most, i) + 1))
    both = seen["allow"] + seen["block"]
    after = {v: {} for v in seen}
    for v in seen:
        for g, n in seen[v].items():
            total, kinds = after[v].get(g[:-1], (0, 0))
            after[v][g[:-1]] = total + n, kinds + 1

    def probability(v, context, c):
        """In the model the strings seen twice or more, of which each shorter ending is in it too."""
        if not context:
            total = sum(n for g, n in seen[v].items() if len(g) == 1)
            return (seen[v][c] + 1) / (total + url_filter.ALPHABET)
        lower = probability(v, context[1:], c)
        total, kinds = after[v].get(context, (0, 0))
        return (seen[v][context + c] + kinds * lower) / (total + kinds) if total else lower

    def ratio(s, i):
        """The difference for a character: from the longest string in the model, by what the contexts above it leave."""
        out = 0
        for k in range(min(most, i), -1, -1):
            context, c = s[i - k : i], s[i]
            if both[context + c] >= url_filter.LEAST_COUNT:
                return out + math.log(probability("allow", context, c)) - math.log(probability("block", context, c))
            if any(both[g] >= url_filter.LEAST_COUNT for g in followers.get(context, ())) and k:
                for v, sign in (("allow", 1), ("block", -1)):
                    total, kinds = after[v].get(context, (0, 0))
                    out += sign * math.log(kinds / (total + kinds)) if total else 0
        return out

    followers = {}
    for g in both:
        followers.setdefault(g[:-1], []).append(g)
    score = [sum(ratio(mark(p), i) for i in range(1, len(p) + 2)) / (len(p) + 1) * 1e6 for p in plain]
    step = url_filter.STEP
    points = [(max(-url_filter.EDGE, min(url_filter.EDGE, math.floor(x / step))), v) for x, v, h in zip(score, said, held, strict=True) if v and h]
    bins, limit = sorted({b for b, _ in points}), 0
    na, nr = (sum(v == w for _, w in points) for v in ("allow", "block"))
    if na and nr:
        miss = lambda b: nr * sum(v == "allow" and x < b for x, v in points) + na * sum(v == "block" and x >= b for x, v in points)
        best = min(bins, key=lambda b: (miss(b), abs(b), b))
        below = bins[bins.index(best) - 1] if bins.index(best) else best - 1
        limit = step * math.floor((best + 1 + below) / 2)
    return [v or ("allow" if x >= limit else "block") for x, v in zip(score, said, strict=True)], [x - limit for x in score]


def some_urls():
    urls = [f"http://w{i % 50}.{'net/de/garten' if i % 2 else 'com/en/casino-win'}{i * 7 % 900}" for i in range(400)] + [f"http://q{i}.info/x/{'garten' if i % 2 else 'casino-win'}{i}" for i in range(40)]
    return urls + [None, "", "http://a.com/é😀", "HTTP://Q.INFO/CASINO-WIN", "x\x02y\x03z"]


def test_url_models_by_hand(spark):
    urls = some_urls() + [f"http://{'net' if i % 3 else 'com'}.org/{'de' if i % 5 else 'es'}/mixed{i % 7}" for i in range(60)]
    want, far = verdicts_by_hand(urls)
    found = url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    sure = [i for i, x in enumerate(far) if abs(x) > 20]  # weights are rounded to millionths
    assert len(sure) > 0.95 * len(urls)
    assert [found[i]["verdict"] for i in sure] == [want[i] for i in sure]


def test_url_models_are_the_same_whatever_is_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(some_urls())), "page_id long, url string")
    want = url_filter.url_verdicts(pages).orderBy("page_id").collect()
    assert sum(r["verdict"] == ("allow" if r["page_id"] % 2 else "block") for r in want[400:440]) >= 38
    for least in (30, 1_000_000):
        monkeypatch.setattr(url_filter, "_COMMON", f"SELECT {least} AS least FROM {{counts}} LIMIT 1")
        assert url_filter.url_verdicts(pages).orderBy("page_id").collect() == want


def test_long_urls_are_cut_without_loss(spark, monkeypatch):
    long = "http://x.info/" + "gärten😀/" * 12_000
    texts = spark.createDataFrame([("k", "\x02" + "aé😀b" * 9 + "\x03"), ("l", "\x02\x03")], "key string, s string")
    monkeypatch.setattr(url_filter, "PART", 7)
    got = sorted((r["g"], r["gram"], r["context"]) for r in url_filter.strings(texts, "key").collect())
    want = [(s[i - k : i + 1], i > 0, i < len(s) - 1 and k < 4) for _, s in texts.collect() for i in range(len(s)) for k in range(min(i, 4) + 1)]
    assert got == sorted(want)
    monkeypatch.undo()
    found = url_filter.url_verdicts(spark.createDataFrame([*enumerate(some_urls()), (9999, long), (9998, long + "x")], "page_id long, url string"))
    assert found.where("page_id >= 9998").count() == 2


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary_path(token_counts.VOCABULARY))
    odd = ["<|startoftext|>a <|endoftext|>b", "Σίσυφος ΟΔΟΣ", "e\u0301 \u0301x", "don't  can't'll", "\u2028 \x85 \u3000x", "１２３ ½", "a" * 5000]
    more = docs.select("doc_id", "text", F.lit(1).alias("n_tokens")).union(spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(odd)], "doc_id long, text string, n_tokens int"))
    texts = {r["doc_id"]: r["text"] or "" for r in more.collect()}
    found = token_counts.token_counts(more).collect()
    assert len(found) == more.count()
    for r in found:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 2048), texts[r["doc_id"]][:50]
    assert token_counts.token_counts(none(spark)).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"])
def test_other_vocabularies(name):
    counter = token_counts.Counter(token_counts.vocabulary_path(name), batch_bytes=50)
    texts = ["", "one two", "x" * 100, "a\n b  c"]
    assert counter(texts) == [token_counts.encoder(token_counts.vocabulary_path(name))[0]([t])[0] for t in texts]
    assert [len(b) for b in token_counts.balanced(["a" * 30, "b" * 30, "c" * 100, "d"], 60)] == [2, 1, 1]


def test_warc_round_trip(spark, tmp_path):
    big = "z" * 300
    rows = [(1, None), (2, ""), (3, big), (4, big), (5, "short"), (6, "short"), (7, "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n" + big), (8, "é€😀\r\n\r\n" * 40), (None, big), (3, big), (9, "y" * 3_000_000)]
    df = spark.createDataFrame([(i, h, "x") for i, h in rows], "page_id long, html string, record_type string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path, file_bytes=2000)
    found = warc.read_warc(spark, path).collect()
    assert not [r for r in found if r["record_type"] == "gap"]
    expected = Counter()
    for i, h in rows:
        data = (h or "").encode()
        again = h == big and i != 3
        expected[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == expected
    warc.write_warc(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def _raw(n, payload):
    digest = hashlib.sha256(payload).hexdigest()
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: {n}\r\nWARC-Block-Digest: sha256:{digest}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    import gzip

    records = [_raw(n, f"payload {n} ".encode() * 20) for n in range(6)]
    parts = [gzip.compress(r) for r in records] if packed else records
    whole = warc.salvage(b"".join(parts))
    assert [r.headers["warc-page-id"] for r in whole.records] == list("012345") and not whole.gaps
    ids = lambda s: [r.headers["warc-page-id"] for r in s.records]
    start = len(parts[0]) + len(parts[1])
    hurt = bytearray(b"".join(parts))
    hurt[start + len(parts[2]) // 2] ^= 0xFF  # a byte of record 2
    found = warc.salvage(bytes(hurt))
    assert ids(found) == list("01345") and found.gaps[0][:2] == (start, start + len(parts[2]))
    cut = b"".join(parts[:3]) + parts[3][: len(parts[3]) // 2] + b"".join(parts[4:])
    found = warc.salvage(cut)
    assert set("012") | {"5"} <= set(ids(found)) and len(found.gaps) == 1
    found = warc.salvage(b"noise" + b"".join(parts) + b"tail")
    assert ids(found) == list("012345") and [g[:2] for g in found.gaps] == [(0, 5), (5 + sum(map(len, parts)), 9 + sum(map(len, parts)))]
    assert warc.salvage(b"").records == [] and warc.salvage(b"WARC/1.1\r\nX").gaps


def test_payloads_do_not_pass_for_records():
    forged = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 999\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n".encode()
    signed = _raw(998, b"an archive inside an archive")
    outer, ids = _raw(1, b"before " + forged + signed + b" after"), lambda s: [r.headers["warc-page-id"] for r in s.records]
    good = outer + _raw(2, b"x" * 50)
    assert ids(warc.salvage(good)) == ["1", "2"]
    wrong = good.replace(b"before ", b"bEfore ")  # the digest is wrong, the frame is whole
    found = warc.salvage(wrong)
    assert ids(found) == ["2"] and found.gaps == [(0, len(outer), "wrong digest")]
    length = re.search(rb"Content-Length: (\d+)", _raw(1, b"before " + forged + b" after"))[0]
    broken = _raw(1, b"before " + forged + b" after").replace(length, b"Content-Length: 9999", 1)
    found = warc.salvage(broken + _raw(2, b"x" * 50))
    assert ids(found) == ["2"] and found.gaps == [(0, len(broken), "no line ends where the block should end")]
    whole = forged.replace(b"WARC-Type", b"WARC-Record-ID: <urn:x:1>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Type")
    assert ids(warc.salvage(b"noise" + whole)) == ["999"] and not ids(warc.salvage(b"noise" + forged))


def test_salvage_is_linear():
    import gzip
    import time

    member = gzip.compress(_raw(5, b"payload " * 40))
    took = []
    for n in (25_000, 100_000):
        begun = time.perf_counter()
        found = warc.salvage(member * n)
        took.append(time.perf_counter() - begun)
        assert len(found.records) == n and not found.gaps
    assert took[1] < 8 * took[0]
    hurt = (b"WARC/1.1\r\nX" * 30_000) + _raw(1, b"y")
    begun = time.perf_counter()
    assert len(warc.salvage(hurt).records) == 1 and time.perf_counter() - begun < 30


def test_warc_fields(spark, tmp_path):
    rows = [(3, "z" * 300, "http://a/\r\nX: y"), (4, "z" * 300, None), (4, "z" * 300, ""), (None, "q", "http://b"), (None, "q", "http://b")]
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, html string, url string"), path, url_column="url", date="2024-01-02T03:04:05Z")
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    found = warc.salvage(data)
    assert len(found.records) == 5 and not found.gaps
    assert len({r.headers["warc-record-id"] for r in found.records}) == 5
    assert all(r.headers["warc-date"] == "2024-01-02T03:04:05Z" and all(r.headers[x] for x in warc.MANDATORY) for r in found.records)
    assert sorted(r.headers["warc-target-uri"] for r in found.records) == ["http://a/%0D%0AX: y", "http://b", "http://b", "urn:page:4", "urn:page:4"]
    assert all((r.headers["warc-type"] == "revisit") == (r.headers.get("warc-profile") == warc.PROFILE) for r in found.records)


def jaccard_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(texts, 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            p, q = sorted((find(i), find(j)))
            root[q] = p
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("cell", [512, 3])
def test_near_duplicates(spark, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL", cell)
    monkeypatch.setattr(minhash, "SIGNATURES", cell)
    rng = np.random.default_rng(3)
    texts = dict(enumerate(TEXTS))
    n = 100
    for length in (9, 40, 200):
        seed = [f"t{rng.integers(400)}" for _ in range(length)]
        for _ in range(30):
            w = list(seed)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(length)] = f"n{rng.integers(9)}"
            texts[n] = " ".join(w) if rng.random() < 0.7 else "\n ".join(w).upper()
            n += 1
    df = spark.createDataFrame([(i, t, 5) for i, t in texts.items()] + [(3, "one", 5), (None, "one", 5), (None, "never seen before here", 5)], "doc_id long, text string, kept int")
    found = minhash.near_duplicates(df, width=3, percent=85).collect()
    assert len(found) == len(texts) + 3
    expected = jaccard_components(texts, 3, 85)
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert sorted(str(r["component_id"]) for r in found if r["doc_id"] is None) == ["3", "None"]
    assert minhash.near_duplicates(none(spark)).count() == 0


def test_banding():
    assert minhash.banding(85) == (32, 6) and minhash.banding(80) == (38, 5)
    assert minhash.banding(100)[1] == 192 and minhash.banding(1)[1] == 1


def test_loose_chains_do_not_grow_together(spark):
    """Neighbours share a half of their shingles, so that they meet in buckets; only the pairs planted are moved and linked."""
    rng = np.random.default_rng(21)
    words_of = [[f"c{k}w{rng.integers(10**6)}" for _ in range(20)] for k in range(1200)]
    texts = {k: " ".join(words_of[k] + words_of[(k + 1) % 1200] + words_of[(k + 2) % 1200]) for k in range(1200)}
    for k in range(0, 1200, 100):
        texts[5000 + k] = texts[k] + " end"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen = minhash.sketches(df, "doc_id", "text", 3, 85).where("key IS NOT NULL").select("id", "n", "buckets", "signature")
    placed = seen.select("id", F.explode("buckets").alias("bucket"))
    met = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").join(placed, "bucket").select("id").distinct().count()
    edges = {tuple(sorted(r)) for r in minhash.resembling(seen, 85).collect()}
    assert met > 600 and edges == {(k, 5000 + k) for k in range(0, 1200, 100)}
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, width=3, percent=85).collect()}
    assert found == {k: k - 5000 if k >= 5000 else k for k in texts}


def test_alike_spans_all_pairs():
    rng = np.random.default_rng(22)
    base = rng.integers(0, 256, (6, 192), dtype=np.uint8)
    grid = np.repeat(base, 10, axis=0)
    for row in grid:
        at = rng.choice(192, 25, replace=False)
        row[at] = rng.integers(0, 256, 25, dtype=np.uint8)
    for sides in ([0] * 60, [i % 2 for i in range(60)]):
        edges = minhash.alike(list(range(60)), sides, [100] * 60, [x.tobytes() for x in grid], 130, 85)
        root = list(range(60))
        for a, b in edges:
            assert a // 10 == b // 10 and (sides[a] != sides[b] or not any(sides))
            root = [root[a] if x == root[b] else x for x in root]
        assert all(root[i] == root[i - i % 10] for i in range(60)) and len(edges) == 54
    assert not minhash.alike([1, 2], [0, 0], [100, 84], [grid[0].tobytes()] * 2, 130, 85)


def test_min_max_signatures_estimate_without_bias():
    rng = np.random.default_rng(5)
    a, b = minhash.permutations(minhash.PERMUTATIONS)
    agree = []
    for _ in range(150):
        x = rng.integers(0, 1 << 63, 230, dtype=np.uint64)
        one, two = minhash.signature(x[:215], a, b), minhash.signature(x[15:], a, b)
        agree.append((one == two).mean())
    assert np.mean(agree) == pytest.approx(200 / 230, abs=0.01)
    assert np.var(agree) <= 1.1 * (200 / 230) * (30 / 230) / (2 * minhash.PERMUTATIONS)


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(1000, k) for k in range(1001, 1200)] + rng.integers(2000, 2300, (200, 2)).tolist() + [(5, 5), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame([tuple(e) for e in edges], "a long, b long")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert found == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_perhaps_in(spark):
    ids = spark.range(0, 1000, 7).selectExpr("id").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    df = spark.range(0, 5000).selectExpr("id AS doc_id", "1 AS _bits").union(spark.sql("SELECT CAST(NULL AS BIGINT), 1"))
    rows = perhaps_in(df.drop("_bits"), "doc_id", ids).collect()
    assert all(r["_maybe"] for r in rows if r["doc_id"] is None or r["doc_id"] < 1000 and r["doc_id"] % 7 == 0)
    assert sum(r["_maybe"] for r in rows) < 160


def test_chat(spark):
    bad = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", bad), (1, 2, "assistant", ""), (2, 0, None, None), (3, 5, "assistant", "#### \\ ##\n</turn></turn>\n😀 <|endoftext|>"), (3, None, "a: b### c", "x"), (4, 1, "assistant", LONG), (4, 1, "assistant", LONG), (None, 0, "assistant", "n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    chunks = chat.formatted(df, chunk=1000)
    assert chunks.where("conv_id = 4").count() == 2
    found = {r["conv_id"]: r for r in chat.read_back(chunks).collect()}
    assert len(found) == 5
    for conv, r in found.items():
        own = sorted([(-1 if t is None else t, x or "", y or "") for c, t, x, y in rows if c == conv], key=lambda x: (x[0], x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        lost = "".join(y for _, x, y in own if x == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(lost))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x}\n{y}\n" for _, x, y in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(lost.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(f"### {chat.escaped(x, chat.IN_ROLE)}: {chat.escaped(y)}</turn>\n") for _, x, y in own)
    for t in (bad, "#####", "\\\\", "<</turn>", "#\\##"):
        assert chat.unescaped(chat.escaped(t)) == t and "###" not in chat.escaped(t) and "</turn>" not in chat.escaped(t)
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_chat_cuts_change_no_ids():
    import random

    rng, codec = random.Random(5), chat.codec(chat.VOCABULARY)
    parts = ["a", "the", " ", "  ", "   ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "é", "ß", "梦", "😀", "'s", "'ll", "12", "...", "#", "A", "\u0301", "<|endoftext|>"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choices(parts, k=rng.randint(1, 18))) for _ in range(4000)]
    whole = [x.ids for x in codec.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, np.int32).tolist() for x in codec.encode(texts)] == whole
    assert [codec.decode(np.frombuffer(x, np.int32)) for x in codec.encode(texts)] == texts


def test_mixing(spark, docs):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), f"s{int(rng.integers(5)) if rng.random() < 0.6 else 0}", 1) for i in range(600)]
    rows += [(1000, "a b c", None, 1), (1000, "a b c", None, 1), (None, "x y", "é", 1), (1001, None, "zero", 1), (1002, " ", "zero", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    found = mixing.draws(df.drop("size").withColumn("n", F.size(words(F.col("text"))).cast("long")), F.col("source"), F.col("n"), F.col("doc_id"), block_words=64, shards=8)
    out = found.select("_row.doc_id", "_row.source", "_size", F.col("_s.size").alias("source_size"), F.col("_s.target").alias("target"), mixing.taken().alias("taken"), "_draws").collect()
    assert len(out) == len(rows)
    total = sum(r["_size"] for r in out)
    by = {}
    for r in out:
        assert r["taken"] <= 3 * r["_size"]
        by.setdefault(r["source"], []).append(r)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert sum(r["_size"] for r in v) == v[0]["source_size"]
        assert v[0]["target"] <= 3 * v[0]["source_size"]
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1
    shards, per = Counter(), {}
    for r in out:
        assert r["taken"] == sum(d["end"] - d["first"] for d in r["_draws"])
        for d in r["_draws"]:
            per.setdefault((r["source"], d["round"], d["block"]), set()).add(d["shard"])
            shards[d["shard"]] += d["end"] - d["first"]
    assert all(len(s) == 1 for s in per.values()) and set(shards) == set(range(8))
    blocks = Counter(next(iter(s)) for s in per.values())
    assert max(blocks.values()) - min(blocks.values()) <= 1
    plan = mixing.mix_plan(df.drop("size"), block_words=64, shards=8).collect()
    assert sum(r["end_word"] - r["first_word"] for r in plan) == sum(r["taken"] for r in out)
    mixed = mixing.mixed(df.drop("size"), block_words=64, shards=8)
    assert mixed.columns == ["doc_id", "text", "source"]
    assert mixed.select(F.sum(F.size(words(F.col("text"))))).first()[0] == sum(r["taken"] for r in out)
    assert mixing.mixed(none(spark)).count() == 0


def mixed_draws(rows, block, seed):
    """What is taken of each (id, source, size), drawing by drawing: id, first and end word of each part without a gap in a round."""
    import math

    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n for _, s, n in rows if s == name) for name in names]
    out = []
    for name, size, target in zip(names, sizes, mixing.targets(sizes), strict=True):
        own = sorted((hashlib.md5(f"{seed}-{'' if i is None else i}".encode()).hexdigest(), n, i) for i, s, n in rows if s == name)
        line = [(i, k) for _, n, i in own for k in range(n)]
        n = max(1, -(-size // block))
        step, first = mixing.permuted(n, seed, "" if name is None else "s" + name)
        assert sorted((k * step + first) % n for k in range(n)) == list(range(n))
        left = math.floor(target + 0.5)
        while left > 0:
            drawn = set()
            for k in sorted(range(n), key=lambda k: (k * step + first) % n):
                places = range(k * block, min((k + 1) * block, size))[:left]
                drawn |= set(places)
                left -= len(places)
            parts = []
            for at in sorted(drawn):
                i, k = line[at]
                if parts and parts[-1][0] == i and parts[-1][2] == k:
                    parts[-1][2] += 1
                else:
                    parts.append([i, k, k + 1])
            out += map(tuple, parts)
    return out


def mixed_by_hand(rows, block, seed):
    out = Counter()
    for i, first, end in mixed_draws(rows, block, seed):
        out[i] += end - first
    return out


def test_mixing_by_hand(spark):
    rng = np.random.default_rng(18)
    rows = [(i, ("a", "b", "c", None)[int(rng.integers(4)) if rng.random() < 0.5 else 0], int(rng.integers(0, 90))) for i in range(300)] + [(900, "long", 5000), (901, "zero", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    takes = {}
    for seed in (1, 2):
        found = mixing.draws(df, F.col("source"), F.col("n"), F.col("doc_id"), block_words=50, shards=5, seed=seed).select("_row.doc_id", "_row.source", "_row.n", mixing.taken().alias("taken"), F.col("_s.target").alias("target")).collect()
        takes[seed] = {r["doc_id"]: r["taken"] for r in found}
        by_hand = mixed_by_hand(rows, 50, seed)
        assert takes[seed] == {i: by_hand[i] for i, _, _ in rows}
        again = mixing.draws(df.repartition(7), F.col("source"), F.col("n"), F.col("doc_id"), block_words=50, shards=5, seed=seed).select("_row.doc_id", mixing.taken().alias("taken")).collect()
        assert {r["doc_id"]: r["taken"] for r in again} == takes[seed]
        for name in ("a", "b", "c", None, "long"):
            assert abs(sum(r["taken"] for r in found if r["source"] == name) - next(r["target"] for r in found if r["source"] == name)) <= 0.5
        assert all(r["taken"] <= 3 * r["n"] for r in found)
    assert takes[1] != takes[2]


def test_nothing_is_taken_but_what_shards_draw(spark, monkeypatch):
    """With a tree that deals out only half of the quotas, half of the blocks are taken."""
    df = spark.createDataFrame([(i, "a", 40) for i in range(500)], "doc_id long, source string, n long")
    monkeypatch.setattr(mixing, "split", lambda quotas, shards, rng: np.vstack([quotas // 2 // shards] * shards))
    found = mixing.draws(df, F.col("source"), F.col("n"), F.col("doc_id"), block_words=100, shards=4).select(F.sum(mixing.taken())).first()[0]
    assert found == 500 * 40 // 2


def test_mixed_keeps_texts_together(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(30)), "ab"[i % 2], 0) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    out = mixing.mixed(df, block_words=45, shards=4).collect()
    taken = Counter(w for r in out for w in r["text"].split())
    plan = mixing.mix_plan(df, block_words=45, shards=4).collect()
    assert taken == Counter(f"d{r['doc_id']}w{k}" for r in plan for k in range(r["first_word"], r["end_word"]))
    assert all(r["n_chars"] == len(r["text"]) and r["text"] in rows[r["doc_id"]][1] for r in out)
    assert sum(r["text"] == rows[r["doc_id"]][1] for r in out) > len(out) / 2
    by_shard = {}
    for r in plan:
        by_shard.setdefault(r["shard"], []).append(r["source"])
    assert len(by_shard) == 4 and all(set(x) == {"a", "b"} and sorted(x) != x for x in by_shard.values())


def test_targets_and_tree():
    assert mixing.targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100]) == [30.0, 120.0, 60.0]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    rng = np.random.Generator(np.random.PCG64(1))
    leaves = mixing.split(np.array([50, 7, 0, 1000]), 7, rng)
    assert leaves.sum(0).tolist() == [50, 7, 0, 1000] and np.ptp(leaves.sum(1)) <= 1


def test_draws_beyond_a_billion():
    rng = np.random.Generator(np.random.PCG64(1))
    leaves = mixing.split(np.array([3_000_000_000, 5, 0, 2_000_000_000]), 6, rng)
    assert leaves.sum(0).tolist() == [3_000_000_000, 5, 0, 2_000_000_000] and np.ptp(leaves.sum(1)) <= 1
    assert abs(leaves[:, 0] - 5e8).max() < 6 * 15000


def test_large_draws_have_the_distribution(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(2))
    exact = rng.hypergeometric(3000, 2000, 700, 20000)
    monkeypatch.setattr(mixing, "BILLION", 0)
    mine = np.array([mixing.hypergeometric(3000, 2000, 700, rng) for _ in range(20000)])
    assert abs(exact.mean() - mine.mean()) < 0.5 and abs(exact.std() - mine.std()) < 0.3


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((n, (centre + rng.normal(size=16) * rng.choice([0, 0.02, 0.06])).tolist(), label))
                n += 1
    rows += [(n + k, [1.0] * 16, 1) for k in range(60)]
    n += 60
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0, None] * 8, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [1.0] * 16, None), (n + 5, [], 1), (n + 6, [1.0] * 8, 1), (n + 7, [2.0] * 8, 1), (None, [1.0] * 16, 1), (n + 8, [1e300] * 16, 1), (n + 9, [1e-300] * 16, 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")

    def cosine(a, b):
        a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
        return a @ b / np.sqrt((a @ a) * (b @ b))

    good = [(i, v, g) for i, v, g in rows if i is not None and v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = Counter(), {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, v, g), (j, w, h) in combinations(good, 2):
        if g == h and len(v) == len(w) and cosine(v, w) >= 0.98:
            links[i] += 1
            links[j] += 1
            p, q = sorted((find(i), find(j)))
            root[q] = p
    found = embeddings.near_vectors(df).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_links"], r["component_id"]) == (links[r["vec_id"]], find(r["vec_id"])), r
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_reach_is_exact_unless_queries_tell_more():
    exact = embeddings.exact_reach(0.98)
    assert embeddings.whole_reach([], 0.98, 0.98) == exact and embeddings.whole_reach([0.01] * 100, 0.98, 0.98) == exact and embeddings.whole_reach([0.01] * 58, 0.98, 0.95) == exact
    assert embeddings.whole_reach([0.01] * 200, 0.98, 0.98) == pytest.approx(0.015)
    assert embeddings.whole_reach([0.19] * 200, 0.98, 0.98) == exact and embeddings.whole_reach([0.01] * 9999, 0.98, 1.0) == exact


@pytest.mark.parametrize("noise", [0.004, 0.02])
def test_near_vectors_recall_where_the_reach_is_measured(spark, monkeypatch, noise):
    """More links than the exact way would need: the measured reach finds nine in ten and more, and invents none."""
    monkeypatch.setattr(embeddings, "PER_CELL", 4)
    rng = np.random.default_rng(19)
    centres = rng.normal(size=(500, 24))
    x = np.repeat(centres, 6, axis=0)
    x += rng.normal(size=x.shape) * rng.choice([noise, 4 * noise], size=(len(x), 1))
    rows = [(i, v.tolist(), i % 2 * (i // 6 % 3)) for i, v in enumerate(x)]
    reach = []
    take = embeddings.whole_reach
    monkeypatch.setattr(embeddings, "whole_reach", lambda *a: reach.append(take(*a)) or reach[-1])
    found = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert reach[0] < embeddings.exact_reach(0.98)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    got = np.array([found[i] for i in range(len(x))])
    assert (got <= near.sum(1)).all() and got.sum() >= 0.98 * near.sum() and near.sum() > 3000


def test_every_length_has_its_grid(spark):
    rng = np.random.default_rng(20)
    rows = [(i, rng.normal(size=6).tolist(), 1) for i in range(400)] + [(1000 + i, rng.normal(size=5).tolist(), 1) for i in range(3)]
    classes = spark.createDataFrame([(str(g), len(v), hashlib.md5(str(i).encode()).digest(), np.array(v).tobytes()) for i, v, g in rows], "label string, dim int, key binary, vec binary")
    samples = embeddings.sampled(classes, classes.groupBy("label", "dim").agg(F.count("*").alias("n")))
    assert {d: len(x) for d, x in samples.items()} == {6: 400, 5: 3}


def test_pieces_are_the_librarys(spark, docs):
    import random

    import sentencepiece

    machine = pieces.transducer(pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path(pieces.MODEL))
    rng = random.Random(4)
    parts = ["a", "the", " ", "   ", "\n", "é", "梦", "▁", "😀", "\x00", "ing", "er", "2", "...", "A", "\u0301", "st", "\t", "ß"]
    texts = [t for t in TEXTS if t is not None] + ["".join(rng.choices(parts, k=rng.randint(0, 16))) for _ in range(3000)] + ["x" * 3000]
    assert [machine.encode(t) for t in texts] == library.encode(texts)
    assert [machine.decode(machine.encode(t)) for t in texts] == [library.decode(library.encode(t)) for t in texts]
    found = pieces.encoded(docs.withColumn("ids", F.lit(1))).collect()
    assert len(found) == docs.count() and all(r["round_trip"] for r in found)
    by = {r["doc_id"]: r for r in found}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "")
        assert by[i]["ids"] == ids and by[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
    assert pieces.encoded(none(spark)).count() == 0


def test_workers_hold_no_other_operators_caches():
    pieces.transducer(pieces.MODEL)
    assert list(common.lean(lambda batches: batches, pieces.transducer)(iter([1, 2]))) == [1, 2] and pieces.transducer.cache_info().currsize == 1
    assert list(common.lean(lambda batches: batches)(iter([1, 2]))) == [1, 2] and pieces.transducer.cache_info().currsize == 0


def test_near_duplicates_get_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{i} " + "word " * 20_000) for i in range(120)], "doc_id long, text string").coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    most = lambda small: common.written(docs.mapInArrow(sizes, "n long"), "sizes", small_batches=small).agg(F.max("n"), F.sum("n")).first()
    assert most(False)[0] > 10e6 and most(True)[0] < 3e6 and most(True)[1] > 10e6
    assert spark.conf.get(common.BATCH_BYTES, None) is None
    spark.conf.set(common.BATCH_BYTES, "1m")  # the session's own bound holds
    assert most(True)[0] < 1.5e6 and spark.conf.get(common.BATCH_BYTES) == "1m"
    spark.conf.unset(common.BATCH_BYTES)
    asked = {}
    monkeypatch.setattr(minhash, "written", lambda df, name, small_batches=False: asked.update({name: small_batches}) or common.written(df, name, small_batches))
    assert minhash.near_duplicates(docs.limit(3)).count() == 3
    assert {k for k, v in asked.items() if v} == {"sketches", "alike", "links"}
