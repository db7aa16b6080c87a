"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import html
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from siftspark.llm import audio, bloomlm, chat, common, fingerprint, mixing, neardup, packing, pagediff, quality, queries, urlfilter

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


# ---- shared


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbÉ \n\t\x1c☃"), max_size=30)), max_size=12), st.integers(1, 40))
@settings(deadline=None)
def test_word_hashes_follow_words(texts, size):
    seen = {}
    for lo, hi, hashes, first in common.hashed(pa.array(texts, pa.string()), size=size):
        for i in range(lo, hi):
            words = WORD.findall(lower(texts[i]))
            got = hashes[first[i - lo] : first[i - lo + 1]].tolist()
            assert len(got) == len(words)
            for w, h in zip(words, got, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# ---- 1


@given(st.binary(max_size=5000))
@settings(deadline=None, max_examples=60)
def test_audio_round_trip(payload):
    media = audio.carry(payload)
    found = audio.parse(media)
    assert audio.payload_of(media, found) == payload
    assert found["crc_bad"] == 0 and found["sync_errors"] == 0 and found["vbr"]["tag_ok"] and found["vbr"]["frames"] == found["frames"]
    assert found["duration_us"] == found["frames"] * 1152 * 1_000_000 // 32000


LAYERS = [  # header, widths of the subbands' allocations, channels, subbands with an allocation for each channel
    (0xFFFEA004, [4] * 32, 2, 32), (0xFFFEA0C4, [4] * 32, 1, 32), (0xFFFEA054, [4] * 32, 2, 8),
    (0xFFFCA004, [4] * 11 + [3] * 12 + [2] * 7, 2, 30), (0xFFFCA404, [4] * 11 + [3] * 12 + [2] * 4, 2, 27), (0xFFFCA064, [4] * 11 + [3] * 12 + [2] * 7, 2, 12),
    (0xFFFC10C4, [4] * 2 + [3] * 6, 1, 8), (0xFFFC18C4, [4] * 2 + [3] * 10, 1, 12), (0xFFF48004, [4] * 4 + [3] * 7 + [2] * 19, 2, 30),
]


@pytest.mark.parametrize(("head", "widths", "channels", "bound"), LAYERS)
def test_audio_checksums_of_layers_one_and_two(head, widths, channels, bound):
    rng = np.random.default_rng(head)
    size, layer = audio.header(head)[4], audio.header(head)[1]
    frames, ends = [], []
    for _ in range(3):
        bits, chosen = "", 0
        for i, w in enumerate(widths):
            for _ in range(channels if i < bound else 1):
                value = int(rng.integers(0, 1 << w)) if rng.random() < 0.6 else 0
                bits += format(value, f"0{w}b")
                chosen += bool(value) * (1 if i < bound else channels)
        bits += "".join(rng.choice(["0", "1"], 2 * chosen)) if layer == 2 else ""
        crc = 0xFFFF
        for bit in format(head & 0xFFFF, "016b") + bits:
            crc, out = crc << 1 & 0xFFFF, crc >> 15 ^ int(bit)
            crc ^= 0x8005 if out else 0
        body = bits.ljust(8 * (size - 6), "1")
        frames.append(head.to_bytes(4, "big") + crc.to_bytes(2, "big") + int(body, 2).to_bytes(size - 6, "big"))
        ends.append(len(bits))
    whole = b"".join(frames)
    found = audio.parse(whole)
    assert (found["frames"], found["crc_good"], found["crc_bad"], found["layer"]) == (3, 3, 0, layer)
    for bit, bad in ((0, 1), (ends[1] - 1, 1), (ends[1], 0)):
        hurt = bytearray(whole)
        hurt[size + 6 + bit // 8] ^= 0x80 >> bit % 8
        assert audio.parse(bytes(hurt))["crc_bad"] == bad


def test_audio_resynchronises_and_checks():
    media = audio.carry(b"abc" * 4000)
    whole = audio.parse(media)
    at = whole["offsets"][4]
    hurt = audio.parse(media[:at] + b"\xff\xfbjunk\xff" * 9 + media[at:])
    assert hurt["frames"] == whole["frames"] and hurt["sync_errors"] == 1 and hurt["skipped_bytes"] == 63
    flipped = bytearray(media)
    flipped[at + 8] ^= 1
    assert audio.parse(bytes(flipped))["crc_bad"] == 1
    assert audio.parse(None)["frames"] == audio.parse(b"no audio here")["frames"] == 0


def test_audio_contract_columns(spark, documents):
    """Every column of the digests against the payload, which is read here from the stored stream by hand."""
    rows = {(r["doc_id"], r["n_bytes"], r["payload_sha256"]): r for r in audio.text_digests(documents).collect()}
    for doc_id, text in documents.select("doc_id", "text").collect():
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = rows[doc_id, len(raw), hashlib.sha256(payload).hexdigest()]
        media = audio.carry(payload)
        assert (r["payload_bytes"], r["tail_crc32"]) == (len(payload), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        ends = [*r["seek_offsets"][1:], len(media)]
        assert all(media[a : a + 2] == b"\xff\xfa" for a in r["seek_offsets"])
        assert b"".join(media[a + 23 : b] for a, b in zip(r["seek_offsets"], ends))[: len(payload)] == payload
        assert r["samples"] == 1152 * len(r["seek_offsets"]) and r["sample_rate"] == 32_000 and r["duration_us"] == r["samples"] * 1_000_000 // 32_000


def test_audio_index(spark):
    df = spark.createDataFrame([(1, audio.carry(b"x" * 3000)), (2, None), (3, b"\xff" * 50)], "id bigint, media binary")
    out = {r["id"]: r for r in audio.audio_index(df, "media", "id").collect()}
    assert out[1]["frames"] == len(out[1]["seek_offsets"]) == 3 and out[1]["tags"]["payload_bytes"] == "3000"
    assert out[2]["frames"] == out[3]["frames"] == 0


# ---- 2


@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14), st.sampled_from([8, 1 << 29]))
@settings(deadline=None)
def test_longest_common_subsequence(a, b, bits):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    before, pagediff.MAX_BITS = pagediff.MAX_BITS, bits
    places = pagediff.common_lines(a, b)
    pagediff.MAX_BITS = before
    rest = iter(b)
    assert len(places) == table[-1][-1] and places == sorted(set(places)) and all(a[i] in rest for i in places)


def test_shared_lines_go_where_no_article_is_named():
    a, b = (pagediff.lines(f"<div>Menu</div><p>{x} own</p><div>Foot</div>") for x in "ab")
    assert pagediff.main_text(a, b) == ("a own", 2, 0, 0)
    assert pagediff.main_text(a, a) == ("Menu\na own\nFoot", 3, 0, 0)
    assert pagediff.main_text(a, None) == ("Menu\na own\nFoot", 0, 0, 0)


def test_the_pair_decides():
    """No list of words decides alone: a slot inside an article goes if the pair has it, and shared lines go if they are the pair's too."""
    slot = lambda name, n: pagediff.lines(f"<article><p>text {n}</p><div class='{name}'>see {n}</div></article>")
    plain = pagediff.lines("<article><p>text 9</p></article>")
    assert pagediff.main_text(slot("related", 1), plain).text == "text 1\nsee 1"
    assert pagediff.main_text(slot("related", 1), slot("related", 2)) == ("text 1", 0, 1, 0)
    for name in ("related-work", "share-price", "social-history", "no-sidebar"):
        assert pagediff.main_text(slot(name, 1), slot(name, 2)).text == "text 1\nsee 1"
    a, b, c = (pagediff.lines(f"<div>{m}</div><p>{x}</p>") for m, x in (("Menu", "a"), ("Menu", "b"), ("Other", "c")))
    assert pagediff.main_text(a, b).text == "a" and pagediff.main_text(a, c).text == "Menu\na"


def test_markup_breaks_ties():
    page = pagediff.lines("<nav>menu</nav><div>teaser</div><article><p>text</p><div class=ad>buy</div></article><footer>foot</footer>")
    assert pagediff.main_text(page, None) == ("text", 0, 0, 4)
    assert pagediff.main_text(page, pagediff.lines("<article><p>other</p></article>")) == ("text\nbuy", 0, 0, 3)


@pytest.mark.parametrize("part", ['<p title="a>b</p>', "<p x='", "<b>", "</i>", "<header><h1>x", "<a href='x' \"", "<!--", "<div class=a-a-a-a->"])
def test_reading_takes_linear_time(part):
    times = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        pagediff.lines("<b>" * n + part * n + "<p>end")
        times.append(time.perf_counter() - began)
    assert times[1] < 10 * times[0] + 0.5


def test_an_unclosed_quote_ends_with_its_tag():
    assert [x.text for x in pagediff.lines('<p title="a>b</p><p>c &lt; d')] == ["b", "c < d"]
    assert [x.text for x in pagediff.lines('<p title="a > b">b</p>')] == ["b"]


def test_a_large_host_gives_the_texts_of_small_ones(spark, monkeypatch):
    """Sections of four pages, each with a menu and a foot of its own and no named article: one host of 3,000 pages, or eight hosts."""
    page = lambda i: f"<div>menu {i // 4}</div><p>own {i}</p><div>foot {i // 4}</div>"
    monkeypatch.setattr(pagediff, "LARGE_ROWS", 100)
    for hosts in (1, 8):
        rows = [(i, f"http://h{i // 4 % hosts}.org/s{i // 4:05d}/p{i % 4}", page(i)) for i in range(3_000)]
        got = pagediff.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        assert {r["page_id"]: r["text"] for r in got} == {i: f"own {i}" for i in range(3_000)}


def test_article_text(spark):
    page = "<html><body><nav><a>x</a></nav><div class='cookie-notice'>we</div><main><article><header><h1>T &amp; t</h1><p>by</p></header><p>One <b>two</b>\n three<p>Four&quot;<div class=ad>buy</div><script>'</p>'</script></article><section class=comments>no</section></main><form>f</form><footer>z</footer>"
    df = spark.createDataFrame([(1, "http://h/a", page), (2, "http://h/a", page), (3, None, None), (None, "x", "")], "page_id bigint, url string, html string")
    out = {r["page_id"]: r["text"] for r in pagediff.extracted(df).collect()}
    assert out == {1: 'T & t\nOne two three\nFour"', 2: 'T & t\nOne two three\nFour"', 3: "", None: ""}


def test_page_texts_of_the_tables(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in pagediff.extracted(pages).collect()}
    for page_id, _, page in pages.collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", page, re.S)[1])
        assert got[page_id] == "\n".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in parts)))


@pytest.mark.parametrize("limit", [7, 40])
def test_pairs_of_a_large_host(spark, monkeypatch, limit):
    monkeypatch.setattr(pagediff, "LARGE_ROWS", limit)
    rng = random.Random(limit)
    pages = [(i, f"http://{'small' if i % 10 == 0 else 'big'}.org/{rng.choice('abc')}/{rng.choice('deé')}{rng.randrange(30)}", f"<div>Menu</div><p>line {rng.randrange(3)}</p><p>own {i}</p>") for i in range(400)]
    want = {}
    for host in ("small", "big"):
        own = sorted((p for p in pages if f"//{host}." in p[1]), key=lambda p: (p[1].encode(), p[0]))
        for i, one in enumerate(own):
            pair = max([own[j] for j in (i - 1, i + 1) if 0 <= j < len(own)], key=lambda p: len(os.path.commonprefix([p[1], one[1]])))
            want[one[0]] = (pair[0], *pagediff.main_text(pagediff.lines(one[2]), pagediff.lines(pair[2])))
    got = pagediff.extracted(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(pages) and {r["page_id"]: (r["pair_id"], r["text"], r["shared_lines"], r["slot_lines"], r["markup_lines"]) for r in got} == want


# ---- 3


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.98


# ---- 4


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(rows, reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(docs).collect()}

    def shingles(text):
        w = WORD.findall(text.lower())
        return set(zip(*(w[i:] for i in range(5)), strict=False)) or {tuple(w)}

    errors = []
    for i, k in enumerate(order):
        text, after = rows[k], rows[order[(i + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[k]["n_chars"] == len(text)
        a, b, c = map(shingles, (text, edited, after))
        errors += [got[k]["near_edited"] - len(a & b) / len(a | b), got[k]["near_next"] - len(a & c) / len(a | c)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_next_rows_of_crowded_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 2)
    ids = [*range(60), 10**9, *range(10**12, 10**12 + 9), -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id bigint, text string")
    steps = fingerprint.places(df.select("doc_id"), "doc_id")
    dealt = Counter(tuple(r["__bucket"]) for r in fingerprint.in_buckets(df, steps, "doc_id").collect())
    assert len(steps[1]) > 1 and max(dealt.values()) <= fingerprint.CROWDED * 2
    order = sorted(ids, reverse=True)
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(df, df.select("doc_id"), "doc_id", ["text"]).collect()}
    assert got == {k: f"text {order[(i + 1) % len(order)]}" for i, k in enumerate(order)}


def test_next_rows_do_not_depend_on_buckets(spark, documents, monkeypatch):
    want = sorted(map(str, fingerprint.edited_fingerprints(documents).collect()))
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    assert sorted(map(str, fingerprint.edited_fingerprints(documents).collect())) == want


# ---- 5


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(deadline=None)
def test_patterns_hold_the_histogram(histogram):
    packs = packing.patterns(histogram, 64)
    held = Counter()
    for count, pack in packs:
        assert sum(pack) <= 64
        held.update({k: v * count for k, v in Counter(pack).items()})
    assert held == Counter(histogram)


def test_packing(spark, documents):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert slow.encode("<|endoftext|> hi", add_special_tokens=False).ids == packing.encoder(RANKS)("<|endoftext|> hi") == [50256, 23105]
    rows = packing.pack(documents, RANKS).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    for doc_id, text in {r["doc_id"]: r["text"] for r in documents.dropDuplicates(["doc_id"]).collect()}.items():
        if len(text or "") > 100_000 or documents.where(f"doc_id <=> {doc_id if doc_id is not None else 'null'}").count() > 1:
            continue
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for r in got[doc_id]:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sorted((r["start"], r["length"]) for r in got[doc_id]) == [(a, min(2048, len(ids) - a)) for a in range(0, len(ids), 2048)]
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048


# ---- 6


def test_rules_and_trees(spark):
    urls = [f"http://{h}/{p}" for h in ("a.org", "x.example.org", "b.com", "c.net") for p in ("en/1", "en/2", "es/5", "de/4", "fr/9")] * 20 + [None, "no url", "HTTP://EXAMPLE.ORG/es/1?q#f", "http://forexample.org/es/", "http://a.org"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    out = {r["page_id"]: r for r in urlfilter.verdicts(df, queries.RULES).collect()}
    n = len(urls)
    assert (out[n - 5]["host"], out[n - 4]["path"]) == ("", "") and out[n - 5]["rule"] is None
    assert (out[n - 3]["host"], out[n - 3]["path"], out[n - 3]["rule"], out[n - 3]["verdict"]) == ("example.org", "/es/1", "example.org/es/", "block")
    assert out[n - 2]["rule"] == "org/" and out[n - 1]["rule"] is None
    by = {urls[k]: r["verdict"] for k, r in out.items()}
    assert (by["http://x.example.org/en/1"], by["http://x.example.org/en/2"], by["http://b.com/de/4"], by["http://b.com/fr/9"]) == ("block", "allow", "block", "allow")
    assert all(0 < r["block_score"] < 1 for r in out.values())


def test_trees_learn_lexical_rules():
    rng = np.random.default_rng(2)
    names = [f"http://h{i % 9}.net/" + "".join(rng.choice(list("abcdefgh" if i % 2 else "0123456789"), 12)) for i in range(600)]
    blocked = np.array([float(i % 2 == 0) for i in range(600)])
    none = np.zeros((600, 4), np.int64)
    sums = np.zeros((urlfilter.FOLDS, 2, urlfilter.BUCKETS))
    sums[:, :, 0] = blocked[:400].sum(), 400
    model = urlfilter.Model(names[:400], blocked[:400], none[:400], none[:400, 0], sums)
    assert ((model.predict(pa.array(names[400:]), none[400:]) > 0.5) == (blocked[400:] > 0)).mean() > 0.98
    assert (urlfilter.Model([], np.zeros(0), none[:0], none[:0, 0], 0 * sums).predict(pa.array(["http://a/b", None]), none[:2]) < 0.5).all()


def test_verdicts_without_a_rule(spark):
    """Where no rule fits, hosts and paths that look like blocked ones are blocked; statistics are of all labelled URLs."""
    urls = [f"http://a.com/{d}/{i}" for d in ("de", "fr") for i in range(300)] + [f"http://b.net/{d}/{i}" for d in ("de", "fr") for i in range(50)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    out = {urls[r["page_id"]]: r for r in urlfilter.verdicts(df, queries.RULES).collect()}
    assert all(r["rule"] is None and r["verdict"] == ("block" if "/de/" in u else "allow") == ("block" if r["block_score"] >= 0.5 else "allow") for u, r in out.items() if "b.net" in u)


def test_suffixes(spark):
    """Buckets follow the host's last labels, the first of several segments, and the extension."""
    same = [("x.İstanbul.example.org", "/a/b.html"), ("y.q.example.org", "/a//c/d.x.html")]
    df = spark.createDataFrame(same + [("example.com", "/a"), ("", "")], "host string, path string")
    got = [r[0] for r in df.select(urlfilter.F.array(*urlfilter.suffixes(urlfilter.F.col("host"), urlfilter.F.col("path")))).collect()]
    assert got[0] == got[1] and all(x != y for x, y in zip(got[0], got[2])) and got[2][2] == got[3][2]


# ---- 7


def brute_components(rows, words, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall(lower(text))
        sets[i] = set(zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, percent):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], words, percent)
    got = neardup.components(docs, words, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_a_chain(spark):
    """Neighbours of a chain are alike, its ends are not; a large group of edited copies stays exact."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    chain = [(i, " ".join(base[i * 2 : i * 2 + 80])) for i in range(20)]
    copies = []
    for i in range(60):
        words = [f"v{k}" for k in range(100)]
        for k in rng.sample(range(100), rng.randrange(0, 9)):
            words[k] = f"e{i}_{k}"
        copies.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(chain + copies, "doc_id bigint, text string")
    want = brute_components(chain + copies, 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.components(df, 3, 85).collect()} == want


def test_sketch_estimates():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(200):
        n, shared = int(rng.integers(1, 300)), rng.random()
        both = rng.integers(0, 1 << 63, max(1, int(n * shared)), np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 63, n - len(both), np.uint64)))) for _ in range(2))
        errors.append((neardup.sketch(a) == neardup.sketch(b)).mean() - len(both) / (2 * n - len(both)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


# ---- 8


def test_mix_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "abcd"[i % 4] if i % 11 else None) for i in range(400)] + [(999, None, "empty")], "doc_id bigint, text string, source string")
    rows = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source_size"], r["target"]].append(r)
    for (size, target), own in by.items():
        assert abs(sum(r["taken"] for r in own) - target) <= 0.5 and target <= 2 * size
    cells = Counter(r["cell"] for r in mixing.items(spark.createDataFrame([(i, "x" * 300, "s") for i in range(20_000)], "doc_id bigint, text string, source string")).collect())
    assert max(cells.values()) < 40  # a text without spaces has the least weight, and its keys still spread
    weighted = docs.withColumn("score", mixing.F.when((docs["doc_id"] / 4).cast("int") % 2 == 0, 0.9).otherwise(0.001))
    picked = Counter(r["doc_id"] // 4 % 2 for r in mixing.mix(weighted, "score").collect() if r["taken"] > 0)
    assert picked[0] > 1.1 * picked[1]
    total = sum(r["size"] for r in rows)
    assert math.isclose(sum(t for _, t in by), 1.5 * total)
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))


# ---- 9


def test_language_model(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    tokens = [[*WORD.findall(lower(t)), 0] for _, t in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    counts = Counter(w for t, ok in zip(tokens, train, strict=True) if ok for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(t), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 5)) for t in tokens)
    got = bloomlm.scores(documents).collect()
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["train_tokens"] == n and -1e9 < r["score"] < 0 for r in got)


def exact_scores(texts, train):
    """The model's formula over exact counts of runs, rounded to the filter's levels."""
    level = lambda c: float(bloomlm._LEVEL_COUNTS[bloomlm._levels(np.array([c]))[0]]) if c else 0.0
    tokens = [[None, "", *WORD.findall(lower(t)), 0] for t in texts]  # a start, which is no token, and an end
    learnt = [t for t, ok in zip(tokens, train, strict=True) if ok]
    single = Counter(w for t in learnt for w in t[2:])
    runs = Counter(r for t in learnt for r in zip(t[1:], t[2:])) + Counter(r for t in learnt for r in zip(t[1:], t[2:], t[3:]))
    runs = {r: c for r, c in runs.items() if c >= bloomlm.MIN_COUNT}
    followed, types = Counter(), Counter()
    for r, c in runs.items():
        followed[r[:-1]] += c
        types[r[:-1]] += 1
    n, v = sum(single.values()), len(single)
    out = []
    for t in tokens:
        total = 0
        for i in range(2, len(t)):
            p = (level(single[t[i]]) + 1) / (n + v + 1)
            for r in (t[i - 1 : i + 1], t[i - 2 : i + 1]):
                r = tuple(r)
                if r[0] is not None and r[:-1] in followed:
                    p = min(1, (level(runs.get(r, 0)) + level(types[r[:-1]]) * p) / (level(followed[r[:-1]]) + level(types[r[:-1]])))
            total += math.log10(p)
        out.append(total / (len(t) - 2))
    return np.array(out)


@pytest.mark.parametrize("tokens", [2_000, 4_000_000])
def test_language_model_against_exact_counts(spark, monkeypatch, tokens):
    """One result whether sections are split or not, within 0.02 a token of exact counts on average, and 0.1 for each text above 50 words."""
    monkeypatch.setattr(bloomlm, "HEADS", 1 << 8)
    monkeypatch.setattr(bloomlm, "SECTION_TOKENS", tokens)
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 2000}" for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    texts += texts[:40] + ["same " * 5000, None]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    want = exact_scores(texts, train)
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in bloomlm.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").cache()).collect()}
    off = np.abs(np.array([got[i] for i in range(len(texts))]) - want)
    long = np.array([len((t or "").split()) > 50 for t in texts])  # one false positive shows in a text of a few words
    assert len(got) == len(texts) and off.mean() < 0.02 and off[long].max() < 0.1


def test_language_model_of_the_tables(spark):
    """Exact counts again; and copies stand apart from texts that occur once."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    train = [zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for r in rows]
    want = exact_scores([r["text"] for r in rows], train)
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in bloomlm.scores(docs).collect()}
    mine = np.array([got[r["doc_id"]] for r in rows])
    assert np.abs(mine - want).mean() < 0.02
    times = Counter(r["text"] for r, ok in zip(rows, train, strict=True) if ok)
    long = np.array([len((r["text"] or "").split()) > 20 for r in rows])
    twice, once = (np.array([times[r["text"]] == k for r in rows]) & long & np.array(train) for k in (2, 1))
    assert (mine[twice] > np.quantile(mine[once], 0.9)).mean() > 0.7


@pytest.mark.parametrize("n", [300, 3_000, 30_000])
def test_filter_grows_with_its_items(n):
    """Bits a level, and with them the share of false positives, are the same at every size."""
    rng = np.random.default_rng(n)
    items, counts = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(1, 5000, n)
    raw = bloomlm.block(items, counts).tobytes()
    assert abs(8 * len(raw) / bloomlm._levels(counts).sum() - bloomlm.LEVEL_BITS) < 0.1
    found = bloomlm.Filter(raw)
    read = found.counts(items)
    assert (read >= counts / 1.6).all() and np.median(np.abs(read - counts) / counts) < 0.3
    assert (found.counts(rng.integers(0, 1 << 63, 20_000, np.uint64)) > 0).mean() < 0.012


# ---- 10


@given(st.text(st.sampled_from("\\#h l</turn>:c\n ### a"), max_size=40))
@settings(deadline=None, max_examples=25)
def test_escapes_are_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(chat.F.col("t")).alias("e"), chat.escape(chat.F.col("t"), True).alias("r")).select("e", "r", chat.unescape(chat.F.col("e")).alias("back"), chat.unescape(chat.F.col("r")).alias("role")).first()
    assert row["back"] == row["role"] == text and "### " not in row["e"] and "</turn>" not in row["e"] and ":" not in row["r"]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi ### user: x</turn>\n"), (1, 1, "assistant", "\\l \\\\h"), (2, 0, "a: b", None), (2, 0, "a: b", None), (None, None, None, "t"), (3, 0, "assistant", ""), (3, 1, "assistant", "é\U0001f600")], "conv_id bigint, turn bigint, role string, text string")
    out = {r["conv_id"]: r for r in chat.conversation_digests(turns).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out[1]["turns_sha256"] == sha("user\nhi ### user: x</turn>\n\nassistant\n\\l \\\\h\n") and out[1]["loss_sha256"] == sha("\\l \\\\h")
    assert out[2]["n_turns"] == 2 and out[2]["loss_chars"] == 0 and out[None]["turns_sha256"] == sha("\nt\n")
    assert out[3]["loss_chars"] == 2
    rendered = {r["conv_id"]: r["formatted"] for r in chat.formatted(turns).collect()}
    for r in chat.loss_spans(chat.formatted(turns.where("conv_id = 1"))).collect():
        assert rendered[1][r["start"] : r["start"] + r["length"]] == "\\\\l \\\\\\\\h"


# ---- the pipeline, stage by stage


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    good = corpus_pipeline.quality_filter(spark, docs, DIR).collect()
    model = quality.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    table = docs.toArrow()
    scored = quality.scores(table.column("text").combine_chunks(), model)
    assert sorted(r["doc_id"] for r in good) == sorted(i for i, s in zip(table.column("doc_id").to_pylist(), scored, strict=True) if s >= 0.3)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(good, docs.schema), DIR).collect()
    want = brute_components([(r["doc_id"], r["text"]) for r in good], 5, 80)
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, (_, c) in want.items() if i == c)
    kept = spark.createDataFrame(kept, docs.schema)
    mixed = corpus_pipeline.source_mix(spark, kept, DIR).collect()
    taken = {r["doc_id"]: r for r in mixing.mix(kept).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({i: n for i, r in taken.items() if r["size"] and (n := math.floor(r["taken"] / r["size"] + 0.5))})
    packed = corpus_pipeline.packed(spark, spark.createDataFrame(mixed, docs.schema), DIR).collect()
    assert sum(r["length"] for r in packed) == sum(len(packing.encoder(RANKS)(r["text"])) + 1 for r in mixed)
    whole = corpus_pipeline.run(spark, DIR).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in whole) == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed)


def test_batches_are_bounded_by_bytes(spark):
    """Batches end by bytes where the session sets no bound, a long row is one batch, and no row is lost."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    spark.conf.unset(common._BATCH)
    rows = spark.range(4_000).selectExpr("repeat('x', if(id = 1700, 9000000, 2500)) text").coalesce(1)
    found = common.map_arrow(rows, sizes, "n bigint, size bigint").collect()
    assert sum(r["n"] for r in found) == 4_000
    assert all(r["size"] < common.BATCH_BYTES + 9_100_000 for r in found) and len(found) > 3
    assert sorted(r["size"] for r in found)[-2] < 2 * common.BATCH_BYTES
    spark.conf.set(common._BATCH, str(1 << 20))
    assert len(common.map_arrow(rows, sizes, "n bigint, size bigint").collect()) > len(found)
    spark.conf.unset(common._BATCH)
