"""Each operator against plain Python, on small tables with the odd cases."""

import hashlib
import json
import random
import struct
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import bpe, chat, decontaminate, html_extract, langid, license_scan, media, quality, simhash, warc

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, hits int, predicted string, pairs int, digest string, trusted_key long, fence double, fp long, key string, s int, `by_lang` int, scored int"


def docs(spark, texts, ids=None, langs=None):
    ids = ids or range(len(texts))
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), "clash", 1, "clash", 1, "d", 1, 1.0, 1, "k", 1, 1, 1) for i, t, g in zip(ids, texts, langs, strict=True)], DOCS)


ODD = [None, "", "   ", "\n\t", "one", "### $$$", "a b", "é É ſ K", "x" * 30_000, "word " * 20_000]


# BPE


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


SAMPLES = ["Hello <|endoftext|> x", "a  <|endoftext|>", " \n\n x  y z éé 123's 'S don't DON'T", "   x", "x\x1cy \x85 z", "<|endoftext|><|endoftext|>", "日本語 текст", "\U0001f600\U0001f468‍\U0001f469", "\x00\x01", "<|endoftext|", "ⅷ²½", "áb", "\r\n\r\n  \t x"]


@pytest.mark.parametrize("text", SAMPLES + [t or "" for t in ODD])
def test_bpe_is_the_librarys(text):
    own, t = bpe.load(), tokenizer()
    ids = np.frombuffer(own.packed(text), "<u4").tolist()
    assert ids == t.encode(text, add_special_tokens=False).ids
    assert own.decode(own.packed(text)) == t.decode(ids, skip_special_tokens=False)


def test_bpe_classes_of_all_characters():
    own, t = bpe.load(), tokenizer()
    for start in range(0, 0x30000, 512):
        text = "".join(f"a{chr(c)} {chr(c)}{chr(c)}1 " for c in range(start, start + 512) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(own.packed(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, hex(start)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_bpe_any_text(text):
    own = _LOADED.setdefault("bpe", bpe.load())
    t = _LOADED.setdefault("t", tokenizer())
    assert np.frombuffer(own.packed(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


_LOADED: dict = {}


def test_bpe_scan_and_heap_agree():
    own, rng = bpe.load(), random.Random(0)
    for _ in range(200):
        word = bytes(rng.choice(b"aeitnrs \xc3\xa9") for _ in range(rng.randint(1, 200)))
        assert own._scanned(word) == own._heaped(word)


def test_bpe_columns(spark):
    df = docs(spark, ODD + ["<|endoftext|> tail"])
    rows = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    t = tokenizer()
    for i, text in enumerate([*ODD, "<|endoftext|> tail"]):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = df.withColumn("ids", bpe.encode_column(df))
    assert [r.back for r in coded.withColumn("back", bpe.decode_column(coded, "ids")).orderBy("doc_id").collect()] == [t or "" for t in [*ODD, "<|endoftext|> tail"]]
    assert bpe.round_trip(df.limit(0)).count() == 0


# SimHash


def brute_fingerprint(text):
    words = bytes(text or "", "utf-8").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in rows.items()} == brute_components(fps)


def test_simhash_chunks_do_not_matter(monkeypatch):
    text = " ".join(f"w{i % 97} v{i % 31}" for i in range(3000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text.decode())


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    fps, v = {}, 0
    for i in range(120):  # a long chain of steps of two bits, a star, and singles
        fps[i] = v
        v ^= 3 << (2 * (i % 31)) if i < 60 else rng.getrandbits(64)
    center = rng.getrandbits(64)
    fps |= {200 + b: center ^ 1 << b for b in range(40)} | {300: None} | {301: center}
    fps = {i: f for i, f in fps.items() if f is not None}
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in fps.items()], "key long, fp long")
    got = {r.key: r.component_id for r in simhash.with_components(df).collect()}
    assert got == brute_components(fps)


def test_one_fingerprint_of_many_rows_is_split(spark):
    """A fingerprint that most rows share is dealt to several tasks by Spark's skew handling."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(20_000).select(F.col("id").alias("key"), F.when(F.col("id") % 10 < 7, F.lit(5)).otherwise(F.col("id") * 2654435761).cast("long").alias("fp"))
        out = simhash.with_components(rows)
        assert out.filter("fp = 5").select("component_id").distinct().collect()[0].component_id == 0
        assert len(out.collect()) == 20_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_keep_one_of_each(spark):
    a, b = "the quick brown fox jumps over the lazy dog again and again", "something else entirely with other words in it"
    df = docs(spark, [a, a, b, a, None, None, b], ids=[5, 3, 9, 3, 7, None, 2])
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 3), (False, 7), (True, None)]


# Decontamination


def brute_hits(text, items):
    words = [w.decode() for w in (text or "").encode().translate(decontaminate_table()).split()]
    hit, found = set(), set()
    for item, value in items:
        iw = [w.decode() for w in (value or "").encode().translate(decontaminate_table()).split()]
        n = min(13, len(iw))
        for s in range(max(1, len(iw) - 12) if iw else 0):
            window = iw[s : s + n]
            for p in range(len(words) - n + 1):
                if words[p : p + n] == window:
                    hit.update(range(p, p + n))
                    found.add(item)
    return len(words), len(hit), sorted(map(str, found))


def decontaminate_table():
    return bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


def contaminated_case():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.5 else f"w{rng.randint(0, 40)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 12, 13, 14, 40])))) for i in range(30)] + [(30, ""), (31, None), (None, "a b c"), (3, "again the same id"), (99, "rare")]
    texts = []
    for i in range(60):
        parts = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            value = items[rng.randrange(30)][1].split()
            at = rng.randint(0, len(parts))
            parts[at:at] = value[rng.randint(0, 1) : len(value) - rng.randint(0, 1)]
        texts.append(rng.choice([" ", "-", "\n"]).join(parts).upper() if i % 5 == 0 else " ".join(parts))
    return items, texts + ODD + ["rare"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, block_bytes):
    items, texts = contaminated_case()
    texts += ["word " * 3000 + items[5][1] + " tail" * 3000, texts[1], texts[1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.contamination(docs(spark, texts), bench, block_bytes=block_bytes).collect()}
    usable = [x for x in items if x[0] is not None and x[1] is not None]
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, usable)
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found)), (i, t)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_decontamination_takes_any_item_ids(spark):
    bench = spark.createDataFrame([("b-1", "one two three"), ("a-1", "two")], "item_id string, text string")
    r = decontaminate.contamination(docs(spark, ["zero one two three"]), bench).first()
    assert (r.n_hit, r.n_items) == (3, 2) and r.items_sha256 == hashlib.sha256(b"a-1,b-1").hexdigest()


def test_decontamination_filter_and_empty(spark):
    items, texts = contaminated_case()
    bench, df = spark.createDataFrame(items, "item_id long, text string"), docs(spark, texts)
    flagged = {r.doc_id for r in decontaminate.contamination(df, bench).filter("contaminated").collect()}
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - flagged
    assert decontaminate.contamination(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


# Language


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in held) < 0.02 * len(held)


def test_language_odd_texts(spark):
    train = [f"the and of that {i}" for i in range(40)] + [f"der die und das {i}" for i in range(40)]
    odd = docs(spark, [*ODD, "the of and", "12 !!"], ids=range(1000, 1000 + len(ODD) + 2), langs=[None] * (len(ODD) + 2))
    df = docs(spark, train, langs=["en"] * 40 + ["de"] * 40).unionByName(odd)
    rows = {r.doc_id: r for r in langid.identify(df).collect()}
    for i, t in enumerate([*ODD, "the of and", "12 !!"]):
        r = rows[1000 + i]
        has_letter = any(c.isalpha() for c in t or "")
        assert (r.lang_pred == "und") == (not has_letter)
    assert rows[1000 + len(ODD)].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify(odd).collect()} == {"und"}  # nothing to learn from
    assert langid.identify(df.limit(0)).count() == 0
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.filter("text IS NULL").count() == 0


def test_language_forward_pass_in_plain_python():
    m = langid.train([(f"the and of {i}".encode(), "en") for i in range(30)] + [(f"der die und {i}".encode(), "de") for i in range(30)])
    text = " the und of "
    total, n = [0.0] * (len(m.languages) + 1), 0
    for size in langid.GRAMS:
        for i in range(len(text) - size + 1):
            h = size * 0x9E3779B1 % (1 << 32)
            for c in text[i : i + size]:
                h = ((h ^ ord(c)) * 0x01000193) % (1 << 32)
                h ^= h >> 15
            bucket = (h * 0x85EBCA6B) % (1 << 32) >> 16
            total, n = [t + v for t, v in zip(total, m.scores[bucket].tolist(), strict=True)], n + 1
    z = [(t / n + b) / m.temperature for t, b in zip(total, m.bias.tolist(), strict=False)]
    p = [np.exp(v) / sum(np.exp(u) for u in z) for v in z]
    lang, score, passed = m.predict(b"The 1 UND, of")
    assert lang == m.languages[int(np.argmax(p))] and score == pytest.approx(max(p), rel=1e-9)
    assert passed == (score >= m.bar and total[-1] / n >= m.known_bar)


def test_language_learns_every_language_of_an_uneven_table(spark):
    texts = [f"the and of to in {i}" for i in range(600)] + [f"der die und das {i}" for i in range(9)]
    df = docs(spark, texts, langs=["en"] * 600 + ["de"] * 9)
    taken = langid.sample(df, "doc_id", "text", "lang", 40).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in taken}["en"] == 20 and {r.lang for r in taken} == {"en", "de"}
    assert sorted(langid.sample(df, "doc_id", "text", "lang", 40).collect()) == sorted(langid.sample(df.repartition(7), "doc_id", "text", "lang", 40).collect())


def test_language_chunks_do_not_matter(monkeypatch):
    m = langid.train([(f"the and of {i}".encode(), "en") for i in range(30)] + [(f"der die und {i}".encode(), "de") for i in range(30)])
    codes = langid.code_points(("the und of die " * 500).encode())
    whole = m.measure(codes)
    monkeypatch.setattr(langid, "CHUNK", 64)
    parts = m.measure(codes)
    assert np.allclose(whole[0], parts[0]) and whole[1] == pytest.approx(parts[1])


# Chat


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "<|turn|>x<|says|>y<|end|>", "\\<\\|", None, "", "<<SYS>>é\n"]
    rows = [(c, t, r, tricky[(c + t) % 6]) for c, n in ((1, 5), (2, 1), (3, 4)) for t, r in zip(range(n), ["system", "user", "assistant", "user", "assistant"], strict=False)]
    rows += [(4, 0, None, "no role"), (5, 1, "assistant", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "assistant", "null id"), (6, None, "user", "null turn")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    ex = chat.examples(df)
    got = {r.conv_id: r for r in chat.digests(ex).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t, r is not None, r or "", x is not None, x or "") for c, t, r, x in rows if c == conv), key=lambda v: (v[0], v[1] or 0, v[2:]))
        turns = [(v[3], v[5]) for v in turns]
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for e in ex.collect():
        back = chat.turns_of(e.formatted)
        if e.loss_start is not None:
            assert back[-1][0] == "assistant" and chat.unescape(e.formatted[e.loss_start : e.loss_end]) == back[-1][1]
    assert chat.examples(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<", "|", ">", "s>", "/", "INST]", "[", "SYS>>", "<|end|>", "x", "\n"]), max_size=9).map("".join))
def test_chat_escape(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not any(mark in e for mark in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))
    assert chat.turns_of(chat.marked(text, text) * 2) == [(text, text)] * 2


def test_chat_checks_the_order_and_takes_any_ids(spark):
    rows = spark.createDataFrame([("c", i, "assistant" if i % 2 else "user", "x" * 20_000 if i == 3 else str(i)) for i in range(6)], "conv_id string, turn long, role string, text string")
    made = chat.examples(rows)
    told = chat.digests(made).collect()
    assert [(r.conv_id, r.n_turns, r.n_examples) for r in told] == [("c", 6, 3)]
    with pytest.raises(Exception, match="out of order"):
        chat.digests(made.coalesce(1).orderBy(F.desc("example")).coalesce(1)).collect()


# WARC


def test_warc_archive(spark, tmp_path):
    rows = [(1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (None, "u", "b"), (None, None, None), (5, "x\r\ny", ""), (7, "z", "é\r\n\r\n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "archive")
    warc.write(df, path)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(spark, path).collect())
    assert got == Counter({(1, 1, "revisit", 2): 1, (2, 1, "response", None): 2, (None, 1, "response", None): 1, (None, 0, "revisit", 5): 1, (5, 0, "response", None): 1, (7, 6, "response", None): 1})
    payloads = spark.read.parquet(f"{path}/payloads")
    assert payloads.count() == 4
    told = []
    for r in warc.records(spark, path).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        block = rest[: int(fields[b"Content-Length"])]
        assert head.startswith(b"WARC/1.1\r\n") and rest[len(block) :] == b"\r\n\r\n"
        http, _, body = block.partition(b"\r\n\r\n")
        size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
        assert len(body) == (size if fields[b"WARC-Type"] == b"response" else 0)
        assert (b"WARC-Refers-To" in fields) == (fields[b"WARC-Type"] == b"revisit")
        told.append((fields[b"WARC-Record-ID"], r.page_id, fields[b"WARC-Target-URI"]))
    assert len({i for i, *_ in told}) == len(set(told)) == len(rows) - 1  # a repeated row is the same record
    assert b"x%0D%0Ay" in {u for *_, u in told}
    least = warc.archive(df, min_bytes=1).filter("payload_bytes = 0").collect()
    assert {r.record_type for r in least} == {"response"}
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_finds_damage(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit("!"))).collect()
    spark.createDataFrame(bad).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, path).collect()
    other = str(tmp_path / "other")
    warc.write(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string"), other)
    bad = spark.read.parquet(f"{other}/headers").withColumn("header", F.replace("header", F.lit("Content-Length: 1\r"), F.lit("Content-Length: 2\r"))).collect()
    spark.createDataFrame(bad, "page_id long, sha256 string, header string").write.mode("overwrite").parquet(f"{other}/headers")
    with pytest.raises(Exception, match="header and payload differ"):
        warc.read(spark, other).collect()


# HTML

PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header class="site"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<div class="wrap"><div class="content-area"><div class="post-body{n}"><h2>Title &amp; more</h2><p>First para with <a href="x>y">link</a> and text that is long enough to count. </p><p>Second&nbsp;para<br>goes   on and on {n}.</p>
<form><input><p>Sign up</p></form><div class="ad-slot">Buy!</div><ul><li>One item</li><li>Two item</ul><script>var p = "<p>no</p>";</script><!-- <p>no</p> --></div>
<section id="comments"><div class="comment"><p>A reader comment, very long, longer than the article, so that it would be tempting to take it in its place, on and on and on and on.</p></div></section></div><aside>Side</aside></div><footer>foot</footer></body></html>"""


def test_html_extracts_the_article(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(n=i)) for i in range(4)]
    rows += [(10, None, None), (11, "x", ""), (12, "https://h.example/t", "plain text\n only"), (13, "https://g.example", "<p>a<p>b</p>&lt;c&gt;"), (14, "https://asp.example", "<body><form><p>All the page is a form here.</p></form></body>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    for i in range(4):
        assert got[i].text == f"Title & more\nFirst para with link and text that is long enough to count.\nSecond para goes on and on {i}.\nOne item\nTwo item"
    assert [got[i].text for i in range(10, 15)] == ["", "", "plain text only", "a\nb\n<c>", "All the page is a form here."]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(df.limit(0)).count() == 0


LINE = "Some long running text of the story here, with words."
BODY = f"<p>{LINE} </p><p>{LINE}</p>"


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (f"<body><header><h1>Site</h1></header><article><header class='entry-header'><h1>Title</h1><span>By</span></header><div class='entry-content'>{BODY}</div><div class='comments-wrapper'><p>{LINE * 5}</p></div></article><div class='ad-container'>{LINE * 9}</div></body>", f"Title\n{LINE}\n{LINE}"),
        (f"<body><div class='page-wrapper with-sidebar'><div><h1>Title</h1><div class='text'>{BODY}</div></div><div class='sidebar'>{LINE * 9}</div></div></body>", f"Title\n{LINE}\n{LINE}"),
        (f"<body><div class='post'><div class='post-header'><h2>Title</h2><span>By</span></div><section><h3>Sub</h3><p>{LINE}</p></section><section><p>{LINE}</p></section></div><ol class='commentlist'><li>{LINE * 4}</li></ol></body>", f"Title\nSub\n{LINE}\n{LINE}"),
        (f"<body><main><h1>T</h1><p>{LINE}</p><aside>x</aside></main><section aria-label='Comments'><p>{LINE * 3}</p></section></body>", f"T\n{LINE}"),
        (f"<body><div role='navigation'>a</div><h1>T</h1>{BODY}<div hidden>no</div><div style='display: none'>no</div><footer>f</footer></body>", f"T\n{LINE}\n{LINE}"),
        (f"<body><article><p title='a > b'>{LINE}</p><pre>x\n  y</pre><table><tr><td>1</td><td>2</td></tr></table><p>&lt;b&gt; &eacute;&#8364;</p></article>", f"{LINE}\nx y\n1 2\n<b> é€"),
    ],
)
def test_html_layouts(html, expected):
    found = html_extract.votes(html)
    assert html_extract.main_text(html, found[0][0]) == expected


def test_html_host_vote_beats_a_page(spark):
    good = "<body><div class='main7'><p>{}</p></div><div class='x'><p>short</p></div></body>"
    odd = "<body><div class='main8'><p>The story of this page in a few words.</p></div><div class='x'><p>{}</p></div></body>".format("promotion text that is longer than the story itself here")
    rows = [(i, "http://h.example/", good.format("a long story " * 9)) for i in range(5)] + [(9, "http://h.example/", odd)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "The story of this page in a few words."


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a'>", "</div>", "<b", ">", "<", "&amp;", "text ", "<!--", "-->", "<script>", "</script>", "\"", "<li>", "</html>", "<table><tr><td>"]), max_size=30).map("".join))
def test_html_never_fails(html):
    text = html_extract.main_text(html, None)
    assert all(line == " ".join(line.split()) and line for line in text.split("\n")) or text == ""


class Plain(HTMLParser):
    """Text of the article element by Python's own parser: an independent reading of the test pages."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.held = 0, [], []
        self.feed(html)
        self.cut()

    def cut(self):
        self.blocks += [t] if (t := " ".join("".join(self.held).split())) else []
        self.held = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.cut() if tag in ("p", "h1", "h2", "article", "div", "footer") else self.held.append(" " if tag == "br" else "")

    def handle_endtag(self, tag):
        self.cut() if tag in ("p", "h1", "h2", "article", "div", "footer") else None
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.held.append(data)


def test_html_equals_an_independent_parser(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages.unionByName(pages)).collect()}
    for r in pages.collect():
        assert got[r.page_id] == "\n".join(Plain(r.html or "").blocks), r.url


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<article><h2 id='social-security-reform'>Social security reform</h2><p id='login-flow'>To log in you type.</p><div class='content-banner'><p>A banner in content.</p></div><p>More running text.</p></article>", "Social security reform\nTo log in you type.\nA banner in content.\nMore running text."),
        ("<body><div class=wrap><div class='part-a'><p>First part of the article.</p></div><div class='part-b'><p>Second part of the article.</p></div></div><div class='cookie-banner'>We use cookies</div><div id=left-sidebar><a href=1>l</a></div></body>", "First part of the article.\nSecond part of the article."),
        ("<form id=f><div class=content><p>A page within a form &amp; a < b.</p></div><div class='comments'><p>I like it</p></div></form>", "A page within a form & a < b."),
        ("<article><p>Text.</p><section id='comments'><article class='comment'><p>nice</p></article></section></article>", "Text."),
        ("<div a='", ""),
    ],
)
def test_html_judges_containers_not_text(html, expected):
    assert html_extract.main_text(html, None) == expected


@pytest.mark.parametrize("piece", ["<div a='<b ", "<script ", "<div>", "<b><p>", "<!--", '<p a="', "<b><div></b>", "<div class=x>t"])
def test_html_takes_time_in_proportion(piece):
    def seconds(n):
        began = time.process_time()
        html_extract.main_text(piece * n, None)
        return time.process_time() - began

    seconds(100)
    assert seconds(16_000) < 0.5 + 8 * min(seconds(4_000), seconds(4_000))


# Quality


def test_quality_rejects_junk_and_keeps_clean(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judge(df, labels).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.rejected for r in good) <= 0.01 * len(good)
    assert sum(r.rejected for r in bad) >= 0.6 * len(bad)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(df, labels).filter("NOT rejected").collect()}


def test_quality_tells_rare_characters_apart(spark):
    rng = np.random.default_rng(1)
    latin = "".join(map(chr, range(0x61, 0x7B))) + "".join(map(chr, range(0xC0, 0x100)))
    cyrillic = ["добро", "слово", "молоко", "город", "дорога"]
    texts = [" ".join("".join(rng.choice(list(latin), 5)) for _ in range(1500)) for _ in range(20)]
    texts += [" ".join(rng.choice(cyrillic, 30)) for _ in range(12)]
    letters = list("".join(cyrillic))
    junk = " ".join("".join(rng.permutation(letters)[: len(w)]) for w in texts[-1].split(" "))
    df = docs(spark, [*texts, junk])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts) - 1)], "doc_id long, quality int, toxic int")
    assert not set(quality.alphabet(df, "text")) & set(letters)
    rows = {r.doc_id: r.perplexity for r in quality.judge(df, labels).collect()}
    assert rows[len(texts)] > 2 * rows[len(texts) - 1]


def test_quality_surprises_are_kneser_ney(spark):
    texts = ["abc 12, abd 12; добро abc", "добро 13, abc", "xyz ab 1"]
    df = docs(spark, texts)
    counts = quality.gathered(df, "text", "ab c", True).groupBy("context", "last").agg(F.sum("n").alias("n"))
    plain = Counter(tuple(map(ord, t[i : i + 4])) for t in ("   " + t for t in texts) for i in range(len(t) - 3))
    shift = lambda cs: sum(c << 21 * i for i, c in enumerate(reversed(cs)))
    assert {(r.context, r["last"]): r.n for r in counts.collect()} == {(shift(g[:3]), g[3]): n for g, n in plain.items()}
    asked = spark.createDataFrame([(shift(g[:3]), g[3]) for g in [*plain, tuple(map(ord, "abcй"))]], "context long, last int")
    got = {(r.context, r["last"]): r.surprise for r in quality.surprises(asked, quality.levels(counts, 21)).collect()}
    tables, level = [], dict(plain)
    for _ in range(4):
        tables.insert(0, level)
        level = dict(Counter(g[1:] for g in level))

    def p(g):
        if not g:
            return 1 / (len(tables[0]) + 1)
        here = tables[len(g) - 1]
        n = Counter(here.values())
        d = quality.discounts(n[1], n[2], n[3], n[4])
        own = {k: c for k, c in here.items() if k[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        c = own.get(g, 0)
        return ((c - d[min(c, 3) - 1]) if c else 0) / sum(own.values()) + sum(d[min(v, 3) - 1] for v in own.values()) / sum(own.values()) * p(g[1:])

    for g in [*plain, tuple(map(ord, "abcй"))]:
        assert got[shift(g[:3]), g[3]] == pytest.approx(-np.log(p(g)), rel=1e-5)


def test_quality_fences_are_quantiles(spark):
    rng = np.random.default_rng(0)
    rows = [("a" if i % 3 else "", float(v) * 10, 10) for i, v in enumerate(rng.normal(2, 0.2, 300))] + [("a", 5.0, 0)]
    got = {r.lang: r for r in quality.fences(spark.createDataFrame(rows, "lang string, nll double, n long")).collect()}
    for lang, r in got.items():
        v = np.sort([np.floor(x[1] / x[2] * quality.BINS) for x in rows if x[0] == lang and x[2]])
        at = lambda q, v=v: (v[int(np.ceil(q * len(v))) - 1] + 0.5) / quality.BINS
        assert r.median == pytest.approx(at(0.5))
        assert r.fence == pytest.approx(max(at(0.75) + quality.REACH * (at(0.75) - at(0.25)), at(0.5) + quality.LEAST_REACH))


def test_quality_fences_follow_labelled_documents(spark):
    rng = np.random.default_rng(4)
    spread = [(i, "a", float(v) * 1000, 1000) for i, v in enumerate(rng.uniform(1.5, 1.9, 300))]
    odd = [(300 + i, "a", 2100.0 + i, 1000) for i in range(20)]
    few = [(400 + i, "b", 1500.0 + i, 1000) for i in range(50)]
    scores = spark.createDataFrame([*spread, *odd, *few], "key long, lang string, nll double, n long")
    labels = spark.createDataFrame([(i, int(i < 300), i % 2) for i, *_ in [*spread, *odd]], "doc_id long, quality int, toxic int")
    old, new = ({r.lang: r for r in f.collect()} for f in (quality.fences(scores), quality.labelled_fences(scores, labels, "doc_id")))
    rate = lambda x: (x[2] + quality.PRIOR * old["a"].median) / (x[3] + quality.PRIOR)
    assert max(map(rate, odd)) < old["a"].fence
    assert max(map(rate, spread)) <= new["a"].fence < min(map(rate, odd)) and new["b"] == old["b"]


def judged_by_hand(texts, langs, good):
    """Rows of judge by document: Kneser-Ney probabilities of every 4-gram, then quantiles by language."""
    grams = [[tuple(("   " + t)[i : i + 4]) for i in range(len(t))] for t in texts]
    tables = [dict(Counter(g for i in good for g in grams[i]))]
    for _ in range(3):
        tables.insert(0, dict(Counter(g[1:] for g in tables[0])))
    vocabulary = len(tables[0])
    amounts = [quality.discounts(*(Counter(t.values())[n] for n in (1, 2, 3, 4))) for t in tables]
    after = [{} for _ in tables]
    for t, own in zip(tables, after, strict=True):
        for g, c in t.items():
            own.setdefault(g[:-1], []).append(c)

    def p(g):
        if not g:
            return 1 / (vocabulary + 1)
        d, others = amounts[len(g) - 1], after[len(g) - 1].get(g[:-1])
        if not others:
            return p(g[1:])
        c = tables[len(g) - 1].get(g, 0)
        return ((c - d[min(c, 3) - 1]) if c else 0) / sum(others) + sum(d[min(v, 3) - 1] for v in others) / sum(others) * p(g[1:])

    nll = [sum(-np.log(p(g)) for g in own) for own in grams]
    fences = {}
    for lang in set(langs):
        bins = sorted(int(np.floor(nll[i] / len(texts[i]) * quality.BINS)) for i, g in enumerate(langs) if g == lang and texts[i])
        q1, median, q3 = ((bins[int(np.ceil(q * len(bins))) - 1] + 0.5) / quality.BINS for q in (0.25, 0.5, 0.75))
        rate = lambda i, m=median: (nll[i] + quality.PRIOR * m) / (len(texts[i]) + quality.PRIOR)
        fence = max(q3 + quality.REACH * (q3 - q1), median + quality.LEAST_REACH)
        own = sorted(int(np.floor(rate(i) * quality.BINS)) for i in good if langs[i] == lang and texts[i])
        if len(own) >= quality.LEAST_GOOD:
            fence = min(fence, (own[int(np.ceil(quality.GOOD_SHARE * len(own))) - 1] + 1) / quality.BINS)
        fences[lang] = fence, rate
    return {i: (np.exp(nll[i] / len(t)), fences[langs[i]][1](i), fences[langs[i]][0]) for i, t in enumerate(texts) if t}


def test_quality_judges_every_document_as_by_hand(spark):
    rng = random.Random(8)
    words = {"en": ["the", "house", "of", "green", "word", "stone"], "de": ["über", "haus", "grün", "wort", "stein", "ß"]}
    langs = [rng.choice(["en", "en", "de"]) for _ in range(260)]
    texts = [" ".join(rng.choice(words[g]) for _ in range(rng.randint(3, 60))) for g in langs]
    for i in range(0, 260, 9):
        texts[i] = "".join(rng.choice("xqzjkw0#é¤") for _ in range(rng.randint(1, 300)))
    texts[5], texts[6] = "", texts[7]
    good = [i for i in range(260) if i % 9]
    labels = spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(260)], "doc_id long, quality int, toxic int")
    want = judged_by_hand(texts, langs, good)
    rejected = 0
    for r in quality.judge(docs(spark, texts, langs=langs), labels).collect():
        if not texts[r.doc_id]:
            assert r.perplexity is None and not r.rejected
            continue
        perplexity, rate, fence = want[r.doc_id]
        assert (r.perplexity, r.rate, r.fence) == pytest.approx((perplexity, rate, fence), rel=1e-5)
        assert r.rejected == (rate > fence)
        rejected += r.rejected
    assert rejected > 10


def test_quality_odd_tables(spark):
    df = docs(spark, ODD, langs=[None, "en"] * 5)
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (6, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    assert len(rows) == len(ODD) and not rows[0].rejected and rows[0].perplexity is None
    assert quality.judge(df, labels.limit(0)).count() == len(ODD)
    assert quality.judge(df.limit(0), labels).count() == 0


# Licenses


def brute_license(text, known):
    import re

    words = [w for w in re.split(license_scan.GAP, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    base, labels, score = [], set(), 0.0
    for t, step in zip(known, license_scan.steps(known), strict=True):
        m = len(t.words)
        if t.phrase:
            for i in range(len(words) - m + 1):
                if words[i : i + m] == t.words:
                    base.append((i, t.label))
        else:
            for b in range(0, max(1, len(words)), step):
                share = len({*words[b : b + 2 * step]} & {*t.tokens}) / len(t.tokens)
                if share * len(t.tokens) >= t.needed:
                    labels.add(t.label)
                    score = max(score, share)
    labels |= {x for _, x in base}
    starts = [i for i, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else score


def test_license_against_brute_force(spark):
    rng, known = random.Random(5), license_scan.templates()
    texts = list(ODD[:8]) + ["word " * 3000 + "Under the MIT License", "cc by nc cc by nc CC-BY-NC", "mit " * 500]
    for i in range(80):
        filler = [rng.choice(["the", "of", "license", "software", "terms", "x1", "é", "permission"]) for _ in range(rng.randint(0, 120))]
        t = rng.choice(known)
        passage = [w for w in t.words if rng.random() > 0.1]
        at = rng.randint(0, len(filler))
        texts.append(rng.choice([" ", ", ", "\n"]).join(filler[:at] + passage + filler[at:]).title())
    rows = {r.doc_id: r for r in license_scan.scan(docs(spark, texts + [texts[-1]], ids=[*range(len(texts)), 5000])).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        expected = brute_license(t, known)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == expected[:6], (i, t)
        assert r.score == pytest.approx(expected[6])
    assert rows[5000][1:] == rows[len(texts) - 1][1:]
    assert license_scan.scan(docs(spark, ["a"]).limit(0)).count() == 0


def test_license_lower_cases_ascii_alone(spark):
    r = license_scan.scan(docs(spark, ["this wor\u212a is licensed under a creative commons license", "x"])).collect()
    assert {x.labels for x in r} == {""} and {x.score for x in r} == {0.0}


def test_license_runs_without_python(spark):
    plan = license_scan.scan(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Media


def test_media_round_trip(spark):
    texts = [*ODD, "RIFF WAVE GIF89a BM %PDF- \x1f", "same", "same"]
    rows = media.media_columns(docs(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.wav(p)).hexdigest() and r.media_bytes == len(p) + 44
    assert rows[-1][1:] == rows[-2][1:]
    assert media.media_columns(docs(spark, ["a"]).limit(0)).count() == 0


def png() -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0;"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4


def test_media_sniffing(spark):
    gz = zlib.compressobj(wbits=31)
    gz = gz.compress(b"hello") + gz.flush()
    damaged = bytearray(png())
    damaged[20] ^= 1
    cases = [(png(), "image/gif", "image/png", True, 0), (GIF, "x", "image/gif", True, 0), (BMP, None, "image/bmp", True, 0), (gz, "x", "application/gzip", True, 0), (bytes(damaged), "image/png", "image/png", False, 0), (b"BM but text", "text/plain", "text/plain", False, 0), (b"junk" + png() + b"tail" + GIF, "text/plain", "text/plain", False, 2), (media.wav(b"\x80" * 576), "x", "audio/wav", True, 0), (b"", "x", "x", False, 0), (None, "x", "x", False, 0)]
    df = spark.createDataFrame([(i, b, d) for i, (b, d, *_) in enumerate(cases)], "id int, data binary, declared string")
    got = {r.id: r.sniffed for r in media.sniff(df, "data", "declared").collect()}
    for i, (_, _, kind, ok, inner) in enumerate(cases):
        assert (got[i].media_type or None, got[i].confirmed, len(got[i].embedded)) == (kind, ok, inner), i
    carved = {r.media_type: bytes(r.content) for r in media.carve(df.filter("id = 6"), "data").collect()}
    assert carved == {"image/png": png(), "image/gif": GIF}


def test_media_pdf_goes_to_its_last_end(spark):
    part = b"1 0 obj\nendobj\nstartxref\n9\n%%EOF\n"
    one = b"%PDF-1.7\n" + part * 3
    inner = b"%PDF-1.4\n" + part
    outer = b"%PDF-1.7\n" + inner + part
    cases = [one, one + b"text %%EOF", one + inner, outer, b"%PDF-1.7 text %%EOF"]
    assert [media._pdf(c, 0) for c in cases] == [len(one) - 1, len(one) - 1, len(one) - 1, len(outer) - 1, 0]
    df = spark.createDataFrame([(1, b"junk" + one)], "id long, data binary")
    assert [bytes(r.content) for r in media.carve(df, "data").collect()] == [one[:-1]]


@pytest.mark.parametrize("mark", [b"%PDF-", b"\xff\xd8\xff\xda\x00\x02", b"%PDF-startxref"])
def test_media_marks_are_searched_once(mark):
    finder = media.automaton()

    def seconds(n):
        began = time.process_time()
        media.sniffed(mark * n, finder)
        return time.process_time() - began

    seconds(100)
    assert seconds(32_000) < 0.5 + 8 * min(seconds(8_000), seconds(8_000))


def test_media_feature_is_told_from_the_bytes(spark):
    df = docs(spark, ["abc", "abc", None, "%PDF-1 startxref %%EOF"])
    rows = {r.doc_id: r for r in media.media_columns(df).collect()}
    for i, text in enumerate([b"abc", b"abc", b"", b"%PDF-1 startxref %%EOF"]):
        p = text + b"\xff" * (576 - len(text))
        inner = "application/pdf@44+22" if text.startswith(b"%PDF") else "none"
        assert rows[i].feature == f"application/octet-stream->audio/wav;n=576;crc={zlib.crc32(p):08x};min={min(p)};max=255;embedded={inner}"


def test_json_of_queries_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names and json.dumps(sorted(names))
