import glob
import hashlib
import math
import struct
import time
import tracemalloc
import uuid
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from tessera.llm import bloom_lm, branch_topk, components, covering_simhash, html_tree, mixing, multi_index, queries, rans, token_count, tree_bpe, zstd_quality
from tessera.llm.common import fold, work_dir

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
#: Nulls, empty and blank, special strings, odd white space, unbroken and long texts, a repeated row; the other columns have names the operators use.
TEXTS = [None, "", " ", "\n\n\n", "a  b", "a \n b", "foo\n\n bar", "x\t\ty", "tail  ", "tail\n\n", "<|endoftext|> a<|endoftext|>", "it's we'll THEY'RE", "é" * 5000, "ab" * 9000, "a b\x1c c　d\xa0 e", "日本語" * 3000, "ΣΑΣ İ ﬁ é " * 50, "the cat sat " * 4000, "the cat sat on the mat", "the cat sat on the mat"]
ROWS = [(None if i == 4 else i, t, float(i), i, "x", i, i) for i, t in enumerate(TEXTS)] + [(19, TEXTS[19], 0.0, 0, "x", 0, 0)]
SCHEMA = "doc_id long, text string, score double, n_tokens int, key string, fp long, part int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def test_token_count(docs, none):
    tok = Tokenizer.from_file(BYTE)
    wanted = [(k, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for k, t, *_ in ROWS]
    found = token_count.count_tokens(docs, BYTE)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert ordered(map(tuple, found.collect())) == ordered(wanted)
    assert token_count.count_tokens(none, BYTE).count() == 0


def test_tree_bpe(docs, none):
    tok = Tokenizer.from_file(WORD)

    def wanted(text):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    found = tree_bpe.round_trip_digests(docs, WORD)
    assert ordered(map(tuple, found.collect())) == ordered((k, *wanted(t)) for k, t, *_ in ROWS)
    assert tree_bpe.round_trip_digests(none, WORD).count() == 0


def test_tree_joins_any_unbroken_text():
    own, tok, rng = tree_bpe.TreeEncoder(WORD, leaf=200, window=8), Tokenizer.from_file(WORD), np.random.default_rng(0)
    for letters in ("abcdeéßthein", "ab", "a1.'s", "thing日́Σ", "🙂🙃a"):
        texts = ["".join(rng.choice(list(letters), n)) for n in (900, 3000)]
        for text, found in zip(texts, own.spans(texts), strict=True):
            wanted = tok.encode(text, add_special_tokens=False)
            assert found["id"].tolist() == wanted.ids and list(zip(found["a"].tolist(), found["b"].tolist(), strict=True)) == wanted.offsets
    assert own.joins > 50 and own.grown > 50


def test_tree_joins_texts_with_white_space():
    tok, rng = Tokenizer.from_file(WORD), np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abé ,.'\n"), n)) for n in (0, 1, 31, 500, 4000)] + [t or "" for t in TEXTS] + ["x" * 300 + " y  z " + "w" * 300, "<|endoftext|>" * 300]
    for leaf, window in ((16, 1), (64, 8), (2048, 256)):
        own = tree_bpe.TreeEncoder(WORD, leaf=leaf, window=window)
        for t, found in zip(texts, own.spans(texts), strict=True):
            assert found["id"].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_tree_is_the_way_of_the_given_documents(monkeypatch):
    """Long documents are encoded as leaves and windows only, and come out as the library has them."""
    texts = [t for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    own, tok, seen = tree_bpe.TreeEncoder(WORD), Tokenizer.from_file(WORD), []
    encode = tree_bpe.TreeEncoder._encode
    monkeypatch.setattr(tree_bpe.TreeEncoder, "_encode", lambda self, parts, at: seen.extend(map(len, parts)) or encode(self, parts, at))
    long = [t for t in texts if len(t) > own.leaf]
    assert len(long) > 1000
    ids, n = own.encode_many(long)
    assert max(seen) <= own.leaf and own.joins >= len(long) and len(seen) >= 2 * own.joins
    wanted = [e.ids for e in tok.encode_batch_fast(long, add_special_tokens=False)]
    assert n.tolist() == list(map(len, wanted)) and ids.tolist() == [i for w in wanted for i in w]


def test_tree_texts(docs, none):
    tok = Tokenizer.from_file(WORD)
    found = ordered(map(tuple, tree_bpe.encode_texts(docs, WORD).collect()))
    ids = [(k, tok.encode(t or "", add_special_tokens=False).ids) for k, t, *_ in ROWS]
    assert found == ordered((k, i, tok.decode(i, skip_special_tokens=False)) for k, i in ids)
    assert tree_bpe.encode_texts(none, WORD).count() == 0


def test_rans_files_are_in_key_order(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), " ".join(rng.choice(["a", "bc", "def"], 400))) for k in rng.permutation(3000)]
    out = f"{work_dir(spark)}/test-{uuid.uuid4().hex}"
    rans.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), BYTE, out)
    names = sorted(glob.glob(f"{out.removeprefix('file://')}/blocks/*/*/*.parquet"))
    keys = [k for n in names for own in pq.ParquetFile(n).read(["keys"])["keys"].to_pylist() for k in own]
    assert len(names) > 1 and keys == list(range(3000))


def test_rans_round_trip(spark, docs, none):
    tok = Tokenizer.from_file(BYTE)
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for k, t, *_ in ROWS}
    out = f"{work_dir(spark)}/test-{uuid.uuid4().hex}"
    rans.write_tokens(docs, BYTE, out)
    found = {(r[0], r.start): tuple(r)[2:] for r in rans.read_tokens(spark, out).collect()}
    wanted, start = {}, 0
    for k, *_ in ordered((r[0],) for r in ROWS):
        wanted[k, start] = (len(ids[k]), zlib.crc32(struct.pack(f"<{len(ids[k])}I", *ids[k])))
        start += len(ids[k])
    assert found == wanted
    out = f"{work_dir(spark)}/test-{uuid.uuid4().hex}"
    rans.write_tokens(none, BYTE, out)
    assert rans.read_tokens(spark, out).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 1000, 5000, 300_000])
def test_rans_coder(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 49_999).astype(np.uint16)
    coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=50_000)))
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    if len(block["places"]) > 1:
        a = rans.EVERY * block["lanes"]
        assert (coder.decode(block, 1, 2) == ids[a : 2 * a]).all()
    if n > 63:
        block["words"] = b"\0\0\0\0" + block["words"][4:]
        with pytest.raises(ValueError):
            coder.decode(block)


@pytest.mark.parametrize("common", [0, 3, 1000])
def test_bloom_lm(spark, docs, none, common):
    learn = fold("doc_id", 5) != 1
    # With so many probes there are no false positives, so that the score has one right value.
    found = bloom_lm.score_texts(docs, learn, max_filter_bytes=400, k=30, common=common)
    c, pairs = Counter(), Counter()
    words = {t: [*(t or "").encode().lower().split(), None] for t in TEXTS}
    for k, t, *_ in ROWS:
        if k is None or zlib.crc32(str(k).encode()) % 5 != 1:
            c.update(words[t])
            pairs.update(zip([0, *words[t]], words[t], strict=False))
    total, kinds = sum(c.values()), len(c)
    rows = found.collect()
    assert len(rows) == len(ROWS)
    texts = {r[0]: r[1] for r in ROWS}

    def level(n):
        return float(bloom_lm.COUNTS.value[bloom_lm.COUNTS.of(np.array([n]))[0]])

    z = Counter()
    for (u, _), n in pairs.items():
        z[u] += level(n)
    for r in rows:
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words[texts[r.doc_id]])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words[texts[r.doc_id]]), sum(c[w] > 0 for w in words[texts[r.doc_id]]), total)
        assert r.base_score == pytest.approx(base)
        if common == 0:
            # The two marks are common always, with exact counts; Z is rounded where it is not.
            often = {None: c[None]}
            q = {w: often.get(w, level(n)) for w, n in c.items()}
            own = words[texts[r.doc_id]]
            p = {w: (q.get(w, 0.0) + 0.5) / (sum(q.values()) + 0.5 * (kinds + 1)) for w in own}

            def zed(u):
                return z[u] if u in (0, None) or not z[u] else float(bloom_lm.SUMS.value[bloom_lm.SUMS.of(np.array([round(z[u])]))[0]])

            score = sum(math.log10((min(level(pairs[u, v]) if pairs[u, v] else 0.0, zed(u)) + 8 * p[v]) / (zed(u) + 8)) for u, v in zip([0, *own], own, strict=False))
            assert r.score == pytest.approx(score)
        assert r.score < 0
    if common == 3:
        whole = {(r.doc_id, r.n_tokens): r.score for r in bloom_lm.score_texts(docs, learn, k=30, common=common).collect()}
        assert all(r.score == pytest.approx(whole[r.doc_id, r.n_tokens]) for r in rows)  # many passes agree with one
    assert bloom_lm.score_texts(none, learn).count() == 0


def test_bloom_lm_scores_little_at_a_time():
    """Arrays of one scored slice, whatever the batch: two tasks of an executor must not hold the tokens of 6 MB each."""
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(words[(7 * i + j * j) % 5000] for j in range(400)) for i in range(3000)]
    ids, n = pa.array(range(len(texts))), 1 << 4
    model = bloom_lm.Model(np.array([bloom_lm.BEGIN, bloom_lm.END]), np.ones(3), np.ones(3), 1e6, 1000, 8.0, 8, n)
    shared = [SimpleNamespace(value=v) for v in (model, *(bloom_lm.Filter({s: bytes([255]) * 4096 for s in range(k)}, 0, k, 6) for k in (8, n)))]
    batch = pa.record_batch([ids, ids, ids, pa.array([True] * len(texts)), pa.array(texts)], ["rid", "other", "key", "train", "text"])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in bloom_lm._score(*shared, True)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and peak < 100e6, peak


def test_bloom_lm_probabilities_add_up():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in np.minimum(rng.geometric(0.02, 60), 300)) for _ in range(300)]
    tokens, n = bloom_lm.hashed(texts)
    words, place = np.unique(tokens, return_inverse=True)
    common = np.sort(np.concatenate([words[np.argsort(-np.bincount(place))[:20]], [bloom_lm.BEGIN, bloom_lm.END]]))
    common = np.unique(common)
    keys, _ = bloom_lm.bigrams(tokens, n, common, words, place, 2)
    parts, z = {}, np.zeros(len(common) + 1)
    for seg in (0, 1):
        own = keys[keys >> np.uint64(bloom_lm.KEY_BITS) == seg] & np.uint64((1 << bloom_lm.KEY_BITS) - 1)
        bits, sums = bloom_lm._build_bigrams(seg, own, np.ones(len(own), np.int64), 24)
        parts[seg] = bits["bits"]
        z[bloom_lm._unpack(sums["doc"], np.uint32)] += bloom_lm._unpack(sums["logs"], np.float64)
    counts = np.bincount(place)
    level = bloom_lm.COUNTS.of(counts)
    often = bloom_lm.place_in(common, words)
    exact = np.zeros(len(common) + 1)
    exact[often[often >= 0]] = counts[often >= 0]
    mass = bloom_lm.COUNTS.value[level][often < 0].sum() + exact.sum()
    uni = bloom_lm.Filter({0: bloom_lm._filter(words & np.uint64((1 << bloom_lm.KEY_BITS) - 1), level, 24).tobytes()}, 0, 1, 24)
    model = bloom_lm.Model(common, exact, z, mass, len(words), 8.0, 1, 2)
    bi = bloom_lm.Filter(parts, 0, 2, 24)
    for u in words[:: len(words) // 40]:
        if u != bloom_lm.END:
            after = np.stack([np.full(len(words), u), words], 1).ravel()
            value, _ = model.score(uni, bi, after, np.full(len(words), 2))
            total = (10 ** value[1::2]).sum()
            assert total == pytest.approx(1, abs=0.04)


def test_bloom_filter_never_underestimates():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    counts = rng.integers(1, 1000, len(keys))
    level = bloom_lm.COUNTS.of(counts)
    f = bloom_lm.Filter({0: bloom_lm._filter(keys, level, 6).tobytes()}, 0, 1, 6)
    found = f.counts(np.zeros(len(keys), np.int64), keys, bloom_lm.COUNTS)
    assert (found >= bloom_lm.COUNTS.value[level]).all() and (found == bloom_lm.COUNTS.value[level]).mean() > 0.9
    assert (abs(bloom_lm.COUNTS.value[level] / counts - 1) < 0.13).all()
    assert (f.counts(np.zeros(5000, np.int64), rng.integers(0, 1 << 40, 5000, dtype=np.uint64), bloom_lm.COUNTS) > 0).mean() < 0.05


def test_quality(spark, docs, none):
    good = [(i, f"calm words about river and mountain number {i} " * 8, 1) for i in range(60)]
    bad = [(100 + i, f"BUY!!! NOW!!! $$$ {i} CLICK!!! " * 8, 0) for i in range(60)]
    t = spark.createDataFrame([(k, x) for k, x, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in good + bad], "doc_id long, quality int")
    held = F.col("doc_id") % 4 == 0
    model = zstd_quality.fit(t, labels.filter(~held), sample=20)
    out = zstd_quality.score(t, model).filter(held).join(labels, "doc_id").collect()
    assert out and all((r.score >= 0.5) == (r.quality == 1) for r in out)
    every = zstd_quality.score(docs, model)
    assert every.columns == docs.columns and every.count() == len(ROWS) and every.filter("score between 0 and 1").count() == len(ROWS)
    assert zstd_quality.score(none, model).count() == 0
    # Repeated keys, with the same text or another, and repeated labels: whatever the order, the same is learned.
    more = t.unionByName(t.limit(20)).unionByName(t.limit(20).withColumn("text", F.concat("text", F.lit("zz"))))
    both = labels.unionByName(labels.limit(10).withColumn("quality", 1 - F.col("quality")))
    a, b = (zstd_quality.fit(x.repartition(n), y.repartition(n), sample=20) for x, y, n in ((more, both, 1), (more, both, 5)))
    assert a.dictionaries == b.dictionaries and (a.weights == b.weights).all()
    sizes = zstd_quality.Sizes(*a.dictionaries)
    text = "calm words about river " * 500
    blocks = [text.encode()[i : i + zstd_quality.BLOCK] for i in range(0, len(text), zstd_quality.BLOCK)]
    bad, good = (sum(len(c.compress(x)) - 6 for x in blocks) for c in sizes.press)
    assert sizes.features(text)[0] == (bad - good) / (len(text) + 20)
    flat = zstd_quality.fit(t, labels.filter("quality = 1"))
    assert {r.score for r in zstd_quality.score(docs, flat).collect()} == {1.0}


def test_html(spark):
    page = """<html><head><title>T</title></head><body><header class=site-header><a href=/>Home</a></header><div id="cookie-notice">We use cookies, ok?</div>
    <div class="layout"><div class="sidebar"><p>Side text, with commas, and more, that is long enough to matter here.</p></div><div class="post-content"><h1>Title &amp; more</h1>
    <p>First para, with some text, that is long enough to count as real.</p><p>Second&nbsp;para   here, <a href=x>link</a>.<p><b>Bold<br>line</b></p><ul><li>item one<li>item two</ul><div class="ad-box">Buy now, cheap!</div>
    <form><p>Your name, email</p></form></div><div id="comments"><p>Nice article, thanks, a lot, for it, I liked it very much indeed, yes.</p></div></div><footer>c 2020</footer></body>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "plain"), (5, "u", "<div><script>x")]
    found = {r.page_id: r for r in html_tree.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert found[1].text.split("\n") == ["Title & more", "First para, with some text, that is long enough to count as real.", "Second para here, link.", "Bold line", "item one", "item two"]
    assert [found[k].text for k in (2, 3, None, 5)] == ["", "", "plain", ""]
    assert all(r.n_chars == len(r.text) for r in found.values())


PARAGRAPHS = [f"Paragraph {i} has some plain text, with commas, and it is long enough to be counted as a real one here." for i in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
FRAME = "<html><body><nav><a href=/>Home</a> <a href=/x>More</a></nav>%s<div class=sidebar><p>Side, text.</p></div><footer>c 2020</footer></body></html>"


@pytest.mark.parametrize(
    "wrapper",
    ["<div class='layout has-sidebar'>%s</div>", "<div class='content no-sidebar'>%s</div>", "<div class=menu-closed>%s</div>", "<div class=elementor-widget>%s</div>", "<article class='legal news'>%s</article>", "<div class='legal news'>%s</div>",
     "<div id=search>%s</div>", "<form id=aspnetForm><div>%s</div></form>", "<article><section id=discussion>%s</section></article>", "<article><section class=related>%s</section></article>"],
)
def test_html_names_never_drop_the_article(wrapper):
    assert html_tree.main_blocks(FRAME % (wrapper % BODY)) == PARAGRAPHS


def test_html_sections_without_an_article():
    short = "A closing section, short, with three commas, that is a text of its own and has well over eighty characters in it."
    page = f"<div><section>{BODY}</section><section><p>{short}</p></section><ul><li>one</li><li>two</li></ul><blockquote>said</blockquote><ul><li><a href=a>link a</a></li><li><a href=b>link b</a></li></ul></div>"
    assert html_tree.main_blocks(FRAME % page) == [*PARAGRAPHS, short, "one", "two", "said"]


@pytest.mark.parametrize("name", ["ad-hoc", "foot-note", "social-history", "share-price", "cookie-recipe", "hidden-gems", "menu-of-the-day", "adHoc", "promotion_law skip-tracing"])
def test_html_compound_names_are_no_adverts(name):
    inside = f"<article>{BODY}<div class='{name}'>Ad-hoc report text</div></article>"
    assert html_tree.main_blocks(FRAME % inside) == [*PARAGRAPHS, "Ad-hoc report text"]
    beside = f"<div class=post>{BODY}</div><div class='{name}'>A closing word.</div><div>And another.</div>"
    assert html_tree.main_blocks(FRAME % f"<div>{beside}</div>") == [*PARAGRAPHS, "A closing word.", "And another."]


@pytest.mark.parametrize("name", ["ad", "ad-box", "ads_2", "adBox", "social-share-buttons", "newsletter-signup", "cookie-notice", "site-footer", "sponsored-content"])
def test_html_adverts_go(name):
    for page in (f"<article>{BODY}<div class='{name}'>Buy now, cheap!</div></article>", f"<div><div class=post>{BODY}</div><div class='{name}'>Buy now, cheap!</div></div>"):
        assert html_tree.main_blocks(FRAME % page) == PARAGRAPHS


def test_html_precision_and_recall_without_an_article():
    """Generated pages: sections of several kinds beside menus, adverts, teasers and comments; no article or main."""
    rng = np.random.default_rng(9)
    kept = wanted = right = 0
    for page in range(300):
        n, truth, parts = int(rng.integers(2, 7)), [], []
        for i in range(n):
            text = f"S{page}x{i} " + " ".join(rng.choice(["plain,", "words", "about", "rivers", "and", "towns."], int(rng.integers(4, 60)))) + "."
            kind = rng.integers(0, 5)
            truth.append(text)
            parts.append([f"<p>{text}</p>", f"<div>{text}</div>", f"<section><p>{text}</p></section>", f"<blockquote>{text}</blockquote>", f"<div class={rng.choice(['ad-hoc', 'share-price', 'part'])}><p>{text}</p></div>"][kind])
            if rng.random() < 0.3:
                parts.append(str(rng.choice(["<div class=ad>Buy this thing. Now.</div>", "<ul class=share><li><a href=x>Tweet it</a><li><a href=y>Mail it</a></ul>", "<div class=related-posts><a href=q>Read this one too</a> <a href=r>And that one</a></div>"])))
        body = f"<div class={rng.choice(['post', 'x', 'entry-content'])}>{''.join(parts)}</div>"
        tail = str(rng.choice(["", "<div id=comments><p>Nice, thanks, really good.</p></div>", "<div class=sidebar><ul><li><a href=a>One more</a><li><a href=b>Two more</a></ul></div>"]))
        found = html_tree.main_blocks(FRAME % f"<div id=wrap>{body}{tail}</div>")
        kept, wanted, right = kept + len(found), wanted + len(truth), right + len(set(found) & set(truth))
    assert right / wanted > 0.99 and right / kept > 0.97, (right / wanted, right / kept)


def test_html_comments_go_even_if_they_are_long():
    page = f"<article>{BODY}<div id=comments>{BODY.replace('Paragraph', 'Comment') * 2}</div></article>"
    assert html_tree.main_blocks(FRAME % page) == PARAGRAPHS


def test_html_scores_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        depth, source = 0, ""
        for _ in range(rng.integers(1, 40)):
            kind = rng.integers(0, 4)
            if kind == 0:
                source, depth = source + "<div>", depth + 1
            elif kind == 1 and depth:
                source, depth = source + "</div>", depth - 1
            else:
                text = ", ".join(["words"] * int(rng.integers(1, 30)))
                source += f"<p>{text}</p>" if kind == 2 else f"<h2><a href=x>{text}</a></h2>"
        nodes, blocks = html_tree.parse(source)
        html_tree._judge(nodes, blocks)
        html_tree._weigh(nodes, blocks)

        def above(node):
            return [node, *above(node.up)] if node is not None else []

        for node in nodes:
            below = [b for b in blocks if node in above(b.node)]
            points = 0.0
            for b in below:
                if b.node.tag == "p":
                    n, level = len(b.text), above(b.node.up).index(node) if node is not b.node else 9
                    points += (min(n / 100, 3) + b.text.count(",") + (n >= 25)) * (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12, 0)[min(level, 5)]
            assert node.points == pytest.approx(points) and node.chars == sum(len(b.text) for b in below)
            assert node.own == pytest.approx(sum(map(html_tree.earned, below)))


def test_html_takes_time_in_proportion():
    for page in ("<div>" * 40_000 + "text, of it", "<div>text, x " * 40_000, "<a " * 200_000, "<p>x</p>" + '<a "' * 200_000 + ">", "<blockquote></p>" * 40_000, "<!--" * 100_000, "<li><div>" * 20_000, "x, " * 1_000_000):
        began = time.time()
        html_tree.main_text(page)
        assert time.time() - began < 5


def test_html_empty_table_and_long_page(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert html_tree.extract(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"word{i}" for i in range(200_000))
    rows = html_tree.extract(spark.createDataFrame([(1, "u", f"<article><p>{long}</p></article>", "t", 1)] * 2, schema)).collect()
    assert [tuple(r) for r in rows] == [(1, "u", long, len(long))] * 2


def brute_components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(n):
        for y in range(x):
            if linked(x, y):
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash(spark, docs, none):
    def brute(text):
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)][: len(w)]
        h = [xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = covering_simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert {(r.doc_id, r.fingerprint) for r in rows} == {(k, f"{brute(t):016x}") for k, t, *_ in ROWS}
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2, 3)} == {0}
    kept = covering_simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 18").count() == 1 and kept.filter("doc_id = 19").count() == 0
    assert covering_simhash.near_duplicates(none).count() == 0 and covering_simhash.keep_one(none).count() == 0


def test_simhash_keeps_a_row_of_each_component(spark):
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcdef")
    rows = [(None, a), (None, b), (None, b), (None, c), (7, c), (8, d), (8, e), (8, e), (9, d), (None, f), (None, f.upper())]
    kept = covering_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 6 and {(r.doc_id, r.text.lower()) for r in kept} == {(None, a), (None, b), (7, c), (8, d), (8, e), (None, f)}
    clash = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"{i} AS {n}" for i, n in enumerate(("_kept", "_file", "_word", "_bits", "_row", "fp", "hash", "top", "_key", "_own_file"))])
    for most in (0, 1 << 20):
        kept = covering_simhash.keep_one(clash, most=most)
        assert kept.columns == clash.columns and len(kept.collect()) == 6 and tuple(kept.first())[2:] == tuple(range(10))
    kept = covering_simhash.keep_one(spark.createDataFrame([(None, a), (None, c), (7, c)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(None, a), (7, c)} and len(kept) == 2


@pytest.mark.parametrize("cap", [2, 64])
def test_covering_edges(spark, cap):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = sorted({int(b) ^ sum(1 << int(i) for i in rng.integers(0, 64, k)) for b in base for k in (0, 1, 2, 3, 4)} - {0})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = covering_simhash.edges(spark.createDataFrame([(f,) for f in fps], "fp long"), cap)
    label = {r.node: r.component for r in components.components(edges).collect()}
    fps.sort()
    wanted = brute_components(len(fps), lambda x, y: ((fps[x] ^ fps[y]) & (1 << 64) - 1).bit_count() <= 2)
    assert [label.get(f, f) for f in fps] == [fps[w] for w in wanted]


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[101] == 100


VECTORS = "vec_id long, embedding array<float>, label int, id long"


def test_multi_index(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x[:60] + rng.normal(size=(60, 16)) * 0.05, x[:5], x[:40] + rng.normal(size=(40, 16)) * 0.05]).astype(np.float32)
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)] + [(1000, None, 0, 0), (1001, [0.0] * 16, 0, 0), (1002, [float("nan")] * 16, 0, 0), (1003, [None] * 16, 0, 0)]
    found = {r.vec_id: r for r in multi_index.near_duplicates(spark.createDataFrame(rows, VECTORS), sample=200, least=8).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert sum(found[i].n_links for i in range(len(x))) >= 0.9 * near.sum()
    assert all(found[i].n_links <= near[i].sum() for i in range(len(x)))
    wanted = brute_components(len(x), lambda a, b: near[a, b])
    assert np.mean([found[i].component_id == w for i, w in enumerate(wanted)]) >= 0.9
    assert all(found[k].n_links == 0 and found[k].component_id == k and found[k].kept for k in range(1000, 1004))
    assert multi_index.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_multi_index_visits_do_not_hang_on_one_group(spark):
    """A tight group with most of the links, and pairs at the threshold: those are found too."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    group = unit(unit(rng.normal(size=(1, 16))) + rng.normal(size=(400, 16)) * 0.01)
    a = unit(rng.normal(size=(1000, 16)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(1)[:, None] * a)
    pairs = 0.955 * a + np.sqrt(1 - 0.955**2) * side
    x = np.concatenate([group, a, pairs])
    found = {r.vec_id: r.n_links for r in multi_index.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(x)], VECTORS), sample=1500).collect()}
    assert np.mean([found[400 + i] > 0 and found[1400 + i] > 0 for i in range(1000)]) >= 0.98
    assert all(found[i] >= 399 for i in range(400))


@pytest.mark.parametrize(("n", "dim", "pairs", "kind"), [(20_000, 16, 400, "float"), (12_000, 64, 40, "double")])
def test_multi_index_finds_rare_pairs(spark, n, dim, pairs, kind):
    """Almost all links are those planted just above the threshold, among vectors without any; defaults."""
    rng = np.random.default_rng(n)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(rng.normal(size=(n, dim)))
    side = rng.normal(size=(pairs, dim))
    side = unit(side - (side * x[:pairs]).sum(1)[:, None] * x[:pairs])
    x = np.concatenate([x, 0.951 * x[:pairs] + np.sqrt(1 - 0.951**2) * side]).astype(np.float32)
    table = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(x.tolist(), pa.list_(pa.float32() if kind == "float" else pa.float64()))}))
    found = {r.vec_id: r.n_links for r in multi_index.near_duplicates(table).collect()}
    u = unit(x.astype(float))
    wanted = np.array([(u @ u[at : at + 1000].T >= 0.95).sum(0) - 1 for at in range(0, len(u), 1000)], object)
    wanted = np.concatenate([w for w in wanted]).astype(int)
    assert wanted.sum() >= 2 * pairs and all(found[i] <= wanted[i] for i in range(len(x)))
    assert sum(found.values()) >= 0.985 * wanted.sum()


def test_traversal_is_the_order_of_the_sums():
    rng = np.random.default_rng(4)
    index, x = multi_index.Index(rng.normal(size=(9, 3)), rng.normal(size=(7, 3))), rng.normal(size=(600, 6))
    a, b = index.distances(x)
    sums = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
    for most in (1, 5, 63, 100):
        found = index.traverse(x, most)
        assert found.shape[1] == min(most, 63)
        assert (np.take_along_axis(sums, found.astype(int), 1) == np.sort(sums, axis=1)[:, : found.shape[1]]).all()
        assert all(len(set(r)) == len(r) for r in found.tolist())
        # The same vectors in other batches have the same visits, to the last tie.
        assert (np.concatenate([index.traverse(x[i : i + 7], most) for i in range(0, 600, 7)]) == found).all()
    assert (index.traverse(x, 1)[:, 0] == index.cells(x)).all()


def test_top_k(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 20)).astype(np.float32)
    x[7] = x[9]
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)] + [(600, None, 0, 0), (620, [float("inf")] * 20, 0, 0), (640, [1.0, 2.0], 0, 0), (640, [1.0, 2.0], 0, 0), (641, [1.0, -2.0], 0, 0), (660, [1.0] * 3, 0, 0), (660, [-1.0] * 3, 0, 0)]
    found = branch_topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, 20, run_bytes=4000).collect()
    e = np.floor(64.0 * x.astype(float))
    wanted = {(q, k + 1, c, s) for q in range(0, 500, 20) for k, (c, s) in enumerate(sorted(((c, int(e[q] @ e[c])) for c in range(500) if c != q), key=lambda t: (-t[1], t[0]))[:20])}
    # Rows that repeat a key are candidates of each other, whether their vectors are equal or not.
    twice = [(640, 1, 640, 64 * 64 + 128 * 128), (640, 2, 641, 64 * 64 - 128 * 128)] * 2 + [(660, 1, 660, -3 * 64 * 64)] * 2
    assert sorted(map(tuple, found)) == sorted([*wanted, *twice])
    assert branch_topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_multiplies_less_than_brute_force():
    x = np.floor(64 * np.stack(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_numpy()).astype(float))
    ids = np.arange(len(x))
    own = branch_topk.Queries(ids[::20], ids[::20], x[::20], 20)
    by = np.argsort(-(x**2).sum(1))
    for a in range(0, len(x), 500):
        at = by[a : a + 500]
        own.search(ids[at], ids[at], np.ones(len(at), np.int64), np.ascontiguousarray(x[at].T))
    assert own.multiplied < 0.97 * len(own.ids) * x.size
    for r, q in enumerate(own.ids.tolist()):
        wanted = sorted(((c, int(x[q] @ x[c])) for c in ids.tolist() if c != q), key=lambda t: (-t[1], t[0]))[:20]
        assert list(zip(own.best[r][1].tolist(), own.best[r][0].tolist(), strict=True)) == wanted


def test_mixing_totals_on_held_out_labels(spark):
    own, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    c = mixing.fit(own, marks.filter(fold("doc_id", 4) != 2), queries.domain_of_labels())
    held = own.join(F.broadcast(marks.filter(fold("doc_id", 4) == 2).withColumn("domain", queries.domain_of_labels())), "doc_id").select("doc_id", "text", "domain")
    rows, _ = mixing.mix(held, c, queries.TARGETS, keep_text=False)
    sums = [F.sum(F.col("tokens") * F.col("posterior")[i]) / F.sum(F.when(F.col("domain") == d, F.col("tokens")).otherwise(0)) for i, d in enumerate(c.domains)]
    assert list(rows.agg(*sums).first()) == pytest.approx([1.0] * 4, abs=0.1)


def test_mixing(spark, docs, none):
    red, blue = [(i, "red rose fire warm word " * (1 + i % 3)) for i in range(60)], [(100 + i, "blue sea cold wave word ") for i in range(30)]
    t = spark.createDataFrame([(*r, 1.0) for r in red + blue], "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(k, "r" if k < 100 else "b") for k, _ in red + blue if k % 2], "doc_id long, domain string")
    c = mixing.fit(t, labels, F.col("domain"))
    assert c.domains == ["b", "r"]
    out, fitted = mixing.mix(t, c, {"b": 0.5, "r": 0.5})
    rows = out.collect()
    total = sum(r.tokens for r in rows)
    share = [sum(r.tokens * r.rate * r.posterior[i] for r in rows) / total for i in range(2)]
    assert share == pytest.approx([0.5, 0.5], abs=0.01) and min(r.rate for r in rows) >= 0
    # The same optimum by plain projected gradient on all documents.
    p, w, r = np.array([x.posterior for x in rows]), np.array([x.tokens for x in rows]) / total, np.ones(len(rows))
    for _ in range(20000):
        r = np.maximum(0, r - 0.5 * (p @ ((w * r) @ p - 0.5) + 1e-3 * (r - 1)))
    assert np.abs(r - [x.rate for x in rows]).max() < 0.02
    every, _ = mixing.mix(docs, c, {"b": 0.5, "r": 0.5})
    assert every.count() == len(ROWS) and mixing.mix(none, c, {"b": 1.0})[0].count() == 0
    assert mixing.fit(docs, labels.limit(0), F.col("domain")).domains == ["all"]
    clash = t.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(("_lower", "_split", "_copies", "_copy", "tokens", "_mix_words"))])
    mixed, _ = mixing.mix(clash, c, {"b": 0.5, "r": 0.5}, prefix="m_")
    assert set(mixed.columns) == {*clash.columns, "m_tokens", "m_posterior", "m_rate"}
    out = mixing.resample(mixed, "m_rate").select(*clash.columns)
    assert out.count() and set(map(tuple, out.select(*clash.columns[2:]).distinct().collect())) == {(0, 1, 2, 3, 4, 5)}
    short, _ = mixing.mix(docs, c, {"b": 0.5, "r": 0.5}, keep_text=False)
    assert short.count() == len(ROWS) and "text" not in short.columns
    more = mixing.resample(t.withColumn("_r", F.when(F.col("doc_id") < 100, 2.0).otherwise(0.0)), "_r")
    assert more.columns == t.columns and more.count() == 120


def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        found, wanted = queries.queries()[name](spark, SF).toPandas(), con.execute(sql).df()
        cols = sorted(found.columns)
        assert found[cols].sort_values(cols).values.tolist() == wanted[cols].sort_values(cols).values.tolist()


def test_top_k_tells_rows_apart_by_key_too():
    """Rows of other keys whose hashes are equal are candidates of each other; a query's own row is not."""
    data = np.array([[3.0, 1.0], [2.0, 2.0]])
    queries = branch_topk.Queries(np.array([7, 7]), np.array([20, 40]), data, 5)
    queries.search(np.array([7, 7]), np.array([20, 40]), np.array([1, 2]), np.ascontiguousarray(data.T))
    found = queries.rows().to_pydict()
    assert sorted(zip(found["query_id"], found["vec_id"], found["score"], found["times"], strict=True)) == [(20, 40, 8, 2), (40, 20, 8, 1), (40, 40, 8, 1)]
