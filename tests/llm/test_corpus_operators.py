"""The corpus operators against libraries and brute force, and their defined edge cases."""

import base64
import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, html_main, jaccard, langid, media, shards, substr, tokens, toxicity
from tidemark.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "a", "z" * 9000, "ab" * 3000, "x\x1c\x1dy\x85 z", "<s> </s> <|endoftext|>", "日本 🙂🙂‍♂️ é ßẞ", "▁▁a  ▁b", "don't I'LL\r\n\r\nok", "same text here", "same text here"]


def docs(spark, texts, first=0):
    rows = [(i + first, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, size string")  # `size` clashes with a column in use


def corpus(seed, n=160):
    """Random prose with exact copies, near copies, shared passages and repeats."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeфö") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages, out = [words(60) for _ in range(3)], []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and out:
            text = list(rng.choice(out))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        else:
            text = words(rng.choice([1, 2, 3, 5, 30, 80, 150]))
            if rng.random() < 0.3:
                text[len(text) // 2 : 0] = rng.choice(passages)
            if rng.random() < 0.1:
                text = text * 3
        out.append(text)
    return [" ".join(w.upper() if i % 9 == 0 else w for i, w in enumerate(t)) for t in out]


def test_bpe_equals_the_library(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + corpus(1, 40)
    got = tokens.bpe_encode(docs(spark, texts), path, P.PATTERN)
    for r in got.collect():
        text = texts[r.doc_id] or ""
        ids = own.encode_ordinary(text)
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: r.text for r in tokens.bpe_decode(got, path, P.PATTERN).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    assert tokens.bpe_encode(docs(spark, []), path, P.PATTERN).count() == 0


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + corpus(2, 40)
    for r in tokens.count_tokens(docs(spark, texts), path, limit=30).collect():
        text = texts[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (len(model.encode(text)), len(text.encode()))
        assert r.over_limit == (r.n_tokens > 30)


def test_shards(spark):
    rng = random.Random(3)
    texts = [None if i % 50 == 0 else "hot text of many rows" if i % 3 == 0 else "w" * rng.randint(0, 400) + str(i) for i in range(2000)]
    rows = shards.shard(docs(spark, texts), 8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(2000))
    size, slots = [0] * 8, [[] for _ in range(8)]
    for r in rows:
        assert r.size == 16 + len((texts[r.doc_id] or "").encode())
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(size) <= 1.02 * sum(size) / 8
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    # equal texts stand together, but for the hot one that is larger than a shard; slots follow the order of the keys
    home = {}
    for r in rows:
        home.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(v) == 1 for k, v in home.items() if k not in ("hot text of many rows", None)) and len(home["hot text of many rows"]) > 1
    places = {}
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        places.setdefault(texts[r.doc_id], []).append(r.doc_id)
    assert all(v == sorted(v) for v in places.values())
    plan = shards.shard(docs(spark, texts), 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert shards.shard(docs(spark, []), 8).count() == 0
    assert [r.slot for r in shards.shard(docs(spark, ["a"]), 8).collect()] == [0]


def brute_repeats(texts, width):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            if k in seen:
                gone[p : p + width] = [True] * width
            seen.add(k)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_repeats(spark, batches):
    texts = ODD + ["a " * 100, "b c " * 50] + corpus(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substr.remove_repeats(docs(spark, texts), 20, batches).collect()}
    assert got == brute_repeats(texts, 20)
    assert substr.remove_repeats(docs(spark, []), 20).count() == 0


def test_index_compacts(spark):
    index = substr.FingerprintIndex(spark, 20, fanout=1)
    texts = corpus(5, 60)
    rows = substr.normal(docs(spark, texts), "doc_id", "text")
    first = index.add(rows.where("id < 20"))
    second = index.add(rows.where("id between 20 and 39"), rows.where("id < 20"))
    assert len(index.runs) == 1
    third = index.add(rows.where("id >= 40"), rows.where("id < 40"))
    got = substr.apply_decisions(rows, first.unionByName(second).unionByName(third), 20).collect()
    index.drop()
    assert {r.id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_repeats(texts, 20)


@pytest.mark.parametrize("hot_docs", [1, 2])
def test_hot_fingerprints(spark, monkeypatch, hot_docs):
    """Fingerprints dealt at random: all that a sample of all documents finds in one or two of them."""
    monkeypatch.setattr(substr, "HOT_PART", 1)
    monkeypatch.setattr(substr, "HOT_DOCS", hot_docs)
    texts = corpus(14, 90)
    for most in (1 << 16, 40):
        monkeypatch.setattr(substr, "HOT_PRINTS", most)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substr.remove_repeats(docs(spark, texts), 20, 3).collect()}
        assert got == brute_repeats(texts, 20)


def test_repeats_of_ids_with_several_texts(spark):
    words = [f"w{i}" for i in range(25)]
    rows = [(None, " ".join(words)), (None, "one two three"), (5, " ".join(words)), (5, " ".join(words)), (5, "four five"), (6, None)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in substr.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 3, 0, "one two three"), (0, 25, 0, " ".join(words)), (5, 2, 0, "four five"), (5, 25, 25, ""), (5, 25, 25, ""), (6, 0, 0, "")]


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_jaccard_components(spark, k, num, den):
    texts = ODD + corpus(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs(spark, texts), k, num, den).collect()}
    assert got == brute_components(texts, k, num, den)
    assert jaccard.link(docs(spark, []), k, num, den).count() == 0


def test_large_near_copy_group(spark):
    """Hundreds of near copies of which only some are linked directly."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(250):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            t[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs(spark, texts), 4, 85, 100).collect()}
    assert got == brute_components(texts, 4, 85, 100)


def test_hot_shingles_and_heavy_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_PART", 1)
    monkeypatch.setattr(jaccard, "HOT_SETS", 2)
    texts = corpus(15, 120)
    for most in (0, 5, 1 << 16):
        monkeypatch.setattr(jaccard, "HOT_SHINGLES", most)
        monkeypatch.setattr(jaccard, "HEAVY", most)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs(spark, texts), 4, 85, 100).collect()}
        assert got == brute_components(texts, 4, 85, 100)


def test_links_of_ids_with_several_texts(spark):
    a, b = "a b c d e f g h", "k l m n o p q r"
    rows = [(3, a), (3, b), (4, b), (2, "x"), (None, a)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect())
    assert got == [(0, 5, 0), (2, 1, 2), (3, 5, 0), (3, 5, 3), (4, 5, 3)]


def test_divide_skip_finds_what_there_is():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 50)).astype(np.uint64)) for _ in range(60)]
    found = dict(jaccard.divide_skip(sets[:30], sets[30:], 60, 100))
    for q, s in enumerate(sets[30:]):
        linked = {m for m, t in enumerate(sets[:30]) if 100 * len(np.intersect1d(s, t)) >= 60 * len(np.union1d(s, t))}
        assert (found.get(q) in linked) if linked else q not in found


def test_components_of_a_chain(spark):
    rows = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (5, 5)], "a long, b long")
    assert {r.id: r.component for r in components(rows).collect()} == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


def test_languages(spark):
    rng = random.Random(8)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60))
    rows = [(i, say("aeiourst" if i % 2 else "öäüklmnß"), "one" if i % 2 else "two") for i in range(120)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(labelled.where("doc_id < 80"))
    got = {r.doc_id: r for r in langid.identify(labelled, filters).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in rows)
    odd = {r.doc_id: r for r in langid.identify(docs(spark, [None, "", "12 !?", "äü ök"]), filters).collect()}
    assert [odd[i].lang_pred for i in range(4)] == ["und", "und", "und", "two"] and odd[0].score == 0
    assert langid.keep_known(docs(spark, [None, "12", "öä kl"]), filters).count() == 1
    assert langid.fit(labelled.limit(0)).languages == []


def test_many_languages_and_letterless_texts(spark):
    letters = [chr(0x4E00 + 3 * i) + chr(0x4E01 + 3 * i) + chr(0x4E02 + 3 * i) for i in range(70)]
    rows = [(i, " ".join([letters[i], letters[i][::-1]] * 6), f"l{i:02d}") for i in range(70)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(table)
    assert {r.doc_id: r.lang_pred for r in langid.identify(table, filters).collect()} == {i: lang for i, _, lang in rows}
    bare = spark.createDataFrame([(1, "12 34", "xx"), (2, "", "yy")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(table, langid.fit(bare)).limit(2).collect()] == ["und", "und"]


def test_toxicity(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    rows, marks = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(80)]
        if toxic := i % 4 == 0:
            for _ in range(4):
                text[rng.randrange(80)] = rng.choice(["wretchedly", "loathsome", "miserable"])
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    scorer = toxicity.fit(d, labels.where("doc_id < 300"))
    got = {r.doc_id: r for r in toxicity.score(d.where("doc_id >= 300"), scorer).collect()}
    right = sum(got[i].predicted == t for i, t in marks[300:])
    assert right >= 95
    odd = toxicity.score(docs(spark, ODD), scorer).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)


def test_toxicity_trains_both_dictionaries(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(2000)]
    usual = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(300)]
    texts = [f"{t} wretchedly loathsome creature {t[::-1]}" for t in usual[:60]] + usual[60:] + ["q" * 200_000]
    made, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda samples, size: made.append((samples, train(samples, size))) or made[-1][1])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(len(texts))], "doc_id long, toxic int")
    toxicity.fit(docs(spark, texts), labels)
    (marking, marks), (plain, base) = made
    assert b" loathsome " in marking and b"loathsome" in marks and len(base) > 1000
    assert not any(b"loathsome" in w for w in plain)


def test_windows_hold_every_word():
    for text in ODD + corpus(3, 10):
        got = toxicity.windows(text or "")
        assert b"".join(b"".join(got).split()) == b"".join((text or "").lower().encode().split())
        assert all(len(w) <= toxicity.WINDOW_BYTES + toxicity.LONGEST_PIECE + 2 for w in got)


@pytest.mark.parametrize(("toxic", "usual"), [(0, 2), (1, 0), (0, 0), (1, 1)])
def test_toxicity_of_few_labels(spark, toxic, usual):
    texts = ["a b"] * toxic + ["a b", "c"][:usual]
    labels = spark.createDataFrame([(i, int(i < toxic)) for i in range(len(texts))] + [(77, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.fit(docs(spark, texts), labels).score(["a b", "", "c"])
    assert all(0 < x < 1 for x in got) and (toxic and usual or len(set(got)) == 1)


PAGE = """<html><head><title>t &amp; u</title><style>p{}</style></head><body class="page-%d"><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies</div><div id="main-%d"><h2>Head &amp; tail</h2><p>First <b>bo</b>ld&nbsp;word,
 and   more text that is long enough.<p>Second &#233; block<br>broken line<script>var x = "<p>no</p>";</script><!-- no --></p><form><p>Sign up</p></form></div>
<div class="sidebar"><p>Other things to read</p></div><div class="comments"><p>A very long reader comment that goes on and on and on, longer than the text itself, and on.</p></div><footer>&copy; us</footer></body>"""


@pytest.mark.parametrize("broadcast", [100, 0])
def test_main_text(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_main, "MOST_BROADCAST", broadcast)
    rows = [(i, f"https://Host{i % 2}.example/a/{i}", PAGE % (i, i)) for i in range(6)] + [(6, None, None), (7, "x", ""), (8, "https://host0.example/z", "<article><p>Only this</article><p>not this")]
    got = {r.page_id: r for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text == "Head & tail First bold word, and more text that is long enough. Second é block broken line"
    assert all(got[i].text == got[0].text for i in range(6))
    assert (got[6].text, got[7].text, got[8].text, got[8].n_chars) == ("", "", "Only this", 9)


def test_article_keeps_its_parts(spark):
    page = '<main><h1>T</h1><div class="related-work"><p>Kept one</p></div><section class="alert">Kept two</section><div class="comments">No</div><div class="ad-box">No</div></main>'
    rows = spark.createDataFrame([(1, "http://a.b/c", page), (1, "http://a.b/c", page), (2, None, "<p>" + "long " * 50000), (None, "http://a.b/d", None)], "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = html_main.main_text(rows).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 19), (1, 19), (2, 249999)]
    assert {r.text for r in got if r.page_id == 1} == {"T Kept one Kept two"}
    assert html_main.main_text(rows.limit(0)).count() == 0


LONG = "This sentence is as long as one of an article would be, and it goes on."
PARTED = {
    "parts of one post": (f'<div class="post"><h1>Heading</h1><p>Introduction. {LONG}</p><div class="body"><p>{LONG * 3}</p></div><div class="more"><p>{LONG}</p></div></div>', f"Heading Introduction. {LONG} {LONG * 3} {LONG}"),
    "sections side by side": (f'<section><h2>One</h2><p>{LONG * 2}</p></section><section><h2>Two</h2><p>{LONG}</p></section><section class="summary"><p>Wrap up.</p></section>', f"One {LONG * 2} Two {LONG} Wrap up."),
    "topics named like junk": (f'<article><p>{LONG}</p><div class="social-history"><p>Kept A</p></div><div class="notice-period">Kept B</div><div class="social">no</div><div class="share-buttons">no</div></article>', f"{LONG} Kept A Kept B"),
    "nested": (f'<div id="wrap"><div class="col"><div class="text"><p>{LONG}</p><div class="quote"><p>{LONG}</p></div></div><div class="text"><p>Last part.</p></div></div><div class="sidebar-left"><p>{LONG * 9}</p></div></div>', f"{LONG} {LONG} Last part."),
}


@pytest.mark.parametrize("kind", sorted(PARTED))
def test_main_text_keeps_all_parts(spark, kind):
    body, want = PARTED[kind]
    page = f'<html><body><header><p>Site name</p></header><nav><a href="/">Home</a></nav>{body}<ul class="menu"><li><a href="/a">Some link</a></ul><footer>Us</footer></body></html>'
    rows = spark.createDataFrame([(i, f"http://{kind.replace(' ', '')}.example/{i}", page) for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in html_main.main_text(rows).collect()} == {want}


def test_decontamination(spark):
    texts = corpus(10, 80)
    rng = random.Random(11)
    items = [" ".join(f"q{rng.randrange(10**5)}" for _ in range(30)) + f". The answer is number{i}." for i in range(20)]
    words = lambda i: items[i].split()
    near = words(3)
    for p in range(0, 30, 6):
        near[p] = "changed"
    texts += ["lead in " + items[0].upper() + " and out", texts[5] + " " + items[1], " ".join(near), " ".join(words(4)[:9]), None, ""]
    texts += [" ".join(texts[:60]) * 20 + " " + items[5] + " " + texts[7], texts[3] + " " + " ".join(words(6)[4:20]) + " " + texts[4]]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.decontaminate(docs(spark, texts), bench).collect()}
    assert got == {(80, 0), (81, 1), (82, 3), (86, 5), (87, 6)}
    assert decontam.decontaminate(docs(spark, texts), bench.limit(0)).count() == 0
    kept = decontam.Screen(docs(spark, texts), bench).clean(docs(spark, texts))
    assert kept.columns == ["doc_id", "text", "size"] and kept.count() == len(texts) - 5


@pytest.mark.parametrize("rows, copies", [(20, 3), (90, 30), (200, 2)])
def test_decontamination_of_an_item_copied_often(spark, rows, copies):
    rng = random.Random(rows)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [" ".join(word() for _ in range(n)) + "." for n in (18, 40)] + ["six words of an item here"]
    texts = []
    for i in range(rows):
        text = [word() for _ in range(120)]
        if i < copies:
            for item in items:
                at = rng.randrange(121)
                text = [word() for _ in range(40)] + text[:at] + item.split() + text[at:]
        texts.append(" ".join(text))
    texts[-1] += " " + " ".join(f"{w} {word()}" for w in items[2].split())
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.decontaminate(docs(spark, texts), bench).collect()}
    whole = {(i, k) for i in range(copies) for k in range(3) if items[k] in texts[i]}  # an item may be cut in two by the next one
    assert len(whole) > copies and whole <= got and all(d < copies for d, _ in got)
    assert decontam.Screen(docs(spark, texts), bench).clean(docs(spark, texts)).count() == rows - copies


def test_spaces_of_a_benchmark_are_fitted_on_all_items_and_on_no_sample_of_the_corpus(spark):
    rng = random.Random(29)
    draw = lambda words, n: [" ".join(f"w{rng.randrange(words)}" for _ in range(40)) for _ in range(n)]
    items = draw(400, 150)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    corpora = [[" ".join(rng.choice(items[:n]).split()[:30]) for _ in range(40)] for n in (2, 150)]
    one, other = (decontam.Screen(docs(spark, texts), bench).scans()[0].value[0] for texts in corpora)
    assert np.allclose(one.latent @ one.latent.T, other.latent @ other.latent.T, atol=1e-3)
    items = draw(90, 60)
    one = decontam.build(list(enumerate(items)), spark)
    # fewer words than dimensions: the space keeps all of every passage, so latent cosines are the full ones
    place, value, item = decontam.unit_passages(one.words, one.vocabulary)
    whole = np.zeros((len(item), len(one.vocabulary.words)))
    whole[place[0], place[1]] = value
    assert np.allclose(one.latent @ one.latent.T, whole @ whole.T, atol=1e-3)
    # more words than dimensions: what the range finder keeps is what an exact decomposition of all passages keeps
    rank = 20
    basis = decontam.build(list(enumerate(items)), spark, rank).basis / one.vocabulary.weight[:, None]
    best = (np.linalg.svd(whole, compute_uv=False)[:rank] ** 2).sum()
    assert ((whole @ basis) ** 2).sum() > 0.85 * best


def test_common_words_make_no_paraphrase(spark):
    common = "the of to is was that".split()
    items = ["the heatou ononat to to the anor shheed eronnten onnt thin ndonsh of. Is the was that of."]
    items += [f"the w{i}a of w{i}b to w{i}c is w{i}d was w{i}e that w{i}f." for i in range(30)]
    rng = random.Random(3)
    texts = [" ".join(rng.choice(common) if rng.random() < 0.5 else f"z{rng.randrange(10**6)}" for _ in range(400)) for _ in range(60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert decontam.decontaminate(docs(spark, texts), bench).count() == 0


def test_common_subsequence():
    a, b = np.array([1, 2, 3, 4, 5], np.uint64), np.array([9, 2, 4, 3, 5], np.uint64)
    assert decontam.common_subsequence(a, b) == 3 and decontam.common_subsequence(a, b[:0]) == 0


def test_media(spark, tmp_path):
    path = str(tmp_path / "media")
    d = docs(spark, ODD)
    media.store_texts(d, path)
    pages = media.parse_sequences(media.interleave_texts(d), "doc_id")
    got = {r.doc_id: r for r in media.resolve(pages, media.read_media(spark, path), "doc_id").collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (got[i].payload_sha256, got[i].payload_bytes, int(got[i].caption)) == (hashlib.sha256(payload).hexdigest(), len(payload), len(raw))
    assert got[11].feature == got[12].feature


def test_sequences_keep_order():
    digest = "0" * 64
    got = media.parse_sequence(f'<h1>A &amp; b</h1><p>one <i>two</i></p><figure><img src="sha256:{digest}"><figcaption>see <b>this</b></figcaption></figure>tail<img alt=pic src=sha256:{digest}><img src=other>')
    assert [(x["kind"], x["text"] or x["caption"]) for x in got] == [("text", html.unescape("A &amp; b")), ("text", "one two"), ("media", "see this"), ("text", "tail"), ("media", "pic")]
    assert [x["position"] for x in got] == list(range(5))


def test_nulls_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert rows.count() == jaccard.link(rows, 4, 85, 100).count() == substr.remove_repeats(rows).count() == shards.shard(rows, 3).count()
    assert sorted(r.component_id or 0 for r in jaccard.link(rows, 4, 85, 100).collect()) == [0, 0, 0, 0]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = corpus(12, 60) + [None, "123 456"]
    d = docs(spark, texts).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    item = texts[7] if len(texts[7]) > 60 else max(texts, key=lambda t: len(t or ""))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows, table = [c for c in corpus_pipeline.STAGES], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in rows:
        before = table
        stage(spark, table, str(tmp_path)).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id: r for r in before.collect()}
        if name == "language_id":
            assert {r.doc_id for r in table.collect()} == set(range(60))
        if name == "near_duplicates":
            want = brute_components([ids[i].text if i in ids else None for i in range(62)], 5, 80, 100)
            assert {r.doc_id for r in table.collect()} == {i for i in ids if want[i][1] == i}
        if name == "substring_dedup":
            order = sorted(ids)
            want = brute_repeats([ids[i].text for i in order], 20)
            assert {r.doc_id: r.text for r in table.collect()} == {i: (t if n else ids[i].text) for (i, (w, n, t)) in zip(order, (want[j] for j in range(len(order))), strict=True) if n < w or not w}
        if name == "benchmark_decontamination":
            assert table.columns == corpus_pipeline.COLUMNS and table.count() < before.count()
    assert table.count() == before.count() and "token_ids" in table.columns
