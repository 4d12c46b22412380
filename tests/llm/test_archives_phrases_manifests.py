"""Archives, phrases and manifests against brute force, and their SQL on the smallest tables."""

import base64
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import decontam, langid, media, merkle, phrases, queries, tokens, toxicity, warc

DATA = "/root/testdata/sf0.001"


def digest_of(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def plain_records(pages, least=0):
    """(page_id, bytes, digest, type, refers_to) of each page by the definition."""
    place = lambda i, u: (i is None, i or 0, u is None, u or "")
    first, out, used = {}, [], set()
    for i, u, h in pages:
        raw = (h or "").encode()
        if len(raw) >= least:
            first[raw] = min(first.get(raw, ((True, 0, True, ""), None)), (place(i, u), i), key=lambda x: x[0]) if raw in first else (place(i, u), i)
    for i, u, h in pages:
        raw = (h or "").encode()
        again = raw in first and (first[raw][0] != place(i, u) or raw in used)
        used |= set() if again else {raw}
        out.append((i, len(raw), digest_of(raw), "revisit" if again else "response", first[raw][1] if again else None))
    return sorted(out, key=str)


INSIDE = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 77\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\nWARC/1.0 tail"
PAGES = [
    (1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, INSIDE), (3, "u", INSIDE + "2"), (4, "u", INSIDE), (5, "u", None), (6, "u", ""), (7, "v", "WARC/1.1\r\nContent-Length: 3\r\n\r\nab"), (None, None, "zz"), (None, "q", "zz"),
    (8, "d", "dup"), (8, "d", "dup"), (8, "d", "dup"), (9, "d", "dup"), (10, "e", "\r\n\r\n"), (11, "e", INSIDE * 60), (12, "u", "\r\n\r\nWARC/1."), (13, "u", "x" * 5000),
]


@pytest.mark.parametrize(("files", "least"), [(1, 0), (3, 3)])
def test_archives(spark, files, least):
    """Records inside payloads, over several splits of a file, are no records."""
    pages = spark.createDataFrame([(*p, i) for i, p in enumerate(PAGES)], "page_id long, url string, html string, path long").repartition(files)
    folder = warc.archive_folder(spark)
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        warc.write(pages, folder, least)
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = warc.read(spark, folder).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in rows), key=str) == plain_records(PAGES, least)
    assert all(r.complete for r in rows) and len({r.record_id for r in rows}) == len(rows)


def test_archive_without_records(spark):
    folder = warc.archive_folder(spark)
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 0


def test_truncated_archive(spark, tmp_path):
    """What was cut off makes its record incomplete; the records before it stand."""
    record = lambda i, body: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record(1, "one") + record(2, "twotwo"))[:-6].encode())
    rows = {r.record_id: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert {k: (r.complete, r.payload_bytes) for k, r in rows.items()} == {"<urn:x:1>": (True, 3), "<urn:x:2>": (False, None)}


def test_pointer_jumping():
    rng = np.random.default_rng(1)
    to = np.array([min(299, i + int(rng.integers(0, 5))) for i in range(300)])
    want = []
    for i in range(300):
        while to[i] != i:
            i = to[i]
        want.append(i)
    assert warc._jump(to).tolist() == want


def plain_phrases(rows, top, least, longest=5, scale=1000):
    count, total = {}, {}
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] = total.get(lang, 0) + len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] = count.get((lang, tuple(w[i : i + k])), 0) + 1
    often = {x: n for x, n in count.items() if n >= least}
    out = {}
    for (lang, p), a in often.items():
        if len(p) < 2 or any(x[0] == lang and len(x[1]) > len(p) and n >= a and any(x[1][i : i + len(p)] == p for i in range(len(x[1]) - len(p) + 1)) for x, n in often.items()):
            continue
        s, k = min((scale * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]], total[lang]))
    return {(lang, i + 1, p.decode(), -a, left, right, n, -s) for lang, v in out.items() for i, (s, a, p, left, right, n) in enumerate(sorted(v)[:top])}


def prose(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}é"[: rng.randint(1, 5)] + str(i) for i in range(60)]
    fixed = [[rng.choice(words) for _ in range(rng.randint(2, 7))] for _ in range(12)]
    rows = [(None, "a b. a b"), ("de", None), ("de", ""), ("fr", "\t ,;!"), ("en", "One  two\tthree ONE two three\r\none two three")]
    for _ in range(n):
        text = []
        for _ in range(rng.randint(1, 25)):
            text += rng.choice(fixed) if rng.random() < 0.4 else [words[min(int(rng.expovariate(0.1)), 59)]]
            if rng.random() < 0.15:
                text[-1] += rng.choice([".", ", ", "!\n", "; "])
        rows.append((rng.choice(["en", "en", "en", "de", None]), (" " if rng.random() < 0.9 else "  ").join(text)))
    return rows + rows[40:60]


@pytest.mark.parametrize(("top", "first", "stretch"), [(4, 1, 300), (2000, 4, 1 << 22)])
def test_phrases(spark, monkeypatch, top, first, stretch):
    """Several waves with few phrases wanted; all phrases; texts parted between pieces."""
    monkeypatch.setattr(phrases, "FIRST_WAVE", first)
    monkeypatch.setattr(phrases, "STRETCH", stretch)
    monkeypatch.setattr(phrases, "FILTER_BITS", 20)
    rows = prose(5)
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, text string, n long").repartition(3)
    assert {tuple(r) for r in phrases.collocations(docs, top=top, least=5).collect()} == plain_phrases(rows, top, 5)


def test_phrases_of_no_text(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string"), least=2).count() == 0


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256("".join(levels[-1][i : i + 2]).encode()).hexdigest() for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    """[(grp, id, slot, leaf, subroot, root, proof, folded, verified)] of rows (grp, id, leaf, claim) by the definition."""
    order = {g: sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for g in {r[0] for r in rows}}
    names = sorted(order, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([r[2].hex() for r in order[g]]) for g in names]
    top, out = tree([t[-1][0] for t in trees]), []
    for j, g in enumerate(names):
        for i, r in enumerate(order[g]):
            node, proof = (r[3] or r[2]).hex(), []
            for levels, at in ((trees[j], i), (top, j)):
                for level in levels[:-1]:
                    pair = level[at // 2 * 2 : at // 2 * 2 + 2]
                    proof += [x for k, x in enumerate(pair) if k != at % 2]
                    pair[at % 2] = node
                    node, at = hashlib.sha256("".join(pair).encode()).hexdigest(), at // 2
            out.append((g, r[1], i, r[2].hex(), trees[j][-1][0], top[-1][0], hashlib.sha256("".join(proof).encode()).hexdigest(), node, node == top[-1][0]))
    return sorted(out, key=str)


def test_manifest(spark):
    """Null and repeated ids, repeated rows, ids far apart, a null group, arrays over two rounds."""
    rng = random.Random(7)
    leaf = lambda x: hashlib.sha256(str(x).encode()).digest()
    ids = [*range(1800), *range(-4000, 0, 7), 2**40, -(2**50), *[7] * 5, 90, 90, *[None] * 6]
    rows = [(rng.choice([None, "en", "en", "en", "é"]), i, leaf(n), leaf(-n) if n % 5 == 0 else None) for n, i in enumerate(ids)]
    rows += [rows[3], rows[3], ("one", 1, leaf("one"), None)]
    frame = spark.createDataFrame(rows, "grp string, id long, leaf binary, claim binary").repartition(4)
    assert sorted(map(tuple, merkle.manifest(frame).collect()), key=str) == plain_manifest(rows)


def test_manifest_of_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], "grp string, id long, leaf binary, claim binary")).count() == 0


def test_ranks():
    rng = np.random.default_rng(3)
    for n in (1, 100, 255, 256, 4000, 4096):
        low = np.sort(rng.choice(merkle.SPAN, n, replace=False))
        bits = merkle.pack_ids(low)
        assert merkle.unpack_ids(bits).tolist() == low.tolist() and len(bits) <= merkle.FULL
        ahead = merkle.directory(bits) if len(bits) >= merkle.FULL else None
        assert merkle.rank(bits, ahead, low).tolist() == list(range(n))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", ["op11_warc_chains", "op12_phrase_collocations", "op13_merkle_manifest"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str)
    assert rows == sorted(map(tuple, want.fetchall()), key=str) and rows


def texts_frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")


def test_all_columns_of_media(spark, tmp_path):
    """Every column against the payload itself; repeated rows; no rows."""
    texts = [None, "", "a", "é" * 100, "b" * 64, "b" * 64, "line\n" * 900, "\0" * 3]
    frame = texts_frame(spark, texts)
    media.store_texts(frame, str(tmp_path / "m"))
    got = {r.doc_id: r for r in media.resolve(media.parse_sequences(media.interleave_texts(frame), "doc_id"), media.read_media(spark, str(tmp_path / "m")), "doc_id").collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.pack(payload)
        assert media.unpack(stored) == payload
        samples = np.frombuffer(payload, np.uint8).astype(float)
        assert (got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (got[i].media_bytes, got[i].media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        height, mean, std = (float(x.split("=")[1]) for x in got[i].feature.split(";")[:3])
        assert height == len(payload) / 64 and abs(mean - samples.mean()) < 6e-4 and abs(std - samples.std()) < 6e-4
    media.store_texts(frame.limit(0), str(tmp_path / "none"))
    assert media.read_media(spark, str(tmp_path / "none")).count() == 0


def test_language_masks_hold_what_sets_hold():
    """A filter has every trigram it was given, and chance hits are corrected to nearly the plain shares."""
    rng = random.Random(2)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl"}
    words = {k: ["".join(rng.choice(v) for _ in range(6)) for _ in range(400)] for k, v in alphabets.items()}
    sets = {k: set(langid.trigrams([" ".join(v)])[0].tolist()) for k, v in words.items()}
    grams = np.array([g for k in sorted(sets) for g in sorted(sets[k])], np.uint64)
    filters = langid.Filters(sorted(sets), grams, np.repeat(np.arange(2), [len(sets[k]) for k in sorted(sets)]))
    texts = [" ".join(rng.choice(words[k]) for _ in range(40)) for k in ("aa", "bb") for _ in range(20)]
    names, score = filters.predict(texts)
    for text, name, got in zip(texts, names, score.tolist(), strict=True):
        own = langid.trigrams([text])[0].tolist()
        hits = {k: sum(g in sets[k] for g in own) for k in sets}
        assert hits[name] == len(own) == max(hits.values()) and abs(got - hits[name] / sum(hits.values())) < 0.05


def test_empty_tables_and_repeated_rows(spark):
    import public_tokenizers as P

    none = texts_frame(spark, [])
    labelled = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(none, langid.fit(labelled)).count() == 0
    assert tokens.count_tokens(none, P.path("piece_bpe_32k.model")).count() == 0
    assert toxicity.score(none, toxicity.Scorer(prior=0.5)).count() == 0
    item = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    twice = spark.createDataFrame([(5, f"some words {item} more"), (5, f"some words {item} more"), (6, "nothing of it here")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.decontaminate(twice, bench).collect()} == {(5, 1)}
    assert decontam.Screen(twice, bench).clean(twice).count() == 1
    assert decontam.Screen(twice.limit(0), bench).clean(twice.limit(0)).count() == 0
