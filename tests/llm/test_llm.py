"""The llm operators against brute force, round trips and held-out accuracy, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, decontaminate, language, lines, media, mixing, near_dup, quality, suffix_dedup, token_counts, token_output
from millrace.llm.queries import BYTE_BPE
from millrace.llm.tokens import Words

R = random.Random(5)
WORDS = ["".join(R.choice("abcdefgé") for _ in range(R.randint(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


BASE, LONG = prose(120), prose(20_000)


def edited(text, k):
    w = text.split(" ")
    for _ in range(k):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


ROWS = [
    (0, BASE), (1, BASE), (1, BASE), (2, edited(BASE, 1)), (3, edited(BASE, 2)), (4, edited(BASE, 30)), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "One"), (10, LONG), (11, LONG + " end"),
    (12, "don't 's  !! <|endoftext|> naïve 中文 ½ \x1c͸"), (13, "aaaa" * 200), (14, "x" + "aaaa" * 200), (None, BASE), (None, "null id"), *((k, prose(80)) for k in range(20, 40)),
]


@pytest.fixture(autouse=True)
def own_seed(request):
    """Each test draws the same whatever ran before it."""
    R.seed(request.node.name)


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, component string"
    rows = [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), k, "x", None) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def library_ids(text):
    return Words.load(BYTE_BPE).whole(text or "")


def test_crc32c():
    assert token_output.crc32c(b"123456789") == 0xE3069283  # the check value of CRC-32C
    for n in (0, 1, 63, 64, 65, 128, 1000, 70_000):
        data = R.randbytes(n)
        c = 0xFFFFFFFF
        for b in data:
            c = (c >> 8) ^ int(token_output._BASE[(c ^ b) & 255])
        assert token_output.crc32c(data) == c ^ 0xFFFFFFFF


def test_frame():
    data = token_output.frame(b"abc") + token_output.frame(b"")
    assert token_output.unframe(data, 0) == b"abc" and token_output.unframe(data, 19) == b""
    for k in (0, 9, 13, 16):
        with pytest.raises(ValueError):
            token_output.unframe(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :], 0)


def test_op1(docs, empty):
    got = token_output.token_output(docs, BYTE_BPE).toPandas()
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library_ids(t), 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    rows = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got.sort_values("start").itertuples()]
    assert rows == want
    assert token_output.token_output(empty, BYTE_BPE).count() == 0


@pytest.mark.parametrize("head", [0, 5, 500_000])
def test_op2(docs, empty, head):
    got = token_counts.token_counts(docs, BYTE_BPE, head_types=head).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((i, len((t or "").encode()), n := len(library_ids(t)), n > 512) for i, t in ROWS)
    assert token_counts.token_counts(empty, BYTE_BPE, head_types=head).count() == 0


def test_op3(docs, empty):
    for r in media.media_columns(docs).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes) and r.feature.startswith("audio/wav;")
    by_text = {}
    got = media.media_columns(docs.where("doc_id IS NOT NULL")).join(docs.where("doc_id IS NOT NULL").select("doc_id", "text").distinct(), "doc_id").collect()
    for r in got:
        raw = (r.text or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert by_text.setdefault(r.text, r.feature) == r.feature
    assert media.media_columns(empty).count() == 0


def test_sniffing(spark):
    import gzip
    import struct

    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", bytes(13)), (b"IDAT", b"abc"), (b"IEND", b"")))
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(9) + b"\x02" + b"\x01a" + b"\x00" + b"\x3b"
    wav = media.wav(bytes(64))
    zipped = gzip.compress(b"hello")
    whole = b"junk" + png + b"BM not one" + zipped + gif + wav + b"GIF89a cut"
    found = media.sniff(whole)
    assert [(m.media_type, whole[m.offset : m.offset + m.length]) for m in found] == [("image/png", png), ("application/gzip", zipped), ("image/gif", gif), ("audio/wav", wav)]
    df = spark.createDataFrame([(png, "image/gif"), (b"text", "text/plain"), (None, "x/y"), (b"", "image/png"), (b"a" + png, "image/png")], "content binary, declared_type string")
    got = media.sniff_media(df).collect()
    assert [r.media_type for r in got] == ["image/png", "text/plain", None, "application/octet-stream", "application/octet-stream"]
    assert [r.type_was_wrong for r in got] == [True, False, True, True, True] and got[4].embedded[0].bytes == png


def test_op4(spark, empty):
    alphabet = {"aa": "abcdef ", "bb": "klmnop ", "cc": "uvwxyz "}
    rows = [(k, "".join(R.choice(alphabet[c]) for _ in range(R.choice([30, 300, 900]))), c) for k, c in enumerate(R.choices(list(alphabet), k=240))]
    df = spark.createDataFrame([*rows, (900, None, None), (901, "", None), (902, "12 34", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.language_id(df).collect()}
    held = [(k, c) for k, _, c in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out for k, _ in held) and sum(got[k].lang_pred == c for k, c in held) >= 0.97 * len(held)
    assert all(got[k].lang_pred == "und" for k in (900, 901, 902)) and all(0 <= r.score <= 1 for r in got.values())
    assert language.language_id(empty).count() == 0


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    label[a], changed = label[b], True
    return sets, label


def test_op5(spark, docs, empty):
    group = [(100 + k, edited(BASE, k % 9)) for k in range(60)]  # near copies, many of which are not near each other
    rows = [(i, t) for i, t in ROWS if i is not None and i not in (10, 11)] + group
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    sets, label = brute_components(rows, 3, 85)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(i, label[i], label[i] == i) for i in sets}
    assert all(r.n_shingles in {len(s) for s in sets[r.doc_id]} for r in got) and len(got) == len(rows)
    assert near_dup.near_duplicates(docs).count() == len(ROWS)
    assert near_dup.near_duplicates(empty).count() == 0


def test_merged_components(spark):
    """Labels of two batches of links are those of all links at once, also where the second links nothing new."""
    rng = np.random.default_rng(7)
    first, second = (rng.integers(0, 120, (n, 2)).tolist() for n in (40, 30))
    name = list(range(120))
    for a, b in first + second:
        low, high = sorted((name[a], name[b]))
        name = [low if x == high else x for x in name]
    met = {x for a, b in first + second if a != b for x in (a, b)}
    scratch = common.Scratch(spark, "merged")
    frame = lambda rows: spark.createDataFrame([r for r in rows if r[0] != r[1]], "a long, b long")
    labels = common.components(frame(first), scratch, "first")
    for rows in (second, first[:3], []):
        labels = common.merged(labels, frame(rows), scratch, f"then{len(rows)}")
    assert sorted(map(tuple, labels.collect())) == [(x, name[x]) for x in sorted(met)]


def test_op5_repeated_ids(spark):
    """Rows of one doc_id with different texts link what each is near to; the pipeline's stage judges each text by itself."""
    import corpus_pipeline as P

    rnd = random.Random(17)
    a, b, c = (" ".join(rnd.choice(WORDS) for _ in range(40)) for _ in range(3))
    w = c.split(" ")
    near, far = " ".join(["other", *w[1:]]), " ".join([*w[:20], "other", *w[21:]])  # 35 and 31 of 36 and 41 shingles
    rows = [(5, a), (5, b), (7, a), (3, b), (9, None), (5, ""), (None, a), (8, c), (8, c), (11, near), (12, far)]
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, id int, k string")
    got = near_dup.near_duplicates(df, 3, 85).collect()
    _, label = brute_components([r for r in rows if r[0] is not None], 3, 85)
    assert all(r.component_id == label.get(r.doc_id) and r.kept == (r.doc_id is None or label[r.doc_id] == r.doc_id) for r in got) and len(got) == len(rows)
    left = P.near_dedup(spark, df, "")
    assert left.columns == df.columns
    kept = Counter((r.doc_id, r.text) for r in left.collect())
    # each text by itself: numbered in order of doc_id, so that the least number of a component is its smallest doc_id
    texts = sorted({(i, t) for i, t in rows if i is not None and t})
    _, label = brute_components([(k, t) for k, (_, t) in enumerate(texts)], 5, 80)
    gone = {texts[k] for k in range(len(texts)) if label[k] != k}
    assert kept == Counter(r for r in rows if r not in gone) and gone == {(7, a), (5, b), (11, near)}


@pytest.mark.parametrize("length", [200, 50, 333])
def test_op6(spark, docs, empty, length):
    shared = prose(70)
    rows = [(50 + k, prose(20) + shared[k * 3 : 230 + 5 * k] + prose(20)) for k in range(12)] + [(i, t) for i, t in ROWS if i != 11]
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    want = Counter()
    for (i, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    assert Counter(map(tuple, got)) == want
    assert suffix_dedup.remove_repeats(empty, length).count() == 0


def test_op7(spark, docs, empty):
    good = [(k, prose(R.randint(5, 200)).capitalize() + ".", 1) for k in range(0, 160)]
    bad = [(k, " ".join(w.upper() + "!!" for w in prose(R.randint(5, 200)).split()), 0) for k in range(160, 220)]
    df = spark.createDataFrame([(k, t) for k, t, _ in good + bad] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in good + bad], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(df, labels).collect()}
    held = [(k, q) for k, _, q in good + bad if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out for k, _ in held) and sum(got[k].predicted == q for k, q in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values()) and len(got) == 222
    assert quality.quality(empty, labels).count() == 0
    assert quality.quality(docs, labels.where("false")).count() == len(ROWS)
    x, y = quality.isotonic(np.arange(5.0), np.array([0.0, 1.0, 0.5, 0.4, 1.0]), np.ones(5))
    assert list(y) == pytest.approx([0, 0.6333333, 1]) and list(x) == [0, 2, 4]


def plain_tiles(doc, item, least):
    """Greedy string tiling by the definition: the longest match of unmarked words, again and again."""
    free_doc, free_item, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and free_doc[p + n] and free_item[q + n]:
                    n += 1
                if n > best[2]:
                    best = (p, q, n)
        p, q, n = best
        if n < least:
            return tiles
        tiles.append(best)
        free_doc[p : p + n] = free_item[q : q + n] = [False] * n


def test_op8_tiles():
    for _ in range(150):
        item = [R.randrange(6) for _ in range(R.randint(1, 20))]
        doc = [R.randrange(6) for _ in range(R.randint(0, 20))]
        for _ in range(R.randint(0, 4)):
            a = R.randrange(len(item))
            doc += item[a : a + R.randint(1, 9)] + [R.randrange(6)]
        least = min(R.choice([1, 2, 3, 5]), len(item))
        got = decontaminate.tile(np.array(doc, np.uint64), np.array(item, np.uint64), least)
        assert got == plain_tiles(doc, item, least)


def test_op8(spark, docs, empty):
    items = [(k, prose(40)) for k in range(6)] + [(6, None), (7, "four words in all"), (8, BASE), (0, None), (None, BASE), (9, "two words")]
    items += [(1, items[1][1])] * 2
    half = items[1][1].split()
    moved = prose(9) + " " + " ".join(half[20:]) + " " + prose(7) + " " + " ".join(half[:20]).upper().replace(" ", " - ")
    rows = [(1, prose(30) + " " + items[0][1] + " " + prose(5)), (2, moved), (3, " ".join(items[2][1].split()[:20])), (4, prose(90)), (5, None), (6, ""), (7, "here: FOUR words (in) all"), (7, "here: FOUR words (in) all"), (8, "two words four words all")]
    df, bench = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, item_id int, k string"), spark.createDataFrame(items, "item_id long, text string")
    for held in (0, 10**6):
        got = decontaminate.contaminated(df, bench, held_seeds=held).collect()
        assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, 0), (2, 1), (7, 7), (7, 7)]) and {r.doc_id: r.n_tiles for r in got}[2] == 2
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} >= {0, 1, 2, 3, None}


def test_op8_tiles_of_repeated_words():
    """20,000 times 800 words that are all one, or two in turn: matches are made once a diagonal, and the tiles are those of the plain way."""
    import time

    for period in (1, 2, 7):
        doc, item = (np.arange(n, dtype=np.uint64) % np.uint64(period) + np.uint64(9) for n in (20_000, 800))
        began = time.process_time()
        got = decontaminate.tile(doc, item)
        assert got == [(0, 0, 800)] and time.process_time() - began < 2
        small = decontaminate.tile(doc[:40], item[:17])
        assert small == plain_tiles(doc[:40].tolist(), item[:17].tolist(), 5)


@pytest.mark.parametrize("held", [0, 10**6])
def test_op8_end_to_end(spark, held):
    """Against tiling of every document with every item; one phrase stands in all of them, one item repeats a word."""
    rnd = random.Random(8)
    vocab = [f"w{k}" for k in range(60)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    phrase = "which of the following is not a right answer".split()
    items = [(k, some(rnd.choice([6, 14, 30])) + phrase) for k in range(12)] + [(20, ["same"] * 20), (21, some(4)), (22, phrase)]
    rows = []
    for k in range(40):
        text = some(20) + phrase
        for _ in range(rnd.randint(0, 3)):
            item = rnd.choice(items)[1]
            cut = rnd.randrange(len(item))
            parts = rnd.choice([[item], [item[cut:], item[:cut]], [item[: int(len(item) * 0.85)]], [item[: len(item) // 2]]])
            for part in parts:
                text = text + part + some(rnd.randint(0, 6))
        rows.append((k if k else None, " ".join(text)))
    rows += [(40, "same " * 15 + "x"), (40, "same " * 18), (41, None)]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"), held_seeds=held).collect()
    want = Counter()
    for d, text in rows:
        for i, item in items:
            tiles = plain_tiles((text or "").split(), item, min(5, len(item)))
            covered = sum(t[2] for t in tiles)
            if tiles and covered >= 0.8 * len(item):
                want[d, i, len(tiles), covered] += 1
    assert Counter((r.doc_id, r.item_id, r.n_tiles, r.n_words) for r in got) == want and len({i for _, i, _, _ in want}) > 10


def test_op8_scripts(spark):
    """Case, marks and spacing of other scripts hide nothing: Greek, Turkish, Chinese, typographic quotes."""
    greek, chinese = "ΟΔΥΣΣΕΥΣ ΛΟΓΟΣ ΚΟΣΜΟΣ ΑΝΘΡΩΠΟΣ ΘΕΟΣ ΦΙΛΟΣ ΝΟΜΟΣ ΤΟΠΟΣ ΧΡΟΝΟΣ ΒΙΟΣ", "我们今天去公园看花然后回家吃饭"
    turkish, quoted = "İstanbul güzel bir şehir ve İzmir de öyle", "it's the \"best\" of all well-known days, she said"
    items = [(1, greek), (2, chinese), (3, turkish), (4, quoted)]
    rows = [(1, "x " + greek.lower() + " y"), (2, "开头" + chinese + "。"), (3, "a " + turkish.upper().replace("I", "I") + " b"), (4, "it\u2019s the \u201cbest\u201d of\u00a0all well\u2013known days, she said"), (5, "公园我们家")]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(1, 1), (2, 2), (4, 4)} and all(r.doc_id == r.item_id for r in got)


def fill(sizes, weights, repeats):
    target, free = {}, set(sizes)
    left = float(sum(sizes.values()))
    while free:
        w = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / w > repeats * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in free}
        for s in over:
            target[s] = float(repeats * sizes[s])
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_op9(spark, docs, empty):
    rows = [(k, prose(R.choice([0, 3, 40, 400])), s) for k, s in enumerate(["big"] * 60 + ["a"] * 3 + ["b"] + [None] * 20 + ["none"] * 2)]
    rows = [(i, "" if s == "none" else t, s) for i, t, s in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, dict(zip(names, [5.0, 2.0, 1.0] * 3)), 3)
    taken = Counter()
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 5 for s in names)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix(docs).count() == len(ROWS) and mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def plain_distance(x, y):
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    return row[-1]


def brute_lines(rows):
    """Kept texts by edit similarity alone, all pairs compared."""

    def normal(line):
        return re.sub("[1-9]", "0", re.sub(r"[\W_]+", " ", line.lower())).strip()

    def alike(x, y):
        return x == y or abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and plain_distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)

    places = [(i, k, normal(line)) for i, t in sorted(rows) if t is not None for k, line in enumerate(t.split("\n")) if normal(line)]
    label = list(range(len(places)))
    changed = True
    while changed:
        changed = False
        for a in range(len(places)):
            for b in range(a):
                if label[a] != label[b] and alike(places[a][2], places[b][2]):
                    label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
                    changed = True
    gone = {places[k][:2] for k in range(len(places)) if label[k] != k}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_op10(spark, docs, empty):
    long = prose(150)
    near = [edited(long, 1) for _ in range(8)] + [long + " z", edited(BASE, 1), BASE]
    rows = [(1, "Alpha beta 12\nunique one\n\n" + long), (2, "alpha, BETA: 99\nunique two\n---"), (3, "last\nlast"), (4, None), (5, ""), (6, "alpha beta 77")] + [(10 + k, x) for k, x in enumerate(near)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert want[2] == "unique two\n---" and want[3] == "last" and want[6] == "" and sum(want[10 + k] == "" for k in range(8)) >= 1
    assert (got[4].text, got[4].n_lines) == (None, 0) and (got[5].text, got[5].n_lines) == ("", 1)
    assert lines.dedup_lines(docs).count() == len(ROWS) and lines.dedup_lines(empty).count() == 0


def test_op10_long_lines(spark):
    """No length at which lines are compared otherwise: about 400 characters, 17,000 words with one word in front."""
    shorter, longer = prose(70), prose(17_000)
    rows = [(1, shorter), (2, "word " + shorter), (3, longer), (4, "word " + longer), (5, prose(17_000))]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_op10_parts():
    texts = ["Ab, 12\n\n--\nÉa_b 中文", "", "x", "ab 99", "\n" + " ".join(WORDS[:40])]
    found = lines.Lines(texts)
    names = [lines.normalised(texts[t].split("\n")[p]) for t, p in zip(found.text, found.pos)]
    assert names[:4] == ["ab 00", "éa b 中文", "x", "ab 00"] and list(found.pos) == [0, 3, 0, 0, 1]
    assert [len(x) for x in names] == list(found.chars) and found.k1[0] == found.k1[3] and len(set(found.k1)) == len(set(names))
    words = [found.words[a : a + n] for a, n in zip(found.first, found.count)]
    bits = [{b for b in range(64) if 2 * sum(int(w) >> b & 1 for w in ws) > len(ws)} for ws in words]
    # which word bit a SimHash bit stands for is no matter, as long as it is the same for all
    place = {b: (b // 8) * 8 + 7 - b % 8 for b in range(64)}
    got = [{b for b in range(64) if int(x) >> b & 1} for x in found.simhash()]
    assert got == bits or got == [{place[b] for b in x} for x in bits]
    for _ in range(200):
        x = "".join(R.choice("abc ") for _ in range(R.randint(1, 30)))
        y = edited(x, 1) if R.random() < 0.3 else "".join(R.choice("abc ") for _ in range(R.randint(1, 30)))
        d = plain_distance(x, y)
        assert lines.edit_distance(x, y, 99) == d and lines.edit_distance(x, y, max(0, d - 1)) == max(1, d) or d == 0


def test_edit_similarity():
    assert lines.alike("abcdefghij", "abcdefghxy") and not lines.alike("abcdefghij", "abcdefgxyz")
    assert lines.alike(LONG, edited(LONG, 50)) and not lines.alike(LONG[:20_000], prose(3_000)[:20_000])


def test_pipeline_decontamination(spark):
    """Each text of a doc_id is judged by itself, and a null doc_id protects nothing."""
    import corpus_pipeline as P

    passage = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("length(text) > 60").first().text
    rows = [(1, passage), (1, "other clean text of this document"), (None, f"before {passage} after"), (None, "clean"), (2, "clean"), (2, "clean"), (3, None), (4, "")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, k string, item_id int")
    left = P.decontamination(spark, df, "/root/testdata/sf0.001")
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(rows[1:2] + rows[3:])


def test_pipeline_stages_keep_columns(spark, docs):
    import corpus_pipeline as P

    sf_dir = "/root/testdata/sf0.001"
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES[:-1]:
        table = stage(spark, table, sf_dir)
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert P.run(spark, sf_dir).columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("slots", [4, 16, 200])
def test_op9_small_sources(spark, slots):
    """Blocks far longer than the smaller sources: each still reaches its target."""
    kinds = {"big": (40, 2000), "tiny": (1, 20), "small": (3, 31), "odd": (7, 457), None: (5, 211)}
    rows = [(100 * c + k, prose(n), s) for c, (s, (m, n)) in enumerate(kinds.items()) for k in range(m)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {s: m * n for s, (m, n) in kinds.items()}
    names = sorted(s for s in sizes if s is not None) + [None]
    want = fill(sizes, dict(zip(names, [5.0, 2.0, 1.0] * 3)), 3)
    taken = Counter()
    for r in mixing.mix(df, slots=slots).collect():
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 1 + 0.01 * want[s] for s in names)
    copies = Counter(r.source for r in mixing.mixed_documents(df, slots=slots).collect())
    assert copies["tiny"] == 3 and copies["small"] == 9


def test_op9_plan(spark):
    """The reviewer's case of 4.9e9 words: a plan that is not run, by points through cumulative weights."""
    sizes = {"a": 4_899_964_000, "b": 2_000, "c": 9_000, "d": 25_000}
    targets = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    plan = mixing.blocked(targets, 18_693)
    got = {r.source: r for r in plan.collect()}
    assert all(abs(r.slots * r.source_size / r.blocks - r.target) <= 0.01 * r.target for r in got.values())
    assert {s: got[s].target for s in "bcd"} == {"b": 6_000, "c": 27_000, "d": 75_000} and sum(r.slots for r in got.values()) < 1.01 * 2**18
    slots = mixing.schedule(plan).collect()
    by_sid = {r.sid: sorted((x.rank, x.place, x.block) for x in slots if x.sid == r.sid) for r in got.values()}
    for r in got.values():
        ranks = [x[0] for x in by_sid[r.sid]]
        assert ranks == list(range(len(ranks))) and abs(len(ranks) - r.slots) <= 0.01 * r.slots and len(ranks) <= 3 * r.blocks
        assert all(b == k % r.blocks for k, _, b in by_sid[r.sid])
        assert abs(sum(p < 0.5 for _, p, _ in by_sid[r.sid]) - r.slots / 2) <= 5


def plain_mix(rows, order, weights, block):
    """taken by row, from the rows (source, size) and their place in their source's order: every point looked up by itself."""
    sizes = Counter()
    for s, n in rows:
        sizes[s] += n
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    target = fill({s: n for s, n in sizes.items() if n}, dict(zip(names, weights * len(names))), 3)
    plan = []
    for s in names:
        if sizes[s]:
            blocks = -(-sizes[s] // max(1, min(block, int(target[s] / 600))))
            plan.append((s, blocks, int(np.floor(target[s] * blocks / sizes[s] + 0.5))))
    total, edges, k = sum(p[2] for p in plan), [], 0
    for _, _, slots in plan:
        k += slots
        edges.append(k * 2**32 // total)
    ranks = [0] * len(plan)
    for i in range(total):
        ranks[np.searchsorted(edges, i * 2654435769 % 2**32, "right")] += 1
    taken = [0] * len(rows)
    for (s, blocks, slots), have in zip(plan, ranks):
        n = slots if slots < 600 else min(have, 3 * blocks)
        draws = Counter(r % blocks for r in range(n))
        at = 0
        for k in sorted((k for k, r in enumerate(rows) if r[0] == s), key=order.__getitem__):
            for word in range(at, at + rows[k][1]):
                taken[k] += draws[((word + 1) * blocks - 1) // sizes[s]]
            at += rows[k][1]
    return taken


@pytest.mark.parametrize("slots", [50, 3000])
def test_op9_documents(spark, slots):
    """taken of every document equals a plain lookup of every point and word; another sequence takes other words."""
    rnd = random.Random(slots)
    rows = [(k, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 400])), rnd.choice(["a", "a", "b", "c", None, "tiny" if k % 40 == 0 else "a"])) for k in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    size = lambda t: len(t.split())
    h = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", mixing.word_count()).alias("h")).collect()}
    # a source's order is that of the bucket, by arithmetic shift, then of the hash
    order = [(h[k], k) for k, _, _ in rows]
    total = sum(size(t) for _, t, _ in rows)
    want = plain_mix([(s, size(t)) for _, t, s in rows], order, [5.0, 2.0, 1.0], -(-total // slots))
    got = {r.doc_id: r.taken for r in mixing.mix(df, slots=slots).collect()}
    assert [got[k] for k, _, _ in rows] == want and sum(want) > 0
    plan = mixing.blocked(mixing.source_targets(spark.createDataFrame([("a", 50_000), ("b", 90_000)], "source string, source_size long")), 50)
    one, two = (mixing.schedule(plan, golden=g).select("sid", "rank", "place").collect() for g in (mixing.GOLDEN, 3_141_592_653))
    assert sorted(one) != sorted(two)


def test_op10_recall(spark):
    """Against edit similarity alone: lines with one or two replaced words, which are seldom within 3 bits."""
    rows, pairs = [], 0
    for n, edits in ((10, 1), (20, 2), (60, 4), (150, 10)):
        for k in range(40):
            base = " ".join("".join(R.choice("abcdefgh") for _ in range(5)) for _ in range(n))
            w = base.split(" ")
            for at in R.sample(range(n), edits):
                w[at] = "".join(R.choice("stuvwxyz") for _ in range(5))
            rows += [(2 * pairs, base), (2 * pairs + 1, " ".join(w))]
            pairs += 1
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == 0 for k in range(pairs))
    assert sum(got[2 * k + 1] for k in range(pairs)) >= 0.93 * pairs
    other = " ".join("".join(R.choice("abcdefgh") for _ in range(5)) for _ in range(7))
    unlike = [(1, "same start of a line " + other), (2, "same start of a line " + " ".join(x[::-1] + "q" for x in other.split(" ")))]
    assert [r.n_removed for r in lines.dedup_lines(spark.createDataFrame(unlike, "doc_id long, text string")).collect()] == [0, 0]


CLASHING = ["id", "k", "d", "key", "n", "size", "score", "predicted", "stats", "pos", "component", "shingles", "item_id", "taken", "target", "row", "label", "h", "start", "n_tokens", "anchor", "spans", "word", "at", "gone"]
OPERATORS = {
    "op1": lambda d, t: token_output.token_output(d, BYTE_BPE),
    "op2": lambda d, t: token_counts.token_counts(d, BYTE_BPE),
    "op3": lambda d, t: media.media_columns(d),
    "op4": lambda d, t: language.language_id(d),
    "op5": lambda d, t: near_dup.near_duplicates(d),
    "op6": lambda d, t: suffix_dedup.remove_repeats(d),
    "op7": lambda d, t: quality.quality(d, t["labels"]),
    "op8": lambda d, t: decontaminate.contaminated(d, t["benchmark"]),
    "op9": lambda d, t: mixing.mix(d),
    "op10": lambda d, t: lines.dedup_lines(d),
    "surplus": lambda d, t: near_dup.surplus(d),
    "filter": lambda d, t: quality.filter_quality(d, t["labels"]),
    "mixed": lambda d, t: mixing.mixed_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(spark, name):
    """Clashing extra columns, nulls in every column, empty and repeated rows: no crash, and the same rows as without them."""
    rows = [(1, BASE, "en", "a"), (1, BASE, "en", "a"), (2, None, None, None), (None, BASE, None, "b"), (None, None, None, None), (3, "", "de", "a"), (4, " ", None, "b"), (5, prose(60), "de", None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = plain.select("*", *(F.lit("x" if k % 2 else None).cast("string").alias(c) for k, c in enumerate(CLASHING)))
    tables = {"labels": spark.createDataFrame([(1, 1, 0), (5, 0, None), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")}
    tables["benchmark"] = spark.createDataFrame([(1, BASE, "x"), (1, BASE, "x"), (2, None, None), (None, BASE, None), (3, "", "y")], "item_id long, text string, item string")
    one, two = (OPERATORS[name](d, tables) for d in (plain, extra))
    keys = [c for c in one.columns if c not in ("row", *CLASHING) or name == "op9" and c in ("size", "taken", "target")]
    one, two = (Counter(map(repr, d.select(*(c for c in keys if c in plain.columns or name not in ("filter", "mixed"))).collect())) for d in (one, two))
    assert one == two
    if name == "op8":
        assert sum(one.values()) == 3  # the two repeated documents and the one without an id hold the passage
    elif name not in ("surplus", "filter", "mixed"):
        assert sum(one.values()) == len(rows)


def test_filter_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.filter_quality(docs, none).count() == len(ROWS)


def test_held_out_accuracy(spark):
    """What the README says of sf0.01: nineteen in twenty held-out rows at least."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lang = language.language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.95
    good = quality.quality(docs, labels).where("held_out").join(labels, "doc_id")
    assert good.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] >= 0.95


def test_op10_native(spark):
    """Lines, votes and edits by DataFrame functions alone, with no more Python in the plans, as numpy and plain Python have them."""
    texts = ["Ab, 12\n\n--\nÉa_b 中文 ½\tx", "", "x", "ab 99", "\n" + " ".join(WORDS[:40]), None, "𝒜 b\n" + prose(300)]
    kinds = lines.kinds_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = kinds.collect()
    want = {lines.normalised(x) for t in texts if t for x in t.split("\n")} - {""}
    assert {r.norm for r in got} == want and all(r.chars == len(r.norm) for r in got)
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for x in want for w in x.split(" ")], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for r in got:
        ws = [hashes[w] for w in r.norm.split(" ")]
        assert r.sim & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in ws) > len(ws))
    pairs = []
    for k in range(300):
        x = " ".join("".join(R.choice("abc") for _ in range(R.randint(1, 4))) for _ in range(R.randint(1, 12)))
        w = x.split(" ")
        for _ in range(R.randint(0, 2)):
            at = R.randrange(len(w) + 1)
            w[at : at + R.randint(0, 1)] = R.choice([[], ["b"], ["abca"]])
        pairs.append((k, x, " ".join(w) or "c"))
    df = spark.createDataFrame(pairs, "id long, norm string, norm2 string").select("*", F.length("norm").alias("chars"), F.length("norm2").alias("chars2"))
    alike = lines.similar(df, ["id"])
    within = lambda x, y: plain_distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)
    assert {r.id for r in alike.collect()} == {k for k, x, y in pairs if within(x, y)}
    for plan in (kinds, alike.select("id")):
        assert not re.search("Python|Pandas|MapInArrow", plan._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", ""))
