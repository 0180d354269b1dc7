"""Near copies in compact hashes: whole results, no bucket skipped, and no whole set dealt."""

import hashlib
import random
import weakref

import duckdb
import numpy as np
from pyspark.sql import functions as F

from millrace import registry
from millrace.functions.text import WORD_OR_MARK
from millrace.operators import heads, near


def hashes(words, width=5):
    return sorted({hashlib.sha256(" ".join(words[k : k + width]).encode()).hexdigest()[:16] for k in range(len(words) - width + 1)})


def test_hashes_are_numbers_in_the_order_of_their_digits(spark):
    words = [f"w{k}" for k in range(300)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "a b")], "id long, text string")
    got = {r.id: r for r in df.select("id", near.shingle_hashes(F.col("text")).alias("s"), near.shingle_summary(F.col("text"), least=20).alias("x")).select("*", F.transform("s", near.hex_hash).alias("hex")).collect()}
    assert got[1].hex == hashes(words) and got[1].s == sorted(got[1].s) and all(isinstance(x, int) for x in got[1].s)
    assert got[2].s == [] and len(got[3].s) == 1
    assert got[1].x.n == 296 and got[1].x.anchors == got[1].s[:8] and got[3].x.n == 0


def test_hashes_of_a_batch_lie_in_one_buffer():
    """No text's hashes are held beside the buffer: what was appended is gone when the next but one is made."""
    made, alive = [], []

    def found():
        for k in range(2000):
            x = np.arange(k % 5, dtype=np.int64) - k
            made.append(weakref.ref(x))
            alive.append(sum(r() is not None for r in made[-10:]))
            yield x

    got = near._lists(found())
    assert got.to_pylist() == [[j - k for j in range(k % 5)] for k in range(2000)]
    assert max(alive) <= 2
    assert near._lists(iter([])).to_pylist() == []


def test_only_sets_that_share_a_couple_are_asked_for(spark):
    rnd = random.Random(3)
    fresh = lambda n: sorted(rnd.sample(range(1 << 60), n))
    base = fresh(60)
    sets = {1: base, 2: base, 3: sorted([*base[:-2], *fresh(2)]), **{k: fresh(50) for k in range(4, 30)}}
    asked = []

    def fetch(ids):
        asked.extend(r.id for r in ids.collect())
        return spark.createDataFrame([(k, sets[k]) for k in asked], "id long, sketch array<bigint>")

    rows = [(k, len(s), s[:8], hashlib.sha256(repr(s).encode()).digest()) for k, s in sets.items()]
    links = near.loose_links(spark.createDataFrame(rows, "id long, n int, anchors array<bigint>, digest binary"), fetch)
    assert sorted((r.a, r.b) for r in links.collect()) == [(1, 2), (1, 3)]
    assert sorted(asked) == [1, 3]


def test_no_bucket_is_skipped(spark):
    base = list(range(1000, 1060))
    rows = [(k, [*base, 10**6 + k]) for k in range(600)]
    got = near.near_classes(spark.createDataFrame(rows, "id long, sketch array<bigint>"), 0.85, None)
    assert got.skipped.count() == 0 and got.links.count() == 600 * 599 // 2


def test_pairs_whose_sizes_rule_them_out_are_not_dealt(spark, monkeypatch):
    """Also where full buckets are skipped: sketches of 40, 41 and 60 hashes share their bands, and only the first two can be alike."""
    asked, similar = [], near._similar

    def watched(pairs, *rest):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return similar(pairs, *rest)

    monkeypatch.setattr(near, "_similar", watched)
    rows = [(k, list(range(n))) for k, n in ((1, 40), (2, 41), (3, 60))]
    got = near.near_classes(spark.createDataFrame(rows, "id long, sketch array<bigint>"), 0.85)
    assert asked == [(1, 2)] and [(r.a, r.b, round(r.similarity, 6)) for r in got.links.collect()] == [(1, 2, round(40 / 41, 6))]


def test_pairs_of_full_buckets_and_copies(spark, tmp_path):
    """520 edited texts in the same buckets, and copies: every pair of different texts, every copy, and the first pairs across the splits."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words, f"end{k}"]) for k in range(520)] + [" ".join([*words, f"end{k}"]) for k in range(40)] + ["one more text of its own"] * 30
    rows = [(k, t, "en", "src1", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("near_dup_pairs", "near_dup_cross_split"):
        got = sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(db.sql(registry.ORACLES[name]).fetchall())
        assert len(got) > 120_000 and sum(r[2] == 1 for r in got) == 69 if name == "near_dup_pairs" else len(got) == 100


def test_first_cross_pairs(spark):
    """Against all pairs: classes of many members, near ones on both sides, and ties."""
    rnd = random.Random(7)
    ids = rnd.sample(range(1000), 300)
    members = [(i, [min(ids[k::6]) for k in range(6)][n % 6], 50) for n, i in enumerate(ids)]
    names = sorted({c for _, c, _ in members})
    links = [(names[0], names[1], 0.9), (names[1], names[2], 0.95), (names[3], names[4], 0.9)]
    found = near.NearClasses(spark.createDataFrame(members, "id long, class long, copies long"), spark.createDataFrame(links, "a long, b long, similarity double"), None)
    alike = {(c, c): 1.0 for c in names} | {(a, b): s for a, b, s in links} | {(b, a): s for a, b, s in links}
    for most, train in ((100, lambda i: i % 10 < 7), (30, lambda i: i > 500), (3000, lambda i: i % 50 == 0)):
        want = sorted((-alike[c, d], a, b) for a, c, _ in members for b, d, _ in members if train(a) and not train(b) and (c, d) in alike)[:most]
        assert [(-r.similarity, r.a, r.b) for r in near.first_cross_pairs(found, lambda c: train_column(c, most), most).collect()] == want


def train_column(c, most):
    return {100: c % 10 < 7, 30: c > 500, 3000: c % 50 == 0}[most]


def test_joint_limits_from_counts_that_add_up(spark):
    """The same reasons by whole joint texts and by sums; the count of a state is taken from its column."""
    rows = [(1, "a b, c", ["x", "y z"]), (2, " a. b ", ["p", "q r s t u v w"]), (3, "w " * 30, ["x", "y"]), (4, "w " * 12, ["x!", "y"]), (5, None, ["x", "y"])]
    df = spark.createDataFrame(rows, "id long, state string, texts array<string>")
    n = lambda c: F.regexp_count(c, F.lit(WORD_OR_MARK))
    df = df.withColumn("known", n(F.col("state")))
    sums = lambda x: F.col("known") + n(F.lit(heads.SEPARATOR)) + n(x)
    got = df.select(heads.request_error(F.col("state"), F.col("texts"), n, 20, 5, 16).alias("whole"), heads.request_error(F.col("state"), F.col("texts"), n, 20, 5, 16, F.col("known"), sums).alias("sums")).collect()
    assert [r.whole for r in got] == [r.sums for r in got] == [None, "long candidate", "long state", "long joint input", "empty state"]


def long_texts(spark, folder):
    """Texts of over 16,000 characters: copies but for words in the middle, and two with a middle of their own."""
    rnd = random.Random(11)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    head, middle, tail = words(1500), words(1500), words(1500)
    texts = [" ".join([*head, *middle[:700], f"x{k}", *middle[701:], *tail]) for k in range(6)]
    texts += [" ".join([*head, *words(4000), *tail]) for _ in range(2)] + ["A short text, of its own.", "", None]
    rows = [(k, t, "en", "src1", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return texts, db


def test_sketch_of_whole_texts(spark, tmp_path):
    """The middle of a long text is hashed as well, in SQL and code."""
    texts, db = long_texts(spark, tmp_path)
    got = {r.id: r for r in registry.QUERIES["shingle_sketch"](spark, str(tmp_path)).collect()}
    assert sorted(tuple(r) for r in got.values()) == sorted(db.sql(registry.ORACLES["shingle_sketch"]).fetchall())
    for k, text in enumerate(texts[:8]):
        want = hashes(text.lower().split())[:512]
        assert (got[k].n, got[k].least, got[k].greatest) == (512, want[0], want[-1])


def test_words_of_a_long_text_are_taken_in_parts():
    text = "one, two three. four five six seven one, two three. four five" * 20
    for width, most, least, marks in ((5, 512, 1, True), (5, None, 20, False), (1, 3, 1, True), (5, 9, 10**6, True), (500, None, 1, True)):
        want = near._hashes(text, width, most, least, marks).tolist()
        assert all(near._hashes(text, width, most, least, marks, some).tolist() == want for some in (1, 2, 4, 5, 100))
    assert near._hashes("one, two three", 5, None, 1, True, 1).tolist() == near._hashes("one, two three", 5, None, 1, True).tolist() != []


def test_pairs_by_whole_texts(spark, tmp_path):
    """Texts whose ends are equal and whose middles are not are no pair; those with one other word in the middle are linked."""
    _, db = long_texts(spark, tmp_path)
    got = sorted(tuple(r) for r in registry.QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect())
    assert got == sorted(db.sql(registry.ORACLES["near_dup_pairs"]).fetchall())
    assert {k for r in got for k in r[:2]} == set(range(6))


def test_cross_pairs_by_whole_texts(spark, tmp_path):
    """The same across the splits: nothing joins a text to one that has its ends alone."""
    _, db = long_texts(spark, tmp_path)
    got = [tuple(r) for r in registry.QUERIES["near_dup_cross_split"](spark, str(tmp_path)).collect()]
    assert got == db.sql(registry.ORACLES["near_dup_cross_split"]).fetchall()
    assert got and {k for r in got for k in r[:2]} <= set(range(6))


def full_buckets(spark, folder):
    """1,300 texts that differ in their last word: most of their buckets have over 500 classes."""
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words, f"end{k}"]), "en", f"src{k % 5}", 300) for k in range(1300)] + [(1300 + k, f"text {k} of its own kind", "de", "src1", 20) for k in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return db


def test_greedy_selection_skips_no_bucket(spark, tmp_path):
    """The first held-out one of the edited texts bars nearly all others (some pairs share no band): not so where full buckets are skipped."""
    db = full_buckets(spark, tmp_path)
    got = sorted(tuple(r) for r in registry.QUERIES["greedy_selection"](spark, str(tmp_path)).collect())
    assert got == sorted(db.sql(registry.ORACLES["greedy_selection"]).fetchall())
    assert sum(r[1] == "en" for r in got) < 5


def test_repair_digests_skip_no_bucket(spark, tmp_path):
    """Training rows that are near a held-out one only by full buckets go as well."""
    db = full_buckets(spark, tmp_path)
    got = sorted(tuple(r) for r in registry.QUERIES["repair_digests"](spark, str(tmp_path)).collect())
    assert got == sorted(db.sql(registry.ORACLES["repair_digests"]).fetchall())
    assert {r[0]: r[1] for r in got}["train_after"] < 100


def test_components_keep_sketches_of_candidates_alone(spark, tmp_path, monkeypatch):
    """Of 300 unlike texts no sketch is kept, and they take no part in the rounds; couples count in the same place alone."""
    rnd = random.Random(13)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(6, 90))) for _ in range(300)]
    texts += [" ".join([*words[:k], "other", *words[k:]]) for k in (0, 100, 200, 300)] + [" ".join(words)] * 2 + ["one two", "one two", "", None]
    rows = [(k, t, "en", "src1", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    kept, rounds, materialised = set(), [], near.materialised

    def watched(df):
        out = materialised(df)
        if "sketch" in out.columns:
            kept.update(r.id for r in out.collect())
        if "was" in out.columns:
            rounds.append(out.count())
        return out

    monkeypatch.setattr(near, "materialised", watched)
    got = sorted(tuple(r) for r in registry.QUERIES["near_dup_components"](spark, str(tmp_path)).collect())
    assert got == sorted(db.sql(registry.ORACLES["near_dup_components"]).fetchall())
    assert kept and kept <= set(range(300, 306)) and rounds and max(rounds) <= 6
    assert sum(r[0] != r[1] for r in got) >= 4
