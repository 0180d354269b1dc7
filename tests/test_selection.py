"""Selections, places, classes and repair against plain loops."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import digests, greedy, near, ranks, repair, sampling, sequences


def plain_pass(rows, links, quota, cap):
    linked = defaultdict(set)
    for a, b in links:
        linked[a].add(b)
        linked[b].add(a)
    used, classes, cells, labels, out = set(), set(), Counter(), Counter(), set()
    for place, cell, label, keys, cls, blocks in sorted(rows):
        if used & set(keys) or cls is not None and ({cls} | linked[cls]) & classes or cells[cell] >= quota or labels[cell, label] >= cap:
            continue
        out.add(place)
        used |= set(keys)
        cells[cell] += 1
        labels[cell, label] += 1
        if blocks and cls is not None:
            classes.add(cls)
    return out


@pytest.mark.parametrize("seed, n, quota, cap, classes, groups", [(1, 120, 8, 3, 40, 60), (2, 150, 100, 100, 20, 30), (3, 100, 3, 1, 5, 90), (4, 80, 10, 4, 200, 3)])
def test_greedy_rounds(spark, seed, n, quota, cap, classes, groups):
    rnd = random.Random(seed)
    cells = ["a/x", "a/y", "b/x", "b/y"]
    rows = []
    for place in range(n):
        cell = cells[4 * place // n]
        group = rnd.choice([0, rnd.randrange(groups), rnd.randrange(groups)])  # one group has a third of the rows
        rows.append((place, cell, rnd.choice(["l", "m", None]), [f"g:{group}", f"s:{rnd.randrange(groups * 3)}"], rnd.choice([None, rnd.randrange(classes)]), cell[0] == "a" or rnd.random() < 0.3))
    links = [(a, b) for a, b in {tuple(sorted(rnd.sample(range(classes), 2))) for _ in range(classes)}]
    df = spark.createDataFrame(rows, "place long, cell string, label string, keys array<string>, class long, blocks boolean").repartition(4)
    got = greedy.greedy(df, spark.createDataFrame(links, "a long, b long"), quota, cap, ahead=2)
    assert {r.place for r in got.collect()} == plain_pass(rows, links, quota, cap)


def test_greedy_empty(spark):
    rows = spark.createDataFrame([], "place long, cell string, label string, keys array<string>, class long, blocks boolean")
    assert greedy.greedy(rows, spark.createDataFrame([], "a long, b long"), 3, 3).count() == 0


def test_placed(spark):
    rnd = random.Random(7)
    rows = [(k, rnd.choice([None, "a", "b", "ü"]), rnd.choice([None, rnd.randrange(100)])) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, name string, size int").repartition(7)
    got = {r.id: r for r in ranks.placed(df, "name", -F.col("id"), size=F.col("size")).collect()}
    start = 0
    for place, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), -r[0]))):
        assert (got[r[0]].place, got[r[0]].start) == (place, start)
        start += r[2] or 0
    within = {r.id: r.place for r in ranks.placed_within(df, "name", "id").collect()}
    for name in (None, "a", "b", "ü"):
        assert [within[r[0]] for r in rows if r[1] == name] == list(range(sum(r[1] == name for r in rows)))
    assert ranks.placed(df.where("false"), "id").count() == 0


def test_placed_spreads_rows(spark):
    """No exchange brings the rows into one partition, and the order is cut into many."""
    df = spark.range(20_000).withColumn("name", F.lit("same"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.placed(df, "name", "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert got.rdd.getNumPartitions() > 1 and got.where("place <> id").count() == 0


def test_epoch_equals_a_plain_fold(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice("aaabcdefghijklmnopqrstuv"), rnd.randrange(50)) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, source string, size int")
    b = sequences.length_batches(df, "size", "id").select("id", "source", "size", "chunk", "inside")
    got = greedy.distinct_group_batches(b, "chunk", "inside", "source", 16).collect()
    chunks = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.chunk, r.inside)):
        chunks[r.chunk].append(r)
    assert sorted(map(len, chunks.values())) == [188, 256, 256]
    for rows_of in chunks.values():
        assert [(r["size"], r.id) for r in rows_of] == sorted((r["size"], r.id) for r in rows_of)
        left, k = list(rows_of), 0
        while left:
            seen, later = {}, []
            for r in left:
                if len(seen) < 16 and r.source not in seen:
                    seen[r.source] = r
                else:
                    later.append(r)
            assert all(r.batch == k for r in seen.values())
            left, k = later, k + 1


def test_classes_of_many_edited_copies(spark):
    """One sketch edited 5,000 times and copied 3,000 times: full buckets are skipped, and links stay in proportion."""
    rnd = random.Random(5)
    base = sorted(f"{x:016x}" for x in rnd.sample(range(1 << 62), 60))
    rows = [(k, base) for k in range(3000)]
    for k in range(3000, 8000):
        edited = list(base)
        edited[rnd.randrange(60)] = f"{rnd.randrange(1 << 62):016x}"
        rows.append((k, sorted(edited)))
    got = near.near_classes(spark.createDataFrame(rows, "id long, sketch array<string>"), 0.85, most=50)
    assert got.members.where("class = 0").count() >= 3000 and got.skipped.count() > 10
    assert got.links.count() <= 16 * 50 * 5001 / 2


def test_cross_pairs(spark):
    base = [f"{k:04x}" for k in range(40)]
    rows = [(1, base, True), (2, base[:-1] + ["ffff"], False), (3, base, True), (4, ["a", "b", "c", "d"], False)]
    got = near.cross_pairs(spark.createDataFrame(rows, "id long, sketch array<string>, side boolean"), "side", 0.85, 200).collect()
    assert sorted((r.a, r.b) for r in got) == [(1, 2), (3, 2)]
    assert near.cross_pairs(spark.createDataFrame(rows, "id long, sketch array<string>, side boolean"), "side", 0.85, 2).count() == 0


def test_links_have_all_components(spark):
    """A chain whose members share a bucket without a common leader, and copies."""
    rnd = random.Random(9)
    sketches = []
    for c in range(6):
        base = sorted(rnd.sample(range(10**6), 60))
        for _ in range(12):
            base = sorted(set(base[:32] + rnd.sample(base[32:], len(base) - 34) + rnd.sample(range(10**6, 10**7), 2)))
            sketches.append([f"{x:08d}" for x in base])
    rows = [(k, s) for k, s in enumerate(sketches + sketches[:5])]
    df = spark.createDataFrame(rows, "id long, sketch array<string>")
    got = {r.id: r.component for r in near.components(near.near_links(df, 0.85), df).collect()}
    want = {k: k for k, _ in rows}
    key = lambda s: {(i, s[2 * i], s[2 * i + 1]) for i in range(min(len(s), 32) // 2)}
    for a, s in rows:
        for b, t in rows:
            if a < b and key(s) & key(t) and len(set(s) & set(t)) >= 0.85 * len(set(s) | set(t)):
                lo, hi = sorted((want[a], want[b]))
                want = {k: lo if v == hi else v for k, v in want.items()}
    assert got == want


@pytest.mark.parametrize("wide", [2, 10])
def test_most_alike(spark, wide):
    rnd = random.Random(wide)
    vocab = [f"w{k}" for k in range(12)]
    rows = [(k, [w for w in vocab if rnd.random() < 0.15] + ["common"] * (k % 3 > 0)) for k in range(90)] + [(90, []), (91, None), (92, vocab), (93, ["alone"]), (94, ["common", None, "common"])]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    got = defaultdict(list)
    for r in sampling.most_alike(df, 3, lambda c: F.sha2(c.cast("string"), 256), wide).collect():
        got[r.id].append((r.other, r.shared))
    import hashlib

    sets = {k: {x for x in w or [] if x is not None} for k, w in rows}
    for k, w in sets.items():
        others = sorted((-len(w & v), hashlib.sha256(str(i).encode()).hexdigest(), i) for i, v in sets.items() if i != k)[:3]
        assert sorted(got[k]) == sorted((i, -s) for s, _, i in others)


ROW = "id string, group string, train boolean, metric string, source string, target int, candidates array<string>, state string"


def repair_rows():
    """h is held out; t1 is near it; t2 shows what t1 alone owns, t3 shows what t2 alone owns, t4 shows what t5 owns too."""
    return [
        ("h", "gh", False, "choice", "a", 0, ["x", "y"], "s0"), ("t1", "g1", True, "choice", "a", 0, ["one", "z"], "s1"), ("t2", "g2", True, "choice", "a", 1, ["one", "two"], "s2"), ("t3", "g3", True, "choice", "a", 0, ["three", "two"], "s3"),
        ("t4", "g4", True, "choice", "a", 0, ["four", "shared"], "s4"), ("t5", "g5", True, "choice", "a", 0, ["shared", "five"], "s5"), ("t1b", "g1", True, "choice", "a", 0, ["shared", "six"], "s6"), ("t7", "g7", True, "ordinal", "a", 0, ["seven", "x"], "s7"),
        ("t8", "g1", True, "choice", "pref", 0, ["eight", "nine"], "s8"), ("t9", "g9", True, "choice", "a", None, ["nine", None], "s9"), ("h", "g10", True, "choice", "a", 0, ["ten"], "s10"), ("d", "g11", True, "choice", "a", 0, ["eleven"], "s11"), ("d", "g12", True, "choice", "a", 5, ["twelve"], "s12"), (None, None, True, "choice", "a", 0, ["one"], None),
    ]


def test_repair_takes_two_passes(spark):
    rows = spark.createDataFrame(repair_rows(), ROW)
    got = repair.repair(rows, spark.createDataFrame([("g1",), ("gh",)], "group string"), 100, ["state"], ["pref"])
    kept = {(r.id, r.group): (r.reason, r["pass"], r.new_id) for r in got.train.collect()}
    assert kept["t1", "g1"] == ("near", 0, None) and kept["t2", "g2"] == ("candidate", 1, None) and kept["t3", "g3"] == ("candidate", 2, None) and kept["t9", "g9"] == ("candidate", 1, None)
    assert kept["t4", "g4"] == (None, None, "t4") and kept["t7", "g7"][0] is None and kept[None, None][0] is None
    names = [kept[k][2] for k in (("h", "g10"), ("d", "g11"), ("d", "g12"))]
    assert len(set(names)) == 3 and names[0].startswith("h:input-") and names[1].startswith("d:input-")
    d = {r.part: r for r in got.digests.collect()}
    assert d["held_out_before"].digest == d["held_out_after"].digest and d["held_out_after"].rows == 1 and d["train_after"].rows == 7


def test_repair_refuses(spark):
    rows = spark.createDataFrame(repair_rows(), ROW)
    direct = spark.createDataFrame([("g1",)], "group string")
    with pytest.raises(ValueError, match="more than 5"):
        repair.repair(rows, direct, 5, ["state"], ["pref"])
    with pytest.raises(ValueError, match="repeated"):
        repair.repair(rows.union(rows.where("id = 'd'")), direct, 100, ["state"], ["pref"])
    assert repair.repair(rows.where("false"), direct, 0, ["state"], []).train.count() == 0


def test_table_digest(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "ab")], "k int, x string")
    one = lambda d: tuple(digests.table_digest(d).first())
    assert one(df) == one(df.orderBy(F.desc("k")).repartition(3)) and len(one(df)[1]) == 32
    assert one(df) != one(df.union(df.limit(1))) and one(df) != one(df.union(df).union(df)) and one(df.where("false")) == (0, "0" * 32)
    assert one(spark.createDataFrame([("a", "bc")], "x string, y string")) != one(spark.createDataFrame([("ab", "c")], "x string, y string"))
    assert one(spark.createDataFrame([(None, "-")], "x string, y string")) != one(spark.createDataFrame([("-", None)], "x string, y string"))


def test_shared_runs(spark):
    """Runs of three words against plain sets, with and without the filter; texts with repeats, short and null ones."""
    from millrace.operators import grams

    rnd = random.Random(4)
    some = lambda n: " ".join(rnd.choice(["a", "B", "ü", "dd", "e"]) for _ in range(n))
    rows = [(k, some(rnd.choice([0, 2, 3, 30]))) for k in range(30)] + [(30, None), (31, "a a a a a")]
    items = [(k, some(6)) for k in range(8)] + [(9, None)]
    runs = lambda t: {tuple(w[k : k + 3]) for w in [(t or "").lower().split()] for k in range(len(w) - 2)}
    want = {(d, i, " ".join(g)) for d, t in rows for i, x in items for g in runs(t) & runs(x)}
    left, right = spark.createDataFrame(rows, "doc long, text string"), grams.word_runs(spark.createDataFrame(items, "item long, text string"), 3)
    held = grams.held_hashes(right)
    assert len(held) == len({g for _, x in items for g in runs(x)}) and grams.held_hashes(right, most=2) is None
    for only in (None, held):
        got = grams.word_runs(left, 3, only)
        assert {(r.doc, r.item, r.run) for r in got.join(right.drop("hash"), "run").collect()} == want and want
    assert {(r.doc, r.run) for r in grams.word_runs(left, 3).collect()} == {(d, " ".join(g)) for d, t in rows for g in runs(t)}
    assert grams.word_runs(left, 3, held[:0]).count() == 0


def plain_round_robin(rows, strata, quota, most, per_group, late):
    """Every stratum in sweeps over all families, over all rows."""
    chosen, groups, long_families, out = [], Counter(), set(), []
    for s in strata:
        mine = sorted((r for r in rows if s in r[1]), key=lambda r: r[4])
        families = sorted({r[2] for r in mine}, key=lambda f: (s == late and f not in long_families, f))
        place, n, moved = Counter(), 0, True
        while moved and n < quota and len(chosen) < most:
            moved = False
            for f in families:
                pool = [r for r in mine if r[2] == f]
                while place[f] < len(pool):
                    r = pool[place[f]]
                    place[f] += 1
                    if r[0] not in chosen and groups[r[3]] >= per_group:
                        continue
                    if r[0] not in chosen:
                        chosen.append(r[0])
                        groups[r[3]] += 1
                        if s != late:
                            long_families.add(f)
                    out.append((r[0], s, n))
                    n, moved = n + 1, True
                    break
                if n >= quota or len(chosen) >= most:
                    break
    return out


@pytest.mark.parametrize("seed, families, groups, quota, most", [(1, 3, 5, 6, 20), (2, 40, 200, 4, 16), (3, 2, 2, 5, 20), (4, 8, 30, 12, 48), (5, 60, 3, 3, 6)])
def test_constrained_round_robin(spark, seed, families, groups, quota, most):
    rnd = random.Random(seed)
    strata = ["b", "c", "d", "a"]
    rows = [(k, rnd.sample(strata, rnd.choice([0, 1, 1, 1, 2])), f"f{rnd.randrange(families):02}", rnd.choice([0, rnd.randrange(groups)]), f"{rnd.random():.12f}") for k in range(300)]
    df = spark.createDataFrame(rows, "id long, strata array<string>, family string, group long, key string").repartition(4)
    got = sampling.constrained_round_robin(df, strata, quota, most, 2, late="a").collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_round_robin(rows, strata, quota, most, 2, "a"))
    order = [r.id for r in sorted(sampling.interleaved(spark.createDataFrame(got), ["a", "b", "c", "d"]).collect(), key=lambda r: r.place)]
    seen = dict.fromkeys(r.id for r in sorted(got, key=lambda r: (r.turn, "abcd".index(r.stratum))))
    assert order == list(seen)


def test_most_alike_does_not_rank_by_label(spark):
    """The labels of a kind share one list: no window (and so no sort) over all labels times n + 1."""
    df = spark.createDataFrame([(k, ["a", f"w{k % 3}"]) for k in range(200)], "id long, words array<string>")
    found = sampling.most_alike(df, 3, lambda c: F.sha2(c.cast("string"), 256))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(" in plan and "windowspecdefinition(id#" not in plan
    assert found.count() == 600
