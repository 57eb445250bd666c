"""Distributed operators against brute force and on awkward inputs."""

import itertools
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vellumry.functions import text
from vellumry.operators import copydiff, documents, incremental, manifest, references
from vellumry.options import FormatOptions
from vellumry.runtime import bucket_of, checkpointed, hot_buckets, micros, running, split_hot

CASE = "id string, a string, b string, c string"


def rows(df):
    return Counter(map(tuple, df.collect()))


# -- differences of copies -----------------------------------------------------------------


def test_pairs_are_least():
    rng = random.Random(5)
    for _ in range(400):
        fields, values = rng.randrange(1, 5), rng.randrange(1, 4)
        make = lambda: list({tuple(rng.choice([None, *range(values)]) for _ in range(fields)) for _ in range(rng.randrange(1, 5))})  # noqa: B023, E731
        left, right = make(), make()
        supply, demand = [rng.randrange(1, 3) for _ in left], [rng.randrange(1, 3) for _ in right]
        few, many = sorted(([x for x, n in zip(left, supply) for _ in range(n)], [x for x, n in zip(right, demand) for _ in range(n)]), key=len)
        wrong, over_left, over_right = copydiff.least_differences(left, supply, right, demand)
        if len(many) <= 6:
            assert sum(wrong) == min(sum(sum(x != y for x, y in zip(few[i], many[j])) for i, j in enumerate(p)) for p in itertools.permutations(range(len(many)), len(few)))
        assert over_left - over_right == sum(supply) - sum(demand) and not min(over_left, over_right)


def test_many_rows_of_a_key_are_paired_in_time():
    rng = random.Random(6)
    make = lambda: list({(rng.randrange(300), rng.randrange(300), rng.randrange(300)) for _ in range(10_000)})
    left, right = make(), make()
    start = time.time()
    wrong, _, _ = copydiff.least_differences(left, [600] * len(left), right, [600] * len(right))  # copies are not unrolled
    assert time.time() - start < 60 and sum(wrong) % 600 == 0


def brute_differences(left, right):
    """Total of differing fields and of rows on one side only, per key, by trying all pairings."""
    out = {}
    for key in {r[0] for r in left + right}:
        a, b = Counter(r[1:] for r in left if r[0] == key), Counter(r[1:] for r in right if r[0] == key)
        a, b = list((a - b).elements()), list((b - a).elements())
        few, many = sorted((a, b), key=len)
        cost = min(sum(sum(x != y for x, y in zip(few[i], many[j])) for i, j in enumerate(p)) for p in itertools.permutations(range(len(many)), len(few)))
        out[key] = (cost, max(0, len(a) - len(b)), max(0, len(b) - len(a)))
    return {k: v for k, v in out.items() if any(v)}


@pytest.mark.parametrize("exact_rows,most,exact", [(128, 0, True), (0, 128, True), (0, 0, False)])
def test_copy_differences(spark, exact_rows, most, exact):
    rng = random.Random(3)
    make = lambda n: [(rng.choice(["k1", "k2", None]), rng.choice(["x", "", None]), rng.choice(["x", "y"]), rng.choice(["p", None])) for _ in range(n)]
    left, right = make(14), make(12)
    found = copydiff.copy_differences(spark.createDataFrame(left, CASE), spark.createDataFrame(right, CASE), ["id"], ["a", "b", "c"], exact_rows=exact_rows, most=most)
    got = defaultdict(lambda: [0, 0, 0])
    for r in found.collect():
        got[r["id"]][{"only_left": 1, "only_right": 2}.get(r["diff"], 0)] += r["n"]
    want = brute_differences(left, right)
    assert got.keys() == want.keys()
    for k, (cost, a, b) in want.items():
        assert tuple(got[k][1:]) == (a, b)
        assert got[k][0] == cost if exact else got[k][0] >= cost


def test_hot_keys_are_paired_at_least_cost(spark):
    rng = random.Random(8)
    make = lambda n: [("hot", f"a{rng.randrange(40)}" if rng.random() < 0.8 else None, f"b{rng.randrange(60)}", rng.choice(["same", "same"])) for _ in range(n)] + [
        ("parts", f"x{k // 3}.{rng.randrange(3)}", f"y{k // 3}.{rng.randrange(3)}", f"z{k}.{rng.randrange(2)}") for k in range(n // 2)]
    left, right = (spark.createDataFrame(make(n), CASE) for n in (330, 300))
    totals = {}
    for rows_, most in ((100_000, 0), (20, 1500), (20, 0)):
        found = copydiff.copy_differences(left, right, ["id"], ["a", "b", "c"], exact_rows=rows_, most=most).collect()
        totals[rows_, most] = {k: tuple(sum(r["n"] for r in found if r["id"] == k and (r["diff"] == x if x else r["diff"] in "abc")) for x in (None, "only_left", "only_right")) for k in ("hot", "parts")}
    assert totals[20, 1500] == totals[100_000, 0]
    for k, (cost, *ends) in totals[20, 0].items():  # parts too large for that: all rows, at some excess
        assert cost >= totals[20, 1500][k][0] and ends == list(totals[20, 1500][k][1:])


def test_differences_are_the_same_whatever_size_is_large(spark):
    rng = random.Random(9)
    make = lambda n: [("hot", f"a{rng.randrange(30)}" if rng.random() < 0.9 else None, f"b{rng.randrange(40)}", "same") for _ in range(n)] + [
        ("parts", f"x{k // 4}.{rng.randrange(2)}", f"y{k // 4}", f"z{k // 4}.{rng.randrange(3)}") for k in range(n)]
    left, right = (spark.createDataFrame(make(n), CASE) for n in (260, 240))
    found = [rows(copydiff.copy_differences(left, right, ["id"], ["a", "b", "c"], exact_rows=n, most=most)) for n, most in ((100_000, 100_000), (20, 100_000), (20, 20), (20, 0))]
    assert found[0] and all(x == found[0] for x in found)  # field by field, not only in sum


def test_parts_count_the_same_alone_or_together():
    rng = random.Random(10)
    part = lambda p: list({(f"{p}", f"{p}{rng.randrange(3)}", f"{p}{rng.randrange(4)}") for _ in range(8)})
    sides = [(part(p), part(p)) for p in "abcdef"]
    alone = [copydiff.least_differences(x, [1] * len(x), y, [1] * len(y)) for x, y in sides]
    left, right = ([r for s in sides for r in s[i]] for i in (0, 1))
    wrong, over_left, over_right = copydiff.least_differences(left, [1] * len(left), right, [1] * len(right))
    ends = sum(a for _, a, _ in alone), sum(b for _, _, b in alone)
    assert wrong == [sum(w[f] for w, _, _ in alone) + min(ends) for f in range(3)] and over_left - over_right == ends[0] - ends[1]


def test_copy_differences_of_empty_tables(spark):
    none, one = spark.createDataFrame([], CASE), spark.createDataFrame([("k", "1", None, "")], CASE)
    diff = lambda a, b: rows(copydiff.copy_differences(a, b, ["id"], ["a", "b", "c"]))
    assert diff(none, none) == Counter() and diff(one, one) == Counter()
    assert diff(one, none) == Counter([("k", "only_left", 1)]) and diff(none, one) == Counter([("k", "only_right", 1)])


def test_latest_differences(spark):
    schema = "id string, revision int, at int, a string, b string, _n string"
    left = spark.createDataFrame([("x", 1, 1, "old", None, "z"), ("x", 2, 1, "new", None, "z"), ("y", 1, 1, "t" * 100_000, "", "z"), ("l", None, 1, None, None, "z")] * 2, schema)
    right = spark.createDataFrame([("x", 5, 1, "new", None, "q"), ("y", 1, 1, "t" * 100_000, None, "q"), ("r", 1, 1, "", "", "q")], schema)
    found = copydiff.latest_differences(left, right, "id", ["revision", "at"], ["a", "b"])
    assert rows(found.select("id", "diff")) == Counter([("y", "b"), ("l", "only_left"), ("r", "only_right")])


# -- running aggregates and hot keys ---------------------------------------------------------


@pytest.mark.parametrize("how,descending", [("sum", False), ("min", True), ("max", False)])
def test_running(spark, how, descending):
    rng = random.Random(7)
    data = [(rng.choice(["a", "b"]), rng.randrange(-50, 50), i, rng.choice([None, 1, 2, 9])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t bigint, i int, v int")
    got = {r["i"]: r["out"] for r in running(df, ["k"], "t", F.col("v"), how, "out", descending, [F.col("i")], bucket_us=7).collect()}
    order = sorted(data, key=lambda r: ((-r[1] if descending else r[1]), r[2]))
    for k in "ab":
        seen = []
        for _, _, i, v in (r for r in order if r[0] == k):
            if how == "sum":
                seen.append(v or 0)
                assert got[i] == sum(seen)
            else:
                assert got[i] == ({"min": min, "max": max}[how](seen) if seen else None)
                seen += [v] if v is not None else []


def test_hot_buckets_find_the_hot_key(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    hot = hot_buckets(df, ["k"], rows=5_000)
    cold, warm = split_hot(df, ["k"], hot)
    assert warm.where("k = 'hot'").count() == 20_000 and cold.where("k = 'hot'").count() == 0
    assert cold.count() + warm.count() == 60_000 and warm.first()["salts"] > 1


def test_micros_do_not_depend_on_the_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2025-03-30 02:30:00.000001' AS t")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(micros("t")).first()[0] == 1743301800000001
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


# -- references ----------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [False, True])
def test_orphans_against_brute_force(spark, monkeypatch, hot):
    rng = random.Random(11)
    ts = lambda n: None if n is None else f"2025-01-{1 + n // 24:02d} {n % 24:02d}:00:00"
    records = [(rng.choice("abc"), a := rng.randrange(100), rng.choice([None, a + rng.randrange(-5, 60)])) for _ in range(40)]
    refs = [(rng.choice(["a", "b", "c", "d", None]), rng.randrange(100), i) for i in range(150)]
    rec = spark.createDataFrame([(k, ts(a), ts(b)) for k, a, b in records], "k string, a string, b string").select("k", F.to_timestamp_ntz("a").alias("a"), F.to_timestamp_ntz("b").alias("b"))
    ref = spark.createDataFrame([(k, ts(t), i) for k, t, i in refs], "k string, t string, i int").select(F.col("k").alias("key"), micros(F.to_timestamp_ntz("t")).alias("at"), "i")
    if hot:
        monkeypatch.setattr(references, "hot_buckets", lambda df, keys: df.select(bucket_of(keys).alias("bucket")).distinct().withColumn("salts", F.lit(3)))
    got = {r["i"] for r in references.orphans(ref.unionByName(ref), references.existence(rec, F.col("k"), F.col("a"), F.col("b"))).collect()}
    assert got == {i for k, t, i in refs if k is not None and not any(k == r and a <= t and (b is None or b > t) for r, a, b in records)}


def test_counts_advance_as_if_counted_at_once(spark):
    refs = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3), ("c", 9, 4)], "key string, at bigint, i int")
    deltas = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("b", 5, -1), ("d", 2, 1), ("d", 3, -1)], "key string, at bigint, delta int")
    early, late = (lambda df: df.where("at <= 2")), (lambda df: df.where("at > 2"))
    state = references.advance(references.signed_counts(early(refs), early(deltas)), references.signed_counts(late(refs), late(deltas)))
    assert rows(state) == Counter([("a", 2, 1), ("b", 1, 0), ("c", 1, 0)])
    assert rows(references.current_orphans(state).select("key")) == Counter([("b",), ("c",)])


def test_keys_are_injective(spark):
    df = spark.createDataFrame([("a|1:b", None), ("a", "b"), ("a", None), ("a", ""), ("", "a")], "x string, y string")
    assert df.select(references.key_of(F.col("x"), F.col("y"))).distinct().count() == 5


def test_orphans_of_empty_tables(spark, data):
    t = lambda n: spark.read.parquet(f"{data}/{n}.parquet").limit(0)
    assert references.mapping_orphans(t("discovered_tests"), t("test_mapping"), t("mapping_checks")).count() == 0


# -- incremental processing ------------------------------------------------------------------


def brute_replay(runs, files):
    known = lambda h: int(h, 16) if h and all(c in "0123456789abcdefABCDEF" for c in h) and int(h, 16) < 1 << 64 else None
    out = set()
    for run, root, version, fp, hashes, code, at in runs:
        earlier = [r for r in runs if r[1] == root and r[5] == 0 and r[6] < at]
        done = set()
        if earlier:
            last = max(earlier, key=lambda r: (r[6], r[0]))
            if last[2] == 1 and known(last[3]) is not None and known(last[3]) == known(fp):
                done = {known(h) for h in last[4] or []} - {None}
        state = {}
        for r, path, h, gone, modified, landed in sorted(files, key=lambda f: (f[4], f[5])):
            if r == root and landed <= at:
                state[path] = (h, gone)
        out |= {(run, p) for p, (h, gone) in state.items() if not gone and known(h) not in done - {None}}
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_replay_against_brute_force(spark, monkeypatch, hot):
    if hot:  # every bucket counts as hot
        monkeypatch.setattr(incremental, "hot_buckets", lambda df, keys: df.select(bucket_of(keys).alias("bucket")).distinct().withColumn("salts", F.lit(3)))
    rng = random.Random(2)
    hashes = ["0a", "A", "00b", "c", "zz", "", None, "ffffffffffffffff", "10000000000000000"]
    runs = [(i, rng.choice(["r1", "r2"]), rng.choice([1, 1, 1, 2, None]), rng.choice(["f", "0F", "e", None]), rng.choice([None, rng.choices(hashes, k=4)]), rng.choice([0, 0, 1, None]), i * 10) for i in range(24)]
    files = [(rng.choice(["r1", "r2"]), rng.choice(["p", "q", "ü"]), rng.choice(hashes), rng.choice([False, None, True]), m := 7 * i, m + rng.choice([0, 3, 90])) for i in range(36)]
    stamp = lambda c: F.to_timestamp_ntz(F.timestamp_add("SECOND", F.col(c), F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00"))).cast("string"))
    r = spark.createDataFrame(runs * 2, "run_id bigint, project_root string, version int, formatter_fingerprint string, hashes array<string>, exit_code int, at int").withColumn("started_at", stamp("at"))
    f = spark.createDataFrame(files * 2, "project_root string, path string, content_hash string, deleted boolean, m int, l int").withColumn("modified_at", stamp("m")).withColumn("landed_at", stamp("l"))
    assert rows(incremental.replay(r, f)) == Counter(brute_replay(runs, files))
    assert rows(incremental.ledger_replay(r, f)) == Counter(brute_replay(runs, files))


def test_found_rows_are_leases_of_the_ledger(spark, data, monkeypatch):
    from vellumry.plans import data_queries

    t = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    want = rows(incremental.replay(t("cache_manifests"), t("tree_files")))
    monkeypatch.setattr(incremental, "replay", None)
    assert rows(data_queries.p4_found(spark, data)) == want and want


def test_ledger_of_a_root():
    ledger = incremental.RootLedger()
    ledger.enqueue("p", 7)
    ledger.enqueue("q", None)
    assert ledger.state("p", 1) == "pending" and sorted(ledger.lease(1, 10, 1)) == ["p", "q"] and ledger.state("p", 1) == "leased"
    assert sorted(ledger.lease(2, 20, 1)) == ["p", "q"]  # the first run was killed
    ledger.succeed(1, 1, 1)  # it comes back: fenced off
    ledger.complete(1, 7)
    assert sorted(ledger.lease(3, 30, 1)) == ["p", "q"]
    ledger.succeed(3, 1, 1)
    ledger.complete(3, 7)
    ledger.enqueue("p", 8)  # changed while it was leased
    assert ledger.state("p", 1) == "pending" and sorted(ledger.lease(4, 40, 1)) == ["p", "q"]
    ledger.enqueue("p", 7)
    assert ledger.state("p", 1) == "done" and ledger.lease(5, 50, 1) == ["q"] and sorted(ledger.lease(6, 60, 2)) == ["p", "q"]


def test_ledger_keeps_what_is_enqueued_while_leased(spark, tmp_path):
    ledger = incremental.Ledger(spark, str(tmp_path))
    item = spark.createDataFrame([("a",)], "item string")
    ledger.enqueue(item, "first", 0)
    token = ledger.lease(1, seconds=10)
    ledger.enqueue(item, "second", 2)  # changed after the worker had read it
    ledger.complete(token, 3)
    assert [r["state"] for r in ledger.state(4).collect()] == ["pending"]
    ledger.complete(ledger.lease(5, seconds=10), 6)
    assert [r["state"] for r in ledger.state(7).collect()] == ["done"]


def test_ledger_is_compacted(spark, tmp_path):
    ledger = incremental.Ledger(spark, f"file://{tmp_path}/shared")
    items = lambda *names: spark.createDataFrame([(n,) for n in names], "item string")
    state = lambda now: {r["item"]: r["state"] for r in ledger.state(now).collect()}
    ledger.enqueue(items("a", "b", "c"), "one", 0)
    first = ledger.lease(1, seconds=5)
    ledger.complete(first, 2, items("a"))
    want = [state(3), state(20)]
    ledger.compact()
    assert [state(3), state(20)] == want and want[1] == {"a": "done", "b": "pending", "c": "pending"}
    ledger.enqueue(items("a"), "two", 21)
    second = ledger.lease(22, seconds=5)
    ledger.compact()
    assert second > first and state(23) == {"a": "leased", "b": "leased", "c": "leased"}
    ledger.complete(second, 24)
    ledger.compact()
    assert state(25) == dict.fromkeys("abc", "done") and len(ledger.folder.names("events")) <= 4


def test_replay_of_empty_tables(spark, data):
    t = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    assert incremental.replay(t("cache_manifests").limit(0), t("tree_files")).count() == 0
    assert incremental.replay(t("cache_manifests"), t("tree_files").limit(0)).count() == 0


def test_ledger(spark, tmp_path):
    ledger = incremental.Ledger(spark, str(tmp_path))
    state = lambda now: {r["item"]: r["state"] for r in ledger.state(now).collect()}
    items = lambda *names: spark.createDataFrame([(n,) for n in names], "item string")
    ledger.enqueue(items("a", "b", "b"), "first", 0)
    ledger.enqueue(items("a", "b", "lost"), "first", 0)  # a retry of the same batch
    assert state(0) == {"a": "pending", "b": "pending"}
    one = ledger.lease(1, seconds=10)
    assert state(5) == {"a": "leased", "b": "leased"} and ledger.leased(ledger.lease(5, 10)).count() == 0
    assert state(12) == {"a": "pending", "b": "pending"}  # the worker died
    two = ledger.lease(12, seconds=10)
    ledger.complete(one, 13)  # the old worker comes back: fenced off
    assert state(13) == {"a": "leased", "b": "leased"}
    ledger.complete(two, 14, items("a"))
    ledger.complete(two, 14, items("a", "b"))  # a retry with other rows changes nothing
    assert state(15) == {"a": "done", "b": "leased"} and state(30) == {"a": "done", "b": "pending"}
    ledger.enqueue(items("a"), "second", 40)  # changed again
    assert state(41)["a"] == "pending"


# -- documents -----------------------------------------------------------------------------


def test_covered_against_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: [(rng.choice("xy"), a := rng.randrange(40), a + rng.randrange(6), i) for i in range(n)]
    left, right = make(60), make(25)
    schema = "k string, start bigint, end bigint, i int"
    got = rows(documents.covered(spark.createDataFrame(left * 2, schema), spark.createDataFrame(right, schema), "k"))
    assert got == Counter(x for x in left * 2 if any(x[0] == y[0] and y[1] < y[2] and (x[1] < y[2] and y[1] < x[2] if x[1] < x[2] else y[1] < x[1] < y[2]) for y in right))


def test_format_documents(spark):
    df = spark.createDataFrame([(1, bytearray(b"a\r\nb")), (2, bytearray(b"\xff")), (3, None), (4, bytearray(b""))], "id int, text binary")
    got = {r["id"]: (r["formatted"], r["changed"], r["error"]) for r in documents.format_documents(df).collect()}
    assert got[1] == ("a b\n", True, None) and got[2] == (None, None, "invalid UTF-8") and got[3] == (None, None, None) and got[4] == ("\n", True, None)
    twice = documents.format_documents(spark.createDataFrame([(1, "x\n")], "id int, text string").withColumn("formatted", F.lit("clash")))
    assert twice.first()["formatted"] == "x\n" and not twice.first()["changed"]


def test_tables_of_structure(spark):
    df = spark.createDataFrame([(1, "# T\n\n- a\n- b `c`\n"), (2, None), (3, "")], "id int, text string")
    kinds = [(r["id"], r["kind"], r["parent"]) for r in documents.blocks(df, ["id"]).orderBy("id", "ord").collect()]
    assert kinds == [(1, "heading", -1), (1, "list", -1), (1, "item", 1), (1, "paragraph", 2), (1, "item", 1), (1, "paragraph", 4)]
    assert [r["source"] for r in documents.regions(df, ["id"]).collect()] == ["`c`"]
    assert [r["kind"] for r in documents.lines(df, ["id"]).where("id = 1").orderBy("i").collect()] == ["heading", "blank", "list", "list"]
    assert documents.sentences(df, ["id"]).count() == 1 and documents.words(df, ["id"]).count() == 7


def test_native_functions_on_very_long_texts(spark):
    long = ["a" * 1_000_000, "\n" * 200_000 + "x", "|" * 100_000, "|-" * 100_000 + "|", "- " * 100_000, "---\n" * 50_000, "Ab. " * 100_000, "`" * 200_000, " " * 300_000, "{%" * 100_000, "#" * 100_000, "[x][y" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "id int, text string")
    start = time.time()
    assert documents.lines(df, ["id"]).groupBy("kind").count().count() > 2
    assert documents.sentences(df, ["id"]).count() == 100_000 + sum(bool(t.strip()) for t in long) - 1
    assert documents.words(df, ["id"], atomic=False).count() > 0 and documents.words(df, ["id"]).count() > 0
    assert documents.references(df, ["id"]).count() >= 0
    c = F.col("text")
    assert df.select(text.front_matter(text.normalize_source(c)).alias("f"), text.fence_length(c, F.lit(0)), text.common_indent(c), text.join_adjacent(c), text.hard_break_pieces(c)).where("f <> ''").count() == 1
    assert documents.format_documents(df).where("formatted is null").count() == 0
    assert time.time() - start < 120


def test_references_last_definition_wins(spark):
    df = spark.createDataFrame([(1, "[a][X] [b][x] [c][y]\n\n[x]: one\n[X]: two\n"), (2, None), (3, "[p][] [P] [q] [r](p) `[p]` ![p] \\[p]\n\n```\n[p]\n[q]: no\n```\n\n[p]: /p\n"), (4, "")], "id int, text string")
    assert rows(documents.references(df, ["id"])) == Counter([(1, "x", "two", 2), (1, "y", None, 1), (3, "p", "/p", 3)])


def test_sentences_keep_every_character(spark):
    df = spark.createDataFrame([(1, "a\u0001b Cd. Ef gh. \u0001"), (2, "Ab. Cd"), (3, "x" * 100_000), (4, " "), (5, None)], "id int, text string")
    got = rows(documents.sentences(df, ["id"]).select("id", "sentence"))
    assert got == Counter([(1, "a\u0001b Cd."), (1, "Ef gh."), (1, "\u0001"), (2, "Ab."), (2, "Cd"), (3, "x" * 100_000)])


def test_front_matter_natively_and_in_python(spark):
    from vellumry.formatting import source

    texts = ["---\na\n---\nb\n", "\n \n --- \na\n\u00a0---\nb\n", "---\nopen\n", "--- a\n", "a\n---\n", "\n", "---\n---\n", "---\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["f"] for r in df.select("id", text.front_matter(F.col("text")).alias("f")).collect()}
    assert got == {i: source.split_front_matter(t)[0] for i, t in enumerate(texts)}


def test_blank_lines_in_code_stay(spark):
    df = spark.createDataFrame([(1, "a\n\n\n```\nb\n\n\nc\n```\n\n\n\nd"), (2, None), (3, "---\n\n\n---\n\n\nx\n")], "id int, text string")
    got = {r["id"]: r["text"] for r in documents.collapse_blank_lines(df).collect()}
    assert got == {1: "a\n\n```\nb\n\n\nc\n```\n\nd\n", 2: None, 3: "---\n\n\n---\n\nx\n"}


def test_why_a_document_keeps_its_source(spark, monkeypatch):
    from vellumry.formatting import markdown

    df = spark.createDataFrame([(1, "a  b", None), (2, "c", "no such file"), (3, None, None)], "id int, text string, error string")
    got = {r["id"]: (r["formatted"], r["error"]) for r in documents.format_documents(df, read_error="error").collect()}
    assert got == {1: ("a b\n", None), 2: ("c\n", "no such file"), 3: (None, None)}
    monkeypatch.setattr(markdown.blocks, "parse", lambda text: {}["gone"])
    assert markdown.checked_markdown("a  b") == ("a  b\n", "KeyError: 'gone'")


def test_structure_of_a_document_nested_too_deep(spark):
    deep = "> " * 40_000 + "x\n"
    df = spark.createDataFrame([(1, deep), (2, "> a\n")], "id int, text string")
    assert [r["kind"] for r in documents.blocks(df, ["id"]).where("id = 1").collect()] == ["raw"]
    assert documents.regions(df, ["id"]).count() == 0 and documents.framed_lines(df, ["id"]).count() == 2 and documents.scopes(df, ["id"]).count() == 1 and documents.references(df, ["id"]).count() == 0
    got = {r["id"]: (r["formatted"], r["error"]) for r in documents.format_documents(df).collect()}
    assert got[2] == ("> a\n", None) and got[1][0] == deep and got[1][1].startswith("RecursionError")


def test_paths_are_selected(spark):
    from vellumry.operators.selection import select_paths
    from vellumry.sources.files import Selection

    paths = ["a.md", "d/b.md", "node_modules/p/c.md", "x.egg-info/d.md", "venv.md", "e.MD", "f.txt", "d/venv/g.md", "ü [1].md", None]
    df = spark.createDataFrame([(p, 5 + i) for i, p in enumerate(paths)], "path string, size int")
    chosen = lambda **o: [r["path"] for r in select_paths(df, Selection(**o), size_col="size").collect()]
    assert chosen() == ["a.md", "d/b.md", "venv.md", "ü [1].md"]
    assert chosen(max_size=6) == ["a.md", "d/b.md"] and chosen(include=["?.txt"]) == ["f.txt"] and chosen(exclude=[], include=["[c-d].md"]) == ["node_modules/p/c.md", "x.egg-info/d.md"]
    assert select_paths(df.limit(0)).count() == 0


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "manifest")
    (tmp_path / "manifest" / "v-000000001").mkdir(parents=True)  # left by a run that was stopped
    docs = manifest.hashed(spark.createDataFrame([("p", bytearray(b"1")), ("q", bytearray(b"2"))], "path string, content binary"))
    assert manifest.read(spark, path).count() == 0
    done = docs.where("path = 'p'").select(F.lit("x").alias("project"), F.lit("f").alias("fingerprint"), "content_hash")
    manifest.write(done, path)
    manifest.write(checkpointed(manifest.merged(manifest.read(spark, path), done)), path)
    known = manifest.read(spark, path)
    assert known.count() == 1
    for _ in range(2):
        manifest.write(manifest.merged(manifest.read(spark, path), done), path)
    assert sorted(p.name for p in (tmp_path / "manifest").iterdir()) == ["v-000000003", "v-000000004"]
    for part in (tmp_path / "manifest" / "v-000000004").glob("*.parquet"):
        part.write_bytes(b"damaged")
    with pytest.warns(UserWarning):
        known = manifest.read(spark, path)  # the version before it
    assert known.count() == 1
    counts = manifest.hit_counts(docs, known, "f", [])
    assert counts.first() == (1, 1, "50.0%")
    assert [r["path"] for r in manifest.unformatted(docs, known, "f").collect()] == ["q"] and manifest.unformatted(docs, known, "g").count() == 2
    assert manifest.fingerprint(FormatOptions()) != manifest.fingerprint(FormatOptions(width=80))
    assert manifest.hit_rate(1, 2) == "33.3%" and manifest.hit_rate(0, 0) == "0.0%" and manifest.human_bytes(1536) == "1.5 KB" and manifest.human_bytes(12) == "12 B"
