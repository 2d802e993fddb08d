"""Exact dedup, personal data and mixing against plain Python, with edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lotgrid.llm import exact_dedup, minhash, mixing, pii, sampling
from lotgrid.llm.scratch import fresh_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """rows: id, text, source; the extra column clashes with a name used inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], DOCS).withColumnRenamed("extra", "digest")


EDGES = [(1, "Abc", "a"), (2, "aBC", "a"), (3, None, None), (4, "", "b"), (5, "É", "b"), (6, "é", "b"), (7, "x" * 200_000, "a"), (8, "abc", None), (8, "abc", None), (None, "abc", "a")]


def test_exact_against_python(spark):
    got = exact_dedup.exact_duplicates(docs(spark, EDGES)).collect()
    groups = defaultdict(list)
    for i, t, _ in EDGES:
        groups[hashlib.sha256((t or "").translate(LOW).encode()).hexdigest()].append(i)
    assert len(got) == len(EDGES)
    for r in got:
        own = groups[r.text_sha256]
        assert (r.keep_id, r.group_size) == (max(x for x in own if x is not None), len(own))
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_duplicates(docs(spark, []).limit(0)).count() == 0


def test_exact_stage_keeps_one_row(spark):
    out = exact_dedup.drop_exact_duplicates(docs(spark, EDGES))
    assert out.columns == docs(spark, EDGES).columns
    assert sorted(r.doc_id for r in out.collect()) == [4, 5, 6, 7, 8]


def test_index_persists(spark):
    path = fresh_path(spark, "index-test")
    first = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.exact_duplicates(docs(spark, [(1, "a", "s"), (2, "b", "s")]), first).count()
    again = exact_dedup.DigestIndex(spark, path, 4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(docs(spark, [(7, "A", "s"), (8, "c", "s")]), again).collect()}
    assert got == {7: (1, False), 8: (8, True)}
    assert again.entries().count() == 3
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {again.table}").collect()}
    assert (told["Num Buckets"], told["Bucket Columns"], told["Sort Columns"]) == ("4", "[`digest`]", "[`digest`]")


def test_index_keeps_its_buckets(spark):
    path, rows = fresh_path(spark, "index-buckets"), docs(spark, [(i, f"text {i}", "s") for i in range(200)])
    first = exact_dedup.DigestIndex(spark, path, 4)
    assert sum(r.kept for r in exact_dedup.exact_duplicates(rows, first).collect()) == 200
    first.close()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        again = exact_dedup.DigestIndex(spark, path)
        got = exact_dedup.exact_duplicates(rows, again).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert again.buckets == 4 and len(got) == 200 and not any(r.kept for r in got) and again.entries().count() == 200
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, path, 8)
    again.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name in (first.table, again.table)]


def test_a_batch_can_be_run_again(spark):
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index-retry"))
    exact_dedup.exact_duplicates(docs(spark, [(1, "old", "s")]), index, "monday").collect()
    rows = docs(spark, [(i, f"text {i % 150}", "s") for i in range(200)] + [(900, "OLD", "s")])
    runs = [sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(rows.repartition(n), index, "tuesday").collect()) for n in (1, 3)]
    assert runs[0] == runs[1] and sum(r[3] for r in runs[0]) == 150 and runs[0][-1] == (900, 1, 1, False)
    assert index.entries().count() == 151
    kept = exact_dedup.drop_exact_duplicates(rows, index, "tuesday")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in runs[0] if r[3])
    index.close()


def test_stages_leave_clashing_names_alone(spark):
    """Columns named as those used inside keep their values; rows alike in every column, and null ids, are counted right."""
    inside = ["_key", "key", "digest", "mark", "_n", "_size", "_shards", "_shard", "_side", "_rank", "_draw", "top_key", "rows", "KEY2"]
    schema = DOCS.replace("extra string", ", ".join(f"`{c}` string" for c in inside))
    rows = [(i, t, "en", s, 1, *(["mine"] * len(inside))) for i, t, s in [*EDGES, (None, "abc", "a"), (None, None, None), (40, "only this", "b")]]
    table = spark.createDataFrame(rows, schema)
    for stage in (exact_dedup.drop_exact_duplicates, minhash.drop_near_duplicates, mixing.mixed):
        out = stage(table)
        assert out.schema.names == table.schema.names and out.dtypes == table.dtypes
        assert all(r[c] == "mine" for r in out.collect() for c in inside)
        assert stage(table.limit(0)).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(table).collect()) == [4, 5, 6, 7, 8, 40]
    planned = mixing.plan_mix(table).groupBy().agg(F.sum("copies")).first()[0]
    assert mixing.mixed(table).count() == planned


def test_samples_stay_bounded(spark):
    """50,000 rows without an id, and 50,000 of one id, don't make a sample of all rows."""
    many = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert 1000 < sampling.per_class(many, "lang", 1500, ("doc_id", "text"))[0].count() < 2000
    one = many.withColumn("doc_id", F.lit(7).cast("long")).withColumn("toxic", F.lit(1))
    assert sampling.labelled_texts(one, one, "toxic", 1000)[0].count() <= 1


def targets(sizes, order):
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, open_, fixed = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return fixed


def test_mixing_reaches_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 20, 60]))) or None, rng.choice(["a", "b", "c", "d", None])) for i in range(1500)] + [(9000, "x", "solo")]
    got = mixing.plan_mix(docs(spark, rows), shards=8).collect()
    source = {i: s for i, _, s in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and len(r.shards) == r.copies and r.taken == r.copies * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    want = targets(sizes, sorted(x for x in sizes if x is not None) + [None])
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= max(0.02 * goal, 2)
    again = mixing.plan_mix(docs(spark, rows[::-1]).repartition(5), shards=8).collect()
    assert {(r.doc_id, r.taken, tuple(r.shards)) for r in got} == {(r.doc_id, r.taken, tuple(r.shards)) for r in again}


def test_mixing_edges(spark):
    assert mixing.plan_mix(docs(spark, EDGES).limit(0)).count() == 0
    out = mixing.plan_mix(docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.taken) for r in out] == [(0, 0), (0, 0)]
    rows = docs(spark, EDGES)
    copies = sum(r.copies for r in mixing.plan_mix(rows).collect())
    mixed = mixing.mixed(rows)
    assert mixed.count() == copies and mixed.columns == rows.columns


def test_splitting_tree_is_exact_and_fair(spark):
    q = spark.sql("SELECT array(700L, 0L, 50L, 1250L) AS q")
    rows = mixing.split_quotas(q, 7, 3).collect()
    assert len(rows) == 7 and [sum(r.q[k] for r in rows) for k in range(4)] == [700, 0, 50, 1250]
    for r in rows:
        assert abs(sum(r.q) - 2000 / 7) < 3 and abs(r.q[0] - 100) < 45
    draws = [mixing.split_quotas(q, 2, s).orderBy("shard").first().q[2] for s in range(12)]
    assert 15 <= min(draws) and max(draws) <= 35 and len(set(draws)) > 3


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [(k, a, e) for a, _, e, k in sorted(out)]


def test_base_spans_against_python(spark):
    rng = random.Random(8)
    pieces = ["a@b.com", "x_y@d.e", "1.2.3.4", "256.1.1.1", "001.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "é", "𝄞", " ", ".", "@", "-", "9", "12", "+", "\n", "a.b@", "0"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))), "s") for i in range(400)] + [(900, None, "s"), (901, "", "s"), (902, "7 " * 30_000, "s"), (903, "1" * 50_000, "s")]
    got = pii.default_model(spark).find(docs(spark, rows))
    text = {i: t or "" for i, t, _ in rows}
    for r in got.collect():
        assert [(c["kind"], c["start"], c["end"]) for c in r.base] == base_spans(text[r.doc_id])
        for c in r.added:
            assert not any(c["start"] < b["end"] and b["start"] < c["end"] for b in r.base)


def test_added_spans(spark):
    texts = {
        "please call 212-555-0187 today": ["phone:212-555-0187"], "reach me on 212-555-0187": ["phone:212-555-0187"], "my tel 00 44 20 7946 0958": ["phone:00 44 20 7946 0958"], "ring 020 7946 0958 now": ["phone:020 7946 0958"],
        "order 212-555-0187 shipped": [], "plain words only 2024 and 3.14": [], "write kato [at] mimi [dot] com now": ["email:kato [at] mimi [dot] com"], "from fe80::1ff:fe23:4567:890a ok": ["ip:fe80::1ff:fe23:4567:890a"], "at 12:30:05 sharp": [],
        "his ssn 078-05-1120 is": ["id:078-05-1120"], 'the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" there': ["secret:04dbebab91ab85687d33eeaaf9ac699e1188f962"], "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 fixed it": [],
        "ueadoos 9807915762804490 raie": ["card:9807915762804490"], "key performance and token value": [], "open since 2023-06-17 10:55": [],
    }
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: [f"{c['kind']}:{rows[r.doc_id][1][c['start'] : c['end']]}" for c in r.added] for r in pii.default_model(spark).find(docs(spark, rows)).collect()}
    assert {t: got[i] for i, t, _ in rows} == texts
    assert pii.default_model(spark).find(docs(spark, rows).limit(0)).count() == 0


def test_held_out_spans(spark):
    """Recall and precision of every kind on texts with words around the spans that weren't learned from."""
    wanted = pii.example_texts(4000, seed=77, held=True)
    rows = docs(spark, [(i, t, "s") for i, (t, *_) in enumerate(wanted)])
    right, want, added, good = (defaultdict(int) for _ in range(4))
    for r in pii.default_model(spark).find(rows).collect():
        own = wanted[r.doc_id]
        met = [c["kind"] for c in [*r.base, *r.added] if own[1] and pii._meets(own, c["kind"], c["start"], c["end"])]
        want[own[1]] += 1
        right[own[1]] += bool(met)
        for c in r.added:
            added[c["kind"]] += 1
            good[c["kind"]] += pii._meets(own, c["kind"], c["start"], c["end"])
    for kind in pii.KINDS + pii.MORE_KINDS:
        assert right[kind] >= 0.9 * want[kind] > 0 and good[kind] >= 0.9 * added[kind] > 0, kind


def test_planted_secrets_and_card_numbers(spark):
    """Tokens and digit runs as long as a card number in the tables, by plain patterns; nothing added to other documents."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in pii.default_model(spark).find(table).collect()}
    planted = hits = 0
    for doc in table.collect():
        spans = [(c["start"], c["end"]) for c in [*found[doc.doc_id].base, *found[doc.doc_id].added]]
        here = [(m.start(1), m.end(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"|(?<![0-9])(?=([0-9]{16})(?![0-9]))', doc.text or "") if m[1]]
        here += [(m.start(), m.end()) for m in re.finditer(r"(?<![0-9])[0-9]{16}(?![0-9])", doc.text or "")]
        planted, hits = planted + len(here), hits + sum(x in spans for x in here)
        assert len(found[doc.doc_id].added) <= len(here) + 1
    assert planted > 20 and hits >= 0.95 * planted


def test_main_paths_stay_native(spark):
    rows = docs(spark, EDGES)
    for df in (exact_dedup.exact_duplicates(rows), mixing.plan_mix(rows), pii.default_model(spark).find(rows).select(F.size("base"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_mix_fills_up_beyond_a_long_document(spark):
    """A source with some very long documents and many short ones comes as near its target as the short ones allow."""
    sizes = [4000 if i % 60 == 7 else 3 + i % 5 for i in range(600)]
    rows = docs(spark, [(i, "w " * n, "a" if i < 300 else "b") for i, n in enumerate(sizes)])
    got = mixing.plan_mix(rows, shards=8).collect()
    for name in (0, 300):
        own = [r for r in got if name <= r.doc_id < name + 300]
        lacks = own[0].target - sum(r.taken for r in own)
        assert -1 < lacks < min(r.size for r in own if r.copies == min(x.copies for x in own)) + 1
        assert all(len(r.shards) == r.copies <= 2 for r in own)
