"""The other operators against brute force, exact round trips or held-out accuracy, with edge cases."""

import json
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotgrid.llm import boosting, html_crf, html_pages, langid, minhash, packing, quality, token_store, toxicity
from lotgrid.llm.components import components
from lotgrid.llm.html_blocks import blocks
from lotgrid.llm.scratch import fresh_path
from lotgrid.llm.tokens import ChunkEncoder

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, start string"
EDGES = [(5, None), (3, ""), (9, "One two"), (9, "One two"), (1, "Hello  world.\n \n\tEnd, it's.\nÉté"), (None, "no id"), (2, "long " * 30_000), (4, "<|endoftext|> \0 x"), (6, "Hello<|endoftext|>world <|startoftext|> <|ENDOFTEXT|>, a.<|endoftext|>"), (7, " lead"), (8, "trail ")]


def docs(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", "clash") for i, t in rows], DOCS)


def plain(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizers.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_encoder_equals_the_tokenizer(name):
    rng = random.Random(2)
    letters = "aBz.,\n  \t\r\x1c 'séÇßΣ́…日12\0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t or "" for _, t in EDGES]
    added = [x["content"] for x in json.load(open(tokenizers.path(name)))["added_tokens"]]
    texts += [rng.choice(["", "a", "Word ", " x.", "\n", "é"]) + t + rng.choice(["", "b", " word", ",", "  "]) + u for x in added for t in (x, x.upper(), x[:-1], " " + x) for u in (x, "", " end")]
    assert added
    fast, slow = ChunkEncoder(tokenizers.path(name), 500), plain(name)
    for k in range(0, len(texts), 300):
        want = [np.array(x.ids, "<u4").tobytes() for x in slow.encode_batch(texts[k : k + 300], add_special_tokens=False)]
        assert fast.encode(texts[k : k + 300]) == want


def test_token_store_round_trip(spark):
    path = fresh_path(spark, "store-test")
    token_store.write_store(docs(spark, EDGES), path, tokenizers.path("word_bpe_49k.json"), end_id=1)
    store = token_store.TokenStore(spark, path)
    slow = plain("word_bpe_49k.json")
    want = [(i, slow.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    got = sorted(store.read().collect(), key=lambda r: r.start)
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0, *(len(x) for _, x in want)])[:-1].tolist()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in store.read([4]).collect()] == [x for i, x in want if i == 4]
    empty = fresh_path(spark, "store-empty")
    token_store.write_store(docs(spark, []).limit(0), empty, tokenizers.path("word_bpe_49k.json"))
    assert token_store.TokenStore(spark, empty).read().count() == 0


def test_dictionary_is_shared_and_checked(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue", "house", "garden", "water"]) for _ in range(rng.randint(40, 400)))) for i in range(400)]
    path = fresh_path(spark, "store-dict")
    token_store.write_store(docs(spark, rows), path, tokenizers.path("word_bpe_49k.json"), end_id=1)
    store = token_store.TokenStore(spark, path)
    assert store.read().count() == 400
    store.key += 1
    with pytest.raises(Exception, match="another dictionary"):
        store.read().count()


def test_packing_covers_every_id_once(spark):
    slow = plain("byte_bpe_50k.json")
    rows = EDGES + [(100 + i, "word " * random.Random(i).randint(1, 700)) for i in range(60)]
    got = packing.pack(docs(spark, rows).repartition(3), tokenizers.path("byte_bpe_50k.json"), end_id=0).collect()
    want = sorted((i if i is not None else -1, slow.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    sequences, total = {}, 0
    for r in got:
        assert len(r.ids) == 4 * r.length and 0 <= r.start < r.doc_tokens
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    assert total == sum(len(x) for _, x in want)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == packing.WINDOW or at & (at - 1) == 0
    one = {i: x for i, x in want if sum(j == i for j, _ in want) == 1}
    for i, x in one.items():
        mine = sorted((r.start, r.ids) for r in got if (r.doc_id if r.doc_id is not None else -1) == i)
        assert b"".join(b for _, b in mine) == np.array(x, "<u4").tobytes()
    assert packing.pack(docs(spark, []).limit(0), tokenizers.path("byte_bpe_50k.json")).count() == 0


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if w and i is not None:
            sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_brute_force(spark, width):
    rng = random.Random(width)
    vocab = [f"w{k}" for k in range(4000)]
    rows = []
    for f in range(12):  # families whose members drift apart, so that links chain and centres miss members
        text = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.choice([2, 5, 30])):
            for _ in range(rng.randint(0, max(1, len(text) // 18))):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(text if rng.random() < 0.8 else [w.upper() for w in text])))
    rows += [(1000, None), (1001, ""), (1002, "Solo"), (1003, "solo"), (1004, "a b"), (1005, "x " * 20_000), (None, "a b")]
    got = minhash.near_duplicates(docs(spark, rows), width, 80).collect()
    want, sizes = brute_components(rows, width, 80)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles) == (want.get(r.doc_id, r.doc_id), sizes.get(r.doc_id, 0))
            assert r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(docs(spark, []).limit(0)).count() == 0


def test_blocks_find_what_centres_miss(spark):
    """A centre that matches nobody, in a bucket whose other members are alike."""
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 62, 100, dtype=np.uint64)) for _ in range(2)]
    near = np.unique(np.concatenate([sets[1][:95], rng.integers(0, 1 << 62, 5, dtype=np.uint64)]))
    block = minhash.QueryBlock([(2, 2, sets[1])], 80)
    assert list(block.links(1, 1, sets[0])) == [] and list(block.links(3, 3, near)) == [(2, 3)] and list(block.links(3, 3, near)) == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100)], "u long, v long")
    got = {r.node: r.label for r in components(links).collect()}
    assert {got[k] for k in range(41)} == {0} and got[101] == 100
    assert components(links.limit(0)).count() == 0


def test_language_accuracy_and_edges(spark):
    rng = random.Random(1)
    sounds = {"aa": "ka lo mi tu ne".split(), "bb": "sch ung keit ver ach".split(), "cc": "ción ado os la que".split()}
    rows = [(i, " ".join("".join(rng.choice(sounds[x]) for _ in range(rng.randint(1, 4))) for _ in range(30)), x, "s", "c") for i in range(240) for x in [rng.choice(sorted(sounds))]]
    table = spark.createDataFrame(rows, DOCS)
    model = langid.train(table, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in model.predict(table).collect()}
    assert all(got[i].lang_pred == x and 0 <= got[i].score <= 1 for i, _, x, _, _ in rows if i % 4 == 2)
    edges = docs(spark, [(1, None), (2, ""), (3, "12 %%"), (4, "ka" * 50_000), (4, "ka lo")])
    assert [(r.lang_pred, r.score > 0) for r in model.predict(edges).collect()] == [("und", False)] * 3 + [("aa", True)] * 2
    assert [r.doc_id for r in model.accepted(edges).collect()] == [4, 4] and model.accepted(edges).columns == edges.columns
    none = langid.train(table.limit(0))
    assert none.languages == [] and none.predict(edges).where("lang_pred <> 'und'").count() == 0
    assert [r.doc_id for r in none.accepted(edges).collect()] == [4, 4]
    strict = langid.train(table, as_filter=True)
    other = docs(spark, [(5, "漢字かな交じり文の例をここに書いておくのでよく読んでください"), (6, "漢字"), (7, rows[0][1]), (7, rows[0][1]), (8, None)])
    assert strict.reject_below > 0.05 and sorted(r.doc_id for r in strict.accepted(other).collect()) == [6, 7, 7]
    assert strict.accepted(table).count() == 240 and strict.accepted(table.limit(0)).count() == 0
    assert langid.train(table.limit(0), as_filter=True).reject_below == 0


def test_pipeline_learns_languages_from_every_row(spark, monkeypatch):
    """3,000 texts of a language, twice the bound of samples: each has its part in prototype and bound, repeated rows too."""
    import corpus_pipeline

    words = "ka lo mi tu ne sa ri vo".split()
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice(words) for _ in range(3)) for _ in range(12)) for _ in range(2999)] + ["kalomi tunesa rivoka schung keitver achplotz"]
    rows = [(i, t, "aa", "s", 1) for i, t in enumerate(texts)] * 2 + [(None, None, "aa", "s", 1), (9000, "zwölf boxkämpfer", None, "s", 1)]
    models, train = [], langid.train
    monkeypatch.setattr(langid, "train", lambda *a, **b: models.append(train(*a, **b)) or models[-1])
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(7)
    assert corpus_pipeline.language(spark, table, "").count() == 6001
    vectors, sizes = langid.Trigrams().texts_and_sizes(texts)
    want = vectors.astype(np.float64).sum(axis=0)
    want /= np.linalg.norm(want)
    assert models[0].languages == ["aa"] and np.abs(models[0].prototypes[0] - want).max() < 1e-6
    assert abs(models[0].reject_below - langid.REJECT_SHARE * max(0.0, (vectors @ want)[sizes >= langid.EVIDENCE].min())) < 1e-6
    again = train(table.repartition(3), each=None)
    assert (again.prototypes == models[0].prototypes).all()


def labelled(spark, n, column, make):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        y = int(rng.random() < 0.4)
        rows.append((i, make(rng, y)))
        marks.append((i, y))
    return docs(spark, rows), spark.createDataFrame(marks, f"doc_id long, {column} int"), dict(marks)


def test_toxicity_held_out(spark):
    word = lambda r: "".join(r.choice("an be ci da el fo gu ha in jo".split()) for _ in range(r.randint(1, 4)))
    make = lambda r, y: " ".join([word(r) for _ in range(r.randint(10, 200))] + (["Grumpelfrex", "vlastik"] if y else []) + [word(r) for _ in range(20)])
    table, labels, y = labelled(spark, 400, "toxic", make)
    model = toxicity.train(table, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in model.score(table).collect()}
    assert all((got[i] >= 0.5) == bool(v) for i, v in y.items() if i % 5 == 0)
    edges = model.score(docs(spark, EDGES)).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 for r in edges)
    alone = toxicity.train(table, labels.where("toxic = 0"))
    assert all(r.score < 0.5 for r in alone.score(docs(spark, EDGES)).collect())


def brute_statistics(text):
    words = (text or "").encode().split()
    triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    again = {t for t in triples if triples.count(t) > 1}
    hit = {k + j for k, t in enumerate(triples) if t in again for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return [len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)]


def test_quality_statistics_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "é# ", "\n", "a b c\n", "\t", "x|y z ", " "]) for _ in range(rng.randint(0, 40)))
        assert quality.statistics(text)[0] == brute_statistics(text)
    assert quality.statistics(None)[0] == [0] * 5


def test_quality_held_out(spark):
    word = lambda r: "".join(r.choice("an be ci da el fo".split()) for _ in range(r.randint(1, 4)))
    make = lambda r, y: " ".join((word(r) if y else word(r).upper() + "!!") for _ in range(r.randint(60, 200)))
    table, labels, y = labelled(spark, 300, "quality", make)
    got = {r.doc_id: r for r in quality.assess(table, quality.train(table, labels)).collect()}
    assert all(got[i].kept == bool(v) for i, v in y.items())
    edges = quality.assess(docs(spark, EDGES), quality.train(table, labels.limit(0))).collect()
    assert len(edges) == len(EDGES) and all(r.base_failed and not r.kept for r in edges if r.n_words < 50)


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, 3))
    y = (x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.3, 2000) > 0.6).astype(float)
    trees = boosting.fit(x, y, monotone={0: 1, 2: -1})
    assert ((trees.score(x) > 0.5) == y).mean() > 0.75
    grid = np.linspace(0, 1, 60)
    for row in x[:40]:
        for k, sign in ((0, 1), (2, -1)):
            line = np.repeat(row[None], 60, axis=0)
            line[:, k] = grid
            assert (sign * np.diff(trees.score(line)) >= -1e-12).all()
    for flat in (boosting.fit(x[:0], y[:0]), boosting.fit(x, np.ones(2000))):
        assert np.ptp(flat.score(x)) < 1e-3


PAGE = '<html><head><title>T &amp; U</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>T &amp; U</h1><p>First <b>bo</b>ld &eacute; line.<p>Second\n line<br>more.</article><div class="comments"><p>I disagree with it.</p></div><footer>&copy; me</footer></body></html>'


def test_html_page():
    field = html_crf.default_field()
    assert field.text(PAGE) == "T & U First bold é line. Second line more."
    assert field.text("") == "" and field.text(None) == ""
    assert [b.text for b in blocks("plain &lt;text&gt;")[0]] == ["plain <text>"]
    for broken in ("<", "<p", "<p class='x", "<!-- open", "<script>x", "</p></div>", "<a><b><p>x</a>", "<" * 2000, "<div>" * 3000 + "x"):
        field.text(broken)


def test_html_held_out_pages():
    field = html_crf.default_field()
    wrong = total = 0
    for page in html_pages.labelled_pages(150, seed=77):
        rows, want = html_crf.marked(page)
        got = field.decode(rows)
        wrong, total = wrong + sum(a != b for a, b in zip(got, want, strict=True)), total + len(want)
    assert wrong < 0.03 * total


def test_viterbi_is_the_best_path():
    field = html_crf.Field({"a": 1.5, "b": -0.7, "c": 0.2}, [[0.3, -1.0], [-0.4, 0.9]], [0.2, -0.1])
    rows = [["a"], ["b", "c"], ["b"], ["a", "b"], ["c"], ["b"]]
    score = lambda ys: field.begin[ys[0]] + sum(sum(field.weights[x] for x in r) * y for r, y in zip(rows, ys, strict=True)) + sum(field.step[a][b] for a, b in zip(ys, ys[1:], strict=False))
    best = max((tuple(n >> k & 1 for k in range(6)) for n in range(64)), key=score)
    assert field.decode(rows) == [bool(y) for y in best]


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (1, "u", PAGE, 0), (2, None, None, 0), (None, "v", "", 0)], "page_id long, url string, html string, n_chars int")
    got = html_crf.extract(pages).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", 42), (1, "u", 42), (2, None, 0), (None, "v", 0)]
    assert html_crf.extract(pages.limit(0)).count() == 0


def brute_targets(sizes):
    """sizes: words by source. Shares by weight, those over twice their size cut back and the excess shared again."""
    order = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    weight = {x: (3, 1, 2)[k % 3] for k, x in enumerate(order)}
    left, target, still = 1.5 * sum(sizes.values()), {}, set(order)
    while still:
        level = left / sum(weight[x] for x in still)
        over = {x for x in still if weight[x] * level > 2 * sizes[x]}
        if not over:
            return target | {x: weight[x] * level for x in still}
        target |= {x: 2.0 * sizes[x] for x in over}
        left, still = left - sum(2 * sizes[x] for x in over), still - over
    return target


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    base = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(60)}x" for _ in range(rng.randint(20, 90))), "en", f"src{i % 4}", 1) for i in range(120)]
    rows = base + [(200, None, "en", "src0", 0), (201, "123", "en", "src1", 3), (202, base[0][1].upper(), "en", "src2", 1), (203, base[1][1] + " tail", "en", "src3", 1), (204, base[2][1], None, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).checkpoint()
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in kept.select("doc_id").collect()})
    ids = {r[0] for r in rows}
    assert seen[0] == ids - {200, 201}
    assert seen[1] == seen[0] - {0, 2}
    want, _ = brute_components([(i, t) for i, t, *_ in rows if i in seen[1]], 5, 80)
    assert seen[2] == {i for i in seen[1] if want[i] == i}
    # Mixing: whole documents, at most twice; a source lacks less than any of its documents that was taken less often.
    text, source, copies = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}, Counter(r.doc_id for r in kept.select("doc_id").collect())
    size = {i: len(text[i].split()) for i in seen[2]}
    words = Counter()
    for i in seen[2]:
        words[source[i]] += size[i]
    for x, target in brute_targets(words).items():
        own = [i for i in seen[2] if source[i] == x]
        lack = round(target) - sum(copies[i] * size[i] for i in own)
        assert lack >= 0 and all(copies[i] <= 2 for i in own)
        assert all(size[i] > lack for i in own if copies[i] < max(copies[j] for j in own))
    # Packing: each id of each copy lies in one piece, and sequences are gapless and full or a power of two long.
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == seen[3] == set(copies)
    slow, covered, sequences = plain("byte_bpe_50k.json"), Counter(), {}
    want = {i: np.array([*slow.encode(text[i], add_special_tokens=False).ids, 0], "<u4") for i in copies}
    for r in out:
        assert r.doc_tokens == len(want[r.doc_id]) and bytes(r.ids) == want[r.doc_id][r.start : r.start + r.length].tobytes()
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == Counter({(i, k): n for i, n in copies.items() for k in range(len(want[i]))})
    for pieces in sequences.values():
        pieces.sort()
        assert [at for at, _ in pieces] == np.cumsum([0, *(n for _, n in pieces)])[:-1].tolist()
        total = sum(n for _, n in pieces)
        assert total == packing.WINDOW or total & (total - 1) == 0
