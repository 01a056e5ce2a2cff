"""The text operators against brute force on small tables, and on awkward rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from daybook.llm import brown, decontaminate, language, line_dedup, mixing, recompression, simhash, suffix, toxicity, vector_file
from daybook.llm.text import FIRST, find_words

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ALPHABET = "the of and to in is on at it by".split()


def sentence(rng, n):
    return " ".join(rng.choice(ALPHABET) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, runs, blanks and repeated rows."""
    rng = random.Random(5)
    passage, lines = sentence(rng, 70), [sentence(rng, 12) for _ in range(4)]
    texts = [sentence(rng, rng.randint(1, 160)) for _ in range(24)]
    texts += [texts[3], texts[3], texts[5] + " more words here", "x " + texts[5]]
    texts += [sentence(rng, 20) + " " + passage + " " + sentence(rng, 30) for _ in range(4)]
    texts += ["\n".join([sentence(rng, 9), *lines[i % 2 :], sentence(rng, 9)]) for i in range(4)]
    texts += ["word " * 130, "word " * 90, "a b " * 60, "a b " * 80 + "c"]
    texts += [None, "", " \t\n ", "One", " café 中文", sentence(rng, 3000)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, 0) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[10]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC)


def words(text):
    return (text or "").encode().split()


def test_flat_words_equal_a_plain_split():
    texts = [b"", b" a  bb\tc ", b"x", b"\n\n", "é ü".encode()]
    found = find_words(texts)
    cut = [found.buffer[a:b] for a, b in zip(found.starts, found.ends)]
    assert [cut[a:b] for a, b in zip(found.first, found.first[1:])] == [t.split() for t in texts]
    again = find_words([b"zz bb"])
    assert FIRST.words(found)[1] == FIRST.words(again)[1]


def test_substring_dedup_equals_brute_force(docs, corpus):
    least = {}
    for doc, text, *_ in corpus:
        w = words(text)
        for i in range(len(w) - 49):
            least[tuple(w[i : i + 50])] = min(doc, least.get(tuple(w[i : i + 50]), doc))
    expected = []
    for doc, text, *_ in corpus:
        w, gone = words(text), set()
        for i in range(len(w) - 49):
            if least[tuple(w[i : i + 50])] < doc:
                gone |= set(range(i, i + 50))
        expected.append((doc, len(w), len(gone)))
    rows = recompression.substring_dedup(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in rows) == sorted(expected)
    assert any(n for *_, n in expected)


@pytest.mark.parametrize("places", [1, 256])
def test_suffix_dedup_equals_brute_force(docs, corpus, places):
    seen = Counter()
    for _, text, *_ in corpus:
        data = (text or "").encode()
        seen.update(data[i : i + 100] for i in range(len(data) - 99))
    expected = []
    for doc, text, *_ in corpus:
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - 99):
            if seen[data[i : i + 100]] > 1:
                gone |= set(range(i, i + 100))
        spans = sum(1 for i in gone if i - 1 not in gone)
        expected.append((doc, len(data), len(gone), spans))
    rows = suffix.suffix_dedup(docs, 100, 32, places, 256).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in rows) == sorted(expected)


@pytest.mark.parametrize("text", [b"", b"a", b"aaaa", b"banana", b"mississippi" * 9, bytes(range(256)) * 2, b"\0\0a\0\0"])
def test_suffix_array_is_sorted(text):
    assert suffix.suffix_array(text, len(text) + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_simhash_groups_equal_brute_force(docs, corpus):
    prints = []
    for doc, text, *_ in corpus:
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append((doc, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    names = {doc: doc for doc, _ in prints}
    for _ in prints:
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= 3:
                    names[a] = names[b] = min(names[a], names[b])
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in rows) == sorted((d, f, names[d]) for d, f in prints)


@pytest.mark.parametrize("block", [2, 4096])
def test_near_links_join_what_is_near(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6)
    values = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 3))) for c in centre for _ in range(60)}
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), block=block).collect()
    assert all((r.a ^ r.b).bit_count() <= 3 for r in links)
    root = {v: v for v in values}

    def find(x):
        return x if root[x] == x else find(root[x])

    for r in links:
        root[find(r.a)] = find(r.b)
    assert all(find(a) == find(b) for a in values for b in values if (a ^ b).bit_count() <= 3)


def test_chains_are_rising_and_the_first_is_longest():
    rng = random.Random(3)
    for _ in range(200):
        places = rng.choices(range(12), k=rng.randrange(0, 12))
        found = line_dedup.chains(places)
        assert sorted(i for c in found for i in c) == list(range(len(places)))
        assert all(a < b and places[a] < places[b] for c in found for a, b in zip(c, c[1:]))
        best = [0] * len(places)
        for i in range(len(places)):
            best[i] = 1 + max((best[j] for j in range(i) if places[j] < places[i]), default=0)
        assert len(found[0] if found else []) == max(best, default=0)


def test_aligned_blocks_join_touching_runs_and_keep_moved_ones():
    assert line_dedup.align([(0, 2, 5), (1, 3, 6), (3, 5, 8)]) == [(0, 5, 5)]
    assert line_dedup.align([(0, 2, 5), (4, 6, 9)]) == [(0, 2, 5), (4, 6, 9)]
    assert sorted(line_dedup.align([(0, 2, 9), (2, 4, 0), (3, 5, 1)])) == [(0, 2, 9), (2, 5, 0)]
    assert line_dedup.align([(0, 2, 1), (0, 3, 1)]) == [(0, 3, 1)]


def test_alignments_name_partner_and_place(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, f"x\n{long}\ny"), (2, f"{long} more\nz"), (3, f"{long} more\nq\n{long}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.earlier): [tuple(b) for b in r.blocks] for r in line_dedup.alignments(docs).collect()}
    assert found[3, 1] == [(2, 3, 1)] and found[3, 2] == [(0, 1, 0)]
    assert set(found) == {(3, 1), (3, 2)}


def test_line_dedup_cuts_later_documents_only(docs, corpus):
    rows = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert rows[3].n_removed == 0 and rows[3].text == corpus[3][1]
    assert rows[24].text == "" and rows[25].text == ""
    assert rows[32].n_removed == 0 and rows[34].n_removed == 4
    assert rows[40].text is None and rows[41].text == ""


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    items = [(i, sentence(rng, n)) for i, n in enumerate([30, 12, 5, 3, 40, 25])] + [(6, None), (7, " ")]
    near = items[0][1].split()
    near[2] = "changed"
    texts = [sentence(rng, 60) for _ in range(20)]
    texts += [sentence(rng, 9) + " " + items[i][1].upper() + " " + sentence(rng, 7) for i in range(6)]
    texts += [" ".join(near[3:]), " ".join(near), items[4][1], "ends " + items[2][1], None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]

    def grams(w, n):
        width = min(5, n)
        return Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))

    expected = {}
    for doc, text in rows:
        w = words((text or "").lower())
        for item, content in items:
            v = words(content)
            for s in range(max(1, len(w) - len(v) + 1)) if v else ():
                x, y = grams(w[s : s + len(v)], len(v)), grams(v, len(v))
                value = (x & y).total() / max(1, (x | y).total())
                if value >= 0.8:
                    expected[doc, item] = max(value, expected.get((doc, item), 0))
    found = decontaminate.contaminated(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == {k: round(v, 9) for k, v in expected.items()}
    assert len(expected) >= 8


def test_mix_meets_its_targets(docs, corpus):
    rows = mixing.mix(docs, mixing.Curriculum(bucket_rows=3)).collect()
    sizes = [len(words(t)) for _, t, *_ in corpus]
    assert sum(r.size for r in rows) == sum(sizes)
    taken, goal = defaultdict(int), {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        assert (r.first_position is None) == (r.taken == 0)
        assert r.first_position is None or -1e-9 <= r.first_position <= (r.second_position or 1) <= 1 + 1e-9
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes))
    assert all(abs(taken[s] - goal[s]) <= max(sizes) for s in goal)


def test_rows_that_share_a_doc_id_are_mixed_and_cleaned_one_by_one(spark):
    item = "zz yy xx ww vv uu tt ss"
    rows = [(1, "a " * 30), (1, f"b c {item} d"), (None, "e f g"), (None, item), (2, "h " * 9), (2, "h " * 9), (3, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r for r in rows if item not in (r[1] or ""))
    order = mixing.training_order(docs, mixing.Curriculum(demand=2.0)).collect()
    assert Counter((r.doc_id, r.text) for r in order) == Counter(r for r in rows if r[1] for _ in range(2))
    assert all(r.size == len(r.text.split()) for r in order)
    assert [r.position for r in order] == sorted(r.position for r in order)


def test_vector_file_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (600, None), (700, [1.0, None]), (800, [float("nan")]), (900, [0.5]), (None, [1.0])]
    vectors = vector_file.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = vector_file.search(vectors, vectors.where("vec_id % 100 = 0"), 5).collect()
    held = {r.vec_id: r.vector for r in vectors.collect()}
    for q in (i for i in held if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(held[q], v)), i) for i, v in held.items() if i != q)[:5]
        assert [(r.vec_id, -r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == [(i, s) for s, i in best]
    assert {r.query_id for r in found} == {0, 100, 200, 300, 500, 900}


def test_class_model_is_a_distribution(spark, docs):
    settings = brown.Settings(classes=5, single=8, endings=7, frequent=20, rounds=2)
    model, counts = brown.fit(docs.select("text"), settings)
    seen = Counter(w for r in docs.collect() for w in words((r.text or "").lower()))
    assert model.tokens == sum(seen.values()) + docs.count() and model.distinct == len(seen) + 1
    # one-word texts: the probabilities of every first word and of the end, and of unseen words by class
    known = [(i, w.decode()) for i, w in enumerate(seen)]
    scored = brown.score(spark.createDataFrame([*known, (-5, "")], "doc_id long, text string"), model, counts).collect()
    end = {r.doc_id: r for r in scored}
    start = model.unit_class[-1]
    total = 10 ** end[-5].score
    for i, w in known:
        found = find_words([w.encode()])
        unit, *_ = brown._units_of(found, FIRST.words(found), model.hashes, model.units, settings)
        own = model.unit_class[unit[0]]
        total += 10 ** (end[i].score - model.step[own, start] - np.log10(model.texts + 0.1))
    unseen = (0.1 * 10 ** model.step[start]).sum()
    assert total + unseen == pytest.approx(1.0)
    again = brown.score(docs.select("doc_id", "text"), model, counts).collect()
    assert all(r.n_known == r.n_tokens for r in again)
    held = Counter((r.doc_id, len(words(r.text)) + 1) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in again) == held


def test_language_prediction(spark):
    rng = random.Random(1)
    kinds = {"aa": "kalo mira tesu".split(), "bb": "wrxst plnk zzgrf".split()}
    rows = [(" ".join(rng.choice(w) + rng.choice(w) for _ in range(8)), k) for k, w in kinds.items() for _ in range(30)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    asked = [(1, "kalomirakalo tesu."), (2, "WRXSTWRXSTPLNK, 12"), (3, None), (4, "12 %"), (5, "中文")]
    found = language.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in found] == ["aa", "bb", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in found)
    assert language.fit(spark.createDataFrame([], "text string, lang string")) is None
    nothing = language.predict(spark.createDataFrame(asked, "doc_id long, text string"), None).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 30) + (" you scum idiot" if i % 5 == 0 else "")) for i in range(300)]
    labels = [(i, int(i % 7 > 0), int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None)]
    docs = spark.createDataFrame([*rows, (None, None), (7, "")], "doc_id long, text string")
    found = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id for r in found if r.toxic} == {i for i in range(300) if i % 5 == 0}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.toxic for r in toxicity.toxicity(docs, none).collect())


def test_awkward_rows_and_empty_tables(spark):
    wide = DOC + ", size int, position int, n_lines int, component int"
    rows = [(1, None, None, None, None, 1, 1, 1, 1), (None, "a b c", "en", "s", 5, 1, 1, 1, 1), (None, None, None, None, None, 1, 1, 1, 1)]
    rows += [(2, "a b c " * 40, "en", "s", 5, 1, 1, 1, 1)] * 2
    items = spark.createDataFrame([(1, "zz yy xx ww vv uu")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for content, n, kept in ((rows, 5, 4), ([], 0, 0)):
        docs = spark.createDataFrame(content, wide)
        assert recompression.substring_dedup(docs).count() == n
        assert suffix.suffix_dedup(docs).count() == n
        assert simhash.near_duplicates(docs).count() == n
        assert simhash.keep_one(docs).count() == kept
        assert line_dedup.line_dedup(docs).columns[-3:] == ["line_n_lines", "n_removed", "n_partners"]
        assert line_dedup.line_dedup(docs).count() == n
        assert toxicity.keep_clean(docs, labels).count() == n
        assert decontaminate.clean(docs, items).count() == n
        assert decontaminate.clean(docs, items.limit(0)).count() == n
        assert mixing.mix(docs).count() == n
        assert "mix_size" in mixing.training_order(docs).columns
        order = mixing.training_order(docs)
        assert order.where("doc_id IS NULL AND text IS NULL").count() == 0
        assert order.columns[: len(docs.columns)] == docs.columns
        model, counts = brown.fit(docs.select("text"), brown.Settings(classes=3, single=4, endings=3, rounds=1))
        assert brown.score(docs.select("doc_id", "text"), model, counts).count() == n
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    vectors = vector_file.integer_vectors(none)
    assert vector_file.search(vectors, vectors).count() == 0
