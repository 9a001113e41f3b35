import collections
import random

import corpus_pipeline


def prose(rng, n, length=4):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, length))) for _ in range(n))


def plain_cut(texts, words=51):
    """The words that are left of each text without those of runs of so many words that start at two places or more."""
    split = {k: (t or "").split() for k, t in texts}
    seen = collections.Counter(tuple(w[i : i + words]) for w in split.values() for i in range(len(w) - words + 1))
    left = {}
    for k, w in split.items():
        gone = {j for i in range(len(w) - words + 1) if seen[tuple(w[i : i + words])] > 1 for j in range(i, i + words)}
        left[k] = [x for j, x in enumerate(w) if j not in gone]
    return left


def test_passages_of_over_fifty_words_are_cut(spark):
    rng = random.Random(4)
    short, shorter, tiny, bytes_long = prose(rng, 51), prose(rng, 50), " ".join(rng.choice("abcdef") for _ in range(51)), prose(rng, 50, 20)
    texts = [f"{prose(rng, 90 + k)} {short if k % 3 else shorter} {prose(rng, 40)} {tiny if k % 2 else bytes_long}" for k in range(12)]
    texts += [short.replace(" ", "\n", 9), "é " + "la " * 60 + "été", None, "", "   ", "word", texts[2][:300], "啊" * 30 + "x" + "啊" * 30]
    rows = [(k, t, len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    found = corpus_pipeline.cut_repeats(spark, docs, "")
    assert found.columns == docs.columns
    found = {r.doc_id: r for r in found.collect()}
    left = plain_cut([r[:2] for r in rows[:-1]])
    for k, text, _ in rows[:-1]:
        if left[k] or not (text or "").split():
            assert (found[k].text or "").split() == left[k] and (text is None or found[k].n_chars == len(found[k].text))
        else:
            assert k not in found
    assert len(left[1]) == 91 + 40 and len(left[0]) == 90 + 50 + 40 + 50 and found[0].text == texts[0]
    assert found[19].text == texts[19]
    assert corpus_pipeline.cut_repeats(spark, docs.limit(0), "").count() == 0
    twice = corpus_pipeline.cut_repeats(spark, spark.createDataFrame([rows[12], rows[12], rows[17]], docs.schema), "").collect()
    assert [r.doc_id for r in twice] == [17]


def plain_groups(texts, limit=0.8):
    """The least place of each text's group, by all pairs."""
    split = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= limit:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def test_near_copies_are_those_of_exact_similarity(spark):
    rng = random.Random(6)
    texts = []
    for k in range(60):
        base = prose(rng, rng.choice((12, 60, 300)), 7).split()
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 5, 7, 9):
            other = list(base)
            for place in rng.sample(range(len(base)), max(1, changes * len(base) // 300) if len(base) > 60 else 1):
                other[place] = prose(rng, 1, 9)
            texts.append(" ".join(other))
    hub = prose(rng, 200, 7).split()
    for k in range(80):  # a large group in which many pairs are less alike than the limit
        texts.append(" ".join([*hub[:k], *("new%d" % k,) * 1, *hub[k + 1 :]]))
    texts += [None, "", "  ", "two words", "Two  WORDS", "two others"]
    rows = [(k, t, len(t or "")) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([*rows, rows[0], (None, "two words", 9), (7, prose(rng, 30), 0)], "doc_id long, text string, n_chars long")
    found = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert found.columns == docs.columns
    found = [(r.doc_id, r.text) for r in found.collect()]
    expected = plain_groups(texts)  # the row without an id is a copy of one that has one
    kept = [(k, texts[k]) for k in set(expected)] + [(docs.where("doc_id = 7").collect()[-1].doc_id, [r.text for r in docs.where("doc_id = 7").collect() if r.text != texts[7]][0])]
    assert sorted(found, key=str) == sorted(kept, key=str)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_stages_in_order(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if name != "packing":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
            assert set(after) <= set(before) and len(after) > 0.5 * len(before)
            if name in ("toxicity", "simhash_near_dedup"):
                assert all(before[k] == t for k, t in after.items())
            before = after
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(before)


def test_rows_without_an_id_are_copies_too(spark, tmp_path):
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    one, two, three = text(60), text(60), text(60)
    rows = [(None, one), (None, one), (None, f"{one} tail"), (None, two), (4, two), (9, f"{two} end"), (None, three), (None, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __named string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert len(kept) == 4 and sum(r.text in (one, f"{one} tail") for r in kept) == 1
    assert sorted((r.doc_id or 0, r.text or "") for r in kept if r.text not in (one, f"{one} tail")) == sorted([(4, two), (0, three), (0, "")])


def test_large_groups_of_copies_are_one_each(spark, tmp_path):
    """Thousands of exact and of near copies, a chain of texts each near the next, and clean texts that share a line with all."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base, other, line = [word() for _ in range(120)], [word() for _ in range(120)], " ".join(word() for _ in range(12))
    rows = [" ".join(base)] * 1500
    for _ in range(1500):
        near = list(other)
        near[rng.randrange(120)] = word()
        rows.append(" ".join(near))
    chain = [word() for _ in range(150)]
    for k in range(40):
        chain[3 * k] = word()
        rows.append(" ".join(chain))
    rows += [f"{' '.join(word() for _ in range(60))} {line}" for _ in range(300)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(order[k], t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(16)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    groups = [range(1500), range(1500, 3000), range(3000, 3040), *([k] for k in range(3040, 3340))]
    assert kept == {min(order[k] for k in g) for g in groups}
