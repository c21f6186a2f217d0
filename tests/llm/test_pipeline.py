"""The pipeline stage by stage, each on its own input."""

import random
from itertools import combinations

import corpus_pipeline
import public_tokenizers
import pytest
from millrace.llm import near_copies, simhash, toxicity
from millrace.llm._common import materialize
from test_llm_operators import brute_decontaminate, brute_fingerprint, brute_line_runs, check_packed
from tokenizers import Tokenizer


def brute_pipeline(spark, sf):
    """{doc_id: text} after each stage but the last, in plain Python; the scores are the operator's own."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rejected = {r.doc_id for r in toxicity.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.rejected}
    docs = {d: t for d, t in docs.items() if d not in rejected}
    yield "toxicity", docs
    order = sorted(docs.items())
    gone = brute_line_runs(spark, order)
    docs = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[(d, t)]) for d, t in order}
    yield "line_dedup", docs
    prints, shingles = {d: brute_fingerprint(t) for d, t in docs.items()}, {}
    for d, t in docs.items():
        words = "".join(c.lower() if c.isascii() else c for c in t).split()
        shingles[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(docs), 2):
        both = len(shingles[a] & shingles[b])
        if (prints[a] ^ prints[b]).bit_count() <= 2 or both and both >= 0.8 * (len(shingles[a]) + len(shingles[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    docs = {d: t for d, t in docs.items() if find(d) == d}
    yield "near_dedup", docs
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {d: t for d, t in docs.items() if not brute_decontaminate(t, items)[1]}
    yield "decontamination", docs


def test_pipeline_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for (name, stage), (same, want) in zip(corpus_pipeline.STAGES, brute_pipeline(spark, sf)):
        docs = materialize(stage(spark, docs, sf))
        assert name == same and docs.columns == columns
        assert {r.doc_id: r.text for r in docs.collect()} == want and all(r.n_chars == len(r.text) for r in docs.collect())
        sizes.append(len(want))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 0
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in want.items()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(ids)
    check_packed(rows, ids, 2048)


def test_stages_on_odd_rows(spark):
    odd = [(1, None), (2, ""), (None, "alone here, without an id."), (4, " \t\n "), (5, "w " * 50_000 + "end."), (6, "Same\ntext"), (6, "Same\ntext"), (7, "Same\ntext"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in odd], "doc_id long, text string, lang string").selectExpr("*", "1 as row", "2 as res", "3 as `a.b`", "4 as fp", "5 as key")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"))
        assert name == "packing" or docs.columns == columns
        kept.append(docs.count())
    # of the rows without words the first stays, of those with one text the first
    assert kept[:4] == [9, 9, 4, 4] and {r.doc_id for r in docs.collect()} == {1, None, 5, 6}


def test_stages_on_empty_and_repeated_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.limit(30).union(docs.limit(30)).withColumnRenamed("source", "row")
    for start in (docs.where("false"), twice):
        d = start
        for _, stage in corpus_pipeline.STAGES:
            d = materialize(stage(spark, d, sf))


def test_line_dedup_rows(spark):
    lines = [f"line {i} of the passage" for i in range(9)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines)), (None, "first\n" + "\n".join(lines)), (10, "lone line"), (11, "lone line"), (12, None), (13, "x\ny"), (14, "x\n\ny"), (15, "y\nx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert out.pop(None) == rows[2][1] and out.pop(1) == "" and out.pop(2) == ""
    assert out == {10: "lone line", 11: "lone line", 12: None, 13: "x\ny", 14: "", 15: "y\nx"}


def test_near_dedup_drops_near_copies_beyond_two_bits(spark):
    rng = random.Random(3)
    rows, far = [], 0
    for i in range(30):
        words = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(100)]
        near = [*words]
        near[40] = "changed"  # 91 of 101 shingles are in both
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
        a, b = (simhash.fingerprint(t.encode()) for _, t in rows[-2:])
        far += ((a ^ b) & (1 << 64) - 1).bit_count() > 2
    assert far
    stage = corpus_pipeline.drop_near_duplicates
    docs = spark.createDataFrame([*rows, (90, "one two"), (91, "one three"), (92, None)], "doc_id long, text string")
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == {*range(0, 60, 2), 90, 91, 92}
    marked = [(simhash.fingerprint(t.encode()), near_copies.bands(t.encode()), t) for _, t in rows]
    marked = materialize(spark.createDataFrame(marked, "fp long, bands array<long>, text string").selectExpr("fp", "bands", "xxhash64(text) as text_key"))
    whole = {(r.u, r.v) for r in simhash.components(near_copies.links(docs, marked)).collect()}
    assert whole and whole == {(r.u, r.v) for r in simhash.components(near_copies.links(docs, marked, max_paired=1)).collect()}


def test_near_dedup_ties(spark):
    schema = "doc_id long, text string, source string"
    one = "the same words in each of these rows here"
    docs = spark.createDataFrame([(1, one, "a"), (1, one, "b"), (1, one.upper(), "c"), (None, one, "d"), (2, "x y", None), (2, "x y", None), (None, None, "e"), (None, "", "f")], schema)
    kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len(kept) == 3 and (2, "x y", None) in kept and sum(r[0] == 1 for r in kept) == 1
    again = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs.orderBy("source"), "").collect()]
    assert sorted(map(str, kept)) == sorted(map(str, again))


def marked_texts(spark, rows):
    marked = [(simhash.fingerprint(t.encode()), near_copies.bands(t.encode()), t) for _, t in rows]
    return materialize(spark.createDataFrame(marked, "fp long, bands array<long>, text string").selectExpr("fp", "bands", "xxhash64(text) as text_key"))


def exact_groups(spark, rows):
    """Linked fingerprints with the least of their group, from all pairs."""
    sets = {simhash.fingerprint(t.encode()): set(near_copies.grams(t.encode()).tolist()) for _, t in rows}
    exact = [(max(a, b), min(a, b)) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return set(exact), grouped(spark.createDataFrame(exact, "u long, v long"))


def grouped(edges):
    return {(r.u, r.v) for r in simhash.components(edges).collect()}


def random_words(rng, n, of=900):
    return [rng.choice("abcdefgh") + str(rng.randrange(of)) for _ in range(n)]


@pytest.mark.parametrize("max_paired", [8, 64])
def test_large_groups_of_near_copies_stay_whole(spark, max_paired):
    rng = random.Random(15)
    rows, ids = [], iter(rng.sample(range(10_000), 400))
    for _ in range(2):  # two texts, each with many copies that differ in four words, and so have 0.66 in common with each other
        words = random_words(rng, 200)
        rows.append((next(ids), " ".join(words)))
        for _ in range(90):
            copy = [*words]
            for at in rng.sample(range(6, 194, 12), 4):
                copy[at] = "changed" + str(rng.randrange(10**6))
            rows.append((next(ids), " ".join(copy)))
    found = near_copies.links(spark.createDataFrame(rows, "doc_id long, text string"), marked_texts(spark, rows), max_paired=max_paired)
    exact, want = exact_groups(spark, rows)
    assert {(r.u, r.v) for r in found.collect()} <= exact and len(want) > 170 and grouped(found) == want


@pytest.mark.parametrize("max_paired", [4, 64, 10**6])
def test_pairs_in_a_common_template_are_found(spark, max_paired):
    # 100 pairs of texts that share most of their words with all others: pairs have 0.8 in common, texts of two pairs less
    rng = random.Random(16)
    template, rows = random_words(rng, 435), []
    for i in range(100):
        own = random_words(rng, 65, 10**6)
        near = [*own]
        near[rng.randrange(65)] = "changed"
        rows += [(2 * i, " ".join([*template, *own])), (2 * i + 1, " ".join([*template, *near]))]
    # texts of other lengths, some of which are near to several
    for i, cut in enumerate((40, 60, 80, 90, 100, 110)):
        rows += [(300 + i, " ".join(template[cut:] + random_words(rng, 30, 10**6))), (400 + i, " ".join(template + random_words(rng, cut, 10**6)))]
    found = near_copies.links(spark.createDataFrame(rows, "doc_id long, text string"), marked_texts(spark, rows), max_paired=max_paired)
    exact, want = exact_groups(spark, rows)
    assert {(r.u, r.v) for r in found.collect()} <= exact and len(want) >= 100 and grouped(found) == want


def test_near_copies_of_random_edits_equal_all_pairs(spark):
    rng = random.Random(17)
    rows = []
    for g in range(3):
        base = random_words(rng, 120)
        for i in range(60):
            copy = base[rng.choice([0, 0, 3, 8]) : 120 - rng.choice([0, 0, 5, 10])]
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(50))
            rows.append((100 * g + i, " ".join(copy)))
    found = near_copies.links(spark.createDataFrame(rows, "doc_id long, text string"), marked_texts(spark, rows), max_paired=5)
    exact, want = exact_groups(spark, rows)
    assert {(r.u, r.v) for r in found.collect()} <= exact and grouped(found) == want


def test_components_of_a_star(spark):
    edges = spark.range(1, 100_001).selectExpr("id as u", "0L as v")
    found = simhash.components(edges)
    assert found.count() == 100_000 and found.agg({"v": "max"}).first()[0] == 0
