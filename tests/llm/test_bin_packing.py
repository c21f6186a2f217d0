"""Op 11: the plan against placing items one by one, ids against the library, and the whole round trip."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bin_packing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(sizes, capacity):
    large = sorted((s for s in sizes if 3 * s > capacity), reverse=True)
    bins = []
    while large:
        a = large.pop(0)
        partner = next((i for i, b in enumerate(large) if a + b <= capacity), None)
        bins.append([a] if partner is None else [a, large.pop(partner)])
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fitting = [b for b in bins if sum(b) + s <= capacity]
        if fitting:
            max(fitting, key=sum).append(s)
        else:
            bins.append([s])
    return bins


def test_plan_equals_placing_one_by_one():
    rng = random.Random(1)
    for _ in range(600):
        capacity = rng.choice([1, 2, 5, 12, 30, 64, 100])
        sizes = [rng.randint(1, capacity) if rng.random() < 0.6 else rng.choice([1, max(1, capacity // 2), capacity // 3 + 1, capacity]) for _ in range(rng.randint(0, 60))]
        plan, n_bins = bin_packing.plan_bins(Counter(sizes), capacity)
        bins = defaultdict(list)
        for size, lo, hi, each, first, offset in plan:
            for r in range(lo, hi):
                bins[first + (r - lo) // each].append((offset + (r - lo) % each * size, size))
        assert set(bins) == set(range(n_bins))
        assert Counter(s for b in bins.values() for _, s in b) == Counter(sizes)
        for b in bins.values():
            assert [o for o, _ in sorted(b)] == list(np.cumsum([0] + [s for _, s in sorted(b)])[:-1])
            assert sum(s > capacity / 3 for _, s in b) <= 2
        assert sorted(sum(s for _, s in b) for b in bins.values()) == sorted(map(sum, one_by_one(sizes, capacity)))


def test_plan_stays_small_and_matching_is_best():
    plan, _ = bin_packing.plan_bins({s: 10**9 + 37 * s for s in range(1, 4097)}, 4096)
    assert len(plan) < 50_000
    # items above a third of the window alone: as many pairs as there can be
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(34, 66) for _ in range(rng.randint(1, 9))]
        most = {0: 0}
        for mask in range(1, 1 << len(sizes)):
            i = mask.bit_length() - 1
            rest = mask ^ (1 << i)
            most[mask] = max([most[rest], *(1 + most[rest ^ (1 << j)] for j in range(i) if rest >> j & 1 and sizes[i] + sizes[j] <= 100)])
        assert bin_packing.plan_bins(Counter(sizes), 100)[1] == len(sizes) - most[(1 << len(sizes)) - 1]


def test_ids_equal_the_library():
    library, own, rng = Tokenizer.from_file(PATH), bin_packing.WordEncoder(PATH), random.Random(3)
    assert own.proved
    pieces = ["the", "Straße", "naïve", "İstanbul", "ÀÉÎ", "don't", "WE'LL", "a'sb", "'S", "x²", "¼", "2024", "__init__", "—", "€5", "ǆ", "ſ", " ", "  ", "\n", "\t", " ", "日本", "😀", "é", "<|endoftext|>", "ß" * 40, "entscheidungen", "!?", "ª", " "]
    texts = ["", " ", *("".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 12))) for _ in range(4000))]
    texts += ["".join(rng.choice("aeinrstéüß' .A") for _ in range(30)) for _ in range(4000)]
    for t in texts:
        assert own.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def check(rows, docs, library):
    """Items give the documents back; sequences are gapless."""
    parts, places, want = defaultdict(list), defaultdict(list), Counter()
    ids = {}
    for i, t in docs:
        ids[t] = ids.get(t) or [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids[t]), bin_packing.WINDOW)):
            part = ids[t][s : s + bin_packing.WINDOW]
            want[i, k, s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    for r in rows:
        parts[r.doc_id, r.piece, r.start, r.length, r.ids_crc32].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert {k: len(v) for k, v in parts.items()} == want
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= bin_packing.WINDOW
    return places


def test_op11_round_trip(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op11_best_fit_packing(spark, sf).collect()
    places = check(rows, docs, Tokenizer.from_file(PATH))
    assert sorted(map(len, places.values())) and len(places) == len(one_by_one([r.length for r in rows], bin_packing.WINDOW))
    assert set(places) == set(range(len(places)))


def test_op11_edges(spark):
    assert bin_packing.pack_whole_documents(spark.createDataFrame([], DOCS), PATH).collect() == []
    texts = [(1, None), (2, ""), (None, "alone here."), (None, "alone here."), (5, "w " * 50_000), (7, "Same text."), (7, "Same text."), (9, " \t\n "), (10, "Größe 日本 😀.")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS).selectExpr("*", "1 as row", "'x' as res", "2 as length", "3 as rank", "4 as `a.b`")
    got = bin_packing.pack_whole_documents(docs, PATH)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "bigint", "bigint"]
    check(got.collect(), texts, Tokenizer.from_file(PATH))


@pytest.mark.parametrize("length", [1, 1365, 1366, 2048, 4096])
def test_op11_one_length(length):
    plan, n_bins = bin_packing.plan_bins({length: 1000}, 4096)
    each = 4096 // length
    assert n_bins == -(-1000 // each)
