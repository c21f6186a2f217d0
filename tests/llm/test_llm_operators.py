"""Each operator against a brute-force version, and its edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from millrace.llm import decontaminate, license_scan, line_chunks, packing, quality_rules, queries, sentence_spans, sharding, simhash, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "w " * 50_000 + "end."


def edge_docs(spark, more=()):
    rows = [(1, None), (2, ""), (None, "alone here."), (4, "a b"), (5, LONG), (6, "Same text here.\nSame again."), (7, "Same text here.\nSame again."),
            (7, "Same text here.\nSame again."), (9, " \t\n "), (10, "Größe ÉTÉ naïve 日本 😀.")]
    rows = [*rows, *more]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).selectExpr("*", "1 as row", "'x' as res", "2 as score", "3 as fp", "4 as root", "5 as lines", "6 as gone", "7 as `a.b`")


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# op1


def brute_repeats(words, k=5):
    seen = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return len({j for i in range(len(words) - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})


def test_quality_measures_equal_brute_force(spark, sf, texts):
    for r in queries.op1_quality_rules(spark, sf).collect():
        t = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, brute_repeats(words))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_repeats_random():
    rng = random.Random(1)
    for n in (0, 4, 5, 6, 30, 200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(n)]
        assert quality_rules.repeated_words(words) == brute_repeats(words)


def test_quality_edges_and_ablation(spark):
    rows = quality_rules.ledger(edge_docs(spark))
    got = rows.collect()
    assert len(got) == 10 and {r.n_words for r in got if r.doc_id in (1, 2, 9)} == {0}
    assert next(r.word_chars for r in got if r.doc_id == 10) == len("GrößeÉTÉnaïve日本😀.")
    ablation = {r.rule: r for r in quality_rules.ablation(rows).collect()}
    bits = [r.failed for r in got]
    for rule in quality_rules.RULES:
        assert ablation[rule.name].n_failed == sum(b >> rule.bit & 1 for b in bits)
        assert ablation[rule.name].n_failed_alone == sum(b == 1 << rule.bit for b in bits)
        assert ablation[rule.name].n_kept_without == sum(b & ~(1 << rule.bit) == 0 for b in bits)
    assert quality_rules.ledger(empty(spark)).count() == 0
    assert {r.n_failed for r in quality_rules.ablation(quality_rules.ledger(empty(spark))).collect()} == {0}


# op2


def brute_licenses(text):
    """(coefficient, line, licence) of every unit of every template, none of them pruned."""
    parts = license_scan.segments(text.encode())
    out = []
    for name, template in license_scan.TEMPLATES:
        t = decontaminate.words_of(template.encode())
        grams = license_scan.bigrams(t)
        for i in range(len(parts)):
            n, j = 0, i
            while j < len(parts) and n < len(t):
                n += len(parts[j][1])
                j += 1
            for end in {j, j - 1} - {i}:
                unit = license_scan.bigrams([w for _, part in parts[i:end] for w in part])
                dice = 2 * len(unit & grams) / (len(unit) + len(grams)) if unit else 0
                if dice >= 0.8:
                    out.append((dice, parts[i][0], name))
    return out


def check_license(row, found):
    assert row.n_matches == len(found) and row.licenses == ",".join(sorted({x[2] for x in found}))
    if found:
        dice, line, name = min((-d, line, name) for d, line, name in found)
        assert (row.license_id, row.line_no, row.dice) == (name, line, round(-dice, 6))
    else:
        assert row.license_id is None and row.line_no == -1 and row.dice is None


def test_license_scan_equals_all_templates(spark, sf, texts):
    rows = queries.op2_license_scan(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_matches > 0 for r in rows) > 3
    chosen = [r for r in rows if r.n_matches or r.doc_id % 9 == 0 and len(texts[r.doc_id]) < 4000]
    for r in chosen:
        check_license(r, brute_licenses(texts[r.doc_id]))


def test_wrapped_notices_and_whole_licences(spark):
    known = dict(license_scan.TEXTS)
    hashed = "\n".join("# " + line for line in known["MIT"].splitlines())
    notice = "Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated documentation files."
    rows = {
        1: "import os\n# Copyright (c) 2020 Somebody\n#\n" + hashed + "\nprint(1)",
        2: "x = 1\n# " + notice + "\ny = 2",
        3: "Some words come before. Released under the MIT License. And others after it.",
        4: "preface\n\n" + known["BSD-3-Clause"].replace("COPYRIGHT HOLDER OR", "REGENTS OR"),
        5: known["GPL-3.0"], 6: known["Apache-2.0"], 7: "nothing of the kind here, only some words.", 8: "All rights reserved.",
    }
    docs = spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    want = {1: ("MIT", 4), 2: ("MIT", 2), 3: ("MIT", 1), 4: ("BSD-3-Clause", 3), 5: ("GPL-3.0", 1), 6: ("Apache-2.0", 2), 7: (None, -1), 8: ("proprietary", 1)}
    assert {k: (r.license_id, r.line_no) for k, r in got.items()} == want
    for k in (1, 2, 3, 4, 7, 8):
        check_license(got[k], brute_licenses(rows[k]))


def test_license_edges(spark):
    got = {r.doc_id: r for r in license_scan.scan_licenses(edge_docs(spark, [(20, "text\nReleased under the MIT License"), (21, "Released under MIT License now ok")])).collect()}
    assert got[20].license_id == "MIT" and got[20].line_no == 2 and got[20].dice == 1.0
    assert got[21].license_id is None and got[1].n_matches == 0
    assert license_scan.scan_licenses(empty(spark)).count() == 0


# op3


def brute_lpt(sizes, n):
    loads = [0] * n
    counts = [defaultdict(int) for _ in range(n)]
    for s in sorted(sizes, reverse=True):
        k = min(range(n), key=lambda i: (loads[i], i))
        loads[k] += s
        counts[k][s] += 1
    return loads, counts


def test_schedule_equals_one_by_one():
    rng = random.Random(2)
    for case in range(60):
        n = rng.randint(1, 8)
        sizes = [rng.choice([1, 2, 3, 7, 50, 51, 1000]) for _ in range(rng.randint(0, 80))] + ([9000] if case % 3 == 0 else [])
        plan = sharding.schedule(list(Counter(sizes).items()), n)
        loads, counts = brute_lpt(sizes, n)
        got = [0] * n
        for size, lo, hi, shard in plan:
            got[shard] += size * (hi - lo)
            assert counts[shard][size] == hi - lo
        assert got == loads


def test_sharding(spark, sf, texts):
    rows = queries.op3_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_text, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in rows:
        t = texts[r.doc_id]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        by_text[t].add(r.shard)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    groups = Counter()
    for t in texts.values():
        groups[t] += len(t.encode()) + 1
    assert sorted(load.values()) == sorted(brute_lpt(groups.values(), 8)[0])


def test_sharding_with_size_classes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EXACT", 50)
    monkeypatch.setattr(sharding, "STEPS", 20)
    rng = random.Random(13)
    texts = [f"{i} " + "x" * rng.randint(1, 2000) for i in range(1500)]
    rows = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert len(rows) == 1500 and max(load.values()) < 1.01 * min(load.values())


def test_sharding_edges(spark):
    rows = sharding.shard_documents(edge_docs(spark)).collect()
    assert len(rows) == 10 and len({r.shard for r in rows if r.doc_id in (6, 7)}) == 1
    assert {r["size"] for r in rows if r.doc_id in (1, 2)} == {1}
    assert sharding.shard_documents(empty(spark)).count() == 0


# op4


def brute_decontaminate(text, items, k=10):
    words = decontaminate.words_of(text.encode()) if text else []
    hit, ids = set(), set()
    for item_id, item in items:
        w = decontaminate.words_of(item.encode()) if item else []
        n = min(k, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                ids.add(str(item_id))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_decontamination_equals_brute_force(spark, sf, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = queries.op4_decontamination(spark, sf).collect()
    assert any(r.contaminated for r in rows) and len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute_decontaminate(texts[r.doc_id], items)


def test_suffix_array():
    rng = random.Random(14)
    for words, n in ((3, 400), (50, 300), (100_000, 300), (1, 40)):
        stream = np.array([rng.randint(0, words) for _ in range(n)], dtype=np.int64)
        for depth in (1, 4, 10):
            order = decontaminate.suffix_array(stream, depth)
            firsts = [stream[i : i + depth].tolist() for i in order]
            assert sorted(order.tolist()) == list(range(n)) and firsts == sorted(firsts)


@pytest.mark.parametrize("block", [10**9, 40])
def test_decontamination_edges_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 7)
    items = [(1, "a b"), (2, None), (3, "  "), (None, "same text"), (5, "w " * 12), (6, "alone"), (7, "A B"), (8, "one two three four five six seven eight nine ten eleven twelve")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = [(20, "x one two three four five six seven eight nine ten ELEVEN y a b two three four five six seven eight nine ten eleven twelve"), (21, "a-b alone a")]
    docs = edge_docs(spark, more)
    known = [(i, t) for i, t in items if i is not None and t is not None]
    for r in decontaminate.find_matches(docs, bench).collect():
        want = brute_decontaminate(r.row.text, known)
        assert (r.res.n_words, r.res.n_hit, len(r.res["items"])) == want[:3]
        if r.row.doc_id == 20:
            found = {(m.item_id, m.item_pos, m.doc_pos, m.n_words) for m in r.res.matches}
            assert {("8", 0, 1, 11), ("8", 1, 15, 11), ("1", 0, 13, 2), ("7", 0, 13, 2)} == found
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and 20 not in {r.doc_id for r in kept.collect()}
    assert decontaminate.find_matches(empty(spark), bench).count() == 0
    assert decontaminate.remove_contaminated(docs, bench.where("false")).count() == docs.count()


# op5


@pytest.fixture(scope="module")
def toxicity_rows(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 has eight toxic texts in the held-out fold, too few to tell
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return queries.op5_toxicity(spark, sf).collect(), labels


def test_toxicity_held_out(toxicity_rows):
    rows, labels = toxicity_rows
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in pos for b in neg]) > 0.95


def test_toxicity_edges(spark):
    docs = edge_docs(spark, [(100 + i, f"you {'idiot' if i % 3 == 0 else 'friend'} number {i} here") for i in range(60)])
    labels = spark.createDataFrame([(100 + i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (101, None), (100, 0)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.classify(docs, labels).collect() if r.doc_id}
    assert rows[1].score == rows[2].score == rows[9].score
    assert rows[103].score > 0.5 > rows[104].score
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 104 in {r.doc_id for r in kept.collect()}
    assert {r.score for r in toxicity.classify(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.classify(empty(spark), labels).count() == 0


def test_toxicity_bounds_skip_only_what_is_too_long(spark):
    rows = [(i, ("you idiot " if i % 2 else "dear friend ") * (2000 if i < 3 else 1), "en") for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_bytes=5000)
    assert model and not {0, 1, 2} & set(model.fitted) and len(model.fitted) > 20
    assert len(toxicity.train(docs, labels, max_train=7).fitted) == 7
    assert toxicity.train(docs, labels, max_bytes=5) is None


def test_toxicity_thresholds_equal_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["en", "de", "fr", None]), round(rng.random(), 3), int(rng.random() < 0.3)) for i in range(800)]
    rows = [(i, lang, min(1.0, s / 2 + y / 2.5), y) for i, lang, s, y in rows] + [(900 + i, "xx", 0.2, 1) for i in range(3)]
    scored, labels = spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, score double"), spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(["a", "b"], [0, 1])
    model.fitted = list(range(100))
    got = toxicity.calibrate(scored, labels, model)
    checked = [r for r in rows if r[0] >= 100 and zlib.crc32(str(r[0]).encode()) % 5]

    def best(of):
        bins = [int(r[2] * 1000) for r in of]
        f1 = lambda b: 2 * sum(r[3] for r, x in zip(of, bins) if x >= b) / (sum(x >= b for x in bins) + sum(r[3] for r in of))
        return max(set(bins), key=lambda b: (f1(b), -abs(b - 500), b)) / 1000

    assert got == {"": best(checked), **{lang: best([r for r in checked if r[1] == lang]) for lang in ("en", "de", "fr")}}
    assert toxicity.calibrate(scored, labels, None) == {}


def test_toxicity_scores_equal_the_forward_pass_written_out():
    model = toxicity.fit(["you are a stupid idiot", "a nice day out", "idiot you", "kind words here"] * 6, [1, 0, 1, 0] * 6)
    for text in ("you are a stupid idiot", "Nice, kind IDIOT day", "", None, "one", "été naïve 日本 stupid"):
        words = re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())
        embedded = []
        for w in words:
            whole, first = zlib.crc32(w), zlib.crc32(w[: toxicity.PREFIX], 7)
            at = [whole % toxicity.BUCKETS, whole // toxicity.BUCKETS, first % toxicity.BUCKETS]
            embedded.append([sum(float(model.tables[t][at[t]][d]) for t in range(3)) for d in range(toxicity.DIM)])
        embedded += [[0.0] * toxicity.DIM] * (max(toxicity.WIDTHS) - len(words))
        z, k = model.shift, 0
        for width, kernel in zip(toxicity.WIDTHS, model.kernels):
            for f in range(toxicity.FILTERS):
                best = max(sum(embedded[i + o][d] * float(kernel[o][d][f]) for o in range(width) for d in range(toxicity.DIM)) for i in range(len(embedded) - width + 1))
                z += max(0.0, best + model.bias[k]) * model.out[k]
                k += 1
        assert toxicity.Scorer(model).score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_toxicity_long_text_in_chunks(monkeypatch):
    model = toxicity.fit(["bad word here", "good word here"] * 5, [1, 0] * 5)
    text = " ".join(f"w{i}" for i in range(100))
    whole = toxicity.Scorer(model).score(text)
    monkeypatch.setattr(toxicity, "_CHUNK", 7)
    monkeypatch.setattr(toxicity, "_CACHE", 5)
    assert toxicity.Scorer(model).score(text) == pytest.approx(whole)


# op6


def test_token_counts_equal_library(spark, sf, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.op6_token_counts(spark, sf).collect():
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(library.encode(texts[r.doc_id])))
        assert r.over_limit == (r.n_tokens > 4096)


ODD = ["", " ", "  ", " a", "a ", "a  b", "▁a ▁ b▁ c", "a\n\nb\t c", "<s>x</s>", "<|endoftext|> a", "é ﬁ \u0000", "日本 語", "a" * 300, "don't I'll 've", "x \n y", "1234567 89", "tab\there", " nb",
       "a b", "\x1c\x1d", "end. \n", "\n", "ǅ ʰ ² ½ ٣", "é x", "😀 ok"]


def test_token_counts_odd_texts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    counter, library = token_counts.PieceCounter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert counter.separable and len(counter.whole) > 10_000
    assert [counter.count(t) for t in ODD] == [len(library.encode(t)) for t in ODD]


def test_token_counts_random_texts(monkeypatch):
    monkeypatch.setattr(token_counts, "_CACHE", 40)
    path = public_tokenizers.path("piece_bpe_32k.model")
    counter, library = token_counts.PieceCounter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(11)
    units = [*"ab cdet  \n\t.,é日▁'1Z\u3000", "  ", " the ", " a", "ing", "x" * 40, "<s>"]
    for _ in range(5000):
        text = "".join(rng.choice(units) for _ in range(rng.randint(0, 14)))
        assert counter.count(text) == len(library.encode(text)), text


def test_token_counts_edges(spark):
    assert token_counts.count_tokens(empty(spark), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    rows = token_counts.count_tokens(edge_docs(spark), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(rows) == 10 and {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (1, 2)} == {(0, 0)}


# op7


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_library(library, texts):
    known = packing.IdEncoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for t in [*ODD, *list(texts.values())[:60]]:
        assert np.frombuffer(known.encode(t), dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    rng = random.Random(3)
    plain = [chr(c) for c in [10, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028), 0x20AC]]
    for _ in range(300):
        t = "".join(rng.choice(plain) if rng.random() < 0.7 else rng.choice(" \n'a1") for _ in range(30))
        assert np.frombuffer(known.encode(t), dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def check_packed(rows, ids, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : at], dtype="<u4").tobytes())
        assert at == len(ids[d])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_seq)


def test_packing_round_trip(spark, sf, texts, library):
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    rows = queries.op7_packing(spark, sf).collect()
    n = check_packed(rows, ids, 2048)
    assert {r.doc_id for r in rows} == set(texts)
    assert sum(map(len, ids.values())) / (2048 * n) > 0.95


def test_plan_stays_within_the_histogram():
    rng = random.Random(4)
    for hist in ({1: 5}, {256: 3}, {c: rng.randint(0, 9) for c in range(1, 257)}, {40: 1000}, {200: 50, 3: 1000}, {}):
        hist = {c: n for c, n in hist.items() if n}
        plan = packing.plan_sequences(hist, 256)
        used = Counter()
        for chosen, repeats in plan:
            assert sum(c * m for c, m in chosen.items()) == 256 and repeats > 0
            for c, m in chosen.items():
                used[c] += m * repeats
        assert all(used[c] <= n for c, n in hist.items()) and set(used) <= set(hist)
    assert packing.plan_sequences({128: 10, 64: 4, 192: 4}, 256)


def test_rest_is_packed_whole():
    rng = random.Random(6)
    for lengths in ([], [1] * 5000, [300] * 400, [rng.randint(1, 2047) for _ in range(500)], [2047] * 9, [33] * 3000, [1500, 3, 900]):
        made = packing.pack_rest(lengths, 2048)
        cover, filled = defaultdict(list), defaultdict(list)
        for i, start, n, sequence, offset in made:
            cover[i].append((start, n))
            filled[sequence].append((offset, n))
        assert sorted(cover) == list(range(len(lengths)))
        for spans, total in [*((v, lengths[i]) for i, v in cover.items()), *((v, None) for v in filled.values())]:
            at = 0
            for start, n in sorted(spans):
                assert start == at and n > 0
                at += n
            assert at == total if total is not None else at <= 2048
        assert len(filled) <= sum(lengths) // (2048 - packing.CUT) + 1


def test_crc_between():
    ids = np.array([random.Random(8).randrange(50_000) for _ in range(1000)], dtype="<u4").tobytes()
    crcs = packing._prefix_crcs(ids, 2048)
    for start, n in ((0, 1000), (0, 32), (64, 936), (32, 64), (992, 8)):
        assert packing.crc_between(crcs, start, n) == zlib.crc32(ids[4 * start : 4 * (start + n)])


@pytest.mark.parametrize("tokens, n", [([1], 20_480), ([9], 40_000), ([33], 12_000), ([300], 2_400), ("mean 12", 40_000)])
def test_packing_leaves_little_padding(spark, library, tokens, n):
    rng = random.Random(9)
    texts = ["" if k == 1 else "a" + " a" * (k - 2) for k in (tokens[0] if tokens != "mean 12" else min(2000, 1 + int(rng.expovariate(1 / 11.5))) for _ in range(n))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert sum(map(len, ids.values())) / (2048 * check_packed(rows, ids, 2048)) > 0.98


def test_nnls_small():
    a, b = np.array([[1.0, 0, 1], [0, 1, 1]]), np.array([3.0, 1.0])
    x = packing.nnls(a, b)
    assert (x >= 0).all() and np.allclose(a @ x, b)
    assert np.allclose(packing.nnls(np.eye(2), np.array([-1.0, 2.0])), [0, 2])


def test_packing_edges(spark):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = packing.pack_documents(edge_docs(spark), *paths).collect()
    assert {(r.start, r.length) for r in rows if r.doc_id in (1, 2)} == {(0, 1)} and sum(r.doc_id == 7 for r in rows) == 2
    assert sum(r.length for r in rows if r.doc_id == 5) == next(r.doc_tokens for r in rows if r.doc_id == 5)
    assert packing.pack_documents(empty(spark), *paths).count() == 0


# op8


def brute_sentences(text):
    """Word lists: an end is the least gap of some WIDTH in succession; end marks and what lies outside the text count as 0."""
    words = re.findall(r"\s*\S+\s*", text or "")
    value = [0 if i == len(words) - 1 or re.search(r"[.!?…][\"')\]”’»]*\s+$|\n\s*$", w) else int.from_bytes(xxhash.xxh3_128_digest(w.strip().encode())[:8], "little") | 1 for i, w in enumerate(words)]
    ends, at = set(), lambda i: value[i] if 0 <= i < len(words) else 0
    for start in range(1 - sentence_spans.WIDTH, len(words)):
        window = range(start, start + sentence_spans.WIDTH)
        ends |= {i for i in window if 0 <= i < len(words) and at(i) == min(map(at, window))}
    cut = [0, *(i + 1 for i in sorted(ends))]
    return [words[i:j] for i, j in zip(cut, cut[1:])]


def brute_runs(parts):
    """(first, after last) of each run."""
    out = []
    for i in range(len(parts)):
        ends = [j for j in range(i + 3, len(parts) + 1) if sum(map(len, parts[i:j])) >= sentence_spans.MIN_WORDS]
        if ends:
            out.append((i, ends[0]))
    if out and out[-1][1] < len(parts):
        out.append((out[-1][0], len(parts)))
    return out


def brute_spans(docs):
    """docs: (id, text) in order of id; {index: removed sentence places}."""
    seen, gone = {}, defaultdict(set)
    for k, (d, t) in enumerate(docs):
        parts = brute_sentences(t)
        for i, j in brute_runs(parts):
            run = tuple(w.strip() for p in parts[i:j] for w in p)
            if seen.setdefault(run, (d, i)) != (d, i):
                gone[k].update(range(i, j))
    return gone


def test_sentences_make_up_the_text(texts):
    for t in [*ODD, *texts.values(), "A. B!  C?\n\n D", "\n\na. ", LONG, "日本語の文。もう一つの文です。三つ目"]:
        assert "".join(sentence_spans.sentences(t)) == (t if t.strip() else "")
    for t in [*texts.values()][:40]:
        assert sentence_spans.sentences(t) == ["".join(p) for p in brute_sentences(t)]


def test_spans_in_batches_equal_spans_alone(texts):
    words = [sentence_spans.words_of(t) for t in [*list(texts.values())[:50], "", None, " "]]
    together = sentence_spans.spans(words)
    for k, w in enumerate(words):
        alone, of = sentence_spans.spans([w]), together.text == k
        assert alone.h1.tolist() == together.h1[of].tolist() and alone.h2.tolist() == together.h2[of].tolist()
        assert list(zip(alone.first.tolist(), alone.last.tolist())) == brute_runs(["" if not w else p for p in brute_sentences("".join(w))])


def test_substring_dedup_equals_brute_force(spark, sf, texts):
    order = sorted(texts.items())
    gone = brute_spans(order)
    rows = {r.doc_id: r for r in queries.op8_substring_dedup(spark, sf).collect()}
    assert len(rows) == len(texts) and any(gone.values())
    for k, (d, t) in enumerate(order):
        parts = brute_sentences(t)
        assert rows[d].n_removed == len(gone[k]) and rows[d].n_sentences == len(parts)
        assert rows[d].text == ("".join("".join(p) for i, p in enumerate(parts) if i not in gone[k]) if gone[k] else t)
        assert bool(rows[d].repeats_of) == bool(gone[k])


def test_passages_of_50_words_are_caught_wherever_they_stand():
    rng = random.Random(7)
    for mark in ("", ".", ","):
        word = lambda: "".join(rng.choice("abcdefg") for _ in range(5)) + (mark if rng.random() < 0.1 else "")
        for _ in range(150):
            passage = " ".join(word() for _ in range(50))
            made = [f"{' '.join(word() for _ in range(rng.randint(0, 30)))} {passage} {' '.join(word() for _ in range(rng.randint(0, 30)))}" for _ in range(2)]
            s = sentence_spans.spans([sentence_spans.words_of(t) for t in made])
            a, b = (set(zip(s.h1[s.text == k].tolist(), s.h2[s.text == k].tolist())) for k in (0, 1))
            assert a & b


def test_substring_edges(spark):
    run = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen. A b c d e f g h."
    wide = "日本語の最初の文です。これは二つ目の文です。そして三つ目の文があります。"
    more = [(30, run), (31, f"Before this. {run} After that."), (32, f"{run} {run}"), (33, run), (33, f"Again. {run}"), (40, wide), (41, f"前の文。{wide}後の文。"), (None, "Other words. " + wide)]
    rows = sentence_spans.dedup_sentences(edge_docs(spark, more)).collect()
    by = {r.doc_id: r for r in rows}
    assert by[30].n_removed == 0 and by[31].text == "Before this. After that." and by[31].repeats_of == [30]
    assert by[32].text == "" and by[1].text is None and by[1].n_sentences == 0 and by[9].text == " \t\n " and by[9].n_sentences == 0
    assert sorted(r.text for r in rows if r.doc_id == 33) == ["", "Again. "]
    assert by[40].text == "" and by[41].text == "前の文。後の文。" and by[41].repeats_of == []
    assert sum(r.doc_id == 7 for r in rows) == 2 and len(rows) == 18 and by[5].n_removed > 0
    assert sentence_spans.dedup_sentences(empty(spark)).count() == 0
    named = spark.createDataFrame([("a", run), ("b", run), (None, "x")], "doc_id string, text string")
    assert {(r.doc_id, r.text, *r.repeats_of) for r in sentence_spans.dedup_sentences(named).collect()} == {("a", run), ("b", "", "a"), (None, "x")}


def test_substring_dedup_keeps_repeats_inside_the_first_place(spark):
    run = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen. A b c d e f g h."
    docs = spark.createDataFrame([(1, f"{run} Between these two here. {run}"), (2, "No repeat in this one.")], "doc_id long, text string")
    out = {r.doc_id: r for r in sentence_spans.dedup_sentences(docs).collect()}
    assert out[1].text == f"{run} Between these two here. " and out[1].repeats_of == [1] and out[2].repeats_of == []


def test_substring_dedup_tells_rows_without_an_id_and_versions_apart(spark):
    run = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen. A b c d e f g h."
    rows = [(None, f"{x} {run}") for x in ("First row.", "Second row.", "Third row.")] + [(5, f"{x} {run}") for x in ("Old.", "New.")] + [(5, f"Old. {run}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in sentence_spans.dedup_sentences(docs).select("doc_id", "text", "n_removed").collect()]
    assert len(out) == 6 and sum(t.endswith(run) for _, t, _ in out) == 1
    assert sum(d is None and n > 0 for d, _, n in out) == 2 and all(n > 0 for d, _, n in out if d == 5)
    versions = docs.where("doc_id = 5")
    out = sorted(tuple(r) for r in sentence_spans.dedup_sentences(versions).select("text", "n_removed").collect())
    # equal rows are alike; of two versions one keeps the passage
    assert len({t for t, _ in out}) == 2 and {n > 0 for _, n in out} == {False, True}


def test_substring_dedup_takes_the_end_of_a_copy(spark):
    text = "".join(f"Sentence {i} has these six words. " for i in range(4)) + "Short end. Last."
    assert sentence_spans.spans([sentence_spans.words_of(text)]).last[-1] == 6
    rows = [(1, text), (2, text), (3, f"Another beginning of a few words. {text}")]
    out = {r.doc_id: r.text for r in sentence_spans.dedup_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: text, 2: "", 3: "Another beginning of a few words. "}


# op9


def brute_fingerprint(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, k=2):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(nodes, 2):
        if bin(a ^ b).count("1") <= k:
            root[find(b)] = find(a)
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(spark, sf, texts):
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    comp = brute_components(set(fps.values()))
    least = defaultdict(lambda: 10**9)
    for d, f in fps.items():
        least[comp[f]] = min(least[comp[f]], d)
    rows = queries.op9_simhash(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == least[comp[fps[r.doc_id]]]


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("max_paired", [1, 3, 64])
def test_links_lose_nothing(spark, distance, max_paired):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(40)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    nodes = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    stars = {r.u: r.v for r in simhash.components(simhash.links(nodes, distance, 4, max_paired)).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for f, s in signed.items():
        groups[stars.get(s, s)].add(f)
    for f, root in brute_components(fps, distance).items():
        want[root].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "u long, v long").repartition(3)
    assert {(r.u, r.v) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 201)}


def test_simhash_edges(spark):
    docs = edge_docs(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id in (1, 2, 9)} == {1}
    kept = simhash.drop_near_duplicates(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(6) == 1 and 7 not in ids and None in ids and 2 not in ids
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.drop_near_duplicates(empty(spark)).count() == 0


# op10


def brute_line_runs(spark, docs):
    """Removed line places by (id, text): the operator's line hash, plain Python for all else."""
    filled = {(d, t): [(i, x) for i, x in enumerate(t.split("\n")) if re.search(r"[^ \t\n\x0b\f\r]", x)] for d, t in docs if t is not None}
    lines = sorted({x for f in filled.values() for _, x in f})
    h = {r.x: r.h for r in spark.createDataFrame([(x,) for x in lines], "x string").selectExpr("x", "xxhash64(x) as h").collect()}
    first, chunks, gone = {}, [], defaultdict(set)
    for key, f in filled.items():
        hs, texts = [h[x] for _, x in f], [x for _, x in f]
        for sign in (1, -1):
            starts = [i for i in range(len(f)) if i == 0 or 2 <= i <= len(f) - 2 and sign * hs[i] < sign * hs[i - 1] and sign * hs[i] < sign * hs[i + 1]]
            for k, (i, j) in enumerate(zip(starts, [*starts[1:], len(f)])) if len(f) > 1 else ():
                around = (starts[k - 1] if k else 0, [*starts[2:], len(f), len(f)][k])
                chunks.append((tuple(texts[i:j]), key, i, j, around))
    for chunk, key, i, j, around in chunks:
        if chunk not in first or (key, i) < first[chunk][:2]:
            first[chunk] = (key, i, j, around)
    for chunk, key, i, j, (lo, hi) in chunks:
        at, a, b, (low, high) = first[chunk]
        if (key, i) == (at, a):
            continue
        mine, its = [x for _, x in filled[key]], [x for _, x in filled[at]]
        if key != at:
            while i > lo and a > low and mine[i - 1] == its[a - 1]:
                i, a = i - 1, a - 1
            while j < hi and b < high and mine[j] == its[b]:
                j, b = j + 1, b + 1
        gone[key].update(range(filled[key][i][0], filled[key][j - 1][0] + 1))
    return gone


def test_line_dedup_equals_brute_force(spark, sf, texts):
    order = sorted(texts.items())
    gone = brute_line_runs(spark, order)
    rows = {r.doc_id: r for r in queries.op10_line_dedup(spark, sf).collect()}
    assert len(rows) == len(texts) and any(gone.values())
    for d, t in order:
        lines = t.split("\n")
        assert rows[d].n_lines == len(lines) and rows[d].n_removed == len(gone[(d, t)])
        assert rows[d].text == "\n".join(x for i, x in enumerate(lines) if i not in gone[(d, t)])


def test_line_dedup_comes_through_chunks(spark, monkeypatch):
    rng = random.Random(10)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(n))
    passages = [[words(8) for _ in range(12)] for _ in range(20)]
    rows = [(i, "\n".join([words(7), *p, words(7)])) for i, p in enumerate(passages)]
    rows += [(100 + i, "\n".join([words(6), words(6), *p[:5], "", *p[5:], words(6)])) for i, p in enumerate(passages)]
    rows += [(200 + i, "\n".join(p)) for i, p in enumerate(passages)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = lambda: {r.row.doc_id: r.res.n_removed for r in line_chunks.dedup_lines(docs).collect()}
    by, gone = removed(), brute_line_runs(spark, rows)
    assert by == {i: len(gone[(i, t)]) for i, t in rows}
    # shifted passages of 12 lines go as a whole, the lines around them stay, and so does what comes first
    assert all(by[i] == 0 and by[100 + i] == 13 for i in range(20)) and sum(by[200 + i] == 12 for i in range(20)) == 20
    monkeypatch.setattr(line_chunks, "_chunks", lambda text: line_chunks.F.expr("array_remove(array(named_struct('h', 0L, 'n', 2, 'at', 0, 'back', 0, 'ahead', 0)), named_struct('h', 0L, 'n', 2, 'at', 0, 'back', 0, 'ahead', 0))"))
    assert set(removed().values()) == {0}  # without chunks nothing goes


def test_line_dedup_edges(spark):
    block = "\n".join(f"line number {i}" for i in range(30))
    docs = edge_docs(spark, [(30, block), (31, f"first line\n{block}\nlast line"), (32, "\n".join(["many"] * 9))])
    rows = [(r.row.doc_id, r.row.text, r.res.n_lines, r.res.n_removed) for r in line_chunks.dedup_lines(docs).collect()]
    by = {r[0]: r for r in rows}
    assert len(rows) == 13 and by[1] == (1, None, 0, 0) and by[2] == (2, "", 1, 0) and by[30][3] == 0 and by[31][3] > 15
    assert by[31][1].startswith("first line") and [r for r in rows if r[0] == 7][0] == [r for r in rows if r[0] == 7][1]
    many = "\n".join(f"line {i}" for i in range(20_000))
    long_docs = spark.createDataFrame([(1, many), (2, many + "\nlast")], "doc_id long, text string")
    assert [(r.row.doc_id, r.res.n_lines, r.res.n_removed) for r in line_chunks.dedup_lines(long_docs).orderBy("row.doc_id").collect()] == [(1, 20_000, 0), (2, 20_001, 20_000)]
    out = line_chunks.dedup_lines(docs).select("row.*")
    assert out.columns == docs.columns and line_chunks.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_is_native(spark, docs):
    plan = line_chunks.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
