"""Op 13 against plain Python over all pairs of words and against SQL; numbered tries over many ranges."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm import spelling_variants as spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near(a, b):
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, count = {}, {}
    for w, k in n.items():
        others = [v for v in n if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * k else None
    out = set()
    for w, k in n.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, k, count[w], n.get(form[w])))
    return out


def random_docs(seed):
    """Words of few letters, so that many are near, with runs of equal letters, capitals of both kinds and long chains of forms."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("aabÉé") for _ in range(rng.choice([7, 7, 8, 9]))) for _ in range(150)}
    texts = [" ".join(rng.choice([w, w.upper(), w.capitalize()]) for _ in range(rng.choice([1, 2, 3, 30]))) for w in sorted(words)]
    chain = ["abcdefgh", "abcdefgx", "abcdefxx", "abcdexxx"]
    texts += [" ".join([w] * (2 * 10**k)) for k, w in enumerate(chain)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture
def many_ranges(spark):
    names = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_nodes_are_those_of_one_trie(spark, many_ranges):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(3, 12))) for _ in range(400)} | {"a" * 40, "a" * 40 + "b", "b" * 3000})
    numbered, replaced = spelling.number_nodes(spark.createDataFrame([(w,) for w in words], "word string"), "word")
    rows = numbered.collect()
    assert len({r.place >> 40 for r in rows}) > 10 and replaced
    node = defaultdict(set)
    for r in rows:
        assert len(r.nodes) == len(r.word) + 1
        for d, x in enumerate(r.nodes):
            node[r.word[:d]].add(replaced.get(x, x))
    assert all(len(x) == 1 for x in node.values())
    assert len({x for s in node.values() for x in s}) == len(node)
    assert [r.word for r in sorted(rows, key=lambda r: r.place)] == words


def test_groups_equal_all_pairs(spark, many_ranges):
    docs = random_docs(9)
    got = spelling.group_spellings(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)).collect()
    want = plain(docs)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    chain = {w: (form, root) for w, form, root, *_ in want if w.startswith("abcde")}
    assert chain["abcdefgh"] == ("abcdefgx", "abcdexxx")


def test_op13_equals_plain_python_and_sql(spark, sf, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op13_spelling_variants(spark, sf).collect()]
    assert set(got) == plain(docs) and len(got) == len(set(got))
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in random_docs(10)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_spelling_variants(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.OP13_SQL).fetchall())


def test_op13_edges(spark):
    assert spelling.group_spellings(spark.createDataFrame([], DOCS)).collect() == []
    long = "e" * 30_000
    docs = [(1, None), (2, ""), (3, " \n"), (None, "Strasse Strasse straße straßeN"), (5, "größere größere Größere GRÖßERE grössere"), (5, "größere größere Größere GRÖßERE grössere"),
            (6, f"{long} {long} {long}f {long}f"), (7, "short words only"), (8, "×÷×÷×÷× ×÷×÷×÷×")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    df = df.select("*", *[F.lit(1).alias(c) for c in ("word", "n", "place", "nodes", "form", "a.b")])
    got = {tuple(r) for r in spelling.group_spellings(df).collect()}
    assert got == plain(docs)
    assert {r[0][-2:] for r in got if len(r[0]) > 1000} == {"ee", "ef"}
