"""Ranked search, line deduplication and fill-in-middle: SQL, brute force and odd rows."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.llm import fill_middle, line_dedup, ranked_search

ODD = "doc_id long, text string, key string, hash string, n long, places string, fim string, _n long, _whole string, question long, slot long"
EXTRA = ("k", "h", 1, "p", "f", 2, "w", 3, 4)
LONG = "A line that many documents share and that is long enough to count"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], ODD)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("alpha beta Gamma délta ÉPSILON zeta <P> <x> eta".split()) for _ in range(rng.randint(3, 14)))
    shared = [line() + " shared by many documents, long enough" for _ in range(12)] + ["short"]
    out = [(i, "\n".join(rng.choice(shared) if rng.random() < 0.4 else line() for _ in range(rng.randint(1, 12)))) for i in range(90)]
    out += [(i, f" {LONG}\t\n{LONG.upper()} \nown {i}") for i in range(100, 340)]
    out += [(400, None), (401, ""), (402, " \t\n "), (None, f"{LONG}\nx"), (None, None), (403, LONG), (403, f"x\n{LONG}\n{LONG}"), (404, "one two"), (404, "one two")]
    return out + [(500, "\n".join([LONG, "word 𝒳 ß"] * 4000)), (501, "x" * 60000), (502, "\n\n" + LONG + "\r\n\n")]


def drop_lines(rows, often=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    last = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v) >= often}
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        left = [x for x in all_lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(all_lines), len(all_lines) - len(left), "\n".join(left)))
    return out


def test_line_dedup_equals_brute_force(spark, rows):
    order = lambda x: repr(x)
    got = [tuple(r) for r in line_dedup.dedup(docs_of(spark, rows).repartition(5)).collect()]
    assert sorted(got, key=order) == sorted(drop_lines(rows), key=order)
    assert any(r[2] for r in got) and {r[0]: r for r in got if r[0] == 400}[400][1] == 1


def test_line_dedup_hot_and_cold_lines_take_both_ways(spark, rows, monkeypatch):
    for bound in (1, 10**9):  # every key cold, every key hot
        monkeypatch.setattr(line_dedup, "HOT", bound)
        got = sorted(map(repr, (tuple(r) for r in line_dedup.dedup(docs_of(spark, rows)).collect())))
        assert got == sorted(map(repr, drop_lines(rows)))


def test_line_dedup_keeps_columns_and_empty_tables(spark, rows):
    docs = docs_of(spark, rows)
    left = line_dedup.cleaned(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    assert left.filter("doc_id = 400").first().text is None
    assert line_dedup.dedup(docs_of(spark, [])).count() == 0


def middle(i, text, seed="1"):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text or "", re.S)
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * j : 8 * j + 8], 16) for j in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text or ""
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_brute_force_and_restores(spark, rows):
    tricky = [(600 + i, x) for i, x in enumerate(["<", "<P", "P>", "<<P>", "a<S>b", "<M", ">", "a<P" * 7, "x<" * 9 + "S>", "\n", "𝒳𝒴 𝒵", "é", "\r\n", "<M>" * 3])] + [(700 + i, "<S a> b< M>" * 3) for i in range(40)]
    docs = docs_of(spark, rows + tricky)
    out = fill_middle.arranged(docs)
    fim = [c for c in out.columns if c not in docs.columns][0]
    assert out.columns[:-1] == docs.columns and fim == "_fim"
    got = out.select("doc_id", "text", f"{fim}.*", fill_middle.restored(F.col(f"{fim}.output"), F.col(f"{fim}.form")).alias("back")).collect()
    assert len(got) == len(rows) + len(tricky) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middle(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert fill_middle.arranged(docs_of(spark, [])).count() == 0


def test_fill_middle_runs_no_python(spark, rows):
    plan = fill_middle.arranged(docs_of(spark, rows).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and plan.count("regexp_extract_all") == 1


def rank(docs, items, k=10):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = [(i, collections.Counter(term(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in set(items):
        asked[i].update(term(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, own in found:
            n = sum(own.values())
            m = 25 + (75 * n * n_docs) // total if total else 0
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * own[t]) // (1000 * own[t] + 8 * m)) for t, r in terms.items() if own[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, place, None if none else doc, -s) for place, (s, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Zwölf", "ÉTÉ", "été", "𝒳𝒴", "9", "A-b"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(150)]
    docs += [(i, docs[7][1]) for i in range(200, 260)] + [(300, None), (301, ""), (302, "... --"), (None, docs[7][1]), (5, docs[5][1]), (5, text(9)), (303, text(20000)), (304, "z" * 50000)]
    items = [(i, text(rng.randint(0, 12))) for i in range(90)] + [(1000, None), (1001, "..."), (1002, text(3000)), (3, "w1 w2"), (4, "w4 w4"), (4, "w4 w4"), (None, "w3 w59"), (1003, "unheard of")]
    return docs, items


def test_ranked_search_equals_brute_force(spark, corpus, monkeypatch):
    docs, items = corpus
    order = lambda x: sorted(map(repr, x))
    item_frame = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in ranked_search.search(docs_of(spark, docs).repartition(3), item_frame).collect()]
    assert order(got) == order(rank(docs, items))
    monkeypatch.setattr(ranked_search, "ITEMS", 30)  # several question blocks, and none broadcast
    monkeypatch.setattr(ranked_search, "SENT", 0)
    again = [tuple(r) for r in ranked_search.search(docs_of(spark, docs).repartition(11), item_frame, k=3).collect()]
    assert order(again) == order(rank(docs, items, 3))


def test_ranked_search_of_nothing(spark, corpus):
    docs, items = corpus
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked_search.search(docs_of(spark, docs[:5]), none).count() == 0
    assert ranked_search.search(docs_of(spark, []), some).count() == 0
    assert ranked_search.search(docs_of(spark, [(1, None), (2, " ")]), some).count() == 0


def test_row_groups_hold_few_blocks_however_many_a_task_makes(spark):
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(11 * ranked_search.BLOCK_DOCS).selectExpr("id AS doc_id", "concat('w', id % 7, ' w', id % 50) AS text").coalesce(1)
    blocks = ranked_search.index(docs)
    files = [pq.ParquetFile(p).metadata for p in glob.glob(blocks._scratch.removeprefix("file:") + "/*.parquet")]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == blocks.count() == 11 and max(groups) <= ranked_search.GROUP


def test_sums_are_radix_sorted_by_packed_key():
    import numpy as np

    rng = np.random.default_rng(1)
    keys, impacts = rng.integers(0, 65536, 5000).astype(np.uint16), rng.integers(0, 10**12, 5000)
    found, sums = ranked_search._sums(keys, impacts)
    want = collections.Counter()
    for k, x in zip(keys.tolist(), impacts.tolist(), strict=True):
        want[k] += x
    assert dict(zip(found.tolist(), sums.tolist(), strict=True)) == want


def test_several_sorts_give_the_sums_of_one(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    matched, docs, base = rng.integers(0, 40, 900), rng.integers(0, 1024, 900), rng.integers(1, 10**6, 900)
    starts = np.concatenate(([0], np.cumsum(rng.integers(0, 9, 40))))
    asked_by, factor = rng.integers(0, 64, starts[-1]), rng.integers(1, 10**5, starts[-1])
    want = np.zeros((64, 1024), dtype=np.int64)
    for t, d, x in zip(matched, docs, base, strict=True):
        for e in range(starts[t], starts[t + 1]):
            want[asked_by[e], d] += factor[e] * x
    for chunk in (1 << 21, 50, 1):
        monkeypatch.setattr(ranked_search, "CHUNK", chunk)
        assert (ranked_search._accumulate(matched, docs, base, starts, asked_by, factor, 0) == want).all()


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_line_dedup", "op13_fill_middle"])
def test_queries_equal_their_sql_over_all_their_tables(spark, name):
    import duckdb

    from evidentia.llm import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
