"""Each training-data operator on small cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from evidentia.llm import chat_format, exact_dedup, language, mixing, partenum, pieces, ppm, quality_model, quality_rules, warc

DOCS = "doc_id long, text string, lang string, source string, key string, size long, n long, rep long, label long"
GOOD = "the of and to in a is that for it as was with be by on not he from are this his at an or"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(GOOD.split()) + rng.choice("abcde") for _ in range(n))
    rows = [(1, None, "en", "s1"), (2, "", "en", None), (3, " \t\n ", None, "s1"), (4, "one two", "en", "s2"), (5, "one  two", "en", "s2"), (5, "one  two", "en", "s2"), (None, "no id here", "fr", "s3"), (7, text(20000), "en", "s1"), (8, "x" * 30000, "de", "s2"), (9, text(80), "en", "s1"), (10, text(80), "en", "s1")]
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    again = mixing.mix(odd.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_rows(odd).columns == odd.columns


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 40), f"s{min(rng.randint(0, 9), 4)}") for i in range(600)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        by[r.source_size][0] += r.taken
        by[r.source_size][2] = r.target
    assert all(abs(taken - target) <= 1 for taken, _, target in by.values())
    total = sum(r.size for r in rows)
    assert abs(sum(t for _, _, t in by.values()) - 1.5 * total) < 1


def test_exact_dedup(spark, odd, none):
    rows = exact_dedup.dedup(odd).collect()
    by = {(r.doc_id, r.at): r for r in rows}
    assert len(by) == odd.count()
    kept = collections.Counter(r.doc_id for r in rows if r.kept)
    assert kept[1] == 0 or kept[2] == 0  # null and empty are equal; white space is not empty
    assert kept[4] == 1 and kept[5] == 0
    assert exact_dedup.dedup(none).count() == 0
    left = exact_dedup.keep_first(odd)
    assert left.columns == odd.columns and left.filter("doc_id = 5").count() == 0
    twice = odd.filter("doc_id = 9").unionByName(odd.filter("doc_id = 9"))
    assert exact_dedup.keep_first(twice).count() == 1


def test_exact_dedup_tells_colliding_digests_apart(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string")
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 0)  # noqa: E731  every digest is equal
    rows = exact_dedup.dedup(docs, digest=weak).collect()
    assert len(rows) == 40 and sum(r.kept for r in rows) == 7
    assert {r.doc_id: r.keep_id for r in rows} == {i: i % 7 for i in range(40)}


def test_exact_dedup_in_several_batches(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string").repartition(4)
    rows = exact_dedup.dedup(docs, maxFilesPerTrigger="1").collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == {i: (i % 7, 6 if i % 7 < 5 else 5) for i in range(40)}


def test_exact_dedup_goes_on_from_intake_to_intake(spark, tmp_path):
    from pyspark.sql import functions as F

    store = "file://" + str(tmp_path / "store")
    rows = lambda found: {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found.collect()}
    take = lambda pairs, **more: rows(exact_dedup.dedup(spark.createDataFrame(pairs, "doc_id long, text string"), store=store, intake=str(pairs[0]), **more))
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)  # noqa: E731  16 digests
    one = [(i, f"text {i % 30}") for i in range(10, 50)]
    two = [(i, f"text  {i % 40}") for i in [*range(4), *range(50, 80)]]
    seen: dict = {}
    for part in (one, two, [(100, "text 1"), (101, "new")]):
        got = take(part, digest=weak)
        for i, text in part:
            seen.setdefault(" ".join(text.split()), []).append(i)
        want = {i: (min(ids), len(ids), i == min(ids)) for ids in seen.values() for i in ids}
        assert got == {i: want[i] for i, _ in part}


def test_exact_dedup_loses_nothing_when_an_intake_dies(spark, tmp_path, monkeypatch):
    frame = lambda pairs: spark.createDataFrame(pairs, "doc_id long, text string")
    one, two, three = [(1, "a"), (2, "b"), (3, "b")], [(4, "a"), (5, "c")], [(0, "a"), (6, "d")]
    found = lambda frame: sorted(tuple(r) for r in frame.select("doc_id", "keep_id", "group_size", "kept").collect())

    def run(store, die):
        out = []
        for name, rows in (("one", one), ("two", two), ("three", three)):
            if die:
                with monkeypatch.context() as m, pytest.raises(RuntimeError):
                    m.setattr(exact_dedup.Store, die, lambda *_, **__: (_ for _ in ()).throw(RuntimeError("lost")))
                    exact_dedup.dedup(frame(rows), store=store, intake=name)
            out.append(found(exact_dedup.dedup(frame(rows), store=store, intake=name)))
        return out

    want = run("file://" + str(tmp_path / "calm"), None)
    assert want[0] == [(1, 1, 1, True), (2, 2, 2, True), (3, 2, 2, False)]
    assert want[1] == [(4, 1, 2, False), (5, 5, 1, True)] and want[2] == [(0, 0, 3, True), (6, 6, 1, True)]
    for die in ("advance", "groups", "clashes"):
        store = "file://" + str(tmp_path / die)
        assert run(store, die) == want
        assert exact_dedup.Store(spark, store).intakes() == ["one", "two", "three"]
    # staged rows that never appeared count for nothing
    store = "file://" + str(tmp_path / "staged")
    frame(one).write.parquet(store + "/staged/dead")
    assert run(store, None) == want
    with pytest.raises(ValueError, match="name"):
        exact_dedup.dedup(frame(one), store=store)


def test_stages_keep_columns_of_any_name(spark):
    names = ["_digest", "_copy", "_id", "_times", "__copy", "row", "label", "sig"]
    rows = [(i, "same text here" if i < 3 else f"word{i} " * (i + 1), "s", *[f"{n}{i}" for n in names]) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for got in (exact_dedup.keep_first(docs), mixing.mixed_rows(docs), partenum.keep_one(docs)):
        assert got.columns == docs.columns
        found = got.collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)


def test_quality_model(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(9, None)], "doc_id long, quality int")
    rows = quality_model.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.classify(none, labels).count() == 0
    assert [r.score for r in quality_model.classify(odd, labels.filter("quality = 5")).collect()] == [0.5] * odd.count()
    assert quality_model.accepted(odd, labels).columns == odd.columns


def test_isotonic():
    x, y = quality_model.isotonic(np.arange(5.0), np.array([0.0, 2, 1, 3, 2]), np.full(5, 3.0))
    assert np.allclose(x, [0, 1.5, 3.5]) and np.allclose(y, [0, 0.5, 5 / 6])


def test_language(spark, odd, none):
    words = {"aa": "kabu zumi tolo", "bb": "strn grpf wklm"}
    rows = [(i, " ".join(random.Random(i).choices(words[lang].split(), k=30)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.95
    und = {r.doc_id: r.lang_pred for r in language.identify(odd).collect()}
    assert und[1] == und[2] == und[3] == "und"
    assert language.identify(none).count() == 0


def _brute(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = set(zip(*[w[j:] for j in range(width)])) if len(w) >= width else ({tuple(w)} if w else set())
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent", "block", "gather", "pairs"), [(4, 85, 2048, 100_000, 1_000_000), (5, 80, 2, 3, 4)])
def test_partenum_against_brute_force(spark, monkeypatch, width, percent, block, gather, pairs):
    for name, value in {"BLOCK": block, "GATHER": gather, "PAIRS": pairs}.items():
        monkeypatch.setattr(partenum, name, value)
    rng = random.Random(width)
    base = [[f"w{rng.randint(0, 300)}" for _ in range(rng.choice([3, 8, 14, 40, 90]))] for _ in range(14)]
    rows = []
    for k in range(180):
        words = list(rng.choice(base[: 14 if k % 2 else 2]))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [f"x{rng.randint(0, 5)}"]
        rows.append((k, " ".join(words)))
    got, _ = partenum.join(spark.createDataFrame(rows, "doc_id long, text string"), width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == _brute(rows, width, percent)


def _similar(rng, size, percent):
    """Two sets on either side of the limit, near it."""
    pool = rng.choice(2**60, size=3 * size + 4, replace=False).astype(np.uint64)
    x = pool[:size]
    gone = int(rng.integers(0, size * (100 - percent) // 100 + 2))
    new = int(rng.integers(0, size * (100 - percent) // 100 + 2))
    return np.sort(x), np.sort(np.concatenate([x[gone:], pool[size : size + new]]))


@pytest.mark.parametrize("percent", [80, 85])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    met = 0
    for size in [*range(1, 40), 60, 100, 150, 151, 300, 700, 2000] * 12:
        x, y = _similar(rng, size, percent)
        common = len(np.intersect1d(x, y))
        if len(y) and 100 * common >= percent * (len(x) + len(y) - common) and (len(x) != common or len(y) != common):
            row, sig = partenum.signatures([x, y], percent)
            assert set(sig[row == 0]) & set(sig[row == 1]), (size, len(y), common)
            met += 1
    assert met > 100


def test_sketches_never_exceed_the_distance():
    rng = np.random.default_rng(3)
    for size in [1, 5, 40, 130, 900, 5000]:
        x, y = _similar(rng, size, 70)
        least = partenum.least_distance(partenum.parity_sketch(x), partenum.parity_sketch(y))
        folded = partenum.least_distance(partenum._folded(partenum.parity_sketch(x)), partenum._folded(partenum.parity_sketch(y)))
        assert folded <= least <= len(np.setxor1d(x, y))


def test_signatures_of_several_components():
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted((rng.randrange(40), rng.randrange(4)) for _ in range(90))
    want = {(s, x) for s, x in rows if len({b for a, b in rows if a == s}) > 1}
    for size in (1, 2, 7, 90):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], ["sig", "label"]) for i in range(0, 90, size)]
        got = [r for b in partenum._several(iter(batches)) for r in zip(b["sig"].to_pylist(), b["label"].to_pylist())]
        assert sorted(got) == sorted(want)


def test_partenum_hot_group(spark):
    """A family whose members differ from the text they were made from by more or less than the limit, and a passage that many share."""
    rng = random.Random(6)
    base, passage = [f"b{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    rows = []
    for k in range(260):
        words = list(base) if k % 4 else passage + [f"o{rng.randint(0, 10**6)}" for _ in range(rng.randint(10, 60))]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(words)))
    got, _ = partenum.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == _brute(rows, 4, 85)


def test_keep_one_judges_rows_of_one_id_by_their_text(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text), (5, text + " end"), (5, " ".join(f"v{i}" for i in range(80))), (6, text)]
    left = partenum.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text[:2]) for r in left.collect()) == [(3, "w0"), (5, "v0")]


def test_partenum_odd_rows(spark, odd, none):
    rows = partenum.join(odd)[0].collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[4][1] == got[5][1] == 4 and got[None][1] is None
    assert partenum.join(none)[0].count() == 0
    assert partenum.keep_one(odd).columns == odd.columns


def test_quality_rules(spark, odd, none):
    rows = {r.doc_id: r for r in quality_rules.judge(odd).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[7].n_words == 20000 and rows[8].word_chars == 30000
    assert quality_rules.judge(none).count() == 0
    repeated = spark.createDataFrame([(1, "en", "a b c d a b c"), (2, "en", "x\n x\nx\n\n"), (3, "en", "a a a a")], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in quality_rules.judge(repeated).collect()}
    assert got[1].n_repeat_words == 6 and got[3].n_repeat_words == 4 and got[2].n_dup_lines == 1


def test_chat_format(spark):
    rows = [(1, 0, "user", "[INST] a </s>"), (1, 1, "user", "b [\\INST] <\\\\s>"), (1, 2, "assistant", None), (1, 3, "assistant", "c[TURN]"), (1, 4, "to[/ANY]ol", "d"), (2, None, None, "e"), (2, 0, "system", "s"), (2, 0, "system", "s"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    out = chat_format.format_conversations(df).select("conv_id", chat_format.parse(F.col("formatted")).alias("back"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {r.conv_id: ([(x.role, x.text) for x in r.back], r.loss) for r in out}
    assert got[1] == ([("user", "[INST] a </s>"), ("user", "b [\\INST] <\\\\s>"), ("assistant", ""), ("assistant", "c[TURN]"), ("to[/ANY]ol", "d")], "c[TURN]")
    assert got[2][0] == [("", "e"), ("system", "s"), ("system", "s")]
    assert got[None][0] == [("user", "n")]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_ppm_is_a_distribution(spark, odd, none):
    rows = ppm.score(odd).collect()
    assert len(rows) == odd.count() and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert ppm.score(none).count() == 0
    keys = np.array([(97 << 32) | (98 << 24) | (99 << 16) | (100 << 8) | s for s in range(256)], dtype=np.int64)
    counts = np.zeros(256)
    counts[[101, 102]] = 3, 1
    low = np.zeros((256, 256))
    low[100, 101], low[100, 102], low[7, 9] = 3, 1, 5
    assert abs((10 ** ppm.context_probabilities(keys, counts, low)).sum() - 1) < 1e-9


def test_pieces(spark, odd, none):
    vocab = pieces.read_model()
    texts = ["", None, " ", "  a\nb  c\t d ", "▁x ퟿", "日本語 🎉", "\x00\x01", "a" * 500, "\n\n", "plain words here"]
    rows = list(pieces.sample(texts, list(range(len(texts))), vocab, 3))
    assert all(vocab.decode(ids.tolist()) == (texts[d] or "") for d, _, ids, *_ in rows)
    assert all(vocab.decode(ids.tolist()) == (text or "") for ids, text in zip(pieces.encode_best(texts, vocab), texts))
    for d in range(len(texts)):
        own = [(ids.tobytes(), g) for row, _, ids, _, g, _ in rows if row == d]
        assert len({i for i, _ in own}) == len(own) and [g for _, g in own] == sorted((g for _, g in own), reverse=True)
    counts = collections.Counter(r.doc_id for r in pieces.digests(odd).collect())
    assert counts[1] == counts[2] == 1 and counts[7] == 2
    assert all(r.decoded_sha256 == hashlib.sha256(b"one  two").hexdigest() for r in pieces.digests(odd.filter("doc_id = 5")).collect())
    assert pieces.encode(none).count() == 0


def test_pieces_units_that_end_alike_share_nodes(monkeypatch):
    vocab = pieces.read_model()
    texts = ["one tone stone\nbone", None, "", "alone  done ▁", "stone bone été 🎉"]
    units = {" one", " tone", " stone", "\n", "bone", " alone", "  done", " ▁", " bone", " été", " 🎉"}
    suffixes = {u[i:] for u in units for i in range(len(u))}
    found = pieces.Units(texts, vocab)
    assert len(found.sizes) == len(units) and found.n_units.tolist() == [5, 0, 0, 3, 4]
    assert len(found.lattice.degree) == len(suffixes) < sum(map(len, units))
    plain = lambda: [(row, number, ids.tolist(), *rest) for row, number, ids, *rest in pieces.sample(texts, list(range(5)), vocab, 4)]
    want = plain()
    monkeypatch.setattr(pieces, "_suffix_hashes", lambda points, remaining: np.zeros(len(points), np.uint64))
    assert len(pieces.Units(texts, vocab).lattice.degree) == sum(map(len, units))  # one hash for all: nothing is shared
    assert plain() == want


def test_pieces_digests_and_ids_are_those_sampled(spark):
    vocab = pieces.read_model()
    texts = [None, "", " ", "\n", "one tone\n stone", "▁ 🎉\x00", "été  ", "日本語 " * 40] * 90
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    want = {(row, number): (ids, *rest) for row, number, ids, *rest in pieces.sample(texts, list(range(len(texts))), vocab, 3)}
    encoded = {(r.doc_id, r["sample"]): (r.ids, r.log_prob, r.perturbed, r.inclusion) for r in pieces.encode(docs, count=3).collect()}
    assert encoded == {k: (v[0].tolist(), *v[1:]) for k, v in want.items()}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    digests = {(r.doc_id, r["sample"]): (r.n_pieces, r.ids_sha256, r.decoded_sha256, r.log_prob) for r in pieces.digests(docs, count=3).collect()}
    assert digests == {(d, n): (len(v[0]), sha(v[0].tobytes()), sha((texts[d] or "").encode()), v[1]) for (d, n), v in want.items()}


def test_pieces_first_samples_and_inclusion_scores():
    vocab = pieces.read_model()
    n, first, total, share = 4000, collections.Counter(), collections.Counter(), {}
    for _, number, ids, logp, _, score in pieces.sample(["then"] * n, list(range(n)), vocab, 2):
        first[ids.tobytes()] += number == 1
        total[ids.tobytes()] += 1 / score
        share[ids.tobytes()] = np.exp(logp)
    for ids, p in share.items():
        if p > 0.02:
            assert abs(first[ids] / n - p) < 4 * np.sqrt(p * (1 - p) / n)
            assert abs(total[ids] / n - 1) < 0.1  # weighted by the inverse of its score, a segmentation counts once a draw


def test_warc(spark, none):
    page = "p" * 1200
    rows = [(1, "http://a.com/x", page), (2, "http://b.com/", page), (3, "not a url", None), (4, None, "short"), (5, "http://c.com/\r\nX: y", "short"), (2, "http://b.com/", page), (None, "http://d.com", page), (7, "http://a.com/x", "é" * 30000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.scratch(spark, "warc")
    warc.write_archives(df, path)
    got = warc.merge_runs(warc.capture_runs(spark, path)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].record_type == "revisit" and by[1].refers_to == 2 and by[2].record_type == "response" and by[None].refers_to == 2
    assert by[7].payload_bytes == 60000 and by[7].payload_digest == hashlib.sha1(("é" * 30000).encode()).hexdigest()
    assert by[3].payload_bytes == 0 and by[3].record_type == "response"
    ordered = sorted(got, key=lambda r: (r["range"], r["place"]))
    assert [r.url_key for r in ordered] == sorted(r.url_key for r in got)
    path = warc.scratch(spark, "warc")
    warc.write_archives(df.limit(0), path)
    assert warc.merge_runs(warc.capture_runs(spark, path)).count() == 0


def test_warc_takes_urls_that_cannot_be_parsed(spark):
    urls = ["http://[abc/", "http://[abc]/x", "http://a\u2100.com/", "http://]/", "//[", "http://[::1]/ok", "HTTP://WWW.Ok.org/P?Q", "http://b.org:99999/", "[", None]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")
    path = warc.scratch(spark, "warc")
    warc.write_archives(df, path)
    got = sorted(warc.histories(warc.merge_runs(warc.capture_runs(spark, path))).collect(), key=lambda r: r.position)
    assert {r.page_id: r.url_key for r in got} == {i: warc.url_key(u or "") for i, u in enumerate(urls)}
    assert warc.url_key("http://[Abc/") == ")http://[abc/" and warc.url_key(urls[6]) == "org,ok)/p?q"
    assert [r.position for r in got] == list(range(len(urls))) and [r.url_key for r in got] == sorted(r.url_key for r in got)


def test_warc_ranges_cut_one_url(spark, monkeypatch):
    # one URL holds most records, ids past 2^53 beside a null one, columns with names the code uses
    ids = [2**60 + i for i in range(60)] + [None]
    rows = [(i, "http://one.org/" if k % 4 else f"http://site{k}.org/", "body" * 400 if k % 3 else f"own {k}", 0) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, salt int").repartition(5)
    path = warc.scratch(spark, "warc")
    warc.write_archives(df, path, file_bytes=8000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 6)
    monkeypatch.setattr(warc, "BATCH_ROWS", 2)
    runs = warc.capture_runs(spark, path)
    assert runs.select("run").distinct().count() > 5
    got = warc.merge_runs(runs).collect()
    assert len({r["range"] for r in got if r.url_key == "org,one)/"}) > 1  # a hot URL is split
    ordered = sorted(got, key=lambda r: (r["range"], r["place"]))
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in ordered]
    assert keys == sorted(keys) and {r.page_id for r in got} == set(ids)
    copies = [r for r in got if r.payload_bytes == 1600]
    assert {r.refers_to for r in copies if r.record_type == "revisit"} == {max(i for i in (r.page_id for r in copies) if i)}


def test_loser_tree():
    rng = random.Random(5)
    for _ in range(200):
        runs = [sorted(rng.choices(range(40), k=rng.randint(0, 6))) for _ in range(rng.randint(0, 8))]
        assert list(warc.loser_tree_merge(runs, lambda x: x)) == sorted(sum(runs, []))


def test_folds(spark):
    from evidentia.llm.common import fold

    ids = spark.range(50)
    got = {r.id: r.f for r in ids.select("id", fold(ids["id"], 4).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}


def _segmentations(text, vocab):
    """All segmentations of a short text with their weights, by plain recursion."""
    pieces_of = {vocab.strings[i].decode(): i for i in range(len(vocab.strings)) if vocab.logp[i] < 0}
    text = " " + text

    def rest(at):
        if at == len(text):
            yield (), 0.0
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in pieces_of:
                own = pieces_of[text[at:end]]
                for ids, logp in rest(end):
                    yield (own, *ids), vocab.logp[own] + logp

    return dict(rest(0))


@pytest.mark.parametrize("text", ["a", "then", "on it", "in an"])
def test_pieces_against_all_segmentations(text):
    vocab = pieces.read_model()
    every = _segmentations(text, vocab)
    whole = np.logaddexp.reduce(list(every.values()))
    count = len(every) + 3
    rows = list(pieces.sample([text, "other words", text], [5, 6, 7], vocab, count))
    for d in (0, 2):
        own = [(tuple(ids.tolist()), logp, bound, score) for row, _, ids, logp, bound, score in rows if row == d]
        assert {ids for ids, *_ in own} == set(every)  # all of them, each once
        assert all(abs(logp - (every[ids] - whole)) < 1e-5 and score == 1.0 for ids, logp, _, score in own)
        assert [b for *_, b, _ in own] == sorted((b for *_, b, _ in own), reverse=True)
    best = tuple(pieces.encode_best([text], vocab)[0].tolist())
    assert every[best] == max(every.values())
    alone = [(ids.tobytes(), b) for row, _, ids, _, b, _ in pieces.sample([text], [5], vocab, count)]
    assert alone == [(ids.tobytes(), b) for row, _, ids, _, b, _ in rows if row == 0]  # whatever else is in a batch


def _rules(rows, word_limit, noise, char_limit):
    """Base counts, distances and verdicts of rows(doc_id, lang, text), plainly."""
    import math
    import re

    out, hists = {}, {}
    for i, lang, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {j + k for j, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        chars = collections.Counter()
        for c in text:
            chars[next((k for k, p in quality_rules.CHAR_CLASSES.items() if re.fullmatch(p, c)), " ")] += 1
        common = collections.Counter(w.lower() if w.lower() in quality_rules.BINS else " " for w in words)
        hists[i] = chars, common
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out[i] = [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed]
    refs = {}
    for i, lang, _ in rows:
        if lang is not None and not out[i][5]:
            for ref, own in zip(refs.setdefault(lang, (collections.Counter(), collections.Counter())), hists[i]):
                ref.update(own)

    def distance(p, q):
        n, m, total = sum(p.values()), sum(q.values()), 0.0
        for k in set(p) | set(q):
            a, b = p[k] / n, q[k] / m
            total += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x > 0) / 2
        return math.sqrt(max(total, 0.0))

    for i, lang, _ in rows:
        ref = refs.get(lang)
        if out[i][5] or ref is None or sum(ref[1].values()) < quality_rules.MIN_REFERENCE_WORDS:
            out[i] += [not out[i][5], None, None]
        else:
            c, w = distance(hists[i][0], ref[0]), distance(hists[i][1], ref[1])
            out[i] += [c <= char_limit and w <= word_limit + noise / math.sqrt(out[i][0]), c, w]
    return out


def test_quality_rules_against_brute_force(spark):
    rng = random.Random(12)
    lists = {k: v.split() for k, v in quality_rules.COMMON_WORDS.items()}
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de", "xx", None])
        words = rng.choices(lists.get(lang, ["qua", "bo"]), k=rng.randint(20, 140)) + [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 200))]
        rng.shuffle(words)
        if i % 9 == 0:
            words = [w + "$$#" for w in words]
        if i % 11 == 0:
            lang = "de" if lang == "en" else "en"
        if i % 13 == 0:
            words = words[:30] * 4
        rows.append((i, lang, "".join(w + rng.choice([" ", "\n", "  ", " \t"]) for w in words)))
    rows += [(900, "en", None), (901, "en", "É" * 40), (902, "zz", "one\n\none\n")]
    want = _rules(rows, quality_rules.WORD_LIMIT, quality_rules.WORD_NOISE, quality_rules.CHAR_LIMIT)
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    verdicts = collections.Counter()
    for i, (*base, failed, kept, c, w) in want.items():
        r = got[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept] == [*base, failed, kept], i
        assert (r.char_distance is None) == (c is None) and (c is None or abs(r.char_distance - c) < 1e-9 and abs(r.word_distance - w) < 1e-9)
        verdicts[failed, kept] += 1
    assert len(verdicts) == 3


def _ppm(train, texts, order=4):
    """log10 probability of each text by escape C with exclusion, from plain dictionaries of the training texts."""
    import math

    body = lambda t: b"\n" * order + b" ".join((t or "").encode().lower().split()) + b"\n"
    seen = collections.defaultdict(collections.Counter)
    for t in train:
        data = body(t)
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen[data[i - k : i]][data[i]] += 1
    out = []
    for t in texts:
        data, total = body(t), 0.0
        for i in range(order, len(data)):
            excluded: set = set()
            for k in range(order, -1, -1):
                left = {s: n for s, n in seen[data[i - k : i]].items() if s not in excluded}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if data[i] in left:
                    total += math.log10(left[data[i]] / whole)
                    break
                total += math.log10(len(left) / whole)
                excluded |= set(left)
            else:
                total -= math.log10(max(1, 256 - len(excluded)))
        out.append(total)
    return out


def test_ppm_against_brute_force(spark):
    import math

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["ab", "abc", "Bc", "cab", "z" * rng.randint(1, 3), "é"], k=rng.randint(0, 12)))) for i in range(60)] + [(60, None), (61, "new§ words"), (7, "ab abc")]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    train = [t for i, t in rows if not held(i)]
    counts = collections.Counter(w for t in train for w in [*(t or "").lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, held(i), round(s, 6), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*(t or "").lower().split(), None]), 6)) for (i, t), s in zip(rows, _ppm(train, [t for _, t in rows])))
    got = ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.held_out, round(r.score, 6), round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}


def test_language_tables_are_the_convolution():
    net = language.Network(["a", "b", "c"])
    rng = np.random.default_rng(1)
    net.p = {k: (v + rng.standard_normal(v.shape) * 0.1).astype(np.float32) for k, v in net.p.items()}
    net._fold()
    data = rng.integers(0, 256, (9, language.WINDOW)).astype(np.uint8)
    assert np.allclose(net.log_probabilities(data), net._forward(data)[0], atol=1e-3)


def test_quality_model_learns_and_sums_are_whole(spark):
    rng = random.Random(3)
    text = lambda good: " ".join(rng.choice(GOOD.split()) + ("" if good else rng.choice("#$%") * 3) for _ in range(rng.randint(20, 60)))
    truth = {i: rng.random() < 0.6 for i in range(400)}
    docs = spark.createDataFrame([(i, text(g)) for i, g in truth.items()], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(g)) for i, g in truth.items()], "doc_id long, quality int")
    got = quality_model.classify(docs, labels).collect()
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out]) > 0.97
    described = quality_model.describe(docs).toPandas().merge(labels.toPandas(), on="doc_id")
    described = described[described["fold"] != quality_model.HELD_OUT]
    x = np.array(described["stats"].tolist())
    kernel = quality_model.Kernel(x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6)))
    f = kernel(x)
    weights = quality_model.solve(f.T @ f, f.T @ described["quality"].to_numpy(float), len(x))
    model = quality_model.fit(quality_model.describe(docs), labels)
    assert np.allclose(kernel(x) @ weights, model.kernel(x) @ model.weights, atol=1e-5)


def test_queries_equal_their_sql(spark):
    import duckdb
    import pandas as pd

    from evidentia.llm import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in queries.SQL.items():
        want = con.sql(sql).df()
        got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
        plain = lambda df: sorted(repr([None if x is None or x is pd.NA or x != x else round(float(x), 4) if isinstance(x, (int, float, np.number)) else str(x) for x in row]) for row in df.itertuples(index=False, name=None))
        assert plain(got) == plain(want), name


def test_language_training_is_bounded_in_windows(spark, monkeypatch):
    long = " ".join(GOOD.split() * 400)
    rows = [(i, long if i % 2 else "el la de que y en un ser se no haber por con su para como estar " * 60, "en" if i % 2 else "es") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language.Network, "train", lambda self, data, y, seed=13: (seen.append(collections.Counter(y.tolist())), self._fold()))
    language.fit(docs)
    monkeypatch.setattr(language, "WINDOWS_PER_LANGUAGE", 150)
    language.fit(docs)
    assert min(seen[0].values()) > 400 and max(seen[1].values()) < 230 and min(seen[1].values()) > 90
