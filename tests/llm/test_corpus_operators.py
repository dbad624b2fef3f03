"""Each operator against a brute-force version on small fixtures, and against nulls, empties, ties, repeated rows, empty tables and clashing columns."""

import base64
import json
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from leadlake.llm import _text, chat, decontaminate, exactdedup, langid, linededup, mixing, neardup, quality, queries, tokens, urlfilter
from leadlake.llm._text import buffers, lower, span_hashes, word_bounds

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne") for b in ("ra", "su", "ti", "vo") for c in ("b", "d", "k", "n", "s")]


def words(seed, n):
    return random.Random(seed).choices(WORDS, k=n)


@pytest.fixture(scope="module")
def corpus(spark):
    """Originals, near and exact copies, shared lines, and odd rows."""
    rows = []
    for k in range(40):
        own = words(k, 80)
        rows.append((k, " ".join(own[:40]) + "\n" + " ".join(own[40:]), "en" if k % 2 else "de", f"src{k % 3}"))
    for k in range(5):
        near = rows[k][1].split(" ")
        near[7] = near[30] = "changed"
        rows.append((100 + k, " ".join(near), "en", "src0"))
        rows.append((200 + k, rows[k][1], "en", "src0"))
    rows.append((300, "shared line here\n" + " ".join(words(900, 30)), "en", "src1"))
    rows.append((301, " ".join(words(901, 30)) + "\n shared line here ", "en", "src1"))
    rows += [(400, None, None, None), (401, "", "en", ""), (402, "", "en", None), (403, "!!! ???", "en", "src2"), (None, "text without id", "en", "src2"), (404, "one", "en", "src2"), (404, "one", "en", "src2")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame(corpus, DOCS).withColumns({"sig": F.lit(1), "key": F.lit("k"), "rep": F.lit(2), "n": F.lit(3), "h1": F.lit(4), "shard": F.lit(5), "print": F.lit(6)})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def groups_of(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(up)}


def test_case_is_folded_character_by_character():
    texts = ["ÄÖ İ ÉX", "ΚΆΤΙ Ⱥ K ẞ Б", "Ș İȺ Ü", None, "", "plain", "İ"]
    folded = lower(pa.array(texts)).to_pylist()
    small = lambda c: c.lower() if len(c.lower().encode()) == len(c.encode()) else c
    assert folded == [None if t is None else "".join(map(small, t)) for t in texts]
    item, text = "ПРИВЕТ МИР ЭТО ДОЛГАЯ ФРАЗА ИЗ ВОСЬМИ СЛОВ", "x {} привет мир это ДОЛГАЯ фраза из восьми слов y"
    for odd in ("İ", "K", "z"):
        table = decontaminate.phrase_table([item.lower()])
        data, offsets = buffers(lower(pa.array([text.format(odd)])))
        assert [x.tolist() for x in decontaminate.spans_in(data, offsets, *table)[:3]] == [[0], [2], [10]]


def test_words():
    data, offsets = buffers(lower(pa.array(["Ünï x—y Z9", None, "", "a、b«c»"])))
    starts, ends, row = word_bounds(data, offsets)
    assert [(int(r), bytes(data[a:b]).decode()) for a, b, r in zip(starts, ends, row)] == [(0, "ünï"), (0, "x"), (0, "y"), (0, "z9"), (3, "a"), (3, "b"), (3, "c")]
    d, o = buffers(pa.array(["abc", "xabc"]))
    assert span_hashes(d, np.array([0]), np.array([3])) == span_hashes(d, np.array([4]), np.array([7]))


# 1


def signatures(corpus):
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in corpus]), pa.array([r[1] for r in corpus], pa.string())], ["doc_id", "text"])
    out = {}
    for part in neardup._sign([batch]):
        for i, m in zip(part.column(0).to_pylist(), neardup._matrix(part.column(1))):
            out[i] = m.copy()
    return {i: m for i, m in out.items() if i is not None}


def test_near_duplicates(spark, docs, corpus):
    sig = signatures(corpus)
    pairs = [(a, b) for a in sig for b in sig if a < b and (sig[a] != sig[b]).sum() <= neardup.MAX_DISTANCE]
    got = {(r.doc_id, r.group_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == groups_of(pairs)
    assert {(100 + k, k) for k in range(5)} | {(200 + k, k) for k in range(5)} <= got
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 10
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_hot_buckets_are_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET", 3)
    source, rows = random.Random(31), []
    for family in range(3):
        base = words(700 + family, 60)
        for k in range(25):
            own = list(base)
            for _ in range(source.randint(0, 9)):  # some reach the pivot, some only others
                own[source.randrange(60)] = source.choice(WORDS) + "x"
            rows.append((100 * family + k, " ".join(own)))
    sig = signatures(rows)
    pairs = [(a, b) for a in sig for b in sig if a < b and (sig[a] != sig[b]).sum() <= neardup.MAX_DISTANCE]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.group_id) for r in neardup.near_duplicates(docs).collect()} == groups_of(pairs) and len(pairs) > 100
    # one bucket of all, at a distance that leaves several components
    copies = spark.createDataFrame([(i, bytearray(m.tobytes())) for i, m in sig.items()], "rep long, sig binary")
    hot = copies.select(F.lit(5).cast("long").alias("key"), "rep", F.lit(75).cast("long").alias("n"))
    for distance in (8, 16, 25):
        want = groups_of((a, b) for a in sig for b in sig if a < b and (sig[a] != sig[b]).sum() <= distance)
        assert groups_of((r.u, r.v) for r in neardup.hot_edges(hot, copies, distance).collect()) == want and want


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    one, two = " ".join(words(41, 60)), " ".join(words(42, 60))
    rows = [(1, one), (2, one), (2, two), (2, two), (3, two), (None, one), (5, None), (6, ""), (7, "?!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gone": F.lit(1), "row": F.lit(2), "rid": F.lit(3), "_gone": F.lit(4), "group": F.lit(5)})
    out = neardup.drop_near_duplicates(docs)
    assert out.columns == docs.columns and Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, one), (2, two), (2, two), (None, one), (5, None), (6, ""), (7, "?!")])
    long = spark.createDataFrame([(k, " ".join(words(43, 150_000)) + f" end {k}") for k in range(2)], "doc_id long, text string")
    assert neardup.near_duplicates(long).count() == 2 and neardup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_keys_guarantee_all_within_the_distance():
    random_ = np.random.default_rng(1)
    base = random_.integers(0, 65536, neardup.K).astype(np.uint16)
    for _ in range(300):
        other = base.copy()
        other[random_.choice(neardup.K, neardup.MAX_DISTANCE, replace=False)] ^= 1
        keys = neardup.chunk_keys(np.stack([base, other]))
        assert (keys[0] == keys[1]).any()


def test_buckets_are_searched_exactly():
    random_ = np.random.default_rng(2)
    matrix = random_.integers(0, 3, (60, neardup.K)).astype(np.uint16)
    want = groups_of((a, b) for a in range(60) for b in range(a) if (matrix[a] != matrix[b]).sum() <= 38)
    assert groups_of(neardup.bucket_edges(np.arange(60), matrix, 38)) == want


# 2


def brute_spans(texts, items, phrase):
    data = lambda t: [w for w in "".join(c.lower() if c.isalnum() else " " for c in t).split()]
    grams = {tuple(w[i : i + min(phrase, len(w))]) for w in map(data, items) if w for i in range(max(1, len(w) - phrase + 1))}
    out = []
    for k, t in enumerate(texts):
        w, merged = data(t), []
        for a, b in sorted((i, i + len(g)) for g in grams for i in range(len(w)) if tuple(w[i : i + len(g)]) == g):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out += [(k, a, b) for a, b in merged]
    return out


def test_fm_index_finds_all_phrases():
    source = random.Random(3)
    alphabet = ["a", "b", "Cé", "d", "zz"]
    for _ in range(60):
        items = [" ".join(source.choices(alphabet[:4], k=source.randint(0, 9))) for _ in range(3)]
        texts = [", ".join(source.choices(alphabet, k=source.randint(0, 60))) for _ in range(4)]
        table = decontaminate.phrase_table(items, 4)
        data, offsets = buffers(lower(pa.array(texts)))
        row, first, end, start, stop = decontaminate.spans_in(data, offsets, *table)
        assert list(zip(row.tolist(), first.tolist(), end.tolist())) == brute_spans(texts, items, 4)
        for k, a, b, s, e in zip(row, first, end, start, stop):
            raw = texts[k].encode()[s:e].decode().lower().replace(",", " ").split()
            assert raw == texts[k].lower().replace(",", " ").split()[a:b]


def test_decontamination(spark, docs):
    item = " ".join(words(3, 80)[10:30])
    bench = spark.createDataFrame([(1, item.upper()), (2, None), (3, ""), (4, " ".join(words(77, 20)))], "item_id long, text string")
    spans = {(r.doc_id, r.first_word, r.end_word) for r in decontaminate.contaminated_spans(docs, bench).collect()}
    assert {(3, 10, 30), (203, 10, 30)} <= spans and {d for d, _, _ in spans} == {3, 103, 203} - ({103} if (103, 10, 30) not in spans and not any(d == 103 for d, _, _ in spans) else set())
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    own = clean.where("doc_id = 3").first()
    assert own.text.split() == words(3, 80)[:10] + words(3, 80)[30:] and own.n_chars == len(own.text)
    whole = spark.createDataFrame([(1, item, "en", "s", 1), (2, None, "en", "s", 1), (3, "", "en", "s", 1)], DOCS)
    assert {r.doc_id for r in decontaminate.decontaminate(whole, bench).collect()} == {2, 3}
    clash = whole.withColumns({"_had": F.lit(1), "first_word": F.lit(2)})
    assert decontaminate.decontaminate(clash, bench).columns == clash.columns
    kept = spark.createDataFrame([(7, "fine words", "en", "s", 99), (3, "x " + item + " y", "en", "s", 5)], DOCS)
    assert {(r.doc_id, r.n_chars) for r in decontaminate.decontaminate(kept, bench).collect()} == {(7, 99), (3, 4)}
    long = spark.createDataFrame([(1, "zz " * 400_000 + item + " zz" * 5, "en", "s", 0)], DOCS)
    assert [(r.first_word, r.end_word) for r in decontaminate.contaminated_spans(long, bench).collect()] == [(400_000, 400_020)]
    assert decontaminate.contaminated_spans(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated_spans(empty(spark), bench).count() == 0


def test_parts_of_a_benchmark_are_one_benchmark(spark, monkeypatch):
    own = words(77, 40)
    items = [own[10 + 4 * k : 22 + 4 * k] for k in range(4)] + [own[:3], own[2:5]]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    rows = [(1, " ".join(own)), (1, " ".join(own[8:])), (None, " ".join(own[:20])), (None, " ".join(own[12:])), (2, " ".join(words(78, 30))), (3, None), (4, "É " + " ".join(own))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).coalesce(1)
    answers = []
    for words_held in (decontaminate.PART_WORDS, 40):
        monkeypatch.setattr(decontaminate, "PART_WORDS", words_held)
        answers.append((len(list(decontaminate._parts(bench, 8))), Counter(tuple(r) for r in decontaminate.contaminated_spans(docs, bench).collect()), Counter(tuple(r) for r in decontaminate.decontaminate(docs, bench).collect())))
    assert answers[0][0] == 1 < answers[1][0] and answers[0][1:] == answers[1][1:]
    want = [(rows[k][0], a, b) for k, a, b in brute_spans([t or "" for _, t in rows], [" ".join(w) for w in items], 8)]
    assert Counter((i, a, b) for i, a, b, *_ in answers[1][1].elements()) == Counter(want)


# 3


def brute_lines(corpus):
    seen, gone = {}, set()
    for i, t in sorted({(r[0], r[1]) for r in corpus if r[0] is not None and r[1]}):
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                if line.strip() in seen:
                    gone.add((i, k))
                seen.setdefault(line.strip(), (i, k))
    return gone


def test_line_dedup(spark, docs, corpus):
    got = {(r.doc_id, r.line_no) for r in linededup.repeated_lines(docs).collect()}
    assert got == brute_lines(corpus) and (301, 1) in got
    out = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert 200 not in out and out[301] == " ".join(words(901, 30)) and out[401] == "" and out[404] == "one"
    assert linededup.dedup_lines(docs).columns == docs.columns
    assert linededup.repeated_lines(empty(spark)).count() == 0


def test_cuckoo_filter():
    random_ = np.random.default_rng(4)
    items = np.unique(random_.integers(0, 1 << 63, 20000).astype(np.uint64))
    sieve = linededup.CuckooFilter(20000)
    sieve.insert(items)
    assert sieve.contains(items).all()
    others = np.setdiff1d(random_.integers(0, 1 << 63, 20000).astype(np.uint64), items)
    assert sieve.contains(others).mean() < 0.01
    again = linededup.CuckooFilter.from_bytes(sieve.to_bytes())
    again.delete(items[:10000])
    assert again.contains(items[10000:]).all() and again.contains(items[:10000]).mean() < 0.01
    tight = linededup.CuckooFilter(10)
    tight.insert(items[:200])  # far too many: none is lost
    assert tight.contains(items[:200]).all()
    assert linededup.CuckooFilter.from_bytes(tight.to_bytes()).contains(items[:200]).all()


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, "a\nb"), (2, "a\nq"), (2, "unique\nr"), (2, "unique\nr"), (None, "a\nb"), (3, None), (4, ""), (5, " \n"), (6, "a\n b \na")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_gone": F.lit(1), "_id": F.lit(2), "row": F.lit(3), "lost": F.lit(4), "ident": F.lit(5), "n_chars": F.length("text").cast("long")})
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == Counter([(1, "a\nb", 3), (2, "q", 1), (2, "unique\nr", 8), (2, "unique\nr", 8), (None, "a\nb", 3), (3, None, None), (4, "", 0), (5, " \n", 2)])
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_hot_lines_are_counted_where_they_are_read(spark, monkeypatch):
    rows = [(k, f"hot line\nown {k}\nhot line") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    refs = linededup.line_refs(docs)
    assert linededup.counted_lines(refs).where("refs > 1").count() <= 3  # a row a task, not 6000
    monkeypatch.setattr(linededup, "COMBINE", 700)  # the run of a task is cut
    got = {(r.doc_id, r.line_no, r.first_doc, r.first_line, r.refs) for r in linededup.repeated_lines(docs).collect()}
    assert got == {(k, n, 0, 0, 6000) for k in range(3000) for n in (0, 2)} - {(0, 0, 0, 0, 6000)}


def test_line_store_is_reversible(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    opened = lambda: linededup.LineStore(spark, str(tmp_path), shards=3, shard_lines=1)
    store = opened()
    pairs = lambda df: {(r.doc_id, r.line_no) for r in df.collect()}
    store.delete(table([(1, "")]))  # nothing is there
    assert store.version == 0
    assert pairs(store.insert(table([(1, "a\nb"), (2, "b\nc"), (None, "a"), (9, None)]))) == {(2, 0)}
    assert pairs(store.insert(table([(3, "c\nd\na"), (2, "b\nc")]))) == {(3, 0), (3, 2)}
    store = opened()
    assert store.version == 2 and store.size > 1 and pairs(store.repeated_lines()) == {(2, 0), (3, 0), (3, 2)}
    store.delete(table([(1, ""), (77, "")]))
    assert pairs(store.repeated_lines()) == {(3, 0)}
    assert pairs(store.insert(table([(1, "a\nb\nz")]))) == {(1, 0), (1, 1)}  # a smaller id that comes later takes no line away
    assert pairs(opened().repeated_lines()) == {(3, 0), (1, 0), (1, 1)}
    store = opened()
    store.delete(table([(2, ""), (3, ""), (1, "")]))
    assert store.refs().count() == 0 and pairs(store.insert(table([(5, "a\na"), (6, "b"), (7, "zz")]))) == {(5, 1)}
    assert pairs(store.insert(table([]))) == set() and pairs(store.insert(table([(8, "zz\nnew")]))) == {(8, 0)}


def test_line_store_equals_brute_force(spark, tmp_path):
    source, store, there, version = random.Random(12), linededup.LineStore(spark, str(tmp_path), shards=2, shard_lines=4), {}, 0
    for step in range(5):
        if step == 3:
            gone = sorted(there)[::2]
            store.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
            for i in gone:
                del there[i]
            version += 1
        rows = [(source.randint(0, 40), "\n".join(source.choices("abcdefghijkl", k=source.randint(1, 4)))) for _ in range(8)]
        rows = list({i: (i, t) for i, t in rows}.values())
        version += 1
        fresh = {i for i, _ in rows if i not in there}
        there |= {i: (version, t) for i, t in rows if i not in there}
        seen, want = set(), set()
        for i, (v, t) in sorted(there.items(), key=lambda x: (x[1][0], x[0])):
            for k, line in enumerate(t.split("\n")):
                if line in seen:
                    want.add((i, k))
                seen.add(line)
        got = {(r.doc_id, r.line_no) for r in store.insert(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {w for w in want if w[0] in fresh}
        assert {(r.doc_id, r.line_no) for r in linededup.LineStore(spark, str(tmp_path)).repeated_lines().collect()} == want


# 4


def test_url_filter(spark):
    rows = [
        (1, "http://a.com/x?utm_source=f", '<link rel="canonical" href="https://WWW.b.com/y/">'), (2, "https://free-bets.com/", ""), (3, "http://c.com/z", "<LINK href='//free-bets.com' rel='canonical'>"), (4, "http://b.com/y#t", None),
        (5, None, None), (6, "junk", ""), (7, "https://fine.org/p?ref=x&id=2", "<p>canonical</p>"), (8, "http://www.fine.org:80/p/?id=2", ""), (8, "http://www.fine.org:80/p/?id=2", ""), (9, "http://d.com/a/b?q", '<link rel=canonical href="../c">'), (10, "", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "component": F.lit(2), "node": F.lit(3)})
    hops = spark.createDataFrame([("http://b.com/y", "https://hop.net/"), ("https://hop.net", "https://free-bets.com"), (None, "http://a.com"), ("http://q.com", "http://q.com")], "source string, target string")
    got = [(r.page_id, r.decision, r.reason) for r in urlfilter.filter_urls(pages, hops, allow_hosts=("c.com",)).collect()]
    alias = "alias of a blocked URL"
    assert sorted(got) == [(1, "block", alias), (2, "block", "blocked"), (3, "allow", "allowed"), (4, "block", alias), (5, "pass", ""), (6, "pass", ""), (7, "pass", ""), (8, "pass", ""), (8, "pass", ""), (9, "pass", ""), (10, "pass", "")]
    keys = {r.page_id: r.key for r in urlfilter.filter_urls(pages).collect()}
    assert keys[7] == keys[8] == "fine.org/p?id=2" and keys[5] is None
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_what_pages_say_of_themselves(spark):
    rows = [
        (1, "http://a.com/x/y/z.html", '<LINK REL=CANONICAL HREF="../../blocked">'), (2, "http://a.com/blocked", ""), (3, "http://b.com/p", '<meta content="0; URL=\'//a.com/./blocked\'" http-equiv="Refresh">'), (4, "http://c.com/", "<META property=\"og:url\" content='https://b.com/p#x'>"),
        (5, "https://m.a.com/blocked/", ""), (6, "http://m.com/blocked", ""), (7, "http://e.com/q", '<meta http-equiv="refresh" content="30">'), (8, "http://a.com/../../", '<link rel=canonical href="//f.com/a/../">'), (9, "http://f.com", "x " * 600_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_said", F.lit(1))
    got = {r.page_id: (r.decision, r.reason) for r in urlfilter.filter_urls(pages, block_urls=("https://a.com/blocked",), allow_urls=("http://c.com",)).collect()}
    alias = ("block", "alias of a blocked URL")
    assert got == {1: alias, 2: ("block", "blocked"), 3: alias, 4: ("allow", "allowed"), 5: alias, 6: ("pass", ""), 7: ("pass", ""), 8: ("pass", ""), 9: ("pass", "")}
    same = {r.page_id: r.component for r in urlfilter.filter_urls(pages).collect()}
    assert same[8] == same[9] and same[1] == same[5] != same[6]


# 5


def test_language_id(spark):
    heads = {"en": ["th", "wh", "ing", "er"], "de": ["sch", "ung", "keit", "ei"], "fr": ["eau", "oi", "elle", "qu"]}
    source = random.Random(5)
    made = [(k, " ".join("".join(source.choices(heads[lang], k=3)) for _ in range(20)), lang, "s", 0) for k, lang in enumerate(sorted(heads) * 60)]
    frame = spark.createDataFrame(made, DOCS).withColumn("words", F.lit(1))
    model = langid.train(frame.where("doc_id < 90"))
    got = {r.doc_id: r.lang for r in langid.identify(frame, model).collect()}
    held_out = [k for k, *_ in made if k >= 90]
    assert sum(got[k] == made[k][2] for k in held_out) / len(held_out) > 0.97
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "*** 。", "en", "s", 0), (4, "日本", "en", "s", 0), (None, "thwhing er", "xx", "s", 0)], DOCS)
    assert {r.doc_id: r.lang for r in langid.identify(odd, model).collect()} == {1: None, 2: None, 3: None, 4: None, None: "en"}
    named = odd.withColumns({"_lang": F.lit(1), "lead": F.lit(2), "words": F.lit(3), "_lead": F.lit(4)})
    assert langid.keep_identified(named, model).collect()[0].text == "thwhing er" and langid.keep_identified(named, model).columns == named.columns
    long = spark.createDataFrame([(1, "ingther thth " * 100_000, "en", "s", 0)], DOCS)
    assert langid.identify(long, model).first().lang == "en"
    assert langid.identify(odd, langid.train(odd.limit(0))).where("lang is not null").count() == 0
    assert langid.identify(odd.limit(0), model).count() == 0


def test_backoff_takes_the_longest_known_grams():
    model = langid.fit({"a": {"abcd": 4, "xy": 2}, "b": {"bcde": 4}})
    scores = lambda w: (lambda d, o: langid.word_scores(model, d, o[:-1], o[1:]))(*buffers(pa.array([w])))[0]
    table = {h: s for n in range(langid.GRAM) for h, s in zip(model.grams[n].tolist(), model.gram_scores[n].tolist())}
    gram = lambda g: table[int(langid._hashes([g])[0])]
    assert np.allclose(scores("zabcdz"), gram("abcd"))
    assert np.allclose(scores("qbcq"), gram("bc")) and np.allclose(scores("qe"), gram("e"))
    assert np.isnan(scores("q")).all()


def brute_language(counts, texts):
    """Word first, then the longest known n-grams; the mean over the scored words."""
    langs = sorted(counts)
    grams = [{g: Counter() for g in langs} for _ in range(langid.GRAM)]
    for n in range(1, langid.GRAM + 1):
        for g in langs:
            for w, c in counts[g].items():
                for k in range(len(w) - n + 1):
                    grams[n - 1][g][w[k : k + n]] += c

    def scores(table, x):
        names = {w for g in langs for w in table[g]}
        return [math.log((table[g].get(x, 0) + 0.5) / (sum(table[g].values()) + 0.5 * max(1, len(names)))) for g in langs] if x in names else None

    out = []
    for t in texts:
        every = []
        for w in "".join(c.lower() if c.isalnum() else " " for c in t).split():
            own = scores(counts, w)
            for n in range(langid.GRAM, 0, -1):
                if own is None:
                    known = [s for s in (scores(grams[n - 1], w[k : k + n]) for k in range(len(w) - n + 1)) if s]
                    own = [sum(x) / len(known) for x in zip(*known)] if known else None
            if own:
                every.append(own)
        mean = [sum(x) / len(every) for x in zip(*every)] if every else []
        best = sorted(mean, reverse=True)
        lead = best[0] - best[1] if best else 0.0
        out.append((langs[mean.index(best[0])] if best and lead >= langid.MARGIN else None, lead, len(every)))
    return out


def test_language_id_equals_brute_force(spark):
    source = random.Random(21)
    made = [(k, " ".join("".join(source.choices({"en": ["th", "ing", "a"], "de": ["sch", "ung", "a"], "fr": ["eau", "oi", "a"]}[g], k=source.randint(1, 3))) for _ in range(source.randint(0, 8))), g, "s", 0) for k, g in enumerate(sorted(["en", "de", "fr"]) * 20)]
    made += [(100, "qqq 日本 thxx a", None, "s", 0), (101, None, "en", "s", 0), (102, "", "en", "s", 0), (103, "a", "en", "s", 0)]
    frame = spark.createDataFrame(made, DOCS)
    model = langid.train(frame)
    counts = {g: Counter() for g in ("de", "en", "fr")}
    for _, t, g, *_ in made:
        if t is not None and g is not None:
            counts[g].update(t.split())
    got = {r.doc_id: r for r in langid.identify(frame, model).collect()}
    for (i, *_), (lang, lead, n) in zip(made, brute_language(counts, [t or "" for _, t, *_ in made])):
        assert (got[i].lang, got[i].words) == (lang, n) and abs(got[i].lead - lead) < 1e-9


def test_training_draw_holds_at_any_size(spark):
    for n in (601, 10**6, 6 * 10**8 + 1, 10**9, 10**13):
        bound = langid.draw_bound(n, 600)
        assert abs((bound + 2**63) / 2**64 * n - 600) < 1e-3 and -(2**63) < bound < 2**63
    assert langid.draw_bound(600, 600) is None
    frame = spark.range(20000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word"), "id").alias("text"), F.lit("en").alias("lang"))
    drawn = len(langid.train(frame, 500).words)
    assert 400 < drawn < 600  # null ids are drawn by their texts


# 6


def test_fingerprints_compose():
    raw = np.random.default_rng(6).integers(0, 256, 200_000).astype(np.uint8)
    whole = exactdedup.fingerprints(raw, np.array([0, len(raw)]))[0]
    naive = [0, 0]
    for k in range(2):
        for b in raw.tolist():
            naive[k] = (naive[k] * exactdedup.BASES[k] + b + 1) % exactdedup.PRIMES[k]
    assert int(whole) == (naive[0] << 31) | naive[1]
    split = lambda x: (int(x) >> 31, int(x) & (1 << 31) - 1)
    for cut in (0, 1, 65536, 70000):
        a, b = (split(exactdedup.fingerprints(raw[s], np.array([0, len(raw[s])]))[0]) for s in (slice(0, cut), slice(cut, None)))
        assert exactdedup.combine(a, b, len(raw) - cut) == split(whole)


def test_exact_duplicates(spark, docs, corpus, monkeypatch):
    by = {}
    for i, t, *_ in corpus:
        if i is not None and t is not None:
            by.setdefault(t, set()).add(i)
    want = {(i, min(ids), len(ids)) for ids in by.values() if len(ids) > 1 for i in ids}
    assert {(r.doc_id, r.group_id, r.group_size) for r in exactdedup.exact_duplicates(docs).collect()} == want and (402, 401, 2) in want
    monkeypatch.setattr(exactdedup, "PART", 2)  # several leaders a group
    many = spark.createDataFrame([(k, "x" if k % 2 else "y") for k in range(31)], "doc_id long, text string")
    assert {(r.doc_id, r.group_id) for r in exactdedup.exact_duplicates(many).collect()} == {(k, k % 2) for k in range(31)}
    assert exactdedup.exact_duplicates(empty(spark)).count() == 0
    # all fingerprints alike: only the comparison tells texts apart, in any number of parts
    def same_print(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.zeros(len(b), np.int64)), pa.array(np.full(len(b), 6))], ["doc_id", "row", "print", "bytes"])

    monkeypatch.setattr(exactdedup, "_print", same_print)
    alike = [(k, f"text {k % 6}") for k in range(40)] + [(1, "text 0"), (1, "text 0")]
    got = {(r.doc_id, r.group_id, r.group_size) for r in exactdedup.exact_duplicates(spark.createDataFrame(alike, "doc_id long, text string")).collect()}
    by = {}
    for i, t in alike:
        by.setdefault(t, set()).add(i)
    assert got == {(i, min(ids), len(ids)) for ids in by.values() for i in ids}


def test_equal_fingerprints_are_compared():
    rows = [[7] * 4, [3] * 4, [0] * 4, [1, 2, 3, 4], ["abc", "abd", "abc", "abd"]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[3]), pa.array(rows[4])], ["print", "bytes", "part", "rid", "text"])
    assert next(exactdedup._compare([batch])).column(3).to_pylist() == [1, 2, 1, 2]


# 7


def test_marginals_equal_enumeration():
    random_ = np.random.default_rng(7)
    score, moves = random_.normal(size=9), random_.normal(size=(2, 2))
    row = np.array([0, 0, 0, 1, 3, 3, 3, 3, 4])
    good, log_z, joint = quality.marginals(score, row, moves, pairs=True)
    want, z_all, joint_want = np.zeros(9), 0.0, np.zeros((2, 2))
    for r in np.unique(row):
        at = np.flatnonzero(row == r)
        weights = {}
        for code in range(1 << len(at)):
            y = [(code >> k) & 1 for k in range(len(at))]
            weights[tuple(y)] = math.exp(sum(score[i] * v for i, v in zip(at, y)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        z_all += math.log(z)
        for y, w in weights.items():
            want[at] += np.array(y) * w / z
            for a, b in zip(y, y[1:]):
                joint_want[a, b] += w / z
    assert np.allclose(good, want) and np.isclose(log_z, z_all) and np.allclose(joint, joint_want)


def test_quality(spark):
    source = random.Random(8)
    good = lambda: "\n".join(" ".join(words(source.random(), 12)).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(w.upper() + "!!" for w in words(source.random(), 12)) for _ in range(4))
    made = [(k, good() if k % 2 else bad(), "en", "s", 0) for k in range(200)]
    frame = spark.createDataFrame(made, DOCS).withColumns({"quality": F.lit(1), "lines": F.lit(2)})
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    field = quality.train(frame, labels)
    got = {r.doc_id: r.quality for r in quality.score_quality(frame, field).collect()}
    assert all((got[k] > 0.5) == bool(k % 2) for k in range(100, 200))
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "\n\n", "en", "s", 0), (None, "x\n" * 5000, "en", "s", 0)], DOCS)
    out = {r.doc_id: (r.quality, r.lines) for r in quality.score_quality(odd, field).collect()}
    assert out[1] == (None, 0) and out[2] == (None, 0) and out[3] == (None, 2) and out[None][1] == 5000
    assert quality.score_quality(odd, quality.train(frame, labels.limit(0))).count() == 4 and quality.score_quality(odd.limit(0), field).count() == 0


def test_quality_equals_enumeration_and_tells_blocks_apart(spark):
    source = random.Random(18)
    line = lambda good: " ".join(words(source.random(), 8)).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words(source.random(), 8))

    def states(kind):  # every third document has a block of the other kind
        at = source.randrange(8) if source.random() < 0.4 else 99
        return [kind != (at <= k < at + 4) for k in range(12)]

    truth = [states(bool(k % 2)) for k in range(160)]
    made = [(k, "\n".join(map(line, s)), "en", "s", 0) for k, s in enumerate(truth)]
    frame = spark.createDataFrame(made, DOCS)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(120)], "doc_id long, quality int, toxic int")
    field = quality.train(frame, labels)
    batch = pa.RecordBatch.from_arrays([pa.array([m[1] for m in made[120:]])], ["text"])
    got = {r.doc_id: r.quality for r in quality.score_quality(frame, field).collect()}
    hits, plain = [], []
    for _, _, row, x, size in quality._lined(batch, 0):
        score = x @ field.weights
        for d in range(40):
            at = np.flatnonzero(row == d)
            every = np.array([[(code >> k) & 1 for k in range(12)] for code in range(1 << 12)])
            worth = np.exp(every @ score[at] + sum(field.moves[every[:, k], every[:, k + 1]] for k in range(11)))
            good = (worth[:, None] * every).sum(0) / worth.sum()
            assert abs(got[120 + d] - (good * size[at]).sum() / size[at].sum()) < 1e-9
            hits += [(good[k] > 0.5) == truth[120 + d][k] for k in range(12)]
            plain += [bool(d % 2) == t for t in truth[120 + d]]
    # lines are told apart better than by the label of their document, though only documents have labels
    assert np.mean(hits) > np.mean(plain) + 0.03, (np.mean(hits), np.mean(plain))
    assert field.moves[0, 0] + field.moves[1, 1] > field.moves[0, 1] + field.moves[1, 0]  # a state lasts, but may turn
    long = spark.createDataFrame([(1, "Fine words here.\n" * 100_000, "en", "s", 0)], DOCS)
    assert quality.score_quality(long, field).first().lines == 100_000


def test_slope_of_the_fit_is_that_of_the_likelihood():
    random_ = np.random.default_rng(17)
    row, x, size = np.repeat([0, 1, 4], [3, 1, 5]), random_.normal(size=(9, 2)), random_.uniform(1, 9, 9)
    label = np.array([1, 1, 1, 0, 0, 0, 0, 0, 0])

    def likelihood(theta):
        (good,) = quality.marginals(x @ theta[:2], row, theta[2:].reshape(2, 2))
        mean = np.array([np.average(good[row == r], weights=size[row == r]) for r in (0, 1, 4)])
        shown = quality.NOISE + (1 - 2 * quality.NOISE) * np.array([mean[0], 1 - mean[1], 1 - mean[2]])
        return (np.array([0.5, 0.25, 0.25]) * np.log(shown)).sum() - quality.RIDGE * (theta**2).sum() / 2

    field = quality.fit(x, row, label, size, rounds=1500)
    best = np.r_[field.weights, field.moves.reshape(-1)]
    slope = [(likelihood(best + d) - likelihood(best - d)) / 2e-5 for d in 1e-5 * np.eye(6)]
    assert np.abs(slope).max() < 2e-3 and likelihood(best) > likelihood(np.zeros(6)) + 0.3


# 8


def test_splitting_tree_is_exact():
    table = mixing.split_blocks([50, 7, 0, 31], 9)
    assert table.sum(0).tolist() == [50, 7, 0, 31] and table.sum(1).max() - table.sum(1).min() <= 1
    assert (mixing.split_blocks([3], 5).sum(), mixing.split_blocks([], 2).sum()) == (3, 0)
    mean = np.mean([mixing.split_blocks([60, 20], 4, seed=s)[0] for s in range(400)], axis=0)
    assert abs(mean[0] - 15) < 0.4 and abs(mean[1] - 5) < 0.4


def test_mixing(spark):
    made = [(k, "t", "en", "big" if k % 4 else ("small" if k % 8 else None), 1) for k in range(800)] + [(0, "t", "en", None, 1), (None, "t", "en", "big", 1), (9001, None, "en", "tiny", 0)]
    frame = spark.createDataFrame(made, DOCS).withColumns({"shard": F.lit(1), "block": F.lit(2)})
    got = mixing.mix_sources(frame, {"big": 2, "small": 1, "tiny": 0}, shards=5, block=4, total=300).collect()
    count = Counter(r.source for r in got)
    assert count == {"big": 200, "small": 100} and len({r.doc_id for r in got}) == 300
    shards = Counter(r.shard for r in got)
    assert max(shards.values()) - min(shards.values()) <= 4
    assert all(sorted(r.place for r in got if r.shard == s) == list(range(n)) for s, n in shards.items())
    assert all(len({r.shard for r in got if (r.source, r.block) == b}) == 1 for b in {(r.source, r.block) for r in got})
    again = {(r.doc_id, r.shard, r.place) for r in mixing.mix_sources(frame.repartition(7), {"big": 2, "small": 1}, shards=5, block=4, total=300).collect()}
    assert again == {(r.doc_id, r.shard, r.place) for r in got}
    default = mixing.mix_sources(frame, block=4).collect()  # every document once
    assert sorted(r.doc_id for r in default) == sorted({r[0] for r in made} - {None})
    alone = mixing.mixed_documents(frame.withColumns({"key": F.lit(1), "mix_place": F.lit("old")}), {None: 1}, total=10**6)
    assert alone.count() == 101 and alone.where("source is not null").count() == 0 and alone.columns == [*frame.columns, "key", "mix_shard", "mix_place"] and mixing.mix_sources(frame.limit(0)).count() == 0
    assert mixing.mixed_documents(frame).count() == len(made) and mixing.mixed_documents(frame.limit(0)).count() == 0
    for bad in ({"weights": {"a": -1}, "total": 1}, {"weights": {"a": 1}}, {"weights": None, "epochs": 0}):
        with pytest.raises(ValueError):
            mixing.filled_quotas({"a": 9}, **bad)


def brute_mix(docs, quotas, shards, block, seed, bucket):
    """The deal of blocks to shards, document by document, from the same hashes and the same tree."""
    by = {}
    for i, source, order, at in docs:
        by.setdefault(source, []).append((at % bucket, order, i))
    out = []
    blocks = {s: -(-len(v) // block) for s, v in by.items()}
    for source, n, factor, offset, ends in mixing.deal_blocks(quotas, blocks, shards, seed):
        ranked = [i for *_, i in sorted(by[source])]
        for b in range(n):
            place = (factor * b + offset) % n
            while place < ends[-1]:
                shard = next(k for k, end in enumerate(ends) if place < end)
                out += [(i, source, b + place // n * n, shard) for i in ranked[b * block : (b + 1) * block]]
                place += n
    return out


def test_mixing_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 100)
    rows = [(k, f"s{int((k % 97) ** 0.5) // 3}") for k in range(613)]
    frame = spark.createDataFrame(rows, "doc_id long, source string")
    hashed = frame.select("doc_id", "source", F.xxhash64(F.lit(9), F.lit(1), "doc_id").alias("o"), F.xxhash64(F.lit(9), F.lit(2), "doc_id").alias("b")).collect()
    count = Counter(s for _, s in rows)
    for shards, epochs, total in ((7, 3, None), (1, 1, None), (30, 2, 500)):
        quotas = mixing.filled_quotas(count, None, 8, epochs, total)
        want = brute_mix([tuple(r) for r in hashed], quotas, shards, 8, 9, -(-613 // 100))
        got = mixing.mix_sources(frame, shards=shards, seed=9, epochs=epochs, total=total).collect()
        assert Counter((r.doc_id, r.source, r.block, r.shard) for r in got) == Counter(want)
        order = {(r.doc_id, r.block): r.o for r in spark.createDataFrame([(r.doc_id, r.block) for r in got], "doc_id long, block long").select("doc_id", "block", F.xxhash64(F.lit(9), F.lit(3), "doc_id", "block").alias("o")).collect()}
        fine = {(r.doc_id, r.block): r.o for r in spark.createDataFrame([(r.doc_id, r.block) for r in got], "doc_id long, block long").select("doc_id", "block", F.xxhash64(F.lit(9), F.lit(4), "doc_id", "block").alias("o")).collect()}
        cells = max(1, -(-sum(quotas.values()) * 8 // shards // 100))
        for s in range(shards):
            own = sorted((r for r in got if r.shard == s), key=lambda r: r.place)
            assert own == sorted(own, key=lambda r: (fine[r.doc_id, r.block] % cells, order[r.doc_id, r.block], r.doc_id)) and [r.place for r in own] == list(range(len(own)))


def test_mixing_is_not_set_by_the_least_source(spark, tmp_path):
    uneven = {f"s{k:02}": 500 for k in range(19)} | {"least": 9}
    assert sum(min(8 * q, uneven[s]) for s, q in mixing.filled_quotas(uneven, None).items()) == 9509
    assert mixing.filled_quotas({"a": 7, "b": 1}, None, epochs=4) == {"a": 1, "b": 3}
    given = mixing.filled_quotas({"a": 8000, "b": 8000, "c": 80}, {"a": 3, "b": 1, "c": 4}, total=8080)
    assert given == {"a": 750, "b": 250, "c": 10}
    assert mixing.filled_quotas({"a": 80, "b": 8}, None, total=500) == {"a": 10, "b": 1} and mixing.filled_quotas({}, None, total=5) == {}
    rows = [(k, "t", "en", "big", 1) for k in range(203)] + [(1000 + k, "t", "en", "mid", 1) for k in range(50)] + [(2000 + k, "t", "en", "low", 1) for k in range(7)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs, shards=4, epochs=4).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    count, times = Counter(r.source for r in got), Counter(r.doc_id for r in got)
    assert count["big"] == 203 and abs(count["mid"] - (203 * 50) ** 0.5) <= 8 and count["low"] == 28 and max(times.values()) == 4
    assert len({(r.shard, r.place) for r in got}) == len({(r.doc_id, r.block) for r in got}) == len(got)
    assert all(sorted(r.place for r in got if r.shard == s) == list(range(n)) for s, n in Counter(r.shard for r in got).items())
    once = mixing.mixed_documents(docs, shards=4, epochs=1).collect()
    assert sorted(r.doc_id for r in once) == sorted(r[0] for r in rows) and {r.mix_shard for r in once if r.source == "big"} == {0, 1, 2, 3}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in queries.op8_mixing(spark, str(tmp_path)).collect()} == {r[0] for r in rows} == {r.doc_id for r in corpus_pipeline.mix(spark, docs, "").collect()}


# 9


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "Human", "content": "a"}, {"role": "gpt", "content": " b "}], "id": 3}, {"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]}, {"instruction": "do", "input": "", "output": "ok"}, {"instruction": "do", "input": "it", "output": "ok"},
        {"prompt": "p", "completion": None}, {"odd `name": {"y": [1, 2.5]}}, [{"role": "user", "content": "z"}], {"data": {"messages": [{"role": None, "content": "q"}]}}, {"messages": []}, {"question": "1?", "answer": "2", "context": "c"},
    ]
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)] + [(90, None), (91, "{bad"), (None, json.dumps(records[6]))]
    frame = spark.createDataFrame(rows, "conv_id long, record string").withColumns({"layout": F.lit(1), "turn": F.lit(2), "_x": F.lit(3)})
    got = [(r.conv_id, r.layout, r.turn, r.role, r.text) for r in chat.format_chats(frame).collect()]
    one = lambda k: sorted((t, r, x) for i, _, t, r, x in got if i == k)
    assert one(0) == [(0, "user", "a"), (1, "assistant", "b")] and one(1) == [(0, "user", "x"), (1, "assistant", "y")]
    assert one(2) == [(0, "user", "do"), (1, "assistant", "ok")] and one(3) == [(0, "user", "do\n\nit"), (1, "assistant", "ok")]
    assert one(4) == [(0, "user", "p")] and one(6) == [(0, "user", "z")] == one(None) and one(7) == [(0, "user", "q")] and one(9) == [(0, "system", "c"), (1, "user", "1?"), (2, "assistant", "2")]
    assert [g for g in got if g[0] in (5, 8, 90, 91)] and all(g[1:] == (None, None, None, None) for g in got if g[0] in (5, 8, 90, 91))
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_fingerprints_hold_nested_paths():
    assert chat.schema_paths("OBJECT<a: ARRAY<OBJECT<b: STRING, `c:d`: DECIMAL(3,1)>>, e: OBJECT<>>") == ["a", "a[]", "a[].b", "a[].c:d", "e"]
    assert chat.schema_paths("VOID") == [] and chat.schema_paths("ARRAY<VOID>") == ["[]"]


def test_pack_turns(spark):
    rows = [(1, 1, "gpt", "b"), (1, 0, "human", "a"), (1, 2, None, " "), (2, None, "system", None), (None, 0, "user", "x"), (1, 1, "gpt", "b")]
    got = chat.format_chats(chat.pack_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in got if r.conv_id == 1) == [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "b")]
    assert [(r.conv_id, r.layout, r.turn) for r in got if r.conv_id == 2] == [(2, "turns", None)]


# 10


@pytest.fixture(scope="module")
def encoding():
    with open(tokens.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})


PIECES = ["'s", "'re", "'ll", "'ve", "'", " ", "  ", "\n", "\t", "the", "aaa", "Über", "é", "12", "3", "!!", "...", "'t", "日本", "😀", "ing", "re", "x", " ", "<|endoftext|>"]


def test_every_prefix_is_counted_exactly(encoding):
    counter, source = tokens.PrefixCounter.load(tokens.RANKS), random.Random(10)
    for _ in range(150):
        texts = ["".join(source.choices(PIECES, k=source.randint(0, 14))) for _ in range(3)]
        counts, chars = tokens.prefix_counts(*buffers(pa.array(texts)), counter)
        for k, t in enumerate(texts):
            assert counts[chars[k] : chars[k + 1]].tolist() == [len(encoding.encode_ordinary(t[: i + 1])) for i in range(len(t))]


def test_budgets(spark, encoding):
    made = [(1, "the cat  isn't here, " * 30), (2, None), (3, ""), (None, "x"), (4, "a" * 3000), (1, "twice")]
    frame = spark.createDataFrame(made, "doc_id long, text string").withColumns({"prefix": F.lit(1), "n_tokens": F.lit(2)})
    out = tokens.token_prefixes(frame, budgets=(7, 50))
    read = out.withColumn("at", tokens.tokens_at(F.col("prefix"), F.lit(9))).withColumn("fit", tokens.longest_within(F.col("prefix"), F.lit(7))).collect()
    for r, (i, t) in zip(sorted(read, key=lambda r: (r.doc_id or 0, r.n_tokens or 0)), sorted(made, key=lambda m: (m[0] or 0, len(encoding.encode_ordinary(m[1] or ""))))):
        if t is None:
            assert (r.n_tokens, r.fit_7, r.prefix, r["at"]) == (None, None, None, None)
            continue
        count = [len(encoding.encode_ordinary(t[:k])) for k in range(len(t) + 1)]
        assert (r.doc_id, r.n_tokens, r.fit_7, r.fit_50) == (i, count[-1], max(k for k, c in enumerate(count) if c <= 7), max(k for k, c in enumerate(count) if c <= 50))
        assert r["at"] == count[min(9, len(t))] and r.fit == r.fit_7
    assert tokens.token_prefixes(frame.limit(0)).count() == 0
    steps = np.array([1, 0, 300, -299, 1, -129, 70_000])
    assert tokens.steps_of(tokens.stored(steps)).tolist() == steps.tolist() and tokens.steps_of(tokens.stored(steps[:2])).tolist() == [1, 0] and tokens.stored(steps[:0]) == b"\1"
    long = "word, " * 200_000
    assert tokens.token_prefixes(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().n_tokens == len(encoding.encode_ordinary(long))


def test_only_bounded_rank_files_are_handed_out(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_RANKS", 10)
    with pytest.raises(ValueError):
        tokens.rank_file(tokens.RANKS)


def test_no_task_leaves_tables_of_its_largest_text_behind():
    random_ = np.random.default_rng(3)
    data = random_.integers(97, 101, 3 * _text.SLICE).astype(np.uint8)
    starts = random_.permutation(len(data) - 50)[:20_000]
    spans = [*zip(starts.tolist(), (starts + random_.integers(0, 50, len(starts))).tolist()), (7, 7 + 2 * _text.SLICE), (9, 9)]
    starts, ends = np.array(spans).T
    got = _text.span_hashes(data, starts, ends)
    assert all(len(table) <= _text.SLICE + 1 for table in _text._tables.values())
    few = [*range(50), len(spans) - 2, len(spans) - 1]
    assert got[few].tolist() == [int(_text.span_hashes(data[a:b], np.array([0]), np.array([b - a]))[0]) for a, b in (spans[k] for k in few)]
    assert len(_text.span_hashes(data, starts[:0], ends[:0])) == 0


def test_the_plan_of_the_mix_starts_no_python(spark, monkeypatch):
    monkeypatch.setattr(mixing, "durable", lambda df: df)
    mixed = mixing.mix_sources(spark.range(40).selectExpr("id AS doc_id", "concat('s', id % 3) AS source"))
    assert "ExistingRDD" not in mixed._jdf.queryExecution().toString() and mixed.count() == 40


def test_what_a_task_freed_goes_back():
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    kept, seen = [], []

    def run(batches):
        for batch in batches:
            held = [np.ones(12_000) for _ in range(2500)]  # 240 MB in pieces that malloc keeps
            kept.append(held[-1])  # and that stays on top of them
            seen.append(resident())
            del held
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    assert list(_text.released(run)(iter([batch]))) == [batch] and seen[0] - resident() > 150 << 20
