"""The stages against brute-force versions, on a small fixture with every odd row."""

from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadlake.llm import langid, mixing, neardup

from test_corpus_operators import DOCS, brute_language, brute_lines, brute_mix, brute_spans, groups_of, signatures, words


def own(k, n):
    """Words that tell the language."""
    return [w + ("th" if k % 2 else "sch") for w in words(k, n)]


def made():
    rows = [(k, " ".join(own(k, 60)) + "\n" + " ".join(own(k + 500, 30)), "en" if k % 2 else "de", f"src{k % 3}") for k in range(60)]
    for k in range(4):
        near = rows[k][1].split(" ")
        near[5] = "other"
        rows += [(100 + k, " ".join(near), "en", "src0"), (200 + k, rows[k][1], "en", "src1")]
    rows += [(300, None, None, None), (301, "", "en", "s"), (302, "*** !!!", "en", "s"), (303, "日本語", "en", "s")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def test_stages(spark, tmp_path):
    rows = made()
    bench = [(1, " ".join(own(9, 60)[10:40])), (2, " ".join(own(1001, 30)))]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, docs = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    back = lambda df: [tuple(r) for r in df.collect()]

    one = stage["language ID"](spark, docs, sf)
    known = {r.doc_id for r in langid.identify(docs, langid.train(docs)).where("lang is not null").collect()}
    assert one.columns == docs.columns and sorted(back(one)) == sorted(r for r in rows if r[0] in known) and not known & {300, 301, 302}

    kept = [r for r in rows if r[0] in known]
    two = back(stage["line dedup"](spark, spark.createDataFrame(kept, DOCS), sf))
    gone = brute_lines(kept)
    want = []
    for i, t, lang, s, n in kept:
        new = "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone)
        if new == t or new.strip():
            want.append((i, new, lang, s, len(new)))
    assert sorted(two) == sorted(want)

    three = back(stage["near dedup"](spark, spark.createDataFrame(kept, DOCS), sf))
    sig = signatures(kept)
    groups = groups_of((a, b) for a in sig for b in sig if a < b and (sig[a] != sig[b]).sum() <= neardup.MAX_DISTANCE)
    dropped = {i for i, g in groups if i != g}
    assert dropped and sorted(three) == sorted(r for r in kept if r[0] not in dropped)

    four = {r[0]: r[1] for r in back(stage["decontamination"](spark, spark.createDataFrame(kept, DOCS), sf))}
    hit = {kept[k][0]: (a, b) for k, a, b in brute_spans([r[1] for r in kept], [t for _, t in bench], 8)}
    assert 9 in hit and all((four[i] == t) == (i not in hit) for i, t, *_ in kept)
    assert four[9].split() == kept[[r[0] for r in kept].index(9)][1].split()[:10] + kept[[r[0] for r in kept].index(9)][1].split()[40:]

    told = brute_language(language_counts(rows), [r[1] or "" for r in rows])
    assert known == {r[0] for r, (lang, *_) in zip(rows, told) if lang is not None}

    last = corpus_pipeline.run(spark, sf)
    out = {r.doc_id: r for r in last.collect()}
    assert 0 < len(out) == last.count() and not set(out) & {200, 201, 202, 203, 300, 301, 302}
    want = brute_pipeline(rows, bench)
    assert {i: r.text for i, r in out.items()} == want
    # the deal, document by document
    left = [(i, out[i].source) for i in want]
    hashed = spark.createDataFrame(left, "doc_id long, source string").select("doc_id", "source", F.xxhash64(F.lit(mixing.SEED), F.lit(1), "doc_id"), F.xxhash64(F.lit(mixing.SEED), F.lit(2), "doc_id")).collect()
    quotas = mixing.filled_quotas(Counter(s for _, s in left), None)
    assert {(i, shard) for i, _, _, shard in brute_mix([tuple(r) for r in hashed], quotas, mixing.SHARDS, mixing.BLOCK, mixing.SEED, 1)} == {(i, r.mix_shard) for i, r in out.items()}
    assert all(sorted(r.mix_place for r in out.values() if r.mix_shard == s) == list(range(sum(r.mix_shard == s for r in out.values()))) for s in {r.mix_shard for r in out.values()})


def language_counts(rows):
    counts = {}
    for _, t, lang, *_ in rows:
        if t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update("".join(c.lower() if c.isalnum() else " " for c in t).split())
    return counts


def brute_pipeline(rows, bench):
    """{doc_id: text} after all stages, one row at a time."""
    told = brute_language(language_counts(rows), [r[1] or "" for r in rows])
    rows = [r for r, (lang, *_) in zip(rows, told) if lang is not None]
    gone = brute_lines(rows)
    cut = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t, *_ in rows]
    rows = [(i, t) for i, t in cut if t.strip()]
    sig = signatures(rows)
    groups = groups_of((a, b) for a in sig for b in sig if a < b and (sig[a] != sig[b]).sum() <= neardup.MAX_DISTANCE)
    rows = [r for r in rows if (r[0], r[0]) in groups or r[0] not in {i for i, _ in groups}]
    spans = {}
    for k, a, b in brute_spans([t for _, t in rows], [t for _, t in bench], 8):
        spans.setdefault(k, []).append((a, b))
    out = {}
    for k, (i, t) in enumerate(rows):
        for a, b in reversed(spans.get(k, [])):
            at, ends, inside = [], [], False
            for n, c in enumerate(t + " "):
                if c.isalnum() and not inside:
                    at.append(n)
                if not c.isalnum() and inside:
                    ends.append(n)
                inside = c.isalnum()
            t = t[: at[a]] + t[ends[b - 1] :]
        if any(map(str.isalnum, t)):
            out[i] = t
    return out


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, tmp_path, name):
    stage, sf = dict(corpus_pipeline.STAGES)[name], str(tmp_path)
    spark.createDataFrame([(1, " ".join(own(9, 30))), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    long = " ".join(own(5, 150_000)) + "\nend"
    rows = [(1, " ".join(own(1, 40)), "en", "a", 9), (1, " ".join(own(1, 40)), "en", "a", 9), (1, " ".join(own(2, 40)), "de", "b", 9), (None, " ".join(own(4, 40)), "de", None, None), (2, None, None, None, None), (3, "", "", "", 0), (4, long, "en", "a", len(long)), (5, "x " + " ".join(own(9, 30)), "en", "c", 9)]
    names = ["_gone", "gone", "_id", "ident", "row", "lost", "key", "_had", "_lang", "lang_", "_lead", "lead", "words", "shard", "block", "_words", "group", "rid", "sig"]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(k) for k, n in enumerate(names)})
    out = stage(spark, docs, sf)
    assert [c for c in out.columns if not c.startswith("mix_")] == docs.columns
    left = Counter((r.doc_id, r.text) for r in out.collect())
    every = Counter((i, t) for i, t, *_ in rows)
    gone = {"language ID": {(2, None), (3, "")}, "line dedup": set(), "near dedup": set(), "decontamination": {(5, rows[-1][1])}, "mixing": set()}[name]
    assert left == Counter({k: n for k, n in every.items() if k not in gone}) + (Counter({(5, "x "): 1}) if name == "decontamination" else Counter())
    assert stage(spark, docs.limit(0), sf).count() == 0 and (name == "mixing" or stage(spark, docs.limit(0), sf).columns == docs.columns)


def test_an_empty_corpus_stays_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("bucket", "files"), [(50_000, 16), (10, 64)])
def test_the_mix_sets_the_order_of_the_rows(spark, tmp_path, monkeypatch, bucket, files):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rows = [(k, f"text {k}", "en", f"src{k // 300}", 9) for k in range(600)]  # by source, as they come
    rows += [(5, "another text", "en", "src0", 12), (None, "no id", "en", None, 5)]
    dict(corpus_pipeline.STAGES)["mixing"](spark, spark.createDataFrame(rows, DOCS), "").write.parquet(out := str(tmp_path / "mixed"))
    parts = [p for f in sorted((tmp_path / "mixed").glob("part-*.parquet")) if (p := pq.read_table(f).to_pylist())]
    assert len(parts) == files and all(len({r["mix_shard"] for r in p}) == 1 and len({r["mix_place"] // bucket for r in p}) == 1 for p in parts)
    read = [(r["mix_shard"], r["mix_place"]) for p in parts for r in p]
    assert read == sorted(read) and Counter((r["doc_id"], r["text"]) for p in parts for r in p) == Counter((i, t) for i, t, *_ in rows)
    source = [r["source"] for p in parts for r in p]
    assert sum(x != y for x, y in zip(source, source[1:])) > 200  # no longer by source
    assert spark.read.parquet(out).count() == len(rows)
