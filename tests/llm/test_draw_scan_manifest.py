"""Resampling, license scans and the manifest against plain Python: whole tables, and the awkward rows."""

import collections
import hashlib
import math
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.functions.storage import table
from lectern.llm import licenses, manifest, ranks, resampling
from lectern.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


@pytest.fixture(scope="module")
def whole(spark):
    return [r.asDict() for r in table(spark, SF, "documents").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids and rows, null and empty texts and groups, long texts, and clashing names."""
    text = "Licensed under the Apache License, Version 2.0 " * 8
    rows = [(None, text, "en"), (None, None, None), (1, text, "en"), (1, text, "en"), (1, "other text of one", "fr"), (2, None, None), (2, "", ""), (3, "ß " * 400_000, "en"), (4, "x" * 3_000_000, "é"), (5, text, "en")]
    clashing = ["row", "rank", "total", "tie", "score", "weight", "n_words", "part", "hash", "tree", "pos", "path", "root", "w", "ident", "places", "spans", "gram", "label", "__draw", "__licenses"]
    return spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], DOCS).select("*", *(F.lit(7).alias(c) for c in clashing)), rows


def brute_draw(docs, target, longest=1, buckets=10_000, share=10, seed=2024, least=20):
    """``docs``: (doc_id, text).  Rows of doc_id, n_features, weight, score, rank."""

    def runs(text):
        w = words(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(runs(text)[1])
    for text in target:
        t.update(runs(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    found = []
    for i, text in docs:
        n, own = runs(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        found.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in found if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = collections.defaultdict(list)
    for k, r in enumerate(able[: len(able) * share // 100], 1):
        rank[r].append(k)
    return [(r[0], *r[2:], rank[r].pop() if rank[r] else None) for r in found]


def test_draw(spark, whole):
    target = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    want = brute_draw([(r["doc_id"], r["text"]) for r in whole], target)
    got = QUERIES["op11_importance_resampling"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_draw_of_word_pairs_ties_and_pieces(spark, whole, monkeypatch):
    """Runs of two words across pieces of a text; many rows with one score, whose doc_ids are cut."""
    monkeypatch.setattr(resampling, "PIECE", 50)
    docs = [(r["doc_id"], r["text"]) for r in whole[:60]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    target = [t for _, t in docs[:5]]
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), share=37, longest=2, buckets=97, keep=["doc_id"]).select("doc_id", "__draw.*")
    assert sorted(map(tuple, got.collect())) == sorted(brute_draw(docs, target, longest=2, buckets=97, share=37))
    values = [3, 3, 3, -5, 9, 9, 3, 0, 2**40, -(2**62)]
    rows = spark.createDataFrame([(v, i % 4, i) for i, v in enumerate(values)], "v long, d long, tie long").coalesce(1)
    for need in (1, 4, 7, 10):
        value, below, at = resampling.cutoff(rows, F.col("v"), need)
        assert value == sorted(values)[need - 1] and below == sum(v < value for v in values) and at == values.count(value)
        first = resampling.drawn(rows, [F.col("v"), F.col("d"), F.col("tie")], F.lit(True), need)
        assert sorted(r["tie"] for r in rows.where(first).collect()) == sorted(i for _, _, i in sorted((v, i % 4, i) for i, v in enumerate(values))[:need])


def test_draw_of_awkward_rows(spark, odd):
    docs, rows = odd
    target = spark.createDataFrame([("apache",), (None,)], "text string")
    got = resampling.resample(docs, target, share=60, seed=1)
    assert got.columns == [*(c for c in docs.columns if c != "__draw"), "__draw"]
    want = brute_draw([(i, t) for i, t, _ in rows], ["apache", None], share=60, seed=1)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.select("doc_id", "__draw.*").collect()), key=key) == sorted(want, key=key)
    assert {r["rank"] for r in got.select("rank").collect()} == {7}
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert {r[0] for r in resampling.resample(docs, target.limit(0), share=0).select("__draw.rank").collect()} == {None}


def test_ranks_within_groups(spark):
    rows = spark.createDataFrame([(f"g{i % 3}", -i) for i in range(1000)], "g string, v long").repartition(7)
    got = ranks.ranked(rows, [F.col("g"), F.col("v")], "ranks", within="g").collect()
    for g in ("g0", "g1", "g2"):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["v"])
        assert [r["rank"] for r in own] == list(range(len(own))) and {r["total"] for r in own} == {len(own)}


def brute_licenses(text, templates=licenses.TEMPLATES, k=licenses.GRAM):
    w, starts, base = words(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split(" ")
        own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += own
        base |= {label} if own else set()
    labels, best = set(base), 0.0
    for label, template in templates:
        t = words(template)
        places = collections.defaultdict(list)
        for j in range(len(t) - k + 1):
            places[tuple(t[j : j + k])].append(j)
        hits = [(i - j, j) for i in range(len(w) - k + 1) for j in places.get(tuple(w[i : i + k]), [])]
        merged = []
        for d, j in sorted(hits):
            if merged and d - merged[-1][-1][0] <= licenses.SLACK:
                merged[-1].append((d, j))
            else:
                merged.append([(d, j)])
        for copy in merged:
            own, found = ({x + n for x in xs for n in range(k)} for xs in ([j for _, j in copy], [d + j for d, j in copy]))
            if len(own) >= licenses.OF_TEMPLATE * len(t) and len(found) >= licenses.OF_SPAN * (max(found) + 1 - min(found)):
                labels.add(label)
                best = max(best, len(own) / len(t))
    starts.sort()
    return len(w), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if starts else best


def test_licenses(spark, whole):
    want = {r["doc_id"]: brute_licenses(r["text"]) for r in whole}
    got = QUERIES["op12_license_scans"](spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert any(w[4] for w in want.values())


def test_licenses_edited_and_repeated(spark, whole):
    """Copies with words changed, added and lost; two copies in one text; parts that are too small; common words."""
    texts = []
    for _, t in licenses.TEMPLATES:
        w, filler = t.split(" "), whole[3]["text"][:300]
        texts += [t, t.upper(), f"{filler} {t}\n{filler}\n{t}", " ".join(w[: len(w) // 3]), " ".join(w[:9] + ["so", "called"] + w[9:]), " ".join(w[:7] + w[8:]), " ".join(x if n % 9 else "changed" for n, x in enumerate(w))]
    texts += ["mit license mit license general public license", "license", "the gnu general public license " * 400, "licensed under cc by nc 4 0 " * 30]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = licenses.scan_licenses(docs).select("doc_id", "__licenses.*").drop("spans").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: brute_licenses(t) for i, t in enumerate(texts)}
    told = {r["doc_id"]: r["labels"].split(",") for r in got}
    for n, (label, t) in enumerate(licenses.TEMPLATES):
        assert label in told[7 * n] and label in told[7 * n + 1] and label in told[7 * n + 2]
        assert len(t.split(" ")) < 15 or label in told[7 * n + 4] and label in told[7 * n + 5]
    spans = licenses.license_spans(docs.where("doc_id = 2")).first()["spans"]
    assert [words(texts[2])[s["start"] : s["end"]] for s in spans if s["template"] == 0] == 2 * [words(licenses.TEMPLATES[0][1])]


def test_licenses_of_many_templates(spark, whole, monkeypatch):
    """Templates beyond the bound of a broadcast give the same."""
    few = spark.createDataFrame([(r["doc_id"], r["text"]) for r in whole[:50]], "doc_id long, text string")
    want = sorted(map(tuple, licenses.scan_licenses(few, keep=["doc_id"]).select("doc_id", "__licenses.*").collect()))
    monkeypatch.setattr(licenses, "BROADCAST_CHARS", 10)
    assert sorted(map(tuple, licenses.scan_licenses(few, keep=["doc_id"]).select("doc_id", "__licenses.*").collect())) == want


def test_licenses_of_awkward_rows(spark, odd):
    docs, rows = odd
    got = licenses.scan_licenses(docs)
    assert got.columns == [*(c for c in docs.columns if c != "__licenses"), "__licenses"]
    key = lambda r: str(r)
    short = [(i, t) for i, t, _ in rows if len(t or "") < 10_000]
    small = got.where("coalesce(length(text), 0) < 10000").select("doc_id", "__licenses.*").drop("spans")
    assert sorted(map(tuple, small.collect()), key=key) == sorted(((i, *brute_licenses(t)) for i, t in short), key=key)
    assert {r[0]: r[1] for r in got.where("doc_id in (3, 4)").select("doc_id", "__licenses.n_words").collect()} == {3: 400_000, 4: 1}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert licenses.scan_licenses(docs, templates=[("short", "one two"), ("none", "")]).count() == len(rows)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, plus=0):
    values = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + plus, r["text"]]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(hashes):
    """The root, and for each leaf the siblings (left, right) of all levels."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for p, i in zip(paths, at, strict=True):
            p.append((level[i - 1], None) if i % 2 else (None, level[i + 1] if i + 1 < len(level) else None))
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf(r) for r in sorted(groups[g], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, leaf(r)))]) for g in order}
    root, tops = climb([trees[g][0] for g in order])
    told = []
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(sorted(groups[g], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, leaf(r))), trees[g][1], strict=True):
            h = leaf(r, int(zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0)) if r["doc_id"] is not None else leaf(r)
            for left, right in path + top:
                h = sha(left or "", h, right or "")
            told.append((r["doc_id"], leaf(r), trees[g][0], root, sha(*(x for s in path + top for x in s if x)), h, h == root))
    return told


def test_manifest(spark, whole):
    got = QUERIES["op13_merkle_manifest"](spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_manifest(whole))


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_of_many_rounds(spark, monkeypatch, levels):
    """Groups of 1 to 300 rows in runs of 2, 4 and 8: every number of rounds, short last runs, more groups than a run holds."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "WIDTH", 1 << levels)
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 65, 300]
    rows = [{"doc_id": 1000 * g + i, "text": f"t{i}", "lang": None if g == 3 else f"l{g}", "source": "s" if i % 3 else None, "n_chars": i if i % 5 else None} for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS).repartition(6)
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    d = manifest.merkle_manifest(docs, columns)
    got = d.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof_text(F.col("path")), 256), manifest.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted(map(tuple, got)) == sorted((*r[:5], r[3]) for r in brute_manifest(rows))


def test_manifest_of_awkward_rows(spark, odd):
    docs, rows = odd
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    plain = [{"doc_id": i, "text": t, "lang": g, "source": "s", "n_chars": len(t or "")} for i, t, g in rows]
    d = manifest.merkle_manifest(docs, columns).select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof_text(F.col("path")), 256))
    assert sorted(map(tuple, d.collect()), key=str) == sorted((r[:5] for r in brute_manifest(plain)), key=str)
    assert manifest.merkle_manifest(docs.limit(0), columns).count() == 0
    alone = manifest.merkle_manifest(docs.where("doc_id = 3"), columns).first()
    assert alone["leaf"] == alone["subroot"] == alone["root"] and alone["path"] == []
