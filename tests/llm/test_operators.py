"""Each operator against brute force on small tables, with the awkward cases: nulls, empty and long texts,
ties, repeated rows, empty tables and extra columns with clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import decontamination, langid, line_dedup, packing, quality, sharding, simhash, substring_dedup, token_files, tokenization

DOCS = "doc_id long, text string"
WHITE = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WHITE, text or "")


def sentence(rnd, n, vocabulary):
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, shared lines and passages, and every awkward text."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdeéÀ") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    passage, line = sentence(rnd, 60, vocabulary), "  A Line that Many documents SHARE \t"
    texts = []
    for i in range(120):
        parts = [sentence(rnd, rnd.randint(1, 30), vocabulary) for _ in range(rnd.randint(1, 6))]
        if i % 3 == 0:
            parts.insert(rnd.randint(0, len(parts)), line if i % 2 else line.upper())
        if i % 5 == 0:
            parts.insert(rnd.randint(0, len(parts)), passage)
        texts.append("\n".join(parts))
    texts += [texts[0]] * 15 + [texts[7].replace("a", "b", 1), "", " \n\t", None, None, "x", "\n", "one\n\n\none", "y" * 20_000, "w " * 30_000, "a\x1cb\x85c d", texts[3] + "\n" + texts[3]]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows, and columns named like those the operators make."""
    rows = [(None, "alpha beta gamma delta"), (None, None), (1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (1, "other text of one"), (2, None), (2, "")]
    clashing = ["keep", "first", "ident", "pos", "h1", "shard", "fingerprint", "n_tokens", "size", "kept", "code", "length", "piece", "row", "n", "key", "tie", "run", "base", "id"]
    clashing += ["__key", "__size", "__run", "__n", "__keep", "__words", "__base", "__lines", "__score", "__ident", "__hits", "__shard", "__quality", "__row", "__s"]
    return spark.createDataFrame(rows, DOCS).select("*", *(F.lit(7).alias(c) for c in clashing))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_shards(docs, rows, odd, empty):
    got = sharding.histogram_shards(docs, 8).select("doc_id", "text", "__shard.*").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(rows, key=lambda r: r[0])
    size = {i: len((t or "").encode()) + 8 for i, t in rows}
    key = {i: int(hashlib.md5(f"\x1f{i}\x1f{t or ''}".encode()).hexdigest()[:15], 16) for i, t in rows}
    below, at = [0], sorted(size, key=key.get)
    for i in at:
        below.append(below[-1] + size[i])
    cuts = [min(range(len(below)), key=lambda k: (abs(below[k] - below[-1] * j / 8), k)) for j in range(1, 8)]
    want = {i: sum(k >= c for c in cuts) for k, i in enumerate(at)}
    assert {r["doc_id"]: r["shard"] for r in got} == want
    for s in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == [*range(len(own))]
    assert sharding.histogram_shards(odd, 3).count() == 7
    assert sharding.histogram_shards(empty, 3).count() == 0


def test_shards_cut_a_hot_key(spark):
    hot = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 2000, "x").otherwise(F.col("id").cast("string")).alias("text"))
    sizes = [r["n"] for r in sharding.histogram_shards(hot, 6).groupBy("__shard.shard").agg(F.sum("__shard.size").alias("n")).collect()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 30


def test_shards_of_several_runs(spark, docs, rows, monkeypatch):
    """Slots count on from run to run: cut into many runs, shards are the same and have no gap."""
    want = {r["doc_id"]: r["shard"] for r in sharding.histogram_shards(docs, 3).select("doc_id", "__shard.shard").collect()}
    monkeypatch.setattr(sharding, "RUN_BYTES", 20_000)
    got = sharding.histogram_shards(docs, 3).select("doc_id", "__shard.*").collect()
    assert {r["doc_id"]: r["shard"] for r in got} == want and len(got) == len(rows)
    for s in range(3):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == [*range(len(own))]


def test_token_counts(docs, rows, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenization.tokenizer_path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in tokenization.count_tokens(docs).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    assert tokenization.count_tokens(odd).count() == 7
    assert tokenization.count_tokens(empty).count() == 0


HARD = ["", " a", "a ", "a  b", "x<|endoftext|>y <|endoftext|> z", "a\n\nb \n c", "it's we'll 've\n's", "1234 ½ ²x", "Σας ΑΣ İx", "🙂🙂 é́ É́a", "\t\ta", "\nx", "x\n", "  a", "a b c", "..", "a.\n,b. c", "<|startoftext|>q Straße."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(rows, name):
    from tokenizers import Tokenizer

    path = tokenization.tokenizer_path(name)
    library, own = Tokenizer.from_file(path), tokenization.Encoder(path)
    texts = [t for _, t in rows if t] + HARD
    for end in (False, True):
        flat, counts = own.ids([*texts, None], end=end)
        for got, t in zip(np.split(flat, np.cumsum(counts)[:-1]), [*texts, ""], strict=True):
            assert got.tolist() == library.encode(t, add_special_tokens=False).ids + [0] * end, t
    if name.startswith("byte"):
        count = tokenization.MergeCounter(path).count
        assert [count(t) for t in HARD] == [len(library.encode(t, add_special_tokens=False).ids) for t in HARD]


def test_a_full_memory_loses_nothing(rows, monkeypatch):
    monkeypatch.setattr(tokenization, "MEMORY", 20)
    small, large = (tokenization.Encoder(tokenization.tokenizer_path("word_bpe_49k.json")) for _ in range(2))
    small.LOT_CHARS = 300
    monkeypatch.setattr(large, "LOT_CHARS", 1 << 30)
    texts = [t for _, t in rows]
    assert all(np.array_equal(a, b) for a, b in zip(small.ids(texts), large.ids(texts), strict=True))


def brute_groups(codes, near):
    """Union-find over all pairs."""
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if near(codes[i], codes[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(codes))]


def plain_fingerprint(text):
    own = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words(text)]
    n = min(4, len(own))
    hashes = [xxhash.xxh64(" ".join(own[i : i + n]).encode(), seed=42).intdigest() for i in range(len(own) - n + 1)] if own else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    codes = [plain_fingerprint(t) for _, t in rows]
    assert [got[i]["fingerprint"] % 2**64 for i, _ in rows] == codes
    roots = brute_groups(codes, lambda a, b: (a ^ b).bit_count() <= 4)
    assert [got[i]["component_id"] for i, _ in rows] == roots
    assert simhash.near_duplicates(odd).count() == 7
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_shingles_in_pieces(rows, monkeypatch, piece):
    """However many shingles are hashed together, the hashes and the bits are those of the whole text."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    texts = [t for _, t in rows if len(t or "") < 3000] + ["  a ", " \t", "É A\x0b\x0cb\u00a0c\r\n D  e", "\n"]
    for t in texts:
        own = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)]
        for n in (1, 4):
            k = min(n, len(own))
            want = [xxhash.xxh64(" ".join(own[i : i + k]).encode(), seed=42).intdigest() for i in range(len(own) - k + 1)] if own else []
            got = simhash.shingle_hashes(t, n)
            assert got.tolist() == want
        assert simhash.majority(got) % 2**64 == plain_fingerprint(t)


@pytest.mark.parametrize("group", [16, 4096])
def test_gray_index_parts_large_groups(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rnd = random.Random(2)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    codes = sorted({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for c in centres for _ in range(60)} | {rnd.getrandbits(64) for _ in range(200)})
    signed = [c - 2**64 if c >> 63 else c for c in codes]
    links = simhash.near_links(spark.createDataFrame([(c, c) for c in signed], "code long, id long")).collect()
    parent = {c: c for c in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = sorted((find(r["a"]), find(r["b"])))
        parent[b] = a
        assert ((r["a"] ^ r["b"]) % 2**64).bit_count() <= 64
    roots = brute_groups(codes, lambda a, b: (a ^ b).bit_count() <= 4)
    assert len({(find(s), r) for s, r in zip(signed, roots, strict=True)}) == len(set(roots)) == len({find(s) for s in signed})


def jaccard(a, b):
    a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(rnd, text, how, share):
    """A copy with words changed here and there, with a passage added, or with its end cut off."""
    w = text.split()
    n = max(1, round(len(w) * share))
    new = [f"new{rnd.randrange(10**9)}" for _ in range(n)]
    if how == "scattered":
        for at, x in zip(rnd.sample(range(len(w)), max(1, n // 5)), new, strict=False):
            w[at] = x
        return " ".join(w)
    return " ".join(w + new if how == "appended" else w[:-n])


def test_similar_documents_recall(spark):
    """Pairs of all kinds of edits against all pairs by brute force: what is linked is similar, and of what is similar 0.97 is linked."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(6000)]
    texts = [sentence(rnd, rnd.choice([12, 60, 150, 400, 1200]), vocabulary) for _ in range(240)]
    shared = sentence(rnd, 100, vocabulary)
    texts[:40] = [f"{t} {shared}" for t in texts[:40]]
    texts += [edited(rnd, t, how, rnd.uniform(0.01, 0.28)) for t in texts for how in ("scattered", "appended", "truncated")]
    grouped = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame([*enumerate(texts)], DOCS)).select("doc_id", "component_id").collect()}
    holders = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for h in set(simhash.shingle_hashes(t, 5).tolist()):
            holders[h].append(i)
    pairs = {p for own in holders.values() if len(own) < 200 for p in itertools.combinations(own, 2)}
    near = [(a, b) for a, b in pairs if jaccard(texts[a], texts[b]) >= 0.8]
    missed = [(a, b, round(jaccard(texts[a], texts[b]), 3)) for a, b in near if grouped[a] != grouped[b]]
    print(len(near), missed)
    assert len(near) > 500 and np.mean([grouped[a] == grouped[b] for a, b in near]) >= 0.97
    parent = [*range(len(texts))]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(near):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert all(find(i) == find(grouped[i]) for i in grouped)  # no group is wider than the links make it


def test_similar_documents_with_common_boilerplate(spark):
    """2,000 documents that share most of their shingles, in groups that share more: members of a group are found."""
    rnd = random.Random(14)
    vocabulary = [f"w{i}" for i in range(6000)]
    common = sentence(rnd, 300, vocabulary)
    texts = []
    for _ in range(400):
        own = sentence(rnd, 150, vocabulary)
        texts += [f"{common} {own}", *(edited(rnd, f"{common} {own}", "scattered", 0.04) for _ in range(4))]
    grouped = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame([*enumerate(texts)], DOCS)).select("doc_id", "component_id").collect()}
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    near = [(5 * g + a, 5 * g + b) for g in range(400) for a, b in itertools.combinations(range(5), 2) if alike(5 * g + a, 5 * g + b)]
    assert not any(alike(5 * g, 5 * g + 5) for g in range(399))  # what all share isn't enough
    found = np.mean([grouped[a] == grouped[b] for a, b in near])
    print(len(near), found)
    assert len(near) > 2000 and found >= 0.97
    assert len(set(grouped.values())) >= 400 and all(grouped[i] // 5 == i // 5 for i in grouped)


def test_similar_documents_lose_no_pair(spark):
    """3,000 pairs of documents at 0.8 or just above, one the first four fifths of the other: each pair is one group."""
    rnd = random.Random(21)
    vocabulary = [f"w{i}" for i in range(50_000)]
    long = [sentence(rnd, rnd.randint(40, 120), vocabulary).split() for _ in range(3000)]
    texts = [" ".join(w) for t in long for w in (t, t[: 4 + math.ceil(0.8 * (len(t) - 4))])]
    grouped = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame([*enumerate(texts)], DOCS)).select("doc_id", "component_id").collect()}
    assert [i for i in grouped if grouped[i] != i // 2 * 2] == []


def test_meeting_pairs_by_brute_force():
    """Prefixes of sets of which many share common hashes: all similar pairs of different groups meet, in batches of any size."""
    import pyarrow as pa

    rnd = random.Random(8)
    base, sets = [rnd.randrange(1, 2**64) for _ in range(60)], []
    for _ in range(300):
        own = [rnd.randrange(1, 2**64) for _ in range(rnd.randint(0, 12))]
        sets.append(np.array(sorted({*rnd.sample(base, rnd.randint(30, 60)), *own}), np.uint64))
    known = np.array(sorted(base)[:40], np.uint64)
    for common in (known[:0], known):
        rows = []
        for i, x in enumerate(sets):
            rows += [(k, i // 2 % 20, i, len(x), at) for at, k in enumerate(simhash.prefix(x, common, np.arange(len(common)) + 5, 0.8).tolist())]
        columns = np.array(sorted(rows)).T
        table = pa.Table.from_arrays([pa.array(c) for c in columns], names=["key", "component", "id", "size", "place"])
        met = [b for b in simhash._meet(table.to_batches(max_chunksize=97), 0.8)]
        got = {p for b in met for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        alike = lambda a, b: len({*a.tolist()} & {*b.tolist()}) >= 0.8 * len({*a.tolist()} | {*b.tolist()})
        near = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if a // 2 % 20 != b // 2 % 20 and alike(sets[a], sets[b])}
        assert len(near) > 100 and near <= got


def test_sketches_rule_out_no_similar_pair(spark):
    """Sets of all sizes that share about 0.6 to 1 of their hashes: those at 0.8 pass, most that differ more don't, as pairs and by prefixes."""
    import pyarrow as pa

    rnd, sets = random.Random(31), []
    for _ in range(150):
        base = [rnd.randrange(2**64) for _ in range(rnd.choice([1, 9, 60, 130, 240, 257, 300, 600, 1100, 2100]))]
        for share in (1, 0.97, 0.9, 0.85, 0.82, 0.75):
            own = [h if rnd.random() < share else rnd.randrange(2**64) for h in base]
            sets.append(np.array(sorted({*own[: len(own) - rnd.randint(0, len(own) // 10)]}), np.uint64))
    overlap = lambda a, b: len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    pairs = [p for g in range(0, len(sets), 6) for p in itertools.combinations(range(g, g + 6), 2)]
    share = {(a, b): (n := overlap(a, b)) / max(1, len(sets[a]) + len(sets[b]) - n) for a, b in pairs}
    near = {p for p in pairs if share[p] >= 0.8}
    assert 500 < len(near) < len(pairs) - 500
    each = spark.createDataFrame([(i, len(x), simhash.sketch(x).tolist()) for i, x in enumerate(sets)], "id long, size int, sketch array<long>")
    passed = {tuple(r) for r in simhash.may_be_similar(spark.createDataFrame(pairs, "a long, b long"), each.where("size > 0"), 0.8).collect()}
    far = [p for p in pairs if share[p] < 0.65 and min(len(sets[p[0]]), len(sets[p[1]])) > 100]
    assert near <= passed and len(far) > 300 and sum(p in passed for p in far) < 0.05 * len(far)

    rows = []
    for i, x in enumerate(sets):
        words = simhash.sketch(x).tolist() if len(x) <= simhash.SMALL else [0] * 4
        rows += [(k, i, i, len(x), at, *words) for at, k in enumerate(simhash.prefix(x, sets[0][:0], np.array([], np.int64), 0.8).tolist())]
    table = pa.Table.from_arrays([pa.array(c) for c in np.array(sorted(rows)).T], names=["key", "component", "id", "size", "place", *"0123"])
    got = {p for b in simhash._meet(table.to_batches(max_chunksize=997), 0.8) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    small = [p for p in far if max(len(sets[p[0]]), len(sets[p[1]])) <= simhash.SMALL]
    assert near <= got and len(small) > 50 and sum(p in got for p in small) < 0.1 * len(small)


def test_similar_documents_cases(spark, odd, empty):
    rnd = random.Random(5)
    text = sentence(rnd, 80, [f"v{i}" for i in range(900)])
    rows = [(3, text), (1, text + " "), (1, text), (1, text), (None, text), (None, None), (7, ""), (8, " \n"), (9, "one two"), (10, "One TWO"), (11, "one three"), (12, "q " * 50_000), (13, "q " * 50_000 + "q")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("first", F.lit("extra"))
    got = {(r["doc_id"], r["text"], r["first"]) for r in simhash.drop_near_duplicates(docs, simhash.similar_documents(docs)).collect()}
    assert {(i, f) for i, _, f in got} == {(i, "extra") for i in (1, 7, 9, 11, 12)} and len(got) == 5
    assert simhash.drop_near_duplicates(odd, simhash.similar_documents(odd)).columns == odd.columns
    assert simhash.drop_near_duplicates(odd, simhash.similar_documents(odd)).count() == 3
    assert simhash.drop_near_duplicates(empty, simhash.similar_documents(empty)).count() == 0


def test_quality_counts(spark, docs, rows, odd, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["__quality"] for r in quality.score_quality(docs, labels).collect()}
    for i, t in rows:
        w, seen, repeated = words(t), set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                repeated += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert tuple(got[i])[:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), repeated, len(covered), failed)
        assert not (got[i]["kept"] and failed)
    none = labels.limit(0)
    assert all(r["__quality"]["kept"] != r["__quality"]["base_failed"] for r in quality.score_quality(docs, none).collect())
    assert quality.score_quality(odd, labels).count() == 7
    assert quality.score_quality(empty, labels).count() == 0


def spark_hash(*words):
    """What Spark's xxhash64 makes of strings: each is the next one's seed."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h


def buckets_of(text):
    w = words(text)
    return [spark_hash(x) % quality.BUCKETS for x in w], [spark_hash(a, b) % quality.BUCKETS for a, b in zip(w, w[1:], strict=False)]


def brute_quality(rows, labels):
    """mean, low and kept of every text that passes the base rules, by the formulas."""
    good = {i for i, q, x in labels if q == 1 and not x and i is not None}
    target = {i for i in good if spark_hash(str(i)) % 2 == 0}
    raw, trusted = collections.Counter(), collections.Counter()
    for i, t in rows:
        for b in itertools.chain(*buckets_of(t)):
            raw[b] += 1
            trusted[b] += i in target
    n, m = raw.total() + quality.BUCKETS, trusted.total() + quality.BUCKETS
    weight = lambda b: round(1000 * math.log((trusted[b] + 1) / m * n / (raw[b] + 1)))
    scores = {}
    for k, (_, t) in enumerate(rows):
        ones, twos = buckets_of(t)
        if ones:
            own = sorted(map(weight, ones))
            scores[k] = (math.floor((sum(own) + sum(map(weight, twos))) / (2 * len(own) - 1)), own[min(len(own) - 1, 1 + len(own) // 250)])
    ends = []
    for part, share, margin in ((0, 0.001, 50), (1, 0.002, 200)):
        own = sorted(s[part] for k, s in scores.items() if rows[k][0] in good - target and len(words(rows[k][1])) >= 50)
        ends.append(own[int(share * (len(own) - 1))] - margin)
    return scores, ends


def test_quality_verdict_is_the_formula(spark):
    """Scores, thresholds and verdicts of every document; documents with a few words that trusted ones lack go."""
    rnd = random.Random(9)
    good = [f"g{i}" for i in range(300)]
    texts = [sentence(rnd, rnd.randint(60, 400), good) for _ in range(400)]
    for i in range(300, 400):
        w = texts[i].split()
        for at in rnd.sample(range(len(w)), 2 + len(w) // 100):
            w[at] = "nasty"
        texts[i] = " ".join(w)
    texts += [sentence(rnd, 5000, good), "short", None, "", "é " * 70]
    rows = [*enumerate(texts), (None, texts[1]), (2, texts[2])]
    labels = [(i, 1, 0) for i in range(150)] + [(i, 1, 1) for i in range(300, 330)] + [(i, 0, 0) for i in range(330, 340)] + [(None, 1, 0), (3, 1, None)]
    got = quality.score_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scores, ends = brute_quality(rows, labels)
    by_text = {rows[k][1]: s for k, s in scores.items()}
    found = got.select("doc_id", "text", "__quality.*").collect()
    assert len(found) == len(rows)
    for r in found:
        mean, low = by_text.get(r["text"], (None, None))
        if mean is None:
            assert (r["mean"], r["low"], r["kept"]) == (None, None, False)
            continue
        assert abs(r["mean"] - mean) + abs(r["low"] - low) <= 2, (r, mean, low)
        assert r["kept"] == (not r["base_failed"] and mean >= ends[0] and low >= ends[1])
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert not kept & set(range(300, 400)) and kept >= {*range(300), 400}


def test_quality_trusts_all_trusted_documents(spark):
    """Every trusted document of either half counts, however many there are."""
    labels = spark.range(20_000).selectExpr("id as doc_id", "1 as quality", "cast(id % 4 = 0 as int) as toxic")
    trusted = {r["doc_id"]: r["target"] for r in quality.trusted_ids(labels).collect()}
    assert set(trusted) == {i for i in range(20_000) if i % 4} and 7000 < sum(trusted.values()) < 8000
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('w', id) as text")
    weights = quality.bucket_weights(docs, quality.trusted_ids(labels)).first()["weights"]
    bucket = {i: spark_hash(f"w{i}") % quality.BUCKETS for i in range(20_000)}
    raw, target = collections.Counter(bucket.values()), collections.Counter(bucket[i] for i, t in trusted.items() if t)
    n, m = 20_000 + quality.BUCKETS, sum(trusted.values()) + quality.BUCKETS
    assert all(abs(w - 1000 * np.log((target[b] + 1) / m * n / (raw[b] + 1))) <= 0.51 for b, w in enumerate(weights))


def test_decontamination(spark, odd, empty):
    rnd = random.Random(6)
    vocabulary = [f"t{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    items = [(i, sentence(rnd, 40, vocabulary)) for i in range(12)]
    benchmark = spark.createDataFrame([*items, (99, None), (98, ""), (None, "x")], "item_id long, text string")
    clean = [sentence(rnd, 400, vocabulary) for _ in range(60)]
    leaks = {}
    for i in range(0, 60, 5):
        item = items[i // 5][1].split()
        if i % 2:
            item = [w if k % 9 else "edited" for k, w in enumerate(item)]
        w = clean[i].split()
        clean[i] = " ".join(w[:200] + [x.upper() + "," for x in item] + w[200:])
        leaks[i] = i // 5
    docs = spark.createDataFrame([*enumerate(clean), (100, None), (101, "")], DOCS)
    got = decontamination.contaminated(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(leaks.items())
    assert all(abs(r["first_word"] - 200) <= 3 and abs(r["last_word"] - 239) <= 3 for r in got)
    flagged = decontamination.find_contamination(odd, benchmark)
    assert flagged.columns == [*(c for c in odd.columns if c != "__hits"), "__hits"] and flagged.where(F.size("__hits") > 0).count() == 0
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0


def test_decontamination_finds_copies_edited_everywhere(spark):
    """Copies with every 4th, 5th or 6th word changed, or changed, dropped and added at random, by brute-force alignment."""
    rnd = random.Random(8)
    vocabulary = [f"t{i}" for i in range(4000)]
    items = [(i, sentence(rnd, rnd.randint(20, 60), vocabulary)) for i in range(30)]
    texts = []
    for k in range(150):
        item = items[k % 30][1].split()
        if k < 90:
            item = [f"new{k}" if at % (4 + k // 30) == k % 4 else w for at, w in enumerate(item)]
        else:
            share = rnd.random() / 3
            item = [x for w in item for x in ([w] if rnd.random() > share else rnd.choice([[], [f"new{k}"], [w, f"new{k}"]]))]
        texts.append(sentence(rnd, rnd.randint(0, 80), vocabulary) + " " + " ".join(item) + " " + sentence(rnd, rnd.randint(0, 80), vocabulary))
    block = decontamination.Items(items)
    assert not block.around.any()
    wanted, unseeded, ceilings = {}, 0, []
    for k, text in enumerate(texts):
        found = block.words(text)
        for i, own in enumerate(block.items):
            score = decontamination.align(own, found)[0]
            ceilings.append(block.ceiling(i, found) >= score)
            if score >= len(own) and len(block.found(found)[0]):
                wanted[k, i] = score / (2 * len(own))
            elif score >= len(own):
                unseeded += 1
    assert all(ceilings) and len(wanted) > 130 and {k for k, _ in wanted} >= set(range(90))
    docs, benchmark = spark.createDataFrame([*enumerate(texts)], DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == wanted and len(got) >= 0.9 * (len(wanted) + unseeded)


def test_decontamination_with_a_phrase_that_all_items_share(spark):
    """A common phrase leads to no item that has rare grams, but to those that have nothing else."""
    phrase = "answer the following question in one word"
    items = [(i, f"{phrase} " + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(2000)] + [(2000 + i, phrase + f" end{i}") for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    spread_out = " ".join(f"{phrase} filler{k}" for k in range(20))
    docs = spark.createDataFrame([(0, spread_out), (1, "before " + items[7][1] + " after"), (2, phrase), (3, None), (4, "")], DOCS)
    met = {r["key"]: {i["item_id"] for i in r["items"]} for r in decontamination.candidates(docs, benchmark).collect()}
    assert all(not ids & {*range(2000)} - {7} for ids in met.values())
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert (1, 7) in got and {(d, 2000 + i) for d in (0, 2) for i in range(40)} <= got
    assert not {i for d, i in got if d in (0, 2)} & {*range(2000)}


def test_seeds_are_rare_grams(spark):
    rnd = random.Random(12)
    items = [(i, sentence(rnd, rnd.choice([1, 2, 3, 5, 30]), ["a", "b", "c"] if i % 3 else [f"v{k}" for k in range(50)])) for i in range(200)]
    own = {i: {w[k : k + n] for k in range(len(w) - n + 1)} for i, t in items for w in [tuple(t.split())] for n in [min(3, len(w))]}
    held = collections.Counter(g for grams in own.values() for g in grams)
    got = collections.Counter(r["item"] for r in decontamination.rare_seeds(spark.createDataFrame(items, "item long, text string")).collect())
    for i, grams in own.items():
        assert got[i] == max(min(decontamination.SEEDS, len(grams)), sum(held[g] <= decontamination.RARE for g in grams))


def test_seeds_told_by_the_texts(spark):
    """A gram that many texts hold is no seed; an item that many texts have copied keeps all of its seeds."""
    items = [(0, "plain as it is but one of the most here"), (1, "copied by very many texts all over this place")]
    texts = [f"x{i} one of the most y{i}" for i in range(60)] + [f"z{i} copied by very many texts all over this" for i in range(60)] + [items[0][1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(texts)], DOCS)
    met = decontamination.candidates(docs, benchmark).collect()
    assert sorted(i["item_id"] for r in met for i in r["items"]) == [0] + [1] * 60
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == {(i, 1) for i in range(60, 120)} | {(120, 0)}


@pytest.mark.parametrize("bits", [5, 12, 22])
def test_decontamination_filter(spark, monkeypatch, bits):
    """The size of the filter changes nothing, also where items share an id, a text or both."""
    monkeypatch.setattr(decontamination, "BITS", bits)
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i}") for i in range(4)] + [(2, "alpha7 beta7 gamma7 delta7"), (2, "alpha2 beta2 gamma2 delta2"), (9, "alpha3 beta3 gamma3 delta3")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"x y alpha{i} beta{i} gamma{i} delta{i} z") for i in (0, 1, 2, 3, 7)] + [(7, "alpha7 beta7 gamma7 delta7"), (7, "alpha7 beta7 gamma7 delta7"), (None, "alpha0 beta0 gamma0 delta0"), (5, "w " * 40_000 + "alpha1 beta1 gamma1 delta1 alpha1 beta1 gamma1 delta1")]
    got = decontamination.contaminated(spark.createDataFrame(rows, DOCS), benchmark).collect()
    wanted = [(0, 0), (1, 1), (2, 2), (3, 3), (3, 9), (7, 2), (7, 2), (7, 2), (None, 0), (5, 1)]
    assert collections.Counter((r["doc_id"], r["item_id"]) for r in got) == collections.Counter(wanted) and all(r["score"] == 1 for r in got)
    assert [(r["first_word"], r["last_word"]) for r in got if r["doc_id"] == 5] == [(40_000, 40_003)]


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 15)), rng.integers(-1, 6, rng.integers(1, 25))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontamination.align(a, b)[0] == h.max()


def test_packing(docs, rows, odd, empty, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenization.tokenizer_path("word_bpe_49k.json"))
    got = packing.pack(docs, capacity=256).collect()
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in rows}
    want = {(i, at // 256): (at, len(x[at : at + 256]), zlib.crc32(x[at : at + 256].tobytes())) for i, x in ids.items() for at in range(0, len(x), 256)}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 256) + 2
    counts = collections.Counter(r["length"] for r in got)
    monkeypatch.setattr(packing, "SLICES", 2)
    monkeypatch.setattr(packing, "SLICE_ROWS", 3)  # of a length with over six pieces a slice has about three
    assert max(counts.values()) > 20
    sliced = packing.pack(docs, capacity=256).collect()
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in sliced} == {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in got}
    shape = lambda found: sorted((r["sequence_id"], r["offset"], r["length"]) for r in found)
    assert shape(sliced) == shape(got)
    assert packing.pack(odd, capacity=256).count() == 7
    assert packing.pack(empty).count() == 0


def optimum(lengths, capacity):
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for r in sorted({*rooms}):
            if r >= lengths[k]:
                rest = [*rooms]
                rest.remove(r)
                place(k + 1, [*rest, r - lengths[k]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_dominance_keeps_an_optimum():
    rnd = random.Random(8)
    for _ in range(200):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))]
        left = collections.Counter(lengths)
        fixed = packing.reduce_by_dominance(left, 20)
        used = collections.Counter(x for p, n in fixed for x in p * n)
        assert used + left == collections.Counter(lengths) and all(sum(p) <= 20 for p, _ in fixed)
        assert sum(n for _, n in fixed) + optimum([*left.elements()], 20) == optimum(lengths, 20)
        plan = packing.plan(collections.Counter(lengths), 20)
        assert collections.Counter(x for p, n in plan for x in p * n) == collections.Counter(lengths)
        assert all(sum(p) <= 20 for p, _ in plan) and sum(n for _, n in plan) <= optimum(lengths, 20) + 1


def test_token_files(spark, docs, rows, odd, empty, tmp_path):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenization.tokenizer_path("byte_bpe_50k.json"))
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path)
    got = {r["doc_id"]: r for r in token_files.digest_token_files(spark, path).collect()}
    index = {r["doc_id"]: r for r in token_files.read_token_index(spark, path).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert (index[i]["start"], index[i]["n_tokens"]) == (start, len(ids))
        start += len(ids)
    assert token_files.read_tokens(spark, path, F.col("doc_id") == 5).count() == 1
    meta = pq.ParquetFile(sorted((tmp_path / "tokens").glob("part*"))[0]).metadata.row_group(0)
    columns = {meta.column(k).path_in_schema: meta.column(k) for k in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings) and columns["doc_id"].has_offset_index
    for c in ("doc_id", "n_tokens"):
        assert set(columns[c].encodings) <= {"DELTA_BINARY_PACKED", "RLE"} and "DELTA_BINARY_PACKED" in columns[c].encodings
    assert token_files.round_trip(odd).count() == 7
    assert token_files.round_trip(empty).count() == 0


def test_language(spark, odd, empty):
    rnd = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["schr", "ung", "ei"], "cc": ["çã", "ó", "nte"], "dd": ["zz", "wy", "kr"]}
    rows = [(i, " ".join("".join(rnd.choice(syllables[g]) for _ in range(3)) for _ in range(30)), g) for i, g in enumerate(rnd.choice([*syllables]) for _ in range(300))]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34 !", "bb"), (902, "kalomi", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs.drop("lang"), model).select("doc_id", langid.held_out().alias("h"), "__lang.*").collect()}
    held = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["h"] for i, _ in held) and sum(r["h"] for r in got.values()) >= len(held)
    assert np.mean([got[i]["lang_pred"] == g for i, g in held]) > 0.97
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(odd, model).count() == 7
    assert langid.identify(empty, langid.fit(docs.limit(0))).count() == 0
    assert langid.codewords(12).shape[0] == 12 and len({*map(tuple, langid.codewords(12))}) == 12


def test_many_languages(spark):
    """Every one of 250 languages can be learnt and told, however few rows it has."""
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèçñøåčšž"
    rows = []
    for k in range(250):
        syllables = ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 4))) for _ in range(12)]
        rows += [(" ".join("".join(rnd.choice(syllables) for _ in range(2)) for _ in range(25)), f"l{k:03}") for _ in range(15)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 250
    held = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    told = [model.predict(t)[0] for t, _ in held]
    assert np.mean([p == g for p, (_, g) in zip(told, held, strict=True)]) > 0.9 and len(set(told)) > 225


def test_language_sample(spark, monkeypatch):
    """Repeated rows count once, ties of the hash and of doc_id are settled by the text, the order of rows changes nothing."""
    monkeypatch.setattr(langid, "SAMPLE_PER_LANGUAGE", 8)
    rows = [(i % 7, f"text {i % 30} of {'abc'[i % 3]}", "abc"[i % 3]) for i in range(400)] + [(3, "long " * 50_000, "a"), (None, "no id at all", "b")]
    one = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    two = langid.fit(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(1))
    assert one.langs == two.langs == ["a", "b", "c"] and np.array_equal(one.coefficients, two.coefficients)


def test_lines(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == i]
        assert (got[i]["text"] or "", tuple(got[i]["__lines"])) == ("\n".join(kept), (len(lines), len(lines) - len(kept)))
    assert line_dedup.dedup_lines(odd).columns == [*(c for c in odd.columns if c != "__lines"), "__lines"]
    assert {r["__n"] for r in line_dedup.dedup_lines(odd).collect()} == {r["row"] for r in line_dedup.dedup_lines(odd).collect()} == {7}
    kept = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(odd).collect()]
    assert sorted(kept, key=str) == sorted([(None, ""), (None, None), (1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (1, "other text of one"), (2, None), (2, "")], key=str)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_hot_lines(spark, rows, monkeypatch):
    """With hardly any hash taken for hot, and with very many, the result is the same."""
    docs = spark.createDataFrame(rows, DOCS)
    want = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    for share, rows_a_way in ((0.5, 1), (0.0001, 1 << 20), (0.0001, 2)):
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        monkeypatch.setattr(line_dedup, "WAY_ROWS", rows_a_way)
        assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == want


def test_repeated_words(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in substring_dedup.drop_repeated_words(docs, 20).collect()}
    seen, texts = set(), {}
    for i, t in sorted(rows):
        w, gone = words(t), set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            gone |= {*range(k, k + 20)} if window in seen else set()
            seen.add(window)
        texts[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert {i: (r["n_words"], r["n_removed"], r["text"]) for i, r in got.items()} == texts
    assert substring_dedup.drop_repeated_words(odd, 4).count() == 7
    assert substring_dedup.drop_repeated_words(empty).count() == 0
    with pytest.raises(ValueError, match="multiple of four"):
        substring_dedup.drop_repeated_words(empty, 10)


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_repeated_rows_keep_their_first_copy(spark, batch):
    """Rows alike in doc_id and text are one document, in one batch or several: none loses what only its repeats hold."""
    rnd = random.Random(12)
    passage, other = (sentence(rnd, 40, [f"p{i}" for i in range(500)]) for _ in range(2))
    rows = [(1, f"one {passage}")] * 5 + [(2, f"two {passage} end")] * 2 + [(3, f"{other} {other}")] * 3 + [(None, other)] * 2 + [(4, None)] * 2
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for parts in (1, 4):
            got = substring_dedup.drop_repeated_words(spark.createDataFrame(rows, DOCS).repartition(parts), 20).collect()
            wanted = [(1, f"one {passage}")] * 5 + [(2, "two end")] * 2 + [(3, other)] * 3 + [(None, "")] * 2 + [(4, "")] * 2
            assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(wanted)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_repeated_words_of_named_documents(spark, rows):
    """doc_ids that are strings: what comes first is told by their bytes."""
    named = [(None if i % 50 == 7 else f"d{i:03}", t) for i, t in rows]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.drop_repeated_words(spark.createDataFrame(named, "doc_id string, text string"), 20).collect()}
    late = [(i if n else 10**6 + k, t) for k, ((i, t), (n, _)) in enumerate(zip(rows, named, strict=True))]
    want = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.drop_repeated_words(spark.createDataFrame(late, DOCS), 20).collect()}
    assert {f"d{i:03}": x for i, x in want.items() if i < 10**6} == {i: x for i, x in got.items() if i}


def test_repeated_words_across_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.createDataFrame(rows, DOCS).repartition(3)
        small = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeated_words(docs, 20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeated_words(docs, 20).collect()}


def test_windows_of_several_texts_at_once():
    """Texts worked on together have the windows that each has alone: none reaches into the next text, none is left out."""
    rnd = random.Random(3)
    texts = [None, "", *(sentence(rnd, n, ["a", "b", "c", "d"]) for n in (1, 7, 8, 9, 40)), " \n", sentence(rnd, 8, ["e", "f"])]
    together = substring_dedup.Words(texts)
    starts = together.starts(8)
    got = [(int(i), int(at), int(h)) for i, at, h in zip(*together.placed(starts), substring_dedup.windows(together.hashes, 8)[starts], strict=True)]
    alone = [(i, at, int(h)) for i, t in enumerate(texts) for at, h in enumerate(substring_dedup.windows(substring_dedup.Words([t]).hashes, 8))]
    assert got == alone and len(got) == 1 + 2 + 33 + 1
