"""Pinned numbers and rules on small tables; folds against plain Python."""

import datetime
import hashlib
import math
import os
import pathlib
import random
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import scores
from lectern.functions.models import embedding_model
from lectern.functions.templates import filled
from lectern.operators import chunking as C
from lectern.operators import dashboards as D
from lectern.operators import requirements as E
from lectern.operators import retrieval as R
from lectern.operators import workspace as W
from lectern.operators.components import connected_components
from lectern.sources import pages as P
from lectern.sources import tables as S
from lectern.sources.store import Conflict, Store
from lectern.streaming import jobs as J


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


def test_coverage_and_blend(spark):
    assert one(spark, scores.coverage(F.lit(2), F.lit(0), F.lit(3))) == 66.7
    assert one(spark, scores.coverage(F.lit(0), F.lit(0), F.lit(0))) == 0
    assert one(spark, E.blend(F.lit(0.8), F.lit(0.4))) == 0.68
    assert one(spark, E.blend(F.lit(None).cast("double"), F.lit(0.5))) == 0.15
    assert [one(spark, scores.tier(F.lit(c))) for c in (0.8, 0.5, 0.49)] == ["high", "medium", "low"]


def test_boosts(spark):
    hits = spark.createDataFrame([(1, "plain.pdf", 0.012, 0), (1, "Guide Été.pdf", 0.010, 1), (1, " GUIDE ÉTÉ.PDF", 0.008, 2)], "query_id int, source string, rrf_score double, rank int")
    none = spark.createDataFrame([], "source string, factor double")
    assert [r["rank"] for r in R.boosted(hits, none).orderBy("rrf_score").collect()] == [2, 1, 0]
    up = spark.createDataFrame([("guide été.pdf", 1.5)], "source string, factor double")
    assert [(r["rrf_score"], r["boosted"]) for r in R.boosted(hits, up).orderBy("rank").collect()] == [(0.015, True), (0.012, False), (0.012, True)]


def test_votes_replace_and_are_checked(spark):
    rows = [(1, "R1", 1, "up", "a", 1, 1), (1, "R1", 1, "down", "b", 2, 2), (1, "R1", 2, "sideways", "c", 3, 3), (1, "R2", 1, "up", "x" * 3000, 4, 4)]
    votes = spark.createDataFrame(rows, "analysis_id int, requirement_id string, user_id int, vote string, comment string, updated_at int, event_id int")
    state = {r["requirement_id"]: r for r in W.upsert_votes(votes).collect()}
    assert (state["R1"]["vote"], state["R1"]["created_at"], state["R1"]["updated_at"]) == ("down", 1, 2)
    assert len(state["R2"]["comment"]) == 2000 and len(state) == 2


def test_merge_repass_guards(spark):
    rows = spark.createDataFrame([(1, "R001", "covered", 0.9, False, "h1"), (1, "R002", "ambiguous", 0.3, False, "h2"), (1, "R003", "missing", 0.0, True, "h3")], "analysis_id int, id string, status string, confidence double, repass_applied boolean, hypothesis string")
    again = spark.createDataFrame([(1, "R002", "covered", 0.8), (1, "R003", "covered", 0.8)], "analysis_id int, id string, status string, confidence double")
    got = E.merge_repass(rows, again, "large").orderBy("id").collect()
    assert [r["status"] for r in got] == ["covered", "covered", "missing"]
    assert [(r["repass_applied"], r["repass_model"], r["repass_reason"], r["hypothesis"]) for r in got] == [(False, None, None, "h1"), (True, "large", "batch_user_request", "h2"), (True, None, None, "h3")]
    assert [r["status"] for r in E.merge_repass(rows, again, force=True).orderBy("id").collect()] == ["covered"] * 3
    asked = spark.createDataFrame([(1, "R001"), (1, "R003")], "analysis_id int, id string")
    assert [r["id"] for r in E.repass_batch(rows, asked).collect()] == ["R001"]
    assert [r["id"] for r in E.repass_batch(rows, asked, force=True).orderBy("id").collect()] == ["R001", "R003"]
    down = spark.createDataFrame([(1, "R001")], "analysis_id int, requirement_id string")
    assert [r["id"] for r in E.repass_batch(rows, down_voted=down).orderBy("id").collect()] == ["R001", "R002"]


def test_requirement_record(spark):
    """Valid values stay, others become what the priority implies; lists come as lists, as one text or not at all."""
    made = """```json
{"requirements": [
 {"title": " Payslip ", "priority": "COULD", "obligation_level": "Contractuelle", "category": "paie", "subdomain": " ", "acceptance_criteria": ["a", "", " b "], "depends_on": ["C0R01", 3], "description": "d"},
 {"title": "x", "priority": "urgent", "obligation_level": "mandatory", "category": "Gardening", "acceptance_criteria": "only one", "source_location": " p. 2 "},
 {"title": "y", "priority": "wont", "notes": null}, {"title": "  "}]}
```"""
    rows = E.normalize(E.with_provisional_ids(E.parse_requirements(spark.createDataFrame([(1, 2, made), (2, 1, "[broken")], "doc_id int, part int, response string")))).orderBy("pos").collect()
    assert [(r["id"], r["title"], r["priority"], r["obligation_level"], r["category"]) for r in rows] == [("C2R01", "Payslip", "could", "contractuelle", "Paie"), ("C2R02", "x", "must", "contractuelle", "Autre"), ("C2R03", "y", "wont", "optionnelle", "Autre")]
    assert [(r["acceptance_criteria"], r["depends_on"], r["subdomain"], r["source_location"], r["notes"]) for r in rows] == [(["a", "b"], ["C0R01", "3"], None, "non localisé", ""), (["only one"], [], None, "p. 2", ""), ([], [], None, "non localisé", "")]
    many = spark.createDataFrame([(["c"] * 12,)], "c array<string>").select(E.listed(F.to_json("c"), 400, 8).alias("x")).first()["x"]
    assert len(many) == 8


def test_representative_is_the_richest(spark):
    rows = spark.createDataFrame([(1, 1, ["a"], "long text"), (2, 1, ["a", "b"], "s"), (3, 1, ["c", "d"], "longer"), (4, 4, [], "")], "idx int, root int, acceptance_criteria array<string>, description string")
    assert sorted(r["idx"] for r in E.representatives(rows, *E.richest()).collect()) == [3, 4]


def test_ratings_keep_the_last(spark):
    messages = spark.createDataFrame([(1, 1)], "conv_id int, turn int")
    ratings = spark.createDataFrame([(1, 1, 7, 1, 10), (1, 1, 7, -1, 11), (1, 1, 8, -1, 5), (1, 1, 8, 1, 6), (1, 1, 8, 0, 9), (1, 2, 7, 1, 1)], "conv_id int, turn int, user_id int, rating int, rated_at int")
    state = W.upsert_ratings(ratings, messages)
    assert sorted(map(tuple, state.collect())) == [(1, 1, 7, -1), (1, 1, 8, 1)]
    gone = spark.createDataFrame([(1, 1, 7)], "conv_id int, turn int, user_id int")
    assert [r["user_id"] for r in W.clear_ratings(state, gone).collect()] == [8]


def test_judged_cases(spark):
    rows = spark.createDataFrame([(1, i) for i in "abc"], "analysis_id int, id string")
    results = spark.createDataFrame([(1, "a", " ", "covered", "v", ["e"], 0.9, 0.5, None), (1, "b", "text", None, None, None, None, 0.5, "timeout"), (1, "c", "text", "partial", "v", ["e"], 0.8, 0.5, None)], "analysis_id int, id string, context string, result_status string, result_verdict string, result_evidence array<string>, llm_confidence double, retrieval_confidence double, error string")
    got = {r["id"]: r for r in E.judged(rows, results).collect()}
    assert (got["a"]["status"], got["a"]["verdict"], got["a"]["evidence"], got["a"]["llm_confidence"], got["a"]["retrieval_confidence"], got["a"]["confidence"]) == ("missing", E.NOTHING_FOUND, [], 0, 0, 0)
    assert (got["b"]["status"], got["b"]["verdict"], got["b"]["llm_confidence"], got["b"]["confidence"]) == ("ambiguous", E.CALL_FAILED + "timeout", 0, 0.15)
    assert (got["c"]["status"], got["c"]["confidence"]) == ("partial", 0.71)


def test_csv_cells_and_fences(spark):
    assert one(spark, S.csv_cell(F.lit('un mot; "deux"'))) == '"un mot; ""deux"""'
    assert one(spark, E.unfenced(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, F.size(S.parse_report(F.lit("{broken")))) == 0
    assert one(spark, E.title_key(F.lit("  Été : Gérer l'ÂGE "))) == "ete gerer l age"


def test_dates(spark):
    assert str(one(spark, P.french_date(F.lit("Mis à jour le 1er août 2024")))) == "2024-08-01"
    assert one(spark, P.french_date(F.lit("Mis à jour le 31 février 2024"))) is None
    assert one(spark, P.numeric_date(F.lit("Mis à jour le 45/13/2024"))) is None


def test_sentences_keep_abbreviations(spark):
    assert one(spark, C.sentences(F.lit("M. Dupont, art. 3 du code. Voir n°. 4 ! Fin.\n\nsuite"))) == ["M. Dupont, art. 3 du code.", "Voir n°. 4 !", "Fin.", "suite"]


def test_structure(spark):
    text = "intro\n# A\nbody a\n## B\nbody b\n1.2 Titre\nbody c\n# Empty\n \t\n\n# D\nbody d\n  # no heading\nArticle 3 bis\nbody e"
    docs = spark.createDataFrame([("s", text), ("t", "no heading"), ("u", ""), ("v", None)], "source string, text string")
    rows = C.heading_paths(docs).orderBy("source", "block").collect()
    wanted = [("s", [], "intro"), ("s", ["# A"], "body a"), ("s", ["# A", "## B"], "body b"), ("s", ["# A", "1.2 Titre"], "body c"), ("s", ["# D"], "body d\n  # no heading"), ("s", ["Article 3 bis"], "body e"), ("t", [], "no heading")]
    assert [(r["source"], r["heading_path"], r["text"]) for r in rows] == wanted
    sections = C.structure_blocks(docs).where("source = 's'").orderBy("block").collect()
    assert [(r["heading"], r["depth"]) for r in sections] == [(None, None), ("# A", 1), ("## B", 2), ("1.2 Titre", 2), ("# Empty", 1), ("# D", 1), ("Article 3 bis", 1)] and sections[4]["text"] == ""


def walked(sizes, apart):
    """Where chunks begin, step by step."""
    d = sorted(apart)
    at = 0.9 * (len(d) - 1)
    limit = max(d[int(at)] + (at - int(at)) * (d[min(int(at) + 1, len(d) - 1)] - d[int(at)]), 0.12) if d else 0
    total, begins = 0, []
    for i, x in enumerate(apart):
        total += sizes[i]
        if total >= 400 and (x >= limit or total >= 2400):
            begins.append(i + 1)
            total = 0
    return begins


def gathered(sentences, begins):
    out = []
    for a, b in zip([0, *begins], [*begins, len(sentences)], strict=True):
        if out and b - a < 2:
            out[-1] += " " + " ".join(sentences[a:b])
        else:
            out.append(" ".join(sentences[max(0, a - 1) if out else a : b]))
    return out


def test_breakpoints_fold(spark):
    rnd = random.Random(3)
    blocks = [(["x" * 300] * 30, [0.0] * 29), (["only one"], []), (["a" * 500, "b" * 10], [0.9])]
    for _ in range(12):
        n = rnd.randint(1, 40)
        blocks.append(([rnd.choice("abc") * rnd.randint(50, 700) for _ in range(n)], [rnd.random() for _ in range(n - 1)]))
    rows = spark.createDataFrame([(k, *b) for k, b in enumerate(blocks)], "k int, found array<string>, apart array<double>")
    begun = rows.withColumn("begins", C.breakpoints(F.col("found"), F.col("apart")))
    got = begun.select("k", "begins", C.assembled(F.col("found"), F.col("begins")).alias("chunks")).orderBy("k").collect()
    for r, (found, apart) in zip(got, blocks, strict=True):
        begins = walked([*map(len, found)], apart)
        assert r["begins"] == begins and r["chunks"] == gathered(found, begins)
    assert got[0]["begins"] == [8, 16, 24]  # flat text is cut at 2400 characters: four chunks


def test_size_split(spark):
    """Pieces as a walk along the words makes them; a text of 200,000 words takes no square of them."""

    def walk(text, limit):
        out, held, total = [], [], 0
        for w in re.split(r"[ \t\n\x0b\f\r]+", text):
            if w:
                held, total = [*held, w], total + len(w) + 1
                if total >= limit:
                    out, held, total = [*out, " ".join(held)], [], 0
        return [*out, " ".join(held)] if held else out

    rnd = random.Random(11)
    texts = ["", " \n\t ", "a", " a  b\tc d\x85e\x1cf ", "x" * 90 + " y", "é𝔘 " * 300, *("".join(rnd.choice(["w", "ab", "  ", " ", "\n", "\u2028", "ü"]) for _ in range(400)) for _ in range(20))]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([None, *texts])], "k int, text string")
    for limit in (1, 2, 3, 7, 40):
        got = [r[0] for r in rows.orderBy("k").select(C.size_split(F.col("text"), limit)).collect()]
        assert got == [None, *(walk(t, limit) for t in texts)]
    began, long = time.perf_counter(), spark.createDataFrame([("ab " * 200_000,)], "text string")
    assert [long.select(F.size(C.size_split(F.col("text"), n))).first()[0] for n in (12, 60_000)] == [50_000, 10]
    assert time.perf_counter() - began < 40


def test_chunk_documents(spark):
    """All ways through the chunker, a sentence at a time in plain Python."""
    rnd = random.Random(7)
    sentence = lambda: f"{rnd.choice('ABCDE')}{' '.join(rnd.choice(['lorem', 'ipsum', 'zzz', 'aeiou']) for _ in range(rnd.randint(5, 30)))}."
    long = " ".join(sentence() for _ in range(60))
    docs = [(1, "s", f"# One\n{long}\n## Two\nShort. Text."), (2, "s", " ".join(f"Word {i}." for i in range(1600))), (3, None, "  \n"), (4, "t", None), (5, "t", "Lone"), (5, "t", "Lone")]
    letters = "aei"
    vector = lambda w: [float(w.count(x)) for x in letters]
    model = lambda df, c: df.withColumn("embedding", F.array(*((F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit("")))).cast("double") for x in letters)))
    rows = C.chunk_documents(spark.createDataFrame(docs, "doc_id int, source string, text string"), model).orderBy("doc_id", "chunk").collect()
    found = re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", long)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    vectors = [vector(" ".join(found[i : i + 2])) for i in range(len(found))]
    begins = walked([*map(len, found)], [1 - cos(a, b) for a, b in zip(vectors, vectors[1:], strict=False)])
    own = [r for r in rows if r["doc_id"] == 1]
    assert [r["text"] for r in own] == [*gathered(found, begins), "Short. Text."] and {r["chunker_version"] for r in own} == {"v2"}
    assert own[-1]["heading_path"] == ["# One", "## Two"] and own[-1]["heading"] == "# One / ## Two"
    assert [r["chunk_id"] for r in own] == [f"{hashlib.md5(b's').hexdigest()[:8]}_1_{i}" for i in range(len(own))]
    fast = [r for r in rows if r["doc_id"] == 2]
    assert {r["chunker_version"] for r in fast} == {"v2-fastpath"} and " ".join(r["text"] for r in fast) == docs[1][2] and all(len(r["text"]) >= 2399 for r in fast[:-1])
    assert [(r["text"], r["chunk"]) for r in rows if r["doc_id"] == 5] == [("Lone", 0)] * 2 and {r["doc_id"] for r in rows} == {1, 2, 5}


def test_plain_pieces():
    assert C.plain_pieces("") == [] and C.plain_pieces("short") == ["short"]
    text = "\n\n".join(" ".join(f"w{p}x{i}" for i in range(60)) for p in range(6))
    pieces = C.plain_pieces(text)
    assert all(len(p) <= 800 for p in pieces) and all(p in text for p in pieces)
    assert pieces[0].count("\n\n") >= 1 and {w for p in pieces for w in p.split()} == set(text.split())
    solid = "y" * 2000
    assert all(len(p) <= 800 for p in C.plain_pieces(solid)) and C.plain_pieces(solid)[0] == "y" * 800
    lapped = C.plain_pieces(" ".join(f"word{i:04}" for i in range(400)))
    assert all(a.split()[-1] in b.split() for a, b in zip(lapped, lapped[1:], strict=False))


def test_pack_and_long_splits(spark):
    paragraphs = ["a" * 900, "b" * 800, "c" * 400, "d" * 2500, "e"]
    packed = one(spark, P.pack_paragraphs(F.lit("\n\n".join(paragraphs))))
    assert packed == ["a" * 900 + "\n\n" + "b" * 800, "c" * 400, "d" * 2500, "e"]
    assert one(spark, P.pack_paragraphs(F.lit(""))) == []
    text = " \n" + " ".join(f"word{i}" for i in range(2000)) + "\n\n" + "z" * 7000 + " \n" + " " * 3500 + "end  "
    pieces = one(spark, C.long_splits(F.lit(text), size=3000, overlap=300))
    whole, start, wanted = text.strip(), 0, []
    while start < len(whole):  # cut by cut
        end = min(start + 3000, len(whole))
        if end < len(whole):
            low = start + 1000
            at = next((k for k in (whole[low:end].rfind(m) for m in ("\n\n", "\n", " ")) if k >= 0), -1)
            end = low + at if at > 0 else end
        wanted.append(whole[start:end].strip())
        if end >= len(whole):
            break
        start = max(end - 300, start + 1)
    assert pieces == [w for w in wanted if w]
    assert one(spark, C.long_splits(F.lit("  short "), size=3000, overlap=300)) == ["short"]


def test_paged_text_stops_at_the_limit(spark):
    pages = spark.range(500).select(F.lit("s").alias("source"), "id", F.repeat(F.lit("x"), 100).alias("text")).withColumnRenamed("id", "page")
    got = C.paged_text(pages, limit=1000).first()["text"]
    whole = "\n\n".join(f"[page {i}]\n{'x' * 100}" for i in range(500))
    assert got == whole[:1000] + "\n\n[...document tronqué...]"


def test_dense_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).astype("float32").tolist(), "private" if i % 3 else "knowledge_base") for i in range(300)] + [(900, [0.0] * 8, "private"), (901, None, "private"), (902, [1.0], "private"), (903, vectors_copy := [1.0] * 8, "private"), (904, vectors_copy, "private")]
    queries = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(7)] + [(50, [1.0] * 8)]
    v = spark.createDataFrame(vectors, "chunk_pos long, embedding array<float>, collection string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    def ranked(query, rows):
        scored = [(-round(float(np.dot(x, query) / np.sqrt(np.dot(x, x) * np.dot(query, query))), 6), i) for i, x in ((i, np.array(x, float)) for i, x, _ in rows if x and len(x) == 8 and any(x))]
        return [i for _, i in sorted(scored)[:5]]
    for block in (3, 50_000):
        got = R.dense(v, q, 5, block=block).orderBy("query_id", "rank").collect()
        for i, x in queries:
            assert [r["chunk_pos"] for r in got if r["query_id"] == i] == ranked(np.array(x, float), vectors)
    by = R.dense(v, q, 5, "collection").collect()
    for c in ("private", "knowledge_base"):
        assert [r["chunk_pos"] for r in sorted(by, key=lambda r: r["rank"]) if r["query_id"] == 2 and r["collection"] == c] == ranked(np.array(queries[2][1], float), [x for x in vectors if x[2] == c])
    assert R.dense(v, q.limit(0), 5).count() == R.dense(v.limit(0), q, 5).count() == 0


def test_dense_takes_queries_of_all_lengths(spark, monkeypatch):
    """Queries of two lengths, each against the vectors of its own; tiles of one query; no query is lost."""
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0])], "chunk_pos long, embedding array<float>")
    q = spark.createDataFrame([(7, [0.0, 2.0, 0.0]), (8, [3.0, 0.0]), (9, [0.0, 1.0]), (10, []), (11, None)], "query_id long, embedding array<float>")
    want = [(7, 4, 1.0, 0), (7, 3, 0.0, 1), (8, 1, 1.0, 0), (8, 2, 0.6, 1), (9, 2, 0.8, 0), (9, 1, 0.0, 1)]
    for tile in (1, 4_000_000):
        monkeypatch.setattr(R, "TILE", tile)
        assert sorted(map(tuple, R.dense(v, q, 2).select("query_id", "chunk_pos", "score", "rank").collect()), key=lambda r: (r[0], r[3])) == want


def brute_bm25(chunks, queries, k):
    docs = {i: (t or "").lower().split() for i, t in chunks}
    df = Counter(w for d in docs.values() for w in set(d))
    raw = {w: math.log((len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    mean = sum(map(len, docs.values())) / len(docs)
    found = []
    for query_id, text in queries:
        scores = []
        for i, d in docs.items():
            tf = Counter(d)
            score = round(sum((low if raw[w] < 0 else raw[w]) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in (text or "").lower().split() if w in tf), 9)
            scores += [(-score, i)] if score > 0 else []
        found += [(query_id, i, n, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return found


@pytest.mark.parametrize("tile", [7, 4_000_000])
def test_bm25_is_exact(spark, monkeypatch, tile):
    """A word that all chunks and all queries hold, words of a few, ties, repeated words, nothing to ask; small tiles and blocks."""
    rnd = random.Random(5)
    word = lambda: "w%d" % min(int(rnd.expovariate(0.05)), 90)
    chunks = [(i, "the the " + " ".join(word() for _ in range(rnd.randint(1, 40)))) for i in range(150)]
    chunks += [(150, None), (151, ""), (152, chunks[0][1]), (153, chunks[0][1]), (154, "the"), (155, "Rare")]
    queries = [(q, "the " + " ".join(word() for _ in range(rnd.randint(1, 12)))) for q in range(30)] + [(90, None), (91, "unheard of"), (92, "rare rare RARE"), (93, chunks[0][1])]
    monkeypatch.setattr(R, "TILE", tile)
    if tile < 100:
        monkeypatch.setattr(R, "SENT_PAIRS", 50)
    c = spark.createDataFrame(chunks, "corpus_pos long, text string").repartition(3)
    got = R.bm25(c, spark.createDataFrame(queries, "query_id long, text string"), 5)
    told = {(r["query_id"], r["corpus_pos"], r["rank"]): r["score"] for r in got.collect()}
    want = {x[:3]: x[3] for x in brute_bm25(chunks, queries, 5)}
    assert told.keys() == want.keys() and all(math.isclose(told[x], want[x], abs_tol=1e-6) for x in want)
    # Only the exchange that gathers each query's best is left: nothing meets by term.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "term" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert R.bm25(c.limit(0), spark.createDataFrame(queries, "query_id long, text string")).count() == 0 == R.bm25(c, spark.createDataFrame([], "query_id long, text string")).count()


def test_semantic_links_of_a_large_report(spark):
    """A report of 800 rows by candidates, a small one by all pairs; copies, null and zero vectors; the least of four runs by bands is 0.98."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 64))
    rows = [(1, i, v) for i, v in enumerate(base)]
    near = [(1, 1200 + i, base[i % 90] + rng.normal(size=64) * rng.uniform(0.2, 0.6)) for i in range(500)]
    rows += near + [(1, 5000, base[0]), (1, 5001, base[0]), (2, 6000, base[0]), (2, 6001, base[0] * 2), (2, 6002, base[1])]
    told = [(g, i, v.tolist()) for g, i, v in rows] + [(2, 6003, None), (2, 6004, [0.0] * 64), (2, 6005, [0.0] * 64)]
    df = spark.createDataFrame(told, "analysis_id long, idx long, embedding array<double>").repartition(3)
    own = [(i, v / np.sqrt(v @ v)) for g, i, v in rows if g == 1]
    ids, m = np.array([i for i, _ in own]), np.array([v for _, v in own])
    a, b = np.nonzero(np.triu(np.round(m @ m.T, 6) >= 0.88, 1))
    want = {(1, *sorted((int(ids[x]), int(ids[y])))) for x, y in zip(a, b, strict=True)} | {(2, 6000, 6001)}
    got = {tuple(r) for r in E.semantic_links(df, "analysis_id", 0.88, compared=300).collect()}
    assert len(want) > 500 and got <= want and len(got) >= 0.98 * len(want) and {(1, 0, 5000), (1, 0, 5001), (1, 5000, 5001), (2, 6000, 6001)} <= got
    assert {tuple(r) for r in E.semantic_links(df, "analysis_id", 0.88, compared=10_000).collect()} == want


def test_templates(spark):
    row = spark.createDataFrame([("a", None)], "x string, y string")
    assert row.select(filled("{x}: {y}{x}!", x=F.col("x"), y=F.col("y"))).first()[0] == "a: a!"
    with pytest.raises(KeyError):
        filled("{z}", x=F.col("x"))


def test_streams(spark, tmp_path):
    """A changed vote counts once, rows later than the watermark don't count."""
    kind = "analysis_id int, requirement_id string, user_id int, vote string, updated_at int, event_id int"
    for k, part in enumerate([[(1, "R1", 7, "up", 1, 1), (1, "R1", 8, "up", 1, 2)], [(1, "R1", 7, "down", 2, 3), (1, "R1", 8, "sideways", 3, 4)]]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/votes")
        out = f"file://{tmp_path}/state_of_votes"
        J.to_batches(J.latest_votes(J.read_stream(spark, f"{tmp_path}/votes", kind)), out, f"file://{tmp_path}/votes_checkpoint", mode="update").awaitTermination()
        totals = J.feedback_totals(J.current(spark, out, J.VOTE_KEY)).first()
        assert (totals["up"], totals["down"]) == [(2, 0), (1, 1)][k]

    jobs = "finished_at timestamp, source int, status string"
    days = [["2024-01-01 10:00:00", "2024-01-02 10:00:00"], ["2024-01-05 10:00:00"], ["2024-01-05 11:00:00", "2024-01-01 11:00:00"]]
    for part in days:
        stamped = [(datetime.datetime.fromisoformat(x), 1, "success") for x in part]
        spark.createDataFrame(stamped, jobs).coalesce(1).write.mode("append").parquet(f"{tmp_path}/jobs")
        out = f"file://{tmp_path}/outcomes"
        J.to_batches(J.outcomes(J.read_stream(spark, f"{tmp_path}/jobs", jobs, 1)), out, f"file://{tmp_path}/jobs_checkpoint", mode="update").awaitTermination()
    counted = {str(r["start"])[:10]: r["success"] for r in J.current(spark, out, ["start", "source"]).collect()}
    assert counted == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-05": 2}


def test_ingested_documents(spark, tmp_path):
    """Three batches: several versions in one, a document that becomes blank, one with fewer chunks; then a batch that runs again."""
    kind = "doc_id long, source string, text string, version int"
    long = "\n".join(f"# Part {i}\nText of part {i}." for i in range(4))
    batches = [[(1, "s", long, 1), (2, "s", "Two.", 1), (3, None, "Three.", 1)], [(1, "s", "Older.", 2), (1, "s", "One now.", 3), (4, "s", "Four.", 1)], [(2, "s", " \n", 2), (4, "s", None, 2), (3, None, "Three again.", 2)]]
    want = [{1: 4, 2: 1, 3: 1}, {1: ["One now."], 2: ["Two."], 3: ["Three."], 4: ["Four."]}, {1: ["One now."], 3: ["Three again."]}]
    schema = "doc_id long, source string, chunk_id string, chunk long, heading string, text string"
    store = Store(spark, f"file://{tmp_path}/chunks", spark.createDataFrame([], schema).schema, ("source", "doc_id"), slots=4)
    for rows, expected in zip(batches, want, strict=True):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/arriving")
        J.ingest(J.read_stream(spark, f"{tmp_path}/arriving", kind), store, f"file://{tmp_path}/state").awaitTermination()
        found = {}
        for r in store.read().orderBy("chunk").collect():
            found.setdefault(r["doc_id"], []).append(r["text"])
        assert found == expected or {k: len(v) for k, v in found.items()} == expected
    before = sorted(map(tuple, store.read().collect()), key=str)
    # A read meets the live slots alone, and a stream that starts anew over all files ends in the same rows.
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__folder" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    store.vacuum()
    assert sorted(map(tuple, store.read().collect()), key=str) == before
    J.ingest(J.read_stream(spark, f"{tmp_path}/arriving", kind), store, f"file://{tmp_path}/other").awaitTermination()
    assert sorted(map(tuple, store.read().collect()), key=str) == before


def test_ingestion_works_chunks_out_once(spark, tmp_path):
    """A model sees each window once a batch, and no step of the chunker is worked out again in an inferred filter."""
    seen = spark.sparkContext.accumulator(0)

    def model(df, column):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.select(*df.columns, F.array(F.length(column).cast("double"), F.lit(1.0)).alias("embedding")).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))

    kind = "doc_id long, source string, text string, version int"
    docs = spark.createDataFrame([(k, "s", " ".join(f"Sentence {i} of number {k} says a little more." for i in range(50)), 1) for k in range(3)], kind)
    docs.write.parquet(f"{tmp_path}/arriving")
    store = Store(spark, f"file://{tmp_path}/chunks", "doc_id long, source string, chunk_id string, chunk long, heading string, chunker_version string, text string", ("source", "doc_id"), slots=2)
    J.ingest(J.read_stream(spark, f"{tmp_path}/arriving", kind), store, f"file://{tmp_path}/state", model).awaitTermination()
    assert seen.value == 150 and store.read().select("doc_id").distinct().count() == 3
    plan = C.chunk_documents(docs, model)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") < 20


def test_stored_collection(spark, tmp_path):
    """Rows move to another unit, null units, empty stores, a writer that is lost before its commit, two writers, what vacuum leaves."""
    kind = "chunk_id string, collection string, source string, text string"
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    stored = lambda s: sorted(map(tuple, s.read().collect()), key=str)
    store = Store(spark, f"file://{tmp_path}/s", rows(("", "", "", "")).schema, slots=3)
    assert stored(store) == [] and store.remove(F.col("source") == "a").count() == 0
    first = [("1", "k", "a", "x"), ("2", "k", "b", "x"), ("3", "k", None, "x"), ("4", None, "a", "x")]
    store.upsert(rows(*first))
    assert stored(store) == sorted(first, key=str)
    before = store.read()
    store.upsert(rows(("2", "k", "a/ü", "moved"), ("2", "k", "a/ü", "moved"), ("5", "k", None, "new")))
    now = [("1", "k", "a", "x"), ("2", "k", "a/ü", "moved"), ("3", "k", None, "x"), ("4", None, "a", "x"), ("5", "k", None, "new")]
    assert stored(store) == sorted(now, key=str) and sorted(map(tuple, before.collect()), key=str) == sorted(first, key=str)
    assert sorted(map(tuple, store.remove(F.col("source") == "a").collect()), key=str) == sorted([("k", "a", 1), (None, "a", 1)], key=str)
    assert {r[0] for r in stored(store)} == {"2", "3", "5"}
    store.replace(rows(("", "k", None, "")), rows(("6", "k", None, "y")))
    assert {r[0] for r in stored(store)} == {"2", "6"}

    # Written but not committed: readers see the old rows, and the next writer starts over.
    versions, state = store.versions(), stored(store)
    commit = store._file_system
    def lost(path):
        if "/commits/" in path:
            raise OSError("lost")
        return commit(path)
    store._file_system = lost
    with pytest.raises(OSError, match="lost"):
        store.upsert(rows(("9", "k", "z", "lost")))
    store._file_system = commit
    assert stored(store) == state and store.versions() == versions
    store.upsert(rows(("9", "k", "z", "there")))
    assert ("9", "k", "z", "there") in stored(store) and len(stored(store)) == len(state) + 1

    # Two writers from the same state: the second one is told, and has changed nothing.
    other, stale = Store(spark, store.path, store.schema, slots=3), store.versions()
    store.upsert(rows(("10", "k", "z", "first")))
    other.versions = lambda: stale
    with pytest.raises(Conflict):
        other.upsert(rows(("10", "k", "z", "second")))
    assert ("10", "k", "z", "first") in stored(store)
    state = stored(store)
    store.vacuum()
    assert stored(store) == state
    store.remove(F.lit(True))
    assert stored(store) == []


def test_record_bodies(spark):
    """Lists inside lists, empty elements, entities, records that aren't well-formed, and a time that grows with the text alone."""
    xml = "<?xml version='1.0' encoding='ISO-8859-1'?><Publication ID='F7'><dc:title>One</dc:title><Liste type='a'><Item>outer one</Item><Liste><Item>inner &lt;two&gt;</Item></Liste><Item>outer threé</Item></Liste><Titre/><Texte>abc</Texte><dc:title>Two</dc:title></Publication>"
    assert P.read_record(xml)["texts"] == ["outer one inner <two> outer threé", "inner <two>", "", "abc"] and P.read_record(xml)["title"] == "One"
    files = spark.createDataFrame([("F1.xml", xml), ("F2.xml", "<Publication><Texte>cut off"), ("F3.xml", "<Publication><dc:description>About</dc:description><Texte>a &nbsp; b</Texte></Publication>"), ("F4.xml", "<Publication><dc:description>About</dc:description></Publication>"), ("F5.xml", None), ("F6.xml", "<other/>")], "name string, xml string")
    got = {r["source_id"]: (r["title"], r["text"]) for r in P.parse_records(files).collect()}
    assert got == {"F7": ("One", "outer one inner <two> outer threé\n\ninner <two>"), "F4": ("F4", "About")}
    assert sorted(r["name"] for r in P.record_errors(files).collect()) == ["F2.xml", "F3.xml"]
    took = {}
    for n in (4_000, 16_000):
        text = "<Publication>" + "<Paragraphe>some text of it</Paragraphe>" * n + "</Publication>"
        began = time.perf_counter()
        assert len(P.read_record(text)["texts"]) == n
        took[n] = time.perf_counter() - began
    assert took[16_000] < 2 and took[16_000] < 12 * took[4_000] + 0.1


def test_long_texts_split_in_time_with_their_length(spark):
    words = " ".join(f"wörd{i % 97}" for i in range(160_000))
    took = {}
    for mb in (1, 4):
        df = spark.createDataFrame([(words * mb,)], "text string")
        began = time.perf_counter()
        pieces = df.select(C.long_splits(F.col("text"))).first()[0]
        took[mb] = time.perf_counter() - began
        assert len(pieces) > 35 * mb and all(len(p) <= 30_000 for p in pieces) and pieces[-1].endswith(words[-20:])
    assert took[4] < 8 * took[1] + 2


def test_progress_and_times(spark):
    logs = [("none", None), (None, None), ("page 3/4\nCumul  5 /\t9 then cumul 7/9", (5, 9)), ("1/2 and 2/2", (1, 2)), ("cumul 4/0", None), ("cumul x/y 8/9", (8, 9)), ("9" * 30 + "/3", (None, 3))]
    got = spark.createDataFrame([(x,) for x, _ in logs], "log string").select(D.progress(F.col("log"))).collect()
    assert [None if r[0] is None else tuple(r[0]) for r in got] == [x for _, x in logs]
    jobs = spark.createDataFrame([(1, "running", "disk full", None), (2, "running", None, None), (3, "error", "bad host", "2024-01-01"), (4, None, None, None)], "id int, status string, error string, finished_at string")
    assert sorted(tuple(r) for r in W.repair_interrupted(jobs, F.lit("now")).where("id < 4").collect()) == [(1, "error", "disk full", "now"), (2, "error", "interrupted", "now"), (3, "error", "bad host", "2024-01-01")]
    assert W.repair_interrupted(jobs, F.lit("now")).where("id = 4").first()["status"] is None
    rows = spark.createDataFrame([("a",), (None,), ("a",)], "status string")
    assert {tuple(r) for r in D.status_facets(rows).collect()} == {("a", 2), (None, 1), ("all", 3)}


def test_corrections_by_time(spark):
    kind = "analysis_id long, requirement_id string, user_id long, category string, subdomain string, title string, verdict string, answer string, notes string, updated_at int"
    rows = [(9, "R1", 1, "c", "s", "t", "covered", "\n first ", " ", 1), (9, " R1", 1, "c", "s", "t", "missing", "second", " why\t", 5), (2, "R4", 1, "c", "s", "t", "partial", "newest", None, 7), (3, "R1", 1, "c", "s", "t", "perhaps", "x", None, 9), (3, " ", 1, "c", "s", "t", "covered", "x", None, 9), (3, "R1", 1, "c", "s", "t", "covered", "\n\t", None, 9)]
    state = W.upsert_corrections(spark.createDataFrame(rows, kind))
    assert sorted((r["analysis_id"], r["verdict"], r["answer"], r["notes"], r["created_at"], r["updated_at"]) for r in state.collect()) == [(2, "partial", "newest", None, 7, 7), (9, "missing", "second", "why", 1, 5)]
    assert [r["analysis_id"] for r in W.latest_corrections(state).collect()] == [2]


def test_cache_keys(spark):
    row = spark.createDataFrame([("u", "f", b"\x00text")], "user string, finger string, content binary")
    key = lambda version="v", model="m", user="u", finger="f", content=b"\x00text": hashlib.sha256(f"{version}|{model}|{user}|{finger}|".encode() + content).hexdigest()
    of = lambda v="v", m="m": row.select(E.cache_key(v, m, F.col("user"), F.col("finger"), F.col("content"))).first()[0]
    assert of() == key() and of("v2") == key("v2") and of(m="n") == key(model="n") and len({of(), of("v2"), of(m="n")}) == 3


def test_guard_strips(spark):
    chunks = spark.createDataFrame([("a", "\n" * 60 + "x"), ("a", None), ("a", " " * 9 + "y" * 60 + "\t"), ("b", "z" * 13_000)], "source string, chunk string")
    assert sorted((r["source"], len(r["chunk"]), r["cut"]) for r in P.length_guard(chunks).collect()) == [("a", 60, False), ("b", 12_000, True)]
    assert sorted(map(tuple, P.guard_counts(chunks).collect())) == [("a", 1, 2, 0), ("b", 1, 0, 1)]


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    def load():
        with open(f"{tmp_path}/loads", "a") as log:
            log.write(f"{os.getpid()}\n")
        def model(rows):
            assert 0 < len(rows) <= 7
            return rows["text"].str.len().fillna(0).map(lambda n: [float(n), 1.0])
        return model
    df = spark.createDataFrame([(i, "x" * i if i % 5 else None) for i in range(200)], "id long, t string").repartition(8)
    embed_ = embedding_model(str(tmp_path), load, batch=7)
    for _ in range(2):
        got = {r["id"]: r["embedding"] for r in embed_(df, "t").collect()}
        assert got == {i: [float(i if i % 5 else 0), 1.0] for i in range(200)}
    pids = (tmp_path / "loads").read_text().split()
    assert len(pids) == len(set(pids))  # 16 tasks, but no worker loads twice
    chunks = C.chunk_documents(spark.createDataFrame([(1, "s", "One sentence here. " * 200)], "doc_id long, source string, text string"), embed_)
    assert chunks.count() > 1


def test_fingerprints_add_up(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "collection string, chunk_id string, text string")
    a, b, c = ("k", "1", "x"), ("k", "2", None), ("p", "3", "y")
    state = lambda *r: E.fingerprint_state(rows(*r), "collection")
    whole = E.merged_fingerprints(state(a, c), state(b), state(c), "collection")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, state(b, a).collect()))
    twice = E.fingerprints(state(a, a), "collection").first()["fingerprint"]
    assert twice != E.fingerprints(state(a), "collection").first()["fingerprint"] and len(twice) == 32


def test_titles_without_accents(spark):
    titles = ["Évaluation  des ŒUVRES", "Šárka ő ﬁn", "ﬄ Ǆ №5 ½", "e\u0301te\u0301", "１２ＡＢ", "ñ—ß", "", None]
    def told(t):
        flat = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c)).lower()
        return re.sub("[^a-z0-9]+", " ", flat).strip()
    got = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").select("i", E.title_key(F.col("t")).alias("k")).collect()
    assert {r["i"]: r["k"] for r in got} == {i: told(t) for i, t in enumerate(titles)}


def test_containers_and_boxes(spark):
    page = '<body><div class="big ad">no</div><main id="one"><p>first</p></main><main id=two><div class="ad x"><p>bought</p></div><p>second</p></main></body>'
    row = spark.createDataFrame([(page,)], "html string")
    part = lambda *c: row.select(P.main_part(F.col("html"), c)).first()[0]
    assert part("main#two", "body") == '<div class="ad x"><p>bought</p></div><p>second</p>' and part("main#three", "article") == page
    assert row.select(P.clean_text(P.main_part(F.col("html"), ("main#two",)), (("div", "ad"),))).first()[0] == "second"
    assert row.select(P.clean_text(P.main_part(F.col("html"), ("main#two",)))).first()[0] == "bought\nsecond"


def test_components(spark):
    rnd = random.Random(5)
    links = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(7, None), (9, 9)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in (a, b) for a, b in links if a != b and b is not None)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("R1", 'a;"b"\nc'), ("R2", None)], "id string, note string")
    S.write_feedback_csv(rows, str(tmp_path / "f"))
    header = b"".join(p.read_bytes() for p in (tmp_path / "f" / "header").glob("part*"))
    body = b"".join(p.read_bytes() for p in sorted((tmp_path / "f" / "rows").glob("part*")))
    assert header == b"\xef\xbb\xbfid;note\r\n"
    assert body.count(b"\r\n") == 2 and b'R1;"a;""b""\nc"\r\n' in body and b"R2;\r\n" in body
    S.write_evaluation_csv(spark.createDataFrame([("q", "t"), ("only", None)], "question string, ground_truth string"), str(tmp_path / "e"))
    assert S.read_questions(spark, str(tmp_path / "e")).count() == 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("x\ny")
    assert S.read_texts(spark, str(tmp_path / "d")).first()["text"] == "x\ny"
    (tmp_path / "x").mkdir()
    for name in ("F1.xml", "X1.xml", "N2.txt"):
        (tmp_path / "x" / name).write_text('<Publication ID="F1"><dc:title>t</dc:title><Texte>some text</Texte></Publication>')
    record = P.parse_records(S.read_records(spark, str(tmp_path / "x"))).collect()
    assert [(r["source_id"], r["title"], r["text"]) for r in record] == [("F1", "t", "some text")]


def test_scratch_tables_go(spark):
    from lectern.functions.storage import materialize, scratch

    kept = materialize(spark.range(3), "kept")
    with scratch(spark):
        gone = materialize(spark.range(5), "gone")
        files = gone.inputFiles()
        assert gone.count() == 5 and files
    assert kept.count() == 3 and not any(pathlib.Path(f.removeprefix("file:").replace("///", "/")).exists() for f in files)


def test_embedding(spark):
    from lectern.functions.embedding import embed

    rows = spark.createDataFrame([(1, "a b b"), (2, "B a b"), (3, "c"), (4, None)], "id int, text string")
    v = {r["id"]: r["embedding"] for r in embed(rows, "text").collect()}
    assert v[1] == v[2] != v[3] and abs(sum(x * x for x in v[1]) - 1) < 1e-6 and not any(v[4])
    assert embed(rows, "text", lambda df, c: df.withColumn("embedding", F.lit(0))).first()["embedding"] == 0


def test_visible_chunks_and_their_counts(spark):
    """Counts by collection tell what the filter of each tenant shows; no other tenant's rows, none without a collection."""
    chunks = spark.createDataFrame([(i, c) for i, c in enumerate(["a", "b", "knowledge_base", "a", "knowledge_base", None, "c"])], "chunk_id long, collection string")
    users = spark.createDataFrame([(1, "a"), (2, "none"), (3, "knowledge_base"), (4, None), (1, "a"), (5, "a")], "user long, collection string")
    counts = {r["user"]: (r["own"], r["shared"]) for r in R.visible_counts(users, chunks).collect()}
    assert counts == {1: (2, 2), 2: (0, 2), 3: (0, 2), 4: (0, 2), 5: (2, 2)}
    for user, own in ((1, "a"), (2, "none"), (3, "knowledge_base")):
        assert R.visible_chunks(chunks, own).count() == sum(counts[user])
    assert {r["chunk_id"] for r in R.visible_chunks(chunks, "a").collect()} == {0, 2, 3, 4}
    assert R.visible_counts(users, chunks.limit(0)).count() == 0
