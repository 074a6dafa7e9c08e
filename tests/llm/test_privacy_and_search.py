import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from coffer.llm import neighbours, privacy, stages
from coffer.llm.oracle import ORACLE
from helpers import documents, odd_rows, prose

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c a.b@c-d.e.f x@y a@b..c @b.c a@b.c@d.e foo@bar.com_x@y.z +a@b.co a@b.c_d@e.f", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0004 1.2.3 .1.2.3.4. 99999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 2024-01-02 1  2 0000 0000 0000", "+1 (555) 123-4567 +49.30.1234567 +1 2 +123456789012345678 ++44 20 7946 0958 x+1-5",
    "é 日本 a@b.cd 😀 10.0.0.1 +33 1 23 45 67 89 5500 0000 0000 0004", "a@b.c" * 300, "1 " * 700, "12.34.56.78," * 300, "." * 5000 + "@" + "x." * 3000, "9" * 20000, "a" * 30000 + "@", "+1" + " " * 9000,
]


def spans_of(spark, rows):
    found = documents(spark, rows).select(privacy.found_spans(F.col("text")).alias("found"))
    return [[(s.start, s["rank"], s.kind, s.end) for s in r.found] for r in found.collect()]


def test_base_spans(spark):
    rows = [*enumerate(TRICKY), *odd_rows()]
    assert spans_of(spark, rows) == [brute_spans(t) for _, t in rows]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("a@.1+ -(5é", max_size=40), min_size=1, max_size=20))
def test_base_spans_of_random_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = df.select("doc_id", privacy.found_spans(F.col("text")).alias("found")).orderBy("doc_id").collect()
    got = [[(s.start, s["rank"], s.kind, s.end) for s in r.found] for r in found]
    assert got == [brute_spans(t) for t in texts]


def owner(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": value.rpartition("@")[2], "ip": ".".join(value.split(".")[:3]), "card": digits[:6], "phone": digits[:4]}[kind]


def brute_terms(texts, disclosure=0.8, value_support=2, owner_support=3):
    """(text number, start, end) of disclosing terms, from the definition."""
    word = re.compile(r"[^\W\d_]{3,}")
    texts = [t or "" for t in texts]
    terms, entities = [], []
    for t in texts:
        spans = brute_spans(t)
        entities.append({e for a, _, k, b in spans for v in [t[a:b].lower()] for e in ((k, "value", v), (k, "owner", owner(k, v)))})
        terms.append([(m.group().lower(), m.start(), m.end()) for m in word.finditer(t) if not any(x < m.end() and m.start() < y for x, _, _, y in spans)])
    held = [set(word.findall(t.lower())) for t in texts]
    n, out = len(texts), set()
    for e in set().union(*entities):
        own = [i for i in range(n) if e in entities[i]]
        least = value_support if e[1] == "value" else owner_support
        if len({texts[i] for i in own}) < least or len(own) == n:
            continue
        for w in {w for i in own for w, _, _ in terms[i]}:
            both = [i for i in own if any(w == x for x, _, _ in terms[i])]
            chance = (len(both) + len(own) / n) / (sum(w in h for h in held) + 1)
            if len({texts[i] for i in both}) >= least and math.log2(chance * n / len(own)) / math.log2(n / len(own)) >= disclosure:
                out |= {(i, a, b) for i in own for x, a, b in terms[i] if x == w}
    return out


def test_disclosing_terms_and_masking(spark):
    rng = random.Random(9)
    texts = [prose(rng, 60) for _ in range(40)]
    for i in range(4):
        texts.append(f"{prose(rng, 20)} Zorblatt Quimby wrote zq@hush.org today {prose(rng, 20)}")
    texts += [texts[-1], "call +1 (555) 123-4567 now"]
    docs = documents(spark, list(enumerate(texts)))
    found = privacy.sanitise(docs)
    got = {(r.doc_id, t.start, t.end) for r in found.docs.collect() for t in r[found.terms]}
    assert got == brute_terms(texts)
    assert {texts[i][a:b] for i, a, b in got} >= {"Zorblatt", "Quimby"}
    out = {r.doc_id: r.text for r in stages.personal_data_stage(spark, docs, "").collect()}
    assert all(out[i] == texts[i] for i in range(40))
    assert "zq@hush.org" not in out[40] and "Zorblatt" not in out[40] and "[EMAIL]" in out[40] and out[45] == "call [PHONE] now"


def test_disclosing_terms_far_from_the_entity(spark):
    rng = random.Random(4)
    texts = [prose(rng, 60) for _ in range(40)]
    for i in range(4):
        texts.append(f"Zorblatt {prose(rng, 60)} zq@hush.org today {prose(rng, 60)} Quimby {i} ZORBLATT zorblatt@else{i}.org")
    texts += ["Wexford " + prose(rng, 60) + " 10.1.2.3", prose(rng, 30) + " 10.1.2.3 " + prose(rng, 50) + " wexford", "Zorblatt alone"]
    docs = documents(spark, list(enumerate(texts)))
    for found in (privacy.sanitise(docs), privacy.sanitise(docs, keep_text=False)):
        got = {(r.doc_id, t.start, t.end) for r in found.docs.collect() for t in r[found.terms]}
        assert got == brute_terms(texts)
    assert {texts[i][a:b] for i, a, b in got} >= {"Zorblatt", "ZORBLATT", "Quimby", "Wexford", "wexford"}
    out = {r.doc_id: r.text for r in stages.personal_data_stage(spark, docs, "").collect()}
    assert all("quimby" not in out[i].lower() and "zorblatt" not in out[i].lower() for i in range(40, 44))
    assert "wexford" not in (out[44] + out[45]).lower() and out[46] == "Zorblatt alone"


@pytest.mark.parametrize("most", [10**6, 0])
def test_terms_that_tell_the_owner(spark, monkeypatch, most):
    """Every address occurs once, but all of one company stand beside its name."""
    monkeypatch.setattr(privacy, "BROADCAST_TERMS", most)
    rng = random.Random(14)
    texts = [prose(rng, 40) for _ in range(60)] + [f"{prose(rng, 10)} staff of Zorblatt {i} w{i}@mail.zorb.org {prose(rng, 10)}" for i in range(5)]
    texts += [f"visit +49 30 12345{i} in Berlinchen or 10.9.8.{i} {prose(rng, 10)}" for i in range(3)] + [f"lone x{i}@twice.org Pairterm" for i in range(2)]
    found = privacy.sanitise(documents(spark, list(enumerate(texts))))
    got = {(r.doc_id, t.start, t.end) for r in found.docs.collect() for t in r[found.terms]}
    assert got == brute_terms(texts)
    assert {texts[i][a:b] for i, a, b in got} >= {"Zorblatt", "Berlinchen"} and "Pairterm" not in {texts[i][a:b] for i, a, b in got}


def test_masking_of_long_texts(spark):
    rng = random.Random(3)
    parts = [prose(rng, rng.randint(0, 900)) + rng.choice(["", "é", "😀"]) for _ in range(30)]
    text = " ".join(f"{p} a{i}@b.org" for i, p in enumerate(parts))
    out = [r.text for r in privacy.hide(documents(spark, [(1, text), (2, None), (3, "x" * 9000), (4, "a@b.org" + "y" * 8192)])).orderBy("doc_id").collect()]
    assert out == [re.sub(r"a[0-9]+@b\.org", "[EMAIL]", text), None, "x" * 9000, "[EMAIL]"]


def test_sql_of_personal_data(spark, tmp_path):
    rng = random.Random(21)
    texts = [prose(rng, 30) for _ in range(50)] + [f"{prose(rng, 9)} Zorblatt z{i % 4}@hush.org {prose(rng, 9)} QUIMBY" for i in range(6)] + TRICKY + [None, "", "+1 (555) 123-4567"]
    docs = documents(spark, [(i % 70, t) for i, t in enumerate(texts)]).select("doc_id", "text")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = privacy.op7(spark, str(tmp_path))
    wanted = con.sql(ORACLE["op7_personal_data"])
    assert Counter(map(tuple, got.select(*wanted.columns).collect())) == Counter(wanted.fetchall())
    assert sum("term" in r.spans for r in got.collect()) >= 6


def test_privacy_of_odd_rows(spark):
    docs = documents(spark, odd_rows())
    out = stages.personal_data_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, docs.select("doc_id", "text").collect()))
    assert stages.personal_data_stage(spark, documents(spark, []), "").count() == 0


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("leaf", "block", "rank", "score", "query_id", "n"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def brute_neighbours(rows, every, k):
    """{query id: [(distance, id)]} by comparing every query with every row."""
    out = {}
    for q, v in {(q, tuple(v)): (q, v) for q, v in rows}.values():
        if q % every == 0:
            far = [(float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in rows if i != q]
            out[q] = sorted(out.get(q, []) + far)[:k]
    return out


def answers(frame):
    by = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return by


@pytest.mark.parametrize(("shard_bytes", "near_bytes"), [(1 << 20, 1 << 20), (16 * 8 * 50, 4000)])
def test_neighbours_against_brute_force(spark, monkeypatch, shard_bytes, near_bytes):
    monkeypatch.setattr(neighbours, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(neighbours, "NEAR_BYTES", near_bytes)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:900] = x[500]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, x[7].tolist())] * 2  # a repeated row is three candidates
    good = [(i, np.array(v, float)) for i, v in rows]
    rows += [(100000, None), (100001, [0.0] * 16), (100002, [float("nan")] * 16), (None, x[0].tolist())]
    got, wanted = answers(neighbours.search(vectors(spark, rows))), brute_neighbours(good, 100, 10)
    assert set(got) == set(range(0, 3000, 100))
    hit = 0
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10
        assert all(s == float(np.sqrt(((x[v].astype(float) - x[q].astype(float)) ** 2).sum())) for s, v in found)
        hit += len({v for _, v in wanted[q]} & {v for _, v in found})
    assert hit >= 0.93 * 10 * len(got)
    assert got[500] == wanted[500] and got[700] == wanted[700]


def test_repeated_rows_lengths_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 1.0]), (4, [1.0]), (100, [2.0]), (200, [1.0, 0.0]), (200, [1.0, 0.0])]
    got = answers(neighbours.search(vectors(spark, rows), k=4))
    assert got == brute_neighbours([(i, np.array(v)) for i, v in rows if len(v) == 2], 100, 4) | {100: [(1.0, 4)]}
    assert [i for _, i in got[0]] == [1, 1, 200, 200]


def test_recall_on_the_tables(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got, wanted = answers(neighbours.op8(spark, "/root/testdata/sf0.1")), brute_neighbours(rows, 100, 10)
    assert set(got) == set(wanted)
    assert sum(len({v for _, v in wanted[q]} & {v for _, v in got[q]}) for q in got) >= 0.95 * 10 * len(got)


def test_the_meeting_gives_one_row_for_a_query_and_shard():
    rng = np.random.default_rng(4)
    tree = neighbours.fit_tree(rng.normal(size=(4000, 8)))
    held = dict(enumerate(np.bincount(tree.assign(rng.normal(size=(4000, 8))), minlength=tree.leaves).tolist()))
    held[3] = 5000
    shards = neighbours.shards_of(held, 1000)
    filled = {}
    for leaf, (first, count) in shards.items():
        for shard in range(first, first + count):
            filled[shard] = filled.get(shard, 0) + held[leaf] / count
    assert sorted(filled) == list(range(max(filled) + 1)) and max(filled.values()) <= 1000 and shards[3][1] == 5


def test_few_or_no_vectors(spark):
    few = neighbours.search(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, None)])).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 1)]
    assert neighbours.search(vectors(spark, [])).count() == 0
    assert neighbours.search(vectors(spark, [(0, [0.0, 0.0])])).count() == 0


def test_pipeline_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stages.table(spark, sf, "documents") if name == "quality" else docs
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == n
