import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coffer.llm import common, labelled as samples, language, quality, toxicity
from helpers import documents, odd_rows, prose

SF = "/root/testdata/sf0.01"


def held(spark, modulus, remainder):
    df = spark.createDataFrame([(i,) for i in [*range(200), None]], "doc_id long")
    got = {r.doc_id: r.held for r in df.select("doc_id", (common.fold(F.col("doc_id"), modulus) == remainder).alias("held")).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % modulus == remainder) for i in range(200))
    return got[None]


def test_folds(spark):
    assert held(spark, 5, 0) is True and held(spark, 3, 1) is False


def labelled(spark, n=160, seed=2):
    """Prose, half of it junk (quality 0) or insulting (toxic 1)."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, kind = prose(rng, 80), i % 4
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 1:
            words = text.split()
            for _ in range(6):
                words.insert(rng.randrange(10, 40), rng.choice(["vilebrute", "nastyfool", "vilebrutish"]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(kind != 0), int(kind == 1)))
    return rows, labels


def frames(spark, rows, labels):
    extra = [(None, 1, 1), (labels[0][0] if labels else 0, None, None)]
    table = spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    return documents(spark, rows), table


def test_quality_votes(spark):
    rows, labels = labelled(spark)
    docs, table = frames(spark, rows + [(1000 + i, t) for i, t in odd_rows() if i is not None] + [(None, None)], labels)
    space = quality.train(docs, table)
    got = {r.doc_id: r["votes"] for r in quality.score(docs, space, into="votes").collect()}
    assert all(0 <= s <= 1 for s in got.values())
    truth = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all((got[i] >= 0.3) == bool(q) for i, q in truth.items())
    assert got[1103] == got[1104] == got[None]
    assert got[1003] == got[1100] == got[1101]


def test_votes_are_exact(spark):
    rng = np.random.default_rng(1)
    vectors, labels = quality._unit(rng.normal(size=(300, 8)).astype(np.float32)), rng.integers(0, 2, 300).astype(np.float32)
    space = quality.Space(np.eye(8, dtype=np.float32), np.ones(8), vectors, labels, 0.5)
    asked = quality._unit(rng.normal(size=(50, 8)).astype(np.float32))
    got = quality.votes(asked, space, block=7)
    for q, g in zip(asked, got, strict=True):
        c = (vectors @ q).astype(float)
        near = np.argsort(-c)[: quality.NEIGHBOURS]
        w = np.maximum(c[near], 1e-6) ** 4
        assert abs(g - (w * labels[near]).sum() / w.sum()) < 1e-4


def written(spark, folder, rows, labels):
    docs, table = frames(spark, rows, labels)
    docs.write.parquet(f"{folder}/documents.parquet")
    table.write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_quality_query_against_brute_force(spark, tmp_path):
    """Every row of the query: one text at a time, all cosines sorted, all that tie with the last neighbour voting."""
    rows, labels = labelled(spark)
    rows += [(1000 + i, t) for i, t in odd_rows() if i is not None]
    docs, table = written(spark, tmp_path, rows, labels)
    space = quality.train(docs, table)

    def brute(text):
        counts = quality.term_counts([text or ""])
        if not counts.any():
            return space.blank
        v = (quality._weighted(counts, quality.shape_terms([text]), space.idf) @ space.axes)[0].astype(float)
        cosines = sorted(((float(v @ u) / max(np.linalg.norm(v), 1e-9), y) for u, y in zip(space.vectors.astype(float), space.labels, strict=True)), reverse=True)
        last = cosines[min(quality.NEIGHBOURS, len(cosines)) - 1][0]
        near = [(max(c, 1e-6) ** 4, y) for c, y in cosines if c >= last - quality.TIE]
        return sum(w * y for w, y in near) / sum(w for w, _ in near)

    got = sorted(map(tuple, quality.op4(spark, str(tmp_path)).collect()))
    assert [r[0] for r in got] == sorted(i for i, _ in rows)
    scores = {}
    for i, t in rows:
        scores.setdefault(i, brute(t))
    for doc, held_out, score, predicted in got:
        assert held_out == (zlib.crc32(str(doc).encode()) % 5 == 0) and predicted == int(score >= 0.3)
        assert abs(score - scores[doc]) < 1e-4


def test_toxic_query_against_brute_force(spark, tmp_path):
    """Every row of the query: tokens looked up one by one, segments by their recursive definition."""
    rows, labels = labelled(spark)
    rows += [(1000 + i, t) for i, t in odd_rows() if i is not None and len(t or "") < 1500] + [(2000, "word vilebrute vilebrute nastyfool, Nastyfools!"), (2001, "vilebrute " * 30)]
    docs, table = written(spark, tmp_path, rows, labels)
    model = toxicity.train(docs, table)
    worth = dict(zip(model.words.tolist(), model.scores.tolist(), strict=True))
    assert worth

    def brute(text):
        words = re.findall(rb"[0-9a-zA-Z\x80-\xff]+", common.lowered(text or "").encode())
        scores = []
        for before, word in zip([None, *words], words):
            found = max(worth.get(int(h), 0) for _, hashes in toxicity.tokens([word.decode()])[4] for h in hashes)
            scores.append(found if found and word != before else -model.drift)
        segments = brute_segments(scores)
        statistic = toxicity.text_statistic(np.array([s for *_, s in segments]), len(words), model.lam, model.k)
        return 1 / (1 + np.exp(-(model.slope * np.log1p(statistic) + model.intercept))) if statistic > 0 else model.none

    got = toxicity.op10(spark, str(tmp_path)).select("doc_id", "held_out", "score", "predicted").collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    scores = {i: brute(t) for i, t in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
        assert abs(r.score - scores[r.doc_id]) < 1e-6
    assert 20 < sum(r.predicted for r in got) < 60


def brute_segments(scores):
    """All maximal scoring segments by the recursive definition."""

    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (top is None or total > top[0] + 1e-12 or (abs(total - top[0]) <= 1e-12 and j + 1 - i < top[2] - top[1])):
                    top = (total, i, j + 1)
        if top is None:
            return []
        return best(a, top[1]) + [(top[1], top[2], top[0])] + best(top[2], b)

    return best(0, len(scores))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([-1, -1, -1, 1.7, 2.3, 5.1]), max_size=24))
def test_maximal_segments(scores):
    places = [i for i, s in enumerate(scores) if s > 0]
    got = toxicity.maximal_segments(places, [scores[i] for i in places], 1.0)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]
    assert np.allclose([s for _, _, s in got], [s for _, _, s in brute_segments(scores)])


def test_toxic_passages(spark):
    rows, labels = labelled(spark)
    docs, table = frames(spark, rows + [(1000 + i, t) for i, t in odd_rows() if i is not None] + [(None, None)], labels)
    model = toxicity.train(docs, table)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    texts = dict(rows)
    for i, _, toxic in labels:
        assert (got[i].score >= 0.7) == bool(toxic)
        if toxic:
            joined = " ".join(texts[i][p.start : p.end] for p in got[i].passages)
            assert "vilebrut" in joined or "nastyfool" in joined
    assert all(got[1000 + i].score < 0.7 for i, _ in odd_rows() if i is not None)
    assert got[1103].score == got[1104].score == got[None].score and got[1103].passages == []
    # the score of clean texts does not depend on their length
    rng = random.Random(1)
    clean = [(i, t) for i, t in enumerate(["", None, "river", prose(rng, 20), prose(rng, 240), prose(rng, 5000)])]
    scores = [r.score for r in toxicity.score(documents(spark, clean), model).collect()]
    assert set(scores) == {min(r.score for r in got.values())}
    # a passage in a text that grows when it is lower-cased, and two passages against one
    insult = "vilebrute nastyfool vilebrutish vilebrute nastyfool"
    text = "İİİ " + prose(rng, 30) + " " + insult + " " + prose(rng, 400)
    found = {r.doc_id: r for r in toxicity.score(documents(spark, [(1, text), (2, text + " " + insult)]), model).collect()}
    assert any(insult in text[p.start : p.end] for p in found[1].passages) and len(found[2].passages) == 2
    assert found[2].score >= found[1].score >= 0.7


def test_statistics_of_segments():
    lam, k = 0.7, 0.02
    assert toxicity.text_statistic(np.array([]), 500, lam, k) == 0
    for score, n in ((5.0, 100), (9.0, 1000), (1.0, 10000)):
        expected = k * n * np.exp(-lam * score)
        assert np.isclose(toxicity.text_statistic(np.array([score]), n, lam, k), -np.log(-np.expm1(-expected)))
    one, two = (toxicity.text_statistic(np.array(s), 300, lam, k) for s in ([9.0, 0.5], [9.0, 9.0]))
    normal = lam * 9.0 - np.log(k * 300)
    assert one < two and np.isclose(two, 2 * normal - np.log(2 * normal) + np.log(2) - 2 * np.log(2))
    # K comes back from draws of its own distribution
    rng = np.random.default_rng(6)
    n_words = rng.integers(20, 2000, 20000)
    best = np.maximum(np.log(k * n_words / rng.exponential(size=20000)) / lam, 0)
    assert abs(toxicity._background_k(best, n_words, lam) / k - 1) < 0.05


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_no_labels(spark, module, column):
    rows, _ = labelled(spark, 8)
    docs, table = frames(spark, rows, [])
    model = module.train(docs, table.where("doc_id is null"))
    got = module.score(docs.select("doc_id", "text"), model)
    wanted = 0.5 if module is quality else 0.0
    assert all(abs(r.score - wanted) < 1e-9 for r in got.collect())
    assert module.score(documents(spark, []).select("doc_id", "text"), model).count() == 0


def test_language_by_held_out_accuracy(spark):
    docs = common.table(spark, SF, "documents")
    net = language.train(docs)
    got = language.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where(common.fold(F.col("doc_id"), 3) == 1).collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    odd = {r.doc_id: r for r in language.predict(documents(spark, odd_rows()), net).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (103, 104, 105))
    marks = {r.doc_id: r.lang_pred for r in language.predict(documents(spark, [(1, "½ ² ① 12"), (2, "١٢ _ 5"), (3, "½ é"), (4, "5 日")]), net).collect()}
    assert marks[1] == marks[2] == "und" and marks[3] in net.languages and marks[4] in net.languages
    assert odd[107].lang_pred in net.languages and all(0 <= r.score <= 1 for r in odd.values())
    assert language.predict(documents(spark, []), net).count() == 0


def test_every_language_is_learnt(spark):
    """A language for each of 230 alphabets of five letters; one row of each is enough to be known."""
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 5 * 230)]
    rows = [(k, " ".join("".join(rng.choice(letters[5 * k : 5 * k + 5]) for _ in range(4)) for _ in range(60)), f"l{k}", "s") for k in range(230)]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1][:230]
    net = language.train(documents(spark, [(i, *r[1:]) for i, r in zip(ids, rows, strict=True)]))
    assert len(net.languages) == 230


def test_pieces_come_from_all_places_of_a_text(spark, monkeypatch):
    """The one stretch of a language that tells lies far inside a long text."""
    seen = []
    monkeypatch.setattr(language, "fit", lambda x, y, languages, seed: seen.append((x, y, languages)))
    text = "aaaa " * 60000 + "zzzz " * 60000
    language.train(documents(spark, [(0, text, "a", "s"), (2, "b " * 9000, "b", "s")]))
    x, y, languages = seen[0]
    own = x[y == languages.index("a")]
    assert abs((own == language._CLASS[ord("z")]).any(axis=1).mean() - 0.5) < 0.1
    assert len(own) <= 2 * language.MOST_EACH + 2


def test_language_without_training(spark):
    assert language.train(documents(spark, [(0, "text", None, "s"), (3, None, "en", "s")])) is None
    assert {r.lang_pred for r in language.predict(documents(spark, [(0, "text")]), None).collect()} == {"und"}


def test_network_gathers_equal_a_plain_convolution():
    rng = np.random.default_rng(0)
    tables = {w: rng.normal(size=(w, language.CLASSES, 3)).astype(np.float32) for w in (2, 3, 4)}
    net = language.Network(["a", "b"], tables, rng.normal(size=9).astype(np.float32), rng.normal(size=(9, 2)).astype(np.float32), np.zeros(2, np.float32))
    x = rng.integers(0, language.CLASSES, (5, 40)).astype(np.uint8)
    pooled = [[max(sum(t[j][row[i + j]][f] for j in range(w)) for i in range(40 - w + 1)) for w, t in tables.items() for f in range(3)] for row in x]
    z = np.maximum(np.array(pooled) + net.bias, 0) @ net.dense
    e = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(language.probabilities(net, x), e / e.sum(axis=1, keepdims=True), atol=1e-4)


@pytest.mark.parametrize("module, column, fold, out", [(quality, "quality", (5, 0), 0.97), (toxicity, "toxic", (3, 1), 0.85)])
def test_held_out_rows_of_the_tables(spark, module, column, fold, out):
    docs, labels = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    model = module.train(docs.select("doc_id", "text"), labels)
    got = module.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(common.fold(F.col("doc_id"), fold[0]) == fold[1]).select(F.col("score").alias("s"), F.col(column).alias("y")).collect()
    s, y = np.array([r.s for r in got]), np.array([r.y for r in got])
    order = np.argsort(np.argsort(s, kind="stable"))
    area = (order[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    print(f"{column}: area {area:.4f} over {len(y)} held-out rows")
    assert area > out


def test_one_document_of_each_sampled_id(spark):
    """Repeats of a labelled row neither enlarge the sample nor change what is learnt."""
    rows, labels = labelled(spark)
    docs, table = frames(spark, rows, labels)
    often = rows + [rows[i] for i in (1, 2, 3) for _ in range(200)]
    many, _ = frames(spark, often, labels)
    sample = samples.sample_labels(table, "toxic", 4000, 3, 1)
    got = samples.with_labels(many, sample).collect()
    assert len(got) == len({r.doc_id for r in got}) == sample.count()
    assert {r.doc_id: r.text for r in got} == {i: t for i, t in rows if i in {r.doc_id for r in got}}
    at = got[0].doc_id
    clash = samples.with_labels(documents(spark, [(at, None), (at, "b"), (at, "a"), (at, None), (None, "x")]), sample).collect()
    assert [r.doc_id for r in clash] == [at]
    space = quality.train(many, table)
    assert len(space.labels) == len(quality.train(docs, table).labels)
    words = [samples.with_labels(d, sample).withColumn("part", F.lit(0)) for d in (docs, many)]
    assert sorted(toxicity._class_counts(words[0]).collect()) == sorted(toxicity._class_counts(words[1]).collect())
