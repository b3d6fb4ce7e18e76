"""Classifiers, search, chat formatting and the pipeline, against brute force or held-out rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import chat, labelled, minhash, mixing, quality_knn, sentencepiece, topk, toxicity
from paperloom.llm.store import materialize, shared_dir
from paperloom.llm.textkernel import PUNCTUATION, chunks, mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 90))]
        toxic, good = rng.random() < 0.25, rng.random() < 0.75
        if toxic:
            for _ in range(1 + len(own) // 15):
                own.insert(rng.randrange(len(own)), "zorgl" + rng.choice(words))
        text = " ".join(own) if good else " ".join(w.upper() + "!!" for w in own)
        docs.append((i, text, None, f"s{i % 3}", len(text)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_held_out_is_the_stated_fold(spark):
    got = spark.range(50).select("id", labelled.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_training_never_sees_the_held_out_fold(spark):
    docs, labels = corpus(200)
    sample = labelled.training_sample(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "toxic")
    seen = {r.text for r in sample.collect()}
    assert not seen & {t for i, t, *_ in docs if zlib.crc32(str(i).encode()) % 4 == 2} and len(seen) > 100


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    first = rows.filter("doc_id = 1").select("doc_id", F.explode(F.array_repeat("text", 20_000)).alias("text"))
    more = spark.createDataFrame([(1, None), (1, "a"), (4, "b")], "doc_id long, text string")
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    seen = []
    for parts in (3, 11):
        docs = rows.union(first).union(more).repartition(parts)
        seen.append(sorted(r.text for r in labelled.training_sample(spark, docs, labels.repartition(parts), "toxic", max_rows=100).collect()))
    assert len(seen[0]) == 100 and seen[0] == seen[1] and len(set(seen[0])) == 100
    few = labelled.training_sample(spark, rows.union(first).union(more).filter("doc_id < 20"), labels, "toxic").collect()
    assert len(few) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(20))


@pytest.mark.parametrize("module,label,threshold", [(toxicity, "toxic", 0.3), (quality_knn, "quality", 0.7)])
def test_held_out_accuracy(spark, module, label, threshold):
    docs, labels = corpus()
    d = spark.createDataFrame(docs + [(9000, None, None, None, None), (9001, "", None, None, 0), (None, "abc " * 3000, None, None, 0)], DOCS).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = module.score(d, module.fit(spark, d, lab), threshold).collect()
    assert len(out) == len(docs) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in out)
    truth = {i: (q if label == "quality" else t) for i, q, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    again = module.score(d, module.fit(spark, d, lab), threshold).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in out}


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality_knn, "quality")])
def test_no_labels_or_one_class(spark, module, label):
    d = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.score(d, module.fit(spark, d, none), 0.5).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1, 1) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.score(d, module.fit(spark, d, one), 0.5).collect()} == {1.0}
    assert module.score(d.filter("false"), module.fit(spark, d.filter("false"), none), 0.5).count() == 0


def brute_top(rows, k, asks):
    out = []
    for q, v in rows:
        if asks(q):
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), c) for c, w in rows if c != q)[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e9])
def test_top_k_is_exact(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "CHUNK_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "SLICE", 3)
    rng = random.Random(2)
    base = [[rng.uniform(-scale, scale) for _ in range(6)] for _ in range(40)]
    data = [(i, [float(np.float32(x)) for x in rng.choice(base)] if i % 2 else [float(np.float32(rng.uniform(-scale, scale))) for _ in range(6)]) for i in range(150)]
    data.append((300, [3e38] * 6))  # beyond 64 bits
    bad = [(None, [1.0] * 6), (200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6)]
    df = spark.createDataFrame(data + bad + data[:2], "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = sorted(map(tuple, topk.top_k(spark, df, F.col("vec_id") % 20 == 0, k=7).collect()))
    assert len(got) == 7 * 9
    whole = [(i, [int(np.floor(64.0 * x)) for x in v]) for i, v in data]
    want = brute_top(whole, 7, lambda i: i % 20 == 0)
    assert got == want


def test_later_phases_resolve_few_pairs():
    rng = np.random.Generator(np.random.PCG64(3))
    c = np.floor(64 * rng.standard_normal((4000, 32)) / 5)
    q, own = c[:50], np.arange(50)[:, None] == np.arange(4000)[None, :]
    full = np.where(own, -(10**9), q @ c.T)
    row, col, score = topk._first(*topk._exact(q, c), own, 20, 1)
    assert len(row) <= 50 * 161 and (score == full[row, col]).all()
    cutoff = np.array([np.sort(score[row == i])[-20:][0] for i in range(50)]).astype(np.int64)
    seen = []
    topk_resolve = topk._resolve
    try:
        topk._resolve = lambda q, c, part, row, col: seen.append(len(row)) or topk_resolve(q, c, part, row, col)
        row, col, score = topk._sufficient(*topk._exact(q, c), own, cutoff)
        flat = c.copy()
        flat[:, 16:] = 0  # the second list cannot reach the threshold
        r, k, s = topk._sufficient(*topk._exact(flat[:50], flat), own, cutoff)
    finally:
        topk._resolve = topk_resolve
    assert set(zip(row, col)) == set(zip(*np.nonzero(full >= cutoff[:, None]))) and len(row) < 0.02 * full.size
    assert (score == full[row, col]).all() and len(seen) == 1 and seen[0] < 0.2 * full.size
    assert set(zip(r, k)) == set(zip(*np.nonzero(np.where(own, -(10**9), flat[:50] @ flat.T) >= cutoff[:, None])))


def test_top_k_of_little(spark):
    df = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(spark, df, F.col("vec_id") == 0).collect()] == [(0, 1, 5, 64 * 128)]
    assert topk.top_k(spark, df.filter("false"), F.col("vec_id") == 0).count() == 0


# ---- models against plain Python


def plain_chunk(texts, lower=False, breaks=None):
    found = list(chunks(pa.array(texts), lower=lower, **({"breaks": breaks} if breaks is not None else {})))
    assert len(found) == 1
    return found[0][2]


def test_voters_fire_as_counted_by_hand():
    texts = ["Bad badly BAD, word", "", "a badminton-bad", "wordy word!!", "AAAA BBBB", "x!!!!"]
    names = ["bad", "word"]
    exact, begins = [{h: n for n, h in zip(names, plain_chunk([" ".join(names)], True, PUNCTUATION).word_hash())} for _ in range(2)]
    begins = {mix(np.array([h], np.uint64))[0]: n for h, n in exact.items()}
    voters = np.sort(np.array([*exact, *begins], np.uint64))
    out = toxicity.fire(plain_chunk(texts, True, PUNCTUATION), voters)
    words = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    for v, h in enumerate(voters):
        name = begins.get(h) or exact[h]
        whole = h in begins  # words are mixed once more, beginnings are not
        assert out[:, v].tolist() == [sum(w == name if whole else w.startswith(name) for w in ws) for ws in words]
    caps = [sum(c.isupper() for c in t) > 0.5 * max(len(t.encode()), 1) for t in texts]
    bangs = [sum(a == b == "!" for a, b in zip(t, t[1:])) > 0.02 * max(len(t.encode()), 1) for t in texts]
    assert out[:, -2].tolist() == caps and out[:, -1].tolist() == bangs


def test_label_model_against_loops():
    rng = random.Random(12)
    truth = [rng.random() < 0.4 for _ in range(120)]
    votes = [[rng.random() < (0.7 if y else 0.1), rng.random() < (0.5 if y else 0.2), rng.random() < 0.3] for y in truth]
    votes = [[*v, v[0]] for v in votes]  # the last voter repeats the first
    labels = [float(y if rng.random() < 0.9 else not y) for y in truth]
    q, n, m = [0.95 if y else 0.05 for y in labels], len(votes), 4
    for _ in range(10):
        share = min(0.99, max(0.01, sum(q) / n))
        t1 = [(sum(q[i] * votes[i][j] for i in range(n)) + 0.5) / (sum(q) + 1) for j in range(m)]
        t0 = [(sum((1 - q[i]) * votes[i][j] for i in range(n)) + 0.5) / (n - sum(q) + 1) for j in range(m)]
        rest = [[votes[i][j] - q[i] * t1[j] - (1 - q[i]) * t0[j] for j in range(m)] for i in range(n)]
        norm = [sum(r[j] ** 2 for r in rest) ** 0.5 + 1e-9 for j in range(m)]
        cor = [[abs(sum(r[a] * r[b] for r in rest)) / norm[a] / norm[b] for b in range(m)] for a in range(m)]
        weight = [1 / max(1, sum(c for c in row if c > 0.2)) for row in zip(*cor)]
        for i in range(n):
            odds = np.log(share / (1 - share)) + sum(weight[j] * (np.log(t1[j] / t0[j]) if votes[i][j] else np.log((1 - t1[j]) / (1 - t0[j]))) for j in range(m))
            q[i] = 1 / (1 + np.exp(-(odds + toxicity.LABEL_ODDS * (2 * labels[i] - 1))))
    got = toxicity.label_model(np.array(votes), np.array(labels))
    assert np.allclose(got, q, atol=1e-9) and weight[0] < 0.6 < weight[1] + 0.3


def test_neighbours_vote_as_by_hand(spark):
    docs, labels = corpus(150, seed=5)
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_knn.fit(spark, d, lab)
    got = {r.doc_id: r.score for r in quality_knn.score(d, model, 0.7).collect()}
    for i, text, *_ in docs[:40]:
        chunk = plain_chunk([text])
        doc, term, many = quality_knn.terms(chunk)
        x = np.zeros(quality_knn.TERMS)
        for t, n in zip(term, many):
            x[t] = np.log1p(100 * n / len(text.split())) * (1 if t < quality_knn.SURFACE else quality_knn.LEXICAL_WEIGHT) * model.rare[t]
        v = x @ model.axes - model.base
        v = (v / np.linalg.norm(v)).astype(np.float32)
        cosine = sorted(((float(v @ w), y) for w, y in zip(model.vectors, model.labels)), key=lambda p: -p[0])[: quality_knn.NEIGHBOURS]
        w = [max(0.0, c) ** quality_knn.SHARPNESS for c, _ in cosine]
        assert got[i] == pytest.approx(sum(a * y for a, (_, y) in zip(w, cosine)) / sum(w), abs=1e-4)


def test_terms_are_counted_as_by_hand():
    text = "The cat, the CAT; a1 b2 the cat\nthe cat the"
    doc, term, many = quality_knn.terms(plain_chunk([text, "", "one"]))
    words = re.findall(r"\S+", text)
    shape = lambda w: "".join(k for k, _ in itertools.groupby("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in w))
    first = [(t, n) for i, t, n in zip(doc, term, many) if i == 0]
    assert sorted(n for t, n in first if t < quality_knn.SHAPES) == sorted(Counter(map(shape, words)).values())
    sizes = {t - quality_knn.SHAPES + 1: n for t, n in first if quality_knn.SHAPES <= t < quality_knn.SHAPES + 24}
    assert sizes == Counter(map(len, words))
    assert sum(n for t, n in first if t >= quality_knn.SURFACE) == 2 * len(words)
    assert set(doc.tolist()) == {0, 2}


# ---- chat

CONTROL = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\nx", "a\\b\\\\", "<|", "<s><unk>", "\\<|", None, "", " \n"]


def test_escapes_are_reversible():
    rng = random.Random(3)
    for t in [t for t in CONTROL if t] + ["".join(rng.choice(["<", "|", "\\", "s>", "/s>", "[", "INST]", "unk>", "é"]) for _ in range(rng.randrange(12))) for _ in range(3000)]:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in ("<|", "<s>", "</s>", "<unk>", "[INST]", "[/INST]"))
        assert chat._plain_role(chat._role(t)) == t


def told(seed=4):
    rng = random.Random(seed)
    rows = []
    for c in [*range(25), None]:
        for n in range(rng.choice([1, 2, 5, 40])):
            text = rng.choice(CONTROL) if rng.random() < 0.3 else " ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([1, 30, 200])))
            rows.append((c, n if rng.random() < 0.9 else 0, "system" if n == 0 and rng.random() < 0.6 else rng.choice(["user", "assistant", "assistant", None]), text))
    return rows


def test_formatting_reads_back(spark):
    rows = told()
    df = spark.createDataFrame(rows + rows[:2], "conv_id long, turn long, role string, text string").repartition(7).withColumn("kind", F.lit("clash"))
    windows = chat.format_windows(spark, df)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = {}
    for c, n, role, text in rows + rows[:2]:
        by.setdefault(c, []).append((n, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    made = windows.collect()
    assert sum(len(w.formatted) for w in made) == sum(r.formatted_chars for r in got.values())
    for w in made:  # a system turn leads every later window of its conversation
        turns = by[w.conv_id]
        if w.window and turns[0][1] == "system":
            assert w.formatted.startswith(f"<|turn|>system\n{chat.escape(turns[0][2])}<|end|>") and w.repeated


def test_windows_against_a_plain_walk(spark):
    rows = told(seed=11)
    made = {(w.conv_id, w.window): w for w in chat.format_windows(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    by, seen = {}, set()
    for c, n, role, text in rows:
        by.setdefault(c, []).append((n, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        begin, at = [], 0
        for _, _, t in turns:
            begin.append(at)
            at += len(re.findall(r"[^\x20\x09-\x0D]+", t)) + chat.TURN_TOKENS
        end = [*begin[1:], at]
        lead = next((k for k, t in enumerate(turns) if t[1] == "system"), None)
        for w in sorted({b // chat.SPAN for b in begin}):
            new = [k for k, b in enumerate(begin) if b // chat.SPAN == w]
            past = [k for k in range(new[0]) if begin[new[0]] - begin[k] <= chat.HISTORY and end[k] <= begin[new[0]]]
            first = [lead] if lead is not None and lead < new[0] else []
            shown = [*first, *(k for k in past if k not in first), *new]
            text, loss = "", []
            for k in shown:
                text += f"<|turn|>{chat._role(turns[k][1])}\n"
                if k in new and turns[k][1] == "assistant":
                    loss.append([len(text), len(text) + len(chat.escape(turns[k][2]))])
                text += chat.escape(turns[k][2]) + "<|end|>\n"
            got = made[c, w]
            seen.add((c, w))
            assert got.formatted == text and got.repeated == len(shown) - len(new) and [list(x) for x in got.loss] == loss
    assert seen == set(made)


def test_long_conversation_over_many_partitions(spark):
    df = spark.range(900).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("say "), F.col("id").cast("string")).alias("text"))
    laid = chat._laid_out(spark, df, "conv_id", "turn", "role", "text").collect()
    assert sorted(r.begin for r in laid) == [6 * i for i in range(900)]
    sizes = [w.formatted.count("<|turn|>") for w in chat.format_windows(spark, df).collect()]
    assert len(sizes) == -(-900 * 6 // chat.SPAN) and max(sizes) <= (chat.SPAN + chat.HISTORY) // 6 + 1
    assert chat.format_windows(spark, df.filter("false")).count() == 0


# ---- the pipeline


def test_pipeline_against_its_parts(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(60), text(100)
    texts = [text(80) for _ in range(20)] + [text(70) + "\n" + passage for _ in range(3)] + [base, base + " tail", "short", None, "A!! " * 60, "# " * 90]
    data = [(i, t, "en", "a" if i % 3 else "b", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, DOCS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "mixing", "encoding"]
    steps = []
    for n, stage in corpus_pipeline.STAGES:
        docs = materialize(spark, stage(spark, docs, ""), "stage")
        steps.append(docs)
        assert n == "encoding" or docs.columns == [f.split()[0] for f in DOCS.split(", ")]
    good, lines, near, mixed, encoded = [s.collect() for s in steps]
    assert sorted(r.doc_id for r in good) == list(range(25))
    cut = {r.doc_id: r.text for r in lines}
    assert sorted(cut) == list(range(25)) and passage in cut[20] and passage not in cut[21] and cut[21] == texts[21].split("\n")[0]
    assert {r.doc_id for r in near} == set(range(24))
    times = {r.doc_id: r.taken // r.size for r in mixing.assess(spark, steps[2]).collect()}
    assert sorted(r.doc_id for r in mixed) == sorted(i for i, n in times.items() for _ in range(n))
    own = sentencepiece.Model.load(corpus_pipeline.TOKENIZER)
    back = sentencepiece.decode(steps[4], own).collect()
    assert len(back) == len(mixed) and all(r.decoded == r.text for r in back) and encoded[0].ids


STAGE_EDGES = {"quality rules": 3, "line dedup": 8, "near dedup": 6, "encoding": 8}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, name, stage):
    long = " ".join(f"w{i}" for i in range(60))
    data = [(1, long, "en", "a", 9), (1, long, "en", "a", 9), (1, long + " more", None, None, None), (2, None, None, None, None), (3, "", "en", "b", 0), (4, "short", "en", "b", 5), (None, None, None, "a", None), (None, "other words", "en", None, None)]
    docs = spark.createDataFrame(data, DOCS).withColumn("id", F.lit("clash")).withColumn("_place", F.lit(1)).withColumn("many", F.lit(None).cast("int"))
    out = stage(spark, docs, "").collect()
    if name == "mixing":
        assert all(sum(r[:-3] == d for r in out) <= 3 * data.count(d) for d in data) and len(out) >= 3
    else:
        assert len(out) == STAGE_EDGES[name]
    if name != "encoding":
        assert stage(spark, docs, "").columns == docs.columns
    assert all(r.id == "clash" and r["_place"] == 1 and r.many is None for r in out)
    assert stage(spark, docs.filter("false"), "").count() == 0


def test_intermediate_folder_is_the_shared_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert minhash.COORDINATES - minhash.MATCHES + minhash.SHARED <= minhash.COORDINATES
