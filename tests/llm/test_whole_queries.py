"""Queries of the text operators against plain versions over whole tables, and cases that cross operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from support import SF
from test_brute import brute_classes, documents, sha

from labelweave.llm import bpe, catalogue, exact_dedup, fstcount, neardup, packing, quality, secrets, toxicity
from labelweave.llm.common import written


def labels(spark, column):
    rows = spark.read.parquet(f"{SF}/labels.parquet").collect()
    return {r["doc_id"]: r[column] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r[column] is not None}


def test_quality_query(spark):
    docs, rated = dict(documents(spark)), labels(spark, "quality")

    def features(t):
        b = t.encode()
        n = len(b) - 2
        if n < 1:
            return {}
        c = Counter(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(n))
        letter = lambda x: 97 <= x | 32 <= 122 or x >= 128
        shape = [1.0, len(c) / n**0.5 / 10, sum(65 <= x <= 90 for x in b) / len(b), sum(not letter(x) and x > 32 for x in b) / len(b) * 2, sum(x <= 32 for x in b) / len(b)]
        return {k: quality.SCALE * v / n for k, v in c.items()} | {quality.DIMS + k: v for k, v in enumerate(shape)}

    known = sorted(i for i in rated if i in docs)
    rows = [features(docs[i]) for i in known]
    m = quality.fit_sparse([(np.array(sorted(x), np.int64), np.array([x[k] for k in sorted(x)], float)) for x in rows], [rated[i] for i in known])
    got = {r["doc_id"]: r for r in catalogue.op2_quality(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        p = [1 / (1 + math.exp(x - sum(m.weights[k] * v for k, v in features(t).items()))) for x in m.thresholds]
        grade = m.grades[0] + sum(q * (b - a) for q, a, b in zip(p, m.grades, m.grades[1:]))
        r = got[i]
        assert abs(r["tail_prob"] - p[-1]) < 1e-6 and abs(r["expected_grade"] - grade) < 1e-6
        assert r["kept"] == (r["tail_prob"] >= 0.5) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality_without_ratings_decides_nothing(spark, odd_docs):
    none = quality.fit(odd_docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert quality.score(odd_docs, none).where("tail_prob is null and expected_grade is null").count() == odd_docs.count()


def test_ratings_of_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", "good fine day" if i % 2 else "bad poor !!!") for i in range(40)], "doc_id string, text string")
    rated = spark.createDataFrame([(f"d{i}", i % 2) for i in range(30)], "doc_id string, grade int")
    out = {r["doc_id"]: r["tail_prob"] for r in quality.score(docs, quality.fit(docs, rated)).collect()}
    assert out["d39"] > 0.5 > out["d38"]
    m = toxicity.fit(docs, rated.withColumnRenamed("grade", "toxic"))
    assert toxicity.score(docs, m).count() == 40


RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def test_secret_query(spark):
    got = {r["doc_id"]: r for r in catalogue.op5_secret_scans(spark, SF).collect()}
    docs = documents(spark)
    assert len(docs) == len(got)
    for i, t in docs:
        found = sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(RULES.values()) for m in p.finditer(t) if len(m[g]) >= least)
        base = [f"{list(RULES)[k]}:{a}:{b}" for a, k, b in found]
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(n) for x in base) for n in RULES)
        assert r["base_sha256"] == sha(",".join(base))
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if x.split(":")[0] in RULES] == base
        more = [(m.start(), m.end()) for m in re.finditer(r"gh[pousr]_[A-Za-z0-9]{36,}", t)]
        assert [tuple(map(int, x.split(":")[1:])) for x in spans if x.startswith("github:")] == more


def test_versions_and_rules_are_scanned_once(spark, tmp_path, monkeypatch):
    """Two versions of a path and two rule versions: only pairs that the ledger lacks are scanned."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches, rules, scan=secrets._scan):
        for b in scan(batches, rules):
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(secrets, "_scan", counted)
    path = f"file://{tmp_path}/ledger"
    old = spark.createDataFrame([("a", 'token = "abcdef12"'), ("b", "plain"), ("c", None)], "path string, text string")
    new = spark.createDataFrame([("a", "AKIA" + "B" * 16), ("b", "plain"), ("d", 'token = "abcdef12"')], "path string, text string")
    few, all_rules = secrets.RULES[:1], secrets.RULES
    for rules, want in ((few, 4), (all_rules, 4)):
        before = seen.value
        ledger = secrets.Ledger(spark, path, rules)
        for v in (old, new, old):
            ledger.scan(v)
        assert seen.value - before == want and ledger.seen().count() == want
        found = {r["path"]: [x["rule"] for x in r["findings"]] for r in ledger.findings(new, "path").collect()}
        assert found == {"a": ["access"] if rules == all_rules else [], "b": [], "d": ["assign"]}
    # two scans at a time put a blob in twice: rows don't double
    again = secrets.Ledger(spark, path, all_rules)
    again.seen().write.mode("append").parquet(again.path)
    assert again.findings(new, "path").count() == 3


def near(word, term, stem):
    """Edits, 0 or 1, by which word is term, or, for a stem, begins with it; the first letter must be right, and short terms exact."""

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    if word == term or stem and word.startswith(term):
        return 0
    if len(term) < toxicity.FUZZY or word[:1] != term[:1]:
        return None
    ends = [word] if not stem else [word[:k] for k in range(len(term) - 1, len(term) + 2) if k <= len(word)]
    return 1 if any(abs(len(x) - len(term)) <= 1 and lev(x, term) <= 1 for x in ends) else None


def test_toxicity_query(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    m = toxicity.fit(table, toxicity.labelled(spark.read.parquet(f"{SF}/labels.parquet")))
    terms, known = list(m.terms.items()), {}

    def best(w):
        if w not in known:
            hits = [(e, k) for k, (t, stem) in enumerate(terms) if (e := near(w, t, stem)) is not None]
            known[w] = min(hits) if hits else None
        return known[w]

    def score(t):
        low = t.lower()
        marks = list(re.finditer(r"\w+", low))
        hits = [best(x[0]) for x in marks]
        if any(h is not None for h in hits):
            apart = []
            for i, x in enumerate(marks):
                window = marks[max(0, i - 5) : i + 6]
                before, after = low[max(0, window[0].start() - 1) : x.start()], low[x.end() : marks[min(len(marks) - 1, i + 5)].start() + 1]
                apart.append(any(y[0] in toxicity._REPORTS for y in window) or any(q in toxicity._QUOTES for q in before) and any(q in toxicity._QUOTES for q in after))
            n = lambda e, a: sum(h is not None and h[0] == e and x == a for h, x in zip(hits, apart))
            kinds = len({h[1] for h in hits if h is not None and h[0] == 0})
            x = [1.0, *map(math.log1p, (n(0, False), n(1, False), kinds, 100 * n(0, False) / len(marks), n(0, True), n(1, True)))]
        else:
            x = [1.0] + [0.0] * 6
        return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(m.weights, x))))))

    got = {r["doc_id"]: r for r in catalogue.op10_toxicity(spark, SF).collect()}
    docs = documents(spark)
    assert len(got) == len(docs)
    for i, t in docs:
        r = got[i]
        assert abs(r["score"] - score(t)) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5), i


# ---- exact dedup over sessions


def test_index_is_found_again(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    batch = lambda *t: spark.createDataFrame([(i, x) for i, x in t], "doc_id long, text string")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    one = exact_dedup.DigestIndex(spark, path, "digests_of_one", buckets=3)
    first = batch((1, "a"), (2, "b"), (3, "a"))
    assert ids(exact_dedup.fresh(first, one)) == [2, 3] == ids(exact_dedup.fresh(first, one))  # nothing is taken up before append
    one.append(first)
    spark.sql("DROP TABLE digests_of_one")  # what the catalogue of another session would not know
    two = exact_dedup.DigestIndex(spark, path, "digests_of_two")
    assert two.exists() and two.buckets == 3
    second = batch((9, "a"), (5, "c"), (6, "c"))
    assert ids(exact_dedup.fresh(second, two)) == [6]
    two.append(second)
    spark.sql("DROP TABLE digests_of_two")
    three = exact_dedup.DigestIndex(spark, path)
    state = {r["digest"].hex(): (r["keep_id"], r["group_size"]) for r in three.read().collect()}
    assert state == {sha("a"): (9, 3), sha("b"): (2, 1), sha("c"): (6, 2)}
    assert three.digests().count() == 3 and ids(exact_dedup.fresh(batch((10, "b"), (11, "d")), three)) == [11]
    plan = exact_dedup._kept(second, three)[1]._jdf.queryExecution().toString()
    assert "Join" in plan


def test_second_delivery_meets_the_index(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (None, "b"), (6, None), (7, "")], "doc_id long, text string")
    parts = catalogue.deliveries(docs)
    assert len(parts) == 2 and sum(p.count() for p in parts) == docs.count() and all(p.count() for p in parts)
    index = exact_dedup.DigestIndex(spark)
    for p in parts:
        index.append(p)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(exact_dedup.labelled(docs, index)) == key(exact_dedup.groups(docs))


# ---- near duplicates


def test_texts_of_one_document_link(spark):
    w, v = [f"w{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    rows = [("k1", " ".join(w)), ("k1", " ".join(v)), ("k2", " ".join(w[:38] + ["x", "y"])), ("k3", " ".join(v[:38] + ["x", "y"])), ("k4", "")]
    out = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.classes(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert out == [("k1", "k1", True), ("k1", "k1", True), ("k2", "k1", False), ("k3", "k1", False), ("k4", "k4", True)]


def test_blocks_of_mixed_clusters(spark, monkeypatch):
    """Many documents around some centres, with outliers between: blocks of one or a few rows."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    r = random.Random(3)
    docs = []
    for g in range(3):
        base = [f"{g}.{i}" for i in range(50)]
        for _ in range(30):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(50)] = f"n{r.randrange(10**6)}"
            docs.append((len(docs), " ".join(words)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs)


# ---- token counts and packing


def test_texts_without_spaces(monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    r = random.Random(6)
    texts = ["".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(5000)) for _ in range(3)] + ["".join(r.choice("ABxyz09+/qQ") for _ in range(5000)), "a" * 5000, "ab" * 2500, " " * 5000]
    path = catalogue.vocabulary(catalogue.PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for room in (fstcount.STATES, 1 << 12):
        monkeypatch.setattr(fstcount, "STATES", room)
        monkeypatch.setattr(fstcount, "NODES", max(room, 1 << 18))
        t = fstcount.transducer.__wrapped__(path)
        for x in texts:
            assert fstcount.count(t, x) == len(sp.encode(x))
            y = fstcount.SPACE + x.replace(" ", fstcount.SPACE)
            maps = [fstcount.chunk_map(t, y[k : k + 700]) for k in range(0, len(y), 700)]
            assert fstcount.composed(t, maps) == len(sp.encode(x))
        assert not any(len(w) > fstcount.WORD for w in t.words)
    t = fstcount.transducer(path)
    maps = [fstcount.chunk_map(t, texts[0][k : k + 700]) for k in range(0, 5000, 700)]
    assert all(len(m[0]) < 10 and len(m[2]) < 10 for m in maps)  # maps stay short where there are resets
    a, b, c = maps[:3]
    assert fstcount.compose(t, fstcount.compose(t, a, b), c) == fstcount.compose(t, a, fstcount.compose(t, b, c))
    path = catalogue.vocabulary(catalogue.BYTE_JSON)
    tok, encode = Tokenizer.from_file(path), packing.encoder(path)
    for x in [*texts, " " * 2_000_000]:
        assert np.concatenate(encode(x)).tolist() == tok.encode(x, add_special_tokens=False).ids


def test_transitions_add_up_and_are_finitely_many():
    t = fstcount.transducer.__wrapped__(catalogue.vocabulary(catalogue.PIECES))
    state, n = t.first, 0
    for i, c in enumerate(fstcount.SPACE + "international" * 20, 1):
        to = state.next.get(c) or t.follow(state, c)
        state, n = to[0], n + to[1]
        assert n == len(t.merged((fstcount.SPACE + "international" * 20)[:i]))
    before = len(t.states)
    t.run(fstcount.SPACE + "international" * 500)
    assert len(t.states) == before


def test_parts_of_long_texts_join(monkeypatch, spark):
    from tokenizers import Tokenizer

    path = catalogue.vocabulary(catalogue.BYTE_JSON)
    tok, encode = Tokenizer.from_file(path), packing.encoder(path)
    monkeypatch.setattr(packing, "PART", 40)
    for _, x in documents(spark):
        assert np.concatenate([*encode(x), np.empty(0, np.uint32)]).tolist() == tok.encode(x, add_special_tokens=False).ids


def test_bpe_places_cannot_overflow(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    import pyspark

    class Task:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Task))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["one two three four five six"])], ["doc_id", "text"])
    assert bpe._chunks(iter([batch]), public_tokenizers.PATTERN, pa.int64()).__next__().column(0).to_pylist() == [3 << bpe._SEQ]
    monkeypatch.setattr(bpe, "_POS", 2)
    with pytest.raises(OverflowError):
        list(bpe._chunks(iter([batch]), public_tokenizers.PATTERN, pa.int64()))


# ---- pipeline


def test_odd_documents_go_through_every_stage(spark, odd_docs):
    from pyspark.sql import functions as F

    clash = {"findings": F.lit("f"), "_digest": F.lit("d"), "_keep": F.lit("k"), "_text": F.lit("t"), "row": F.lit("r"), "_kept": F.lit(1), "text_hash": F.lit(2), "n_chars": F.length("text").cast("long")}
    docs = odd_docs.withColumns(clash)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name.replace(" ", "-"))
        assert out.columns == docs.columns and out.where("_digest = 'd' and findings = 'f' and _keep = 'k' and _text = 't'").count() == out.count() > 0
        docs = out
    kept = {r["doc_id"] for r in docs.collect()}
    assert {3, 8, 10, 11, 12} <= kept and not {1, 2, 9} & kept  # 4 and 1, 3 and 2 are copies, 9 is a near copy of 8
    packed = corpus_pipeline.pack(spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_keeps_and_packs_by_its_operators(spark):
    """Toxicity and packing as their operators say; an index of earlier corpora drops what it holds."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {r["doc_id"] for r in catalogue.op10_toxicity(spark, SF).where("predicted = 1").collect()}
    clean = written(corpus_pipeline.drop_toxic(spark, docs, SF), "clean")
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in documents(spark)} - bad
    tok = Tokenizer.from_file(catalogue.vocabulary(catalogue.BYTE_JSON))
    ids: dict = {}
    for r in sorted(corpus_pipeline.pack(spark, clean, SF).collect(), key=lambda r: (r["doc_id"], r["start"])):
        ids.setdefault(r["doc_id"], b"")
        assert r["start"] * 4 == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] & (r["length"] - 1) == 0
        ids[r["doc_id"]] += bytes(r["ids"])
    assert all(np.frombuffer(ids[r["doc_id"]], "<u4").tolist() == [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in clean.collect())
    index = exact_dedup.DigestIndex(spark)
    index.append(docs.where("doc_id < 50"))
    held = {hashlib.sha256((t or "").encode()).digest() for i, t in documents(spark) if i < 50}
    left = corpus_pipeline.drop_copies(spark, docs, SF, index).collect()
    assert left and not any(hashlib.sha256((r["text"] or "").encode()).digest() in held for r in left)
