"""Text operators against plain versions, the libraries, and round trips."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from support import SF
from pyspark.sql import functions as F

from labelweave.llm import bpe, catalogue, chat, exact_dedup, fingerprints, fstcount, neardup, packing, quality, secrets, toxicity

ODD = ["a", "e", "th", "ing", " ", "  ", "\n", " \n", "\t", "\x00", "\xa0", "é", "é", "中", "国", "😀", "▁", "=", "--", "<s>", "<0x0A>", "<|endoftext|>", "'s", "1", "20", "The", "ﬀ", "क", "//"]


def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(n)]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLE)))
def test_same_as_sql(name, same):
    same(name, catalogue.QUERIES, catalogue.ORACLE)


# ---- byte-level BPE


def test_bpe_is_what_the_library_gives(spark):
    import tiktoken

    path = catalogue.vocabulary(catalogue.BYTE_RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    got = by_id(catalogue.op1_byte_bpe(spark, SF))
    for i, t in documents(spark):
        ids = enc.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t))
    texts = odd_texts(300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for i, r in by_id(bpe.round_trip(df, path, public_tokenizers.PATTERN)).items():
        assert r["ids"] == enc.encode_ordinary(texts[i]) and bytes(r["decoded"]).decode() == texts[i]


def test_bpe_edges(spark, odd_docs, no_docs):
    path = catalogue.vocabulary(catalogue.BYTE_RANKS)
    out = bpe.round_trip(odd_docs, path, public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in out) == sorted((r["doc_id"] or 0, r["text"] or "") for r in odd_docs.collect())
    assert bpe.round_trip(no_docs, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_chunks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    texts = odd_texts(50, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = bpe.round_trip(df, catalogue.vocabulary(catalogue.BYTE_RANKS), public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in out.collect()} == dict(enumerate(texts))


# ---- quality


def test_ordinal_grades():
    r = np.random.default_rng(1)
    docs, grades = [], []
    for _ in range(500):
        z = r.random()
        docs.append(" ".join(r.choice(["good", "fine"] if r.random() < z else ["bad", "poor"]) for _ in range(60)))
        grades.append(int(min(3, z * 4)))
    m = quality.fit_sparse([quality.features(t) for t in docs[:350]], grades[:350])
    assert (np.diff(m.thresholds) > 0).all()
    tails = np.array([m.tails(t) for t in docs[350:]])
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(tails.sum(1), grades[350:])[0, 1] > 0.9


def test_quality_holds_out(spark):
    held = catalogue.op2_quality(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    hits = held.select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")).alias("a")).first()["a"]
    assert hits > 0.7


def test_a_capped_sample_keeps_the_shares_of_grades(spark):
    """Texts that tell nothing of their grade: the probability is the share of the grade, whatever the cap."""
    docs = spark.createDataFrame([(i, "one and the same text") for i in range(600)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, int(i % 6 == 0) + int(i % 12 == 0)) for i in range(600)], "doc_id long, grade int")
    full, capped = quality.fit(docs, ratings), quality.fit(docs, ratings, sample=40)
    tails = lambda m: m.tails("one and the same text")
    assert np.allclose(tails(full), [1 / 6, 1 / 12], atol=0.02) and np.allclose(tails(capped), tails(full), atol=0.01)


def test_quality_edges(spark, odd_docs, no_docs):
    m = quality.fit_sparse([quality.features("aaa bbb"), quality.features("!!! ???")], [0, 1])
    assert quality.score(odd_docs, m).count() == odd_docs.count() and quality.score(no_docs, m).count() == 0
    none = quality.fit(no_docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert quality.score(odd_docs, none).where("tail_prob <> 1").count() == 0


# ---- fingerprints


def canon(t):
    n = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", n(n(t).casefold())).strip()


def test_fingerprints(spark):
    got, docs = by_id(catalogue.op3_fingerprints(spark, SF)), documents(spark)
    seen = defaultdict(set)
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) == (len(t), sha(edited), float(canon(t) == canon(edited)), float(canon(t) == canon(after)))
        seen[r["fingerprint"]].add(canon(t))
        seen[r["edited_fingerprint"]].add(canon(edited))
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == len({x for v in seen.values() for x in v})


def test_fingerprint_edges(spark, odd_docs, no_docs):
    out = fingerprints.fingerprints(odd_docs).collect()
    assert len(out) == odd_docs.count()
    fp = {r["doc_id"]: r["fingerprint"] for r in out}
    assert fp[2] == fp[3] == fp[10] and fp[1] == fp[4] and fp[11] == fp[12] and fp[None] == fp[7] != fp[1]
    assert fingerprints.fingerprints(no_docs).count() == 0


def test_equal_digests_of_different_texts_are_told_apart(spark, monkeypatch):
    weak = lambda c: F.struct(F.lit(1).cast("long").alias("h1"), F.length(c).cast("long").alias("h2"), F.substring(F.sha2(c, 256), 1, 16).alias("s"))
    monkeypatch.setattr(fingerprints, "digest", weak)
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "abc")], "doc_id long, text string")
    fp = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df).collect()}
    assert fp[1] == fp[3] != fp[2] and len(set(fp.values())) == 3 and "-" in fp[1] and "-" not in fp[4]


# ---- exact dedup


def test_exact_dedup_edges(spark, odd_docs, no_docs):
    out = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.groups(odd_docs).collect()]
    assert (1, 4, 3, False) in out and out.count((4, 4, 3, True)) == 2 and (2, 3, 2, False) in out and (None, 7, 2, False) in out
    assert exact_dedup.groups(no_docs).count() == 0


def test_repeated_rows_stay_once(spark, duck):
    """Rows of one id and text: both give what the SQL gives, one kept row a text; also where ids are null."""
    rows = [(1, "a", "x"), (4, "a", "y"), (4, "a", "y"), (4, "a", "z"), (5, "b", "x"), (None, "c", "x"), (None, "c", "x"), (None, None, "x"), (6, "", "x"), (6, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = exact_dedup.groups(docs)
    kept = sorted((r["doc_id"] or 0, r["text_sha256"]) for r in out.where("kept").collect())
    assert kept == sorted([(4, sha("a")), (5, sha("b")), (0, sha("c")), (6, sha(""))]) and out.count() == len(rows)
    assert {r["doc_id"]: r["group_size"] for r in out.collect()}[4] == 4
    single = exact_dedup.dedup(docs, exact_dedup.DigestIndex(spark))
    assert single.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in single.collect()) == [(0, "c"), (4, "a"), (5, "b"), (6, "")]
    whole = duck.cursor()
    values = ", ".join(f"({'NULL' if i is None else i}::BIGINT, {'NULL' if t is None else repr(t)})" for i, t, _ in rows if i is not None)
    sql = f"WITH documents(doc_id, text) AS (VALUES {values}) {catalogue.ORACLE['op4_exact_dedup']}"
    got = exact_dedup.groups(docs.where("doc_id is not null")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(whole.sql(sql).fetchall())


def test_index_persists(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", "persisted_digests")
    batch = lambda *t: spark.createDataFrame([(i, x) for i, x in t], "doc_id long, text string")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(exact_dedup.dedup(batch((1, "a"), (2, "b"), (3, "a")), index)) == [2, 3]
    assert ids(exact_dedup.dedup(batch((4, "a"), (5, "c"), (6, "c")), index)) == [6]
    assert index.read().count() == 3
    spark.sql("DROP TABLE persisted_digests")


# ---- secrets


def test_base_rules():
    def base(text):
        assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        return [("assign access hex".split()[k], a, b) for a, k, b in sorted(found)]

    r = random.Random(5)
    parts = ["password", "ToKen", "api_key", "APIKEY", "secret", "=", ": ", " ", '"', "'", "abc", "x" * 6, "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "é", "\n", "toKen", "s3cr3t/Val+ue"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert [x for x in secrets.scan_text(t) if x[0] in secrets.BASE] == base(t), t


def test_no_part_of_a_pem_key_survives(spark):
    r = random.Random(11)
    key = ["".join(r.choice("ABCxyz019+/") for _ in range(64)) for _ in range(25)] + ["Qm9keQ=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    fields = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF", ""]
    forms = [sep.join([begin, *head, *key, *tail]) for sep in ("\n", "\r\n", "\n    ", "\n> ", "\n# ", "\\n", "\\r\\n", '\\n" +\n  "') for head in ([], fields) for tail in ([end], [])]
    forms += [" ".join([begin, *key, end]), begin + "".join(key) + end, " ".join([begin, *key[:-1]]), "\n".join([begin, *key[:3], key[3][:7]])]
    rows = [(k, f"Here it is:\n{f}\nAnd so the text goes on.\n") for k, f in enumerate(forms)]
    # another block between: each key goes, the text between them stays
    rows += [(len(rows), f"{begin}\n{key[0]}\nkept one, kept two\n{forms[0]}\nkept three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ledger = secrets.Ledger(spark)
    ledger.scan(docs)
    out = {x["doc_id"]: x["t"] for x in ledger.findings(docs, "doc_id", "text").select("doc_id", secrets.masked(F.col("text"), F.col("findings")).alias("t")).collect()}
    for k, t in out.items():
        assert not any(line[j : j + 7] in t for line in key for j in range(0, len(line) - 6)), (k, rows[k][1][:99], t)
        assert not secrets.scan_text(t) and t.count("[secret]") == (2 if k == len(forms) else 1)
        assert "kept one, kept two\n" in t and "kept three" in t if k == len(forms) else t.startswith("Here it is:\n[secret]") and t.endswith("\nAnd so the text goes on.\n")
    prose = f"A line {begin} opens a key, and the words after it stay."
    assert [x[1:] for x in secrets.scan_text(prose)] == [(7, 7 + len(begin))]
    many = (begin + "\n" + "word and word " * 5) * 5000
    assert len(secrets.scan_text(many)) == 5000


def test_ledger_scans_once(spark, odd_docs, no_docs, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    versions = spark.createDataFrame([("a", 'x token = "abcdef12"'), ("b", 'x token = "abcdef12"'), ("c", None)], "path string, text string")
    ledger.scan(versions)
    assert ledger.seen().count() == 2
    ledger.scan(versions.unionByName(spark.createDataFrame([("d", "AKIA" + "A" * 16)], versions.schema)))
    assert ledger.seen().count() == 3
    found = {r["path"]: [(x["rule"], x["start"], x["end"]) for x in r["findings"]] for r in ledger.findings(versions, "path").collect()}
    assert found == {"a": [("assign", 2, 19)], "b": [("assign", 2, 19)], "c": []}
    text = F.lit('x token = "abcdef12" y')
    marks = F.array(F.struct(F.lit("assign").alias("rule"), F.lit(2).alias("start"), F.lit(19).alias("end")), F.struct(F.lit("hex").alias("rule"), F.lit(11).alias("start"), F.lit(19).alias("end")))
    assert spark.range(1).select(secrets.masked(text, marks).alias("t")).first()["t"] == 'x [secret]" y'
    ledger.scan(odd_docs)
    assert ledger.findings(odd_docs, "doc_id").count() == odd_docs.count()
    ledger.scan(no_docs)
    assert ledger.findings(no_docs, "doc_id").count() == 0


# ---- token counts


def test_counts_are_what_the_library_gives(spark, odd_docs, no_docs):
    import sentencepiece

    path = catalogue.vocabulary(catalogue.PIECES)
    sp, t = sentencepiece.SentencePieceProcessor(model_file=path), fstcount.transducer(path)
    for x in odd_texts(2000, 2) + ["a" * 500, "=" * 333, "中" * 100]:
        assert fstcount.count(t, x) == len(sp.encode(x)), x
        c = random.Random(len(x)).randint(1, 9)
        maps = [fstcount.chunk_map(t, (fstcount.SPACE if k == 0 else "") + x[k : k + c].replace(" ", fstcount.SPACE)) for k in range(0, len(x), c)]
        assert not maps or fstcount.composed(t, maps) == len(sp.encode(x)), x
    for r in fstcount.count_tokens(odd_docs.withColumn("t", F.col("text")), path, chunk_chars=1000).collect():
        if r["doc_id"] == 8:
            assert r["n_tokens"] == len(sp.encode(odd_docs.where("doc_id = 8").first()["text"]))
    whole = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in fstcount.count_tokens(odd_docs, path).collect())
    assert whole == sorted((r["doc_id"] or 0, r["n_tokens"]) for r in fstcount.count_tokens(odd_docs, path, chunk_chars=7).collect())
    assert len(whole) == odd_docs.count() and fstcount.count_tokens(no_docs, path).count() == 0
    got = by_id(catalogue.op6_token_counts(spark, SF))
    assert all((got[i]["n_tokens"], got[i]["n_bytes"]) == (len(sp.encode(x)), len(x.encode())) for i, x in documents(spark))


# ---- near duplicates


def brute_classes(docs):
    sets, parent = {}, {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def root(x):
        while x in parent:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * min(len(sets[a]), len(sets[b])) >= 75 * max(len(sets[a]), len(sets[b])):
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and root(a) != root(b):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark):
    want = brute_classes(documents(spark))
    got = by_id(catalogue.op7_minhash_near_dedup(spark, SF))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_chains_of_near_duplicates(spark, monkeypatch):
    """Texts that drift: neighbours are linked, ends are not, and many share most bands."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r, docs = random.Random(9), []
    base = [f"w{i}" for i in range(60)]
    for g in range(2):
        words = [f"{g}{w}" for w in base]
        for k in range(45):
            docs.append((1000 * g + k, " ".join(words)))
            words[r.randrange(60)] = f"n{g}.{k}"
    docs += [(5000 + k, " ".join(base[:40] + [f"z{k}.{j}" for j in range(12 + k % 5)])) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(df).collect()} == brute_classes(docs)


def test_near_duplicate_edges(spark, odd_docs, no_docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.classes(odd_docs).collect()}
    assert {(1, 3, 1, True), (4, 3, 1, False), (2, 0, 2, True), (3, 0, 3, True), (10, 0, 10, True), (None, 1, None, True), (7, 1, None, False)} <= got
    assert any(r[0] == 9 and r[2] == 8 for r in got)
    assert neardup.classes(no_docs).count() == 0


def test_sketches():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 2**63, 900, dtype=np.uint64), r.integers(0, 2**63, 300, dtype=np.uint64)
    seeds = neardup._seeds(1024)
    x, y = neardup.registers(a, seeds), neardup.registers(np.concatenate([a[:700], b]), seeds)
    assert (neardup.merged(x, y) == neardup.registers(np.concatenate([a, b]), seeds)).all()
    d = x.astype(int) - y
    j = neardup.likely(*[np.array([(f(d)).sum()]) for f in (lambda v: v > 0, lambda v: v < 0, lambda v: v == 0)], np.array([900.0]), np.array([1000.0]))[0]
    assert abs(j - 700 / 1200) < 0.06


# ---- chat


def test_chat_edges(spark):
    rows = [(1, 1, "user", "a<b\\l"), (1, 0, "system", None), (1, 2, "user", "</turn>"), (1, 3, "assistant", "x<part>"), (1, 4, "assistant", "y"), (2, 0, None, ""), (None, 0, "as>si<", "é\\"), (3, 5, "assistant", ""), (3, 5, "assistant", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, t int")
    out = chat.format_conversations(df).select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learnt"), "loss")
    got = {r["conv_id"]: r for r in out.collect()}
    said = lambda i: [(t["role"], t["text"]) for t in got[i]["turns"]]
    assert said(1) == [("system", ""), ("user", "a<b\\l"), ("user", "</turn>"), ("assistant", "x<part>"), ("assistant", "y")] and got[1]["learnt"] == "x<part>y"
    assert got[1]["formatted"].count("<turn ") == 3 and got[1]["formatted"].count("<part>") == 2
    assert said(2) == [("", "")] and said(None) == [("as>si<", "é\\")] and said(3) == [("assistant", "")] * 2
    assert chat.format_conversations(df.where("conv_id = 99")).count() == 0


# ---- packing


def test_packing(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = catalogue.vocabulary(catalogue.BYTE_JSON)
    tok = Tokenizer.from_file(path)
    texts = dict(documents(spark)) | {10**6 + i: t for i, t in enumerate(odd_texts(300, 4))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pieces = defaultdict(list)
    rows = packing.pack(df, path, max_len=256).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for r in rows:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 256 and r["offset"] == 0 and 2 ** r["bucket"] == r["length"]
        pieces[r["doc_id"]].append(r)
    for i, t in texts.items():
        data = b"".join(bytes(r["ids"]) for r in sorted(pieces[i], key=lambda r: r["start"]))
        assert np.frombuffer(data, "<u4").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1]
    crc = catalogue.op9_packing(spark, SF).where("doc_id = 0 and start = 0").first()
    ids = [*tok.encode(texts[0], add_special_tokens=False).ids, 1][: crc["length"]]
    assert crc["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert packing.pack(odd_docs, path).select("doc_id").distinct().count() == 11
    assert packing.pack(no_docs, path).count() == 0


# ---- toxicity


def test_lexicon_finds_misspellings():
    lex = toxicity.Lexicon({"idiot": False, "trash": False, "vequ": True})
    assert lex.look("idiot") == (0, 0) and lex.look("idoit") is None and lex.look("idiott") == (0, 1) and lex.look("idio") == (0, 1) and lex.look("idizt") == (0, 1)
    assert lex.look("vequgn") == (2, 0) and lex.look("veq") is None and lex.look("xdiot") is None and lex.look("trashy") == (1, 1) and lex.look("") is None
    r = random.Random(3)
    for _ in range(3000):
        w = list("trash")
        for _ in range(r.randint(0, 2)):
            k = r.randrange(1, len(w))
            r.choice([lambda: w.insert(k, r.choice("ashz")), lambda: w.pop(k) if len(w) > 2 else None, lambda: w.__setitem__(k, r.choice("ashz"))])()
        word = "".join(w)

        def lev(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                new = [i]
                for j, y in enumerate(b, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            return row[-1]

        hit = lex.look(word)
        assert (hit is not None) == (lev(word, "trash") <= 1), word


def test_quotation_is_kept_apart():
    m = toxicity.Model({"idiot": False}, {}, [0.0] * 7)
    assert m.features("you idiot go away now please and more words")[1] > 0
    quoted = m.features('he said the word "idiot" was not nice at all today')
    assert quoted[1] == 0 and quoted[5] > 0


def test_toxicity_holds_out(spark):
    held = catalogue.op10_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    r = held.groupBy("toxic", "predicted").count().collect()
    n = {(x["toxic"], x["predicted"]): x["count"] for x in r}
    assert n.get((1, 1), 0) > 0.85 * (n.get((1, 1), 0) + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_a_capped_sample_keeps_the_shares_of_classes(spark):
    """Texts that tell nothing of their class: the score is the share of toxic ones, whatever the cap."""
    docs = spark.createDataFrame([(i, "a plain remark here") for i in range(1600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(1600)], "doc_id long, toxic int")
    full, capped = toxicity.fit(docs, labels), toxicity.fit(docs, labels, sample=100)
    assert np.allclose([full.score("a plain remark here"), capped.score("a plain remark here")], 1 / 8, atol=0.01)


def test_toxicity_edges(spark, odd_docs, no_docs):
    m = toxicity.fit(no_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(odd_docs, m).where("score between 0 and 0.5").count() == odd_docs.count()
    assert toxicity.score(no_docs, m).count() == 0
