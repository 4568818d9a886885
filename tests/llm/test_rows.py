"""Row-by-row decisions, identity of words, and the pipeline, against plain Python."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from labelwright.llm import bpe, common, exact, jaccard, media, packing, pretokens, queries, sharding, toxicity, words
from test_small import JSON, WORD, R, brute_jaccard, passage

#: Columns that the operators' own names clash with.
CLASHING = ["row", "Score", "best", "key", "root", "n", "cls", "recipe", "_rows", "_repeated", "_bucket", "bucket"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], SCHEMA).repartition(3)


def thue_morse(letters, n=2048):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


PAIR = thue_morse("ab"), thue_morse("ba")


def test_words_apart():
    data = [w.encode() for w in (*PAIR, "x", "", "abcdefgh", "abcdefghi", "abcdefghj", "a" * 16, "a" * 17)]
    joined = np.frombuffer(b"".join(data), np.uint8)
    size = np.array(list(map(len, data)))
    first = np.cumsum(size) - size
    lanes = words.Lanes(joined)
    assert len(set(words.hashes(lanes, first, size).tolist())) == len(data)
    assert lanes.read(np.arange(len(joined))).tolist() == [int.from_bytes(joined[i : i + 8].tobytes(), "little") for i in range(len(joined))]
    same = np.array([0, 1])
    assert words.differing(lanes, first[same], lanes, first[[0, 0]], size[same]).tolist() == [False, True]


def test_word_table_when_hashes_clash(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    texts = [PAIR[0], PAIR[1], "ab ba abba baba", "<|endoftext|> a", "it's <|endoftext|>", passage(40)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert expected[3] == [50256, 257]
    real = words.hashes
    for weak in (real, lambda lanes, first, size: size.astype(np.uint64) % np.uint64(3)):
        monkeypatch.setattr(words, "hashes", weak)
        own = pretokens.byte_level_table(JSON)
        for _ in range(2):
            flat, counts = own.texts(texts)
            ends = np.cumsum(counts)
            assert [flat[e - n : e].tolist() for e, n in zip(ends, counts)] == expected


def test_tokens_of_sets_apart():
    sets = []
    for w in PAIR:
        data = np.frombuffer(f"one {w} two".encode(), np.uint8)
        sets.append(jaccard.token_sets(data, np.array([0, len(data)]))[0].tolist())
    assert sets[0] != sets[1]


ROWS = [(3, "alpha beta"), (5, "gamma delta"), (5, "alpha beta"), (7, "one  two"), (7, "one two"), (None, "alpha  beta"), (None, None), (8, ""), (9, " \n"), (10, "gamma delta"), (None, "q")]


def test_exact_keep_one_by_row(spark):
    def text(t):
        return re.sub(r"[ \t-\r]+", " ", t or "")

    for widths in ((8, 32), (1, 32)):
        kept = exact.keep_one(frame(spark, ROWS), widths)
        assert kept.columns == ["doc_id", "text", *CLASHING]
        got = Counter((r.doc_id, text(r.text)) for r in kept.collect())
        expected = {}
        for doc, t in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
            expected.setdefault(text(t), doc)
        assert got == Counter((doc, t) for t, doc in expected.items())
    assert exact.keep_one(frame(spark, ROWS).limit(0)).count() == 0


def near_rows():
    base = passage(80).split()
    near = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in (3, 40, 70)]
    other = passage(60)
    return [(5, "a wholly different text of its own"), (5, near[0]), (2, " ".join(base)), (6, "x y z"), (6, "q r s"), (None, near[1]), (None, other), (4, other), (None, None), (None, ""), (1, None), (9, near[2])]


def brute_keep(rows):
    """Of each group of near copies the row with the least doc_id; rows without words stay."""
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    group = {}
    for doc, _, component in brute_jaccard(numbered).elements():
        group[doc] = component
    best = {}
    for i, (doc, _) in enumerate(rows):
        best.setdefault(group[i], []).append((doc is None, doc or 0, i))
    return Counter(rows[min(v)[2]] for v in best.values())


def test_near_keep_one_by_row(spark):
    rows = near_rows()
    kept = jaccard.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", *CLASHING] and Counter((r.doc_id, r.text) for r in kept.collect()) == brute_keep(rows)


def toxic_rows():
    clean = [(i, passage(40)) for i in range(200)]
    bad = [(1000 + i, " ".join(passage(6) + " " + R.choice(["moronic", "idiots", "scummy"]) for _ in range(4))) for i in range(200)]
    return clean, bad, [(i, 1, int(i >= 1000)) for i, _ in [*clean, *bad]]


def naive_scores(model, text):
    """The model's score, n-gram by n-gram."""
    raw = bytes([32, *(int(toxicity.LETTERS[b]) for b in (text or "").encode()), 32])
    fresh, last, kept = bytearray(raw), None, []
    for m in re.finditer(rb"[^ ]+", raw):
        if m[0] == last:
            fresh[m.start() - 1 : m.end() - 1] = b"\x00" * (m.end() - m.start())
        else:
            kept.append(m[0])
        last = m[0]
    bucket = lambda x: int(x) >> 64 - toxicity.BITS
    parts = [model.parts[bucket(words.hashes(words.Lanes(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0])] for w in kept]
    for size in toxicity.SIZES:
        for i in range(len(raw) - size + 1):
            gram = raw[i : i + size]
            if b" " not in gram[1:-1] and gram.strip() and fresh[i]:
                parts.append(model.parts[bucket(words.mixed(np.array([int.from_bytes(gram, "little") + (size << 56)], np.uint64))[0])])
    logit = float(np.sum(parts, dtype=np.float64)) / (len(parts) + toxicity.NEUTRAL) + model.bias[1] - model.bias[0]
    return 1 / (1 + math.exp(-logit))


def test_toxicity_scores_and_rows(spark):
    clean, bad, labels = toxic_rows()
    rows = [*clean, *bad, (3, bad[0][1]), (None, bad[1][1]), (None, clean[4][1]), (None, None), (7, ""), (8, "idiots idiots  idiots idiotz Ä ß")]
    df, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks)
    assert np.linalg.matrix_rank(model.embedding, tol=1e-3) > 1
    scored = {(r.doc_id, r.text): r.found for r in toxicity.scored(df, model, "found").collect()}
    for row in rows[::7] + rows[-6:]:
        assert scored[row] == pytest.approx(naive_scores(model, row[1]), abs=1e-5)
    kept = toxicity.keep_clean(df, marks)
    assert kept.columns == df.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r for r in rows if scored[r] < 0.5)
    assert toxicity.classify(df.limit(0), marks).count() == 0 and toxicity.keep_clean(df.limit(0), marks).count() == 0


def test_pipeline(spark, tmp_path):
    clean, bad, labels = toxic_rows()
    rows = [*clean[:40], *bad, *ROWS, *near_rows(), (3, bad[0][1]), (50, passage(700)), (51, "word " * 3000)]
    frame(spark, rows).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    sf_dir = f"{tmp_path}/a"
    left, marks = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = toxicity.fit(left, marks)
    stays = [r for r in rows if naive_scores(model, r[1]) < 0.5]
    assert 20 < len(stays) < len(rows) - 150
    seen = {}
    for doc, t in sorted(stays, key=lambda r: (r[0] is None, r[0] or 0)):
        seen.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), (doc, t))
    expected = brute_keep(list(seen.values()))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    from tokenizers import Tokenizer

    library, pieces = Tokenizer.from_file(JSON), Counter()
    for (doc, text), k in expected.items():
        n = len(library.encode(text or "", add_special_tokens=False).ids) + 1
        first = (n - 1) % 1024 + 1
        pieces.update({(doc, i, 0 if i == 0 else first + 1024 * (i - 1), first if i == 0 else 1024): k for i in range(-(-n // 1024))})
    assert Counter((r.doc_id, r.piece, r.start, r["length"]) for r in got) == pieces
    frame(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "best_fit_packing"] and queries.queries()


def test_rendezvous_equals_plain_python(spark):
    weights = [1.0, 2.5, 1.0, 0.5]

    def plain(key, weights):
        def score(shard, weight):
            seed = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
            return weight / -math.log(((xxhash.xxh64(struct.pack("<i", shard), seed=seed).intdigest() >> 11) + 0.5) / 2**53), shard

        return max(score(i, w) for i, w in enumerate(weights))[1]

    keys = spark.range(-500, 500).withColumn("best", F.lit("x")).withColumn("bucket", F.lit(1))
    placed = sharding.slots(sharding.assign(keys, F.col("id"), weights, grown="more"), "shard", ["id"]).collect()
    assert [(r.shard, r.more) for r in sorted(placed)] == [(plain(k, weights), plain(k, [*weights, 1.0])) for k in range(-500, 500)] and {r.best for r in placed} == {"x"}


def test_media_features(spark):
    texts = ["", "abc äö " * 50, "x" * 192, None, "abc äö " * 50]
    got = {r.doc_id: r for r in media.round_trip(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        lines = b"".join(b"\x00" + pad[k : k + 192] for k in range(0, len(pad), 192))
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        image = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 192, len(pad) // 192, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines, 1)) + part(b"IEND", b"")
        mean = sum(pad) / len(pad)
        steps = Counter(b // 32 for b in pad)
        feature = f"192x{len(pad) // 192};mean={mean:.4f};std={math.sqrt(sum((b - mean) ** 2 for b in pad) / len(pad)):.4f};distinct={len(set(pad))};hist={','.join(str(steps[k]) for k in range(8))}"
        assert (got[i].media_bytes, got[i].media_sha256, got[i].feature) == (len(image), hashlib.sha256(image).hexdigest(), feature)
        assert (got[i].position, got[i].caption) == (1, f"Text of {len(raw)} bytes")
    assert got[1][1:] == got[4][1:]


def test_pages_with_open_heads_and_nested_figures():
    found = [(p["kind"], p["text"], p["ref"], p["caption"]) for p in media.parts("<html><head><title>T</title><body><p>All the text</p>")]
    assert found == [("text", "All the text", None, None)]
    nested = '<figure><img src="a"><figure><img src="b"><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure><img src="c">'
    assert [(p["ref"], p["caption"]) for p in media.parts(nested)] == [("a", "out"), ("b", "in"), ("c", None)]


def test_bpe_by_the_file_of_the_query(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t) for i, t in enumerate([None, "", passage(200), "Ünïcode 世界 ٣ x²", " " * 300, "<|endoftext|>", PAIR[0]])]
    for r in bpe.round_trip(frame(spark, rows), path, public_tokenizers.PATTERN).collect():
        ids = plain.encode_ordinary(rows[r.doc_id][1] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_packing_with_clashing_columns(spark):
    rows = near_rows()
    got = packing.pack_documents(frame(spark, rows).withColumnRenamed("cls", "piece"), JSON, 64, 2)
    assert Counter(r.doc_id for r in got.filter("piece = 0").collect()) == Counter(doc for doc, _ in rows) and WORD
