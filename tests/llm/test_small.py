"""Operators on small tables against plain Python: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from labelwright.llm import bpe, exact, jaccard, media, mixing, packing, pretokens, sharding, tokencounts, toxicity, warc, words

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, length long, row string, n long, cls string"
R = random.Random(5)
VOCABULARY = ["".join(R.choices("abcdeé", k=R.randint(2, 7))) for _ in range(400)]


def passage(n):
    return " ".join(R.choices(VOCABULARY, k=n))


def texts():
    long = passage(6000)
    base = passage(120).split()
    near = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in range(0, 100, 9)]
    far = [" ".join(base[: 60 - i] + passage(70).split()) for i in range(5)]
    return [None, "", " \n ", "one two", "one two", "One\tTWO  ", " one two", long, long + " end", "x" * 9000, "it's we'll 12,5 — Ä\x1c ", *near, *far, near[0], near[0].upper(), passage(50), "<|endoftext|> a"]


@pytest.fixture(scope="module")
def rows():
    made = [(i * 7 % 101, t) for i, t in enumerate(texts())]
    return [*made, made[3], (None, "one two"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "r", 2, "c") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pretokens_equal_the_library():
    from tokenizers import Tokenizer

    own, library = pretokens.byte_level_table(JSON), Tokenizer.from_file(JSON)
    marks = [*"aAé ß'  \n\t12.,!?", "'s", "'ll", " '", "世", " ", " ", "—", "\x1c", "٣", "'re", "'d"]
    many = ["".join(R.choices(marks, k=R.randint(0, 30))) for _ in range(3000)]
    for part in (many, many[:7]):
        flat, counts = own.texts(part)
        ends = np.cumsum(counts)
        assert [flat[e - n : e].tolist() for e, n in zip(ends, counts)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_plan_is_best_fit_decreasing():
    for _ in range(150):
        size = R.randint(3, 30)
        lengths = [R.randint(1, size) for _ in range(R.randint(0, 80))]
        bins, used = [], defaultdict(list)
        for x in sorted(lengths, reverse=True):
            fits = [i for i, b in enumerate(bins) if size - b >= x]
            if fits:
                bins[max(fits, key=lambda i: bins[i])] += x
            else:
                bins.append(x)
        for length, lo, hi, first, each, offset in packing.plan(Counter(lengths), size):
            for r in range(hi - lo):
                used[first + r // each].append((offset + r % each * length, length))
        assert sorted(bins) == sorted(sum(n for _, n in v) for v in used.values())


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    packed = packing.pack_documents(docs, JSON, 64, 2, with_ids=True).cache()
    pieces = packed.collect()
    ids = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.token_ids) == p.ids_crc32 and len(p.token_ids) == 4 * p.length
        ids[p.doc_id].append(p)
    for doc, text in rows:
        if [r[0] for r in rows].count(doc) == 1:
            own = sorted(ids[doc], key=lambda p: p.piece)
            whole = [*library.encode(text or "", add_special_tokens=False).ids, 2]
            assert np.frombuffer(b"".join(p.token_ids for p in own), "<u4").tolist() == whole and [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
            assert all(p.length == 64 for p in own[1:])
    places = defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
    for v in places.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() and sum(n for _, n in v) <= 64
    assert {r.sequence_id: len(r.token_ids) for r in packing.sequences(packed).collect()} == {k: 4 * sum(n for _, n in v) for k, v in places.items()}
    assert packing.pack_documents(empty, JSON).count() == 0


def test_bpe(docs, empty, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = sorted((i or -1, len(ids := plain.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows)
    assert got == expected and bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    short = bpe.Codec(RANKS, public_tokenizers.PATTERN, stretch=16)
    for text in (passage(300), "y" * 500, "a  b\n\n  c " * 40, " " * 200 + "x", "don't " * 50):
        assert short.encode(text) == plain.encode_ordinary(text)
    kept = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, with_ids=True)
    assert Counter(bytes(r.text_bytes) for r in bpe.decode_ids(kept, RANKS, public_tokenizers.PATTERN).collect()) == Counter((t or "").encode() for _, t in rows)


def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return Counter((doc, len(sets[i]), min(least[find(i)], default=doc) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def test_jaccard(docs, empty, rows):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert got == brute_jaccard(rows)
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_of_chains(spark):
    base = passage(150).split()
    made = [(0, " ".join(base))]
    for i in range(1, 60):
        words = list(base if i % 3 else made[-1][1].split())
        for _ in range(R.randint(0, 6)):
            words[R.randrange(len(words))] = R.choice(VOCABULARY) + "z"
        made.append((i, " ".join(words)))
    shared = passage(60)
    made += [(100 + i, f"{passage(30)} {shared} {passage(30)}") for i in range(40)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(4)).collect())
    assert got == brute_jaccard(made)


def test_jaccard_of_rows_without_doc_id(spark):
    base = passage(200).split()
    changed = lambda words, *at: [w if i not in at else f"{w}new{i}" for i, w in enumerate(words)]
    bridge = changed(base, 20, 40, 60)
    far = changed(bridge, 100, 120, 140)
    other = passage(150).split()
    made = [(1, " ".join(base)), (None, " ".join(bridge)), (None, " ".join(bridge)), (2, " ".join(far)), (None, " ".join(other)), (None, " ".join(changed(other, 70))), (3, passage(80))]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect())
    assert got == brute_jaccard(made) and {c for d, _, c in got if d in (1, 2)} == {1}


def test_sharding(docs, empty, rows):
    got = sharding.shard_documents(docs, 5).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    for shard in range(5):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
    assert all(r.grown_shard in (r.shard, 5) for r in got) and len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.shard_documents(empty).count() == 0


def test_weighted_shards(spark):
    keys = spark.range(20000)
    n = {r.s: r["count"] for r in keys.groupBy(sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0, 1.0]).alias("s")).count().collect()}
    assert set(n) == {0, 1, 3} and n[1] == pytest.approx(10000, rel=0.05) and n[0] == pytest.approx(5000, rel=0.05)
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [0.0])


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/\r\nx", "<p>ä</p>"), (2, "http://b", "<p>ä</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e", "WARC/1.1\r\n\r\n" * 3), (2, "http://b", "<p>ä</p>"), (6, "http://f", "z" * 300000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(i, largest.get(h or "", i))
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert got == Counter((i, len((h or "").encode()), digest(h), "response" if i == largest[h or ""] else "revisit", None if i == largest[h or ""] else largest[h or ""]) for i, _, h in pages)
    assert warc.round_trip(df.limit(0)).count() == 0
    path = f"file://{tmp_path}/archive"
    warc.write(df, path, "none")
    rows = warc.read(spark, path, split_bytes=1)
    assert rows.filter("record_type = 'revisit'").count() == 2 and rows.filter("content_length > 1000").count() == 1 and rows.filter("record_id in ('<urn:record:5>')").first().payload == b"WARC/1.1\r\n\r\n" * 3
    assert warc.read(spark, path, payload=False).filter("payload is not null").count() == 0
    reader = warc.WarcReader({"files": "[]"})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response")])) == [] and reader.wanted


def test_mixing(docs, empty, rows):
    got = mixing.score(docs, top=20).collect()
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    tokens = [(i, [*WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), None]) for i, t in rows]
    counts = Counter(w for i, own in tokens if train(i) for w in own)
    total, kinds = sum(counts.values()), len(counts)
    base = sorted((i if i is not None else -1, not train(i), len(own), sum(counts[w] > 0 for w in own), round(sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own), 6)) for i, own in tokens)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == base
    assert all(r.train_tokens == total and r.score < 0 and np.isfinite(r.score) and r.bits_per_byte > 0 for r in got)
    assert mixing.score(empty).count() == 0


def plain_model(rows, code, weights):
    """The model of `mixing` word by word: logarithms of probabilities by row."""
    low = lambda t: WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    key = lambda w: int(words.hashes(words.Lanes(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0])
    listed = {int(k): int(i) for k, i in zip(code.keys, code.order)}
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    way = lambda s: list(zip(code.way[code.begin[s] : code.begin[s] + code.size[s]].tolist(), code.bit[code.begin[s] : code.begin[s] + code.size[s]].tolist()))

    def row_of(past, rows):
        x = np.array([sum(b << 8 * k for k, b in enumerate(past))], np.uint64)
        return int((words.mixed(x * words.STEP + np.uint64(rows)) >> np.uint64(65 - rows.bit_length()))[0])

    def coded(text):
        """(symbol, first row, second row, pair of words before or None) of what is coded."""
        own, out, topic = low(text), [], mixing.OFTEN
        for i, w in enumerate([*own, None]):
            symbol = code.end if w is None else listed.get(key(w), code.escape)
            out.append((symbol, "first", ("topic", topic), (own[i - 1] if i else None, own[i - 2] if i > 1 else None)))
            if symbol == code.escape:
                for k, b in enumerate([*w, 32]):
                    past = [w[k - j] for j in range(1, 5) if k >= j]
                    out.append((code.words + b, ("two", row_of(past[:2], mixing.ROWS[0])), ("four", row_of(past, mixing.ROWS[1])), None))
            elif w is not None and code.often[symbol] >= 0:
                topic = int(code.often[symbol])
        return out

    every = [coded(t) for _, t in rows]
    seen, next_of = defaultdict(Counter), defaultdict(Counter)
    for (doc, _), own in zip(rows, every):
        for symbol, first, second, pair in own if train(doc) else []:
            seen["first"][symbol] += pair is not None
            for context in (first, second):
                for node, bit in way(symbol) if context != "first" else []:
                    seen[context][(node, bit)] += 1
            if pair:
                next_of[pair][symbol] += 1

    def odds(context, node):
        if context == "first":
            return int(code.first_odds[node])
        zero, one = seen[context][(node, 0)], seen[context][(node, 1)]
        backed = context[0] == "topic"
        p = 1 / (1 + np.exp(-float(mixing.VALUE[code.first_odds[node]]))) if backed else 0.5
        m = mixing.BACKING if backed else 2 * mixing.PRIOR
        logit = np.log((one + m * p) / (zero + m * (1 - p)))
        return int(np.clip(np.rint(logit * 4), -32, 31)) + 32 | int(np.digitize(zero + one, [1, 4, 40])) << 6

    out = []
    for (doc, _), own in zip(rows, every):
        mine = defaultdict(Counter)
        for symbol, *_, pair in own:
            mine[pair][symbol] += train(doc)
        w, total = weights.astype(np.float64).copy(), 0.0
        for at in range(0, len(own), mixing.BLOCK):
            step, n = np.zeros_like(w), np.zeros(w.shape[1])
            for symbol, first, second, pair in own[at : at + mixing.BLOCK]:
                likely, sure = None, 0
                known = next_of[pair].most_common() if pair else []
                best = [(c - mine[pair][s], -i, s) for i, (s, c) in enumerate(sorted(known, key=lambda x: (-x[1], x[0]))[:2])]
                if best and max(best)[0] > 0:
                    count, _, likely = max(best)
                    rest = sum(next_of[pair].values()) - sum(mine[pair].values()) - count
                    sure = int(np.digitize(count, [2, 3, 6])) * 3 + (0 if rest == 0 else 1 if rest <= count else 2)
                agree = likely is not None
                for depth, (node, bit) in enumerate(way(symbol)):
                    second_odds = odds(second, node)
                    said = 0.0
                    gate = (0 if symbol < code.words else mixing.GATES - 4) + (second_odds >> 6)
                    if agree:
                        said = 1.0 if way(likely)[depth][1] else -1.0
                        gate = 4 + (sure * 4 + 0) * 4 + int(mixing.STEPS_OF_DEPTH[depth]) + (second_odds >> 6)
                        agree = way(likely)[depth][1] == bit
                    x = np.array([mixing.VALUE[odds(first, node)], mixing.VALUE[second_odds], said, 1.0])
                    p = 1 / (1 + np.exp(-float(w[:, gate] @ x)))
                    total += np.log(p if bit else 1 - p)
                    step[:, gate] += (bit - p) * x
                    n[gate] += 1
            w += step * mixing.OWN_RATE / (n + mixing.OWN_PRIOR)
        out.append(total / np.log(10))
    return out


def test_mixing_equals_a_plain_model(spark, rows, monkeypatch):
    some = [f"{R.choice(VOCABULARY)} {R.choice('pqrst')}{R.randrange(60)}" for _ in range(60)]
    many = [(i, " ".join(R.choice(some) for _ in range(R.randint(1, 400)))) for i in range(200, 230)]
    made = [*rows, *many, (300, many[3][1]), (301, many[4][1])]
    held = {}

    def weights(chunks, code, tables, share, real=mixing.fit_weights):
        held["code"], held["weights"] = code.value, real(chunks, code, tables, share)
        return held["weights"]

    monkeypatch.setattr(mixing, "fit_weights", weights)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in made], "doc_id long, text string, chunk string, at int")
    monkeypatch.setattr(mixing, "CHUNK_BYTES", 30000)
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.score)
    got = sorted(map(key, mixing.score(docs.repartition(3), top=150).collect()))
    code = held["code"]
    sizes = code.size[: code.words].astype(float)
    assert sum(2.0**-sizes) == pytest.approx(1) and len({(c, s) for c, s in zip(code.code[: code.words].tolist(), sizes.tolist())}) == code.words
    assert np.abs(held["weights"] - np.array(mixing.START)[:, None]).max() > 0.2
    plain = plain_model(made, code, held["weights"])
    expected = sorted((i if i is not None else -1, len(WORD.findall((t or "").encode())) + 1, s) for (i, t), s in zip(made, plain))
    assert [x[:2] for x in got] == [x[:2] for x in expected]
    assert np.abs(np.array([a[2] - b[2] for a, b in zip(got, expected)])).max() < 2e-3
    # The same rows in another order, in chunks of another size, with counts in two steps.
    monkeypatch.setattr(mixing, "CHUNK_BYTES", 4000)
    assert got == sorted(map(key, mixing.score(docs.repartition(5, "text"), top=150, salt_words=4000).collect()))


def test_toxicity(spark, docs, empty):
    clean = [(i, passage(40)) for i in range(300)]
    bad = [(1000 + i, " ".join(passage(6) + " " + R.choice(["moronic", "idiots", "scummy"]) for _ in range(4))) for i in range(300)]
    labels = [(i, 1, int(i >= 1000)) for i, _ in [*clean, *bad]]
    df = spark.createDataFrame([*clean, *bad, (5000, None), (5001, passage(6) + " idiotz " + passage(5) + " idiotz moronicc")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 5000]
    assert len(held) > 50 and np.mean([r.predicted == int(r.doc_id >= 1000) for r in held]) > 0.95 and 0 <= got[5000].score < 1 and got[5001].score > got[5000].score
    none = toxicity.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(none) == docs.count() and {r.score for r in none} == {0.0}


def test_toxicity_with_a_very_long_text(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    used = [i for i in range(400) if fold(i)]
    first = min(used, key=lambda doc: (doc * 0x9E3779B97F4A7C15) % 2**64)
    made = [(i, passage(40) if i % 2 else " ".join(passage(6) + " " + R.choice(["moronic", "idiots"]) for _ in range(4))) for i in range(400) if i != first] + [(first, passage(40000))]
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i, _ in made], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(made, "doc_id long, text string")
    model = toxicity.fit(df, labels, limit=150_000)
    got = [r for r in toxicity.score(df, model).collect() if r.held_out]
    assert len(got) > 50 and np.mean([r.predicted == 1 - r.doc_id % 2 for r in got]) > 0.95
    found = {1: (0, b"x" * 90), 2: (1, b"y" * 10), 3: (0, b"x" * 9), 4: (1, b"y" * 200)}
    assert toxicity.fitting([1, 2, 3, 4], found, 100) == [2, 3] and toxicity.fitting([1, 4], found, 20) == [1, 4] and toxicity.fitting([1, 3, 2], {i: found[i] for i in (1, 2, 3)}, 109) == [1, 3, 2]


@pytest.mark.parametrize("widths", [(8, 32), (1, 32)])
def test_exact(docs, empty, rows, widths):
    made = [exact.normalise((t or "").encode()) for _, t in rows]
    assert made == [re.sub(rb"[\x20\x09-\x0D]+", b" ", (t or "").encode()) for _, t in rows]
    groups = defaultdict(list)
    for (doc, _), x in zip(rows, made):
        groups[x].append(doc)
    least = lambda x: min((d for d in groups[x] if d is not None), default=None)
    got = exact.deduplicate(docs, widths).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((doc, least(x), len(groups[x]), hashlib.sha256(x).hexdigest()) for (doc, _), x in zip(rows, made))
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact.deduplicate(empty).count() == 0


def test_chunks():
    text = passage(9000).encode()
    assert b"".join(exact.chunks(text)) == text and all(exact.LEAST <= len(c) <= exact.MOST for c in list(exact.chunks(text))[:-1])
    assert len(set(exact.chunks(text)) & set(exact.chunks(b"some words first " + text))) > 3


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts(docs, empty, rows, rule):
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    got = Counter((r.doc_id, r.section, r.begin, r.end, r.n_tokens, r.n_crossing, r.doc_tokens) for r in tokencounts.count(docs, RANKS, public_tokenizers.PATTERN, rule=rule).collect())
    expected = Counter()
    for doc, text in rows:
        text = text or ""
        ids = codec.encode(text)
        spans, at = [], 0
        for line in text.split("\n") if text else [""]:
            end = min(len(text), at + len(line) + 1)
            if end > at or not text:
                spans.append((at, end))
            at = end
        owner = [i for i, (a, b) in enumerate(spans) for _ in range(b - a)]
        chars = [i for i, c in enumerate(text) for _ in c.encode()]
        n, crossing, byte = Counter(), Counter(), 0
        for token in ids:
            width = codec.widths[token]
            own = [owner[c] for c in range(chars[byte], chars[byte + width - 1] + 1)]
            byte += width
            to = own[0] if rule == "first" else own[-1] if rule == "last" else max(sorted(set(own)), key=own.count)
            n[to] += 1
            crossing[to] += own[0] != own[-1]
        expected.update((doc, i, a, b, n[i], crossing[i], len(ids)) for i, (a, b) in enumerate(spans))
    assert got == expected and tokencounts.count(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_media(docs, empty, rows):
    got = media.round_trip(docs).collect()
    pad = lambda t: (t or "").encode() + b" " * (-len((t or "").encode()) % 192 or (192 if not t else 0))
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == Counter((i, len((t or "").encode()), len(pad(t)), hashlib.sha256(pad(t)).hexdigest(), zlib.crc32(pad(t)[-16:])) for i, t in rows)
    assert media.samples(media.png(bytes(range(192)) * 3)) == bytes(range(192)) * 3 and media.round_trip(empty).count() == 0
    with pytest.raises(ValueError):
        media.samples(media.png(bytes(192))[:-20] + b"x" * 20)


def test_interleaving(spark):
    html = '<body><p>One <b>two</b></p><script>no()</script><img src="digest:%s" alt="A"><figure><img src="u"><figcaption>Cap &amp; tion</figcaption></figure>tail' % ("0" * 64)
    parts = [(p["kind"], p["text"], p["ref"], p["caption"]) for p in media.parts(html)]
    assert parts == [("text", "One two", None, None), ("image", None, "digest:" + "0" * 64, "A"), ("image", None, "u", "Cap & tion"), ("text", "tail", None, None)]
    pages = media.sequences(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    store = spark.createDataFrame([("0" * 64, 7)], "digest string, payload_bytes int")
    found = media.resolve(pages, store, "page_id").orderBy("position").collect()
    assert [(r.position, r.caption, r.payload_bytes) for r in found] == [(1, "A", 7), (2, "Cap & tion", None)]


def test_mixing_shuffles_no_more_for_more_salts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_BYTES", 3000)
    docs = spark.createDataFrame([(i, passage(120)) for i in range(150)], "doc_id long, text string").repartition(6, "doc_id").cache()
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, none, context._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    scores, sizes = [], []
    tokens = mixing.score(docs).first().train_tokens
    for salts in (4, 16, 64):
        before = written()
        scores.append(sorted((r.doc_id, r.score) for r in mixing.score(docs, salt_words=tokens // (salts - 1)).collect()))
        sizes.append(written() - before)
    assert scores[0] == scores[1] == scores[2] and sizes[2] < 1.5 * sizes[0]


def test_mixing_fits_every_bit_of_all_training_texts(spark, monkeypatch):
    """Of all folds but the held-out one, and a chunk sends no more lists than there are tasks to send them to."""
    rows = [(i, passage(R.randint(0, 300))) for i in range(60)]
    held, lists = {}, []

    def weights(*given, real=mixing.fit_weights):
        held["code"] = given[1].value
        return real(*given)

    def fit(cell, n, real=mixing.fit):
        held["bits"] = int(n.sum())
        return real(cell, n)

    def followers_lists(*given, real=mixing.followers_lists):
        made = real(*given)
        lists.append(made.groupBy("chunk").count().agg({"count": "max"}).first()[0])
        return made

    for name, f in (("fit_weights", weights), ("fit", fit), ("followers_lists", followers_lists)):
        monkeypatch.setattr(mixing, name, f)
    monkeypatch.setattr(mixing, "CHUNK_BYTES", 9000)
    mixing.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), top=30).count()
    code = held["code"]
    key = lambda w: int(words.hashes(words.Lanes(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0])
    listed = {int(k): int(i) for k, i in zip(code.keys, code.order)}
    bits = 0
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for w in WORD.findall(text.lower().encode()):
                symbol = listed.get(key(w), code.escape)
                bits += int(code.size[symbol]) + (sum(int(code.size[code.words + b]) for b in [*w, 32]) if symbol == code.escape else 0)
            bits += int(code.size[code.end])
    assert held["bits"] == bits
    n = mixing.common.partitions(spark)
    assert max(lists) <= 1 << (n - 1).bit_length()
