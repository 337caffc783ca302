"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from lociform.llm import chat, classifier, langid, media, oracle, packing, quality_rules, queries, simhash, sptok, tokens, warc, wavelet

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, " ", "a", "one two three", "Ünï çødé \U0001f600 ​x", "tab\tline\n\n  end ", "<|endoftext|> ### </turn> \\", "x" * 5000, "the cat " * 900, "a\x00b\x01c\x1cd\x85e f", "don't we'll I'm"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, SCORE string, Ids int, key string"


def frame(spark, texts=TEXTS):
    rows = [(None if i == 3 else i, t, None if i % 3 else "en", None, None, "mine", 5, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[4]], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    as_rows = lambda d: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert as_rows(got) == as_rows(want)


# chat


def test_chat_round_trip(spark):
    turns = [(1, i, r, t) for i, (r, t) in enumerate([("user", "\\### Assistant: </turn> ok"), ("assistant", "\U0001f600 :: </turn>\n###\\"), ("a: b", ""), ("assistant", None), ("assistant", "  lead")])]
    df = spark.createDataFrame([*turns, (None, None, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert chat.parse(out[1]["formatted"]) == [(r, t or "") for _, _, r, t in turns]
    learned = [chat.unescape(out[1]["formatted"][s["start"] : s["end"]]) for s in out[1]["loss_spans"]]
    assert learned == ["\U0001f600 :: </turn>\n###\\", "  lead"]
    assert out[2]["n_turns"] == 2 and out[None]["n_turns"] == 1 and len(out[1]["loss_mask"]) == len(out[1]["input_ids"])


def test_chat_segments_equal_the_whole(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"text {i} " * 5) for i in range(40)], "conv_id long, turn long, role string, text string")
    whole, cut = chat.format_conversations(df).first(), chat.format_conversations(df, segment_chars=200).orderBy("segment").collect()
    assert len(cut) > 5 and [x for r in cut for x in r["input_ids"]] == whole["input_ids"] and "".join(r["formatted"] for r in cut) == whole["formatted"]
    assert chat.digests(chat.format_conversations(df, segment_chars=200)).first() == chat.digests(chat.format_conversations(df)).first()


# media


def test_payload_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 191, 192, 193, 5000, 192 * 1025, 192 * 33000):
        data = media.pad(rng.integers(0, 256, n, dtype=np.uint8).tobytes())
        p = media.decode_progressive(media.encode_payload(data))
        assert media.payload_of(p) == data and len(data) % 192 == 0
        assert p.rgb().shape == (p.height, p.width, 3)


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def data(self):
        b = np.array(self.bits + [1] * (-len(self.bits) % 8), np.uint8)
        return np.packbits(b).tobytes().replace(b"\xff", b"\xff\x00")


def general_jpeg(planes, sizes, width, height, quant):
    """A plain progressive encoder of known coefficients: subsampled chroma, two bands, two approximation steps."""
    import struct

    every = sorted(range(256))
    # 8-bit codes for 255 symbols, 9-bit codes for the last two
    spec = {8: every[:254], 9: every[254:]}
    dc, ac = media.table(0, spec), media.table(0x10, spec)
    codes = media.huffman(dc[5:])[2]
    out = [b"\xff\xd8", media.marker(0xDB, b"\0" + bytes(quant)), media.marker(0xC2, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sizes))), dc, ac]

    def value(w, v):
        s = abs(v).bit_length()
        return s, (v if v > 0 else v + (1 << s) - 1)

    hmax, vmax = max(h for h, _ in sizes), max(v for _, v in sizes)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    units = [(k, y * v + b, x * h + a) for y in range(down) for x in range(across) for k, (h, v) in enumerate(sizes) for b in range(v) for a in range(h)]
    w, was = BitWriter(), [0, 0, 0]
    for k, r, c in units:
        v = planes[k][r, c, 0] >> 1
        s, bits = value(w, int(v) - was[k])
        was[k] = int(v)
        w.put(*codes[s])
        w.put(bits, s)
    out += [media.marker(0xDA, b"\x03\x01\0\x02\0\x03\0\0\0\x01"), w.data()]
    w = BitWriter()
    for k, r, c in units:
        w.put(int(planes[k][r, c, 0]) & 1, 1)
    out += [media.marker(0xDA, b"\x03\x01\0\x02\0\x03\0\0\0\x10"), w.data()]
    for k, (h, v) in enumerate(sizes):
        rows, cols = -(-(-(-height * v // vmax)) // 8), -(-(-(-width * h // hmax)) // 8)
        for lo, hi in ((1, 5), (6, 63)):
            for low in (1, 0):
                w = BitWriter()
                for r in range(rows):
                    for c in range(cols):
                        block = planes[k][r, c].astype(int)
                        now = [int(np.sign(x)) * (abs(int(x)) >> low) for x in block]
                        old = [int(np.sign(x)) * (abs(int(x)) >> 1) if not low else 0 for x in block]
                        run, held = 0, []
                        fresh = [i for i in range(lo, hi + 1) if now[i] and not old[i]]
                        for i in range(lo, hi + 1):
                            if old[i]:
                                held.append(abs(now[i]) & 1)
                            elif now[i]:
                                s, bits = (1, int(now[i] > 0)) if not low else value(w, now[i])
                                w.put(*codes[run << 4 | s])
                                w.put(bits, s)
                                for b in held:
                                    w.put(b, 1)
                                run, held = 0, []
                            else:
                                run += 1
                                if run == 16 and any(f > i for f in fresh):
                                    w.put(*codes[0xF0])
                                    for b in held:
                                        w.put(b, 1)
                                    run, held = 0, []
                        if not fresh or fresh[-1] < hi:
                            w.put(*codes[0])
                            for b in held:
                                w.put(b, 1)
                out += [media.marker(0xDA, bytes([1, k + 1, 0, lo, hi, 0x01 if low else 0x10])), w.data()]
    return b"".join([*out, b"\xff\xd9"])


def test_general_progressive_scans():
    rng = np.random.default_rng(5)
    sizes, width, height = [(2, 2), (1, 1), (1, 1)], 37, 21
    planes = []
    for h, v in sizes:
        p = np.zeros((2 * v, 3 * h, 64), int)
        p[..., 0] = rng.integers(-60, 60, p.shape[:2])
        ac = rng.integers(-9, 10, (*p.shape[:2], 63)) * (rng.random((*p.shape[:2], 63)) < 0.2)
        p[..., 1:] = ac
        planes.append(p)
    got = media.decode_progressive(general_jpeg(planes, sizes, width, height, [3] * 64))
    for k, c in enumerate(got.components):
        assert (c["coef"][: c["rows"], : c["cols"]] == planes[k][: c["rows"], : c["cols"]]).all()
    rgb = got.rgb()
    assert rgb.shape == (height, width, 3)
    # one luma sample by the plain double sum
    u = np.arange(8)
    natural = np.zeros(64)
    natural[media.zigzag()] = planes[0][0, 0] * 3
    scale = np.where(u == 0, np.sqrt(1 / 8), 0.5)
    basis = lambda x: scale * np.cos((2 * x + 1) * u * np.pi / 16)
    y = basis(2) @ natural.reshape(8, 8) @ basis(5) + 128
    chroma = []
    for k in (1, 2):
        n = np.zeros(64)
        n[media.zigzag()] = planes[k][0, 0] * 3
        chroma.append(basis(1) @ n.reshape(8, 8) @ basis(2))
    want = np.clip(np.rint(np.clip(np.rint(y), 0, 255) + 1.402 * (np.clip(np.rint(chroma[1] + 128), 0, 255) - 128)), 0, 255)
    assert abs(int(rgb[2, 5, 0]) - want) <= 1


def test_media_rows(spark):
    df = media.decode(media.store(frame(spark), F.col("text").cast("binary")), payload=True)
    got = df.select("doc_id", "text", "payload", "rgb", "width", "height").collect()
    assert all(bytes(r["payload"]) == media.pad((r["text"] or "").encode()) and len(r["rgb"]) == 3 * r["width"] * r["height"] for r in got)
    assert media.decode(media.store(empty(spark), F.col("text").cast("binary"))).count() == 0
    with pytest.raises(ValueError):
        media.decode_progressive(b"\xff\xd8\xff\xda")


# classifier


def test_quality_held_out(spark):
    got = queries.op3_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.9
    assert got["score"].between(0, 1).all()


def test_quality_edges(spark):
    model = classifier.fit(np.zeros((0, classifier.N_FACTS + classifier.BUCKETS), np.float32), np.zeros(0, int), 0.3)
    got = classifier.score(frame(spark), model).collect()
    assert len(got) == len(TEXTS) + 2 and all(r["score"] == pytest.approx(0.5) for r in got)
    assert classifier.score(empty(spark), model).count() == 0


# packing


def test_packing_is_whole(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.path_of("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = frame(spark)
    got = packing.pack(docs, length=64, partitions=2).toPandas()
    for i, text in enumerate(TEXTS):
        if i not in (3, 4):
            mine = got[got["id"] == i].sort_values("start")
            ids = np.frombuffer(b"".join(mine["ids"]), "<u4").tolist()
            assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 1]
            assert mine["start"].tolist() == np.concatenate([[0], np.cumsum(mine["length"])[:-1]]).tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == np.concatenate([[0], np.cumsum(s["length"])[:-1]]).tolist() and s["length"].sum() <= 64
    assert sum(s["length"].sum() < 64 for _, s in got.groupby("sequence_id")) <= 2
    assert packing.pack(empty(spark)).count() == 0


def test_hilbert_is_a_curve():
    n = 8
    points = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_index(points, 3)
    assert sorted(key.tolist()) == list(range(n**3))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


# simhash


def plain_fingerprint(text, width=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps, distance):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_documents(spark):
    rows = documents(spark).orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = plain_components(fps, 2)
    got = {r["doc_id"]: r for r in queries.op5_simhash(spark, SF).collect()}
    for i, r in enumerate(rows):
        assert got[r["doc_id"]]["fingerprint"] == f"{fps[i]:016x}" and got[r["doc_id"]]["component_id"] == rows[want[i]]["doc_id"]


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_links_in_large_buckets(spark, distance):
    rng = np.random.default_rng(9)
    made = {0}
    for base in (0xDEADBEEF12345678, 0x0F0F00FF12345678):
        for _ in range(60):
            x = base
            for b in rng.choice(26, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            made.add(x)
    fps = sorted(made)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance)
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    want = plain_components(fps, distance)
    group = lambda root: {frozenset(signed[i] for i in range(len(fps)) if root[i] == r) for r in set(root)}
    assert group([found.get(x, x) for x in signed]) == group(want)


def test_bit_counts():
    h = np.random.default_rng(2).integers(0, 1 << 63, (101, 3), dtype=np.uint64)
    want = [[sum(int(x) >> b & 1 for x in h[:, k]) for b in range(64)] for k in range(3)]
    assert simhash.bit_counts(h).tolist() == want


def test_near_copies_stay_once(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    base = [[word() for _ in range(300)] for _ in range(6)]
    rows = []
    for k, words in enumerate(base):
        for c in range(4):
            w = list(words)
            for i in rng.choice(300, c, replace=False):
                w[i] = word()
            rows.append((10 * k + c, " ".join(w)))
    rows += [(100, None), (101, ""), (102, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x"))
    kept = sorted(r["doc_id"] for r in simhash.keep_first(df).collect())
    assert kept == [0, 10, 20, 30, 40, 50, 100]
    assert simhash.keep_first(empty(spark)).count() == 0
    assert simhash.link_components(empty(spark)).count() == 0
    assert len({r["fp"] for r in simhash.link_components(frame(spark)).collect() if r["id"] in (0, 1, 2)}) == 1


@pytest.mark.parametrize("crossed", [simhash.CROSSED, 2])
def test_near_copies_in_large_buckets(spark, monkeypatch, crossed):
    """A text with many copies that resemble it but not each other, and pairs just above the threshold; with a low limit buckets are split."""
    monkeypatch.setattr(simhash, "CROSSED", crossed)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))

    def copy(words, n):
        w = list(words)
        for i in rng.choice(len(w), n, replace=False):
            w[i] = word()
        return w

    star = [word() for _ in range(400)]
    texts = [star, *(copy(star, 6) for _ in range(250))]
    for _ in range(60):
        pair = [word() for _ in range(400)]
        texts += [pair, copy(pair, 7)]
    texts += [[word() for _ in range(400)] for _ in range(100)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {find(i) for i in range(len(texts))}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_first(df).collect()}
    assert len(kept - want) <= 0.05 * len(want) and not want - kept


def test_more_links_join_components(spark):
    rng = np.random.default_rng(6)
    scratch, found, root = simhash.Scratch(spark, "test"), None, list(range(120))
    find = lambda i: i if root[i] == i else find(root[i])
    for k in range(3):
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (30, 2))]
        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        found = simhash.joined(found, spark.createDataFrame(pairs, "a long, b long"), scratch, f"found-{k}")
        got = {r["node"]: r["root"] for r in found.collect()}
        assert [got.get(i, i) for i in range(120)] == [find(i) for i in range(120)] and found.count() == len(got)


def test_recall_of_near_copies(spark):
    """Pairs planted at a known similarity of their sets of five-word shingles, by replacing the last words."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), 7))
    rows, want = [], {}
    for k, s in enumerate(np.repeat([0.82, 0.85, 0.9], 60)):
        n = 240
        changed = round(n * (1 - s) / (1 + s))  # of n shingles each, n - changed are shared
        base = [word() for _ in range(n + 4)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: n + 4 - changed] + [word() for _ in range(changed)]))]
        want.setdefault(float(s), []).append(2 * k + 1)
    kept = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {s: sum(i not in kept for i in ids) / len(ids) for s, ids in want.items()}
    print("recall by similarity", found)
    assert found[0.82] >= 0.9 and found[0.85] >= 0.95 and found[0.9] >= 0.98 and not any(2 * k not in kept for k in range(180))


# shards


def test_wavelet_matrix_against_lists():
    rng = np.random.default_rng(6)
    ids = (rng.zipf(1.5, 3000) % 500).astype(np.uint32)
    m = wavelet.load(wavelet.dump(np.arange(3), np.array([10, 20, 3000]), ids))[2]
    assert m.decode().tolist() == ids.tolist()
    assert [m.access(i) for i in range(0, 3000, 37)] == ids[::37].tolist()
    for token in (0, 1, 2, 7, 499, 70000):
        places = np.flatnonzero(ids == token)
        assert m.count(token) == len(places) and m.count(token, 100, 900) == ((places >= 100) & (places < 900)).sum()
        assert [m.find(token, k) for k in range(0, len(places), 29)] == places[::29].tolist()
    assert wavelet.WaveletMatrix.build(np.zeros(0, np.uint32)).decode().tolist() == []


def test_shards_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.path_of("word_bpe_49k.json"))
    t.encode_special_tokens = True
    plain = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]
    got = wavelet.read_shards(wavelet.write_shards(frame(spark), shard_tokens=700)).orderBy("start").collect()
    assert [r["id"] for r in got] == [None, 0, 1, 2, 4, 4, 4, *range(5, len(TEXTS))]
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at and ids == plain(TEXTS[3] if r["id"] is None else TEXTS[r["id"]])
        at += len(ids)
    assert wavelet.read_shards(wavelet.write_shards(empty(spark))).count() == 0


# language


def test_forward_sums_all_segmentations():
    pieces = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}
    p = np.random.default_rng(0).random((5, 2))

    def brute(word, k):
        return 1.0 if not word else sum(p[pieces[word[:n]], k] * brute(word[n:], k) for n in range(1, 4) if word[:n] in pieces and n <= len(word))

    for word in ("a", "abab", "abaabba", "ab" * 40):
        got = langid.forward(langid.edges(word, pieces, 3), p)
        if len(word) < 20:
            assert got == pytest.approx([np.log(brute(word, k)) for k in range(2)])
        assert np.isfinite(got).all()


def segmentations(word, pieces):
    """All ways to cut a word into pieces, or characters that no piece covers (None)."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        k = pieces.get(word[:n])
        if k is not None or n == 1:
            for rest in segmentations(word[n:], pieces):
                yield [k, *rest]


PIECES = {p: i + 2 for i, p in enumerate(["a", "b", "ab", "ba", "aba", "▁", "▁a", "bb", "\U0001f600"])}


def weigh(cut, p):
    return float(np.prod([langid.UNSEEN if k is None else p[k] for k in cut]))


def test_lattices_against_all_segmentations():
    rng = np.random.default_rng(5)
    words = ["a", "abab", "▁abba", "xax", "b", "", "▁aba\U0001f600ab", "abab", "xyz"]
    p = rng.random((max(PIECES.values()) + 2, 3)) / 10
    p[-1] = langid.UNSEEN
    lattices = langid.Lattices(PIECES)
    got = lattices.scores(words, p)
    want = [[np.log(sum(weigh(cut, p[:, k]) for cut in segmentations(w, PIECES))) for k in range(3)] for w in words]
    assert got == pytest.approx(np.array(want))
    assert got[1] == pytest.approx(langid.forward(langid.edges("abab", PIECES, 3), p))
    counts, expected = rng.random(len(words)), np.zeros(lattices.size)
    for w, n in zip(words, counts, strict=True):
        cuts = list(segmentations(w, PIECES))
        whole = sum(weigh(c, p[:, 0]) for c in cuts)
        for c in cuts:
            for k in c:
                if k is not None:
                    expected[k] += n * weigh(c, p[:, 0]) / whole
    assert lattices.expect(words, counts, p[:, 0]) == pytest.approx(expected)
    assert langid.Lattices({}).scores(["ab"], np.full((1, 2), langid.UNSEEN)) == pytest.approx(np.full((1, 2), 2 * np.log(langid.UNSEEN)))


def made_up(n_texts=40, seed=3):
    """A model with random probabilities, texts of random words (some long, some without a letter), and what they score by the definition."""
    rng = np.random.default_rng(seed)
    pieces = langid.load_pieces(langid.default_vocabulary())
    model = langid.LanguageModel(["x", "y", "z"], (rng.random((max(pieces.values()) + 1, 3)) ** 6).astype(np.float32), langid.default_vocabulary())
    letters = np.array(list("abcdeéü中ßж"))
    words = ["".join(rng.choice(letters, int(rng.integers(1, 12)))) for _ in range(300)] + ["²", "abc" * 30, "é" * 33, "d" * 32]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(n_texts)]
    p = np.vstack([model.probabilities.astype(float), np.full((1, 3), langid.UNSEEN)])
    longest = max(map(len, pieces))
    alone = {w: langid.forward(langid.edges("▁" + w, pieces, longest), p) if w != "²" else np.zeros(3) for w in words}
    best = ["xyz"[int(np.argmax(sum(alone[w] for w in t.split())))] if set(t.split()) != {"²"} else "und" for t in texts]
    return model, texts, best


def test_scorer_against_the_definition(monkeypatch):
    model, texts, best = made_up()
    scorer = langid.Scorer(model)
    langs, scores = scorer(texts)
    assert langs == best and scorer(texts) == (langs, scores)
    assert tuple(x[::-1] for x in langid.Scorer(model)(texts[::-1])) == (langs, scores)
    one = langid.Scorer(model)
    assert [one([t]) for t in texts] == [([a], [b]) for a, b in zip(langs, scores, strict=True)]
    for name, value in (("CACHED_WORDS", 50), ("CACHED_CHARS", 300), ("CACHED_VALUES", 60), ("BLOCK", 7)):
        with monkeypatch.context() as m:
            m.setattr(langid, name, value)
            small = langid.Scorer(model)
            assert [small([t]) for t in texts * 2] == [([a], [b]) for a, b in zip(langs, scores, strict=True)] * 2
            assert small(texts) == (langs, scores)  # one slice above the memory's size
    with monkeypatch.context() as m:
        m.setattr(langid, "SUMMED", 4)
        assert langid.Scorer(model)(texts)[0] == langs


def test_language_query_against_the_definition(spark):
    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where(langid.fold("doc_id", 3) != 1))
    p = np.vstack([model.probabilities.astype(float), np.full((1, len(model.languages)), langid.UNSEEN)])
    pieces = langid.load_pieces(model.vocabulary)
    longest, memory = max(map(len, pieces)), {}

    def brute(text):
        words = [w for w in langid.WORD.findall((text or "").lower()) if any(map(str.isalpha, w))]
        if not words:
            return "und"
        for w in words:
            if w not in memory:
                memory[w] = langid.forward(langid.edges("▁" + w, pieces, longest), p)
        return model.languages[int(np.argmax(sum(memory[w] for w in words)))]

    want = {r["doc_id"]: brute(r["text"]) for r in docs.collect()}
    got = queries.op7_language(spark, sf).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == want and len(got) == len(want)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)


def test_every_language_keeps_its_words(spark):
    rows = [("zz", f"zeta{chr(97 + i)} ombra zed") for i in range(20)] + [("aa", " ".join(f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "lmnr"))] * 3 + [("unspaced", "ж" * 90)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = langid.train(df, max_types=30)
    assert model.languages == ["aa", "unspaced", "zz"]
    got = langid.predict(df, model).select("lang", "lang_pred").distinct().collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)
    words = {(r["lang"], r["word"]): r["n"] for r in langid.count_words(df, "text", "lang").collect()}
    assert words[("unspaced", "ж" * 33)] == 1 and words[("unspaced", "▁" + "ж" * 32)] == 1 and words[("zz", "▁zed")] == 20


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97


def test_language_edges(spark):
    model = langid.train(documents(spark), docs_per_language=5)
    got = {r["doc_id"]: r for r in langid.predict(frame(spark), model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2)) and 0 < got[9]["score"] <= 1
    nothing = langid.train(empty(spark))
    assert {r["lang_pred"] for r in langid.predict(frame(spark), nothing).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


# rules


def test_rules_edges(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    texts = [*TEXTS, prose, prose + "\nHome | News | Sport | Help", prose + "\n" + "### $$$ *** " * 60, prose + "\nAll rights reserved, subscribe now " * 40]
    got = {r["doc_id"]: r for r in quality_rules.clean_lines(frame(spark, texts)).collect()}
    n = len(TEXTS)
    assert got[n]["kept"] and got[n + 1]["kept"] and got[n + 1]["clean_text"] == prose and got[n + 1]["n_lines_removed"] == 1
    assert not got[n + 2]["kept"] and not got[n + 3]["kept"] and not got[0]["kept"] and got[1]["n_words"] == 0
    assert got[9]["n_repeat_words"] == 1800 and got[9]["base_failed"]
    assert quality_rules.clean_lines(frame(spark, texts)).where("kept").count() == 2  # filters above give the same rows
    assert quality_rules.clean_lines(empty(spark)).count() == 0


def test_rules_judge_a_line_by_its_length(spark):
    prose, more = (" ".join(f"{w}{i}" for i in range(400)) for w in ("word", "more"))
    texts = [f"{prose} > a > b | c {more}", f"{prose} our cookie jar {more}", f"{prose}\nHome > News > Sport > Help\nThis site uses a cookie to subscribe you"]
    got = {r["doc_id"]: r for r in quality_rules.clean_lines(frame(spark, [*texts, *TEXTS])).collect()}
    assert all(got[i]["kept"] and got[i]["n_lines_removed"] == 0 for i in (0, 1))
    assert got[2]["kept"] and got[2]["n_lines_removed"] == 2 and got[2]["clean_text"] == prose


# archives


def test_archive_round_trip(spark):
    big, small = "é" * 600, "tiny"
    rows = [(1, "u1", big), (5, "u\n5", big), (3, None, big), (7, "u7", small), (8, "u8", small), (9, "u9", None), (None, "n", "x" * 1500), (5, "u\n5", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("type", F.lit("mine"))
    got = warc.assemble(warc.read_archive(warc.write_archive(df, file_bytes=2000))).collect()
    assert len(got) == len(rows) and all(len(r["requests"]) == len(r["metadata"]) == 1 for r in got)
    kinds = sorted((r["page_id"] or 0, r["response"]["type"]) for r in got)
    assert kinds == [(0, "response"), (1, "revisit"), (3, "revisit"), (5, "response"), (5, "revisit"), (7, "response"), (8, "response"), (9, "response")]
    for r in got:
        if r["response"]["type"] == "response":
            html = dict((i, h or "") for i, _, h in rows)[r["page_id"]]
            assert bytes(r["response"]["payload"]) == html.encode() and r["response"]["payload_sha1"] == hashlib.sha1(html.encode()).hexdigest()
    assert warc.assemble(warc.read_archive(warc.write_archive(df.limit(0)))).count() == 0


def test_assembly_follows_links(spark):
    rows = [("r1", "response", None), ("q1", "request", ["r1"]), ("m1", "metadata", ["q1"]), ("r2", "response", ["q2"]), ("q2", "request", None), ("m9", "metadata", ["lost"])]
    rows += [("r3", "revisit", None), ("m3", "metadata", ["r1", "r3", "r3"]), ("q3", "request", ["m3", "lost"]), ("r4", "response", ["q4", "m4"]), ("q4", "request", ["r1"]), ("m4", "metadata", [])]
    df = spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>")
    for c, t in (x.split(" ") for x in warc.RECORD.split(", ")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    got = {r["capture_id"]: r for r in warc.assemble(df).collect()}
    of = lambda r, kind: [x["record_id"] for x in got[r][kind]]
    assert of("r1", "requests") == ["q1", "q3", "q4"] and of("r1", "metadata") == ["m1", "m3"]
    assert of("r2", "requests") == ["q2"] and of("r3", "requests") == ["q3"] and of("r3", "metadata") == ["m3"]
    assert of("r4", "requests") == ["q4"] and of("r4", "metadata") == ["m4"] and set(got) == {"r1", "r2", "r3", "r4"}


def test_files_of_others(spark, tmp_path):
    """Repeated headers are all kept; a file that ends early gives what it holds and a row that says so."""
    a = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<r1>"), ("Content-Type", "application/http")], b"HTTP/1.1 200 OK\r\n\r\nbody")
    b = warc.record([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m1>"), ("WARC-Concurrent-To", "<r1>"), ("WARC-Concurrent-To", "<r2>")], b"page-id: x\r\n")
    files = {"whole": a + b, "cut": a + b[:-20], "other": b"not gzip", "none": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    manifest = spark.createDataFrame([(str(tmp_path / n), 2, 1) for n in files], warc.MANIFEST)
    rows = warc.read_archive(manifest).collect()
    assert sorted(r["target_uri"].rsplit("/", 1)[1] for r in rows if r["type"] == "unreadable") == ["cut", "other"]
    assert [r["concurrent_to"] for r in rows if r["type"] == "metadata"] == [["<r1>", "<r2>"]] and sum(r["type"] == "response" for r in rows) == 2


def test_revisits_of_shuffled_pages(spark):
    """Roles hold whatever the order in which the pages arrive, and every record of a copied file is still there."""
    rows = [(i, f"u{i}", "x" * (1000 + i % 3) if i % 4 else f"own {i}" * 300) for i in range(200)] + [(7, "u7", "x" * 1001)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = warc.assemble(warc.read_archive(warc.write_archive(df, file_bytes=1500))).collect()
    assert len(got) == len(rows) and {(r["page_id"], r["response"]["target_uri"]) for r in got} == {(i, u) for i, u, _ in rows}
    by_id = {r["capture_id"]: r for r in got}
    for r in got:
        html = rows[r["page_id"]][2]
        best = max(i for i, _, h in rows if h == html)
        if r["response"]["type"] == "response":
            assert r["page_id"] == best and bytes(r["response"]["payload"]) == html.encode()
        else:
            assert by_id[r["response"]["refers_to"]]["page_id"] == best and r["response"]["payload_sha1"] == hashlib.sha1(html.encode()).hexdigest()


# sentencepiece


def test_sentencepiece_matches_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.path_of("piece_bpe_32k.model"))
    texts = [*(t for t in TEXTS if t is not None), *(r["text"] for r in documents(spark).limit(60).collect())]
    m = sptok.Matcher()
    for text, ids in zip(texts, m.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(text)
        assert m.decode(ids.tolist()) == sp.decode(ids.tolist()) == text
    some = sp.encode("to be")
    assert m.decode([sp.bos_id(), *some, sp.eos_id()]) == sp.decode([sp.bos_id(), *some, sp.eos_id()])
    assert m.decode([*some, 10**7]).endswith("\ufffd") and m.decode([]) == ""
    out = sptok.decode(sptok.encode(frame(spark), decoded="once"))
    assert all(r["decoded"] == r["once"] == r["text"] for r in out.collect()) and sptok.encode(empty(spark)).count() == 0
    nulls = spark.createDataFrame([([None, 5],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] is None for r in sptok.decode(nulls).collect()] == [False, True, False]


def test_sentencepiece_forgets_parts(monkeypatch):
    """Ids stay those of the library when the memory is full, a text is one long part, or an index holds few characters."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.path_of("piece_bpe_32k.model"))
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)) for _ in range(12)] + ["ab" * 4000, "the cat " * 50]
    for name, value in (("HELD_PARTS", 40), ("INDEX_CHARS", 100), ("SHORT", 4), ("HELD_CHARS", 3)):
        with monkeypatch.context() as c:
            c.setattr(sptok, name, value)
            m = sptok.Matcher()
            for _ in range(2):
                for i in range(0, len(texts), 3):
                    assert [x.tolist() for x in m.encode(texts[i : i + 3])] == [sp.encode(t) for t in texts[i : i + 3]]


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = documents(spark).toPandas()
    assert set(out["doc_id"]) < set(docs["doc_id"])
    assert (out.groupby("doc_id")["length"].sum() == out.groupby("doc_id")["doc_tokens"].first()).all()
    kept = docs[docs["doc_id"].isin(out["doc_id"])]
    assert not kept["text"].duplicated().any()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, documents(spark).limit(0), SF)
        assert none.columns == documents(spark).columns and none.count() == 0


def test_pipeline_stages_keep_columns(spark):
    """Nulls in any column, repeated rows, and columns named like those that operators add."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    words = "the quick brown fox jumps over some lazy dogs while many birds sing their morning songs near old trees".split()
    long = [" ".join(rng.choice(words, 90)) for _ in range(6)]
    rows = [(i, t, "en", "s", 1, "mine", 7, "w", "p", 0.5, 3) for i, t in enumerate(long)]
    rows += [rows[0], (None, long[1], None, None, None, None, None, None, None, None, None), (9, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, clean_text string, lang_pred string, score double, row int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and out.drop("text", "n_chars").dtypes == df.drop("text", "n_chars").dtypes
        got = out.toPandas()
        assert set(got["kept"].dropna()) == {"mine"} and set(got["clean_text"].dropna()) == {"w"} and set(got["row"].dropna()) == {3}
        assert sorted(x for x in got["doc_id"].dropna()) == ([0, 1, 2, 3, 4, 5] if name == "near copies" else [0, 0, 1, 2, 3, 4, 5]) + ([9] if name == "near copies" else [])
    assert corpus_pipeline.packed(spark, df, SF).count() >= len(rows)


def test_fold_is_crc32(spark):
    got = spark.range(50).select("id", langid.fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_word_ids_of_any_white_space_and_latin_letters():
    from lociform.llm.tokens import WordBpe

    e, letters = WordBpe(), "aZéÉßÿøñ'.,!9\x1c\x1f"
    texts = [f"ab{c}cd{c}!{c}don{c}'t{c}́x" for c in map(chr, range(0x3001)) if c.isspace() or c in "\x1c\x1d"]
    texts += [" ".join(a + b + c for b in letters for c in letters) for a in letters]
    for text, ids in zip(texts, e.encode(texts, 2), strict=True):
        assert ids.tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 2]
