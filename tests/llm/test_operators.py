"""Every operator against brute force on a small table of odd rows: nulls, empty and long texts, ties, repeated rows,
empty tables, and extra columns whose names clash with the operators' own."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revgraph.llm import bpe, common, embedding_dedup, exact_dedup, html_extract, jaccard, packing, sharding, suffix_dedup, toxicity, warc
from revgraph.llm.common import components, ranked, tokenizer_path

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp string, digest string, key string, n int, id string, bytes string, piece int, start int, score int"


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 120, 700]))) for _ in range(25)]
    texts = []
    for _ in range(160):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [None, "", " ", "one", "One", "ONE two", "É", "é", "<|endoftext|> a <|startoftext|>", "x" * 3000, "ab" * 900, "long " * 20_000, base[3], base[3].upper(), texts[5], texts[5]]
    return [(i, t) for i, t in enumerate(texts)] + [(len(texts) - 1, texts[5])]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "f", "d", "k", 1, "i", "b", 2, 3, 4) for i, t in rows], DDL).repartition(5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def lower(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("bits", [64, 6])
def test_exact_dedup(docs, nothing, rows, bits):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = sorted((i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), hashlib.sha256(lower(t)).hexdigest()) for i, t in rows)
    assert sorted(tuple(r)[:5] for r in exact_dedup.duplicates(docs, bits).collect()) == want  # few bits: fingerprints collide
    assert exact_dedup.duplicates(nothing).count() == 0


def test_exact_dedup_keeps_one(docs, rows):
    out = exact_dedup.keep_one(docs)
    assert out.columns == docs.columns
    left = out.collect()
    assert sorted(lower(r.text) for r in left) == sorted({lower(t) for _, t in rows})
    best = {}
    for i, t in rows:
        best[lower(t)] = max(i, best.get(lower(t), -1))
    assert all(r.doc_id == best[lower(r.text)] for r in left)


def test_exact_dedup_null_ids(spark):
    d = spark.createDataFrame([(None, "a"), (None, "A"), (None, "b"), (3, "b")], "doc_id long, text string")
    assert sorted((r.text.lower(), r.doc_id) for r in exact_dedup.keep_one(d).collect()) == [("a", None), ("b", 3)]


def test_filter_merge_is_lossless():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50, 200) << 58 for _ in range(3)]
    merged = collections.Counter()
    blocks = collections.defaultdict(list)
    for p in parts:
        for b, r, c in exact_dedup.build_filter(p.astype(np.int64), 4):
            blocks[b].append((r, c))
    for b, x in blocks.items():
        for r, c in zip(*exact_dedup.merge_filters(x), strict=True):
            merged[b << 60 | int(r)] += int(c)
    assert merged == collections.Counter(int(x) & (1 << 64) - 1 for p in parts for x in p)
    assert list(exact_dedup.build_filter(np.zeros(0, np.int64), 4)) == []


def brute_removals(texts, w):
    found = collections.Counter(b[i : i + w] for b in texts for i in range(len(b) - w + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - w + 1):
            if found[b[i : i + w]] > 1:
                gone[i + 1 : i + 1 + w] = True
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "gram", "hot"), [(400, 64, 20_000), (40, 8, 3)])
def test_suffix_dedup(docs, nothing, rows, window, gram, hot):
    short = [(i, t) for i, t in rows if len(t or "") < 50_000]
    want = sorted((i, *x) for (i, _), x in zip(short, brute_removals([(t or "").encode() for _, t in short], window), strict=True))
    got = suffix_dedup.removals(docs.where("text is null or length(text) < 50000"), window, gram, hot)
    assert sorted(map(tuple, got.collect())) == want
    assert suffix_dedup.removals(nothing).count() == 0


def test_suffix_dedup_cleans(docs, rows):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    left = out.collect()
    assert len(left) == len(rows)
    made = {r.doc_id: r for r in suffix_dedup.removals(docs).collect()}
    assert all(len((r.text or "").encode()) <= made[r.doc_id].n_bytes - made[r.doc_id].n_removed for r in left)
    assert all(r.n_chars == len(r.text) for r in left if r.text is not None and made[r.doc_id].n_removed)


def test_suffix_order_is_a_suffix_array():
    data = np.frombuffer(b"mississippi banana mississippi", np.uint8)
    starts = np.arange(len(data))
    s = suffix_dedup.Suffixes(data, starts, np.full(len(data), len(data)))
    assert s.order(np.zeros(len(data), np.int64)).tolist() == sorted(starts.tolist(), key=lambda i: bytes(data[i:]))


def vectors(rng):
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base + 0.12 * rng.normal(size=base.shape) for _ in range(6)])
    rows = [(i, x[i].astype(np.float32).tolist(), int(i % 3), "x", 1) for i in range(len(x))]
    return rows + [(500, rows[0][1], 0, "x", 1), (501, None, 1, "x", 1), (502, [0.0] * 16, 1, "x", 1), (503, [float("nan")] * 16, 1, "x", 1), (504, [None] * 16, 1, "x", 1), (505, rows[1][1], None, "x", 1), (506, [1.0, 2.0], 1, "x", 1), (507, [2.0, 4.0], 1, "x", 1), (508, [], 1, "x", 1), (509, [float("inf")] * 16, 1, "x", 1)]


def test_embedding_dedup(spark):
    rows = vectors(np.random.default_rng(2))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, class_id string, weight int")

    def fine(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = {r[0]: np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) for r in rows if fine(r[1]) and r[2] is not None}
    label = {r[0]: r[2] for r in rows}
    root = {r[0]: r[0] for r in rows}
    links = collections.Counter()
    pairs = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        x, y = root[a], root[b]
        for k in root:
            if root[k] in (x, y):
                root[k] = min(x, y)
    assert len(pairs) > 100
    for probes, cell in ((4, 256), (4, 8)):
        got = embedding_dedup.near_duplicates(d, probes=probes, cell_rows=cell).collect()
        assert len(got) == len(rows)
        found = sum(r.n_links for r in got)
        assert 0.97 * 2 * len(pairs) <= found <= 2 * len(pairs)  # recall with small cells; one cell is exact
        if cell == 256:
            assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {k: (links[k], root[k], root[k] == k) for k in root}
    assert embedding_dedup.near_duplicates(d.limit(0)).count() == 0


def test_warc(spark):
    big = "<html>" + "é" * 120
    rows = [(5, "http://a/", big, "x"), (3, None, big, "x"), (9, "http://b/\r\nX: y", big, "x"), (1, "u", "tiny", "x"), (2, "u", "tiny", "x"), (4, "u", None, "x"), (7, "u", "", "x"), (3, None, big, "x"), (None, "u", big, "x"), (8, "u", "WARC/1.1\r\n\r\n" * 30, "x")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string, digest string")).collect()

    def want(i, h):
        raw = (h or "").encode()
        again = len(raw) >= 100 and h == big and i != 3
        return (i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None)

    assert sorted(map(tuple, got), key=str) == sorted((want(i, h) for i, _, h, _ in rows), key=str)
    assert warc.archive(spark.createDataFrame(rows[:0], "page_id long, url string, html string, digest string")).count() == 0


def test_warc_records_are_single_frames(spark, tmp_path):
    import zstandard

    w = warc.Writer(str(tmp_path), 1000, 4096)
    data = [warc.record(i, "http://x/", b"payload %d" % i * 20, "d", None) for i in range(50)]
    for d in data:
        w.add(d)
    path, n, _ = w.close()
    raw = open(path, "rb").read()
    size = int.from_bytes(raw[4:8], "little")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    rest, seen = raw[8 + size :], []
    while rest:
        one = d.decompressobj()
        seen.append(one.decompress(rest))
        rest = one.unused_data
    assert n == 50 and seen == data


WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                if x != y:
                    for k in root:
                        if root[k] in (x, y):
                            root[k] = min(x, y)
    return sets, root


@pytest.mark.parametrize("turn", [32, 1])
def test_jaccard(docs, nothing, rows, monkeypatch, turn):
    monkeypatch.setattr(jaccard, "ROUND", turn)
    monkeypatch.setattr(jaccard, "BLOCK", 32 if turn == 32 else 4)  # pieces cut into block pairs
    sets, root = brute_components(rows)
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), root[i]) for i in sets}
    assert any(len(t or "") and root[i] != i for i, t in rows)
    assert jaccard.near_duplicates(nothing).count() == 0


def test_jaccard_shared_pieces(spark):
    """Pieces met within a batch, across batches, or both, against counting them all in one place."""
    common = "one line that a great many of the documents share word for word"
    texts = [(i, f"{common} {i} {i % 7} {i % 5} tail of some words {i % 3}" if i % 4 else f"alone {i} x{i} y{i} z{i} w{i}") for i in range(300)]
    texts += [(1000 + i, " ".join(f"w{(i % 4) * 1000 + k}" for k in range(150))) for i in range(9)]
    held: dict = {}
    for doc_id, text in texts:
        values = jaccard.shingle_sets(pa.array([text]))[0]
        for band, pieces, d in jaccard.bands(len(values)):
            made = jaccard.sketch(values, band, pieces)
            for p in made.tolist():
                held.setdefault(p, []).append((doc_id, band, len(made) - d))
    want = sorted(row for rows in held.values() if len(rows) > 1 for row in rows)
    for parts in (1, 5):
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
        got = jaccard.shared_pieces(docs).collect()
        assert sorted((r["id"], r["band"], r["need"]) for r in got) == want
        by_piece: dict = {}
        for r in got:
            by_piece.setdefault(r["piece"], []).append((r["id"], r["band"], r["need"]))
        assert sorted(map(sorted, by_piece.values())) == sorted(sorted(rows) for rows in held.values() if len(rows) > 1)


def test_jaccard_keeps_one(docs, rows):
    _, root = brute_components(rows)
    left = jaccard.keep_one(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.select("doc_id").collect()} == set(root.values())


def test_sketch_bound():
    rng = np.random.default_rng(4)
    for n in (70, 300, 900, 3000):
        a = np.sort(rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
        b = np.sort(np.concatenate([a[: int(0.87 * n)], rng.integers(0, (1 << 64) - 1, int(0.1 * n), dtype=np.uint64)]))
        common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert 100 * common >= 75 * union
        shared = [(band, p, d) for band, p, d in jaccard.bands(len(a)) if band in {x[0] for x in jaccard.bands(len(b))}]
        assert shared
        assert any(len(np.intersect1d(jaccard.sketch(a, x, p), jaccard.sketch(b, x, p))) >= len(jaccard.sketch(a, x, p)) - d > 0 for x, p, d in shared)


def test_packing(docs, nothing, rows):
    encode = packing.Encoder()
    want = {i: np.append(encode(t or ""), 1) for i, t in rows}
    got = packing.pack(docs).collect()
    assert sum(r.length for r in got) == sum(len(want[i]) for i, _ in rows)
    seqs = collections.defaultdict(list)
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length].astype("<u4")
        assert (zlib.crc32(ids.tobytes()), len(want[r.doc_id])) == (r.ids_crc32, r.doc_tokens)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    fill = []
    for s in sorted(seqs):
        at = 0
        for offset, n in sorted(seqs[s]):
            assert offset == at
            at += n
        fill.append(at)
    assert all(x == 2048 for x in fill[:-1]) and fill[-1] <= 2048
    assert packing.pack(nothing).count() == 0


def test_token_ids_match_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    e = packing.Encoder()
    for x in ["", " a", "don't  stop\n\n", "Éß 12,3 ²½", "a<|endoftext|>b", "中文 🙂", "\x85\x1c ​", "tab\t\tx", "“q” – …"]:
        assert e(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_hilbert_curve_is_continuous():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    order = np.argsort(packing.hilbert_key(cells, 3))
    assert len(set(packing.hilbert_key(cells, 3).tolist())) == 512
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_sharding(docs, nothing, rows):
    got = sharding.shard_by_bytes(docs, 7, 0.2).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    shards = collections.defaultdict(list)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        shards[r.shard].append(r)
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in shards.values())
    total, most = sum(r.size for r in got), max(r.size for r in got)
    assert all(abs(sum(x.size for x in shards[s]) - total / 7) <= most + 0.2 * total / 7 for s in range(7))
    assert sharding.shard_by_bytes(nothing).count() == 0


def test_prefix_sums_are_global(spark):
    out, n, total = ranked(spark.range(1000).select((F.col("id") * 7 % 13).alias("k"), "id", (F.col("id") % 5).alias("size")), ["k", "id"], "size", 6)
    got = sorted(out.collect(), key=lambda r: r.row_index)
    assert (n, total) == (1000, 2000) and [r.row_index for r in got] == list(range(1000)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    assert [r.start for r in got] == [0, *np.cumsum([r.size for r in got])[:-1].tolist()]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    root = {x: x for e in edges for x in e}
    for a, b in edges * 1:
        x, y = root[a], root[b]
        for k in root:
            if root[k] in (x, y):
                root[k] = min(x, y)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def toxic_corpus():
    rng = random.Random(9)
    words = ["w" + str(i) for i in range(200)]
    out, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if bad:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["vile", "nasty", "awful"]))
        out.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return out, labels


def test_toxicity(spark):
    out, marks = toxic_corpus()
    d = spark.createDataFrame([*out, (900, None), (901, ""), (None, "vile nasty awful vile"), (5, out[5][1])], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, y) for i, y in marks], "doc_id long, quality int, toxic int")
    got = toxicity.scored(d, labels).collect()
    assert len(got) == 904
    held = {r.doc_id: r for r in got if r.held_out}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == marks[i][1] for i, r in held.items() if i < 900]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    left = toxicity.keep_clean(d, labels)
    assert left.columns == d.columns and not any("vile" in (r.text or "") and "nasty" in r.text and "awful" in r.text for r in left.collect())
    spans = toxicity.offending(d, labels).where("doc_id is null").first()
    assert [(s["start"], s["end"]) for s in spans.spans] == [(0, 4), (5, 10), (11, 16), (17, 21)]
    assert {r.score for r in toxicity.scored(d, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.scored(d.limit(0), labels).count() == 0


def test_marginals_match_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    m = toxicity.Model({"a": 1}, rng.normal(size=2), rng.normal(size=(2, 2)), rng.normal(size=2), constant=None)
    ids, first = rng.integers(0, 2, 9).astype(np.int32), np.array([1, 0, 0, 0, 1, 0, 0, 1, 0], bool)
    want = np.zeros(9)
    for lo, hi in ((0, 4), (4, 7), (7, 9)):
        total, part = 0, np.zeros(hi - lo)
        for tags in itertools.product((0, 1), repeat=hi - lo):
            s = m.start[tags[0]] + sum(m.emission[ids[lo + i]] * t for i, t in enumerate(tags)) + sum(m.transition[a, b] for a, b in zip(tags, tags[1:], strict=False))
            total += np.exp(s)
            part += np.exp(s) * np.array(tags)
        want[lo:hi] = part / total
    assert np.allclose(m.marginals(ids, first), want)


def test_bpe(docs, nothing, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_decode(docs).collect())) == sorted(want)
    assert bpe.encode_decode(nothing).count() == 0


def test_bpe_streams_with_its_lookahead():
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), bpe.WordBpe.get(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(1)
    for _ in range(6):
        x = "".join(rng.choice(["ing", "tion", "the", "a", "ss", "lll", "erst"]) for _ in range(1500))
        assert list(w.transducer.encode((w.symbols[b] for b in x.encode()), w.suffix, block=16)) == t.encode(x, add_special_tokens=False).tokens
    for x in ["ΣΑΣ İx ǅ", "a\x1cb\x85c", "é 🙂 ²½ don't I'LL", "<|endoftext|>A<|startoftext|>", "中文　x"]:
        ids, decoded = w.encode(x)
        e = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == e and decoded.decode() == t.decode(e, skip_special_tokens=False)
    d = bpe.Decoder(w.tokens, readable=True)
    ids = np.frombuffer(w.encode("grüße 🙂 welt")[0], "<u4").tolist()
    assert "".join(d.feed([i]) for i in ids).split() == ["grüße", "🙂", "welt"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- c <p>no</p> --><div class="ad">Buy</div><article><h1>A &amp; B&nbsp;x</h1><p><b>One<br>two</b>   three<p>Four &lt;5&gt; <a href="#" title="a>b">six</a></p><div class="share-bar">Share<div>it</div></div><ul><li>seven<li>eight</ul>
<form><input>q</form><section id="comments"><p>I agree</p></section></article><aside>Side</aside><footer>&copy; f</footer></body></html>"""


def test_html(spark):
    outer = "<div>We use this site to tell you about all of our many products today</div>"
    plain = [f"<body>{outer}<p>Unique words of page number {i} are here and nowhere else</p></body>" for i in ("one", "two", "three")]
    rows = [(1, "http://h/a", PAGE, "x"), (2, "http://h/b", None, "x"), (3, None, "", "x"), (4, "http://h/c", PAGE[:-60], "x"), (5, "http://h/e", "<p>a < b & c", "x"), (5, "http://h/e", "<p>a < b & c", "x")] + [(10 + i, f"https://k.example/{i}", p, "x") for i, p in enumerate(plain)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(d).collect()}
    article = "A & B x\nOne two three\nFour <5> six\nseven\neight"
    assert got[1].text == got[4].text == article
    assert got[2].text == got[3].text == "" and got[3].url is None
    assert got[5].text == "a < b & c" and html_extract.extract(d).where("page_id = 5").count() == 2
    assert [got[10 + i].text for i in range(3)] == [f"Unique words of page number {i} are here and nowhere else" for i in ("one", "two", "three")]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(d.limit(0)).count() == 0


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def html_texts(spark, pages):
    d = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_extract.extract(d).orderBy("page_id").collect()]


def test_html_editions_of_an_article_stay(spark):
    rng = random.Random(8)
    outer, quote = sentence(rng, 14), sentence(rng, 8)
    article = sentence(rng, 60)
    teasers = [sentence(rng, 9) for _ in range(2)]
    exact = [("http://a/1", f"<p>{article}</p>"), ("http://a/2", f"<p>{article}</p>")]
    lone = [(None, f"<p>{article}</p><p>{sentence(rng, 20)}</p>") for _ in range(2)]
    own = [sentence(rng, 30) for _ in range(4)]
    mixed = [(f"http://b/{i}", f"<div>{outer}</div><p>{article}</p><p>{t}</p>") for i, t in enumerate(teasers)] + [(f"http://b/x{i}", f"<div>{outer}</div><p>{t}</p>" + (f"<p>{quote}</p>" if i < 2 else "")) for i, t in enumerate(own)]
    got = html_texts(spark, exact + lone + mixed)
    assert got[:2] == [article] * 2
    assert all(g.startswith(article + "\n") and len(g) > len(article) + 20 for g in got[2:4])
    assert got[4:6] == [f"{article}\n{t}" for t in teasers]
    assert got[6:] == [t + (f"\n{quote}" if i < 2 else "") for i, t in enumerate(own)]


def test_html_judges_marked_articles(spark):
    rng = random.Random(9)
    notice, story = sentence(rng, 12), sentence(rng, 50)
    own = [sentence(rng, 30) for _ in range(4)]
    pages = [(f"http://c/{i}", f"<article><h1>Same head</h1><p>{t}</p><p>{notice}</p></article>") for i, t in enumerate(own)]
    pages += [(f"http://c/s{i}", f"<main><p>{story}</p><p>{notice}</p><p>Seen {i}</p></main>") for i in range(3)]
    got = html_texts(spark, pages)
    assert got[:4] == [f"Same head\n{t}" for t in own]
    assert got[4:] == [f"{story}\nSeen {i}" for i in range(3)]


@pytest.mark.parametrize("keep", [common.cut, lambda df: common.stored(df, "sizes")])
def test_batches_of_long_texts_are_small(spark, keep):
    """A stored step never gets thousands of whole texts at once; the caller's setting stays."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    got = keep(texts.mapInArrow(sizes, "n long, size long")).collect()
    assert sum(r["n"] for r in got) == 200 and max(r["size"] for r in got) <= common.BATCH_BYTES + 1_000_000
    assert spark.conf.get(key) == before
