"""Rows on which weak hashes, keys that repeat, clashing column names or one very common value would go wrong."""

import os
import random
import time

import numpy as np
import pytest

from revgraph.llm import bpe, common, exact_dedup, html_extract, jaccard, suffix_dedup
from tests.llm.test_operators import brute_components, brute_removals


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_words_with_much_structure_differ(spark):
    one = [thue_morse(1024, p) for p in ("ab", "cd", "ef", "gh", "ij", "kl")]
    two = [thue_morse(1024, p[::-1]) for p in ("ab", "cd", "ef", "gh", "ij", "kl")]
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(one).upper())]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    data = np.frombuffer("".join(one[:1] + two[:1]).encode(), np.uint8)
    h = common.PrimeHash(data, 3).of(np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] != h[1]


def test_hashes_of_parts_do_not_depend_on_their_place():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    twice = np.concatenate([data[:7], data, data])
    starts = rng.integers(0, 4000, 300)
    ends = starts + rng.integers(0, 600, 300)
    h = common.PrimeHash(twice, 5)
    assert (h.of(starts + 7, ends + 7) == h.of(starts + 5007, ends + 5007)).all()
    w = common.word_hashes(twice, starts + 7, ends + 7)
    assert (w == common.word_hashes(twice, starts + 5007, ends + 5007)).all()
    parts = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len(set(w.tolist())) == len(set(parts))
    a, b = rng.integers(0, (1 << 61) - 1, (2, 500), dtype=np.uint64)
    assert [int(x) for x in common.times_p(a, b)] == [int(x) * int(y) % ((1 << 61) - 1) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_components_over_several_tasks(spark, monkeypatch, limit):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1001 + i) for i in range(150)] + [(i, i + 1) for i in range(2000, 2100)] + [(5, 5)]
    monkeypatch.setattr(common, "EDGES_A_TASK", limit)
    got = {r.id: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_of_repeated_ids(spark, hot):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    common_part = text(300)
    texts = [(7, text(90) + common_part + text(700)), (7, text(2500)), (7, common_part + text(20)), (8, text(500) + common_part), (None, text(60) + common_part + text(5)), (None, text(400)), (9, None), (9, ""), (7, None)]
    texts += [(10 + i, text(30) + common_part[i : 200 + i] + text(30)) for i in range(9)]  # one anchor, many different spans
    want = brute_removals([(t or "").encode() for _, t in texts], 60)
    got = suffix_dedup.removals(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), 60, 8, hot).collect()
    key = lambda r: (r[0] is None, r[0], *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((i, *w) for (i, _), w in zip(texts, want, strict=True)), key=key)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_suffix_dedup_of_common_passages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(suffix_dedup, "COMMON", 4)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", broadcast)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    very, some = text(300), text(200)
    texts = [(i, text(50) + very * (1 + i % 3) + text(80) + some * (i < 3)) for i in range(12)] + [(20, "ab" * 400), (21, text(500))]
    want = brute_removals([t.encode() for _, t in texts], 60)
    got = suffix_dedup.removals(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), 60, 8).collect()
    assert sorted(map(tuple, got)) == sorted((i, *w) for (i, _), w in zip(texts, want, strict=True))


def brute_texts(pages):
    """The rule of the host suffix array, by counting every run of every page in one place."""
    run, share = html_extract.RUN, html_extract.CORE
    parsed = [(html_extract.host_of(u), html_extract.blocks(h or "")) for u, h in pages]
    held_by = {}  # block: contents
    text_of = {}
    for host, parts in set((h, tuple(p)) for h, p in parsed if h):
        for i, (text, n) in html_extract.judged_blocks(host, list(parts)).items():
            held_by.setdefault(i, set()).add((host, parts))
            text_of[i] = (host, text.split(" "), n)
    runs, levels = {}, {}
    for i, (host, words, n) in text_of.items():
        for k in range(len(words) - run + 1):
            runs.setdefault((host, *words[k : k + run]), set()).add(i)
    for i, (host, words, n) in text_of.items():
        found = [runs[(host, *words[k : k + run])] for k in range(len(words) - run + 1)]
        found = sorted(sum(len(held_by[b]) for b in bs) for bs in found) or [len(held_by[i])]
        levels[i] = next(h for seen, h in enumerate(found, 1) if seen >= share * n) if n else 1
    base = {}
    for c in {c for cs in held_by.values() for c in cs}:
        blocks = sorted((levels[i], text_of[i][2]) for i in html_extract.judged_blocks(c[0], list(c[1])) if text_of[i][2])
        total, seen = sum(n for _, n in blocks), 0
        base[c] = 1
        for h, n in blocks:
            seen += n
            if seen >= share * total:
                base[c] = h
                break
    every = set((h, tuple(p)) for h, p in parsed if h)
    hosts = {}
    for c in every:
        hosts[c[0]] = hosts.get(c[0], 0) + 1 / base.get(c, 1)
    enough = lambda host, cs: sum(1 / base[c] for c in cs) >= (2 if hosts[host] < 3.5 else 3) - 1e-6
    out = []
    for host, parts in parsed:
        kept, texts = html_extract.judged(parts), []
        for zone, text in parts:
            i = html_extract.block_id(host, True, text)
            if zone != kept:
                continue
            if host and i in html_extract.judged_blocks(host, parts) and enough(host, held_by[i]):
                continue
            words, gone = text.split(" "), set()
            for k in range(len(words) - run + 1 if host else 0):
                bs = runs[(host, *words[k : k + run])]
                if len(bs) > 1 and enough(host, set().union(*(held_by[b] for b in bs))):
                    gone.update(range(k, k + run))
            left = [w for k, w in enumerate(words) if k not in gone]
            if left:
                texts.append(" ".join(left))
        out.append("\n".join(texts))
    return out


def test_html_against_counting(spark):
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    notices, stories, quotes = [words(n) for n in (8, 11, 30, 5)], [words(60) for _ in range(5)], [words(9) for _ in range(4)]
    pages = []
    for k in range(110):
        host = rng.choice(["a", "a", "a", "b", "c", "d", "e", "f"])
        parts = [words(rng.randint(1, 40)) for _ in range(rng.randint(0, 3))]
        parts += rng.sample(notices, rng.randint(0, 2)) + rng.sample(quotes, rng.randint(0, 1))
        if rng.random() < 0.3:
            parts.append(rng.choice(stories).replace("a", rng.choice("ax"), rng.randint(0, 2)))
        if rng.random() < 0.3:
            parts.append(words(6) + " " + rng.choice(notices) + " " + words(7))
        rng.shuffle(parts)
        body = "".join(f"<p>{x}</p>" for x in parts)
        frame = f"<nav>{words(2)}</nav><div class='ad'>{rng.choice(notices)}</div>"
        pages.append((rng.choice([f"http://{host}/{k}", f"https://{host}/{k}#x"]), rng.choice([f"{frame}<article>{body}</article>", f"<body>{frame}{body}</body>"])))
    pages += [pages[3], ("http://a/copy", pages[3][1]), (None, pages[4][1]), ("", "<p>x</p>"), ("http://a/n", None), ("http://lone/1", pages[5][1])]
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)] + [(0, *pages[0])]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_extract.extract(d).collect()}
    want = dict(enumerate(brute_texts(pages)))
    assert got == want
    assert any(len(want[i]) < len(html_extract.main_text(html_extract.host_of(u), html_extract.blocks(h or ""), {})) for i, (u, h) in enumerate(pages))


def test_clashing_columns_stay(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(6)]
    texts = [(i, base[i % 6] + (" x" if i >= 6 else "")) for i in range(12)] + [(0, base[0]), (0, base[0].upper())]
    names = ["gone_id", "gone_raw", "_normal", "twice_id", "cut_key", "CUT_RANGES", "cut_words", "odd", "id", "doc_key", "ranges", "component_id", "fp", "sha", "group_size"]
    docs = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in names]) for i, t in texts], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    near = jaccard.keep_one(docs)
    exact = exact_dedup.keep_one(docs)
    clean = suffix_dedup.without_repeats(docs, 120, 16, words=12)
    for made in (near, exact, clean):
        assert made.columns == docs.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in made.collect() for c in names)
    assert clean.count() == len(texts)
    _, root = brute_components(texts)
    assert {r.doc_id for r in near.collect()} == {i for i, _ in texts if root[i] == i}
    kept = [(r.doc_id, r.text.lower()) for r in exact.collect()]
    assert sorted(kept) == sorted({(max(i for i, u in texts if u.lower() == t.lower()), t.lower()) for _, t in texts})


@pytest.mark.parametrize("segment", [1, 40, 1 << 16])
def test_bpe_in_segments(segment):
    tokenizers = pytest.importorskip("tokenizers")
    path = common.tokenizer_path("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.WordBpe(path)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(5)
    n = own.transducer.lookahead
    long = ["".join(rng.choice(["ing", "tion", "er", "a", "ss", "lll", "th"]) for _ in range(3 * n))[:size] for size in (n - 1, n, n + 1, 2 * n, 2 * n + 1, 3 * n)]
    texts = ["", " ", "e\u0301 e\n\u0301 a\u0301\tb <|endoftext|>x <|endoftext|> <|end oftext|>", " ".join(long), "Don't  we'll\r\n\x0b\x0c ... 12 x\u3000y\u00a0z", long[0] + "<|startoftext|>" + long[1], "ΑΣ Σ\nΑΣ", "".join(rng.choice(["a", " ", "\n", "é", "<|", "endoftext", "|>", "'s", "1", "中"]) for _ in range(3000))]
    for x in texts:
        ids, decoded = own.encode(x, segment)
        want = library.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode() == library.decode(want, skip_special_tokens=False)


def test_anchors_hold_little_beside_the_texts():
    """Long buffers are hashed in segments small enough for the workers of a pipeline, which hold other models too."""
    import tracemalloc

    import numpy as np

    from revgraph.llm import suffix_dedup

    data = np.random.default_rng(1).integers(97, 123, 2 << 20, dtype=np.uint8)
    offsets = np.arange(0, len(data) + 1, 2048)
    suffix_dedup.anchors(data[: 1 << 16], offsets[:33])  # powers are made
    tracemalloc.start()
    suffix_dedup.anchors(data[: 1 << 20], offsets[:513])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20


def test_entries_that_are_routed_compress():
    """With many buckets every entry has a few keys, so its own bytes count: they are mostly zeros in a row."""
    import zlib

    made = np.array([(i * 3 - (i % 50 == 0), -2147483648 if i == 7 else 60 + i % 90, 1 + i % 3, 7 + i % 3) for i in range(1000)], common.ENTRY)
    packed = common.packed_entries(made)
    assert (common.unpacked_entries(packed) == made).all() and not len(common.unpacked_entries(common.packed_entries(made[:0])))
    plain = b"".join(made[c].tobytes() for c in common.ENTRY.names)
    assert 2 * len(zlib.compress(packed, 1)) < len(zlib.compress(plain, 1))


def test_html_leaves_no_dead_shuffles(spark, monkeypatch):
    """Shuffle files of ended steps go before the next large step writes its own: they were most of op10's disk."""
    folders = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs())

    def shuffled():
        files = [f"{d}/{x}" for top in folders for d, _, names in os.walk(str(top)) for x in names if x.startswith("shuffle_") and x.endswith(".data")]
        return {x: os.path.getsize(x) for x in files if os.path.exists(x)}

    known, most, left, cut, stored = shuffled(), [0], [], common.cut, common.stored
    own = lambda: sum(n for x, n in shuffled().items() if x not in known)

    def cut_and_seen(df):
        out = cut(df)
        most[0] = max(most[0], own())
        return out

    def stored_later(df, name):
        if name == "suffixes":
            until = time.time() + 5
            while own() > 0.25 * most[0] and time.time() < until:  # the cleaner works beside the driver
                time.sleep(0.1)
            left.append(own())
        return stored(df, name)

    monkeypatch.setattr(html_extract, "cut", cut_and_seen)
    monkeypatch.setattr(html_extract, "stored", stored_later)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, f"http://h{i % 2}/{i}", f"<p>{' '.join(rng.choices(words, k=900))}</p><p>one two three four five six seven eight {i}</p>") for i in range(80)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_extract.extract(d).count() == 80
    assert most[0] > 100_000
    assert left[0] <= 0.25 * most[0]
