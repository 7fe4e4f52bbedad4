"""Each operator against a brute-force version on awkward documents."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from panelspark.llm import audio, bpe, exact_dedup, jaccard_join, mixing, pretokens, quality, sharding, substring_dedup, token_files, url_filters  # noqa: E402
from panelspark.llm import text as text_module  # noqa: E402

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def awkward() -> list[tuple[int, str | None, str | None]]:
    """Nulls, blanks, copies, near copies, shared passages, odd characters, one very long text, repeated rows."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    base = [r.choice(vocabulary) for _ in range(120)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows: list[tuple[int, str | None, str | None]] = [(0, None, None), (1, "", "a"), (2, " \t\n", "a"), (3, "one", "b"), (4, "One  two", "b"), (5, "one two", None)]
    for i in range(10, 40):
        words = list(base)
        for _ in range(i % 7):
            words[r.randrange(len(words))] = "new" + str(r.randrange(1000))
        rows.append((i, " ".join(words), "ab"[i % 2]))
    rows += [(i, " ".join(base), "hot") for i in range(40, 60)]
    rows += [(i, " \n".join(base), "hot") for i in range(60, 63)]
    for i in range(70, 90):
        rows.append((i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 300))) + (" " + passage if i % 3 == 0 else ""), "z"))
    rows.append((95, " ".join(r.choice(vocabulary) for _ in range(30_000)), "long"))
    rows += [(96, "it's we'LL 've\r\n\r\n x 12a'sb  日本語 \x1f\x85 ñ é <|endoftext|> 🙂", "odd"), (97, "!!! ''s  \t 's", "odd"), (98, "\x0b\x0c\x1c a\xa0b ", "odd")]
    rows += [(99, "repeated row of text", "rep")] * 2
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "x", 1.5) for i, t, s in awkward()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row string, score double").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, row string, score double")


def texts() -> list[tuple[int, str]]:
    return [(i, t or "") for i, t, _ in awkward()]


def test_bpe_equals_library_and_round_trips(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rows = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS).collect()
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert r["decoded"] == (r["text"] or "")
    sums = {r["doc_id"]: r for r in bpe.digests(docs, RANKS, PATTERN).collect()}
    for i, t in texts():
        ids = library.encode_ordinary(t)
        assert sums[i]["n_tokens"] == len(ids)
        assert sums[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert sums[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.digests(empty, RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumnRenamed("row", "ids"), RANKS, PATTERN)


def test_utf8_machine_equals_python_in_any_portions():
    r = random.Random(3)
    for _ in range(2000):
        raw = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xC0]) for _ in range(r.randint(0, 12)))
        machine, out, at = bpe.Utf8(), "", 0
        while at < len(raw):
            n = r.randint(1, 4)
            out += machine.feed(raw[at : at + n])
            at += n
        assert out + machine.end() == raw.decode("utf-8", "replace")


def test_decoded_text_comes_from_the_machine(monkeypatch):
    """In portions that cut characters; and what the machine changes, text and digest change with it."""
    texts = ["日本語 ñandú 🙂 " * 9, "", "plain", "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    run = lambda: list(bpe.decode_batches(bpe.encode_batches(iter([batch]), RANKS, PATTERN, "text", "ids"), RANKS, "ids", "decoded"))[0].column(2).to_pylist()
    for portion in (1, 2, 5, 1 << 14):
        monkeypatch.setattr(bpe, "PORTION", portion)
        assert run() == texts
        assert [bpe._digest(bpe.streamed(t.encode())) for t in texts] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    fed = bpe.Utf8.feed
    monkeypatch.setattr(bpe.Utf8, "feed", lambda self, data: fed(self, data).replace("p", "q"))
    assert run()[2] == "qlain" and bpe._digest(bpe.streamed(b"plain")) == hashlib.sha256(b"qlain").hexdigest()


def test_transducer_on_small_vocabulary():
    ranks = {bytes([c]): c for c in range(256)}
    for i, t in enumerate([b"ab", b"bc", b"abc", b"aa", b"aaa", b"ca", b"bca"]):
        ranks[t] = 256 + i
    machine = bpe.Transducer(ranks, most=10)
    r = random.Random(1)
    for _ in range(3000):
        t = bytes(r.choice(b"abc") for _ in range(r.randint(0, 15)))
        assert machine.encode(t) == machine.merged(t), t


def test_exact_dedup(docs, empty):
    for block in (16, 4096):
        rows = exact_dedup.decide(exact_dedup.numbered(docs), block=block).collect()
        norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in texts()]
        groups = collections.defaultdict(list)
        for i, t in norm:
            groups[t].append(i)
        want = sorted((i, min(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want
        assert sum(r["kept"] for r in rows) == len(groups)
        assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    assert exact_dedup.decide(exact_dedup.numbered(empty)).count() == 0


def test_substring_dedup(docs, empty):
    for window in (5, 35):
        own = [(i, WORD.findall(t)) for i, t in texts()]
        count = collections.Counter(tuple(w[p : p + window]) for _, w in own for p in range(len(w) - window + 1))
        want = []
        for i, w in own:
            gone = set()
            for p in range(len(w) - window + 1):
                if count[tuple(w[p : p + window])] > 1:
                    gone.update(range(p, p + window))
            want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
        got = [tuple(r) for r in substring_dedup.substring_dedup(docs, window=window).collect()]
        assert sorted(got) == sorted(want)
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, empty, k, percent):
    sets = {}
    for i, t in texts():
        w = WORD.findall(t.translate(LOW))
        sets[i] = frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = jaccard_join.jaccard_components(docs, k, percent).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, len(sets[i]), root(i)) for i, _ in texts())
    assert jaccard_join.jaccard_components(empty, k, percent).count() == 0


def test_tree_finds_all_links_of_near_sets():
    r = np.random.default_rng(4)
    for trial in range(20):
        base = r.integers(0, 1 << 63, 300).astype(np.uint64)
        sets = [np.unique(np.concatenate([r.permutation(base)[: 300 - r.integers(0, 25)], r.integers(0, 1 << 63, r.integers(0, 12)).astype(np.uint64)])) for _ in range(60)]
        left = None if trial % 2 else np.arange(60) < 30

        def linked(a, b):
            n = len(np.intersect1d(sets[a], sets[b]))
            return 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n)

        def classes(edges):
            p = list(range(60))
            for a, b in edges:
                x, y = p[a], p[b]
                p = [x if z == y else z for z in p]
            return [p.index(z) for z in p]

        pairs = [(a, b) for a in range(60) for b in range(a) if left is None or left[a] != left[b]]
        found = jaccard_join.links(sets, 90, left)
        assert all(linked(a, b) for a, b in found)
        assert classes(found) == classes([(a, b) for a, b in pairs if linked(a, b)])


@pytest.mark.parametrize(("tile", "k", "percent"), [(256, 3, 90), (6, 5, 80)])
def test_jaccard_of_large_components_and_hot_groups(spark, monkeypatch, tile, k, percent):
    """Chains, near copies of several sizes and a passage in most documents; tile 6 cuts components into leaves."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    r = random.Random(12)
    word = lambda: "w%d" % r.randrange(100_000)
    passage = [word() for _ in range(50)]
    rows = []
    for _ in range(3):
        text = [word() for _ in range(90)]
        for _ in range(25):  # a chain: neighbours are linked, its ends aren't
            text = list(text)
            text[r.randrange(len(text))] = word()
            rows.append(list(text))
    for size in (60, 80, 100):
        base = [word() for _ in range(size)]
        for _ in range(25):
            own = list(base)
            for _ in range(r.randint(0, 5)):
                own[r.randrange(size)] = word()
            rows.append(own + (passage if r.random() < 0.5 else []))
    rows += [[word() for _ in range(r.randint(5, 60))] + passage for _ in range(60)]
    r.shuffle(rows)
    data = [(i, " ".join(w)) for i, w in enumerate(rows)]
    sets = [frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) for w in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = jaccard_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), k, percent).collect()
    assert sorted(tuple(x) for x in got) == [(i, len(sets[i]), root(i)) for i in range(len(rows))]


def alike_words(n: int) -> tuple[str, str]:
    """Two different words of n letters whose polynomial hashes modulo 2 ** 64 agree whatever the base: Thue and Morse's and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_alike_words_are_told_apart(spark, n, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    from tokenizers import Tokenizer

    rows = [(i, " ".join([w] * 40)) for i, w in enumerate(alike_words(n))]
    rows += [(i + 2, " ".join(f"{w} tail{j}" for j in range(40))) for i, w in enumerate(alike_words(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(docs, RANKS, PATTERN).collect()} == {i: library.encode_ordinary(t) for i, t in rows}
    # in documents 0 and 1 windows repeat in the document itself; 2 and 3 share none
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs.where("doc_id >= 2")).collect()} == {2: 0, 3: 0}
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, 3, 90).collect()} == {i: i for i in range(4)}
    exact = Tokenizer.from_file(JSON)
    token_files.write(docs, str(tmp_path / "a"), JSON, PATTERN, 2)
    sums = {i: zlib.crc32(np.array(exact.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows}
    assert {r["doc_id"]: r["ids_crc32"] for r in token_files.read(spark, str(tmp_path / "a")).collect()} == sums


def test_words_of_windows_in_patterns_are_told_apart():
    """Windows of the same words in Thue and Morse's order and its complement, and in reverse."""
    r = np.random.default_rng(0)
    for n in (32, 35, 64, 1024):
        bits = np.array([bin(i).count("1") % 2 for i in range(n)])
        two = r.integers(0, 1 << 63, 2).astype(np.uint64)
        found = {int(text_module.window_hash(v, n, lane)[0]) for lane in (0, 1) for v in (two[bits], two[1 - bits], two[bits][::-1].copy(), np.sort(two[bits]))}
        assert len(found) == 2 * len({tuple(v) for v in (two[bits], two[1 - bits], two[bits][::-1], np.sort(two[bits]))})


def test_span_hash_tells_all_short_and_long_spans_apart():
    r = random.Random(9)
    spans = sorted({bytes(r.choice(b"\x00ab") for _ in range(r.randint(1, 40))) for _ in range(5000)})
    buf = np.frombuffer(b" ".join(spans), np.uint8)
    size = np.array([len(x) for x in spans])
    start = np.cumsum(size + 1) - size - 1
    both = text_module.span_hash(buf, start, start + size, 2)
    assert all(len(set(lane.tolist())) == len(spans) for lane in both)
    assert (text_module.span_hash(buf, start, start + size) == both[0]).all()


def test_token_files_read_back(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    token_files.write(docs, str(tmp_path / "a"), JSON, PATTERN, 2)
    got = {(r["doc_id"], r["ids_crc32"]): (r["start"], r["n_tokens"]) for r in token_files.read(spark, str(tmp_path / "a")).collect()}
    at = 0
    starts = []
    for i, t in sorted(texts()):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        starts.append(((i, zlib.crc32(np.array(ids, "<u4").tobytes())), (at, len(ids))))
        at += len(ids)
    assert set(dict(starts)) == set(got)
    assert all(got[k] == p for k, p in starts if k[0] != 99)
    token_files.write(empty, str(tmp_path / "b"), JSON, PATTERN, 2)
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


def test_short_pieces_are_encoded_once():
    """Their bytes don't count against the memo, whose numbers they are; before, more than 8 bytes a piece cleared it."""
    asked = []
    memo = pretokens.Memo(lambda found: [asked.append(x) or list(x) for x in found], PATTERN, most=1000)
    texts_ = [" ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}andmore" for i in range(k, k + 300)) for k in (0, 300, 600)] * 2
    for t in texts_:
        ids, n = memo.texts([t])
        assert bytes(ids.tolist()).decode() == t and n.tolist() == [len(t)]
    assert len(asked) == len(set(asked))


def test_memo_tells_pieces_apart_by_all_bytes():
    """Bytes of 0, lengths about the bound of short pieces, long pieces that differ at their end, a memo that is cleared."""
    r = random.Random(4)
    spans = [bytes(r.choice(b"\x00ab") for _ in range(r.choice((1, 2, 7, 8, 9, 14, 15, 16, 17, 30)))) for _ in range(6000)]
    spans += [b"\x00" * i for i in range(1, 20)] + [b"x" * 20 + bytes([i]) for i in range(50)]
    for most in (200, 1_000_000):
        memo = pretokens.Memo(lambda found: [[len(x), zlib.crc32(x)] for x in found], PATTERN, most)
        for k in range(0, 2 * len(spans), 500):
            part = [spans[i % len(spans)] for i in range(k, k + 500)]
            hi = np.cumsum([len(x) for x in part])
            ids, n = memo.lookup(np.frombuffer(b"".join(part), np.uint8), hi - [len(x) for x in part], hi)
            assert (n == 2).all() and ids.reshape(-1, 2).tolist() == [[len(x), zlib.crc32(x)] for x in part]


def test_grammar_decodes_each_document_alone():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = r.integers(0, 150, r.integers(1, 8))
        ids = r.integers(0, r.integers(2, 9), n.sum()).astype(np.uint32)
        g = token_files.compress(ids, n)
        row = {"terminals": g["terminals"]} | {x: g[x].astype("<i4").tobytes() for x in ("rules", "sizes", "symbols", "starts")}
        assert (token_files.decode_block(row) == ids).all()
        for j in range(len(n)):
            own = ids[n[:j].sum() : n[: j + 1].sum()]
            assert (token_files.decode_block(row, j) == own).all()
            if len(own):
                x, y = sorted(r.integers(0, len(own) + 1, 2).tolist())
                assert (token_files.decode_block(row, j, x, y) == own[x:y]).all()
        # no pair inside a document is left with as many uses, overlapping ones apart
        uses = collections.Counter()
        for j in range(len(n)):
            own, at = g["symbols"][g["starts"][j] : g["starts"][j + 1]].tolist(), -2
            for i, both in enumerate(zip(own, own[1:])):
                if at < i - 1 or both != last:
                    uses[both] += 1
                    at, last = i, both
        assert not uses or max(uses.values()) < token_files.LEAST_USES


def test_audio_is_lossless_and_the_same_for_equal_texts(docs, empty):
    text = dict(texts())
    seen = {}
    for r in audio.digests(docs).collect():
        raw = text[r["doc_id"]].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert seen.setdefault(raw, tuple(r)[1:]) == tuple(r)[1:]
    for r in audio.with_audio(docs).where("doc_id in (3, 95)").collect():
        clips = pa.ipc.open_stream(r["tensors"]).read_all()
        assert clips.schema.field("tensor").type.shape == [audio.CLIP, audio.MELS]
        assert audio.from_wav(r["media"])[0].rstrip() == text[r["doc_id"]].encode().rstrip()
    assert audio.digests(empty).count() == 0


def test_resampling_keeps_a_tone():
    t = np.arange(16_000) / 16_000
    for up, down in ((1, 2), (3, 4), (3, 2)):
        out = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), up, down)
        want = np.sin(2 * np.pi * 440 * np.arange(len(out)) * down / up / 16_000)
        assert len(out) == -(-16_000 * up // down)
        assert np.abs(out - want)[100:-100].max() < 0.02


def test_log_mel_and_segments_equal_brute_force():
    r = np.random.default_rng(5)
    for n in (1, 96, 255, 256, 257, 300, 384, 1000):
        x = r.normal(size=n).astype(np.float32)
        count = 1 if n <= 256 else 1 + -(-(n - 256) // 128)
        padded = np.concatenate([x, np.zeros(256 + 128 * (count - 1) - n)])
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
        edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 4000 / 700), 42) / 2595) - 1)
        want = np.zeros((count, 40))
        for f in range(count):
            frame = padded[128 * f : 128 * f + 256] * window
            power = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(256) / 256))) ** 2 for k in range(129)]
            for m in range(40):
                low, mid, high = edges[m : m + 3]
                tri = [max(0, min((k * 31.25 - low) / (mid - low), (high - k * 31.25) / (high - mid))) for k in range(129)]
                want[f, m] = np.log(np.dot(power, tri) + 1e-6)
        assert np.allclose(audio.log_mel(x, 8000.0), want, atol=2e-2)
    # a change of the last sample is seen
    x = r.normal(size=300).astype(np.float32)
    y = x.copy()
    y[-1] += 5
    assert (audio.log_mel(x, 8000.0) != audio.log_mel(y, 8000.0)).any()
    for _ in range(200):
        e = r.normal(size=r.integers(1, 40)).round(1)
        high, low, on, want = e.mean() + e.std() / 2, e.mean(), False, []
        for i, v in enumerate(e):
            if not on and v > high:
                on = True
                want.append([i, len(e)])
            elif on and v < low:
                on = False
                want[-1][1] = i
        assert audio.segments(e).tolist() == (want if e.std() >= 1e-6 else [])


def test_url_filters(spark):
    cases = [
        (1, "https://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://b.example.net/fr/", "b.example.net", "/fr/", "net/", "block"),
        (3, "http://example.com/de/x", "example.com", "/de/x", "example.com/de/", "block"),
        (4, "http://notexample.com/de/x", "notexample.com", "/de/x", None, "allow"),
        (5, "ftp://x.org/fr/?a", "x.org", "/fr/", "org/fr/", "allow"),
        (6, "http://x.org", "x.org", "", None, "allow"),
        (7, "http://net?x", "net", "", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "no scheme/net/", "", "", None, "allow"),
        (10, "http://www.casino-win.example.org/en/14", "www.casino-win.example.org", "/en/14", None, "block"),
        (11, "http://www.casino.example.org/fr/14", "www.casino.example.org", "/fr/14", "org/fr/", "allow"),
        (12, "a\nb://X.net/\n?", "x.net", "/\n", "net/", "block"),
    ]
    pages = spark.createDataFrame([(i, u, "old", "old") for i, u, *_ in cases], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, url_filters.HOST_RULES, url_filters.TOKEN_RULES).collect()}
    assert got == {c[0]: tuple(c[2:]) for c in cases}
    assert url_filters.judge(pages.limit(0), url_filters.HOST_RULES).count() == 0


def test_shards(docs, empty):
    rows = sharding.shard(docs, 6).collect()
    size = {i: len(t.encode()) + 8 for i, t in texts()}
    assert len(rows) == len(texts())
    assert all(r["size"] == size[r["doc_id"]] and r["text_crc32"] == zlib.crc32(dict(texts())[r["doc_id"]].encode()) for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty, 6).count() == 0


def test_shards_are_even_with_a_hot_text(spark):
    rows = [(i, "hot text of some length") for i in range(4000)] + [(i, f"text {i} " * (1 + i % 5)) for i in range(4000, 12000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    total = collections.Counter()
    for r in got:
        total[r["shard"]] += r["size"]
    assert len(total) == 24 and max(total.values()) - min(total.values()) < 200


def test_shard_boundaries_are_the_sampled_quantiles(spark):
    """Where measured sizes allow it the boundaries are those sampled, and other samples give others; a hot text is subdivided."""
    from pyspark.sql import functions as F

    rows = [(i, f"text {i} " * 5) for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select("doc_id", (F.octet_length("text").cast("long") + 8).alias("size"), F.shiftrightunsigned(F.xxhash64("text"), 12).alias("key"))
    keys = {r["doc_id"]: r["key"] for r in keyed.collect()}
    found = []
    for samples in (40_000, 20_000):
        bounds = sharding.splitters(keyed, 4 * 16, 4 * samples)[15::16]
        got = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 4, samples_per_shard=samples).collect()}
        assert got == {i: sum(b < k for b in bounds) for i, k in keys.items()}
        found.append(got)
    assert found[0] != found[1]
    assert sharding.joined_shards([100, 101, 99, 100], [False] * 3) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    assert sharding.joined_shards([100, 130, 70, 100], [False] * 3) == [(0, 1), (1, 2), (3, 1)]
    assert sharding.joined_shards([300, 50, 25, 25], [False] * 3) == [(0, 4)]
    assert sharding.joined_shards([100, 100, 100, 100], [True, False, False]) == [(0, 2), (2, 1), (3, 1)]


def test_shards_are_the_first_query_of_a_session(tmp_path):
    """As such, the search for a row's range became a filter of the measured ranges, which have no key."""
    code = f"""
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
text = F.concat(F.lit("text number "), F.col("id").cast("string"))
spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet({str(tmp_path / "docs")!r})
from panelspark.llm import sharding
print("rows:", len(sharding.shard(spark.read.parquet({str(tmp_path / "docs")!r}), 6, samples_per_shard=500).collect()))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "rows: 3000" in done.stdout, done.stderr[-2000:]


def test_shards_read_texts_once(spark):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert sharding.shard(rows.mapInArrow(counted, "doc_id long, text string"), 4, samples_per_shard=100).count() == 2000
    assert read.value == 2000


def test_shards_are_the_same_under_other_settings(spark, docs):
    """Neither partitions of shuffles nor those of the input change a shard; boundaries are exact quantiles of the sample."""
    rows = [(i, f"text {i} " * (1 + i % 50)) for i in range(5000)] + [(i, "hot") for i in range(5000, 7000)] + [(None, None), (1, "text 1 ")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    first = sorted(map(str, sharding.shard(table.repartition(3), 5, samples_per_shard=300).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        assert sorted(map(str, sharding.shard(table.repartition(11), 5, samples_per_shard=300).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    keyed = spark.createDataFrame([(i, i // 3, 1) for i in range(1000)], "doc_id long, key long, size long")
    assert sharding.splitters(keyed, 10, 1000) == [sorted(i // 3 for i in range(1000))[100 * b - 1] for b in range(1, 10)]


def test_another_seed_draws_another_mix(spark, docs):
    """Counts of shards are drawn, not dealt; they change with the seed, and totals meet the targets all the same."""
    plan = spark.createDataFrame([(1, 60_000, 40_000), (2, 20_000, 15_000), (3, 9, 5), (4, 0, 7)], "turn int, slots long, blocks long")
    seen = []
    for seed in (11, 12):
        table = mixing.mixture(plan, seed).collect()
        assert collections.Counter(r["turn"] for r in table) == {1: 60_000, 2: 20_000, 3: 9}
        for turn, slots, blocks in ((1, 60_000, 40_000), (2, 20_000, 15_000), (3, 9, 5)):
            uses = collections.Counter(r["index"] for r in table if r["turn"] == turn)
            assert max(uses.values()) <= 2 and all(0 <= i < blocks for i in uses) and len(uses) == min(slots, blocks)
        shards = collections.Counter((r["shard"], r["turn"]) for r in table)
        seen.append(shards)
        first = [n for (_, turn), n in sorted(shards.items()) if turn == 1][:-1]
        # binomial: as spread as draws are, around their share
        assert len(set(first)) > 1 and all(abs(n - 8192 * 60_000 / 80_009) < 6 * (8192 * 0.75 * 0.25) ** 0.5 for n in first)
    assert seen[0] != seen[1]
    a, b = (sorted(tuple(r) for r in mixing.mix(docs, share=0.7, block=16, seed=s).collect()) for s in (1, 2))
    assert a != b and [r[:4] for r in a] == [r[:4] for r in b]


def test_draws_alone_decide_the_shards(spark):
    """With the permutations' seed fixed, another seed of the draws deals the same blocks to other shards, as many to each as it drew."""
    plan = spark.createDataFrame([(1, 60_000, 40_000), (2, 20_000, 15_000)], "turn int, slots long, blocks long")
    seen = []
    for draw in (1, 2):
        table = mixing.mixture(plan, 7, draw).collect()
        drawn = collections.Counter({(r["shard"], r["turn"]): r["drawn"] for r in mixing.draws(spark, plan, draw).collect()})
        held = collections.Counter((r["shard"], r["turn"]) for r in table)
        total = {t: sum(n for (_, turn), n in drawn.items() if turn == t) for t in (1, 2)}
        wanted = {1: 60_000, 2: 20_000}
        assert all(abs(held[k] - n * wanted[k[1]] / total[k[1]]) <= 1 for k, n in drawn.items())
        seen.append((held, collections.Counter((r["turn"], r["index"]) for r in table)))
    assert seen[0][0] != seen[1][0] and seen[0][1] == seen[1][1]
    docs = spark.createDataFrame([(i, "w " * (i % 400), "ab"[i % 3 == 0]) for i in range(1, 6000)], "doc_id long, text string, source string")
    a, b = ({r["doc_id"]: r for r in mixing.mix(docs, block=16, seed=7, draw_seed=d).collect()} for d in (1, 2))
    assert all(a[i]["taken"] == b[i]["taken"] and a[i]["n_slots"] == b[i]["n_slots"] for i in a)
    assert any(a[i]["first_shard"] != b[i]["first_shard"] for i in a)


def test_shards_of_a_document_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, "w " * (i * 7 % 90), "ab"[i % 3 == 0]) for i in range(60)] + [(90, None, "a")], "doc_id long, text string, source string")
    scratch = mixing.Scratch(spark)
    sized, plan = mixing.packed(docs, 1.5, (3, 1, 2), 2.0, 16, 5, scratch)
    slots = collections.defaultdict(list)
    for r in mixing.mixture(plan, 5).collect():
        slots[r["turn"], r["index"]].append(r["shard"])
    turn = {r["source"]: r["turn"] for r in plan.collect()}
    got = {r["doc_id"]: r for r in mixing.mix(docs, block=16, seed=5).collect()}
    for source in ("a", "b"):
        at = 0
        for r in sorted((r for r in sized.collect() if r["source"] == source), key=lambda r: (r["bucket"], r["doc_id"], r["size"], r["tie"])):
            blocks = range(at // 16, (at + r["size"] - 1) // 16 + 1) if r["size"] else []
            held = [s for b in blocks for s in slots[turn[source], b]]
            words = sum(len(slots[turn[source], w // 16]) for w in range(at, at + r["size"]))
            mine = got[r["doc_id"]]
            assert (mine["taken"], mine["n_slots"], mine["first_shard"]) == (words, len(held), min(held, default=None))
            at += r["size"]


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs, block=16).collect()
    size = collections.Counter()
    for _, t, s in awkward():
        size[s] += len(WORD.findall(t or ""))
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        open_ -= full
    source = {i: s for i, _, s in awkward()}
    taken = collections.Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 48 for s in order)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(3), block=16).collect()))
    assert mixing.mix(empty).count() == 0


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 17, 100, 1009):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(0).cast("long")).alias("x"))
        assert sorted(r["x"] for r in df.collect()) == list(range(n))


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i < 70), 0) for i in range(100)] + [(3, None, 0), (10_000, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs.select("doc_id", "text"), model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(empty, model).count() == 0
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}


def test_quality_gradients():
    r = np.random.default_rng(2)
    m = quality.Attention()
    m.p["c"] = r.normal(size=quality.HIDDEN)
    first = np.array([0, 3, 4, 9])
    x, y = r.normal(size=(9, quality.FEATURES)), np.array([0.0, 1.0, 1.0])

    def loss():
        p = m.forward(x, first)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = m.gradients(m.forward(x, first), first, y)
    for k, v in m.p.items():
        at = tuple(0 for _ in v.shape)
        old = v[at]
        v[at] = old + 1e-6
        up = loss()
        v[at] = old - 1e-6
        down = loss()
        v[at] = old
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-6, k


def test_quality_learns_from_other_rows_than_those_held_out(spark):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["the", "river", "quiet", "morning", "walked", "Reader"]) + r.choice(["", "", ","]) for _ in range(150)) + "."
    bad = lambda: " ".join(r.choice(["$$$", "CLICK", "win!!!", "9", "#1", "free"]) for _ in range(60))
    # label 0: a bad passage somewhere in an otherwise good text
    rows = [(i, good() + " " + (bad() + " " if i % 2 else "") + good()) for i in range(400)]
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = lambda turn: spark.createDataFrame([(i, 1 - i % 2 if i not in held or not turn else i % 2) for i in range(400)], "doc_id long, quality int")
    model, other = quality.fit(docs, table(False)), quality.fit(docs, table(True))
    assert all((model.p[k] == other.p[k]).all() for k in model.p)
    got = {x["doc_id"]: x["score"] for x in quality.score(docs, model).collect()}
    assert sum((got[i] >= 0.5) == (i % 2 == 0) for i in held) >= 0.95 * len(held)
    marked = docs.select("doc_id", quality.held_out().alias("h")).collect()
    assert {x["doc_id"] for x in marked if x["h"]} == held
    # repeated rows and labels add nothing
    again = quality.fit(docs.unionByName(docs), table(False).unionByName(table(False)))
    assert all((model.p[k] == again.p[k]).all() for k in model.p)


def test_passages_equal_brute_force():
    texts = ["", "  ", " ".join(f"w{i % 50}" for i in range(200)), "A b, c! " * 70]
    column = pa.array(texts)
    x, first = quality.passages(*text_module.column_bytes(column))
    for d, t in enumerate(texts):
        w = WORD.findall(t)
        count = max(1, -(-len(w) // quality.PASSAGE))
        assert first[d + 1] - first[d] == count
        for p in range(count):
            own = w[p * quality.PASSAGE : (p + 1) * quality.PASSAGE]
            row = x[first[d] + p][quality._KINDS :]
            size = [len(v) for v in own] or [0]
            want = [np.log1p(np.mean(size)), np.log1p(np.std(size)), len(set(own)) / max(len(own), 1), sum(a == b for a, b in zip(own, own[1:])) / max(len(own), 1), np.log1p(len(own)) / 4, np.log1p(max(size)) / 4, not own, np.log1p(len(w)) / 8]
            assert np.allclose(row, want, atol=1e-4)
